"""Language identification by compression: a text is of the language whose sample makes it shortest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.llm.order import stored
from pageloom.llm.text import map_texts, text_key
from pageloom.llm.toxicity import held_out
from pageloom.operators.ranking import first_k_per_key

#: Bounds of the fit. Texts to be told are bounded by none of them.
MAX_LANGS = 200  # languages learned, those of most labelled texts first
SAMPLE_TEXTS = 512  # different texts a language is learned from at most, chosen by hash
PIECE = 256  # code points taken of each, at a place that a hash chooses
SAMPLE_CHARS = 32_768  # of a language's dictionary

WINDOW = 2048  # bytes encoded at once, so that the dictionary matters as much at the end of a long text
LEVEL = 6
MARGIN = 0.02  # of the smallest size: a narrower lead is rejected
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """Languages, those of most labelled texts first, and the raw content of their dictionaries."""
    langs: list[str]
    contents: list[bytes]


def fold(text: bytes) -> bytes:
    return text.lower()  # A-Z alone


def _piece(text: Column) -> Column:
    """PIECE code points of a text, from a place that its crc32 chooses."""
    room = F.greatest(F.char_length(text) - PIECE + 1, F.lit(1))
    return F.substring(text, (F.crc32(text.cast("binary")) % room + 1).cast("int"), F.lit(PIECE))


def fit(docs: DataFrame) -> Model:
    """Dictionaries from rows of ``docs`` (doc_id, text, lang) that are not held out, have a lang and a letter.

    Copies of a text count once. The texts of a language are those of the least hashes; at most MAX_LANGS *
    SAMPLE_CHARS code points (and one piece a language) reach the driver, whatever ``docs`` holds.
    """
    rows = docs.select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
        held_out(F.col("doc_id")).alias("out"))
    rows = rows.where(~F.col("out") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    texts = stored(rows.select("lang", text_key().alias("key")).groupBy("lang", "key").agg(F.count(F.lit(1)).alias("copies")), "texts")
    langs = texts.groupBy("lang").agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    order = [r["lang"] for r in langs.collect()]
    chosen = stored(first_k_per_key(texts.join(langs.select("lang"), "lang", "left_semi"), ["lang"], ["key"], F.lit(SAMPLE_TEXTS)), "chosen")
    pieces = rows.select("lang", text_key().alias("key"), _piece(F.col("text")).alias("piece")).join(
        chosen.select("lang", "key"), ["lang", "key"]).dropDuplicates(["lang", "key"])
    so_far = F.sum(F.char_length("piece")).over(Window.partitionBy("lang").orderBy("key"))  # SAMPLE_TEXTS rows at most
    taken = pieces.withColumn("so_far", so_far).where(F.col("so_far") - F.char_length("piece") < SAMPLE_CHARS)
    found: dict[str, list[tuple[bytes, str]]] = {lang: [] for lang in order}
    for r in taken.select("lang", "key", "piece").collect():
        found[r["lang"]].append((bytes(r["key"]), r["piece"]))
    return Model(order, [fold("\n".join(piece for _, piece in sorted(found[lang])).encode()) for lang in order])


def encoders(model: Model) -> list[zstandard.ZstdCompressor]:
    made = []
    for content in model.contents:
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(
            level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected of each row of ``docs`` (doc_id, text).

    A whole text is encoded window by window with each language's dictionary; the smallest sum wins, of equal ones
    the language of most labelled texts. ``margin`` is the lead over the second as a share of the smallest size;
    a lead under MARGIN is ``rejected`` (the prediction stands beside it). ``score`` falls with the other languages'
    closeness. Null texts, those without a letter, and all if nothing was learned, are UNKNOWN: score and margin 0,
    rejected. One language learned alone leads by everything. Repeated rows stay; other columns are not read.
    """
    langs = model.langs

    def make():
        tools = encoders(model)

        def tell(texts: list[bytes]):
            preds, scores, margins = [], [], []
            for text in texts:
                if not tools or not _LETTER.search(text.decode()):
                    preds.append(UNKNOWN), scores.append(0.0), margins.append(0.0)
                    continue
                text = fold(text)
                windows = [text[i:i + WINDOW] for i in range(0, len(text), WINDOW)]
                sizes = np.array([sum(len(tool.compress(w)) for w in windows) for tool in tools])
                best = int(sizes.argmin())
                lead = np.delete(sizes, best) - sizes[best]
                preds.append(langs[best])
                scores.append(float(1 / (1 + np.exp(-lead / (1 + 0.01 * sizes[best])).sum())))
                margins.append(float(lead.min() / sizes[best]) if len(lead) else 1.0)
            return preds, scores, margins
        return tell

    told = map_texts(docs, make, "lang_pred string, score double, margin double")
    return told.withColumn("rejected", F.col("margin") < MARGIN)
