"""Quality rules: counts, repeated windows, and how far a text's make-up is from that of languages."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pageloom.llm.text import SLICE, map_texts, text_bytes

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Texts with fewer letters or words are not held against a reference: their histograms say little.
MIN_CHARS, MIN_COMPARED = 200, 40
#: Largest Jensen-Shannon distances (base 2, 0 to 1) to the nearest language: of characters, of words, their sum.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MAX_SUM = 0.3, 0.92, 1.0
SYMBOLS = b"#*$%&|<>"
#: Fewest texts of a reference. Frequent words of a language stand in a share of its texts; a language with fewer than
#: LEAST_WORDS of them (it may set no blanks) is told by its characters alone.
MIN_DOCS, N_WORDS, WORD_SHARE, LEAST_WORDS = 10, 25, 0.1, 10
#: Frequent short words of four languages; those of others are found in the data.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or from at an which".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il avec".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an er so".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como o pero este".split(),
}
#: Classes of bytes: letters by case, digits, sentence marks, other marks, blanks, line ends, rest of UTF-8.
_CLASSES = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-", b"!?", b"#*$%&<>", b"|",
    b" ", b"\n", bytes(range(0xC0, 0x100))]
_CLASS_OF = np.full(256, len(_CLASSES), dtype=np.int64)
for _i, _chars in enumerate(_CLASSES):
    _CLASS_OF[list(_chars)] = _i
_CLASS_OF[0x80:0xC0] = -1  # continuation bytes: the code point is counted with its first byte
_N_CLASSES = len(_CLASSES) + 1
#: First bytes of letters by script: Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Indic and Thai, Georgian and others,
#: Chinese and Japanese, Korean, beyond the basic plane.
_SCRIPTS = [
    _CLASSES[0] + _CLASSES[1] + bytes(range(0xC3, 0xCA)), b"\xce\xcf", bytes(range(0xD0, 0xD4)), b"\xd4\xd5", b"\xd6\xd7",
    bytes(range(0xD8, 0xDC)), b"\xe0", b"\xe1", bytes(range(0xE3, 0xEA)), bytes(range(0xEA, 0xEE)), bytes(range(0xF0, 0xF5))]
_SCRIPT_BYTES = [list(x) for x in _SCRIPTS]


@dataclass
class References:
    """What texts are held against: for each language its shares of classes and of words (None: too few), its script."""
    words: list[bytes]
    of: dict[str, tuple[np.ndarray, np.ndarray | None, int]]


def _runs_found_twice(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that the text has at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    if len(number) == len(words):
        return 0
    width = 1
    while width < WINDOW:  # exact numbers of runs twice as long, from pairs of numbers
        ids = np.unique(ids[:-width] * (int(ids.max()) + 1) + ids[width:], return_inverse=True)[1].reshape(-1)
        width *= 2
    again = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _make_up(text: bytes, words: list[bytes], place: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte counts, character classes, common words."""
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    classes = np.zeros(_N_CLASSES)
    lead = _CLASS_OF >= 0
    np.add.at(classes, _CLASS_OF[lead], counts[lead])
    common = np.zeros(len(place))
    for word, n in Counter(filter(place.__contains__, words)).items():
        common[place[word]] = n
    return counts, classes, common


def _scripts(counts: np.ndarray) -> np.ndarray:
    return np.array([counts[x].sum() for x in _SCRIPT_BYTES], dtype=np.float64)


def _frequent(docs: DataFrame) -> dict[str, list[bytes]]:
    """The words that most texts of a language have, for the languages of ``docs`` that have enough texts and words.

    Counts are added up before the shuffle; N_WORDS a language reach the driver.
    """
    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                seen: Counter = Counter()
                for lang, text in zip(part.column(0).to_pylist(), text_bytes(part.column(1))):
                    seen.update((lang, w) for w in {*text.lower().split(), b""})  # b"" stands in each text
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([k for k, _ in seen], pa.string()), "word": pa.array([w for _, w in seen], pa.binary()),
                    "n": pa.array(list(seen.values()), pa.int64())})

    counts = docs.select("lang", F.col("text").cast("string")).mapInArrow(count, "lang string, word binary, n bigint")
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    rows = (
        counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= N_WORDS + 1).collect())
    texts = {r["lang"]: r["n"] for r in rows if not r["word"]}
    found: dict[str, list[bytes]] = {}
    for r in rows:
        if r["word"] and texts[r["lang"]] >= MIN_DOCS and r["n"] >= WORD_SHARE * texts[r["lang"]]:
            found.setdefault(r["lang"], []).append(bytes(r["word"]))
    return {lang: words for lang, words in found.items() if len(words) >= LEAST_WORDS}


def references(docs: DataFrame) -> References:
    """For each language with MIN_DOCS texts: mean shares of character classes and of common words, and the script.

    Over all rows of ``docs`` (text, lang); each document counts by the shares of its own text, so a very
    long one weighs no more than others. Sums are made before the shuffle; a few hundred of them for each
    language reach the driver, whatever the input. A language with fewer documents has no reference.
    """
    known = docs.where(F.col("lang").isNotNull() & (F.char_length("text") >= MIN_CHARS))
    lists = {k: [w.encode() for w in words] for k, words in COMMON_WORDS.items()} | _frequent(
        known.where(~F.col("lang").isin(*COMMON_WORDS)))
    words = sorted({w for x in lists.values() for w in x})
    place = {w: i for i, w in enumerate(words)}
    parts = [_N_CLASSES, _N_CLASSES + len(words), _N_CLASSES + len(words) + len(_SCRIPTS)]

    def make():
        def compute(texts):
            out = []
            for text in texts:
                counts, classes, common = _make_up(text, text.lower().split(), place)
                scripts = _scripts(counts)
                out.append(np.concatenate([x / max(1, x.sum()) for x in (classes, common, scripts)] + [[1.0]]).tolist())
            return [out]
        return compute

    sums = (
        map_texts(known, make, "shares array<double>", ("lang",))
        .select("lang", F.posexplode("shares").alias("i", "share")).where("share > 0")
        .groupBy("lang", "i").agg(F.sum("share").alias("share")))
    enough = sums.where((F.col("i") == parts[-1]) & (F.col("share") >= MIN_DOCS)).select("lang")
    made: dict[str, np.ndarray] = {}
    for r in sums.join(enough, "lang", "left_semi").collect():
        made.setdefault(r["lang"], np.zeros(parts[-1] + 1))[r["i"]] = r["share"]
    of = {}
    for lang, x in sorted(made.items()):
        classes, common, scripts, _ = np.split(x, parts)
        of[lang] = (classes / classes.sum(), common / max(1e-9, common.sum()) if lang in lists else None, int(scripts.argmax()))
    return References(words, of)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence, base 2: 0 for the same shares, 1 for disjoint ones."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, parts.sum() / 2)))


def _distances(classes: np.ndarray, common: np.ndarray, known: list) -> tuple[float, float]:
    """To the nearest reference, by characters and by common words; no common words: 1."""
    if not known:
        return 0.0, 0.0
    chars = min(js_distance(classes / classes.sum(), c) for c, _, _ in known)
    total = common.sum()
    return chars, min((js_distance(common / total, w) for _, w, _ in known if w is not None), default=1.0) if total else 1.0


def quality(docs: DataFrame, keep=("doc_id",), known: References | None = None) -> DataFrame:
    """The columns of ``keep``, counts, base_failed, distances and ``kept`` for each row of ``docs``.

    Words are what stands between ASCII white space. A text fails the base rules with fewer than 20 words
    or with over 30 percent of them in repeated eight-word windows; it is rejected too if it has
    MIN_CHARS code points and MIN_COMPARED words, and its character classes or common words are too far
    from every language. Null and empty texts have no words and fail. There is no such verdict on texts of
    a language without a reference; with a null lang, characters alone are judged, where some reference is
    in the text's script. Rows are judged one by one, so repeated rows get equal results; an empty table
    gives no rows. Two passes over the texts (three where lang is none of COMMON_WORDS), no shuffle of them.
    """
    known = references(docs) if known is None else known
    refs = list(known.of.values())
    place = {w: i for i, w in enumerate(known.words)}

    def make():
        def compute(texts):
            rows = []
            for text in texts:
                words = text.split()
                counts, classes, common = _make_up(text, [w.lower() for w in words], place)
                blank = int(counts[[32, 9, 10, 11, 12, 13]].sum())
                points = int(counts.sum() - counts[0x80:0xC0].sum())
                repeat = _runs_found_twice(words)
                failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words)
                chars = common_words = None
                if points >= MIN_CHARS and len(words) >= MIN_COMPARED:
                    chars, common_words = _distances(classes, common, refs)
                rows.append((len(words), points - blank, int(counts[list(SYMBOLS)].sum()), _repeated_lines(text),
                             repeat, failed, chars, common_words, int(_scripts(counts).argmax())))
            return [list(x) for x in zip(*rows)] if rows else [[]] * 9
        return compute

    judged = map_texts(
        docs.withColumn("_lang", F.col("lang")), make,
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, char_distance double, word_distance double, _script int", (*keep, "_lang"))
    one_of = lambda column, values: F.coalesce(F.col(column).isin(*values), F.lit(False)) if values else F.lit(False)
    chars, words = F.col("char_distance"), F.col("word_distance")
    far_words = one_of("_lang", [k for k, x in known.of.items() if x[1] is not None]) & (
        (words > MAX_WORD_DISTANCE) | (chars + words > MAX_SUM))
    compared = one_of("_lang", list(known.of)) | F.col("_lang").isNull() & one_of("_script", sorted({x[2] for x in refs}))
    far = F.coalesce(compared & ((chars > MAX_CHAR_DISTANCE) | far_words), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~far).select(
        *[F.col(f"`{c}`") for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "char_distance", "word_distance")
