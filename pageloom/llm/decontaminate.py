"""Benchmark decontamination: a prefix-filtered join of item windows with documents, verified exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.text import SLICE, text_bytes, text_key
from pageloom.session import scratch_path

WINDOW, SHINGLE = 13, 3
#: Slots of the bit table that every task gets; its size is fixed, however large the benchmark is.
FILTER_BITS = 23
#: Candidates in one row of the candidate table.
ROW_CANDIDATES = 256
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of ASCII letters, digits and everything outside ASCII."""
    return text.translate(_WORD_BYTES).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit value for each run of ``width`` words."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for i in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * _MIX + hashes[i:i + n]
    return (out ^ (out >> np.uint64(32))) * _MIX


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _windows(items: DataFrame) -> DataFrame:
    """item_id, window (words joined by a space), n, shingles (key, at) for each window of each item."""
    schema = "item_id string, window string, n int, shingles array<struct<key: bigint, at: int>>"

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                words = split_words(batch.column(1)[row].as_py() or b"")
                if not words:
                    continue
                n = min(WINDOW, len(words))
                keys = _shingles(_hashes(words), min(SHINGLE, n)).astype(np.int64).tolist()
                inside = n - min(SHINGLE, n) + 1
                starts = range(len(words) - n + 1)
                item = batch.column(0)[row].as_py()
                yield pa.RecordBatch.from_pydict({
                    "item_id": pa.array([item] * len(starts), pa.string()),
                    "window": [b" ".join(words[i:i + n]).decode() for i in starts],
                    "n": pa.array([n] * len(starts), pa.int32()),
                    "shingles": pa.array([[{"key": k, "at": a} for a, k in enumerate(keys[i:i + inside])] for i in starts],
                                         pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32())])))})

    return items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")
                        ).mapInArrow(run, schema)


def _bit_table(keys: DataFrame) -> bytes:
    """2**FILTER_BITS bits, set for the keys. What reaches the driver is bounded by that size."""
    slot = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    words = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))).alias("bits"))
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    got = words.toArrow()
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return table.tobytes()


def _hit_slots(table: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(table, dtype=np.uint8), bitorder="little").astype(bool)


def _counted(docs: DataFrame, table, widths: list[int]) -> DataFrame:
    """key, seen: how often shingles that pass the bit table stand in the documents."""
    def run(batches):
        passes = _hit_slots(table.value)
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, SLICE):
                for text in text_bytes(batch.slice(at, SLICE).column(0)):
                    hashes = _hashes(split_words(text))
                    for width in widths:
                        keys = _shingles(hashes, width)
                        found.append(keys[passes[_slot(keys)]])
            keys, seen = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(seen.astype(np.int64))], ["key", "seen"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key bigint, seen bigint")
    return parts.groupBy("key").agg(F.sum("seen").alias("seen"))


def _candidates(docs: DataFrame, table, widths: list[int]) -> DataFrame:
    """doc_id, row, n_words, first (one row of each document), found (key, pos, start, around)."""
    kind = pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int32()), ("start", pa.int32()), ("around", pa.string())]))

    def run(batches):
        passes = _hit_slots(table.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = []
                for i, text in enumerate(text_bytes(part.column(2))):
                    words = split_words(text)
                    hashes, found = _hashes(words), []
                    for width in widths:
                        keys = _shingles(hashes, width)
                        for pos in np.flatnonzero(passes[_slot(keys)]).tolist():
                            start = max(0, pos - WINDOW + width)
                            found.append({"key": int(keys[pos].astype(np.int64)), "pos": pos, "start": start,
                                          "around": b" ".join(words[start:pos + WINDOW]).decode()})
                    for cut in range(0, max(1, len(found)), ROW_CANDIDATES):
                        out.append((i, len(words), cut == 0, found[cut:cut + ROW_CANDIDATES]))
                take = pa.array([x[0] for x in out], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array([x[1] for x in out], pa.int64()),
                     pa.array([x[2] for x in out], pa.bool_()), pa.array([x[3] for x in out], kind)],
                    ["doc_id", "row", "n_words", "first", "found"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("row"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, row binary, n_words bigint, first boolean, "
             "found array<struct<key: bigint, pos: int, start: int, around: string>>")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (array of item ids, sorted as strings), contaminated, row.

    A window is 13 words in a row of an item, or a whole item of fewer. A document word inside any
    occurrence of a window is hit; ``contaminated`` if words are hit and they are 5 percent or more.
    Null, empty and blank texts have no words; items without words have no window; repeated items and
    windows count once, a null item_id adds hits but no item. Each row of ``docs`` gives one row, also if
    it repeats an id (``row`` is a digest of its text); other columns are not read.

    Containment is whole, so the one rarest shingle of a window is the prefix that any occurrence must
    have; rarity is counted over all documents. Shingles of documents pass a bit table of fixed size
    before they are joined with the prefixes by equality; the place of the prefix then fixes where the
    window would begin, and its words are compared. Only candidates leave the scan, with the words
    around them; a hot passage is spread by the join's skew handling.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "windows")
    _windows(items).write.parquet(path)
    told = spark.read.parquet(path)
    windows = told.groupBy("window").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    shingles = windows.select("window", "n", F.explode("shingles").alias("s")).select("window", "n", "s.key", "s.at")
    widths = sorted(min(SHINGLE, r["n"]) for r in told.select("n").distinct().collect())  # at most WINDOW values
    widths = sorted(set(widths))
    sent = []

    def table(keys):
        sent.append(spark.sparkContext.broadcast(_bit_table(keys)))
        return sent[-1]

    seen = _counted(docs, table(shingles.select("key")), widths)
    rarest = (
        shingles.join(seen, "key", "left").groupBy("window", "n")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "key", "at")).alias("rare"))
        .where("rare.seen > 0").select("window", "n", F.col("rare.key").alias("key"), F.col("rare.at").alias("at")))
    path = scratch_path(spark, "prefixes")
    rarest.write.parquet(path)
    prefixes = spark.read.parquet(path)
    path = scratch_path(spark, "candidates")
    _candidates(docs, table(prefixes.select("key")), widths).write.parquet(path)
    scanned = spark.read.parquet(path)
    found = scanned.select("doc_id", "row", "n_words", F.explode("found").alias("c")).select("doc_id", "row", "n_words", "c.*")
    begin = F.col("pos") - F.col("at")
    matched = (
        found.join(prefixes, "key")
        .where((begin >= 0) & (begin + F.col("n") <= F.col("n_words")))
        .where(F.array_join(F.slice(F.split("around", " "), begin - F.col("start") + 1, F.col("n")), " ") == F.col("window"))
        .select("doc_id", "row", begin.alias("begin"), (begin + F.col("n")).alias("end"), "window"))
    path = scratch_path(spark, "hits")
    matched.distinct().write.parquet(path)
    hits = spark.read.parquet(path)
    # a document's spans are at most its words times the lengths of windows
    spans = hits.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["upto"], s["end"]).alias("upto"),
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["begin"]))).cast("long").alias("n")),
        lambda a: a["n"])
    of_items = (
        hits.select("doc_id", "row", "window").distinct()
        .join(told.select("window", "item_id").distinct(), "window").select("doc_id", "row", "item_id").distinct()
        .groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.row") == F.col(f"{b}.row"))
    told_hits = spans.select("doc_id", "row", covered.alias("n_hit")).alias("h").join(
        of_items.alias("i"), same("h", "i"), "left").select("h.doc_id", "h.row", "h.n_hit", "i.items")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (
        scanned.where("first").select("doc_id", "row", "n_words").alias("d").join(told_hits.alias("h"), same("d", "h"), "left")
        .select("d.doc_id", "n_words", n_hit.alias("n_hit"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.col("d.row").alias("row")))
