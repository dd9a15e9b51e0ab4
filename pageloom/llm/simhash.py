"""SimHash near-dedup: fingerprints, links at few differing bits, components."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.llm.components import components
from pageloom.llm.text import map_texts
from pageloom.session import scratch_path

SHINGLE, SEED, BITS = 3, 42, 64
#: Fingerprints link at this many differing bits or fewer: one of two halves then differs in at most one.
MAX_BITS = 2
#: Members of one variant key that are still compared with each other; larger keys go another exact way.
PAIRWISE = 48
_PART = 1 << 18


def _fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _PART):
        part = words[at:at + _PART + SHINGLE - 1]
        shingles = map(b" ".join, zip(part, part[1:], part[2:])) if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.array([digest(s, SEED) for s in shingles], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, keep=("doc_id",), text: str = "text") -> DataFrame:
    """The columns of ``keep`` and ``fp`` (64 bits as a long).

    Words are what is left between ASCII white space after A-Z are lower-cased; a bit is set if it is in
    over half of the XXH64 hashes (seed 42) of all runs of three words. Fewer words make one run, no
    words (null, empty or blank text) give 0.
    """
    return map_texts(docs, lambda: lambda texts: [[_fingerprint(t) for t in texts]], "fp long", keep, text)


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), number)


def _variants(fp: Column) -> Column:
    """64 keys: either half of the fingerprint with one bit cleared; above, the number of that bit."""
    def of(half: int) -> Column:
        value = (F.shiftrightunsigned(fp, 32) if half else fp).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.transform(
            F.sequence(F.lit(0), F.lit(31)),
            lambda j: value.bitwiseAND(F.bitwise_not(_bit(j))).bitwiseOR(
                F.call_function("shiftleft", (j + 32 * half).cast("long"), F.lit(32))))
    return F.concat(of(0), of(1))


def links(prints: DataFrame) -> DataFrame:
    """a, b: links between the distinct fingerprints of ``prints`` (fp), a > b, enough for all components.

    Every pair at MAX_BITS or fewer differing bits is a link or joined by links. A pair shares the
    variant of a half that differs in at most one bit. Keys with at most PAIRWISE fingerprints are
    joined and verified pair by pair. All fingerprints of larger keys are linked over shared one-bit
    neighbours: two of them are at most two bits apart exactly if a value exists within one bit of both,
    so each gives its 65 values, and all that meet in a value (65 at most) are linked to the smallest.
    Both ways are exact, and neither makes more than 65 rows or PAIRWISE partners per key for a
    fingerprint, whatever the size of a group.
    """
    # 64 rows come from each: small partitions, which the planner would put together by their present size. Dealt
    # by a hash of its own: by fp alone they lie so already, and the planner would drop the exchange
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = prints.where("fp is not null").select("fp").repartition(parts, F.xxhash64("fp"))
    keyed = prints.select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    keys = sizes.where("n > 1")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    twos = keys.where("n = 2").select(F.col("high").alias("a"), F.col("low").alias("b")).where(near)
    members = keyed.join(keys.where("n > 2").select("key", "n"), "key")
    few = members.where(F.col("n") <= PAIRWISE)
    some = (
        few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key")
        .where("a > b").where(near).select("a", "b"))
    hot = members.where(F.col("n") > PAIRWISE).select("fp").distinct()
    centres = F.concat(F.array("fp"), F.transform(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        lambda j: F.col("fp").bitwiseXOR(_bit(j))))
    around = hot.select("fp", F.explode(centres).alias("centre"))
    first = around.groupBy("centre").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    many = around.join(first, "centre").select(F.col("fp").alias("a"), "b").where("a > b")
    return twos.unionByName(some).unionByName(many).distinct()


def near_duplicates(docs: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links, the row's own included. Rows that repeat
    an id or a text are kept; a null id gets a component like any other and is null as a component only
    if no row of it has an id. Texts without words link like any other. Other columns are not read; an
    empty table gives no rows. Fingerprints are written once to the shared folder, then only they move;
    copies are one fingerprint before anything is joined.
    """
    spark = docs.sparkSession
    if prints is None:
        path = scratch_path(spark, "simhash")
        fingerprints(docs).write.parquet(path)
        prints = spark.read.parquet(path)
    each = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(each))
    labelled = each.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return prints.join(named, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
