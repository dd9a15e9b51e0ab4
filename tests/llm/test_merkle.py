"""The manifest against a tree built in plain Python."""

import zlib
from hashlib import sha256

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pageloom.llm import merkle

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return _h(*[told(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def _siblings(levels, at):
    for level in levels[:-1]:
        run = at // 3 * 3
        yield level[run:at], level[at + 1:run + 3]
        at //= 3


def _plain(rows):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r, r["text"])))
          for s in sources}
    trees = [_tree([_leaf(r, r["text"]) for r in of[s]]) for s in sources]
    top, out = _tree([t[-1][0] for t in trees]), []
    for k, (s, tree) in enumerate(zip(sources, trees)):
        for i, r in enumerate(of[s]):
            steps, text = [*_siblings(tree, i), *_siblings(top, k)], r["text"]
            if text and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            digest = _leaf(r, text)
            for left, right in steps:
                digest = _h(*left, digest, *right)
            out.append((r["doc_id"], tree[0][i], tree[-1][0], top[-1][0], _h(*[x for a, b in steps for x in a + b]), digest, digest == top[-1][0]))
    return sorted(out, key=repr)


def _got(docs, height=merkle.LEVELS):
    found = merkle.manifest(docs, merkle.tampered_text(F.col("doc_id"), F.col("text")), height)
    return sorted([tuple(r) for r in found.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=repr)


@pytest.mark.parametrize("height", [1, 6])
def test_given_table_in_one_tier_and_in_many(spark, height):
    """Superblocks of 3 nodes give many tiers, those of 729 one."""
    path = "/root/testdata/sf0.001/documents.parquet"
    got = _got(spark.read.parquet(path), height)
    assert got == _plain(pq.read_table(path).to_pylist())
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(1, "a\nb", "en", "x", 3), (1, "a\nb", "en", "x", 3), (1, None, None, None, None), (None, "", "en", None, 0),
            (2, "ü\n", None, "y", 2), (2, "other", None, "y", 5), (None, "\n", "en", "x", 1), (7, "long " * 30_000, "de", "ÿ", 9)]
    docs = spark.createDataFrame([(*r, "clash", 5, 6) for r in rows], FIELDS + ", tree string, at int, digest int")
    names = ("doc_id", "text", "lang", "source", "n_chars")
    assert _got(docs) == _plain([dict(zip(names, r)) for r in rows])
    assert _got(docs.limit(0)) == []
    (alone,) = _got(docs.where("doc_id = 7"))
    assert alone[1] == alone[2] == alone[3] and alone[4] == sha256(b"").hexdigest() and alone[6]


def test_untampered_rows_verify(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t\n").alias("text"), F.lit("en").alias("lang"),
                                    F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("source"),
                                    F.lit(2).alias("n_chars"))
    assert merkle.manifest(docs).where("verified").count() == 3000
