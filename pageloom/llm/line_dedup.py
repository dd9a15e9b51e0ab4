"""Line dedup: lines found in many documents are taken out of all of them.

Lines are exploded with their position, a line's key is hashed, distinct documents are counted for
each hash, and the lines that stay are put together again by position.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, functions as F

from pageloom.llm.order import stored
from pageloom.llm.text import map_texts, text_key

#: White space stripped at both ends of a line: space, and tab to carriage return.
BLANKS = b" \t\n\x0b\x0c\r"
#: Tasks over which one common line is dealt when its places are looked up.
SALTS = 16


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """A hash for each line: white space at its ends is left out, A-Z are lower-cased; null for a shorter one."""
    keys = [line.strip(BLANKS).lower() for line in text.split(b"\n")]
    return [md5(k).digest() if len(k) >= min_chars and (min_chars < 2 or len(k.decode()) >= min_chars) else None for k in keys]


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept for each row of ``docs`` (doc_id, text).

    Lines whose key has ``min_chars`` code points and stands in ``min_docs`` documents go everywhere.
    Null or empty text is one empty line, which stays. A document is a doc_id: rows that repeat an id
    count once for a key, each row still gets its own result. Null ids count as one document. Only
    doc_id and text are read, so other columns do not matter; an empty table gives no rows.

    Each line is hashed once, and the hashes are stored. Counting is by (key, document) before (key), so a
    line that all documents share is spread over all tasks; the places of common lines are looked up in salted
    parts, and only they are gathered by document. Texts move once, by document.
    """
    docs = docs.select("doc_id", "text")

    def make():
        return lambda texts: [[md5(t).digest() for t in texts], [line_keys(t, min_chars) for t in texts]]

    hashed = stored(map_texts(docs, make, "row binary, keys array<binary>"), "line-keys")
    common = stored(
        hashed.select("doc_id", F.explode(F.array_distinct("keys")).alias("key")).where("key is not null").distinct()
        .groupBy("key").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs).select("key"), "common-lines")
    salted = common.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    places = hashed.select("doc_id", "row", F.posexplode("keys").alias("pos", "key")).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)))
    # rows repeated whole give each position more than once
    gone = places.join(salted, ["key", "salt"]).groupBy("doc_id", "row").agg(F.collect_set("pos").alias("gone"))
    joined = docs.withColumn("row", text_key()).alias("d").join(
        gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.row") == F.col("g.row")), "left")
    lines = F.split(F.coalesce(F.col("d.text"), F.lit("")), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size("line") - 1), "gone")
    return joined.select(F.col("d.doc_id").alias("doc_id"), lines.alias("line"), "gone", F.col("d.row").alias("row")).select(
        "doc_id", F.size("line").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(F.when(F.col("gone").isNull(), F.col("line")).otherwise(
            F.transform(left, lambda p: F.get("line", p))), "\n").alias("kept"), "row")


QUERY_SQL = r"""
with lines as (
  select d.doc_id, u.pos, u.line,
    translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from documents d, lateral (select unnest(string_split(coalesce(d.text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) as pos) u),
common as (select key from lines where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where common.key is not null)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where common.key is null), '')) as kept_sha256
from lines left join common on lines.key = common.key
group by doc_id
"""
