"""Merkle manifest of a dataset: a tree per source over its documents, a tree of the sources' roots above, proofs of all rows.

Trees are cut into superblocks of ARITY ** LEVELS consecutive nodes. A first pass reduces each superblock to one node;
these are the nodes of the next tier, until every source, and then the table, is one node. Proofs come down again:
at each tier the nodes of a superblock are cogrouped with the nodes outside it that its proofs need (at most two a
level), and reduced, joined with those and folded in one function. A group never holds more than a superblock.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.llm.order import group_runs, in_order, part_of, stored
from pageloom.llm.sql import crc32_sql

ARITY = 3
LEVELS = 6  # of a superblock: 729 nodes
#: Steps of a proof are numbered upwards; those of the tree over the sources from here on.
ABOVE = 1_000
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEP = "tree bigint, block bigint, place int, left string, right string"
PROOF = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_digest(values: list[Column]) -> Column:
    """Digest (32 bytes) of values, each told by its length in bytes; null is '-'."""
    told = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
            for v in (v.cast("string") for v in values)]
    return F.unhex(F.sha2(F.concat(*told), 256))


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The contract's damage: no line ends in texts of rows whose id has an even crc32."""
    even = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def _levels(nodes: list[str], height: int, in_larger: bool) -> list[list[str]]:
    """The levels of a superblock, nodes first; one that is a whole tree ends as soon as one node is left."""
    levels = [nodes]
    while len(levels) <= height and (in_larger or len(levels[-1]) > 1):
        last = levels[-1]
        levels.append([_h("".join(last[i:i + ARITY])) for i in range(0, len(last), ARITY)])
    return levels


def _siblings(levels: list[list[str]], at: int) -> Iterator[tuple[str, str]]:
    """What stands left and right of a node's ancestors in their runs, upwards."""
    for level in levels[:-1]:
        run = at // ARITY * ARITY
        yield "".join(level[run:at]), "".join(level[at + 1:run + ARITY])
        at //= ARITY


def _fold(digest: str, steps: list[tuple[str, str]]) -> str:
    for left, right in steps:
        digest = _h(left + digest + right)
    return digest


def _read_block(nodes: pd.DataFrame, height: int) -> tuple[pd.DataFrame, list[list[str]]]:
    nodes = nodes.sort_values("rank")
    return nodes, _levels([x.hex() for x in nodes["digest"]], height, bool(nodes["n"].iloc[0] > ARITY**height))


def block_roots(nodes: DataFrame, height: int = LEVELS) -> DataFrame:
    """The nodes of the next tier (tree, rank, n, digest), from those of a tier: one for each superblock."""
    def reduce(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        (top,) = _read_block(block, height)[1][-1]
        return pd.DataFrame({"tree": [key[0]], "rank": [key[1]], "n": [-(-int(block["n"].iloc[0]) // ARITY**height)],
                             "digest": [bytes.fromhex(top)]})

    return _by_block(nodes.select("tree", "rank", "n", "digest"), height).applyInPandas(
        reduce, "tree bigint, rank bigint, n bigint, digest binary")


def _steps_down(nodes: DataFrame, outer: DataFrame, first_place: int, height: int) -> DataFrame:
    """The steps from each node of a tier to the root: what the superblock below it needs from outside (STEP)."""
    def join(key: tuple, block: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        block, levels = _read_block(block, height)
        beyond = list(outside.sort_values("place")[["place", "left", "right"]].itertuples(index=False, name=None))
        rows = [(key[0], rank, place, left, right) for at, rank in enumerate(block["rank"]) for place, left, right in [
            *((first_place + i, *pair) for i, pair in enumerate(_siblings(levels, at))), *beyond]]
        return pd.DataFrame(rows, columns=["tree", "block", "place", "left", "right"])

    return _by_block(nodes, height).cogroup(outer.groupBy("tree", "block")).applyInPandas(join, STEP)


def _by_block(nodes: DataFrame, height: int):
    return nodes.withColumn("block", F.expr(f"rank div {ARITY**height}")).groupBy("tree", "block")


def _tiers(nodes: DataFrame, height: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The tables of nodes of each tier, and beside each the roots of the trees that end with it."""
    tiers, ended = [], []
    while True:
        above = stored(block_roots(nodes, height), "nodes")
        tiers.append(nodes)
        ended.append(above.where("n = 1"))
        nodes = above.where("n > 1")
        if (above.agg(F.max("n")).first()[0] or 1) == 1:
            return tiers, ended


def manifest(docs: DataFrame, tampered: Column | None = None, height: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of ``docs``.

    ``docs`` has FIELDS; other columns are not read. A row's leaf is made of all FIELDS; ``tampered`` is the text that
    the row is verified with (default: its own). Null values have a digest of their own; rows of a null source are
    a source, the first; within a source rows ascend by doc_id (null first), then by digest, so ties and repeated
    rows have places, each its own proof. An empty table has no rows and no root.

    ``height`` is that of a superblock. ``folded_root`` is the leaf of the text to verify, folded with the siblings of the untampered tree;
    ``proof_sha256`` is of those siblings. A whole text is read once; all else works on digests. One digest
    (the root), the number of sources and one number a tier reach the driver.
    """
    own = [F.col(c) for c in FIELDS]
    checked = leaf_digest([*own[:-1], tampered if tampered is not None else own[-1]])
    leaf = leaf_digest(own)
    rows = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf.alias("digest"), checked.alias("checked"))
                  .withColumn("row", F.monotonically_increasing_id()), "leaves")
    # asc() has nulls first; repeated rows differ by their place in the stored table, so they can be dealt apart
    rows = in_order(rows, [F.col(c).asc() for c in ("source", "doc_id", "digest", "row")], "ordered")
    runs = stored(group_runs(rows, "source"), "sources")
    of_run = runs.select(F.col("part").alias("of_part"), F.col("source").alias("of_source"), "before", "first",
                         F.col("n"), F.col("group_no").alias("tree"))
    leaves = rows.join(of_run, (part_of() == F.col("of_part")) & F.col("source").eqNullSafe(F.col("of_source"))).select(
        "doc_id", "tree", (F.col("before") + F.col("at") - F.col("first")).alias("rank"), "n", "digest", "checked")
    tiers, ended = _tiers(leaves, height)
    n_sources = (runs.agg(F.max("group_no")).first()[0] if runs.head(1) else -1) + 1
    subroots = ended[0]
    for more in ended[1:]:
        subroots = subroots.unionByName(more)
    top = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"),
                          F.lit(n_sources).cast("long").alias("n"), "digest")
    top_tiers, top_ended = _tiers(top, height)
    last = top_ended[-1].first()
    root = bytes(last["digest"]).hex() if last else None

    outer = docs.sparkSession.createDataFrame([], STEP)
    for i in range(len(top_tiers) - 1, -1, -1):
        outer = _steps_down(top_tiers[i], outer, ABOVE + i * height, height)
    outer = stored(outer, "steps")  # of the sources' roots: block is the source
    from_root = outer.select(F.col("block").alias("tree"), F.lit(0).cast("long").alias("block"), "place", "left", "right")
    below = outer.limit(0)
    for i in range(len(tiers) - 1, -1, -1):
        below = below.unionByName(from_root.join(ended[i].select("tree"), "tree", "left_semi").select(*below.columns))
        if i:
            below = stored(_steps_down(tiers[i], below, i * height, height), "steps")
    # pandas has no integers beside nulls, so ids pass it as text
    done = _by_block(leaves.withColumn("doc_id", F.col("doc_id").cast("string")), height).cogroup(
        below.groupBy("tree", "block")).applyInPandas(_finisher(root, height), f"doc_id string, {PROOF}")
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _finisher(root: str | None, height: int):
    """Reduces a superblock of leaves, joins its proofs with the nodes outside it and folds them."""
    def finish(block: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        block, levels = _read_block(block, height)
        outside = outside.sort_values("place")
        beyond = list(zip(outside["left"], outside["right"]))
        within = [step for step, place in zip(beyond, outside["place"]) if place < ABOVE]
        rest = "".join(left + right for left, right in beyond)
        subroot = _fold(levels[-1][0], within)
        rows = []
        for at, (doc_id, checked) in enumerate(zip(block["doc_id"], block["checked"])):
            steps = list(_siblings(levels, at))
            folded = _fold(_fold(checked.hex(), steps), beyond)
            proof = _h("".join(left + right for left, right in steps) + rest)
            rows.append((doc_id, levels[0][at], subroot, root, proof, folded, folded == root))
        return pd.DataFrame(rows, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    return finish


def _told_sql(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::varchar))::varchar || ':' || {value}::varchar, '-')"


_HEAD_SQL = " || ".join(_told_sql(c) for c in FIELDS[:-1])
QUERY_SQL = f"""
with recursive
rows as (
  select doc_id, source, sha256({_HEAD_SQL} || {_told_sql("text")}) as leaf,
    sha256({_HEAD_SQL} || {_told_sql("case when " + crc32_sql("doc_id::varchar") + " % 2 = 0 then replace(text, chr(10), '') else text end")}) as checked
  from documents),
placed as (
  select *, row_number() over () as row, dense_rank() over (order by source nulls first) - 1 as tree,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos,
    count(*) over (partition by source) as n from rows),
-- levels of each source's tree, then those of the tree over the sources' roots
nodes(level, tree, pos, h, n) as (
  select 0, tree, pos, leaf, n from placed
  union all
  select level + 1, tree, pos // 3, sha256(string_agg(h, '' order by pos)), max((n + 2) // 3)
  from nodes where n > 1 group by level, tree, pos // 3),
top(level, pos, h, n) as (
  select 0, tree, h, count(*) over () from nodes where n = 1
  union all
  select level + 1, pos // 3, sha256(string_agg(h, '' order by pos)), max((n + 2) // 3)
  from top where n > 1 group by level, pos // 3),
runs as (
  select level, tree, pos // 3 as run, list(struct_pack(pos := pos, h := h) order by pos) as members
  from (select level, tree, pos, h from nodes where n > 1 union all select level, -1, pos, h from top where n > 1)
  group by level, tree, pos // 3),
siblings as (
  select level, tree, m.pos as pos,
    array_to_string(list_transform(list_filter(members, lambda x: x.pos < m.pos), lambda x: x.h), '') as before,
    array_to_string(list_transform(list_filter(members, lambda x: x.pos > m.pos), lambda x: x.h), '') as after
  from (select *, unnest(members) as m from runs)),
inside(row, level, tree, pos, h, proof) as (
  select row, 0, tree, pos, checked, '' from placed
  union all
  select i.row, i.level + 1, i.tree, i.pos // 3, sha256(s.before || i.h || s.after), i.proof || s.before || s.after
  from inside i join siblings s on s.level = i.level and s.tree = i.tree and s.pos = i.pos),
above(row, level, pos, h, proof) as (
  select row, 0, tree, h, proof from inside qualify row_number() over (partition by row order by level desc) = 1
  union all
  select a.row, a.level + 1, a.pos // 3, sha256(s.before || a.h || s.after), a.proof || s.before || s.after
  from above a join siblings s on s.level = a.level and s.tree = -1 and s.pos = a.pos),
folded as (select * from above qualify row_number() over (partition by row order by level desc) = 1)
select p.doc_id, p.leaf, s.h as subroot, r.h as root, sha256(f.proof) as proof_sha256, f.h as folded_root, f.h = r.h as verified
from placed p join folded f on f.row = p.row join nodes s on s.tree = p.tree and s.n = 1, (select h from top where n = 1) r
"""
