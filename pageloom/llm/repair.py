"""Repair of conversations whose turns were lost, emptied, cut, repeated or mislabelled.

A repaired conversation's role initials are of ``(s?(ua)+)?``. Places between rows and the four states of that
grammar are the nodes of a graph, edits its arcs. Rows of all conversations are dealt by range into blocks of BLOCK rows,
so conversations of any length are spread: a first pass turns the stretches of conversations that cross a block's edge into
4 x 4 tables of least costs, whose products give each stretch the costs that follow it, then the state that it begins in.

Within a block all conversations are worked on at once. Least costs come from products of rows' tables over doubled
lengths; arcs on cheapest paths are kept; nodes are ranked by the least audits of 1, 2, 4, ... letters that begin at
them; ranks choose each node's arc, and doubled pointers read the paths.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.llm.order import in_order, stored
from pageloom.llm.sql import crc32_sql

BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS  # rows; divides a part's numbers, see order.PART_BITS

# States: nothing yet, after s, after u, after a. Rows and inserts lead from one to another.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
NONE = -1
#: By state, then initial (the last for any other).
KEPT = np.array([[SYSTEM, USER, NONE, NONE], [NONE, USER, NONE, NONE], [NONE, NONE, ASSISTANT, NONE], [NONE, USER, NONE, NONE]])
ADDED = np.array([USER, USER, ASSISTANT, USER])  # what an inserted or renamed turn makes of a state
NAMES = np.array([None, None, "user", "assistant"], dtype=object)
AT_END = np.array([0, 10, 5, 0])  # cost of the inserts that a state still needs
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
LETTERS = np.array(["", "D", "I", "K", "R"], dtype=object)  # ascending
FAR = 1 << 40
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _row_tables() -> np.ndarray:
    """Least costs from state to state over a row and inserts before it, by initial, must go, is cut."""
    insert = np.full((4, 4), FAR)
    insert[range(4), range(4)] = 0
    for s in range(4):
        once, twice = ADDED[s], ADDED[ADDED[s]]
        insert[s, once] = min(insert[s, once], INSERT)
        insert[s, twice] = min(insert[s, twice], 2 * INSERT)
    out = np.full((4, 2, 2, 4, 4), FAR)
    for initial, gone, cut in np.ndindex(4, 2, 2):
        row = np.full((4, 4), FAR)
        row[range(4), range(4)] = DELETE
        for s in range(4 if not gone else 0):
            row[s, ADDED[s]] = min(row[s, ADDED[s]], REROLE + CUT * cut)
            if KEPT[s, initial] != NONE:
                row[s, KEPT[s, initial]] = min(row[s, KEPT[s, initial]], KEEP + CUT * cut)
        out[initial, gone, cut] = _product(insert[None], row[None])[0]
    return out


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Min-plus products of stacked 4 x 4 tables."""
    return np.minimum((left[:, :, :, None] + right[:, None, :, :]).min(axis=2), FAR)


_TABLES = _row_tables()


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


class Stretches:
    """Stretches of conversations, one after the other: initial (0 to 3), gone and cut of each row, where each begins."""

    def __init__(self, initial: np.ndarray, gone: np.ndarray, cut: np.ndarray, starts: np.ndarray):
        self.initial, self.gone, self.cut, self.starts = initial, gone, cut, starts
        self.n = len(initial)
        self.ends = np.append(starts[1:], self.n)
        self.of = np.repeat(np.arange(len(starts)), self.ends - starts)
        # least costs from each row to the end of its stretch, over doubled lengths
        costs, length = _TABLES[initial, gone.astype(int), cut.astype(int)], 1
        while length < (self.ends - starts).max(initial=0):
            more = np.flatnonzero(np.arange(self.n) + length < self.ends[self.of])
            costs[more] = _product(costs[more], costs[more + length])
            length *= 2
        self.costs = costs

    def tables(self) -> np.ndarray:
        return self.costs[self.starts]

    def least_arcs(self, after: np.ndarray, last: np.ndarray) -> None:
        """Choose each node's arc. ``after``: costs that follow each stretch, by state; ``last``: whether it ends there."""
        n, states = self.n, np.arange(4)
        value = np.concatenate([(self.costs + after[self.of][:, None, :]).min(axis=2), after])
        place = np.arange(n)
        onward = np.where(place + 1 < self.ends[self.of], place + 1, n + self.of)  # the place behind a row
        count = len(value)
        target = np.zeros((len(LETTERS), count, 4), dtype=np.int64)
        cost = np.full((len(LETTERS), count, 4), FAR)
        cut, may = CUT * self.cut[:, None], ~self.gone[:, None]
        kept = KEPT[states[None, :], self.initial[:, None]]
        target[1, :n], cost[1, :n] = onward[:, None] * 4 + states, DELETE
        target[2], cost[2] = np.arange(count)[:, None] * 4 + ADDED, INSERT
        cost[2, n:][~last] = FAR
        target[3, :n] = onward[:, None] * 4 + np.maximum(kept, 0)
        cost[3, :n] = np.where(may & (kept != NONE), KEEP + cut, FAR)
        target[4, :n], cost[4, :n] = onward[:, None] * 4 + ADDED, np.where(may, REROLE + cut, FAR)
        value, target, cost = value.ravel(), target.reshape(len(LETTERS), -1), cost.reshape(len(LETTERS), -1)
        nodes = np.arange(len(value))
        best = cost + value[target] == value  # arcs on cheapest paths; no two of a node have the same letter
        best[0] = ~best[1:].any(axis=0)  # an audit ends here
        target[0] = nodes
        letters = np.arange(len(LETTERS))[:, None]
        rank = np.where(best, letters, len(LETTERS)).min(axis=0)
        step = target[rank, nodes]
        while True:  # ranks of the least audits of twice as many letters
            further = step[step]
            if (further == step).all():
                break
            rank, step = _dense(rank * len(value) + rank[step]), further
        chosen = np.where(best, letters * len(value) + rank[target], FAR).argmin(axis=0)
        self.letter, self.cost_of = chosen, np.where(chosen == 0, 0, cost[chosen, nodes])
        self.jumps, self.lengths = [target[chosen, nodes]], [(chosen > 0).astype(np.int64)]
        while (self.jumps[-1][self.jumps[-1]] != self.jumps[-1]).any():
            jump, length = self.jumps[-1], self.lengths[-1]
            self.jumps.append(jump[jump])
            self.lengths.append(length + length[jump])

    def exits(self) -> np.ndarray:
        """The state behind each stretch, by the state before it."""
        return (self.jumps[-1][self.starts[:, None] * 4 + np.arange(4)]) % 4

    def paths(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nodes of the paths from the stretches' states of entry: node, its place's row, number in the stretch's path."""
        begin = self.starts * 4 + entry
        lengths = self.lengths[-1][begin]
        number = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        node = np.repeat(begin, lengths)
        for bit, jump in enumerate(self.jumps):
            moved = (number >> bit & 1).astype(bool)
            node[moved] = jump[node[moved]]
        place = node // 4
        row = np.where(place < self.n, place, self.ends[np.repeat(np.arange(len(begin)), lengths)] - 1)
        return node, row, number


def _read(block: pd.DataFrame) -> tuple[pd.DataFrame, Stretches, np.ndarray]:
    block = block.sort_values("at", ignore_index=True)
    conv = block["conv"].to_numpy()
    starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
    fault = block["fault"].to_numpy()
    gone = (fault == "blank") | (fault == "duplicate")
    return block, Stretches(block["initial"].to_numpy(), gone, fault == "truncated", starts), conv[starts]


def _bounds(edges: pd.DataFrame, convs: np.ndarray) -> dict[str, np.ndarray]:
    """What is known of each stretch's surroundings; one that is whole begins with nothing and ends."""
    out = {"after": np.tile(AT_END, (len(convs), 1)), "last": np.ones(len(convs), bool),
           "entry": np.zeros(len(convs), int), "before": np.full(len(convs), NONE)}
    for edge in edges.itertuples():
        (at,) = np.flatnonzero(convs == edge.conv)
        out["after"][at], out["last"][at], out["before"][at] = edge.after, edge.last, edge.before
        out["entry"][at] = getattr(edge, "entry", START)
    return out


def _edge_tables(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    block, stretches, convs = _read(block)
    return pd.DataFrame({"conv": convs, "block": key[0], "costs": list(stretches.tables().reshape(-1, 16)),
                         "first": stretches.initial[stretches.starts], "final": stretches.initial[stretches.ends - 1]})


def _costs_after(edges: pd.DataFrame) -> pd.DataFrame:
    """For each stretch of a conversation the costs that follow it, and the initial before it."""
    edges = edges.sort_values("block", ignore_index=True)
    after = [AT_END]
    for costs in edges["costs"].iloc[:0:-1]:
        after.append((np.reshape(costs, (4, 4)) + after[-1]).min(axis=1))
    edges["after"], edges["last"] = after[::-1], edges.index == len(edges) - 1
    edges["before"] = [NONE, *edges["final"].iloc[:-1]]
    return edges[["conv", "block", "after", "last", "before"]]


def _edge_exits(block: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    block, stretches, convs = _read(block)
    known = _bounds(edges, convs)
    stretches.least_arcs(known["after"], known["last"])
    return edges.set_index("conv").loc[convs].reset_index().assign(exits=list(stretches.exits()))


def _entries(edges: pd.DataFrame) -> pd.DataFrame:
    edges = edges.sort_values("block", ignore_index=True)
    entry = [START]
    for exits in edges["exits"].iloc[:-1]:
        entry.append(exits[entry[-1]])
    return edges.assign(entry=entry)[["conv", "block", "after", "last", "before", "entry"]]


def _edit_rows(block: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    block, stretches, convs = _read(block)
    known = _bounds(edges, convs)
    stretches.least_arcs(known["after"], known["last"])
    node, row, number = stretches.paths(known["entry"])
    letter = stretches.letter[node]
    initial = stretches.initial
    previous = np.append(NONE, initial[:-1])
    previous[stretches.starts] = known["before"]
    illegal = np.array([p != NONE and (p, i) not in LEGAL for p, i in zip(previous, initial)])
    own = letter != 2  # the edit of the row itself, not one beside it
    return pd.DataFrame({
        "at": block["at"].to_numpy()[row], "step": number, "key": block["key"].to_numpy()[row],
        "edit": LETTERS[letter], "new_role": np.where(np.isin(letter, [2, 4]), NAMES[ADDED[node % 4]], None),
        "fault": np.where(own, block["fault"].to_numpy()[row], None), "illegal": own & illegal[row],
        "cost": stretches.cost_of[node]})


EDGE = "conv string, block bigint, after array<bigint>, last boolean, before int"
EDITS = "at bigint, step bigint, key binary, edit string, new_role string, fault string, illegal boolean, cost bigint"


def _digest(*values: Column) -> Column:
    """32 bytes that tell lists of strings apart."""
    told = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return F.unhex(F.sha2(F.concat(*told), 256))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` after the contract's damage, nulls as one space: conv_id, turn, role, text, copies (0: dropped)."""
    space = F.lit(" ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), space)
    turns = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"),
                         (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("harm"))
    return turns.select(
        "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1).cast("long").alias("copies"))


def repair(turns: DataFrame) -> DataFrame:
    """The cheapest edits of each conversation of ``turns`` (conv_id, turn, role, text, and copies: how often a row stands).

    One row per edit, ascending by (at, step) within a conversation: conv_id, at, step, edit (K, R, D, I), role and text of
    the turn it leaves (null for D), cost, and of K, R, D the row's fault (blank, duplicate, truncated) and whether its
    initial may not follow the one before (illegal). Rows are taken by turn (null first), then by a digest of role and
    text, so ties have an order and repeated rows are adjacent; rows with a null conv_id are a conversation; null roles and
    texts count as one space. Conversations without rows have no edits. Of cheapest audits the ASCII-least is taken.
    Other columns are not read. Texts are shuffled once; all else works on digests. Nothing reaches the driver.
    """
    rows = turns.where("copies > 0").select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies")
    rows = rows.withColumn("key", _digest(*[F.col(c) for c in ("conv_id", "turn", "role", "text")]))
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    first = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))  # 0 for others; an empty role is one of them
    # copies of a row within a task become one, so that repeats are few before the shuffle and none is exploded too far
    narrow = rows.select(
        "conv_id", "turn", "key", _digest(*[F.col(c) for c in ("conv_id", "role", "text")]).alias("said"),
        F.when((first > 0) & (F.col("role") != ""), first - 1).otherwise(3).alias("initial"),
        F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").alias("fault"),
        F.spark_partition_id().alias("task"), "copies")
    narrow = stored(narrow.groupBy(*[c for c in narrow.columns if c != "copies"]).agg(F.sum("copies").alias("copies")), "turns")
    seen = narrow.groupBy("said").agg(F.min(F.struct("turn", "task")).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = F.col("earliest").isNotNull() & ~(F.col("earliest.turn").eqNullSafe(F.col("turn")) & (F.col("earliest.task") == F.col("task")))
    each = narrow.join(seen, "said", "left").select(
        "conv_id", "turn", "said", "task", "key", "initial",
        F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        F.explode(F.expr("sequence(1, copies)")).alias("copy"), later.alias("later"), "fault")
    each = each.withColumn("fault", F.when(F.col("fault") == "blank", "blank").when(
        F.col("later") | (F.col("copy") > 1), "duplicate").otherwise(F.col("fault"))).drop("later")
    order = [F.col(c).asc() for c in ("conv_id", "turn", "said", "task", "copy")]
    ordered = in_order(stored(each, "each"), order, "ordered").select(
        "at", F.shiftright("at", BLOCK_BITS).alias("block"), "conv", "key", "initial", "fault")
    edges = _edges(ordered)
    edits = ordered.groupBy("block").cogroup(edges.groupBy("block")).applyInPandas(_edit_rows, EDITS)
    texts = rows.select("key", "conv_id", "role", "text").dropDuplicates(["key"])
    kept = F.col("edit") == "K"
    return edits.join(texts, "key").select(
        "conv_id", "at", "step", "edit", F.when(kept, F.col("role")).otherwise(F.col("new_role")).alias("role"),
        F.when(kept | (F.col("edit") == "R"), F.col("text")).when(F.col("edit") == "I", "").alias("text"), "cost", "fault", "illegal")


def _edges(ordered: DataFrame) -> DataFrame:
    """The surroundings of the stretches of conversations that cross blocks: at most two stretches a block.

    A conversation's own stretches, one for BLOCK rows, are combined in one place.
    """
    borders = ordered.groupBy("block").agg(F.min_by("conv", "at").alias("a"), F.max_by("conv", "at").alias("b"))
    borders = stored(borders.select("block", F.explode(F.array_distinct(F.array("a", "b"))).alias("conv")), "borders")
    crossing = borders.join(borders.groupBy("conv").count().where("count > 1"), "conv", "left_semi")
    parts = stored(ordered.join(crossing, ["block", "conv"], "left_semi"), "crossing")
    tables = parts.groupBy("block").applyInPandas(
        _edge_tables, "conv string, block bigint, costs array<bigint>, first int, final int")
    after = stored(tables.groupBy("conv").applyInPandas(_costs_after, EDGE), "after")
    exits = parts.groupBy("block").cogroup(after.groupBy("block")).applyInPandas(_edge_exits, EDGE + ", exits array<bigint>")
    return stored(exits.groupBy("conv").applyInPandas(_entries, EDGE + ", entry bigint"), "edges")


def repair_report(turns: DataFrame) -> DataFrame:
    """The contract's columns for every conversation of ``turns`` (with copies, see repair), also those without rows.

    A repaired conversation is one string here, so its turns meet in one row; repair itself spreads them.
    """
    some = F.when(F.col("copies") > 0, F.col("turn"))
    gaps = F.coalesce(F.max(some) - F.min(some) + 1 - F.count_distinct(some), F.lit(0)).cast("long")
    base = turns.groupBy("conv_id").agg(gaps.alias("gaps"))
    edits = repair(turns)
    said = F.concat("role", F.lit(":"), "text")  # null where deleted
    count = lambda what: F.count(F.when(what, 1))
    found = edits.groupBy(F.col("conv_id").alias("of")).agg(
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"), F.sum("cost").alias("cost"),
        F.array_sort(F.collect_list(F.struct("at", "step", "edit", said.alias("said")))).alias("steps"))
    found = found.select(
        "of", "blank", "duplicate", "truncated", "illegal", "cost",
        F.array_join(F.transform("steps", lambda s: s["edit"]), "").alias("audit"),
        F.sha2(F.array_join(F.transform("steps", lambda s: s["said"]), "\n"), 256).alias("repaired_sha256"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return base.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id", "gaps", *[zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_KEY_SQL = crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")
_WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
QUERY_SQL = f"""
with recursive
harmed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_KEY_SQL} % 20 as harm from conversations),
rows as (
  select conv_id, turn, case when harm = 4 then 'user' else role end as role,
    case when harm = 1 then '' when harm = 2 then translate(text, '.!?', '') else text end as text,
    unnest(range(case harm when 0 then 0 when 3 then 2 else 1 end)) as copy
  from harmed),
placed as (
  select *, left(role, 1) as initial, rtrim(text, {_WHITE_SQL}) as bare,
    row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as pos,
    count(*) over (partition by conv_id) as n,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as time
  from rows),
faulty as (
  select *, case when bare = '' then 'blank' when time > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' end as fault,
    lag(initial) over (partition by conv_id order by pos) || initial not in ('su', 'ua', 'au') as illegal
  from placed),
-- what an initial makes of a state (0 nothing yet, 1 after s, 2 after u, 3 after a)
moves(state, initial, becomes) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(state, becomes, cost, letters, said) as (
  values (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
    (0, 2, 5, 'I', 'user:' || chr(10)), (1, 2, 5, 'I', 'user:' || chr(10)), (3, 2, 5, 'I', 'user:' || chr(10)),
    (2, 3, 5, 'I', 'assistant:' || chr(10)),
    (0, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))),
edits as (  -- of each row, from state to state
  select conv_id, pos, s.state, s.state as becomes, 2 as cost, 'D' as letter, '' as said from faulty, range(4) s(state)
  union all
  select conv_id, pos, m.state, m.becomes, if(fault is null, 0, 5), 'K', role || ':' || text || chr(10)
  from faulty f join moves m on m.initial = f.initial where fault is null or fault = 'truncated'
  union all
  select conv_id, pos, m.state, m.becomes, if(fault is null, 1, 6), 'R', if(m.becomes = 2, 'user:', 'assistant:') || text || chr(10)
  from faulty, moves m where m.initial in ('u', 'a') and (fault is null or fault = 'truncated')),
steps as (
  select e.conv_id, e.pos, i.state, e.becomes, i.cost + e.cost as cost, i.letters || e.letter as letters, i.said || e.said as said
  from edits e join inserts i on i.becomes = e.state),
best(conv_id, pos, state, way) as (  -- the cheapest, then least, way from a state before a row to the end
  select conv_id, max(n) + 1, i.state, min(struct_pack(cost := i.cost, letters := i.letters, said := i.said))
  from faulty, inserts i where i.becomes = 3 or (i.state = 0 and i.becomes = 0) group by conv_id, i.state
  union all
  select s.conv_id, s.pos, s.state, min(struct_pack(cost := s.cost + way.cost, letters := s.letters || way.letters, said := s.said || way.said))
  from best b join steps s on s.conv_id is not distinct from b.conv_id and s.pos = b.pos - 1 and s.becomes = b.state
  group by s.conv_id, s.pos, s.state),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
    count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
    count(*) filter (where illegal) as illegal from faulty group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(way.cost, 0)::bigint as cost,
  coalesce(way.letters, '') as audit, sha256(coalesce(left(way.said, greatest(length(way.said) - 1, 0)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join counted on counted.conv_id is not distinct from c.conv_id
left join best b on b.conv_id is not distinct from c.conv_id and b.pos = 1 and b.state = 0
"""
