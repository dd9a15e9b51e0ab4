"""Conversation repair against a plain search of all edits."""

import random
import zlib
from functools import lru_cache
from hashlib import sha256

import pyarrow.parquet as pq
import pytest

from pageloom.llm import repair

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
WHITE = " \t\n\x0b\x0c\r"
GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def _key(*values):
    told = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return sha256("".join(told).encode()).digest()


def _cheapest(rows):
    """Least (cost, audit, turns) of (role, text, fault) rows, by trying each edit at each place."""
    @lru_cache(None)
    def best(at, state, added):
        options = [(0, "", ())] if at == len(rows) and state in ("", "a") else []
        into = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[into]
        if added < 3:
            cost, audit, turns = best(at, into, added + 1)
            options.append((cost + 5, "I" + audit, (f"{name}:", *turns)))
        if at < len(rows):
            role, text, fault = rows[at]
            cost, audit, turns = best(at + 1, state, 0)
            options.append((cost + 2, "D" + audit, turns))
            if fault in (None, "truncated"):
                more = 5 if fault else 0
                cost, audit, turns = best(at + 1, into, 0)
                options.append((cost + 1 + more, "R" + audit, (f"{name}:{text}", *turns)))
                kept = GRAMMAR.get((state, role[:1]))
                if kept:
                    cost, audit, turns = best(at + 1, kept, 0)
                    options.append((cost + more, "K" + audit, (f"{role}:{text}", *turns)))
        return min(options, default=(10**9, "", ()))  # too many inserts
    for at in range(len(rows), 0, -1):  # so that no call is deep
        for state in GRAMMAR.values():
            best(at, state, 0)
    return best(0, "", 0)


def _plain(rows, harm=True):
    out = []
    for conv in {r[0] for r in rows}:
        left = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            told = " " if turn is None else turn
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{told}".encode()) % 20 if harm else 9
            text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
            left += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, _key(conv, *r[1:])))
        judged, seen = [], set()
        for _, role, text in left:
            bare = text.rstrip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            judged.append((role, text, fault))
            seen.add((role, text))
        turns = {t for t, _, _ in left if t is not None}
        cost, audit, kept = _cheapest(tuple(judged))
        pairs = zip(judged, judged[1:])
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                    *[sum(f == kind for _, _, f in judged) for kind in ("blank", "duplicate", "truncated")],
                    sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit,
                    sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def _got(turns):
    return sorted([tuple(r) for r in repair.repair_report(turns).select(*COLUMNS).collect()], key=repr)


def _table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], "conv_id bigint, turn bigint, role string, text string, at string, copies int")


def test_given_table(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    rows = [tuple(r.values()) for r in pq.read_table(path, columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    assert _got(repair.damaged(spark.read.parquet(path))) == _plain(rows)


def _random_rows(seed, convs, length):
    pick = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "usher", "", None], ["a.", "b?", "cut", " \t", "", None, "x. \n", "long! " * 50]
    return [(c, pick.choice([t, t, t, None, t + 2]), pick.choice(roles[:3] if pick.random() < 0.8 else roles), pick.choice(texts + [f"{t}."] * 4))
            for c in [None, *range(convs)] for t in range(pick.randrange(length))]


@pytest.mark.parametrize("bits", [1, 12])
def test_random_conversations_within_blocks_and_across(spark, monkeypatch, bits):
    """With two rows in a block, all conversations cross edges."""
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    rows = _random_rows(bits, 60, 14)
    assert _got(repair.damaged(_table(spark, rows))) == _plain(rows)


def test_a_long_conversation_is_spread(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", 5)
    pick = random.Random(3)
    rows = [(1, t, pick.choice(["user", "assistant", "system"]), pick.choice([f"{t}.", f"{t}.", "again.", "cut", ""])) for t in range(900)]
    rows += [(2, 0, "user", "q?"), (2, 1, "assistant", "a.")]
    turns = _table(spark, rows).drop("copies").selectExpr("*", "1L as copies")
    assert _got(turns) == _plain(rows, harm=False)
    edits = repair.repair(turns)
    assert edits.where("conv_id = 1").count() == len(_plain(rows, harm=False)[0][7])
    assert [(r.edit, r.role, r.text) for r in edits.where("conv_id = 2").orderBy("at", "step").collect()] == [
        ("K", "user", "q?"), ("K", "assistant", "a.")]


def test_conversations_without_rows_stay(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "x.")]
    assert _got(repair.damaged(_table(spark, rows))) == [(gone, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]
    assert _got(repair.damaged(_table(spark, rows).limit(0))) == []
