"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation = { turn }
    turn         = "<s>[INST] " role flag " [/INST]" text "</s>"
    flag         = "" (role and text stand as they are) | "*" (both are escaped)

In escaped strings "\\" is "\\\\", "<" is "\\l" and "[" is "\\b", so that no control string is left in them.
The parser cuts at "</s>" and takes a turn's head up to the first " [/INST]".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
#: Strings that no text or role may hold as they are, also where the parser would still tell them apart.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")),
                     F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    """The string that was escaped: pairs of backslashes are set aside before the other two are undone."""
    parts = F.split(text, r"\\\\", -1)  # at each pair
    return F.array_join(F.transform(parts, lambda x: F.replace(
        F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))), "\\")


def _render(turn: Column) -> Column:
    """Head, text, close of a turn (role, text, escaped)."""
    plain = F.struct(F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE)).alias("head"), turn["text"].alias("text"))
    safe = F.struct(F.concat(F.lit(OPEN), escape(turn["role"]), F.lit("*" + MIDDLE)).alias("head"),
                    escape(turn["text"]).alias("text"))
    return F.when(turn["escaped"], safe).otherwise(plain)


def _joined(rendered: Column) -> Column:
    return F.array_join(F.transform(rendered, lambda x: F.concat(x["head"], x["text"], F.lit(CLOSE))), "")


def parse(formatted: Column) -> Column:
    """Turns (role, text, escaped, raw) of a formatted conversation; null if it isn't of the grammar."""
    pieces = F.split(formatted, CLOSE, -1)
    bodies = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        middle = F.instr(piece, MIDDLE)
        head = F.substring(piece, F.lit(len(OPEN) + 1), middle - 1 - len(OPEN))
        raw = F.substring(piece, middle + len(MIDDLE), F.char_length(piece))
        starred = F.endswith(head, F.lit("*"))
        role = F.substring(head, F.lit(1), F.char_length(head) - 1)
        return F.struct(
            F.when(starred, unescape(role)).otherwise(head).alias("role"),
            F.when(starred, unescape(raw)).otherwise(raw).alias("text"), starred.alias("escaped"), raw.alias("raw"),
            (F.startswith(piece, F.lit(OPEN)) & (middle > len(OPEN))).alias("fits"))

    turns = F.transform(bodies, turn)
    fits = F.forall(turns, lambda t: t["fits"]) & (F.element_at(pieces, -1) == "")
    return F.when(fits, turns)


def _told(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (read back), mask, round_trip for each conversation of ``turns``.

    ``turns`` has conv_id, turn, role, text: one row a turn, in the order of turn (null first), then role
    and text, so ties and repeated rows have a place; null roles and texts count as empty; rows with a
    null conv_id are one conversation. Other columns are not read; an empty table gives no rows.

    Each turn is first rendered as it is and parsed; turns that don't come back as they were, or hold a
    control string, are escaped; if the whole conversation then still reads back differently, all its turns are escaped. ``turns``
    (role, text, escaped, raw) is what the parser reads from ``formatted``, ``round_trip`` whether it
    equals the source. ``mask`` is the loss mask in runs (length in code points, loss) that add up to
    the formatted text; the texts of assistant turns, as they stand there, are under loss.

    One conversation is one string, so its turns must meet in one row; conversations are not split.
    """
    empty = F.lit("")
    source = turns.select("conv_id", F.struct(
        F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text")).alias("t"))
    alone = F.struct(F.col("t.role").alias("role"), F.col("t.text").alias("text"), F.lit(False).alias("escaped"))
    back = parse(_joined(F.array(_render(alone))))
    # null (not of the grammar) counts as different
    same = F.coalesce(_told(back) == F.array(F.struct(F.col("t.role").alias("role"), F.col("t.text").alias("text"))),
                      F.lit(False))
    clean = ~reduce(Column.__or__, [F.contains(F.col(c), F.lit(x)) for c in ("t.role", "t.text") for x in CONTROL])
    marked = source.select("conv_id", F.struct("t.turn", "t.role", "t.text", (~(same & clean)).alias("escaped")).alias("t"))
    whole = marked.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    every = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.lit(True).alias("escaped")))
    first = whole.withColumn("rendered", F.transform("t", _render)).withColumn("formatted", _joined(F.col("rendered")))
    first = first.withColumn("good", F.coalesce(_told(parse(F.col("formatted"))) == _told(F.col("t")), F.lit(False)))
    settled = first.withColumn(
        "rendered", F.when(F.col("good"), F.col("rendered")).otherwise(F.transform(every, _render)),
    ).withColumn("formatted", _joined(F.col("rendered"))).withColumn("turns", parse(F.col("formatted")))
    run = lambda n, loss: F.struct(n.cast("long").alias("length"), loss.alias("loss"))
    mask = F.flatten(F.zip_with("rendered", "turns", lambda r, t: F.array(
        run(F.char_length(r["head"]), F.lit(False)), run(F.char_length(r["text"]), t["role"] == "assistant"),
        run(F.lit(len(CLOSE)), F.lit(False)))))
    return settled.select(
        "conv_id", "formatted", F.transform("turns", lambda t: F.struct(
            t["role"].alias("role"), t["text"].alias("text"), t["escaped"].alias("escaped"), t["raw"].alias("raw"))).alias("turns"),
        mask.alias("mask"), F.coalesce(_told(F.col("turns")) == _told(F.col("t")), F.lit(False)).alias("round_trip"))


def chat_digest(chats: DataFrame) -> DataFrame:
    """The contract's columns, from what format_chats gives."""
    texts = F.filter("turns", lambda t: t["role"] == "assistant")
    loss = F.array_join(F.transform(texts, lambda t: t["text"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "round_trip")


QUERY_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (select *, regexp_matches(text, '</?s>|\\[/?INST\\]') or regexp_matches(role, '</?s>|\\[/?INST\\]') or ends_with(role, '*') as escaped,
    replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<', chr(92) || 'l'), '[', chr(92) || 'b') as safe_role,
    replace(replace(replace(text, chr(92), chr(92) || chr(92)), '<', chr(92) || 'l'), '[', chr(92) || 'b') as safe from turns)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length('<s>[INST] ') + length(' [/INST]') + length('</s>')
    + case when escaped then length(safe_role) + length(safe) + 1 else length(role) + length(text) end)::bigint as formatted_chars,
  true as round_trip
from marked group by conv_id
"""
