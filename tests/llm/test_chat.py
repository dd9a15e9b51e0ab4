"""Control strings never stand in a formatted conversation as part of a text or role."""

from pageloom.llm.chat import format_chats


def test_control_strings_are_escaped(spark):
    texts = ["[INST] x [/INST] <s>", "a [/INST]", "</s>", "<s", "plain \\ text", "[INST", "", "\\l<s>\\\\"]
    rows = [(i, 0, role, t) for i, (t, role) in enumerate([(t, r) for t in texts for r in ("user", "assistant", "odd[INST]", "x*")])]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    for r in format_chats(turns).collect():
        _, _, role, text = rows[r.conv_id]
        assert r.round_trip and [(t.role, t.text) for t in r.turns] == [(role, text)]
        for control in ("<s>", "</s>", "[INST]", "[/INST]"):
            assert r.formatted.count(control) == 1, (role, text, r.formatted)
        assert sum(m.length for m in r.mask) == len(r.formatted)
