"""The rows that the classifier learns from."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from pageloom.llm import toxicity as tox


def _tables(spark):
    good = [(i, f"calm words about gardens and rivers number {i}") for i in range(60)]
    bad = [(i, f"vile scornful insult thrown at people {i}") for i in range(60, 90)]
    rare = [(i, f"calm words with a zorgblat in them {i}") for i in range(90, 110)]
    docs = spark.createDataFrame([*good, *bad, *rare, *[good[0]] * 500], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(110)], "doc_id bigint, toxic int")
    return docs, labels


def test_repeated_rows_weigh_once(spark):
    docs, labels = _tables(spark)
    want = {i for i in range(110) if not spark.range(1).select(tox.held_out(F.lit(i))).first()[0]}
    got = [r["doc_id"] for r in tox.training_rows(docs, labels).collect()]
    assert sorted(got) == sorted(want)
    once = tox.fit(docs.distinct(), labels)
    many = tox.fit(docs, labels)
    assert many.place == once.place and abs(many.weights - once.weights).max() < 1e-9


def test_bound_holds_for_rows_and_not_for_counted_ngrams(spark, monkeypatch):
    docs, labels = _tables(spark)
    seen = []
    fitted = tox._logistic
    monkeypatch.setattr(tox, "_logistic", lambda row, column, ratios, label: seen.append(len(label)) or fitted(row, column, ratios, label))
    model = tox.fit(docs, labels, bound=10)
    assert seen == [10]
    assert "zorg" in model.place  # on too few of the ten rows, but on enough of all


def test_ratios_and_scores_against_plain_counting(spark):
    """Document frequencies, log-count ratios, chosen n-grams and scores, each made again from the texts."""
    import math
    import random
    pick = random.Random(2)
    words = ["garden", "river", "vile", "scorn", "Insult!", "stone", "x" * 90, "ü", "the"]
    rows = [(i, " ".join(pick.choice(words[2:6] if i % 3 == 0 else words) for _ in range(pick.randrange(9)))) for i in range(160)]
    docs = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(160)], "doc_id bigint, toxic int")
    model = tox.fit(docs, labels)

    def grams(text):
        found = set()
        for w in {x.strip("!") for x in (text or "").lower().split()}:
            w = f" {w} "
            found |= {w[i:i + n] for n in range(4, 8) for i in range(len(w) - n + 1)}
        return found
    learned = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    n, toxic = Counter(), Counter()
    for i, t in learned:
        n.update(grams(t))
        if i % 3 == 0:
            toxic.update(grams(t))
    bad = sum(i % 3 == 0 for i, _ in learned)
    assert set(model.place) == {g for g in n if n[g] >= tox.MIN_DOCS}
    ratio = {g: math.log((toxic[g] + 1) / (bad + 2)) - math.log((n[g] - toxic[g] + 1) / (len(learned) - bad + 2)) for g in model.place}
    order = sorted(ratio, key=lambda g: -abs(ratio[g]) * math.sqrt(n[g]))
    strength = [abs(ratio[g]) * math.sqrt(n[g]) for g in sorted(model.place, key=model.place.get)]
    assert all(a >= b - 1e-9 for a, b in zip(strength, strength[1:])) and len(order) == len(strength)
    for i, text, score in [(r.doc_id, dict(rows).get(r.doc_id), r.score) for r in tox.toxicity(docs, labels, model=model).collect()]:
        total = sum(model.weights[model.place[g]] for g in grams(text) if g in model.place) + model.bias
        assert abs(score - 1 / (1 + math.exp(-max(-30, min(30, total))))) < 1e-9


def test_an_ngram_that_a_text_repeats_is_one():
    """In one word, in several, and in words that are too long to be remembered."""
    counts = tox._Counts()
    for label, text in ((1, "abababababab abab, abab"), (0, "abab " + "ab" * 90), (1, "ABAB!"), (0, "")):
        counts.add(label, text.encode())
    at = counts.names
    assert [(counts.every[at[g]], counts.toxic[at[g]]) for g in ("abab", " aba", "babab", "abab ")] == [(3, 2), (3, 2), (2, 1), (3, 2)]
    features = tox._Features({"abab": 0, "zzzz": 1, " aba": 2})
    assert [features(t).tolist() for t in (b"abababab abab", b"", b"cabab", b"ab" * 90)] == [[0, 2], [], [0], [0, 2]]
