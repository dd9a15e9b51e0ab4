"""The verdict by make-up: clean texts of any language stay, junk goes; verdicts against a plain version."""

import math
import random
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from pageloom.llm.quality import COMMON_WORDS, quality

GIVEN = "/root/testdata/sf0.01/documents.parquet"
ALPHABETS = {"ru": "абвгдежзиклмнопрстуфхцчшыэюя", "el": "αβγδεζηθικλμνξοπρστυφχψω", "hi": "कखगघचछजझटठडढणतथदधनपफबभम", "pl": "abcdefghijklmnoprstuwyząęłńóśż"}
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"()-", "!?", "#*$%&<>", "|", " ", "\n"]


def _prose(lang, seed, n=120):
    rnd = random.Random(f"{lang} {seed}")
    fixed = random.Random(lang)
    word = lambda r, k: "".join(r.choice(ALPHABETS[lang]) for _ in range(k))
    short = [word(fixed, 3) for _ in range(30)]
    return " ".join(rnd.choice(short) if rnd.random() < 0.4 else word(rnd, rnd.randrange(4, 10)) for _ in range(n)) + "."


def _kept(spark, rows):
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "doc_id bigint, text string, lang string")
    return [r["kept"] for r in sorted(quality(docs).collect(), key=lambda r: r["doc_id"])]


def _given():
    return [(r["text"], r["lang"]) for r in pq.read_table(GIVEN, columns=["text", "lang"]).to_pylist()]


def test_clean_texts_of_any_language_stay(spark):
    many = [(_prose(k, i), k) for k in ("ru", "el") for i in range(40)]  # enough for references
    few = [(_prose(k, i), k) for k in ("hi", "pl") for i in range(3)]
    unknown = [(_prose(k, 99), None) for k in ("ru", "hi", "pl")]
    junk = [(" ".join(f"{i * j % 9973}#{j}|$%" for j in range(80)), "ru") for i in range(1, 4)]
    kept = _kept(spark, [*many, *few, *unknown, *junk, *_given()])
    n = len(many) + len(few) + len(unknown)
    assert kept[:n] == [True] * n
    assert kept[n:n + 3] == [False] * 3


def test_verdicts_of_given_texts_against_a_plain_version(spark):
    rows = _given()
    words = sorted({w for x in COMMON_WORDS.values() for w in x})
    of = {c: i for i, x in enumerate(CLASSES) for c in x}

    def shares(items, size):
        return {k: n / size for k, n in items.items()} if size else {}

    def make_up(text):
        low = "".join(c.lower() if c.isascii() else c for c in text)
        chars = Counter(of.get(c, "letter" if ord(c) >= 128 else "rest") for c in text)
        common = Counter(w for w in low.encode().split() if w.decode() in words)
        return shares(chars, sum(chars.values())), shares(common, sum(common.values()))

    def distance(p, q):
        total = 0.0
        for k in {*p, *q}:
            a, b = p.get(k, 0), q.get(k, 0)
            m = (a + b) / 2
            total += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
        return math.sqrt(max(0.0, total / 2))

    sums = defaultdict(lambda: (Counter(), Counter()))
    for text, lang in rows:
        if len(text or "") >= 200:
            for into, part in zip(sums[lang], make_up(text)):
                into.update(part)
    refs = [tuple(shares(x, sum(x.values())) for x in pair) for pair in sums.values()]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string")
    told = {r["doc_id"]: r for r in quality(docs).collect()}
    n_far = 0
    for i, (text, _) in enumerate(rows):
        far, row = False, told[i]
        if len(text or "") >= 200 and len(text.encode().split()) >= 40:
            chars, common = make_up(text)
            c = min(distance(chars, x) for x, _ in refs)
            w = min(distance(common, y) for _, y in refs) if common else 1.0
            assert abs(c - row["char_distance"]) < 1e-6 and abs(w - row["word_distance"]) < 1e-6
            far = c > 0.3 or w > 0.92 or c + w > 1.0
            n_far += far
        assert row["kept"] == (not row["base_failed"] and not far)
    assert n_far
