"""Language identification against plain encoding with the same dictionaries, and on held-out rows."""

import zlib
from collections import Counter, defaultdict
from hashlib import md5

import pyarrow.parquet as pq
import zstandard

from pageloom.llm import language

GIVEN = "/root/testdata/sf0.01/documents.parquet"


def _out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def _plain_dictionaries(rows):
    texts = defaultdict(Counter)
    for i, text, lang in rows:
        if not _out(i) and lang is not None and text and any(map(str.isalpha, text)):
            texts[lang][text] += 1
    found = {}
    for lang in sorted(texts, key=lambda x: (-sum(texts[x].values()), x)):
        pieces, taken = [], 0
        for text in sorted(texts[lang], key=lambda t: md5(t.encode()).digest())[:language.SAMPLE_TEXTS]:
            at = zlib.crc32(text.encode()) % max(len(text) - language.PIECE + 1, 1)
            if taken < language.SAMPLE_CHARS:
                pieces.append(text[at:at + language.PIECE])
                taken += len(pieces[-1])
        found[lang] = "\n".join(pieces).encode().lower()
    return found


def _plain(rows):
    tools = {}
    for lang, content in _plain_dictionaries(rows).items():
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=language.LEVEL)
        tools[lang] = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)
    out = []
    for i, text, _ in rows:
        if not tools or not text or not any(map(str.isalpha, text)):
            out.append((i, "und", True))
            continue
        raw = text.encode().lower()
        sizes = {x: sum(len(t.compress(raw[at:at + 2048])) for at in range(0, len(raw), 2048)) for x, t in tools.items()}
        best, *rest = sorted(sizes.values())
        out.append((i, min(sizes, key=sizes.get), bool(rest) and (rest[0] - best) / best < language.MARGIN))
    return sorted(out, key=repr)


def _got(docs):
    return sorted([tuple(r) for r in language.predict(docs, language.fit(docs)).select("doc_id", "lang_pred", "rejected").collect()], key=repr)


def test_given_table(spark):
    rows = [tuple(r.values()) for r in pq.read_table(GIVEN, columns=["doc_id", "text", "lang"]).to_pylist()]
    got = _got(spark.read.parquet(GIVEN))
    assert got == _plain(rows)
    lang = {i: x for i, _, x in rows}
    held = [(said, lang[i], rejected) for i, said, rejected in got if _out(i)]
    assert sum(a == b for a, b, _ in held) / len(held) > 0.97
    kept = [(a, b) for a, b, rejected in held if not rejected]
    assert len(kept) > 0.95 * len(held) and sum(a == b for a, b in kept) / len(kept) > 0.99


ODD = [(1, "some plain words here", "en", "x"), (2, None, "en", "x"), (3, "", None, "x"), (4, "12 ?!", "de", "x"), (None, "mots", None, "x"),
       (5, "ein paar deutsche Wörter", "de", "x"), (5, "ein paar deutsche Wörter", "de", "x"), (6, "слово " * 5000, "ru", "x"),
       (7, "слово и ещё слово", None, "x"), (8, "words", "en", "x"), (9, "Wörter", "de", "x"), (10, "漢字", None, "x"), (11, "\x00a", "en", "x")]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, score string")
    got = _got(docs)
    assert got == _plain([r[:3] for r in ODD])
    assert {said for _, said, _ in got} <= {"en", "de", "ru", "und"}
    assert (7, "ru", False) in got


def test_nothing_learned_and_one_language(spark):
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, score string")
    none = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {(r.lang_pred, r.score) for r in language.predict(none, language.fit(none)).collect()} == {("und", 0.0)}
    one = docs.where("lang = 'ru'")
    assert [(r.lang_pred, r.score, r.rejected) for r in language.predict(one, language.fit(one)).collect()] == [("ru", 1.0, False)]
    assert _got(docs.limit(0)) == []


def test_the_fit_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_TEXTS", 3)
    monkeypatch.setattr(language, "MAX_LANGS", 2)
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('text number ', id) as text", "array('a', 'a', 'b', 'c')[id % 4] as lang")
    model = language.fit(docs)
    assert model.langs == ["a", "b"] and all(c.count(b"text") == 3 for c in model.contents)
