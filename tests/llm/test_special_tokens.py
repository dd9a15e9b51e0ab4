"""Special tokens in another case are plain text, as in the tokenizers library."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import brute
import corpus_pipeline
from pageloom.llm.queries import QUERIES, table

TEXTS = [
    "x <|ENDOFTEXT|> y", "<|EndOfText|>", "<|endoftext|> Then <|EndOfText|>.", "A<|StartOfText|>b<|startoftext|>C",
    "é <|ENDOFTEXT|> Ü", "漢 <|ENDOFTEXT|> y", "<|ENDOFTEXT<|endoftext|>|>", "<| ENDOFTEXT |> It'S Fine, A. b.", "after them"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("special"))
    pq.write_table(pa.table({"doc_id": list(range(len(TEXTS))), "text": TEXTS, "lang": ["en"] * len(TEXTS)}), f"{folder}/documents.parquet")
    return folder


def test_bpe(spark, folder):
    got = QUERIES["op8_bpe"](spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute.bpe(list(enumerate(TEXTS))))


def test_token_file(spark, folder):
    got = sorted(map(tuple, QUERIES["op2_token_file"](spark, folder).select("doc_id", "n_tokens", "ids_crc32", "start").collect()))
    want = brute.token_rows(list(enumerate(TEXTS)))
    assert got == [(*row, sum(n for _, n, _ in want[:i])) for i, row in enumerate(want)]


def test_last_stage_of_the_pipeline(spark, folder):
    stage = corpus_pipeline.STAGES[-1]
    stage = stage[1] if isinstance(stage, tuple) else stage
    got = stage(spark, table(spark, folder, "documents"), folder).select("doc_id", "n_tokens", "ids_sha256").collect()
    assert sorted(map(tuple, got)) == [r[:3] for r in sorted(brute.bpe(list(enumerate(TEXTS))))]
