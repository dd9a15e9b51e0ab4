"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import string
from array import array
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.order import stored
from pageloom.llm.text import SLICE, map_texts, text_bytes, text_key

SHORTEST, LONGEST = 4, 7
#: Bound of the labelled rows that weights are fitted on (n-grams are counted over all), and of its n-grams.
MAX_TRAIN, MAX_FEATURES, MIN_DOCS = 8000, 30000, 4
#: Weight of a toxic row in the fit, ridge, and steps.
TOXIC_WEIGHT, RIDGE, STEPS = 3.0, 1e-4, 250
THRESHOLD = 0.3
#: Words that a worker remembers, the length from which it doesn't, and n-grams after which it hands on its counts.
_REMEMBER, _LONG_WORD, _HELD = 200_000, 64, 400_000


@dataclass
class Model:
    place: dict[str, int]
    weights: np.ndarray
    bias: float


def _words(text: bytes) -> set[str]:
    return {w.strip(string.punctuation) for w in text.decode("utf-8").lower().split()}


def _grams(word: str) -> list[str]:
    """The n-grams of a word, one that it repeats more than once: both users mark places, which repeats don't change."""
    word = f" {word} "
    return [word[i:i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(word) - n + 1)]


class _Features:
    """Which known n-grams a text has; a bounded number of words is remembered."""

    def __init__(self, place: dict[str, int]):
        self.place, self.known = place, {}

    def _of(self, word: str) -> bytes:
        got = self.known.get(word)
        if got is None:
            got = array("i", [p for p in map(self.place.get, _grams(word)) if p is not None]).tobytes()
            if len(self.known) < _REMEMBER and len(word) < _LONG_WORD:
                self.known[word] = got
        return got

    def __call__(self, text: bytes) -> np.ndarray:
        """Distinct places, ascending."""
        hit = np.zeros(len(self.place), bool)
        hit[np.frombuffer(b"".join(map(self._of, _words(text))), np.intc)] = True
        return np.flatnonzero(hit)


class _Counts:
    """In how many texts, and toxic texts, each n-gram stands; numbers stand for n-grams, words are remembered."""

    def __init__(self):
        self.names, self.known = {}, {}
        self.every, self.toxic = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _of(self, word: str) -> bytes:
        got = self.known.get(word)
        if got is None:
            names = self.names
            got = array("i", [names.setdefault(g, len(names)) for g in _grams(word)]).tobytes()
            if len(self.known) < _REMEMBER and len(word) < _LONG_WORD:
                self.known[word] = got
        return got

    def add(self, label: int, text: bytes) -> None:
        ids = np.frombuffer(b"".join(map(self._of, _words(text))), np.intc)
        while len(self.names) > len(self.every):
            self.every, self.toxic = (np.append(c, np.zeros_like(c)) for c in (self.every, self.toxic))
        self.every[ids] += 1  # a place that comes more than once is raised once
        if label:
            self.toxic[ids] += 1

    def batches(self):
        grams = list(self.names)
        for at in range(0, len(grams), 50_000):
            part = grams[at:at + 50_000]
            yield pa.RecordBatch.from_pydict({
                "gram": pa.array(part, pa.string()), "n": self.every[at:at + len(part)], "toxic": self.toxic[at:at + len(part)]})


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, key, toxic, text of the labelled documents outside the held-out fold, once for each id and text.

    Ids labelled more than once count as toxic if any label says so; null labels and ids are left out.
    Repeated rows are dropped by an aggregate that combines before the shuffle.
    """
    told = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    return (
        docs.select("doc_id", "text").join(told, "doc_id")
        .groupBy("doc_id", text_key().alias("key")).agg(F.max("toxic").alias("toxic"), F.max("text").alias("text")))


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN) -> Model:
    """Log-count ratios and n-grams from all labelled rows (see training_rows), weights from ``bound`` of them.

    The rows of the weight fit are chosen by a hash of id and text; their number bounds what is sent to the
    driver, however often an id is repeated. Without labels of both kinds there are no n-grams, and every
    text gets the share of toxic rows (0 without any row).
    """
    spark = docs.sparkSession
    every_row = stored(training_rows(docs, labels), "toxicity")
    # keys alone are ordered in one place; their texts are read where they lie
    keys = every_row.select("doc_id", "key").orderBy(F.xxhash64("doc_id", "key"), "doc_id", "key").limit(bound)
    sample = every_row.join(stored(keys, "toxicity-sample"), ["doc_id", "key"], "left_semi")

    def count(batches):
        counts = _Counts()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for label, text in zip(part.column(0).to_pylist(), text_bytes(part.column(1))):
                    counts.add(label, text)
                if len(counts.names) > _HELD:
                    yield from counts.batches()
                    counts = _Counts()
        yield from counts.batches()

    totals = {r["toxic"]: r["n"] for r in every_row.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sum(n for k, n in totals.items() if k), totals.get(0, 0)
    if not n_toxic or not n_clean:
        share = 0.0 if not n_toxic else 1.0
        return Model({}, np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    ratio = F.log((F.col("toxic") + 1) / (n_toxic + 2.0)) - F.log((F.col("n") - F.col("toxic") + 1) / (n_clean + 2.0))
    chosen = (
        every_row.select("toxic", "text").mapInArrow(count, "gram string, n bigint, toxic bigint")
        .groupBy("gram").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        .where(F.col("n") >= MIN_DOCS).withColumn("ratio", ratio)
        .orderBy((F.abs("ratio") * F.sqrt("n")).desc(), "gram").limit(MAX_FEATURES).toArrow())
    place = {g: i for i, g in enumerate(chosen.column("gram").to_pylist())}
    ratios = chosen.column("ratio").to_numpy()
    sent = spark.sparkContext.broadcast(place)
    found = map_texts(sample, lambda: partial(_places, _Features(sent.value)), "places array<int>", ("toxic",)).toArrow()
    lists = found.column("places").combine_chunks()
    labels_now = found.column("toxic").to_numpy().astype(np.float64)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    weights, bias = _logistic(row, lists.flatten().to_numpy().astype(np.int64), ratios, labels_now)
    return Model(place, weights, bias)


def _places(features: _Features, texts: list[bytes]) -> list:
    return [list(map(features, texts))]


def _logistic(row: np.ndarray, column: np.ndarray, ratios: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression over values ``ratios[column]``, by Adam; weights come back times the ratios."""
    n, value = len(label), ratios[column]
    scale = 1 / np.sqrt(max(1e-9, np.bincount(row, value ** 2, n).mean()))
    value = value * scale
    share = np.where(label > 0, TOXIC_WEIGHT, 1.0)
    share /= share.sum()
    w, first, second = (np.zeros(len(ratios) + 1) for _ in range(3))
    w[-1] = np.log((share * label).sum() / (share * (1 - label)).sum())
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[column], n) + w[-1], -30, 30)))
        gap = (p - label) * share
        slope = np.append(np.bincount(column, value * gap[row], len(ratios)) + RIDGE * w[:-1], gap.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope ** 2
        w -= 0.03 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1] * ratios * scale, float(w[-1])


def toxicity(docs: DataFrame, labels: DataFrame, keep=("doc_id",), model: Model | None = None) -> DataFrame:
    """The columns of ``keep``, score and predicted for each row of ``docs`` (doc_id, text).

    Features are the distinct character n-grams of a text's words (4 to 7, word ends included). Only the
    text makes the score. Null and empty texts have no n-grams and get the score of the bias; repeated
    rows get equal scores; other columns are not read; an empty table gives no rows.
    """
    model = fit(docs, labels) if model is None else model
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        features, weights, bias = _Features(sent.value.place), sent.value.weights, sent.value.bias

        def compute(texts):
            scores = [1 / (1 + np.exp(-np.clip(weights[features(t)].sum() + bias if len(weights) else bias, -30, 30)))
                      for t in texts]
            return [[float(s) for s in scores], [int(s >= THRESHOLD) for s in scores]]
        return compute

    return map_texts(docs, make, "score double, predicted int", keep)
