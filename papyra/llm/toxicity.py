"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed unigrams, word beginnings of 3 to 7 characters (unigrams cut short, so that
inflected and compound forms share a feature), bigrams and skip-grams over one word. Each coordinate has its own
learning rate; L1 leaves few non-zero weights, and only those are sent to the tasks: at most 2**HASH_BITS pairs.

Defined results: a null or empty text has the bias alone; with no labelled rows, or rows of one class only, every score
is the share of toxic training rows (0 if there are none); labels that contradict each other for an id count as toxic; a
null doc_id is in no fold (held_out false); an empty table has no rows; repeated rows are scored alike; texts of any
length are read whole; other columns of docs are kept, a column `score` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import ascii_digits_crc, pieces, read

HASH_BITS = 20
SIZE = 1 << HASH_BITS
#: Labelled rows used for fitting, the first by a hash of their id.
TRAIN_ROWS = 8000
CACHE_WORDS = 200_000
BEGINNINGS = (3, 4, 5, 6, 7)
THRESHOLD = 0.7
_TO_SPACE = bytes(32 if (c < 128 and not chr(c).isalnum()) else c for c in range(256))


class _Vocabulary:
    """word -> row of a table of its hash and the feature numbers of the word and its beginnings; starts anew when full."""

    def __init__(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.full = np.zeros(1024, np.uint64)
        self.features = np.zeros((1024, 1 + len(BEGINNINGS)), np.uint32)

    def add(self, words: set[bytes]) -> None:
        if len(self.rows) > CACHE_WORDS:
            self.__init__()
        for w in words:
            i = len(self.rows)
            if i == len(self.full):
                self.full = np.concatenate([self.full, np.zeros_like(self.full)])
                self.features = np.concatenate([self.features, np.zeros_like(self.features)])
            h = self.full[i] = xxhash.xxh3_64_intdigest(w)
            text = w.decode("utf-8", "replace")
            self.features[i] = [h & (SIZE - 1), *(xxhash.xxh3_64_intdigest(text[:n].encode(), n) & (SIZE - 1) if len(text) >= n else h & (SIZE - 1) for n in BEGINNINGS)]
            self.rows[w] = i


@lru_cache(maxsize=1)
def _vocabulary() -> _Vocabulary:
    return _Vocabulary()


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - HASH_BITS)).astype(np.uint32)


def _parts(text: str | None) -> Iterator[np.ndarray]:
    """Feature numbers of one piece of the text after the other; pairs reach over the cuts."""
    before = np.empty(0, np.uint64)  # the two words before
    for piece in pieces(text or ""):
        words = piece.lower().encode("utf-8", "replace").translate(_TO_SPACE).split()
        if not words:
            continue
        v = _vocabulary()
        if new := {w for w in words if w not in v.rows}:
            if len(v.rows) + len(new) > CACHE_WORDS:
                v.__init__()
                new = set(words)
            v.add(new)
        at = np.fromiter(map(v.rows.__getitem__, words), np.int64, len(words))
        h = np.concatenate([before, v.full[at]])
        one, two = h[max(0, len(before) - 1) :], h  # what the first new word is paired with comes first
        yield np.concatenate([v.features[at].ravel(), _pair(one[:-1], one[1:], 1), _pair(two[:-2], two[2:], 2)])
        before = h[-2:]


def features(text: str | None) -> np.ndarray:
    """Feature numbers, with repeats."""
    return np.concatenate([np.empty(0, np.uint32), *_parts(text)])


def _kept_features(text: str | None, kept: np.ndarray | None = None) -> np.ndarray:
    """Distinct feature numbers (where kept is not 0), found piece by piece."""
    found = np.empty(0, np.uint32)
    for x in _parts(text):
        found = np.union1d(found, x if kept is None else x[kept[x] != 0])
    return found


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 10, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias. rows: distinct feature numbers of each row; each row's features weigh one together with the bias."""
    z, n, zb, nb = np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x, y = rows[i], labels[i]
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2))
            wb = -zb / ((beta + nb**0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35)))
            g = p - y
            s = (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha
            z[x] = zx + g - s * w
            n[x] = nx + g * g
            sb = ((nb + g * g) ** 0.5 - nb**0.5) / alpha
            zb, nb = zb + g - sb * wb, nb + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w.astype(np.float32), float(-zb / ((beta + nb**0.5) / alpha))


def _distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "x": [_kept_features(t).astype(np.int32) for t in pdf["text"]]})


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: int, folds: int, most: int) -> DataFrame:
    """(doc_id, text, label): the training rows, at most `most` of them, never from the held-out fold."""
    kept = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.pmod(ascii_digits_crc("doc_id"), F.lit(folds)) != fold))
    few = kept.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most `most` rows are broadcast
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bounded sample is fitted in one task, so that the driver holds nothing but the weights."""
    found = [(i, y, np.asarray(x, np.int32)) for pdf in batches for i, y, x in zip(pdf["doc_id"], pdf["label"], pdf["x"], strict=True)]
    found.sort(key=lambda r: r[0])  # rows come in any order, the model is to be the same
    labels, rows = np.array([r[1] for r in found], float), [r[2] for r in found]
    if not len(labels) or labels.min() == labels.max():
        bias = 35.0 if len(labels) and labels[0] else -35.0
        yield pd.DataFrame({"at": [-1], "weight": [bias]})
        return
    w, bias = ftrl(rows, labels)
    at = np.flatnonzero(w)
    yield pd.DataFrame({"at": np.r_[-1, at], "weight": np.r_[bias, w[at]].astype(float)})


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature numbers, weights, bias) from rows outside the held-out third."""
    rows = labelled(docs, labels, "toxic", 1, 3, TRAIN_ROWS).mapInPandas(_distinct, "doc_id long, label int, x array<int>")
    model = rows.repartition(1).mapInPandas(_fit, "at long, weight double").toPandas()  # at most 2**HASH_BITS + 1 rows, few after L1
    at, w = model["at"].to_numpy(), model["weight"].to_numpy()
    known = at >= 0
    if known.all():  # no task ran, the rows being none
        return at, w.astype(np.float32), -35.0
    return at[known], w[known].astype(np.float32), float(w[~known][0])


def _score(model: tuple[np.ndarray, np.ndarray, float]):
    at, weights, bias = model

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.zeros(SIZE, np.float32)
        w[at] = weights
        for batch in texts:
            out = []
            for t in batch:
                x = _kept_features(t, w)
                out.append(1 / (1 + np.exp(-np.clip(float(w[x].sum()) + bias, -35, 35))))
            yield pd.Series(out, dtype=float)

    return F.pandas_udf(run, "double")


def scored(docs: DataFrame, model) -> DataFrame:
    """docs with `score` added, in place of a column of that name."""
    return docs.withColumn("score", _score(model)(F.col("text").cast("string")))


def op5_ftrl_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(F.pmod(ascii_digits_crc("doc_id"), F.lit(3)) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
