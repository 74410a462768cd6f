"""Text quality by a small byte-level convolutional network, trained and run in numpy.

Bytes are mapped to learned embeddings; one extra channel says whether the eight bytes that begin here also began at one
of the LAGS places before (so filters see repetition, which no filter of a few bytes could). Filters of WIDTH bytes
slide over the whole text in steps of STRIDE; their rectified outputs are averaged over overlapping chunks of CHUNK
bytes (half a chunk apart); each filter keeps its largest chunk (max-pooling) and the mean over chunks; a logistic layer
combines these into one probability. Every byte of every text is read, in fitting as in scoring, in pieces of PIECE
bytes: besides the text itself only a piece's activations (and, in fitting, FILTERS numbers for each half chunk) are held.

Defined results: a null or empty text is scored as one chunk of padding; with no labelled rows or rows of one class the
score is the share of good training rows (1 if there are none); contradicting labels of an id count as good; a null
doc_id is in no fold (held_out false); an empty table has no rows; repeated rows are scored alike; other columns of docs
are kept, a column `score` is replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import ascii_digits_crc, read
from papyra.llm.toxicity import labelled

EMBED, WIDTH, STRIDE, FILTERS, CHUNK = 5, 6, 2, 16, 256
LAGS = range(1, 25)
#: Labelled rows used for fitting; their texts are read whole.
TRAIN_ROWS, EPOCHS = 2400, 6
THRESHOLD = 0.7
PIECE = 1 << 16
HALF = CHUNK // 2 // STRIDE


def repeats(b: np.ndarray, i: int = 0, j: int | None = None) -> np.ndarray:
    """For the places i to j (to the end) of b: 1 where the 8 bytes from here on equal those a lag before."""
    j = len(b) if j is None else j
    out = np.zeros(j - i, np.float32)
    low, high = max(0, i - LAGS[-1]), min(len(b), j + 7)
    if high - low < 9:
        return out
    u = np.lib.stride_tricks.sliding_window_view(b[low:high], 8)
    u = np.ascontiguousarray(u).view(np.uint64).ravel()
    hit = np.zeros(len(u), bool)
    for lag in LAGS:
        if lag < len(u):
            hit[lag:] |= u[lag:] == u[:-lag]
    found = hit[i - low : j - low]
    out[: len(found)] = found
    return out


def _padded(b: np.ndarray) -> np.ndarray:
    """To a whole number of half chunks, two at least, and WIDTH - STRIDE bytes for the last filter place."""
    step = CHUNK // 2
    n = max(2, -(-len(b) // step)) * step
    return np.concatenate([b, np.zeros(n + WIDTH - STRIDE - len(b), np.uint8)])


def text_bytes(text: str | None) -> np.ndarray:
    return _padded(np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8))


def text_flags(b: np.ndarray) -> np.ndarray:
    """Repeat flags of a whole text as bytes, for texts that are read many times."""
    n = len(b) - (WIDTH - STRIDE)
    return np.concatenate([repeats(b, i, min(n, i + PIECE) + (WIDTH - STRIDE) * (i + PIECE >= n)).astype(np.uint8) for i in range(0, n, PIECE)])


def pieces(b: np.ndarray, flags: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Byte values and repeat flags, PIECE bytes at a time and WIDTH - STRIDE more, which the next piece has as well."""
    n = len(b) - (WIDTH - STRIDE)
    for i in range(0, n, PIECE):
        j = min(n, i + PIECE) + WIDTH - STRIDE
        yield b[i:j], repeats(b, i, j) if flags is None else flags[i:j]


class Network:
    def __init__(self, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        self.e = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.w = r.normal(0, 0.3, (WIDTH * (EMBED + 1), FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = r.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def inputs(self, by: np.ndarray, rep: np.ndarray) -> np.ndarray:
        """What lies under each filter place: (places, WIDTH * (EMBED + 1)). Neighbouring places share memory."""
        x = np.empty((len(by), EMBED + 1), np.float32)
        x[:, :EMBED] = self.e[by]
        x[:, EMBED] = rep
        places, one = (len(by) - (WIDTH - STRIDE)) // STRIDE, x.strides[0]
        return np.lib.stride_tricks.as_strided(x, (places, WIDTH * (EMBED + 1)), (STRIDE * one, x.strides[1]), writeable=False)

    def filtered(self, by: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs and rectified filters at each place."""
        x = self.inputs(by, rep)
        h = x @ self.w
        h += self.b
        return x, np.maximum(h, 0, out=h)

    def halves(self, by: np.ndarray, rep: np.ndarray) -> np.ndarray:
        """Means of the rectified filters over half chunks: (half chunks, FILTERS)."""
        return self.filtered(by, rep)[1].reshape(-1, HALF, FILTERS).mean(axis=1)

    def pooled(self, text: str | None) -> np.ndarray:
        """Largest chunk and mean over chunks of each filter, gathered piece by piece."""
        top, total, n, last = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS), 0, np.empty((0, FILTERS), np.float32)
        for by, rep in pieces(text_bytes(text)):
            half = np.concatenate([last, self.halves(by, rep)])
            last = half[-1:]
            if len(half) > 1:
                chunk = (half[1:] + half[:-1]) / 2
                top, total, n = np.maximum(top, chunk.max(axis=0)), total + chunk.sum(axis=0, dtype=np.float64), n + len(chunk)
        return np.concatenate([top, (total / n).astype(np.float32)])

    def probability(self, text: str | None) -> float:
        s = float(self.pooled(text) @ self.v + self.c[0])
        return 1 / (1 + np.exp(-np.clip(s, -35, 35)))


NAMES = ("e", "w", "b", "v", "c")


def gradients(net: Network, texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean log loss over whole texts (text_bytes, text_flags). The forward pass keeps half-chunk means; what lies
    below them is kept as well where the texts together fill one piece, and computed again piece by piece where not."""
    g = {n: np.zeros_like(getattr(net, n)) for n in NAMES}
    keep = sum(len(b) for b, _ in texts) <= PIECE
    halves, kept = [], []
    for text in texts:
        mine = []
        for by, rep in pieces(*text):
            x, h = net.filtered(by, rep)
            mine.append(h.reshape(-1, HALF, FILTERS).mean(axis=1))
            if keep:
                kept.append((by, x, h))
        halves.append(np.concatenate(mine))
    chunks = [(h[1:] + h[:-1]) / 2 for h in halves]
    f = np.stack([np.concatenate([c.max(axis=0), c.mean(axis=0)]) for c in chunks])
    p = 1 / (1 + np.exp(-np.clip(f @ net.v + net.c[0], -35, 35)))
    d = ((p - y) / len(texts)).astype(np.float32)
    g["v"], g["c"] = f.T @ d + 1e-4 * net.v, np.array([d.sum()], np.float32)
    df, k = np.outer(d, net.v), 0
    for text, c, one in zip(texts, chunks, df, strict=True):
        dc = np.broadcast_to(one[FILTERS:] / len(c), c.shape).copy()
        dc[c.argmax(axis=0), np.arange(FILTERS)] += one[:FILTERS]
        dhalf = np.zeros((len(c) + 1, FILTERS), np.float32)
        dhalf[1:] += dc / 2
        dhalf[:-1] += dc / 2
        at = 0
        for by, rep in pieces(*text):
            if keep:
                by, x, h = kept[k]
                k += 1
            else:
                x, h = net.filtered(by, rep)
            m = len(h) // HALF
            dh = np.repeat(dhalf[at : at + m] / HALF, HALF, axis=0) * (h > 0)
            at += m
            g["w"] += x.T @ dh
            g["b"] += dh.sum(axis=0)
            dx = (dh @ net.w.T).reshape(len(h), WIDTH // STRIDE, STRIDE, EMBED + 1)
            dbytes = np.zeros((len(h) + WIDTH // STRIDE - 1, STRIDE, EMBED + 1), np.float32)  # a byte lies under several places
            for i in range(WIDTH // STRIDE):
                dbytes[i : i + len(h)] += dx[:, i]
            dbytes = dbytes.reshape(-1, EMBED + 1)
            g["e"] += np.stack([np.bincount(by, dbytes[:, j], 256) for j in range(EMBED)], axis=1).astype(np.float32)
    return g


def train(rows: list[tuple[float, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01, batch: int = 16, seed: int = 5) -> Network:
    """Adam on the log loss. rows: (label, bytes of the whole text)."""
    texts = [(b, text_flags(b)) for _, b in rows]
    net, r, t = Network(), np.random.default_rng(seed), 0
    m = {k: np.zeros_like(getattr(net, k)) for k in NAMES}
    s = {k: np.zeros_like(getattr(net, k)) for k in NAMES}
    y = np.array([x[0] for x in rows], np.float32)
    for epoch in range(epochs):
        order = r.permutation(len(rows))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            g = gradients(net, [texts[i] for i in pick], y[pick])
            t += 1
            step = rate * (1 - 0.9 * epoch / epochs)
            for n in NAMES:
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                s[n] = 0.999 * s[n] + 0.001 * g[n] ** 2
                setattr(net, n, (getattr(net, n) - step * (m[n] / (1 - 0.9**t)) / (np.sqrt(s[n] / (1 - 0.999**t)) + 1e-8)).astype(np.float32))
    return net


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bounded sample is fitted in one task, so that the driver holds nothing but the network."""
    found = [(i, float(a), text_bytes(t)) for pdf in batches for i, a, t in zip(pdf["doc_id"], pdf["label"], pdf["text"], strict=True)]
    rows = [r[1:] for r in sorted(found, key=lambda r: r[0])]  # rows come in any order, the network is to be the same
    y = [r[0] for r in rows]
    model = (sum(y) / len(y) if y else 1.0) if len(set(y)) < 2 else train(rows)
    yield pd.DataFrame({"model": [pickle.dumps(model)]})


def fit(docs: DataFrame, labels: DataFrame) -> Network | float:
    """From rows outside the held-out quarter; a constant where there is nothing to learn from."""
    rows = labelled(docs, labels, "quality", 2, 4, TRAIN_ROWS)
    fitted = rows.repartition(1).mapInPandas(_fit, "model binary").first()  # none where no task ran, the rows being none
    return pickle.loads(fitted[0]) if fitted else 1.0


def _score(model: Network | float):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model if isinstance(model, float) else model.probability(t) for t in batch], dtype=float)

    return F.pandas_udf(run, "double")


def scored(docs: DataFrame, model: Network | float) -> DataFrame:
    """docs with `score` added, in place of a column of that name."""
    return docs.withColumn("score", _score(model)(F.col("text").cast("string")))


def op7_byte_cnn_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(F.pmod(ascii_digits_crc("doc_id"), F.lit(4)) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
