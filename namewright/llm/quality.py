"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(b + w.x + 1/2 * sum over f of ((V_f.x)^2 - (V_f^2).(x^2))), linear in the number of features by the
sum-of-squares identity. Features come from the text alone: hashed words, and statistics of its structure and length.
It is fitted with fixed seed on at most SAMPLE labelled rows, taken in the order of a hash of their ids, of those whose
crc32(doc_id as text) mod 4 isn't 2; the sample's bound is a parameter, so fitting costs the same at every size.
Scoring reads each whole text once, without a shuffle.

Defined results: a null text is empty; empty texts get a score as any other; every row gives one row, repeated ones
too; a null doc_id is never held out. Labels that contradict each other count by majority (ties as 1), null ones not at
all. Without labels, or with one class only, every score is that class's share, 0.5 if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import ready

#: Labelled rows to fit on, hashed word columns, factors, least score of a predicted 1.
SAMPLE, WORDS, FACTORS, ACCEPTED = 8000, 4096, 8, 0.7
_CLASSES = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"-()", b"#$%&*!|@+=<>~^_/\\{}[]`", b" ", b"\n\r", b"\t\x0b\x0c"), 1):
    _CLASSES[list(_chars)] = _k
STATS = 26


def structure(text: str, words: list[bytes], h: np.ndarray) -> np.ndarray:
    """Statistics in about 0..1 each."""
    out = np.zeros(STATS)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n, m = len(raw), len(words)
    if not n:
        out[0] = 1
        return out
    share = np.bincount(_CLASSES[raw], minlength=9) / n
    out[1:10] = share
    out[10], out[11] = np.log1p(n) / 15, np.log1p(m) / 12
    if m:
        _, count = np.unique(h, return_counts=True)
        out[12] = len(count) / m
        out[13] = count.max() / m
        size = np.fromiter(map(len, words), np.int64, m)
        out[14], out[15] = min(size.mean() / 20, 2), min(size.std() / 20, 2)
        last = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
        out[16] = (_CLASSES[last] == 5).mean()
        out[17] = (_CLASSES[last] == 4).mean()
        if m >= 6:
            with np.errstate(over="ignore"):
                tri = h[:-2] * np.uint64(31) + h[1:-1] * np.uint64(17) + h[2:]
            out[18] = len(np.unique(tri)) / len(tri)
        else:
            out[18] = 1
        out[19] = (size == 1).mean()
    lines = [x for x in text.split("\n") if x.strip()]
    if lines:
        out[20] = len(set(lines)) / len(lines)
        out[21] = min(n / len(lines) / 500, 2)
        out[22] = np.log1p(len(lines)) / 8
    if n > 1:
        out[23] = (raw[1:] == raw[:-1]).mean()
    out[24] = share[2] / max(share[1] + share[2], 1e-9)
    out[25] = float(m < 5)
    return out


def featurise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a text: WORDS hashed words of unit length together, then STATS statistics."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    col, count = np.unique(h % np.uint64(WORDS), return_counts=True)
    x = np.log1p(count)
    if len(x):
        x = x / np.sqrt((x * x).sum())
    s = structure(text, words, h)
    return np.concatenate([col.astype(np.int64), WORDS + np.arange(STATS)]), np.concatenate([x, s])


Model = tuple[float, np.ndarray, np.ndarray]


def raw_scores(model: Model, x: np.ndarray) -> np.ndarray:
    b, w, v = model
    s = x @ v
    return b + x @ w + 0.5 * ((s * s).sum(1) - (x * x) @ (v * v).sum(1))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 14, seed: int = 11) -> Model:
    """Adam on the logistic loss, with weight decay; rows: columns and values."""
    r = np.random.default_rng(seed)
    n = WORDS + STATS
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return float(np.log(share / (1 - share))), np.zeros(n), np.zeros((n, FACTORS))
    b, w, v = np.array([np.log(share / (1 - share))]), np.zeros(n), r.normal(0, 0.03, (n, FACTORS))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (b, w, v)]
    t = 0
    for epoch in range(epochs):
        order = r.permutation(len(y))
        rate = 0.02 if epoch < epochs * 2 // 3 else 0.005
        for at in range(0, len(y), 128):
            pick = order[at : at + 128]
            x = np.zeros((len(pick), n))
            for k, i in enumerate(pick):
                x[k, rows[i][0]] = rows[i][1]
            s = x @ v
            p = 1 / (1 + np.exp(-np.clip(raw_scores((b[0], w, v), x), -30, 30)))
            d = (p - y[pick]) / len(pick)
            grads = (np.array([d.sum()]), x.T @ d + 1e-5 * w, x.T @ (d[:, None] * s) - v * ((x * x).T @ d)[:, None] + 1e-4 * v)
            t += 1
            for q, g, (m1, m2) in zip((b, w, v), grads, state, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                q -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return float(b[0]), w, v


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, quality)."""
    ready(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q")).where("doc_id is not null and q is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("double").alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most sample rows: small enough to send to every executor

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = [featurise(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "c": [a.tolist() for a, _ in f], "x": [b.tolist() for _, b in f]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = texts.join(F.broadcast(some), "doc_id").mapInPandas(run, "doc_id long, y double, c array<int>, x array<float>").toPandas()
    got["n"] = got["c"].map(len)
    got = got.drop_duplicates("doc_id").sort_values("doc_id")
    rows = [(np.asarray(c, np.int64), np.asarray(x, np.float64)) for c, x in zip(got["c"], got["x"], strict=True)]
    return fit(rows, got["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs' columns keep, and score."""
    ready(docs.sparkSession)
    keep = keep if keep is not None else docs.columns
    at = "score"
    while at in keep:
        at += "_"
    b, w, v = model
    w, v = w.astype(np.float64), v.astype(np.float64)
    v2 = (v * v).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                c, x = featurise(t)
                x = x.astype(np.float32).astype(np.float64)
                s = x @ v[c]
                out.append(1 / (1 + np.exp(-np.clip(b + x @ w[c] + 0.5 * (s @ s - (x * x) @ v2[c]), -30, 30))))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(out, pa.float64())], names=[*keep, at])

    return docs.mapInArrow(run, StructType([docs.schema[c] for c in keep]).add(at, DoubleType()))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(docs, train(docs, labels, sample), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))
