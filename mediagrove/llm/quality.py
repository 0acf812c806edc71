"""Quality classifier: statistics of a document, random Fourier features, ridge regression, isotonic calibration.

1. Statistics: shares of byte classes, entropy, word and line figures of the whole text (``statistics``).
2. Random Fourier features of the standardised statistics approximate a Gaussian kernel.
3. Each partition sums its normal equations (0.5 MB). Sums are added in a tree of ``FAN_IN`` a task, however many partitions there are,
   until the driver gets ``FAN_IN`` at most, and solves a system of the fixed size ``features`` + 1.
4. Training scores are counted in fixed bins; pool-adjacent-violators turns them into probabilities.
All labelled training rows take part; no sample is drawn.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SLICE_BYTES, cut, release, spread
from .kernel import NOT_WHITE, Words, flat, letters, mix, slices

FEATURES, RIDGE, BINS, FAN_IN = 256, 1e-3, 2000, 16
_CLASSES = [b" ", b"\n", b"\t\r\x0b\x0c", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b".", b",", b"!", b"?", b"|", b"*&%$#@^~", b"<>{}[]()/\\", b"-_=+", b"'\"`", b":;", bytes([*range(9), *range(14, 32), 127]), bytes(range(128, 192)), bytes(range(192, 256))]
_MEMBER = np.zeros((256, len(_CLASSES)))
for _k, _c in enumerate(_CLASSES):
    _MEMBER[list(_c), _k] = 1
NAMES = [*(f"class{k}" for k in range(len(_CLASSES))), "entropy", "log_bytes", "log_words", "word_len", "long_words", "distinct", "top_word", "repeat", "capital", "ends_in_mark", "one_letter", "line_len"]
_PLAIN = letters(False)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[48:58] = _ALPHA[128:] = True


def statistics(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of ``NAMES`` for each document; an empty one has zeros."""
    docs = len(ends) - 1
    size = np.diff(ends)
    n = np.maximum(size, 1)[:, None]
    hist = np.bincount(np.repeat(np.arange(docs) * 256, size) + data, minlength=docs * 256).reshape(docs, 256)
    p = hist / n
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    words = Words(data, ends, NOT_WHITE)
    m, length = np.maximum(words.count, 1), words.end - words.start
    per_doc = lambda x: np.bincount(words.doc, x, docs) / m
    h = words.hashes(_PLAIN)
    key, at, times = np.unique(mix(h + words.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    top = np.zeros(docs)
    np.maximum.at(top, words.doc[at], times)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    lines = hist[:, 10] + 1
    return np.column_stack([
        hist @ _MEMBER / n, entropy, np.log1p(size), np.log1p(words.count), per_doc(length), per_doc(length > 24),
        np.bincount(words.doc[at], minlength=docs) / m, top / m, per_doc(again), per_doc(_UPPER[data[words.start]]),
        per_doc(~_ALPHA[data[words.end - 1]]), per_doc(length == 1), np.log1p(size / lines),
    ])


def describe(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x: the statistics as an array of floats), a row an input row."""
    rows = spread(df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")))

    def run(batches):
        for batch in batches:
            data, ends = flat(batch.column(1))
            out = [statistics(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]) for a, b in slices(ends, SLICE_BYTES)]
            flat_out = np.concatenate([*out, np.zeros((0, len(NAMES)))]).astype(np.float32).ravel()
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat_out) + 1, len(NAMES), dtype=np.int32)), pa.array(flat_out))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["id", "x"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)).astype(float)


class Model:
    """Standardisation, Fourier features, weights and the calibration's steps; a few hundred kB whatever the corpus."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, features: int, seed: int = 8):
        rng = np.random.default_rng(seed)
        d = len(NAMES)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w, self.b = rng.normal(size=(d, features)) / math.sqrt(d), rng.uniform(0, 2 * math.pi, features)
        self.weights, self.edge, self.level = np.zeros(features + 1), np.zeros(1), np.full(1, 0.5)

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        return np.column_stack([np.cos(z @ self.w + self.b) * math.sqrt(2 / len(self.b)), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 (by linear interpolation between the calibrated bins)."""
        return np.interp(self.raw(x), self.edge, self.level)


def isotonic(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``value`` by weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for w, v in zip(weight, value, strict=True):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2]
    return np.concatenate([np.full(int(n), v) for _, v, n in blocks]) if blocks else np.zeros(0)


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = 0
    for s in pdf["s"]:
        total = total + np.frombuffer(s)
    return pd.DataFrame({"s": [total.tobytes()], "k": [int(pdf["k"].iloc[0])]})


def _added(parts: DataFrame, fan_in: int = FAN_IN) -> np.ndarray:
    """The sum of the vectors ``s`` of (s, k: the partition's number), in a tree."""
    most = parts.agg(F.max("k")).first()[0]
    while most >= fan_in:
        parts, last = cut(parts.withColumn("k", F.floor(F.col("k") / fan_in).cast("int")).groupBy("k").applyInPandas(_add, "s binary, k int")), parts
        release(last)
        most //= fan_in
    return np.sum([np.frombuffer(r.s) for r in parts.select("s").collect()], 0)


def fit(described: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", label_col: str = "quality", features: int = FEATURES, ridge: float = RIDGE) -> Model:
    """Fits on all described rows in ``train`` that have a label 0 or 1 (of several labels of an id, the least). Other labels count as none.

    Null ids are never labelled; without labelled rows, or in an empty table, every score is 0.5; rows of one id are examples of their own.
    """
    known = labels.where(labels[label_col].isin(0, 1) & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    rows = described.where(train).join(known, "id").select("x", "y")
    spark, d = described.sparkSession, len(NAMES)
    sums = rows.agg(*(f(F.col("x")[k].cast("double")).alias(f"{n}{k}") for k in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))), F.count(F.lit(1)).alias("n")).first()
    if not sums["n"]:
        return Model(np.zeros(d), np.ones(d), features)
    model = Model(np.array([sums[f"m{k}"] for k in range(d)]), np.array([sums[f"s{k}"] for k in range(d)]), features)

    def equations(batches):
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            z, y = model.lift(_matrix(batch.column(0))), batch.column(1).to_numpy()
            total[:, :-1] += z.T @ z
            total[:, -1] += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    parts = cut(rows.mapInArrow(equations, "s binary").withColumn("k", F.spark_partition_id()))
    got = _added(parts).reshape(features + 1, features + 2)
    model.weights = np.linalg.solve(got[:, :-1] + ridge * max(1, sums["n"]) * np.eye(features + 1) / features, got[:, -1])

    def bins(batches):
        for batch in batches:
            k = np.clip(np.floor((model.raw(_matrix(batch.column(0))) + 0.5) * BINS / 2), 0, BINS - 1).astype(np.int64)
            y = batch.column(1).to_numpy()
            n, ones = np.bincount(k, minlength=BINS), np.bincount(k, y, BINS)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at].astype(np.int64)), pa.array(ones[at].astype(np.int64))], ["k", "n", "ones"])

    table = sorted(rows.mapInArrow(bins, "k long, n long, ones long").groupBy("k").agg(F.sum("n"), F.sum("ones")).collect())
    k, n, ones = (np.array(c, float) for c in zip(*table, strict=True))
    model.edge, model.level = (k + 0.5) * 2 / BINS - 0.5, np.clip(isotonic(n, ones / n), 0, 1)
    return model


def score(described: DataFrame, model: Model) -> DataFrame:
    """(id, score between 0 and 1, predicted: 1 if score >= 0.5, else 0) of described rows."""

    def run(batches):
        for batch in batches:
            s = model.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    return described.mapInArrow(run, f"id {described.schema['id'].dataType.simpleString()}, score double, predicted int")


def classify(df: DataFrame, labels: DataFrame, train, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row a document: ``id_col``, score, predicted. ``train`` makes a condition from the name of the id column.

    Null and empty texts have the statistics of the empty text and are scored like others. Ids may be null (never labelled) or
    repeat; each row gives one row. Without labelled rows all scores are 0.5. Other columns aren't read. The statistics
    are written to the shared checkpoint folder once, for training and scoring.
    """
    described = cut(describe(df, id_col=id_col, text_col=text_col))
    model = fit(described, labels, train("id"), id_col=id_col, label_col=label_col)
    return score(described, model).withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows whose text scores 0.5 or more, with all their columns as they were.

    Null and empty texts have the statistics of the empty text; very long ones are read whole; each of several equal rows is judged alike; ids
    aren't read; an empty table stays empty.
    """

    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            data, ends = flat(batch.column(at).cast(pa.string()))
            good = [model.score(statistics(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])) >= 0.5 for a, b in slices(ends, SLICE_BYTES)]
            yield batch.filter(pa.array(np.concatenate([*good, np.zeros(0, bool)])))

    return df.mapInArrow(run, df.schema)
