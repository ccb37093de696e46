"""Quality classifier: a factorisation machine over hashed words, structure statistics and numeric metadata.

``score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``; the pairwise sum is taken in time linear in the
features by ``1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.

Words are counted whole-text into ``BUCKETS`` hash buckets (log counts, scaled to length 1 per text). Structure statistics
come from bytes, words and lines; metadata columns add ``log(1 + value)`` and a mark for missing values. Statistics are standardised with
the mean and deviation of the training rows.

The model is fitted on at most ``train_rows`` labelled documents, those whose hashed ids come first, brought to the driver as packed
features (at most ``BUCKETS`` numbers a row); scoring covers every row and needs no shuffle.

Defined results: null text counts as empty and has a score like any other; labels that are null or contradict each other are left out,
as are labels without a document; a repeated ``doc_id`` trains once, with its least text; without training rows every score is
0.5; with one class only, scores stay near that class's share. Columns other than the text and the named metadata are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import pieces, text_bytes, word_hashes, word_spans

BUCKETS = 1 << 12
FACTORS = 8
TRAIN_ROWS = 6000
ROUNDS = 120

_CLASSES = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "mark": [*b"!?"],
    "stop": [*b".,;:"],
    "symbol": [*b"#*$%&|<>{}[]\\^~=_+@/"],
    "line": [10],
    "high": [*range(128, 256)],
}
STATISTICS = 17


def structure(texts: pa.Array) -> np.ndarray:
    """Structure statistics, one row per text."""
    raw, bounds = text_bytes(texts)
    rows = len(bounds) - 1
    starts, ends = word_spans(raw, bounds)
    first = np.searchsorted(starts, bounds)
    size = np.maximum(np.diff(bounds), 1)
    n = np.diff(first)

    def per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values)))
        return np.diff(total[at])

    columns = [np.log1p(n), np.log1p(np.diff(bounds))]
    for members in _CLASSES.values():
        table = np.zeros(256, np.int64)
        table[members] = 1
        columns.append(per_row(table[raw], bounds) / size)
    words, _ = word_hashes(texts)
    row = np.repeat(np.arange(rows), n)
    length = ends - starts
    mean = per_row(length, first) / np.maximum(n, 1)
    columns += [mean, np.sqrt(per_row((length - mean[row]) ** 2, first) / np.maximum(n, 1))]
    again = np.zeros(len(words))
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    columns.append(per_row(again, first) / np.maximum(n, 1))
    order = np.lexsort((words, row))
    new = np.ones(len(words))
    new[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
    columns.append(np.bincount(row[order], new, rows) / np.maximum(n, 1))
    upper = np.isin(raw[starts] if len(starts) else raw[:0], np.arange(65, 91))
    columns.append(per_row(upper, first) / np.maximum(n, 1))
    bare = ~np.isin(raw[ends - 1] if len(ends) else raw[:0], np.arange(33, 48))
    columns += [per_row(bare, first) / np.maximum(n, 1), (n == 0).astype(float)]
    return np.stack(columns, axis=1).astype(np.float32)


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of all non-zero word features, sorted by row and bucket."""
    words, bounds = word_hashes(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    key, count = np.unique(row * BUCKETS + (words & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
    row, value = key // BUCKETS, np.log1p(count).astype(np.float32)
    norm = np.sqrt(np.bincount(row, value * value, len(texts)))
    return row, key % BUCKETS, value / norm[row].astype(np.float32)


def _metadata(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    out = np.zeros((batch.num_rows, 2 * len(names)), np.float32)
    for i, name in enumerate(names):
        v = batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
        missing = ~np.isfinite(v)
        out[:, 2 * i] = np.sign(v) * np.log1p(np.abs(np.where(missing, 0, v)))
        out[missing, 2 * i], out[:, 2 * i + 1] = 0, missing
    return out


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # (features,): statistics and metadata come after the words
    factors: np.ndarray  # (features, FACTORS)
    mean: np.ndarray
    scale: np.ndarray
    metadata: list[str]

    def standard(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.scale, -4, 4).astype(np.float32) / np.float32(np.sqrt(len(self.mean)))

    def score(self, batch: pa.RecordBatch) -> np.ndarray:
        texts = batch.column("text")
        row, bucket, value = word_features(texts)
        dense = self.standard(np.hstack([structure(texts), _metadata(batch, self.metadata)]))
        both = np.hstack([self.weights[:, None], self.factors])
        sums = np.zeros((batch.num_rows, both.shape[1]))
        squares = np.zeros((batch.num_rows, FACTORS))
        if len(row):
            begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            part = both[bucket] * value[:, None]
            sums[row[begin]] = np.add.reduceat(part, begin)
            squares[row[begin]] = np.add.reduceat(part[:, 1:] ** 2, begin)
        sums += dense @ both[BUCKETS:]
        squares += dense**2 @ self.factors[BUCKETS:] ** 2
        z = self.bias + sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_PACKED = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("bucket", pa.binary()), ("value", pa.binary()), ("dense", pa.binary())])


def _pack(metadata: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                row, bucket, value = word_features(batch.column("text"))
                dense = np.hstack([structure(batch.column("text")), _metadata(batch, metadata)])
                at = np.searchsorted(row, np.arange(batch.num_rows + 1))
                packed = [
                    [bucket[a:b].astype("<u2").tobytes() for a, b in zip(at, at[1:])],
                    [value[a:b].astype("<f4").tobytes() for a, b in zip(at, at[1:])],
                    [x.astype("<f4").tobytes() for x in dense],
                ]
                columns = [batch.column("doc_id"), batch.column("label"), *[pa.array(x, pa.binary()) for x in packed]]
                yield pa.RecordBatch.from_arrays(columns, schema=_PACKED)

    return run


def _inputs(docs: DataFrame, metadata: list[str], *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(m).cast("double").alias(m) for m in metadata], *more)


def fit(docs: DataFrame, labels: DataFrame, label: str, metadata: list[str] = [], train_rows: int = TRAIN_ROWS) -> Model:  # noqa: B006
    """Fit on a bounded set of labelled documents; ``labels`` has ``doc_id`` and a 0/1 column named ``label``."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("doc_id", "label")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )
    rows = _inputs(docs, metadata).join(F.broadcast(known), "doc_id")  # train_rows at most
    inputs = F.struct(F.coalesce("text", F.lit("")).alias("text"), *metadata)
    rows = rows.groupBy("doc_id").agg(F.min(inputs).alias("x"), F.first("label").alias("label")).select("doc_id", "label", "x.*")
    packed = rows.mapInArrow(_pack(metadata), "doc_id long, label int, bucket binary, value binary, dense binary")
    return _train(sorted(packed.collect(), key=lambda r: r.doc_id), metadata)


def _train(rows: list, metadata: list[str]) -> Model:
    width = STATISTICS + 2 * len(metadata)
    features = BUCKETS + width
    if not rows:
        return Model(0.0, np.zeros(features), np.zeros((features, FACTORS)), np.zeros(width), np.ones(width), metadata)
    y = np.array([r.label for r in rows], np.float32)
    dense = np.stack([np.frombuffer(r.dense, "<f4") for r in rows])
    model = Model(0.0, np.empty(0), np.empty(0), dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-3), metadata)
    x = np.zeros((len(rows), features), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.bucket, "<u2")] = np.frombuffer(r.value, "<f4")
    x[:, BUCKETS:] = model.standard(dense)
    x2 = x * x
    model.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    # Parameters in one matrix: linear weights, then factors. Adam over all rows, with weight decay.
    p = np.zeros((features, 1 + FACTORS), np.float32)
    p[:, 1:] = np.random.default_rng(7).normal(0, 0.05, (features, FACTORS))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, ROUNDS + 1):
        s = x @ p
        z = model.bias + s[:, 0] + 0.5 * (s[:, 1:] ** 2 - x2 @ p[:, 1:] ** 2).sum(axis=1)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = x.T @ (error[:, None] * np.hstack([np.ones((len(y), 1), np.float32), s[:, 1:]]))
        g[:, 1:] -= p[:, 1:] * (x2.T @ error)[:, None]
        g += 2e-6 * p
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model.bias -= 0.5 * float(error.sum())
    model.weights, model.factors = p[:, 0].astype(np.float64), p[:, 1:].astype(np.float64)
    return model


def _scorer(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(batch))], schema=schema)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every row."""
    return _inputs(docs, model.metadata).mapInArrow(_scorer(model), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``; all columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                yield batch.filter(pa.array(model.score(batch) >= threshold))

    return docs.mapInArrow(run, docs.schema)
