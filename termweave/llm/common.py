"""Helpers shared by the operators: words, word hashes, running totals, components, joins by a set of ids."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave.runtime import cut, ensure_checkpoint_dir

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Rows of plain ids up to which a set is sent to all executors (8 bytes each); larger sets are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def remembered(limit: int = 10_000):
    """Cache of a function's results, given up when full. Unlike those of the standard library it travels to workers by value."""

    def wrap(fn: Callable) -> Callable:
        known: dict = {}

        def asked(*args):
            if args not in known:
                if len(known) >= limit:
                    known.clear()
                known[args] = fn(*args)
            return known[args]

        return asked

    return wrap


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors can reach."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def batch_bytes(spark: SparkSession, limit: int = 1 << 21) -> Iterator[None]:
    """Arrow batches of at most about ``limit`` bytes in the jobs run inside; a batch of 10,000 texts may be very large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, limit)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver collect its garbage: Spark deletes the shuffle files of finished steps only then, and a heap of its size may wait for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def small(ids: DataFrame, rows: int | None = None) -> DataFrame:
    """``ids`` with a broadcast hint if it was counted to be short; else unchanged, and the join shuffles."""
    rows = ids.count() if rows is None else rows
    return F.broadcast(ids) if rows <= BROADCAST_IDS else ids


def word_count(text: Column | str) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_total(df: DataFrame, order: list[Column], values: dict[str, str]) -> DataFrame:
    """Inclusive running sums over a global order, in two levels: inside ranges, plus the totals of earlier ranges.

    ``values`` maps new columns to summed columns. Rows are range-partitioned by ``order`` (which should settle ties),
    so no key, however frequent, has to fit into one task. The written copy fixes the ranges. The table of range
    totals has one row per shuffle partition.
    """
    n = partitions(df.sparkSession)
    ranged = cut(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        ranged.groupBy("__range")
        .agg(*[F.sum(v).alias(f"__sum_{k}") for k, v in values.items()])
        .select("__range", *[F.coalesce(F.sum(f"__sum_{k}").over(before), F.lit(0)).alias(f"__base_{k}") for k in values])
    )
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({k: F.sum(v).over(inside) for k, v in values.items()})
    out = out.join(F.broadcast(bases), "__range")  # one row per shuffle partition
    out = out.withColumns({k: F.col(k) + F.col(f"__base_{k}") for k in values})
    return out.drop("__range", *[f"__base_{k}" for k in values])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of a link: the smallest node that its links reach.

    Each round gives a node the least label around it, then the label of its label. Labels are written once per round.
    """
    both = cut(
        links.select(F.col(a).alias("node"), F.col(b).alias("other"))
        .union(links.select(F.col(b), F.col(a)))
        .where("node <> other")
        .distinct()
    )
    labels = cut(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "other"), "other")
            .groupBy("node")
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("component")
        )
        target = labels.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        stepped = cut(
            lower.join(target, "component", "left").select(
                "node", F.coalesce(F.least("component", "jump"), F.col("component")).alias("component"), "was"
            )
        )
        labels = stepped.select("node", "component")
        if not stepped.where("component < was").limit(1).count():
            return labels


# Word hashes of Arrow text columns.

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IS_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_FACTOR = 0x9E3779B97F4A7C15  # odd, so that powers have inverses modulo 2**64
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_SHINGLE = np.uint64(0xD1342543DE82EF95)
_powers = np.empty(0, np.uint64), np.empty(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_FACTOR))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (_FACTOR, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers = made[0], made[1]
    return _powers[0][:n], _powers[1][:n]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text; a longer text is a slice of its own."""
    ends = np.cumsum(pa_lengths(batch.column(column)))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, base + limit, "right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def give_back() -> None:
    """Return freed memory to the system; Python workers outlive their task beside the other processes of an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def pa_lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of each text, 0 for null."""
    return pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column one after another, and where each row starts (one more than rows); null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words; a word never crosses a row."""
    inside = ~_IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each row's words start. A-Z count as a-z if ``lower``."""
    raw, bounds = text_bytes(texts)
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    starts, ends = word_spans(raw, bounds)
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[_LOWER[raw] if lower else raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), np.searchsorted(starts, bounds)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of each row, and the row of each; a row of fewer words has one, of all of them."""
    counts = np.diff(bounds)
    rows = np.repeat(np.arange(len(counts)), counts)
    made = []
    if len(words) >= k:
        h = np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            h = h * _SHINGLE + words[i : len(words) - k + 1 + i]
        same = rows[: len(h)] == rows[k - 1 :]
        made.append((mix(h[same]), rows[: len(h)][same]))
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        h = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = counts[short] > i
            h[has] = h[has] * _SHINGLE + words[bounds[short[has]] + i]
        made.append((mix(h ^ (counts[short].astype(np.uint64) << np.uint64(56))), short))
    if not made:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, r = (np.concatenate(x) for x in zip(*made))
    if len(made) > 1:
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r
