"""Alignment of two tokenizations of the same texts, and the corpus-wide counts of the id pairs they link.

Byte offsets at which tokens of both vocabularies end cut a text into groups; every token of one vocabulary is linked with every token
of the other in its group.

The alignment walks along a diagonal of the two arrays of end offsets: as long as the ends are equal at the current index shift, tokens
are one to one. Slices of 1, 2, 4, ... ends are compared until they differ, then halves find the place; where the ends differ, the group
is resolved one token at a time, and the shift becomes what it is after it.

Links are kept as distinct pairs with their number per document, never one row each. Pairs are counted by documents with partial counts
in each task. Pairs frequent enough that at most ``FREQUENT`` of them can exist are sent to all tasks, sorted arrays of 17 bytes each;
the rest, none of which is frequent, meets the documents in a shuffled join.

Defined results: a null or empty text has no tokens, nor has one that a vocabulary does not give back byte by byte; every row is a
document, also one of a repeated or null id; an empty table gives an empty table. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import batch_bytes, pieces
from termweave.llm.word_pieces import PieceCache, byte_level_coder, cached, forget_when_idle, piece_coder
from termweave.runtime import cut

FREQUENT = 2_000_000  # pairs sent to every task
TEXT_BYTES = 1 << 20  # aligned at a time
PIECES = 300_000  # kept per process
PAIRS_AT_ONCE = 1 << 22
LOW = (1 << 32) - 1

ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens end a group, for ascending end offsets with the same last one."""
    n, m = len(ends_a), len(ends_b)
    close_a, close_b = bytearray(b"\1") * n, bytearray(b"\1") * m
    raw_a, raw_b = ends_a.astype("<i8").tobytes(), ends_b.astype("<i8").tobytes()
    a, b = memoryview(raw_a).cast("q"), memoryview(raw_b).cast("q")
    i = j = 0
    while i < n and j < m:
        if a[i] == b[j]:
            i, j, width = i + 1, j + 1, 1
            while i + width <= n and j + width <= m and raw_a[8 * i : 8 * (i + width)] == raw_b[8 * j : 8 * (j + width)]:
                i, j, width = i + width, j + width, 2 * width
            while width > 1:
                width //= 2
                if i + width <= n and j + width <= m and raw_a[8 * i : 8 * (i + width)] == raw_b[8 * j : 8 * (j + width)]:
                    i, j = i + width, j + width
            continue
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                close_a[i] = 0
                i += 1
                x = a[i]
            else:
                close_b[j] = 0
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
    return np.frombuffer(bytes(close_a), bool), np.frombuffer(bytes(close_b), bool)


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id), sorted, and how often each occurs."""
    key, times = np.unique(group << 32 | ids, return_counts=True)
    return key >> 32, key & LOW, times


def _summed(doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(pair):
        return doc, pair, times
    order = np.lexsort((pair, doc))
    doc, pair = doc[order], pair[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1]))))
    return doc[first], pair[first], np.add.reduceat(times[order], first)


def pair_counts(a: np.ndarray, b: np.ndarray, off_a: np.ndarray, off_b: np.ndarray, doc_of_group: np.ndarray):
    """Distinct linked ``(doc, a << 32 | b)`` with the number of links; groups are token ranges between offsets."""
    n_a, n_b = np.diff(off_a), np.diff(off_b)
    single = (n_a == 1) & (n_b == 1)
    parts = [(doc_of_group[single], a[off_a[:-1][single]] << 32 | b[off_b[:-1][single]], np.ones(int(single.sum()), np.int64))]
    many = ~single
    group = np.arange(len(n_a))
    in_a, in_b = (np.repeat(many, n) for n in (n_a, n_b))
    group_a, id_a, times_a = _counted(np.repeat(group, n_a)[in_a], a[in_a])
    group_b, id_b, times_b = _counted(np.repeat(group, n_b)[in_b], b[in_b])
    first_b = np.searchsorted(group_b, group_a)
    partners = np.searchsorted(group_b, group_a, "right") - first_b
    upto = np.cumsum(partners)
    start = 0
    while start < len(group_a):  # each distinct id of a side meets the distinct ids of its group's other side
        base = upto[start - 1] if start else 0
        stop = max(int(np.searchsorted(upto, base + PAIRS_AT_ONCE, "right")), start + 1)
        count = partners[start:stop]
        left = np.repeat(np.arange(start, stop), count)
        right = np.arange(len(left)) - np.repeat(upto[start:stop] - count - base, count) + first_b[left]
        parts.append(_summed(doc_of_group[group_a[left]], id_a[left] << 32 | id_b[right], times_a[left] * times_b[right]))
        start = stop
    return _summed(*(np.concatenate(x) for x in zip(*parts)))


def _joined(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(ids).cast(pa.large_string()))
    return pc.binary_join(lists, pa.scalar(",", pa.large_string()))


def _aligner(vocabulary_a: str, vocabulary_b: str):
    schema = pa.schema(
        [(n, pa.int64()) for n in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")]
        + [("groups", pa.large_string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
    )

    def make() -> PieceCache:
        return PieceCache([byte_level_coder(vocabulary_a, special=False), piece_coder(vocabulary_b)], PIECES)

    def align(texts: list[str | None], cache: PieceCache) -> list[pa.Array]:
        coder_a, coder_b = cache.coders
        spaced = [" " + t if t else "" for t in texts]
        found = cache.encode(spaced)
        none = np.empty(0, np.int32)
        for at, text in enumerate(spaced):
            data = text.encode()
            if any(b"".join(map(c.tokens.__getitem__, ids[at].tolist())) != data for c, ids in zip(cache.coders, found)):
                found[0][at] = found[1][at] = none
        (a, n_a), (b, n_b) = ((np.concatenate([none, *ids]).astype(np.int64), np.fromiter(map(len, ids), np.int64, len(ids))) for ids in found)
        close_a, close_b = common_ends(np.cumsum(coder_a.sizes[a]), np.cumsum(coder_b.sizes[b]))
        off_a, off_b = (np.concatenate(([0], np.flatnonzero(c) + 1)) for c in (close_a, close_b))
        # Token ranges of documents end where groups end.
        group_end = np.searchsorted(off_a, np.cumsum(n_a))
        n_groups = np.diff(group_end, prepend=0)
        doc_of_group = np.repeat(np.arange(len(texts)), n_groups)
        bounds = np.concatenate(([0], group_end))
        links = np.concatenate(([0], np.cumsum(np.diff(off_a) * np.diff(off_b))))
        each = pc.binary_join_element_wise(_joined(a, off_a), _joined(b, off_b), pa.scalar("|", pa.large_string()))
        groups = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), each), pa.scalar(";", pa.large_string()))
        doc, pair, times = pair_counts(a, b, off_a, off_b, doc_of_group)
        at = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int64())) for x in (pair, times)]
        return [*(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, np.diff(links[bounds]))), groups, *lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cached(("alignment", vocabulary_a, vocabulary_b), make)
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in pieces(whole, "text", TEXT_BYTES):
                rows = pa.array(np.arange(row, row + batch.num_rows))
                row += batch.num_rows
                columns = [rows, batch.column("doc_id"), *align(batch.column("text").to_pylist(), cache)]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)
        forget_when_idle()

    return run


def alignments(docs: DataFrame, vocabulary_a: str, vocabulary_b: str) -> DataFrame:
    """``ALIGNED`` rows, one per document: a byte-level vocabulary over a blank and the text, and a piece model over the text.

    ``groups`` shows the ids of every group as ``a1,a2|b1;a3|b2``; ``pairs`` are the distinct linked ids as ``a << 32 | b``, ``times`` their links
    in the document. ``row`` numbers the rows; it holds for the copy that is stored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_aligner(vocabulary_a, vocabulary_b), ALIGNED)


def store(aligned: DataFrame, path: str) -> DataFrame:
    """Write ``aligned``, which holds a corpus in pairs, compressed; and read it back."""
    spark = aligned.sparkSession
    with batch_bytes(spark):
        aligned.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def pair_documents(stored: DataFrame) -> DataFrame:
    """Stored ``(pair, documents, best)``: documents that link the pair, and whether no pair of its first id is in more."""
    counts = cut(stored.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents")))
    first = F.shiftright("pair", 32)
    most = counts.groupBy(first.alias("a")).agg(F.max("documents").alias("most"))  # one row per id of a vocabulary
    return counts.join(F.broadcast(most), first == F.col("a")).select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def _scorer(frequent, kept: list[str]):
    """Sums over the pairs that are in ``frequent`` (a broadcast of sorted pairs, counts, bests); the others stay in the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, documents, best = frequent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                pair, times = (batch.column(n).flatten().to_numpy(zero_copy_only=False) for n in ("pairs", "times"))
                sizes = pc.list_value_length(batch.column("pairs")).to_numpy(zero_copy_only=False)
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                place = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
                hit = known[place] == pair if len(known) else np.zeros(len(pair), bool)
                place = np.where(hit, place, 0)
                sums = []
                for weight in (best, documents) if len(known) else ():
                    upto = np.concatenate(([0], np.cumsum(np.where(hit, weight[place] * times, 0))))
                    sums.append(pa.array(np.diff(upto[bounds]), pa.int64()))
                sums = sums or [pa.array(np.zeros(batch.num_rows, np.int64))] * 2
                left = pa.array(np.concatenate(([0], np.cumsum(~hit)))[bounds], pa.int32())
                rest = [pa.ListArray.from_arrays(left, pa.array(x[~hit], pa.int64())) for x in (pair, times)]
                columns = [*(batch.column(n) for n in kept), *sums, *rest]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_best", "count_sum", "pairs", "times"])

    return run


def with_link_counts(stored: DataFrame, limit: int = FREQUENT) -> DataFrame:
    """``stored`` alignments with ``n_best`` and ``count_sum`` in place of their pairs; ``limit`` bounds the pairs sent to every task."""
    spark: SparkSession = stored.sparkSession
    kept = [n for n in stored.columns if n not in ("pairs", "times", "groups")]
    counts = cut(pair_documents(stored))
    total = counts.agg(F.sum("documents")).first()[0] or 0
    often = -(-total // limit)
    hot = counts.where(F.col("documents") >= often).sort("pair").toArrow()  # at most ``limit`` rows
    frequent = spark.sparkContext.broadcast(tuple(hot.column(n).to_numpy().astype(np.int64) for n in ("pair", "documents", "best")))
    types = {f.name: f.dataType.simpleString() for f in stored.schema.fields}
    schema = ", ".join([f"{n} {types[n]}" for n in kept] + ["n_best long, count_sum long, pairs array<long>, times array<long>"])
    scored = stored.select(*kept, "pairs", "times").mapInArrow(_scorer(frequent, kept), schema)
    rare = counts.where(F.col("documents") < often)
    if rare.isEmpty():
        return scored.drop("pairs", "times")
    scored = cut(scored)
    links = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.*")
    sums = (
        links.join(rare, links["pairs"] == rare["pair"])
        .groupBy(F.col("row").alias("__row"))
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"), F.sum(F.col("times") * F.col("documents")).alias("__sum")
        )
    )
    joined = scored.drop("pairs", "times").join(sums, F.col("row") == F.col("__row"), "left")
    return joined.select(*kept, *[(F.col(n) + F.coalesce(m, F.lit(0))).alias(n) for n, m in (("n_best", "__best"), ("count_sum", "__sum"))])
