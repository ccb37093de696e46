"""Lines that many documents share, dropped everywhere.

1. Every text is cut at line ends; a line's key is the line without white space at both ends and with A-Z in lower case.
2. The 128-bit hashes of a document's distinct keys are counted over all documents, with partial counts in each task.
3. Hashes found in ``min_documents`` documents lose all their lines. Those frequent enough that at most ``FREQUENT`` of them can
   exist (the counts add up to the number of all pairs of hash and document) are sent to all tasks, which also keeps the hottest ones
   out of any join; the others, none of which has more than that share of the pairs, meet the documents in a shuffled join.
4. What is left of a document is put together again in the order of its lines.

Defined results: a null or empty text is one empty line; keys of fewer than ``min_chars`` code points are never dropped, nor counted; a
document all of whose lines go has an empty text; every row is a document, also one of a repeated or null id; an empty table gives
an empty table. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import batch_bytes, pieces
from termweave.runtime import cut

MIN_DOCUMENTS = 10
MIN_CHARS = 1
FREQUENT = 1_000_000  # hashes sent to every task, 16 bytes each
SPACE = b" \t\n\x0b\x0c\r"

_HASHES = pa.schema([("h1", pa.int64()), ("h2", pa.int64())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())])


def line_hashes(lines: list[bytes], min_chars: int) -> np.ndarray:
    """Two 64-bit numbers per line, and whether its key is long enough to count (third column, 0 or 1)."""
    digests, counts = [], bytearray()
    for line in lines:
        key = line.strip(SPACE).lower()
        long_enough = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)
        counts.append(long_enough)
        digests.append(hashlib.blake2b(key, digest_size=16).digest() if long_enough else bytes(16))
    out = np.empty((len(lines), 3), np.int64)
    out[:, :2] = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    out[:, 2] = np.frombuffer(bytes(counts), np.uint8)
    return out


def _distinct_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                found = [np.empty((0, 2), np.int64)]
                for text in batch.column("text").to_pylist():
                    h = line_hashes((text or "").encode().split(b"\n"), min_chars)
                    found.append(np.unique(h[h[:, 2] > 0, :2], axis=0) if len(h) > 1 else h[h[:, 2] > 0, :2])
                h = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1])], schema=_HASHES)

    return run


class Members:
    """A set of hashes as sorted arrays."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray):
        order = np.lexsort((h2, h1))
        self.h1, self.h2 = h1[order], h2[order]
        runs = np.unique(self.h1, return_counts=True)[1]
        self.longest = int(runs.max()) if len(runs) else 0  # hashes that agree in their first half; hardly ever above 1

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h), bool)
        first = np.searchsorted(self.h1, h[:, 0])
        for step in range(self.longest):
            at = np.minimum(first + step, len(self.h1) - 1)
            found |= (self.h1[at] == h[:, 0]) & (self.h2[at] == h[:, 1])
        return found & (h[:, 2] > 0)


def _dropper(frequent, min_chars: int):
    """Rebuilds texts without the lines whose hash is in ``frequent`` (a broadcast pair of arrays) or in the row's own ``gone``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = None
        for whole in batches:
            for batch in pieces(whole, "text"):
                members = members or Members(*frequent.value)
                own = batch.column("gone").to_pylist() if "gone" in batch.schema.names else [None] * batch.num_rows
                counts, dropped, texts = [], [], []
                for text, gone in zip(batch.column("text").to_pylist(), own):
                    lines = (text or "").encode().split(b"\n")
                    h = line_hashes(lines, min_chars)
                    drop = members.has(h)
                    if gone:
                        gone = np.array([(g["h1"], g["h2"]) for g in gone], np.int64)
                        drop |= Members(gone[:, 0], gone[:, 1]).has(h)
                    counts.append(len(lines))
                    dropped.append(int(drop.sum()))
                    if dropped[-1]:
                        lines = [line for line, d in zip(lines, drop.tolist()) if not d]
                    texts.append(b"\n".join(lines).decode())
                columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=_KEPT)

    return run


def drop_shared_lines(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, limit: int = FREQUENT
) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, text)`` of every row; ``limit`` bounds the hashes that are sent to every task."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashes = docs.mapInArrow(_distinct_hashes(min_chars), "h1 long, h2 long")
    with batch_bytes(spark):
        counted = hashes.groupBy("h1", "h2").agg(F.count("*").alias("documents"))
        # One pass gives the shared hashes and, in the row without hash, the number of all pairs.
        pairs = F.sum("documents").alias("documents")
        shared = cut(counted.groupBy(*[F.when(F.col("documents") >= min_documents, F.col(h)).alias(h) for h in ("h1", "h2")]).agg(pairs))
    total = shared.agg(F.sum("documents")).first()[0] or 0
    shared = shared.where("h1 IS NOT NULL")
    often = max(min_documents, -(-total // limit))
    hot = shared.where(F.col("documents") >= often).select("h1", "h2").toArrow()  # at most ``limit`` rows
    frequent = spark.sparkContext.broadcast(tuple(hot.column(h).to_numpy() for h in ("h1", "h2")))
    rare = shared.where(F.col("documents") < often).select("h1", "h2")
    if often > min_documents and not rare.isEmpty():
        # Rows alike in id and text lose the same lines, so that both together serve as the key of a row.
        key = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]
        keyed = docs.select(F.col("doc_id"), F.col("text"), *key)
        with batch_bytes(spark):
            gone = cut(
                keyed.mapInArrow(_keyed_hashes(min_chars, frequent), "doc_id long, t1 long, t2 long, h1 long, h2 long")
                .join(rare, ["h1", "h2"])
                .groupBy(F.col("doc_id").alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"))
                .agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))  # at most the document's own lines
            )
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("t1") == F.col("__t1")) & (F.col("t2") == F.col("__t2"))
        docs = keyed.join(gone, same, "left").select("doc_id", "text", "gone")
    return docs.mapInArrow(_dropper(frequent, min_chars), "doc_id long, n_lines long, n_dropped long, text string")


def _keyed_hashes(min_chars: int, frequent):
    """Hashes of each row's lines outside ``frequent``, with the row's key."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "t1", "t2", "h1", "h2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = None
        for whole in batches:
            for batch in pieces(whole, "text"):
                members = members or Members(*frequent.value)
                found, sizes = [np.empty((0, 3), np.int64)], []
                for text in batch.column("text").to_pylist():
                    h = line_hashes((text or "").encode().split(b"\n"), min_chars)
                    h = np.unique(h[(h[:, 2] > 0) & ~members.has(h)], axis=0)
                    found.append(h)
                    sizes.append(len(h))
                h = np.concatenate(found)
                at = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
                keys = [batch.column(n).take(at) for n in ("doc_id", "t1", "t2")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(h[:, 0]), pa.array(h[:, 1])], schema=schema)

    return run
