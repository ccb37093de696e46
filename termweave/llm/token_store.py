"""Token ids of a corpus in files, coded with a static range asymmetric numeral system (rANS).

The documents are put in ascending ``doc_id`` order by a range partition, tokenised once, and written as chapters: rows of
a Parquet table, each a run of whole documents with about ``CHAPTER`` ids. A chapter has one frequency table, counted over
all its ids and shared by its blocks of ``BLOCK`` ids. Every block is coded on its own by ``LANES`` interleaved states and
can be decoded alone: the chapter keeps a checkpoint per block (number of ids, bytes, crc32 of the ids).

Payload of a block: the final states of its lanes (uint64 each), then 32-bit words, all little-endian. Lane j codes
ids j, j + lanes, j + 2 lanes... A state x stays in [2**31, 2**63); before it codes an id of frequency f it gives off its
low word if x >= f << (63 - PRECISION). Words stand in the order in which decoding takes them.

Frequency table: the ids that occur, then their frequencies scaled to a sum of 2**PRECISION and none below 1; 32-bit
numbers, deflated.

Defined results: null and empty texts are the end id alone; null ids come first; rows of equal id are ordered by text and
each is a document of its own; extra columns are not stored. A text is tokenised whole. The write is an ordinary Spark
write: a lost executor's tasks run again and leave nothing behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave.llm.common import batch_bytes, partitions, pieces
from termweave.llm.word_pieces import PieceCache, byte_level_coder, cached, forget_when_idle

PRECISION = 20
LANES = 2048
BLOCK = 1 << 18
CHAPTER = 1 << 21  # ids that share a frequency table; bounds a task's memory, with the longest document
TEXT_BYTES = 2 << 20  # tokenised at a time
PIECES = 1_200_000  # pieces of texts that a process keeps with their ids, some 250 bytes each
LOW = np.uint64(1 << 31)
_32 = np.uint64(32)

CHAPTERS = (
    "part int, chapter int, first_in_part long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
    "table binary, blocks array<struct<n:int,bytes:int,crc32:long>>, payload binary"
)
_CHAPTERS = pa.schema(
    [
        ("part", pa.int32()),
        ("chapter", pa.int32()),
        ("first_in_part", pa.int64()),
        ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int64())),
        ("table", pa.binary()),
        ("blocks", pa.list_(pa.struct([("n", pa.int32()), ("bytes", pa.int32()), ("crc32", pa.int64())]))),
        ("payload", pa.binary()),
    ]
)


# The coder.


def scaled_frequencies(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies with sum 2**precision in proportion to ``counts`` (all positive), none below 1."""
    total, size = int(counts.sum()), 1 << precision
    if len(counts) > size:
        raise ValueError("more symbols than slots")
    f = np.maximum(1, counts.astype(np.int64) * size // total)
    over = int(f.sum()) - size
    if over < 0:
        f[np.argmax(f)] -= over
    while over > 0:  # take from the largest, which lose least by it
        order = np.argsort(-f, kind="stable")
        cut = np.minimum(f[order] - 1, np.maximum(1, f[order] // 64))
        take = np.minimum(cut, np.maximum(0, over - np.concatenate(([0], np.cumsum(cut)[:-1]))))
        f[order] -= take
        over -= int(take.sum())
    return f.astype(np.uint64)


def encode_block(slots: np.ndarray, f: np.ndarray, start: np.ndarray, lanes: int = LANES) -> bytes:
    """Codes positions in the table. Lanes run backwards, so that decoding runs forwards."""
    n = len(slots)
    width = min(lanes, n)
    x = np.full(width, LOW, np.uint64)
    room = np.uint64(63 - PRECISION)
    out: list[np.ndarray] = []
    for at in range((n - 1) // width * width, -1, -width):
        s = slots[at : at + width]
        fs, y = f[s], x[: len(s)]
        full = y >= fs << room
        if full.any():
            out.append((y[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            y = np.where(full, y >> _32, y)
        q = y // fs
        x[: len(s)] = (q << np.uint64(PRECISION)) + (y - q * fs) + start[s]
    out.reverse()
    return x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in out)


def decode_block(data: bytes, n: int, f: np.ndarray, start: np.ndarray, slot_of: np.ndarray, lanes: int = LANES) -> np.ndarray:
    width = min(lanes, n)
    x = np.frombuffer(data, "<u8", width).astype(np.uint64)
    words = np.frombuffer(data, "<u4", offset=8 * width)
    mask, shift = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
    out = np.empty(n, slot_of.dtype)
    used = 0
    for at in range(0, n, width):
        y = x[: n - at]
        low = y & mask
        s = slot_of[low]
        out[at : at + width] = s
        y = f[s] * (y >> shift) + low - start[s]
        poor = np.flatnonzero(y < LOW)
        if len(poor):
            y[poor] = (y[poor] << _32) | words[used : used + len(poor)]
            used += len(poor)
        x[: len(y)] = y
    if used != len(words) or (x != LOW).any():
        raise ValueError("block does not end where its checkpoint says")
    return out


# Tokenising.

def byte_level(name: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Encoder of a byte-level vocabulary file; ``name`` is a path, or the name of a public vocabulary. One per process."""
    cache = cached(("token store", name), lambda: PieceCache([byte_level_coder(name)], PIECES))
    return lambda texts: cache.encode(texts)[0]


# Writing and reading.


def encode_chapter(ids: np.ndarray) -> tuple[bytes, list[dict], bytes]:
    """Frequency table, checkpoints and payload of some ids."""
    if not len(ids):
        return zlib.compress(b""), [], b""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    f = scaled_frequencies(counts[symbols])
    start = np.cumsum(f) - f
    slot = np.zeros(len(counts), np.int64)
    slot[symbols] = np.arange(len(symbols))
    blocks, payload = [], []
    for at in range(0, len(ids), BLOCK):
        piece = ids[at : at + BLOCK]
        data = encode_block(slot[piece], f, start)
        blocks.append({"n": len(piece), "bytes": len(data), "crc32": zlib.crc32(piece.astype("<u4").tobytes())})
        payload.append(data)
    return zlib.compress(symbols.astype("<u4").tobytes() + f.astype("<u4").tobytes()), blocks, b"".join(payload)


def decode_chapter(table: bytes, blocks: list[dict], payload: bytes, only: range | None = None) -> np.ndarray:
    """All ids of a chapter as little-endian uint32, or those of some of its blocks. Checks every block's checksum."""
    numbers = np.frombuffer(zlib.decompress(table), "<u4")
    symbols, f = numbers[: len(numbers) // 2], numbers[len(numbers) // 2 :].astype(np.uint64)
    start = np.cumsum(f) - f
    slot_of = np.repeat(np.arange(len(f), dtype=np.int32), f.astype(np.int64))
    out, at = [np.empty(0, "<u4")], 0
    for i, block in enumerate(blocks):
        data = payload[at : at + block["bytes"]]
        at += block["bytes"]
        if only is not None and i not in only:
            continue
        ids = symbols[decode_block(data, block["n"], f, start, slot_of)].astype("<u4")
        if zlib.crc32(ids.tobytes()) != block["crc32"]:
            raise ValueError(f"checksum of block {i} differs")
        out.append(ids)
    return np.concatenate(out)


def _writer(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = byte_level(vocabulary), TaskContext.get().partitionId()
        chapter, first, held = 0, 0, 0
        docs: list[tuple[int | None, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            table, blocks, payload = encode_chapter(np.concatenate([x for _, x in docs]))
            row = [part, chapter, first, held, [d for d, _ in docs], [len(x) for _, x in docs], table, blocks, payload]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _CHAPTERS.types)], schema=_CHAPTERS)

        for whole in batches:
            for batch in pieces(whole, "text", TEXT_BYTES):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                    docs.append((doc, np.append(ids, end_id).astype("<u4")))
                    held += len(docs[-1][1])
                    if held >= CHAPTER:
                        yield close()
                        chapter, first, held, docs = chapter + 1, first + held, 0, []
        if docs:
            yield close()
        forget_when_idle()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Write the ids of all texts, in ascending ``doc_id`` order, to ``path``."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = docs.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    with batch_bytes(docs.sparkSession):
        ordered.mapInArrow(_writer(vocabulary, end_id), CHAPTERS).write.mode("overwrite").parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for at in range(batch.num_rows):
            row = {k: v[0] for k, v in batch.slice(at, 1).to_pydict().items()}
            data = decode_chapter(row["table"], row["blocks"], row["payload"]).tobytes()
            n = np.asarray(row["doc_tokens"], np.int64)
            ends = np.cumsum(n)
            starts = row["base"] + row["first_in_part"] + ends - n
            ids = [data[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist())]
            columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)``; ``ids`` are little-endian uint32, ``start`` counts the ids of all documents before.

    Chapters are decoded independently, in any order.
    """
    chapters = spark.read.schema(CHAPTERS).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part.
    bases = chapters.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = bases.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = chapters.join(F.broadcast(bases), "part")
    rows = rows.select("base", "first_in_part", "doc_ids", "doc_tokens", "table", "blocks", "payload")
    return rows.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids binary")
