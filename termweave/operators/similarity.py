"""Similarity of every chunk with every tag, without a cross join.

Small tag tables (size checked first) travel to the tasks as one broadcast matrix: the chunk side is then scanned
once and never shuffled. Larger tag tables are cut into shares that fit a task's memory, and groups of shares that fit its disk;
chunk rows are sent to the groups they have to meet and each task streams its chunks past its shares. Both ways test all pairs and give equal rows.
"""

from __future__ import annotations

import math
import pickle
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from termweave.functions import text as tx
from termweave.runtime import cut

BROADCAST_BYTES = 256 << 20  # largest tag table sent whole to every executor
SHARE_BYTES = 256 << 20  # tag vectors held by one task beyond that
SPOOL_BYTES = 1 << 30  # tag vectors that one task keeps on its executor's disk, in shares
TASK_FLOPS = 2e12  # multiplications wanted per task, about a minute on one core
MAX_PARTITIONS = 100_000
RING = 9  # parts of a table joined with itself; 5 of 9 products are done
ROWS, COLS, PAIRS = 1024, 4096, 1 << 15  # block sizes of the matrix product and of the exact re-score
DOCUMENT_CHUNKS = 10_000  # chunks of one document that one task scores; larger documents are spread and combined by a shuffle
CELLS = 1 << 24  # (chunk, tag) cells scored before their maxima leave the task


@dataclass
class Block:
    """Vectors of one width: positions in their table, raw values, unit vectors and norms."""

    positions: np.ndarray
    raw: np.ndarray
    unit: np.ndarray
    norms: np.ndarray


def _blocks(vectors: pa.Array, zeros: bool = False) -> dict[int, Block]:
    """Usable vectors by width; null, empty, non-finite and (unless ``zeros``) zero ones can match nothing and are left out."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    starts = np.cumsum(lengths) - lengths
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    blocks = {}
    for width in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == width)
        raw = values[starts[at][:, None] + np.arange(width)]
        exact = raw.astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            norms = np.sqrt(np.einsum("ij,ij->i", exact, exact))
        good = np.isfinite(norms) & (zeros | (norms > 0))
        if good.any():
            unit = (exact[good] / np.where(norms > 0, norms, 1)[good, None]).astype(np.float32)
            blocks[width] = Block(at[good], raw[good], unit, norms[good])
    return blocks


Found = tuple[np.ndarray, np.ndarray, np.ndarray]
Kernel = Callable[[Block, Block], Iterator[Found]]


def cosine_above(threshold: float, strict: bool = False) -> Kernel:
    """Pairs with cosine ``>=`` (``>`` if strict) the threshold.

    A float32 matrix product finds candidates; its rounding error is bounded by the margin, so no pair is missed.
    Candidates are scored again in float64 and compared with the threshold unrounded.
    """

    def run(a: Block, b: Block) -> Iterator[Found]:
        margin = (a.unit.shape[1] + 8) * 2.0**-23
        for r in range(0, len(a.unit), ROWS):
            for c in range(0, len(b.unit), COLS):
                near = a.unit[r : r + ROWS] @ b.unit[c : c + COLS].T >= threshold - margin
                rows, cols = np.nonzero(near)
                rows, cols = rows + r, cols + c
                for p in range(0, len(rows), PAIRS):
                    i, j = rows[p : p + PAIRS], cols[p : p + PAIRS]
                    dots = np.einsum("ij,ij->i", a.raw[i].astype(np.float64), b.raw[j].astype(np.float64))
                    sim = dots / (a.norms[i] * b.norms[j])
                    keep = sim > threshold if strict else sim >= threshold
                    yield a.positions[i[keep]], b.positions[j[keep]], sim[keep]

    return run


def closest(metric: str) -> Kernel:
    """For every left vector the best right vector of the block, by ``cosine`` or ``manhattan`` similarity."""

    def run(a: Block, b: Block) -> Iterator[Found]:
        for r in range(0, len(a.raw), ROWS):
            rows = slice(r, min(r + ROWS, len(a.raw)))
            best = np.full(rows.stop - r, -np.inf)
            where = np.zeros(rows.stop - r, dtype=np.int64)
            for c in range(0, len(b.raw), COLS):
                cols = slice(c, c + COLS)
                if metric == "cosine":
                    left, right = a.raw[rows].astype(np.float64), b.raw[cols].astype(np.float64)
                    sims = (left @ right.T) / np.outer(a.norms[rows], b.norms[cols])
                    at = sims.argmax(axis=1)
                    top = sims[np.arange(len(at)), at]
                else:
                    top, at = _nearest(a.raw[rows], b.raw[cols], best)
                better = top > best
                best[better], where[better] = top[better], at[better] + c
            yield a.positions[rows], b.positions[where], best

    return run


TILE = (128, 512)  # rows and columns whose distances stay in a core's cache while the dimensions pass
LEVELS, GROUP = 1023, 64  # of a value in whole numbers, and dimensions whose sum of them fits 16 bits
RARE = 0.01  # share of a tile that may be candidates of the whole numbers


class _Steps:
    """Vectors of two tables in whole steps, from which the distance of any two follows but for ``error``.

    A value lies less than a step above its number, so a difference of two values is less than a step off that of their numbers.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, low: float, high: float):
        self.step = (high - low) / LEVELS
        self.error = x.shape[1] * self.step * (1 + 2.0**-20)  # the rest is for the rounding of the division
        self.x, self.y = (np.ascontiguousarray(np.clip(np.floor((v.T.astype(np.float64) - low) / self.step), 0, LEVELS), dtype=np.uint16) for v in (x, y))
        self.sum_x, self.sum_y = (v.sum(axis=0, dtype=np.int32) for v in (self.x, self.y))
        self.part, self.total = np.empty(TILE, np.uint16), np.empty(TILE, np.uint16)

    def near(self, rows: slice, cols: slice, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the tile that may be the nearest ones, and nearer than ``known``."""
        shape = rows.stop - rows.start, cols.stop - cols.start
        x, y, part, total = self.x[:, rows], self.y[:, cols], self.part[: shape[0], : shape[1]], self.total[: shape[0], : shape[1]]
        larger = np.zeros(shape, np.int32)
        for group in range(0, len(x), GROUP):
            total.fill(0)
            for k in range(group, min(group + GROUP, len(x))):
                np.maximum(x[k, :, None], y[k, None, :], out=part)
                np.add(total, part, out=total)
            larger += total
        # |a - b| is twice the larger one without both.
        steps = 2 * larger - self.sum_y[None, cols]
        least = np.minimum((steps.min(axis=1) - self.sum_x[rows]) * self.step + self.error, known)
        return np.nonzero(steps <= ((least * (1 + 2.0**-40) + self.error) / self.step + self.sum_x[rows])[:, None])


def _nearest(x: np.ndarray, y: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest negative Manhattan distance to ``y`` and its place for every row of ``x``; exact where it is above ``best``, else any lower value.

    Sums of whole numbers find candidates, or float32 sums where these leave too many; the error of both is bounded by a margin, so that the
    nearest is among them. Candidates are summed again in float64.
    """
    top, at = np.full(len(x), -np.inf), np.zeros(len(x), dtype=np.int64)
    width = x.shape[1]
    low, high = min(float(x.min()), float(y.min())), max(float(x.max()), float(y.max()))
    single = x.dtype == np.float32 and y.dtype == np.float32 and max(-low, high) < 1e30
    kind = np.float32 if single else np.float64
    # Each difference and each addition rounds once, relative to a partial sum that is no larger than the whole.
    margin = (width + 2) * 2.0 ** (-23 if single else -52)
    # Steps must be well above the rounding of the values they are made of, and numbers of all dimensions below 2**31.
    usable = high - low > max(-low, high) * 2.0**-20 and 1e-250 < high - low < 1e250 and width < 1 << 20
    steps, sparse = _Steps(x, y, low, high) if usable else None, True
    xt = yt = None
    for r in range(0, len(x), TILE[0]):
        rows = slice(r, min(r + TILE[0], len(x)))
        for c in range(0, len(y), TILE[1]):
            cols = slice(c, min(c + TILE[1], len(y)))
            known = np.maximum(best[rows], top[rows])
            if steps and sparse:
                i, j = steps.near(rows, cols, -known)
                sparse = len(i) <= RARE * (rows.stop - r) * (cols.stop - c) + 4 * (rows.stop - r)
            if not (steps and sparse):
                if xt is None:
                    xt, yt = (np.ascontiguousarray(v.T, dtype=kind) for v in (x, y))
                total, part = np.zeros((rows.stop - r, cols.stop - c), kind), np.empty((rows.stop - r, cols.stop - c), kind)
                for k in range(width):
                    np.subtract(xt[k, rows, None], yt[k, None, cols], out=part)
                    np.abs(part, out=part)
                    total += part
                least = np.minimum(total.min(axis=1).astype(np.float64), -known)
                # The last term is for differences below the smallest normal number.
                i, j = np.nonzero(total <= (least * (1 + 2.5 * margin) + width * 2.0**-120)[:, None])
            for p in range(0, len(i), PAIRS):
                ip, jp = i[p : p + PAIRS], j[p : p + PAIRS]
                left, right = x[r + ip].astype(np.float64), y[c + jp].astype(np.float64)
                sims = 0.0 - np.cumsum(np.abs(left - right), axis=1)[:, -1]  # one dimension after another
                order = np.lexsort((jp, -sims, ip))
                lead = order[np.flatnonzero(np.append(True, ip[order][1:] != ip[order][:-1]))]
                row, sims, place = r + ip[lead], sims[lead], c + jp[lead]
                better = sims > top[row]
                top[row[better]], at[row[better]] = sims[better], place[better]
    return top, at


def _emit(
    keys: list[pa.Array], left: dict[int, Block], tag: pa.Array, right: dict[int, Block], kernel: Kernel, schema
) -> Iterator[pa.RecordBatch]:
    for width, block in left.items():
        if width not in right:
            continue
        for i, j, sim in kernel(block, right[width]):
            if len(i):
                columns = [k.take(pa.array(i)) for k in keys] + [tag.take(pa.array(j)), pa.array(sim)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _result_schema(chunks: DataFrame, keep: list[str], tags: DataFrame, tag_key: str) -> T.StructType:
    fields = [T.StructField(n, chunks.schema[n].dataType) for n in keep]
    fields.append(T.StructField(tag_key, tags.schema[tag_key].dataType))
    return T.StructType([*fields, T.StructField("similarity", T.DoubleType())])


def place_on_ring(key: Column, ring: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(ring)).cast("int")


def _once(pairs: DataFrame, left: str, right: str, ring: int) -> DataFrame:
    """Rows of two places have met one way round only, rows of one place both ways."""
    a, b = F.col(left), F.col(right)
    return pairs.where((place_on_ring(a, ring) != place_on_ring(b, ring)) | (a < b)) if ring else pairs


def block_join(
    chunks: DataFrame,
    tags: DataFrame,
    kernel: Kernel,
    *,
    keep: list[str] | None = None,
    tag_key: str = "tag",
    chunk_vector: str = "embedding",
    tag_vector: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
    share_bytes: int = SHARE_BYTES,
    zeros: bool = False,
    ring: int = 0,
) -> DataFrame:
    """Rows ``keep + [tag_key, similarity]`` found by ``kernel`` over all (chunk, tag) pairs; zero vectors only if ``zeros``.

    ``ring``, an odd number, is for a table joined with itself on its key, ``keep[0]``: keys lie on so many places, and a row meets
    its own place and the next ``ring // 2``. Any two rows of different keys are compared and given once, in one order or the other.
    """
    keep = [c for c in chunks.columns if c != chunk_vector] if keep is None else list(keep)
    chunks = chunks.select(*keep, F.col(chunk_vector).alias("__vector"))
    tags = tags.select(tag_key, F.col(tag_vector).alias("__vector"))
    schema = _result_schema(chunks, keep, tags, tag_key)
    vector_bytes, ids, values = _measure(tags, tag_key)
    if vector_bytes + ids <= broadcast_bytes:
        return _with_broadcast(chunks, tags, kernel, keep, tag_key, schema, zeros, ring)
    return _with_shares(chunks, tags, kernel, keep, tag_key, schema, vector_bytes, values, share_bytes, zeros, ring)


def _with_broadcast(chunks, tags, kernel, keep, tag_key, schema, zeros, ring) -> DataFrame:
    places = max(ring, 1)
    table = tags.withColumn("__place", place_on_ring(F.col(tag_key), places)).toArrow()
    parts = []
    for place in range(places):
        part = table.filter(pc.equal(table["__place"], place))
        plain = {w: (b.positions, b.raw, b.unit, b.norms) for w, b in _blocks(part["__vector"], zeros).items()}
        parts.append((part[tag_key].combine_chunks(), plain))
    shared = chunks.sparkSession.sparkContext.broadcast(parts)
    arrow_schema = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rights = [(tag, {w: Block(*block) for w, block in plain.items()}) for tag, plain in shared.value]
        for batch in batches:
            for place in pc.unique(batch.column("__place")).to_pylist():
                rows = batch.filter(pc.equal(batch.column("__place"), place)) if ring else batch
                keys, left = [rows.column(n) for n in keep], _blocks(rows.column("__vector"), zeros)
                for step in range(places // 2 + 1):
                    yield from _emit(keys, left, *rights[(place + step) % places], kernel, arrow_schema)

    place = place_on_ring(F.col(keep[0]), ring) if ring else F.lit(0)
    return _once(chunks.withColumn("__place", place).mapInArrow(scan, schema), keep[0], tag_key, ring)


def _with_shares(chunks, tags, kernel, keep, tag_key, schema, vector_bytes, width_sum, share_bytes, zeros, ring) -> DataFrame:
    """Grid of (chunk slice, group of tag shares) cells; every chunk meets every share in exactly one cell.

    A row's place comes from a hash of its content and of its input partition: a lost task redone gives the same
    cells, whatever the order of its rows, and copies of one row spread over the slices. Tags sort before chunks
    inside a cell, hence a task puts its shares on disk, holds one of them and streams the rest. How often a row is sent
    follows the number of tasks, not that of shares. The counts set slices, shares and groups only.
    """
    spark = chunks.sparkSession
    n_chunks = chunks.count()
    shares = max(1, math.ceil(vector_bytes / share_bytes))
    if ring:  # the shares are the places
        shares = max(ring, shares | 1)
    tasks = max(spark.sparkContext.defaultParallelism, n_chunks * width_sum / TASK_FLOPS)
    # As many tasks as wanted with about as many groups as slices, so that the fewest rows are sent.
    groups = min(shares, max(math.ceil(vector_bytes / SPOOL_BYTES), math.ceil(math.sqrt(tasks))))
    per_group = math.ceil(shares / groups)
    groups = math.ceil(shares / per_group)
    slices = max(1, min(math.ceil(tasks / groups), MAX_PARTITIONS, n_chunks))

    def number(columns: list[str], n: int):
        return F.pmod(F.xxhash64(*columns, F.spark_partition_id()), F.lit(n)).cast("int")

    def all_of(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    tag_type = tags.schema[tag_key].dataType
    no_keys = [F.lit(None).cast(schema[n].dataType).alias(n) for n in keep]
    def group_of(share: Column) -> Column:
        return F.floor(share / per_group).cast("int")

    tag_rows = (
        tags.withColumn("__share", place_on_ring(F.col(tag_key), shares) if ring else number([tag_key], shares))
        .withColumn("__slice", all_of(slices))
        .select("__slice", group_of(F.col("__share")).alias("__group"), F.lit(0).alias("__side"), "__share", *no_keys, F.col(tag_key).alias("__tag"), "__vector")
    )
    no_tag = F.lit(None).cast(tag_type).alias("__tag")
    own, met = F.lit(0), all_of(groups)
    if ring:
        own = place_on_ring(F.col(keep[0]), shares)
        places = F.transform(F.sequence(F.lit(0), F.lit(shares // 2)), lambda step: group_of(F.pmod(own + step, F.lit(shares))))
        met = F.explode(F.array_distinct(places))
    chunk_rows = (
        chunks.withColumn("__slice", number([*keep, "__vector"], slices))
        .withColumn("__group", met)
        .select("__slice", "__group", F.lit(1).alias("__side"), own.alias("__share"), *keep, no_tag, "__vector")
    )
    cells = (
        tag_rows.unionByName(chunk_rows)
        .repartition(min(slices * groups, MAX_PARTITIONS), "__slice", "__group")
        .sortWithinPartitions("__slice", "__group", "__side", "__share")
    )
    arrow_schema = to_arrow_schema(schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, share, parts, spool = None, None, [], Spool()
        for batch in batches:
            marks = [batch.column(n).to_numpy() for n in ("__slice", "__group", "__side", "__share")]
            change = np.flatnonzero(np.any([np.diff(m) != 0 for m in marks], axis=0)) + 1
            bounds = [0, *change.tolist(), batch.num_rows]
            for start, stop in zip(bounds, bounds[1:]):
                if start == stop:
                    continue
                run = batch.slice(start, stop - start)
                here, side, place = (marks[0][start], marks[1][start]), marks[2][start], marks[3][start]
                if here != cell:
                    cell, parts = here, []
                    spool.clear()
                if parts and (side or place != share):
                    table = pa.Table.from_batches(parts)
                    spool.put(share, table["__tag"].combine_chunks(), _blocks(table["__vector"], zeros))
                    parts = []
                if not side:
                    share = place
                    parts.append(run)
                    continue
                keys, left = [run.column(n) for n in keep], _blocks(run.column("__vector"), zeros)
                for number in spool.places:
                    if not ring or (number - place) % shares <= shares // 2:
                        yield from _emit(keys, left, *spool.get(number), kernel, arrow_schema)

    return _once(cells.mapInArrow(stream, schema), keep[0], tag_key, shares if ring else 0)


class Spool:
    """Tag shares in a file of the executor's own disk, which goes with the task; the share asked for last is held."""

    def __init__(self):
        self.file, self.places, self.held = tempfile.TemporaryFile(), {}, None

    def clear(self) -> None:
        self.file.seek(0)
        self.file.truncate()
        self.places, self.held = {}, None

    def put(self, share: int, tag: pa.Array, blocks: dict[int, Block]) -> None:
        self.places[share] = self.file.seek(0, 2)
        plain = {w: (b.positions, b.raw, b.unit, b.norms) for w, b in blocks.items()}
        pickle.dump((tag, plain), self.file, pickle.HIGHEST_PROTOCOL)

    def get(self, share: int) -> tuple[pa.Array, dict[int, Block]]:
        if self.held is None or self.held[0] != share:
            self.file.seek(self.places[share])
            tag, plain = pickle.load(self.file)
            self.held = share, tag, {w: Block(*block) for w, block in plain.items()}
        return self.held[1:]


def _measure(tags: DataFrame, tag_key: str) -> tuple[int, int, int]:
    """Bytes of the vectors as tasks hold them, bytes of the keys, and number of values."""
    values, ids = tags.agg(
        F.coalesce(F.sum(F.greatest(F.size("__vector"), F.lit(0)).cast("long")), F.lit(0)),
        F.coalesce(F.sum(F.length(F.col(tag_key).cast("string"))), F.lit(0)),
    ).first()
    single = isinstance(tags.schema["__vector"].dataType.elementType, T.FloatType)
    return values * (8 if single else 12), ids, values  # the given values and the float32 unit vectors


def similarity_join(
    chunks: DataFrame, tags: DataFrame, threshold: float, *, strict: bool = False, **options
) -> DataFrame:
    """One row per (chunk, tag) with cosine at or above the threshold (above it if ``strict``)."""
    return block_join(chunks, tags, cosine_above(threshold, strict), **options)


class Vectors:
    """A tag table or a share of it: the distinct tags in order, the place of each row's tag, and the usable vectors by width."""

    def __init__(self, tags: pa.Array, codes: np.ndarray, blocks: dict[int, tuple]):
        self.tags, self.codes = tags, codes
        self.blocks = {w: Block(*block) for w, block in blocks.items()}


def _coded(tag: pa.Array, vectors: pa.Array) -> tuple[pa.Array, np.ndarray, dict[int, tuple]]:
    """What ``Vectors`` are made of; broadcast as it is, since classes of this package travel with functions only."""
    coded = tag.dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary, null_placement="at_end")
    place = np.empty(len(order), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    blocks = {w: (b.positions, b.raw, b.unit, b.norms) for w, b in _blocks(vectors).items()}
    return coded.dictionary.take(order), place[coded.indices.to_numpy()], blocks


def _documents(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Whole documents of a stream that is sorted by ``doi``, in tables of about ``rows`` rows."""
    held, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            held.append(batch.slice(start, rows))
            size += held[-1].num_rows
            if size < rows:
                continue
            table = pa.Table.from_batches(held)
            ends = np.flatnonzero(np.diff(_document_codes(table))) + 1
            if len(ends):
                last = int(ends[-1])
                yield table.slice(0, last)
                table = table.slice(last)
            held, size = table.to_batches(), table.num_rows
    if size:
        yield pa.Table.from_batches(held)


def _document_codes(table: pa.Table) -> np.ndarray:
    return table["doi"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


def _highest(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with its highest value."""
    if not found:
        return np.empty(0, np.int64), np.empty(0)
    keys, values = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.maximum.reduceat(values, starts) if len(starts) else values


def _scored_documents(batches: Iterator[pa.RecordBatch], right: Vectors, kernel: Kernel, schema, settle=None, rank=None) -> Iterator[pa.RecordBatch]:
    """The best score per document and tag; a document's pairs are held as one row per tag. ``settle`` picks of a document's tags those to keep.

    Documents come out as they stand, a document's tags in order or, with ``rank`` (a place for every tag), by descending score, then by rank.
    """
    n, blocks = max(len(right.tags), 1), right.blocks
    for table in _documents(batches, max(1, min(ROWS, CELLS // n))):
        doc = _document_codes(table).astype(np.int64)
        first = np.unique(doc, return_index=True)[1]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = kept = 0
        for width, block in _blocks(table["__vector"]).items():
            if width not in blocks:
                continue
            for i, j, sim in kernel(block, blocks[width]):
                found.append((doc[i] * n + right.codes[j], sim))
                held += len(i)
                if held > 2 * kept + CELLS // 4:
                    found = [_highest(found)]
                    held = kept = len(found[0][0])
        keys, sims = _highest(found)
        if settle:
            ends = np.append(np.flatnonzero(np.diff(keys // n)) + 1, len(keys)).tolist()
            null = {d for d, row in enumerate(first.tolist()) if not table["doi"][row].is_valid}
            stay = np.ones(len(keys), dtype=bool)
            for start, stop in zip([0, *ends], ends):
                if stop > start and int(keys[start] // n) not in null:  # a tag goes by its document's name
                    stay[start:stop] = settle(keys[start:stop] % n, sims[start:stop])
            keys, sims = keys[stay], sims[stay]
        if rank is not None:
            order = np.lexsort((rank[keys % n], -sims, keys // n))
            keys, sims = keys[order], sims[order]
        doi = table["doi"].combine_chunks().take(pa.array(first))
        for at in range(0, len(keys), PAIRS):
            key = keys[at : at + PAIRS]
            columns = [doi.take(pa.array(key // n)), right.tags.take(pa.array(key % n)), pa.array(sims[at : at + PAIRS])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _usual_and_large(chunks: DataFrame) -> tuple[int, DataFrame, DataFrame | None]:
    """Number of chunks; those of usual documents, and those of documents with more than ``DOCUMENT_CHUNKS``, if there are any."""
    sizes = chunks.groupBy("doi").agg(F.count("*").alias("n"))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most <= DOCUMENT_CHUNKS:
        return total, chunks, None
    large = cut(sizes.where(F.col("n") > DOCUMENT_CHUNKS).select(F.col("doi").alias("__large")))
    same = F.col("doi").eqNullSafe(F.col("__large"))
    return total, chunks.join(large, same, "left_anti"), chunks.join(large, same, "left_semi")


def _name_ranks(tags: pa.Array) -> np.ndarray:
    """Place of every tag by its local name, equal ones by the whole tag, null first."""
    names = [(t is not None, (t or "").rpartition("/")[2], t or "") for t in tags.to_pylist()]
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    return rank


def score_tags(chunks: DataFrame, tags: DataFrame, threshold: float, *, ranked: bool = False, **options) -> DataFrame:
    """``doi, tag, similarity``: best cosine over a document's chunks, at or above the threshold.

    The threshold is tested on chunks: the maximum passes exactly if some chunk passes. Chunks are brought together by document, so that
    the maximum is taken where the pairs are found: chunks are shuffled, pairs are not. Documents of very many chunks are spread over tasks as
    they come; only their pairs, combined map-side, are shuffled.

    ``ranked`` gives the rows in order: documents and their similarities descending, then by the tag's local name. Chunks are then dealt to
    ranges of documents and a document's rows are ordered where they are found; rows are sorted by a shuffle only where that cannot be.
    """
    return _score_documents(chunks, tags, threshold, None, ranked=ranked, **options)


def annotate_documents(chunks: DataFrame, tags: DataFrame, threshold_chunk: float, settle, **options) -> DataFrame | None:
    """As ``score_tags``, of each document only the tags that ``settle`` keeps: ``settle(vectors)`` gives a function of a document's tags (places in
    ``vectors.tags``, ascending) and scores. None where a task cannot have all it needs: if the tag table is too large to be broadcast, if tags
    repeat, or if there are documents of very many chunks.
    """
    vectors = tags.select("tag", F.col(options.get("tag_vector", "embedding")).alias("__vector"))
    vector_bytes, ids, _ = _measure(vectors, "tag")
    if vector_bytes + ids > options.get("broadcast_bytes", BROADCAST_BYTES):
        return None
    named = tags.groupBy("tag").agg(F.count("*").alias("n")).where("n > 1 OR tag IS NULL")
    if not named.isEmpty() or _usual_and_large(chunks)[2] is not None:
        return None
    return _score_documents(chunks, tags, threshold_chunk, settle, **options)


def _score_documents(
    chunks: DataFrame,
    tags: DataFrame,
    threshold: float,
    settle,
    *,
    ranked: bool = False,
    chunk_vector: str = "embedding",
    tag_vector: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
    share_bytes: int = SHARE_BYTES,
) -> DataFrame:
    chunks = chunks.select("doi", F.col(chunk_vector).alias("__vector"))
    tags = tags.select("tag", F.col(tag_vector).alias("__vector"))
    schema = _result_schema(chunks, ["doi"], tags, "tag")
    vector_bytes, ids, values = _measure(tags, "tag")
    total, usual, large = _usual_and_large(chunks)
    kernel, layout = cosine_above(threshold), to_arrow_schema(schema)
    tasks = max(4 * chunks.sparkSession.sparkContext.defaultParallelism, math.ceil(total * values / TASK_FLOPS))
    if vector_bytes + ids <= broadcast_bytes:
        table = tags.toArrow()
        shared = chunks.sparkSession.sparkContext.broadcast(_coded(table["tag"].combine_chunks(), table["__vector"]))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            right = Vectors(*shared.value)
            return _scored_documents(batches, right, kernel, layout, settle(right) if settle else None, _name_ranks(right.tags) if ranked else None)

        parts, by = max(1, min(tasks, MAX_PARTITIONS, total)), F.desc("doi") if ranked else F.col("doi")
        dealt = usual.repartitionByRange(parts, by) if ranked else usual.repartition(parts, by)
        scored = dealt.sortWithinPartitions(by).mapInArrow(scan, schema)
        if large is None:
            return scored
    else:
        shares = max(1, math.ceil(vector_bytes / share_bytes))
        slices = max(1, min(math.ceil(tasks / shares), MAX_PARTITIONS, total))
        scored = _documents_with_shares(usual, tags, kernel, schema, shares, slices)
    if large is not None:
        sizes = {"broadcast_bytes": broadcast_bytes, "share_bytes": share_bytes}
        pairs = block_join(large, tags, kernel, keep=["doi"], chunk_vector="__vector", tag_vector="__vector", **sizes)
        scored = scored.unionByName(pairs.groupBy("doi", "tag").agg(F.max("similarity").alias("similarity")))
    return scored.orderBy(F.desc("doi"), F.desc("similarity"), tx.local_name(F.col("tag")), "tag") if ranked else scored


def _documents_with_shares(chunks: DataFrame, tags: DataFrame, kernel: Kernel, schema: T.StructType, shares: int, slices: int) -> DataFrame:
    """As ``_with_shares``, with slices by document and shares by tag: a document meets a tag in one cell, which takes the maximum."""

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    no_doi, no_tag = (F.lit(None).cast(schema[n].dataType) for n in ("doi", "tag"))
    tag_rows = (
        tags.withColumn("__share", place_on_ring(F.col("tag"), shares))
        .withColumn("__slice", all_of(slices))
        .select("__slice", "__share", F.lit(0).alias("__side"), no_doi.alias("doi"), F.col("tag").alias("__tag"), "__vector")
    )
    chunk_rows = (
        chunks.withColumn("__slice", place_on_ring(F.col("doi"), slices))
        .withColumn("__share", all_of(shares))
        .select("__slice", "__share", F.lit(1).alias("__side"), "doi", no_tag.alias("__tag"), "__vector")
    )
    cells = (
        tag_rows.unionByName(chunk_rows)
        .repartition(min(slices * shares, MAX_PARTITIONS), "__slice", "__share")
        .sortWithinPartitions("__slice", "__share", "__side", "doi")
    )
    layout = to_arrow_schema(schema)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
        for batch in batches:
            marks = [batch.column(n).to_numpy() for n in ("__slice", "__share", "__side")]
            change = np.flatnonzero(np.any([np.diff(m) != 0 for m in marks], axis=0)) + 1
            bounds = [0, *change.tolist(), batch.num_rows]
            for start, stop in zip(bounds, bounds[1:]):
                if stop > start:
                    yield (int(marks[0][start]), int(marks[1][start])), int(marks[2][start]), batch.slice(start, stop - start)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell in groupby(runs(batches), key=lambda run: run[0]):
            right = None
            for side, members in groupby(cell, key=lambda run: run[1]):
                if side == 0:
                    table = pa.Table.from_batches([run for _, _, run in members])
                    right = Vectors(*_coded(table["__tag"].combine_chunks(), table["__vector"]))
                elif right is not None:
                    yield from _scored_documents((run for _, _, run in members), right, kernel, layout)

    return cells.mapInArrow(stream, schema)


def best_similarity(chunks: DataFrame, tags: DataFrame, metric: str = "manhattan", **options) -> DataFrame:
    """``doi, best_similarity``: the single best similarity over all chunks of a document and all tags."""
    if metric not in ("manhattan", "cosine"):
        raise ValueError(f"unknown metric: {metric}")
    best = block_join(chunks, tags, closest(metric), keep=["doi"], zeros=metric == "manhattan", **options)
    return best.groupBy("doi").agg(F.max("similarity").alias("best_similarity"))


def tag_edges(tags: DataFrame, threshold: float, **options) -> DataFrame:
    """``tag_a < tag_b`` with cosine above the threshold; computed once per tag table, not once per document.

    Tags lie on a ring of places: two tags of different places are compared once, whichever comes first.
    """
    options = {"ring": RING, **options}
    pairs = similarity_join(
        tags.select(F.col("tag").alias("tag_a"), "embedding"),
        tags.select(F.col("tag").alias("tag_b"), "embedding"),
        threshold,
        strict=True,
        tag_key="tag_b",
        **options,
    )
    a, b = F.col("tag_a"), F.col("tag_b")
    return pairs.select(F.least(a, b).alias("tag_a"), F.greatest(a, b).alias("tag_b"), "similarity").where("tag_a < tag_b")
