"""Exact Jaccard join of documents on word shingles by vertical partitioning.

Shingles have a global order: by the number of distinct sets that hold them, rare first, then by hash. The hash range is
cut into fragments at the same points for all documents; overlaps are counted per fragment and summed per pair.

1. Documents with the same set are one class; only its smallest id goes on.
2. A set that links with another shares at least ``threshold`` of its own shingles. Over the first part of the hash
   range, shingles that only one document has are counted; a document with too many of them can have no partner.
   The same test follows over the whole range for the documents left, so that ordinary text is gone early.
3. Prefixes in the global order give candidates. Every posting list first meets one hub, the member with the fewest
   unshared shingles; links make components. After that only pairs across components are left to test, and a posting
   list whose members are in one component is done: no list is expanded into all its pairs.
4. Candidates pass bounds by length and by place of the shingle, and are then counted exactly.

Everything is keyed by node: a ``doc_id``, or a number of its own for each of the different sets that rows of one repeated ``doc_id`` have.

Defined results: null text and text without words have an empty set and no links; a text of fewer words than ``k`` is
one shingle of all its words; a repeated ``doc_id`` joins the components of all its rows, which each keep their own ``n_shingles`` and links;
rows with a null id link with nothing and have a null component. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import WORD, batch_bytes, components, pieces, release_shuffles, running_total, shingle_hashes, small, word_hashes
from termweave.runtime import cut

FRAGMENTS = 8
_ONE, _TWO = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)

_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])
_GRAMS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("grams", pa.list_(pa.int64()))])


def _sets_of(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles sorted by (row, hash), the row of each, and their number per row."""
    h, row = shingle_hashes(*word_hashes(batch.column("text")), k)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
    return h, row, np.bincount(row, minlength=batch.num_rows)


def _signatures(k: int, more: tuple[str, ...] = ()):
    """Rows (doc_id, n, s1, s2) and the columns named in ``more``."""
    schema = pa.schema([*_SETS, *[(c, pa.int64()) for c in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                h, row, n = _sets_of(batch, k)
                start = np.concatenate(([0], np.cumsum(n)))
                sums = []
                for part in (h * _ONE ^ (h >> np.uint64(29)), h * h * _TWO + (h >> np.uint64(31))):
                    total = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(part, out=total[1:])
                    sums.append(pa.array(np.diff(total[start]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *sums, *[batch.column(c) for c in more]], schema=schema)

    return run


def _grams(k: int, below: int | None):
    """Rows (doc_id, n, shingles), only those under ``below`` if given; rows without shingles are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                h, row, n = _sets_of(batch, k)
                if below is not None:
                    low = h < np.uint64(below)
                    h, row = h[low], row[low]
                kept = np.bincount(row, minlength=batch.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(kept))), pa.int32()), pa.array(h.view(np.int64)))
                out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), lists], schema=_GRAMS)
                yield out.filter(pa.array(kept > 0))

    return run


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, n, s1, s2)``: size and a 128-bit signature of each row's shingle set."""
    return _slim(docs).mapInArrow(_signatures(k), "doc_id long, n long, s1 long, s2 long")


def shingle_lists(docs: DataFrame, k: int, below: int | None = None) -> DataFrame:
    return _slim(docs).mapInArrow(_grams(k, below), "doc_id long, n long, grams array<long>")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _unshared(grams: DataFrame) -> DataFrame:
    """``(doc_id, alone)``: shingles of each document that no other one has; documents without such are not listed."""
    return (
        grams.groupBy("gram")
        .agg(F.count("*").alias("df"), F.min("doc_id").alias("doc_id"))
        .where("df = 1")
        .groupBy("doc_id")
        .agg(F.count("*").alias("alone"))
    )


def _needed(percent: int, n: Column) -> Column:
    """Least number of its shingles that a set of size n shares with any partner."""
    return F.ceil(F.lit(percent) * n / F.lit(100)).cast("long")


def _bounds(percent: int) -> Column:
    """Can a pair whose first common shingle stands at pos_a and pos_b in the global order reach the threshold?

    All before is not common, so the overlap is at most what follows. Other common shingles of a pair may fail this, the first may not.
    """
    most = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    return F.lit(100) * most >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - most)


def _ends(posting: DataFrame, end: str, *more: str) -> DataFrame:
    return posting.select("gram", F.col("doc_id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "pos", *more)])


def _verify(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Links among ``pairs(a, b, n_a, n_b)``: partial overlaps per fragment, summed per pair."""
    left = segments.select(F.col("doc_id").alias("a"), "fragment", F.col("part").alias("part_a"))
    right = segments.select(F.col("doc_id").alias("b"), "fragment", F.col("part").alias("part_b"))
    return (
        pairs.join(left, "a")
        .join(right, ["b", "fragment"])
        .select("a", "b", "n_a", "n_b", F.size(F.array_intersect("part_a", "part_b")).alias("common"))
        .groupBy("a", "b", "n_a", "n_b")
        .agg(F.sum("common").alias("common"))
        .where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("common")))
        .select("a", "b")
    )


def link_classes(docs: DataFrame, sets: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between class representatives; they join just those that are linked directly or through others.

    ``sets`` is the stored output of ``shingle_sets``, ``reps`` has the representatives' ``doc_id``.
    """
    docs = _slim(docs).where("doc_id IS NOT NULL")
    sizes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("n").alias("n"), F.count("*").alias("rows"))
    # A part of the hash range wide enough to tell documents of mostly unshared text.
    share = min(1.0, (100 - percent) / 60)
    low = shingle_lists(docs, k, int(share * 2.0**64) if share < 1 else None)
    alone = _unshared(low.select("doc_id", F.explode("grams").alias("gram")))
    spare = F.col("n") - _needed(percent, F.col("n"))
    left = sizes.join(alone, "doc_id", "left").where((F.coalesce("alone", F.lit(0)) <= spare) | (F.col("rows") > 1))
    with batch_bytes(docs.sparkSession):
        left = cut(left.join(reps, "doc_id", "left_semi").select("doc_id"))
    release_shuffles(docs.sparkSession)  # each step's files go before the next one writes its own

    # The whole sets of what is left, and the frequencies among them.
    lists = shingle_lists(docs.join(small(left), "doc_id", "left_semi"), k)
    with batch_bytes(docs.sparkSession):
        lists = cut(lists.groupBy("doc_id").agg(F.max(F.struct("n", "grams")).alias("set")).select("doc_id", "set.*"))
    grams = lists.select("doc_id", "n", F.explode("grams").alias("gram"))
    frequent = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    shared = cut(
        grams.join(frequent, "gram")
        .groupBy("doc_id", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))  # at most the document's own
        .withColumn("shared", F.size("grams").cast("long"))
        .where(F.col("shared") >= _needed(percent, F.col("n")))
    )
    segments = cut(
        shared.select("doc_id", F.explode("grams.gram").alias("gram"))
        .groupBy("doc_id", F.pmod("gram", F.lit(FRAGMENTS)).alias("fragment"))
        .agg(F.collect_list("gram").alias("part"))
    )
    release_shuffles(docs.sparkSession)
    # Unshared shingles are the rarest and fill the front of a prefix.
    prefix = F.col("shared") - _needed(percent, F.col("n")) + 1
    alone = F.col("n") - F.col("shared")
    posting = shared.select("doc_id", "n", alone.alias("alone"), F.posexplode(F.slice("grams.gram", F.lit(1), prefix.cast("int"))).alias("at", "gram"))
    posting = cut(posting.select("gram", "doc_id", "n", "alone", (F.col("alone") + F.col("at")).alias("pos")))

    best = F.min(F.struct("alone", "doc_id", "n", "pos"))
    hubs = posting.groupBy("gram").agg(best.alias("hub"), F.count("*").alias("df")).where("df > 1").select("gram", "hub.*")
    star = _ends(hubs, "a").join(_ends(posting, "b"), "gram").where("a <> b").where(_bounds(percent))
    links = cut(_verify(star.select("a", "b", "n_a", "n_b").distinct(), segments, percent))

    release_shuffles(docs.sparkSession)
    labels = components(links).select(F.col("node").alias("doc_id"), "component")
    placed = cut(posting.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    per = placed.groupBy("gram", "component").agg(F.count("*").alias("members"))
    largest = per.groupBy("gram").agg(F.max_by("component", F.struct("members", "component")).alias("largest"), F.count("*").alias("parts"))
    mixed = cut(placed.join(largest.where("parts > 1"), "gram"))
    cross = (
        _ends(mixed.where("component <> largest"), "a", "component")
        .join(_ends(mixed, "b", "component"), "gram")
        .where("component_a <> component_b")
        .where(_bounds(percent))
    )
    one, two = (F.struct(F.col(x).alias("id"), F.col(f"n_{x}").alias("n")) for x in "ab")
    cross = cross.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y"))
    cross = cross.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))
    return links.union(_verify(cross.distinct(), segments, percent))


def _numbered_sets(sets: DataFrame) -> DataFrame | None:
    """``(doc_id, n, s1, s2, node)`` of the ids whose rows have different sets; none if there are no such ids."""
    key = ["n", "s1", "s2"]
    filled = sets.where("n > 0 AND doc_id IS NOT NULL")
    several = filled.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("low"), F.max(F.struct(*key)).alias("high")).where("low < high")
    several = cut(several.select("doc_id"))
    rows = several.count()
    if not rows:
        return None
    distinct = filled.join(small(several, rows), "doc_id", "left_semi").select("doc_id", *key).distinct()
    ranked = cut(running_total(distinct.withColumn("one", F.lit(1).cast("long")), [F.col(c) for c in ("doc_id", *key)], {"place": "one"}))
    low, high, count = (*sets.agg(F.min("doc_id"), F.max("doc_id")).first(), ranked.count())
    # Numbers that no document has: after the largest id, or before the smallest.
    node = F.lit(high) + F.col("place") if high + count < 1 << 63 else F.lit(low) - F.col("place")
    return cut(ranked.select("doc_id", *key, node.alias("node")))


def _with_nodes(docs: DataFrame, numbered: DataFrame | None, k: int) -> DataFrame:
    """``docs`` with ``__node``, one for all rows of equal id and set."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    if numbered is None:
        return docs.withColumn("__node", doc_id)
    # The sets of just these rows once more, by a hash of their text.
    hashes = [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]
    some = docs.select(doc_id.alias("doc_id"), text.alias("text"), *hashes).join(small(numbered.select("doc_id").distinct()), "doc_id", "left_semi")
    signed = some.mapInArrow(_signatures(k, ("t1", "t2")), "doc_id long, n long, s1 long, s2 long, t1 long, t2 long")
    with batch_bytes(docs.sparkSession):
        found = cut(signed.join(numbered, ["doc_id", "n", "s1", "s2"]).select(F.col("doc_id").alias("__id"), "t1", "t2", "node").distinct())
    found = found.select("__id", F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.col("node").alias("__node"))
    same = (doc_id == F.col("__id")) & (F.xxhash64(text) == F.col("__t1")) & (F.xxhash64(F.lit(1), text) == F.col("__t2"))
    joined = docs.join(small(found), same, "left")
    return joined.withColumn("__node", F.coalesce("__node", doc_id)).drop("__id", "__t1", "__t2")


def _node_components(docs: DataFrame, sets: DataFrame, numbered: DataFrame | None, k: int, percent: int, joined_ids: bool) -> DataFrame:
    """Stored ``(doc_id, n, node, component)`` of every row; components are of nodes, ``joined_ids`` links those of one id."""
    key = ["n", "s1", "s2"]
    if numbered is None:
        sets = sets.withColumn("node", F.col("doc_id"))
    else:
        marked = numbered.select(F.col("doc_id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in key], "node")
        same = [F.col("doc_id") == F.col("__id"), *[F.col(c) == F.col(f"__{c}") for c in key]]
        sets = cut(sets.join(small(marked), same, "left").select("doc_id", *key, F.coalesce("node", "doc_id").alias("node")))
    nodes = sets.select(F.col("node").alias("doc_id"), *key)
    reps = nodes.where("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    rows = cut(sets.join(reps, key, "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "node"))))
    by_node = _with_nodes(docs, numbered, k).select(F.col("__node").alias("doc_id"), "text")
    links = link_classes(by_node, nodes, reps.select(F.col("rep").alias("doc_id")).distinct(), k, percent)
    if joined_ids:
        ids = rows.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
        twice = rows.join(ids.where("low < high"), "doc_id").where("rep > low").select(F.col("low").alias("a"), F.col("rep").alias("b"))
        links = links.union(twice)
    labels = components(links).select(F.col("node").alias("rep"), "component")
    return cut(rows.join(labels, "rep", "left").select("doc_id", "n", "node", F.coalesce("component", "rep").alias("component")))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row; sets link from a Jaccard similarity of ``percent``/100."""
    with batch_bytes(docs.sparkSession):
        sets = cut(shingle_sets(docs, k))
    numbered = _numbered_sets(sets)
    found = _node_components(docs, sets, numbered, k, percent, joined_ids=True)
    if numbered is None:
        return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    # Numbers of nodes are not ids: a component's smallest id is looked up.
    least = found.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one_per_component(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, of its smallest node, which is the smallest ``doc_id`` unless rows of one id differ.

    A repeated id links nothing here: rows stand for themselves, and different texts under one id stay. Rows without an id or without
    words stay, too.
    """
    with batch_bytes(docs.sparkSession):
        sets = cut(shingle_sets(docs, k))
    numbered = _numbered_sets(sets)
    found = _node_components(docs, sets, numbered, k, percent, joined_ids=False).where("n > 0 AND doc_id IS NOT NULL")
    gone = cut(found.where("node <> component").select(F.col("node").alias("__gone")).distinct())
    again = cut(found.where("node = component").groupBy(F.col("node").alias("__again")).agg(F.count("*").alias("rows")).where("rows > 1").select("__again"))
    placed = _with_nodes(docs, numbered, k).withColumn("__node", F.when(F.coalesce(F.col("text").rlike(WORD), F.lit(False)), F.col("__node")))
    kept = placed.join(small(gone), F.col("__node") == F.col("__gone"), "left_anti")
    rows = again.count()
    if not rows:
        return kept.select(*docs.columns)
    # Rows of equal id and set: the least text stays.
    again = small(again, rows)
    once = kept.join(again, F.col("__node") == F.col("__again"), "left_anti").select(*docs.columns)
    first = kept.join(again, F.col("__node") == F.col("__again"), "left_semi")
    first = first.groupBy("__node").agg(F.min_by(F.struct(*docs.columns), "text").alias("row")).select("row.*")
    return once.unionByName(first)
