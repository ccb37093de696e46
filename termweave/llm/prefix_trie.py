"""The trie of conversation openings, built by a van Emde Boas recursion over turns.

Sequences are cut at half their (padded) depth, again and again, all parts of one size in one step.

1. Fold: turns become 128-bit fingerprints, two neighbouring blocks of h turns become the name of a block of 2h turns. Each step is an
   aggregation by (conversation, block), and leaves a dictionary of distinct blocks with their halves.
2. Equal sequences are one edge from the root by now. An edge from node r over a block is cut at half depth: the cut prefix gets a name,
   node m; the edge falls into one of the upper trie, from r over the first half, and one of the lower forest, from m over the second.
   Equal edges of all sequences merge at once. After log2(depth) steps edges are single turns, that is, the nodes of the trie.
3. Totals are grafted upward: the subtree of height 2h below a node is its upper trie of height h and the lower forests of height h
   whose roots lie h below it, so heights double with every step.

No step holds a conversation, a group of equal conversations or a subtree in one task: rows are fingerprints and numbers, grouped with
partial sums, and joined to tables of one row per key, where adaptive execution cuts a frequent key of the other side into parts.

Defined results: rows without ``conv_id`` belong to no conversation and are left out; null role or text is empty; turns go in ascending
order, null first, equal ones by fingerprint; repeated rows are turns of their own; no conversations give no nodes. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import running_total
from termweave.runtime import cut

ROOT = bytes(16)  # name of the root
CHUNK = 4096  # ids joined to one string

_DIGESTS = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])


def _fingerprint(data: Column) -> Column:
    return F.unhex(F.substring(F.sha2(data, 256), 1, 32))


def _name(*parts: Column | str) -> Column:
    """128-bit name of a row of names; nulls, all at the end, count as absent."""
    return _fingerprint(F.concat(*[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit(b"")) for p in parts]))


def turns_of(conversations: DataFrame) -> DataFrame:
    """Stored ``(conv_id, pos, name, bytes)``: place of each turn in its conversation, fingerprint, UTF-8 bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _fingerprint(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("name"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.lit(1).cast("long").alias("one"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("name")]
    placed = cut(running_total(slim, order, {"row": "one"}))
    first = placed.groupBy("conv_id").agg(F.min("row").alias("first"))
    return cut(placed.join(first, "conv_id").select("conv_id", (F.col("row") - F.col("first")).cast("int").alias("pos"), "name", "bytes"))


def with_shared_openings(turns: DataFrame, block: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their block, as ``(conversations, turns)``.

    Conversation c takes the first h turns of c - c % block, then its own turns after its first h; h is crc32(c) % longest.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest).cast("int")
    sizes = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n"))
    convs = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = cut(convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))))
    heads = turns.where(F.col("pos") < longest - 1).withColumnRenamed("conv_id", "base")
    heads = convs.where("taken > 0").select("conv_id", "base", "taken").join(heads, "base").where("pos < taken")
    tails = turns.join(convs.where("n > h").select("conv_id", "h", "taken"), "conv_id").where("pos >= h")
    tails = tails.withColumn("pos", F.col("taken") + F.col("pos") - F.col("h"))
    columns = ["conv_id", "pos", "name", "bytes"]
    return convs.select("conv_id"), cut(heads.select(*columns).unionByName(tails.select(*columns)))


def _fold(turns: DataFrame, levels: int) -> tuple[DataFrame, list[DataFrame]]:
    """Whole sequences as blocks ``(conv_id, name, n, cover)``, and per level the distinct blocks with their halves.

    ``cover`` lists the full blocks, largest first, that make up the sequence.
    """
    blocks = cut(
        turns.select("conv_id", F.col("pos").alias("block"), "name", F.lit(1).alias("n"), F.array("name").alias("cover"), "bytes")
    )
    halves = []
    for level in range(1, levels + 1):
        side = F.col("block") % 2
        kept = ["name", "n", "cover", "bytes"]
        paired = blocks.groupBy("conv_id", F.floor(F.col("block") / 2).cast("int").alias("block")).agg(
            *[F.max(F.when(side == i, F.struct(*kept))).alias(half) for i, half in enumerate(("left", "right"))]
        )
        n = F.col("left.n") + F.coalesce("right.n", F.lit(0))
        name = _name("left.name", "right.name")
        joint = F.when(F.col("left.n") < 2 ** (level - 1), F.col("left.cover")).otherwise(
            F.concat("left.cover", F.coalesce("right.cover", F.array().cast("array<binary>")))
        )
        cover = F.when(n == 2**level, F.array(name)).otherwise(joint)
        blocks = cut(paired.select("conv_id", "block", name.alias("name"), n.alias("n"), cover.alias("cover"), F.lit(0).cast("long").alias("bytes"), "left", "right"))
        halves.append(
            blocks.groupBy(F.col("name").alias("block")).agg(
                *[F.any_value(f"{half}.{c}").alias(f"{c}_{half}") for half in ("left", "right") for c in ("name", "n", "bytes")]
            )
        )
    return blocks.select("conv_id", "name", "n", "cover"), halves


def _merged(edges: DataFrame) -> DataFrame:
    """One edge per start and block; ``end`` is the node at its end, null if the block is not full."""
    return edges.groupBy("root", "block").agg(
        *[F.any_value(c).alias(c) for c in ("depth", "n", "end", "bytes")],
        F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
    )


def trie(conversations: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie of ``turns(conv_id, pos, name, bytes)``, and ``(node, conv_id)`` of where every conversation ends.

    ``conversations`` has every ``conv_id`` once, also those without turns. Nodes are ``(node, conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens)``; ``saved_tokens`` sums (n_convs - 1) times the bytes of the last text over a subtree.
    """
    deepest = (turns.agg(F.max("pos")).first()[0] or 0) + 1
    levels = (deepest - 1).bit_length()
    whole, halves = _fold(turns, levels)
    root = F.lit(ROOT)
    ends = whole.select("conv_id", F.aggregate("cover", root, lambda node, block: _name(node, block)).alias("node"))
    without = conversations.join(whole.select("conv_id"), "conv_id", "left_anti")
    ends = cut(ends.select("node", "conv_id").unionByName(without.select(root.alias("node"), "conv_id")))

    first = whole if levels else whole.join(turns.select("conv_id", "bytes"), "conv_id")
    bytes_ = F.lit(0).cast("long") if levels else F.col("bytes")
    one = F.lit(1).cast("long")
    full = F.when(F.col("n") == 2**levels, _name(root, "name"))
    edges = first.select(
        root.alias("root"), F.col("name").alias("block"), F.lit(0).alias("depth"), "n", full.alias("end"), bytes_.alias("bytes"), one.alias("n_convs"), "conv_id"
    )
    edges = cut(_merged(edges))
    for level in range(levels, 0, -1):
        half = 2 ** (level - 1)
        split = edges.drop("bytes").join(halves[level - 1], "block")
        split = split.withColumn("middle", F.when(F.col("n_left") == half, _name("root", "name_left")))
        totals = ["n_convs", "conv_id"]
        upper = split.select(
            "root", F.col("name_left").alias("block"), "depth", F.col("n_left").alias("n"), F.col("middle").alias("end"), F.col("bytes_left").alias("bytes"), *totals
        )
        lower = split.where("name_right IS NOT NULL").select(
            F.col("middle").alias("root"),
            F.col("name_right").alias("block"),
            (F.col("depth") + half).alias("depth"),
            F.col("n_right").alias("n"),
            "end",
            F.col("bytes_right").alias("bytes"),
            *totals,
        )
        edges = cut(_merged(upper.unionByName(lower)))

    saved = ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")
    nodes = edges.select(F.col("end").alias("node"), F.col("root").alias("parent"), (F.col("depth") + 1).alias("depth"), "n_convs", "conv_id", saved)
    all_convs = conversations.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    top = all_convs.select(root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("depth"), "n_convs", "conv_id", F.lit(0).cast("long").alias("saved_tokens"))
    nodes = cut(nodes.unionByName(top))
    return _totals(nodes, deepest), ends


def _totals(nodes: DataFrame, deepest: int) -> DataFrame:
    """Children, leaves and saved tokens of subtrees, and the parent's ``conv_id``."""
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    state = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    state = cut(
        state.select(
            "node", "depth", "conv_id", "n_convs", "n_children", "saved_tokens", (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.col("parent").alias("above")
        )
    )
    parents = state.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    fixed = state.select("node", "above").join(parents, "above").select("node", "parent_conv_id")
    out = cut(state.join(fixed, "node", "left"))
    height = 1
    while height <= deepest:  # ``above`` is the node ``height`` above
        sums = ("saved_tokens", "n_leaves")
        grafts = out.where("above IS NOT NULL").groupBy(F.col("above").alias("node")).agg(*[F.sum(c).alias(f"graft_{c}") for c in sums])
        grown = out.join(grafts, "node", "left").withColumns({c: F.col(c) + F.coalesce(F.col(f"graft_{c}"), F.lit(0)) for c in sums})
        # From twice as deep on there is a node twice as high; the others need not be joined.
        higher = out.select(F.col("node").alias("above"), F.col("above").alias("twice"))
        far = out.where(F.col("depth") >= 2 * height).select("node", "above").join(higher, "above").select("node", "twice")
        out = cut(grown.drop("above", *[f"graft_{c}" for c in sums]).join(far.withColumnRenamed("twice", "above"), "node", "left"))
        height *= 2
    return out.select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks; rows are sorted by node and chunk, and pass one at a time."""
    node, state = None, None
    for batch in batches:
        made = []
        for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if key != node:
                if state:
                    made.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(_DIGESTS.types)], schema=_DIGESTS)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], schema=_DIGESTS)


def end_digests(ends: DataFrame) -> DataFrame:
    """``(node, ends_sha256)``: SHA-256 of the ids that end at a node, ascending, joined by commas.

    The ids are ranked over ranges and joined to chunks of at most ``CHUNK`` on all cores; the digest itself, which is sequential by
    its nature, streams over the chunks of a node.
    """
    ranked = running_total(ends.withColumn("one", F.lit(1).cast("long")), [F.col("node"), F.col("conv_id")], {"row": "one"})
    chunks = ranked.groupBy("node", F.floor(F.col("row") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    chunks = chunks.select("node", "chunk", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    ordered = chunks.repartition("node").sortWithinPartitions("node", "chunk")
    return ordered.mapInArrow(_digest, "node binary, ends_sha256 string")
