"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Documents of a source are shuffled by a keyed hash; each gets the virtual finish time ``tokens of its source so far / target of its
source``. Sorting all sources by finish time interleaves them at their weights, and the mix ends where the total budget is
reached. A source whose target exceeds its size runs again from its start, up to ``MAX_REPEATS`` times.

Targets share the budget by weight; no source goes over ``MAX_REPEATS`` times its size. With ``cap_i / weight_i`` in ascending order the
capped sources are a prefix, so running sums give the level at which all targets add up to the budget.

Running sums go over ranges of the global order (``running_total``), so a source with a third of all rows, or millions of sources,
need no task of their own.

Defined results: null texts have size 0, and documents of size 0 are never taken; the null source comes last; sources without words have
target 0; ties are settled by id and a hash of the text, so reruns agree; a repeated row is a document of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import running_total, small, word_count
from termweave.runtime import cut

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)


def cyclic_weights(rank: Column) -> Column:
    """Weights 1, 2, 3 in turn along the order of the sources; ``rank`` starts at 1."""
    return F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))


def source_targets(sized: DataFrame, weight=cyclic_weights, share: float = 1.0) -> DataFrame:
    """``(source, source_size, weight, target)`` from rows ``(source, size)``; the targets add up to ``share`` of all sizes.

    ``weight`` makes a weight of a source's place in code point order.
    """
    by_source = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    total = by_source.agg(F.sum("source_size")).first()[0] or 0
    budget = share * total
    ranked = running_total(by_source.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], {"rank": "one"})
    ranked = ranked.withColumn("weight", weight(F.col("rank")).cast("double")).drop("one")
    caps = ranked.withColumns({"cap": F.lit(float(MAX_REPEATS)) * F.col("source_size")})
    caps = caps.withColumn("level", F.col("cap") / F.col("weight"))
    summed = cut(running_total(caps, [F.col("level"), F.col("rank")], {"caps": "cap", "weights": "weight"}))
    all_weights = summed.agg(F.max("weights")).first()[0] or 0.0
    # The first source whose own level is above the level of a full sharing with those before it capped ends the prefix.
    free = F.lit(all_weights) - (F.col("weights") - F.col("weight"))
    level = (F.lit(float(budget)) - (F.col("caps") - F.col("cap"))) / free
    water = summed.where(F.col("level") > level).agg(F.min_by(level, F.struct("level", "rank"))).first()[0]
    target = F.col("cap") if water is None else F.least(F.col("cap"), F.col("weight") * F.lit(water))
    return summed.select("source", "source_size", "weight", target.alias("target"))


def queue(docs: DataFrame, seed: int = 0, weight=cyclic_weights, share: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Stored slim rows of all documents with the target of their source, and the mix.

    The first has ``row, doc_id, source, size, source_size, target``; the second ``row, repeat, finish, total``, one per document
    taken, ``total`` being the tokens of the mix up to and with it.
    """
    text = F.col("text").cast("string")
    size = word_count(text)
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")))
    # Words are counted once; ranges are sampled from the slim copy.
    slim = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            size.alias("size"),
            key.alias("key"),
            *_text_hashes(),
        )
    )
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size"), F.col("t1"), F.col("t2")]
    placed = cut(running_total(slim.withColumn("one", F.lit(1).cast("long")), order, {"upto": "size", "row": "one"}))
    targets = source_targets(placed, weight, share)
    starts = placed.groupBy("source").agg(F.min(F.col("upto") - F.col("size")).alias("start"))
    targets = targets.alias("t").join(starts.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")))
    targets = cut(targets.select(F.col("t.source").alias("__source"), "source_size", "target", "start"))
    rows = placed.join(targets, F.col("source").eqNullSafe(F.col("__source")))
    rows = cut(rows.select("row", "doc_id", "source", "size", "t1", "t2", "source_size", "target", (F.col("upto") - F.col("start")).alias("upto")))

    budget = share * (targets.agg(F.sum("source_size")).first()[0] or 0)
    runs = F.least(F.ceil(F.col("target") / F.col("source_size")), F.lit(MAX_REPEATS)).cast("int")
    copies = rows.where("size > 0 AND target > 0").select(
        "row", "size", "upto", "source_size", "target", F.explode(F.sequence(F.lit(0), runs - 1)).alias("repeat")
    )
    finish = (F.col("repeat") * F.col("source_size") + F.col("upto")) / F.col("target")
    copies = copies.select("row", "repeat", "size", finish.alias("finish"))
    # Whoever finishes after 1 is behind its whole target; nothing of it can be within the budget but one document per source.
    mixed = running_total(copies, [F.col("finish"), F.col("row"), F.col("repeat")], {"total": "size"})
    return rows, mixed.where(F.col("total") <= F.lit(float(budget))).select("row", "repeat", "finish", "total")


def taken(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every row; ``taken`` counts words with repeats."""
    rows, mix = queue(docs, seed)
    times = mix.groupBy("row").agg(F.count("*").alias("times"))
    return rows.join(times, "row", "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).alias("taken")
    )


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents of the mix with all their columns, a repeated one once per repeat.

    Rows alike in id, source and text stand for each other: as many rows as the mix takes of them, copies of one of them.
    """
    rows, chosen = queue(docs, seed)
    alike = ["doc_id", "__source", "t1", "t2"]
    times = rows.join(chosen.groupBy("row").agg(F.count("*").alias("times")), "row", "left")
    per = times.withColumn("__source", _source_key("source")).groupBy(*alike)
    per = per.agg(F.count("*").alias("__rows"), F.sum(F.coalesce("times", F.lit(0))).cast("int").alias("__times"))
    per = cut(per.where("__times > 0").toDF("__doc_id", "__source", "__t1", "__t2", "__rows", "__times"))

    columns = docs.columns
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id"))
        & (_source_key("source") == F.col("__source"))
        & (_text_hashes()[0] == F.col("__t1"))
        & (_text_hashes()[1] == F.col("__t2"))
    )
    found = docs.join(small(per), same)  # rows of six numbers
    several = found.where("__rows > 1")
    several = several.groupBy("__doc_id", "__source", "__t1", "__t2", "__times").agg(F.first(F.struct(*columns)).alias("row"))
    once = found.where("__rows = 1").select(*columns, "__times").union(several.select("row.*", "__times"))
    return once.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(*columns)


def _text_hashes() -> list[Column]:
    """128 bits of the text."""
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _source_key(source: str) -> Column:
    return F.xxhash64(F.col(source).cast("string"), F.col(source).isNull())
