"""Precision, recall and F1 against curated descriptors, macro-averaged over all abstracts.

Everything stays in long form (one row per document and term): two aggregations with map-side combine, and all
thresholds of a sweep in the same pass. No per-document set is collected.
``truth`` holds one row per doi: ``doi, descriptor array<string>``; a null array counts as 0 but stays in the average.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import text as tx
from termweave.runtime import small

# Thresholds of the standard sweep.
THRESHOLDS = (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.99)


def predictions(scores: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """``doi, term, similarity`` by local name; scores below all thresholds count nowhere, of equal names the counters take the best."""
    named = scores.select("doi", tx.local_name(F.col("tag")).alias("term"), "similarity")
    return named.where(F.col("similarity") >= F.lit(min(thresholds))) if thresholds else named


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _counters(predicted: DataFrame, truth: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Per doi ``tp0, predicted0, tp1, ...`` from ``doi, kind, term, similarity`` (kind ``u`` can never be true)."""
    true_rows = truth.select("doi", F.explode("descriptor").alias("term")).select(
        "doi", F.lit("d").alias("kind"), "term", F.lit(None).cast("double").alias("similarity"), F.lit(1).alias("true")
    )
    facts = predicted.withColumn("true", F.lit(0)).unionByName(true_rows)
    merged = facts.groupBy("doi", "kind", "term").agg(
        F.max("similarity").alias("similarity"), F.max("true").alias("true")
    )
    counters = [F.sum("true").alias("actual")]
    for i, t in enumerate(thresholds):
        hit = F.when(F.col("similarity") >= F.lit(t), 1).otherwise(0)
        counters += [F.sum(hit * F.col("true")).alias(f"tp{i}"), F.sum(hit).alias(f"predicted{i}")]
    return merged.groupBy("doi").agg(*counters)


def _sweep(predicted: DataFrame, truth: DataFrame, thresholds: Sequence[float], actual: Column | None) -> DataFrame:
    """Average the metrics; ``actual`` overrides the number of distinct true terms."""
    counted = truth.select("doi", "descriptor").join(_counters(predicted, truth, thresholds), "doi", "left")
    judged = F.col("descriptor").isNotNull()
    n_true = F.coalesce(F.col("actual") if actual is None else actual, F.lit(0))
    averages = []
    for i, _ in enumerate(thresholds):
        tp, n_pred = F.coalesce(f"tp{i}", F.lit(0)), F.coalesce(f"predicted{i}", F.lit(0))
        precision, recall = _ratio(tp, n_pred), _ratio(tp, n_true)
        f1 = F.when(tp > 0, 2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))).otherwise(F.lit(0.0))
        nothing = (n_pred == 0) & (n_true == 0)
        for name, value in (("precision", precision), ("recall", recall), ("f1", f1)):
            credit = F.when(~judged, F.lit(0.0)).when(nothing, F.lit(1.0)).otherwise(value)
            averages.append(F.coalesce(F.avg(credit), F.lit(0.0)).alias(f"{name}{i}"))
    rows = [
        F.struct(
            F.lit(float(t)).alias("threshold"), *[F.col(f"{n}{i}").alias(n) for n in ("precision", "recall", "f1")]
        )
        for i, t in enumerate(thresholds)
    ]
    return counted.agg(*averages).select(F.inline(F.array(*rows)))


def evaluate_sweep(scores: DataFrame, truth: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """``threshold, precision, recall, f1``: predicted local names against descriptors."""
    predicted = predictions(scores, thresholds).select("doi", F.lit("d").alias("kind"), "term", "similarity")
    return _sweep(predicted, truth, thresholds, None)


def evaluate(scores: DataFrame, truth: DataFrame, threshold: float = 0.0) -> DataFrame:
    return evaluate_sweep(scores, truth, [threshold])


def resolve_links(links: DataFrame) -> DataFrame:
    """``concept, descriptor``: preferred links, and plain links for the concepts without a preferred one."""
    preferred = links.where("prop = 'preferredConcept'").select("concept", "descriptor").distinct()
    plain = links.where("prop = 'concept'").select("concept", "descriptor").distinct()
    return preferred.unionByName(plain.join(preferred, "concept", "left_anti"))


def grouped_links(links: DataFrame) -> DataFrame:
    """``concept, prop, descriptors`` with the sorted descriptors of each concept and property."""
    return links.groupBy("concept", "prop").agg(F.sort_array(F.collect_list("descriptor")).alias("descriptors"))


def evaluate_linked_sweep(
    scores: DataFrame, truth: DataFrame, links: DataFrame, thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """As ``evaluate_sweep`` with predicted concepts mapped to descriptors.

    A concept without any link is one false positive; false negatives are counted over the descriptor list.
    """
    named = predictions(scores, thresholds).withColumnRenamed("term", "concept")
    mapped = named.join(small(resolve_links(links)), "concept", "left")
    predicted = mapped.select(
        "doi",
        F.when(F.col("descriptor").isNull(), "u").otherwise("d").alias("kind"),
        F.coalesce("descriptor", "concept").alias("term"),
        "similarity",
    )
    return _sweep(predicted, truth, thresholds, F.size("descriptor"))


def evaluate_linked(scores: DataFrame, truth: DataFrame, links: DataFrame, threshold: float = 0.0) -> DataFrame:
    return evaluate_linked_sweep(scores, truth, links, [threshold])
