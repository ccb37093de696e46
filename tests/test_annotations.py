from pyspark.sql import functions as F

from termweave import runtime
from termweave.operators import annotations, evaluate, graph, reports

SCORES = [("d1", "a", 0.5), ("d1", "b", 0.6), ("d2", "c", 0.7), (None, "a", 0.4), ("d3", None, 0.3)]


def tables(spark):
    scores = spark.createDataFrame(SCORES, "doi string, tag string, similarity double")
    up = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("z", "y"), (None, "n")], "term string, ancestor string")
    docs = spark.createDataFrame([("d1", "1"), ("d1", "1"), ("d2", "2"), (None, "0")], "doi string, pmid string")
    return scores, up, docs


def test_ancestors_read_scores_once(spark):
    scores, up, _ = tables(spark)
    got = annotations.with_ancestors(scores, up)
    rows = sorted((r.doi or "", r.tag or "") for r in got.collect())
    expected = [(d, t) for d, t, _ in SCORES] + [(d, a) for d, t, _ in SCORES for x, a in [("a", "x"), ("a", "y"), ("b", "x"), ("b", "x")] if t == x]
    assert rows == sorted((d or "", t or "") for d, t in expected)
    assert len([p for p in got._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("|").split("|") if "similarity" in p]) <= 1


def test_small_sides_are_broadcast(spark, monkeypatch):
    """Scores are not shuffled for a join with a table that is measured small."""
    scores, up, docs = tables(spark)
    meta = spark.createDataFrame([("a", "o", "A"), ("b", "o", "B")], "tag string, ontology string, label string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for marked in (True, False):
            joined = [annotations.annotation_rows(docs, scores, up), annotations.annotation_rows(docs, scores), reports.ontology_counts(scores, meta)]
            plans = [df._jdf.queryExecution().executedPlan().toString() for df in joined]
            assert all(("BroadcastHashJoin" in p) == marked and ("SortMergeJoin" in p) != marked for p in plans)
            assert sorted(df.count() for df in joined) == [1, 5, 13]
            monkeypatch.setattr(runtime, "SMALL", 0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_iris_with_and_without_rare_characters(spark):
    rows = spark.createDataFrame([("http://e.org/a",), ("http://e.org/a b\t<c>\\d`",), ("_:b1",), (None,)], "v string")
    got = [r.o for r in rows.select(graph._node(F.col("v")).alias("o")).collect()]
    assert got == ["<http://e.org/a>", "<http://e.org/a\\u0020b\\u0009\\u003Cc\\u003E\\u005Cd\\u0060>", "_:b1", None]


def test_evaluation_shuffles_scores_once(spark):
    """Scores below all thresholds are not shuffled; equal names of different tags count once, with the best score."""
    scores = spark.createDataFrame([("d", "x/a", 0.4), ("d", "y/a", 0.9), ("d", "x/b", 0.2), ("e", "x/c", 0.1)], "doi string, tag string, similarity double")
    truth = spark.createDataFrame([("d", ["a", "b"]), ("e", ["c"]), ("f", None)], "doi string, descriptor array<string>")
    swept = evaluate.evaluate_sweep(scores, truth, [0.3, 0.95])
    plan = swept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and ">= 0.3" in plan
    got = {r.threshold: (round(r.precision, 6), round(r.recall, 6)) for r in swept.collect()}
    assert got == {0.3: (round(1 / 3, 6), round(0.5 / 3, 6)), 0.95: (0.0, 0.0)}
    links = spark.createDataFrame([("a", "concept", "D"), ("b", "concept", "E")], "concept string, prop string, descriptor string")
    real = spark.createDataFrame([("d", ["D"])], "doi string, descriptor array<string>")
    linked = evaluate.evaluate_linked_sweep(scores, real, links, [0.1, 0.3]).collect()
    assert {r.threshold: (r.precision, r.recall) for r in linked} == {0.1: (0.5, 1.0), 0.3: (1.0, 1.0)}
