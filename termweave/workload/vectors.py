"""Queries over the given vectors."""

from pyspark.sql import functions as F

from termweave.functions import vectors as vx
from termweave.operators import similarity as sim
from termweave.operators.documents import collect_chunk_vectors
from termweave.operators.suppress import suppress_similar_tags
from termweave.operators.terms import tags_in_scores
from termweave.plans import jobs
from termweave.runtime import keep
from termweave.workload.registry import (
    CHUNK_T,
    SQL_SUPPRESS,
    SQL_VECTORS,
    TAG_T,
    query,
    table,
    vector_chunks,
    vector_tags,
)


def rounded(df):
    return df.withColumn("similarity", F.round("similarity", 6))


def scores(spark, sf, **options):
    return sim.score_tags(vector_chunks(spark, sf), vector_tags(spark, sf), CHUNK_T, **options)


SQL_PAIRS = f"WITH {SQL_VECTORS} SELECT doi, chunk_idx, tag, round(sim, 6) AS similarity FROM pairs"


@query("similarity_pairs", SQL_PAIRS)
def similarity_pairs(spark, sf):
    return rounded(sim.similarity_join(vector_chunks(spark, sf), vector_tags(spark, sf), CHUNK_T))


@query("similarity_pairs_large_tags", SQL_PAIRS)
def similarity_pairs_large_tags(spark, sf):
    """The way taken when the tag table is too large to broadcast."""
    options = {"broadcast_bytes": 0, "share_bytes": 1 << 18}
    return rounded(sim.similarity_join(vector_chunks(spark, sf), vector_tags(spark, sf), CHUNK_T, **options))


@query("annotate_chunks", f"WITH {SQL_VECTORS} SELECT doi, tag, round(sim, 6) AS similarity FROM pairs")
def annotate_chunks(spark, sf):
    return rounded(jobs.annotate_chunks(vector_chunks(spark, sf), vector_tags(spark, sf), CHUNK_T))


@query("score_tags", f"WITH {SQL_VECTORS} SELECT doi, tag, round(sim, 6) AS similarity FROM scores")
def score_tags(spark, sf):
    return rounded(scores(spark, sf))


@query("tag_edges", f"WITH {SQL_VECTORS} SELECT tag_a, tag_b, round(sim, 6) AS similarity FROM edges")
def tag_edges(spark, sf):
    return rounded(sim.tag_edges(vector_tags(spark, sf), TAG_T))


SQL_KEPT = f"WITH RECURSIVE {SQL_VECTORS},{SQL_SUPPRESS} SELECT doi, tag, round(sim, 6) AS similarity FROM kept"


@query("annotate", SQL_KEPT)
def annotate(spark, sf):
    return rounded(jobs.annotate(vector_chunks(spark, sf), vector_tags(spark, sf), CHUNK_T, TAG_T))


@query("suppress_similar_tags", SQL_KEPT)
def suppress(spark, sf):
    """Every document settled by slices, the way taken for documents with very many tag pairs."""
    edges = sim.tag_edges(vector_tags(spark, sf), TAG_T)
    return rounded(suppress_similar_tags(keep(scores(spark, sf)), edges, stream_limit=0))


@query(
    "best_similarity",
    f"""WITH {SQL_VECTORS}
    SELECT doi, round(max(-list_sum(list_transform(list_zip(c.v, t.v), lambda p: abs(p[1] - p[2])))), 6)
      AS best_similarity
    FROM chunks c CROSS JOIN tags t GROUP BY doi""",
)
def best_similarity(spark, sf):
    best = sim.best_similarity(vector_chunks(spark, sf), vector_tags(spark, sf))
    return best.withColumn("best_similarity", F.round("best_similarity", 6))


@query(
    "best_cosine",
    f"""WITH {SQL_VECTORS}
    SELECT doi, round(max(list_cosine_similarity(c.v, t.v)), 6) AS best_similarity
    FROM chunks c CROSS JOIN tags t GROUP BY doi""",
)
def best_cosine(spark, sf):
    best = sim.best_similarity(vector_chunks(spark, sf), vector_tags(spark, sf), "cosine")
    return best.withColumn("best_similarity", F.round("best_similarity", 6))


@query(
    "vector_functions",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
    SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine,
           round(-list_sum(list_transform(list_zip(a.e, b.e), lambda p: abs(p[1] - p[2]))), 6) AS manhattan,
           round(sqrt(list_dot_product(a.e, a.e)), 6) AS norm,
           round(a.e[1] / sqrt(list_dot_product(a.e, a.e)), 6) AS unit_first
    FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
)
def vector_functions(spark, sf):
    """Every vector against the next one."""
    v = table(spark, sf, "embeddings")
    a = v.select("vec_id", F.col("embedding").alias("a"))
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    x, y = F.col("a"), F.col("b")
    return a.join(b, "vec_id").select(
        "vec_id",
        F.round(vx.cosine(x, y), 6).alias("cosine"),
        F.round(vx.neg_manhattan(x, y), 6).alias("manhattan"),
        F.round(vx.l2_norm(x), 6).alias("norm"),
        F.round(F.get(vx.unit(x), F.lit(0)), 6).alias("unit_first"),
    )


@query(
    "chunk_vector_slices",
    """SELECT '10.5555/' || (vec_id // 10) AS doi, ((vec_id % 10) // 4)::INTEGER AS slice, count(*)::INTEGER AS n,
       round(arg_min(embedding[1], vec_id)::DOUBLE, 6) AS first_value,
       round(arg_max(embedding[64], vec_id)::DOUBLE, 6) AS last_value
    FROM embeddings GROUP BY ALL""",
)
def chunk_vector_slices(spark, sf):
    e = F.col("embeddings")
    return collect_chunk_vectors(vector_chunks(spark, sf), 4).select(
        "doi",
        "slice",
        F.size(e).alias("n"),
        F.round(F.get(F.get(e, F.lit(0)), F.lit(0)).cast("double"), 6).alias("first_value"),
        F.round(F.element_at(F.element_at(e, -1), -1).cast("double"), 6).alias("last_value"),
    )


@query(
    "tags_in_scores",
    f"WITH {SQL_VECTORS} SELECT tag, ontology, label FROM tags WHERE tag IN (SELECT tag FROM scores)",
)
def used_tags(spark, sf):
    return tags_in_scores(vector_tags(spark, sf).drop("embedding", "group"), scores(spark, sf))
