"""Registration and the inputs shared by the queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions.encode import HashingEncoder
from termweave.plans.jobs import embed_tags
from termweave.runtime import cut, ensure_checkpoint_dir, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CHUNK_T = TAG_T = 0.3  # the test vectors are nearly random: few pairs reach more
TEXT_T = 0.53
ENCODER = HashingEncoder(64)


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder all executors can reach, for queries that go through files."""
    return f"{ensure_checkpoint_dir(spark)}/termweave-{uuid.uuid4().hex}"


def text_of(col: str) -> Column:
    return F.col(col).cast("string")


def vector_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as a tag. Its places are rotated by one, so that no chunk meets its own copy."""
    key, label = text_of("vec_id"), text_of("label")
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("http://example.org/onto"), label, F.lit("/T_"), key).alias("tag"),
        F.concat(F.lit("onto"), label).alias("ontology"),
        F.concat(F.lit("term "), key).alias("label"),
        F.lit("vectors").alias("group"),
        F.expr("concat(slice(embedding, 2, size(embedding) - 1), slice(embedding, 1, 1))").alias("embedding"),
    )


def vector_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as a chunk, ten in a row to a document."""
    return spread(table(spark, sf, "embeddings")).select(
        F.concat(F.lit("10.5555/"), F.expr("vec_id div 10")).alias("doi"),
        F.expr("cast(vec_id % 10 as int)").alias("chunk_idx"),
        "embedding",
    )


def document_abstracts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as abstracts: the first line is the title, the whole text the abstract."""
    return spread(table(spark, sf, "documents")).select(
        "doc_id",
        F.concat(F.lit("10.5555/"), text_of("doc_id")).alias("doi"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
        text_of("doc_id").alias("pmid"),
        F.lit(None).cast("string").alias("reference_id"),
    )


def passage_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as terms: first line as label, whole passage as description."""
    return table(spark, sf, "benchmark").select(
        F.lit("benchmark").alias("ontology"),
        F.concat(F.lit("http://example.org/benchmark/B_"), text_of("item_id")).alias("term"),
        F.substring_index("text", "\n", 1).alias("rdfs_label"),
        F.col("text").alias("description"),
        F.lit("passages").alias("group"),
    )


def passage_tags(spark: SparkSession, sf: str) -> DataFrame:
    """The passages with their vectors, stored: annotation reads them several times."""
    return cut(embed_tags(passage_terms(spark, sf), ENCODER))


# SQL of the same inputs.
WS = r"\t-\r\x1c-\x20\x85\p{Z}"

SQL_VECTORS = f"""
chunks AS (
  SELECT '10.5555/' || (vec_id // 10) AS doi, (vec_id % 10)::INTEGER AS chunk_idx, embedding::DOUBLE[] AS v
  FROM embeddings),
tags AS (
  SELECT 'http://example.org/onto' || label || '/T_' || vec_id AS tag, 'onto' || label AS ontology,
         'term ' || vec_id AS label, list_concat(embedding[2:], embedding[1:1])::DOUBLE[] AS v
  FROM embeddings),
pairs AS (
  SELECT doi, chunk_idx, tag, sim
  FROM (SELECT doi, chunk_idx, tag, list_cosine_similarity(c.v, t.v) AS sim FROM chunks c CROSS JOIN tags t)
  WHERE sim >= {CHUNK_T} AND NOT isnan(sim)),
scores AS (SELECT doi, tag, max(sim) AS sim FROM pairs GROUP BY doi, tag),
edges AS (
  SELECT * FROM (SELECT a.tag AS tag_a, b.tag AS tag_b, list_cosine_similarity(a.v, b.v) AS sim
                 FROM tags a JOIN tags b ON a.tag < b.tag)
  WHERE sim > {TAG_T} AND NOT isnan(sim))"""

SQL_SUPPRESS = """
ranked AS (
  SELECT a.doi, e.tag_a, e.tag_b, CASE WHEN a.sim > b.sim THEN e.tag_b ELSE e.tag_a END AS loser,
         row_number() OVER (PARTITION BY a.doi ORDER BY e.sim DESC, e.tag_a, e.tag_b) AS rk
  FROM scores a JOIN edges e ON e.tag_a = a.tag JOIN scores b ON b.doi = a.doi AND b.tag = e.tag_b),
steps AS (
  SELECT DISTINCT doi, 0::BIGINT AS rk, []::VARCHAR[] AS lost FROM ranked
  UNION ALL
  SELECT s.doi, r.rk, CASE WHEN list_contains(s.lost, r.tag_a) OR list_contains(s.lost, r.tag_b)
                           THEN s.lost ELSE list_append(s.lost, r.loser) END
  FROM steps s JOIN ranked r ON r.doi = s.doi AND r.rk = s.rk + 1),
gone AS (SELECT doi, unnest(arg_max(lost, rk)) AS tag FROM steps GROUP BY doi),
kept AS (SELECT s.* FROM scores s ANTI JOIN gone g ON g.doi = s.doi AND g.tag = s.tag)"""

SQL_ABSTRACTS = """
abstracts AS (
  SELECT doc_id, '10.5555/' || doc_id AS doi, split_part(text, chr(10), 1) AS title, text AS abstract FROM documents)"""

SQL_CHUNKS = rf"""{SQL_ABSTRACTS},
parts AS (
  SELECT doc_id, doi, list_concat([title], string_split(regexp_replace(abstract, '([.!?])[{WS}]+([A-Z])',
         '\1' || chr(1) || '\2', 'g'), chr(1))) AS p
  FROM abstracts WHERE regexp_matches(title, '[^{WS}]') AND regexp_matches(abstract, '[^{WS}]')),
chunks AS (SELECT doc_id, doi, (generate_subscripts(p, 1) - 1)::INTEGER AS chunk_idx, unnest(p) AS text FROM parts)"""


def sql_encode(name: str, source: str, keys: str, text: str = "text") -> str:
    """Sparse vectors ``keys, bucket, w`` of a text column."""
    return rf"""
{name}_tokens AS (
  SELECT {keys}, unnest(list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')) AS tok
  FROM {source}),
{name}_counts AS (
  SELECT {keys}, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS bucket, count(*) AS c
  FROM {name}_tokens GROUP BY ALL),
{name} AS (
  SELECT {keys}, bucket, (c / sqrt(sum(c * c) OVER (PARTITION BY {keys})::DOUBLE))::FLOAT::DOUBLE AS w
  FROM {name}_counts)"""


SQL_TEXT_SCORES = rf"""{SQL_CHUNKS},{sql_encode("cv", "chunks", "doc_id, doi, chunk_idx")},
terms AS (
  SELECT 'http://example.org/benchmark/B_' || item_id AS tag,
         CASE WHEN regexp_matches(text, '[^{WS}]') THEN split_part(text, chr(10), 1) || ' - ' || text
              ELSE split_part(text, chr(10), 1) END AS text FROM benchmark),{sql_encode("tv", "terms", "tag")},
cn AS (SELECT doi, chunk_idx, sqrt(sum(w * w)) AS n FROM cv GROUP BY ALL),
tn AS (SELECT tag, sqrt(sum(w * w)) AS n FROM tv GROUP BY ALL),
pairs AS (
  SELECT d.doc_id, d.doi, d.chunk_idx, d.tag, d.dot / (cn.n * tn.n) AS sim
  FROM (SELECT doc_id, doi, chunk_idx, tag, sum(cv.w * tv.w) AS dot FROM cv JOIN tv USING (bucket) GROUP BY ALL) d
  JOIN cn USING (doi, chunk_idx) JOIN tn USING (tag)),
all_scores AS (SELECT doc_id, doi, tag, max(sim) AS sim FROM pairs WHERE sim >= {TEXT_T} GROUP BY ALL),
edges AS (
  SELECT d.tag_a, d.tag_b, d.dot / (a.n * b.n) AS sim
  FROM (SELECT x.tag AS tag_a, y.tag AS tag_b, sum(x.w * y.w) AS dot
        FROM tv x JOIN tv y ON x.bucket = y.bucket AND x.tag < y.tag GROUP BY ALL) d
  JOIN tn a ON a.tag = d.tag_a JOIN tn b ON b.tag = d.tag_b
  WHERE d.dot / (a.n * b.n) > {TEXT_T})"""

SQL_TEXT_ANNOTATED = f"{SQL_TEXT_SCORES}, scores AS (SELECT doi, tag, sim FROM all_scores), {SQL_SUPPRESS.strip()}"
