"""Queries over whole texts: chunking, encoding, annotation, incremental and streamed annotation."""

from pyspark.sql import functions as F

from termweave.functions import text as tx
from termweave.functions.encode import encode
from termweave.operators import documents, terms
from termweave.plans import jobs
from termweave.runtime import spread
from termweave.sinks import write_abstracts
from termweave.streaming import annotate_stream
from termweave.spec import AnnotationSpec, TaxonSpec
from termweave.workload.registry import (
    ENCODER,
    SQL_ABSTRACTS,
    SQL_CHUNKS,
    SQL_SUPPRESS,
    SQL_TEXT_ANNOTATED,
    SQL_TEXT_SCORES,
    TEXT_T,
    WS,
    document_abstracts,
    passage_tags,
    passage_terms,
    query,
    scratch,
    sql_encode,
    table,
    text_of,
)
from termweave.workload.vectors import rounded


@query("chunk_documents", f"WITH {SQL_CHUNKS} SELECT doi, chunk_idx, text FROM chunks")
def chunk_documents(spark, sf):
    return documents.chunk_documents(document_abstracts(spark, sf))


@query(
    "valid_abstracts",
    f"""WITH {SQL_ABSTRACTS} SELECT doc_id, length(title) AS title_chars FROM abstracts
    WHERE regexp_matches(title, '[^{WS}]') AND regexp_matches(abstract, '[^{WS}]')""",
)
def valid_abstracts(spark, sf):
    return documents.valid_abstracts(document_abstracts(spark, sf)).select(
        "doc_id", F.length("title").cast("long").alias("title_chars")
    )


@query(
    "dedupe_documents",
    "SELECT min(doc_id) AS doc_id, md5(text) AS doi, arg_min(source, doc_id) AS source FROM documents GROUP BY md5(text)",
)
def dedupe_documents(spark, sf):
    """First of the documents with equal text."""
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("doi"), "source")
    return documents.dedupe_documents(docs, F.col("doc_id"))


@query(
    "encode_documents",
    f"WITH {sql_encode('dv', 'documents', 'doc_id')} SELECT doc_id, bucket::INTEGER AS bucket, round(w, 6) AS weight FROM dv",
)
def encode_documents(spark, sf):
    """Vectors of whole documents, their non-zero places in long form.

    The outer form of explode: the plain one adds a filter on the array, which would run the encoder twice.
    """
    vectors = encode(spread(table(spark, sf, "documents").select("doc_id", "text")), ENCODER, "text")
    places = vectors.select("doc_id", F.posexplode_outer("embedding").alias("bucket", "w")).where("w <> 0")
    return places.select("doc_id", "bucket", F.round(F.col("w").cast("double"), 6).alias("weight"))


@query(
    "encode_conversations",
    f"""WITH turns AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
    {sql_encode('cv', 'turns', 'conv_id')} SELECT conv_id, bucket::INTEGER AS bucket, round(w, 6) AS weight FROM cv""",
)
def encode_conversations(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id")
    joined = turns.agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    whole = joined.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))
    places = encode(whole, ENCODER, "text").select("conv_id", F.posexplode_outer("embedding").alias("bucket", "w"))
    return places.where("w <> 0").select("conv_id", "bucket", F.round(F.col("w").cast("double"), 6).alias("weight"))


@query(
    "encode_tags",
    f"""WITH terms AS (
      SELECT item_id, CASE WHEN regexp_matches(text, '[^{WS}]') THEN split_part(text, chr(10), 1) || ' - ' || text
             ELSE split_part(text, chr(10), 1) END AS text FROM benchmark), {sql_encode('tv', 'terms', 'item_id')}
    SELECT 'http://example.org/benchmark/B_' || item_id AS tag, bucket::INTEGER AS bucket, round(w, 6) AS weight FROM tv""",
)
def encode_tags(spark, sf):
    places = passage_tags(spark, sf).select("tag", F.posexplode_outer("embedding").alias("bucket", "w")).where("w <> 0")
    return places.select("tag", "bucket", F.round(F.col("w").cast("double"), 6).alias("weight"))


@query(
    "tag_text",
    f"""SELECT item_id::VARCHAR AS item, CASE WHEN regexp_matches(text, '[^{WS}]')
      THEN split_part(text, chr(10), 1) || ' - ' || text ELSE split_part(text, chr(10), 1) END AS text FROM benchmark
    UNION ALL SELECT 'P' || p_partkey, CASE WHEN p_size > 25 THEN p_name || ' - ' || p_type ELSE p_name END FROM part""",
)
def tag_text(spark, sf):
    items = passage_terms(spark, sf).select(tx.local_name(F.col("term")).alias("item"), "rdfs_label", "description")
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("P"), text_of("p_partkey")).alias("item"),
        F.col("p_name").alias("rdfs_label"),
        F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.lit(" \t")).alias("description"),
    )
    both = terms.encoding_text(items.withColumn("item", F.substring_index("item", "_", -1)).unionByName(parts))
    return both.select("item", "text")


def text_chunks(spark, sf, rows=None):
    docs = document_abstracts(spark, sf) if rows is None else rows
    return encode(documents.chunk_documents(docs), ENCODER, "text")


@query(
    "score_documents",
    f"WITH {SQL_TEXT_SCORES} SELECT doi, tag, round(sim, 6) AS similarity FROM all_scores",
)
def score_documents(spark, sf):
    from termweave.operators.similarity import score_tags

    return rounded(score_tags(text_chunks(spark, sf), passage_tags(spark, sf), TEXT_T))


SQL_ANNOTATED = f"WITH RECURSIVE {SQL_TEXT_ANNOTATED} SELECT doi, tag, round(sim, 6) AS similarity FROM kept"


@query("annotate_documents", SQL_ANNOTATED)
def annotate_documents(spark, sf):
    """From text: chunk, encode, score against the passages, drop near-duplicates."""
    return rounded(jobs.annotate(text_chunks(spark, sf), passage_tags(spark, sf), TEXT_T, TEXT_T))


@query("workflow", SQL_ANNOTATED)
def workflow(spark, sf):
    """The whole workflow from files, the passages as a taxonomy. A first run has other thresholds, and other texts for some documents."""
    folder = scratch(spark)
    passages = passage_terms(spark, sf).select(F.substring_index("term", "_", -1).alias("id"), "rdfs_label", "description")
    one_line = [F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\n\r]", " ") for c in ("rdfs_label", "description")]
    passages.select(F.concat_ws("\t", "id", one_line[0]).alias("value")).write.text(f"{folder}/taxon.tsv")
    passages.select(F.concat_ws("\t", "id", one_line[1]).alias("value")).write.text(f"{folder}/vernacular_name.tsv")
    docs = document_abstracts(spark, sf).select("doc_id", "doi", "title", "abstract")
    early = F.when(F.col("doc_id") % 7 == 0, F.reverse("abstract")).otherwise(F.col("abstract"))
    files = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 20_000}  # one task reads such a file
    docs.withColumn("abstract", early).drop("doc_id").write.options(**files).json(f"{folder}/early")
    docs.drop("doc_id").write.options(**files).json(f"{folder}/docs")
    spec = AnnotationSpec("hashing-64", 0.6, 0.6, gbif=TaxonSpec(folder), abstract_files=[f"{folder}/early"], compression="gzip")
    jobs.run_workflow(spark, spec, f"{folder}/out")
    spec.threshold_chunk = spec.threshold_tag = TEXT_T
    spec.abstract_files = [f"{folder}/docs"]
    found = jobs.run_workflow(spark, spec, f"{folder}/out")
    tag = F.concat(F.lit("http://example.org/benchmark/B_"), F.substring_index("tag", "/", -1))
    return rounded(found.withColumn("tag", tag))


@query(
    "annotate_incremental",
    f"""WITH RECURSIVE {SQL_TEXT_SCORES},
    scores AS (SELECT doi, tag, sim FROM all_scores WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
    {SQL_SUPPRESS.strip()} SELECT doi, tag, round(sim, 6) AS similarity FROM kept""",
)
def annotate_incremental(spark, sf):
    """The labelled documents count as done; all others are annotated."""
    done = table(spark, sf, "labels").select(F.concat(F.lit("10.5555/"), text_of("doc_id")).alias("doi"))
    fresh = jobs.annotate_incremental(text_chunks(spark, sf), passage_tags(spark, sf), done, TEXT_T, TEXT_T)
    return rounded(fresh)


@query("annotate_stream", SQL_ANNOTATED)
def stream_documents(spark, sf):
    """The documents land as files, the stream annotates them and writes its scores."""
    folder = scratch(spark)
    landed = document_abstracts(spark, sf).drop("doc_id")
    landed.repartition(3, "doi").write.option("maxRecordsPerFile", 100_000).json(f"{folder}/landed")
    tags = passage_tags(spark, sf)
    stream = annotate_stream(
        spark, f"{folder}/landed", tags, ENCODER, f"{folder}/out", f"{folder}/checkpoint", TEXT_T, TEXT_T
    )
    stream.awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/out/scores").drop("batch"))


@query(
    "abstract_files",
    f"""WITH {SQL_ABSTRACTS} SELECT doi, doc_id::VARCHAR AS pmid, length(abstract) AS chars, md5(abstract) AS digest
    FROM abstracts""",
)
def abstract_files(spark, sf):
    """Documents to JSON files of a hundred abstracts and back."""
    from termweave.sources.abstracts import read_abstracts

    folder = scratch(spark)
    write_abstracts(document_abstracts(spark, sf).drop("doc_id"), folder, 100)
    read = read_abstracts(spark, directories=folder)
    return read.select(
        "doi", "pmid", F.length("abstract").cast("long").alias("chars"), F.md5("abstract").alias("digest")
    )


@query(
    "search_hits",
    """SELECT CASE WHEN lang = 'en' THEN '' ELSE split_part(text, chr(10), 1) END AS title, length(text) AS chars,
    CASE WHEN quality IS NOT NULL THEN '10.5555/' || doc_id END AS doi,
    CASE WHEN toxic = 1 THEN 'toxic,' || source ELSE '' END AS keywords
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def search_hits(spark, sf):
    """Labelled documents have a doi list, toxic ones keywords; English ones lack the title."""
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    doi = F.concat(F.lit("10.5555/"), text_of("doc_id"))
    words = F.struct(F.array(F.lit("toxic"), "source").alias("teeft"))
    hits = joined.select(
        F.when(F.col("lang") != "en", F.substring_index("text", "\n", 1)).alias("title"),
        F.col("text").alias("abstract"),
        F.when(F.col("quality").isNotNull(), F.array(doi, F.lit("other")))
        .otherwise(F.array().cast("array<string>"))
        .alias("doi"),
        F.when(F.col("toxic") == 1, words).alias("keywords"),
    )
    return documents.hits_to_abstracts(hits).select(
        "title",
        F.length("abstract").cast("long").alias("chars"),
        "doi",
        F.array_join("keywords", ",").alias("keywords"),
    )
