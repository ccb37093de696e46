"""Queries over scores: summaries, annotation rows, RDF, evaluation, merging."""

from pyspark.sql import functions as F

from termweave import sinks
from termweave.operators import annotations, evaluate, graph, reports
from termweave.operators.closure import ancestors
from termweave.operators.similarity import score_tags
from termweave.plans import jobs
from termweave.runtime import small
from termweave.sinks import scores_json
from termweave.sources import abstracts
from termweave.sources.stores import parse_scores, read_scores_json
from termweave.spec import AnnotationSpec
from termweave.workload.registry import (
    CHUNK_T,
    SQL_VECTORS,
    TAG_T,
    document_abstracts,
    query,
    scratch,
    table,
    text_of,
    vector_chunks,
    vector_tags,
)
from termweave.workload.vectors import rounded, scores

SQL_DESCRIBED = f"WITH {SQL_VECTORS}, d AS (SELECT * FROM scores JOIN tags USING (tag))"
GZIP = {"compression": "gzip", "per_file": sinks.ROWS_PER_FILE}
SWEEP = [0.3, 0.33, 0.36, 0.4, 0.45]


def meta(spark, sf):
    return vector_tags(spark, sf).select("tag", "ontology", "label")


@query(
    "best_similarities",
    f"""{SQL_DESCRIBED} SELECT 'https://doi.org/' || doi AS doi, ontology, split_part(tag, '/', -1) AS tag, label,
    round(sim, 6) AS similarity FROM d""",
)
def best_similarities(spark, sf):
    return rounded(reports.best_similarities(scores(spark, sf, ranked=True), meta(spark, sf), ranked=True))


def _round_spread(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean_similarity", "std_similarity")})


SQL_SPREAD = "round(avg(sim), 6) AS mean_similarity, round(stddev_pop(sim), 6) AS std_similarity"


@query(
    "summary_tags",
    f"""{SQL_DESCRIBED} SELECT arg_min(ontology, d.tag) AS ontology, split_part(d.tag, '/', -1) AS tag,
    arg_min(label, d.tag) AS label, count(*) AS count, {SQL_SPREAD} FROM d GROUP BY split_part(d.tag, '/', -1)""",
)
def summary_tags(spark, sf):
    return _round_spread(reports.summary_tags(scores(spark, sf), meta(spark, sf)))


@query(
    "summary_ontologies", f"{SQL_DESCRIBED} SELECT ontology, count(*) AS tag_count, {SQL_SPREAD} FROM d GROUP BY ontology"
)
def summary_ontologies(spark, sf):
    return _round_spread(reports.summary_ontologies(scores(spark, sf), meta(spark, sf)))


@query(
    "distribution_totals",
    f"""WITH {SQL_VECTORS} SELECT (SELECT count(DISTINCT doi) FROM chunks) AS abstracts, count(DISTINCT doi) AS annotated,
    count(*) AS labels FROM scores""",
)
def distribution_totals(spark, sf):
    docs = vector_chunks(spark, sf).select("doi").distinct()
    return reports.distribution(docs, scores(spark, sf), meta(spark, sf)).totals


@query("distribution_ontologies", f"{SQL_DESCRIBED} SELECT ontology, count(*) AS count FROM d GROUP BY ontology")
def distribution_ontologies(spark, sf):
    return reports.ontology_counts(scores(spark, sf), meta(spark, sf))


@query(
    "distribution_top_labels",
    f"WITH {SQL_VECTORS} SELECT tag, count(*) AS count FROM scores GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 10",
)
def distribution_top_labels(spark, sf):
    return reports.top_labels(scores(spark, sf))


# Annotation rows


def vector_abstracts(spark, sf):
    """Documents the vectors belong to, as far as the document table has them."""
    return document_abstracts(spark, sf).select("doi", "pmid", "reference_id")


SQL_DOCS = "docs AS (SELECT '10.5555/' || doc_id AS doi, doc_id::VARCHAR AS pmid FROM documents)"


@query(
    "annotation_rows",
    f"""WITH {SQL_VECTORS}, {SQL_DOCS} SELECT doi, tag AS "topicalDescriptor", pmid, NULL::VARCHAR AS reference_id
    FROM docs JOIN scores USING (doi)""",
)
def annotation_rows(spark, sf):
    return annotations.annotation_rows(vector_abstracts(spark, sf), scores(spark, sf))


def tag_ancestors(spark, sf):
    """Tags below their ontology, ontologies below one root."""
    tags = vector_tags(spark, sf).select("tag", F.substring_index("tag", "/", 4).alias("onto"))
    edges = tags.select(F.col("tag").alias("child"), F.col("onto").alias("parent")).unionByName(
        tags.select(F.col("onto").alias("child"), F.lit("http://example.org/").alias("parent")).distinct()
    )
    return ancestors(edges)


@query(
    "annotations_with_ancestors",
    f"""WITH {SQL_VECTORS}, {SQL_DOCS},
    up AS (SELECT tag, regexp_replace(tag, '/T_.*$', '') AS anc FROM tags UNION ALL SELECT tag, 'http://example.org/' FROM tags)
    SELECT doi, t AS "topicalDescriptor", pmid, NULL::VARCHAR AS reference_id
    FROM docs JOIN (SELECT doi, tag AS t FROM scores UNION ALL SELECT doi, anc FROM scores JOIN up USING (tag)) USING (doi)""",
)
def annotations_with_ancestors(spark, sf):
    return annotations.annotation_rows(vector_abstracts(spark, sf), scores(spark, sf), tag_ancestors(spark, sf))


# RDF

SQL_NODE = "'_:b' || sha256(doi || chr(10) || tag)"
SQL_GRAPH = f"""
g AS (SELECT doi, tag, printf('%.6f', sim) AS score, {SQL_NODE} AS node FROM scores),
triples AS (
  SELECT 'https://doi.org/' || replace(url_encode(doi), '%2F', '/') AS s, 'http://purl.org/dc/elements/1.1/subject' AS p,
         node AS o, 'bnode' AS o_kind, NULL::VARCHAR AS datatype FROM g
  UNION ALL SELECT node, 'http://www.w3.org/2004/02/skos/core#closeMatch', tag, 'iri', NULL FROM g
  UNION ALL SELECT node, 'urn:termweave:similarityScore', score, 'literal', 'http://www.w3.org/2001/XMLSchema#float' FROM g)"""


def fixed_scores(spark, sf):
    """Scores in six decimals, so that both engines write the same digits."""
    return scores(spark, sf).withColumn("similarity", F.format_string("%.6f", "similarity"))


@query("annotation_triples", f"WITH {SQL_VECTORS}, {SQL_GRAPH} SELECT s, p, o, o_kind, datatype FROM triples")
def annotation_triples(spark, sf):
    return graph.annotation_triples(fixed_scores(spark, sf)).drop("lang")


@query(
    "ntriples_lines",
    f"""WITH {SQL_VECTORS}, {SQL_GRAPH},
    n AS (SELECT CASE WHEN starts_with(s, '_:') THEN s ELSE '<' || s || '>' END AS s, '<' || p || '>' AS p, CASE o_kind
            WHEN 'bnode' THEN o WHEN 'iri' THEN '<' || o || '>' ELSE '"' || o || '"^^<' || datatype || '>' END AS o
          FROM triples)
    SELECT s || ' ' || p || ' ' || o || ' .' AS value FROM n""",
)
def ntriples_lines(spark, sf):
    return graph.ntriples_lines(graph.annotation_triples(fixed_scores(spark, sf)))


@query(
    "graph_counts",
    f"""WITH {SQL_VECTORS} SELECT count(*) AS total_triplets, count(DISTINCT doi) AS abstracts_processed FROM scores""",
)
def graph_counts(spark, sf):
    return graph.graph_counts(scores(spark, sf))


@query(
    "provenance_triples",
    f"""WITH {SQL_VECTORS}, c AS (SELECT count(*) AS t, count(DISTINCT doi) AS a FROM scores)
    SELECT unnest([
      {{s: '_:activity', p: 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', o: 'http://www.w3.org/ns/prov#Activity'}},
      {{s: '_:graph', p: 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', o: 'http://www.w3.org/ns/prov#Entity'}},
      {{s: '_:graph', p: 'http://www.w3.org/ns/prov#generatedAtTime', o: '2024-01-01T00:00:00'}},
      {{s: '_:graph', p: 'http://www.w3.org/ns/prov#wasGeneratedBy', o: '_:activity'}},
      {{s: '_:activity', p: 'urn:termweave:encoderName', o: 'given vectors'}},
      {{s: '_:activity', p: 'urn:termweave:systemName', o: 'termweave'}},
      {{s: '_:activity', p: 'urn:termweave:similarityThreshold', o: '{CHUNK_T}'}},
      {{s: '_:activity', p: 'urn:termweave:tagSimilarityThreshold', o: '{TAG_T}'}},
      {{s: '_:activity', p: 'urn:termweave:similarityMethod',
        o: 'https://w3id.org/semapv/vocab/SemanticSimilarityThresholdMatching'}},
      {{s: '_:graph', p: 'urn:termweave:totalTriplets', o: t::VARCHAR}},
      {{s: '_:graph', p: 'urn:termweave:abstractsProcessed', o: a::VARCHAR}}], recursive := true) FROM c""",
)
def provenance_triples(spark, sf):
    return graph.provenance_triples(
        scores(spark, sf),
        encoder_name="given vectors",
        system_name="termweave",
        threshold_chunk=CHUNK_T,
        threshold_tag=TAG_T,
        generated_at="2024-01-01T00:00:00",
    ).select("s", "p", "o")


# Evaluation


def tag_truth(spark, sf):
    """Each document's own vectors as its descriptors; documents without a label-0 vector were never judged."""
    e = table(spark, sf, "embeddings")
    own = F.collect_list(F.concat(F.lit("T_"), text_of("vec_id")))
    return (
        e.groupBy(F.concat(F.lit("10.5555/"), F.expr("vec_id div 10")).alias("doi"))
        .agg(F.min("label").alias("least"), own.alias("own"))
        .select("doi", F.when(F.col("least") == 0, F.col("own")).alias("descriptor"))
    )


SQL_METRICS = """
m AS (
  SELECT t, judged, actual,
         CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE ELSE 0 END AS pr,
         CASE WHEN actual > 0 THEN tp / actual::DOUBLE ELSE 0 END AS re, predicted
  FROM facts),
credits AS (
  SELECT t, CASE WHEN NOT judged THEN 0 WHEN predicted = 0 AND actual = 0 THEN 1 ELSE pr END AS pr,
         CASE WHEN NOT judged THEN 0 WHEN predicted = 0 AND actual = 0 THEN 1 ELSE re END AS re,
         CASE WHEN NOT judged THEN 0 WHEN predicted = 0 AND actual = 0 THEN 1
              WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1
  FROM m)
SELECT t AS threshold, round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall, round(avg(f1), 6) AS f1
FROM credits GROUP BY t"""


def sql_plain(thresholds):
    return f"""WITH {SQL_VECTORS},
    sweep AS (SELECT unnest({thresholds}::DOUBLE[]) AS t),
    docs AS (SELECT '10.5555/' || (vec_id // 10) AS doi, min(label) = 0 AS judged FROM embeddings GROUP BY 1),
    truth AS (SELECT '10.5555/' || (vec_id // 10) AS doi, 'T_' || vec_id AS term FROM embeddings),
    p AS (SELECT t, doi, split_part(tag, '/', -1) AS term FROM scores, sweep WHERE sim >= t),
    facts AS (
      SELECT t, judged, coalesce((SELECT count(*) FROM p WHERE p.t = sweep.t AND p.doi = docs.doi), 0) AS predicted,
             coalesce((SELECT count(*) FROM p JOIN truth USING (doi, term) WHERE p.t = sweep.t AND p.doi = docs.doi), 0) AS tp,
             coalesce((SELECT count(*) FROM truth WHERE truth.doi = docs.doi), 0) AS actual
      FROM docs, sweep), {SQL_METRICS}"""


def _round_metrics(df):
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("evaluate_sweep", sql_plain(SWEEP))
def evaluate_sweep(spark, sf):
    return _round_metrics(evaluate.evaluate_sweep(scores(spark, sf), tag_truth(spark, sf), SWEEP))


@query("evaluate", sql_plain(SWEEP[:1]))
def evaluate_once(spark, sf):
    return _round_metrics(evaluate.evaluate(scores(spark, sf), tag_truth(spark, sf), SWEEP[0]))


def vector_links(spark, sf):
    """Tags as concepts: labels 0-3 have a preferred descriptor, labels 2-6 a plain one, the others none."""
    e = table(spark, sf, "embeddings")
    concept, label = F.concat(F.lit("T_"), text_of("vec_id")).alias("concept"), F.col("label")
    preferred = e.where(label < 4).select(
        concept, F.lit("preferredConcept").alias("prop"), F.concat(F.lit("D"), text_of("label")).alias("descriptor")
    )
    plain = e.where((label > 1) & (label < 7)).select(
        concept, F.lit("concept").alias("prop"), F.concat(F.lit("D"), (label % 3).cast("string")).alias("descriptor")
    )
    return preferred.unionByName(plain)


def label_truth(spark, sf):
    """Labels of a document's vectors as descriptors, repeats included."""
    return (
        table(spark, sf, "embeddings")
        .groupBy(F.concat(F.lit("10.5555/"), F.expr("vec_id div 10")).alias("doi"))
        .agg(F.collect_list(F.concat(F.lit("D"), text_of("label"))).alias("descriptor"))
    )


SQL_LINKS = """
links AS (
  SELECT 'T_' || vec_id AS concept, 'preferredConcept' AS prop, 'D' || label AS descriptor FROM embeddings WHERE label < 4
  UNION ALL
  SELECT 'T_' || vec_id, 'concept', 'D' || (label % 3) FROM embeddings WHERE label > 1 AND label < 7),
resolved AS (
  SELECT DISTINCT concept, descriptor FROM links l WHERE prop = 'preferredConcept' OR NOT EXISTS (
    SELECT 1 FROM links p WHERE p.concept = l.concept AND p.prop = 'preferredConcept'))"""


@query(
    "evaluate_linked",
    f"""WITH {SQL_VECTORS}, {SQL_LINKS},
    sweep AS (SELECT unnest({SWEEP}::DOUBLE[]) AS t),
    truth AS (SELECT '10.5555/' || (vec_id // 10) AS doi, 'D' || label AS term FROM embeddings),
    docs AS (SELECT doi, count(*) AS actual FROM truth GROUP BY doi),
    p AS (SELECT t, doi, split_part(tag, '/', -1) AS concept FROM scores, sweep WHERE sim >= t),
    q AS (SELECT DISTINCT t, doi, CASE WHEN descriptor IS NULL THEN 'u' ELSE 'd' END AS kind,
                 coalesce(descriptor, concept) AS term FROM p LEFT JOIN resolved USING (concept)),
    counted AS (
      SELECT t, doi, count(*) AS predicted,
             count(*) FILTER (WHERE kind = 'd' AND (doi, term) IN (SELECT (doi, term) FROM truth)) AS tp
      FROM q GROUP BY t, doi),
    facts AS (
      SELECT sweep.t, true AS judged, docs.actual, coalesce(c.predicted, 0) AS predicted, coalesce(c.tp, 0) AS tp
      FROM docs CROSS JOIN sweep LEFT JOIN counted c ON c.t = sweep.t AND c.doi = docs.doi), {SQL_METRICS}""",
)
def evaluate_linked(spark, sf):
    linked = evaluate.evaluate_linked_sweep(scores(spark, sf), label_truth(spark, sf), vector_links(spark, sf), SWEEP)
    return _round_metrics(linked)


@query("resolve_links", f"WITH {SQL_LINKS} SELECT concept, descriptor FROM resolved")
def resolve_links(spark, sf):
    return evaluate.resolve_links(vector_links(spark, sf))


@query(
    "grouped_links",
    f"""WITH {SQL_LINKS} SELECT concept, prop, string_agg(descriptor, ',' ORDER BY descriptor) AS descriptors
    FROM links GROUP BY concept, prop""",
)
def grouped_links(spark, sf):
    return evaluate.grouped_links(vector_links(spark, sf)).withColumn("descriptors", F.array_join("descriptors", ","))


# Merging runs and exchanging scores


def two_runs(spark, sf):
    """All scores as a first run; a second run over the documents of even vectors' labels, slightly lower. A score's two rows stand together."""
    first = scores(spark, sf)
    docs = table(spark, sf, "embeddings").where("label = 0")
    docs = docs.select(F.concat(F.lit("10.5555/"), F.expr("vec_id div 10")).alias("doi")).distinct()
    strong = (F.col("similarity") >= 0.35) & F.col("again").isNotNull()
    own = F.struct("similarity", F.lit(1).alias("run"))
    lower = F.struct((F.col("similarity") - 0.01).alias("similarity"), F.lit(2).alias("run"))
    marked = first.join(small(docs.withColumn("again", F.lit(True))), "doi", "left")  # scores are read once
    return marked.select("doi", "tag", F.inline(F.when(strong, F.array(own, lower)).otherwise(F.array(own))))


SQL_RUNS = f"""WITH {SQL_VECTORS},
runs AS (
  SELECT doi, tag, sim, 1 AS run FROM scores UNION ALL
  SELECT doi, tag, sim - 0.01, 2 FROM scores
  WHERE sim >= 0.35 AND doi IN (SELECT '10.5555/' || (vec_id // 10) FROM embeddings WHERE label = 0))"""


@query("merge_scores_max", f"{SQL_RUNS} SELECT doi, tag, round(max(sim), 6) AS similarity FROM runs GROUP BY doi, tag")
def merge_max(spark, sf):
    return rounded(annotations.merge_scores(two_runs(spark, sf), together=True))


@query(
    "merge_scores_last",
    f"""{SQL_RUNS}, l AS (SELECT doi, max(run) AS run FROM runs GROUP BY doi)
    SELECT doi, tag, round(sim, 6) AS similarity FROM runs JOIN l USING (doi, run)""",
)
def merge_last(spark, sf):
    return rounded(annotations.merge_scores(two_runs(spark, sf), "last", together=True))


@query("scores_json", f"WITH {SQL_VECTORS} SELECT doi, tag, round(sim, 6) AS similarity FROM scores")
def scores_json_round_trip(spark, sf):
    """Scores to JSON lines of at most 16 tags or so, and back."""
    return rounded(parse_scores(scores_json(scores(spark, sf), 16, together=True)))


@query("run_evaluation", sql_plain(list(evaluate.THRESHOLDS)))
def run_evaluation(spark, sf):
    return _round_metrics(jobs.run_evaluation(scores(spark, sf), tag_truth(spark, sf)))


# Files of results


@query(
    "annotation_files",
    f"""WITH {SQL_VECTORS}, {SQL_DOCS} SELECT doi, tag AS "topicalDescriptor", pmid, NULL::VARCHAR AS reference_id
    FROM docs JOIN scores USING (doi)""",
)
def annotation_files(spark, sf):
    """Annotation rows to compressed CSV and back; rows grow with the square of the vectors."""
    path = scratch(spark)
    rows = annotations.annotation_rows(vector_abstracts(spark, sf), scores(spark, sf))
    sinks.write_annotations(rows, path, **GZIP)
    layout = "doi string, topicalDescriptor string, pmid string, reference_id string"
    return spark.read.schema(layout).option("header", True).csv(path)


@query(
    "summary_files",
    f"""{SQL_DESCRIBED}
    SELECT 'tags' AS file, arg_min(ontology, d.tag) AS "Ontology group", split_part(d.tag, '/', -1) AS "Tag", arg_min(label, d.tag) AS "Label",
           count(*) AS "Count", round(avg(sim), 6) AS "Mean Similarity", round(stddev_pop(sim), 6) AS "Std Similarity", NULL::VARCHAR AS "DOI"
    FROM d GROUP BY split_part(d.tag, '/', -1)
    UNION ALL SELECT 'ontologies', ontology, NULL, NULL, count(*), round(avg(sim), 6), round(stddev_pop(sim), 6), NULL FROM d GROUP BY ontology
    UNION ALL SELECT 'best', ontology, split_part(tag, '/', -1), label, NULL, round(sim, 6), NULL, 'https://doi.org/' || doi FROM d""",
)
def summary_files(spark, sf):
    """The three summaries to CSV with their headers and back, by the names in the headers."""
    path, found, described = scratch(spark), scores(spark, sf, ranked=True), meta(spark, sf)
    sinks.write_summary_tags(reports.summary_tags(found, described), f"{path}/tags")
    sinks.write_summary_ontologies(reports.summary_ontologies(found, described), f"{path}/ontologies")
    sinks.write_best_similarities(reports.best_similarities(found, described, ranked=True), f"{path}/best")

    def number(name):
        return F.round(F.col(name).cast("double"), 6)

    def read(name, **columns):
        rows = spark.read.option("header", True).csv(f"{path}/{name}")
        return rows.select(F.lit(name).alias("file"), *[c.alias(k.replace("_", " ")) for k, c in columns.items()])

    spread = {"Mean_Similarity": number("Mean Similarity"), "Std_Similarity": number("Std Similarity")}
    ontology, named = {"Ontology_group": F.col("Ontology group")}, {"Tag": F.col("Tag"), "Label": F.col("Label")}
    parts = [
        read("tags", **ontology, **named, Count=F.col("Count").cast("long"), **spread),
        read("ontologies", **ontology, Count=F.col("Tag Count").cast("long"), **spread),
        read("best", Ontology_group=F.col("Ontology"), **named, Mean_Similarity=number("Similarity"), DOI=F.col("DOI")),
    ]
    return sinks.union_frames(parts)


RUN = "'run_' || (split_part(doi, '/', 2)::BIGINT % 3)"


def write_runs(spark, sf):
    """The scores as three folders of compressed JSON lines, by document; returns the folders. Scores grow with the square of the vectors."""
    path, chunks = scratch(spark), vector_chunks(spark, sf)
    number = F.substring_index("doi", "/", -1).cast("long") % 3
    folders = [f"{path}/run_{i}" for i in range(3)]
    for i, folder in enumerate(folders):
        found = score_tags(chunks.where(number == i), vector_tags(spark, sf), CHUNK_T)  # every document is scored for its own folder only
        sinks.write_scores_json(rounded(found), folder, together=True, compression="gzip", per_file=sinks.ROWS_PER_FILE // sinks.TAGS_PER_LINE)
    return folders


@query("scores_files", f"WITH {SQL_VECTORS} SELECT doi, tag, round(sim, 6) AS similarity, {RUN} AS run FROM scores")
def scores_files(spark, sf):
    """Score files of several runs, each score with its run."""
    read = read_scores_json(spark, write_runs(spark, sf))
    return read.select("doi", "tag", "similarity", F.substring_index("run", "/", -1).alias("run"))


def sql_statement(s, p, o):
    return f"""{s} || ' <{p}> ' || {o} || ' .'"""


def sql_number(value):
    return f"""'"' || {value} || '"^^<http://www.w3.org/2001/XMLSchema#integer>'"""


XSD, PROV, OURS = "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/ns/prov#", "urn:termweave:"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
GRAPH_LINES = [
    sql_statement("'_:activity'", TYPE, f"'<{PROV}Activity>'"),
    sql_statement("'_:graph'", TYPE, f"'<{PROV}Entity>'"),
    sql_statement("'_:graph'", PROV + "generatedAtTime", f"""'"2024-01-01T00:00:00"^^<{XSD}dateTime>'"""),
    sql_statement("'_:graph'", PROV + "wasGeneratedBy", "'_:activity'"),
    sql_statement("'_:activity'", OURS + "encoderName", """'"given vectors"'"""),
    sql_statement("'_:activity'", OURS + "systemName", """'"termweave"'"""),
    sql_statement("'_:activity'", OURS + "similarityThreshold", f"""'"{CHUNK_T}"^^<{XSD}float>'"""),
    sql_statement("'_:activity'", OURS + "tagSimilarityThreshold", f"""'"{TAG_T}"^^<{XSD}float>'"""),
    sql_statement("'_:activity'", OURS + "similarityMethod", "'<https://w3id.org/semapv/vocab/SemanticSimilarityThresholdMatching>'"),
    sql_statement("'_:graph'", OURS + "totalTriplets", sql_number("t")),
    sql_statement("'_:graph'", OURS + "abstractsProcessed", sql_number("a")),
]
SCORE_LINES = [
    sql_statement("'<https://doi.org/' || replace(url_encode(doi), '%2F', '/') || '>'", "http://purl.org/dc/elements/1.1/subject", SQL_NODE),
    sql_statement(SQL_NODE, "http://www.w3.org/2004/02/skos/core#closeMatch", "'<' || tag || '>'"),
    sql_statement(SQL_NODE, OURS + "similarityScore", f"""'"' || sim || '"^^<{XSD}float>'"""),
]


@query(
    "graph_per_file",
    f"""WITH {SQL_VECTORS}, r AS (SELECT doi, tag, round(sim, 6) AS sim, {RUN} AS graph FROM scores),
    c AS (SELECT graph, count(*) AS t, count(DISTINCT doi) AS a FROM r GROUP BY graph)
    SELECT graph, unnest([{", ".join(SCORE_LINES)}]) AS value FROM r
    UNION ALL SELECT graph, unnest([{", ".join(GRAPH_LINES)}]) FROM c""",
)
def graph_per_file(spark, sf):
    """Score files to one RDF graph each, with its own provenance and counts, read back line by line."""
    out = scratch(spark)
    spec = AnnotationSpec(encoder="given vectors", threshold_chunk=CHUNK_T, threshold_tag=TAG_T)
    jobs.build_graphs(spark, write_runs(spark, sf), spec, out, generated_at="2024-01-01T00:00:00", **GZIP)
    return spark.read.text(out).select(F.regexp_replace("graph", "-[0-9a-f]{8}$", "").alias("graph"), "value")


def name_files(spark, folder, name):
    """Give the files of a Spark write names by number, as evaluation abstracts have them."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for i, status in enumerate(files.globStatus(pattern)):
        files.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(f"{folder}/{name % i}"))


@query(
    "truth_files",
    """SELECT '10.5555/' || (vec_id // 10) AS doi, string_agg('D' || label, ',' ORDER BY 'D' || label) AS descriptor FROM embeddings GROUP BY 1""",
)
def truth_files(spark, sf):
    """Evaluation abstracts in numbered files; files of other names beside them do not count."""
    folder = scratch(spark)
    label_truth(spark, sf).write.json(folder)
    name_files(spark, folder, "abstracts_%d.json")
    label_truth(spark, sf).write.mode("append").json(folder)
    name_files(spark, folder, "abstracts_%dx.json")
    return abstracts.read_truth(spark, folder).select("doi", F.array_join(F.sort_array("descriptor"), ",").alias("descriptor"))
