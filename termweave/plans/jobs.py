"""The jobs: tag tables, chunk tables, annotation, publication."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave import sinks
from termweave.functions import text as tx
from termweave.functions.encode import Encoder, HashingEncoder, encode
from termweave.operators import annotations, closure, documents, evaluate, graph, reports, taxa, terms
from termweave.operators.similarity import annotate_documents, score_tags, similarity_join, tag_edges
from termweave.operators.suppress import settle_by_vectors, suppress_similar_tags
from termweave.runtime import cut, keep, keeper, small
from termweave.schemas import TRIPLES
from termweave.sources import abstracts as abstract_files
from termweave.sources import rdf, stores, taxonomy, turtle
from termweave.spec import SUBCLASS_OF, AnnotationSpec, OntologySpec, TaxonSpec, iri_of, split_path


def encoder_of(spec: AnnotationSpec) -> Encoder:
    """The built-in encoder for ``hashing-<dim>``; any other name needs an encoder object from the caller."""
    kind, _, dim = spec.encoder.partition("-")
    if kind == "hashing" and dim.isdigit():
        return HashingEncoder(int(dim))
    raise ValueError(f"no built-in encoder {spec.encoder!r}: pass encoder=BatchEncoder(...)")


def read_ontology(spark: SparkSession, spec: OntologySpec) -> DataFrame:
    if spec.format in ("nt", "ntriples"):
        return rdf.read_ntriples(spark, spec.path)
    if spec.format in ("ttl", "turtle"):
        return turtle.read_turtle(spark, spec.path, spec.prefixes, spec.base or "")
    wanted = [spec.label, *spec.properties, *[split_path(p).predicate for p in spec.constraints]]
    return rdf.read_owl(spark, spec.path, [iri_of(p, spec.prefixes) for p in wanted], spec.base)


def build_owl_tags(spark: SparkSession, spec: AnnotationSpec, multi: str = "agg") -> DataFrame:
    """Tags of all ontologies; the triples are used once per part of a query, so each file is parsed once and kept."""
    parts = [terms.build_terms(cut(read_ontology(spark, o)), o, multi, spec.cap_terms) for o in spec.ontologies]
    return reduce(lambda a, b: a.unionByName(b), parts)


def build_gbif_tags(spark: SparkSession, spec: TaxonSpec) -> DataFrame:
    """Tags of the two-column extracts; where one is missing, the dump's own file stands in for it."""
    extracts = [os.path.join(spec.work_dir, name) for name in (spec.taxon_file, spec.vernacular_file)]
    dump = [os.path.join(spec.work_dir, name) for name in (taxonomy.GBIF_TAXA, taxonomy.GBIF_VERNACULAR)]
    have = abstract_files.existing(spark, extracts)
    taxa_path, names_path = (path if path in have else full for path, full in zip(extracts, dump))
    taxa_rows = taxonomy.read_gbif_taxa(spark, taxa_path, raw=taxa_path not in have)
    return taxa.gbif_tags(taxa_rows, taxonomy.read_gbif_vernacular(spark, names_path), spec.regex, spec.cap)


def build_ncbi_tags(spark: SparkSession, spec: TaxonSpec) -> DataFrame:
    names, nodes, divisions = (os.path.join(spec.work_dir, f"{n}.dmp") for n in ("names", "nodes", "division"))
    compiled = taxa.compile_ncbi(
        taxonomy.read_names(spark, names), taxonomy.read_nodes(spark, nodes), taxonomy.read_divisions(spark, divisions)
    )
    return taxa.ncbi_tags(compiled, spec.regex, spec.cap)


def build_tags(spark: SparkSession, spec: AnnotationSpec) -> DataFrame:
    """All tags, one row per term; taxonomies overrule ontologies."""
    parts = [build_owl_tags(spark, spec)] if spec.ontologies else []
    if spec.gbif and spec.gbif.work_dir:
        parts.append(build_gbif_tags(spark, spec.gbif))
    if spec.ncbi and spec.ncbi.work_dir:
        parts.append(build_ncbi_tags(spark, spec.ncbi))
    return terms.merge_tags(*parts)


def embed_tags(tags: DataFrame, encoder: Encoder) -> DataFrame:
    """``tag, ontology, label, group, embedding``."""
    usable, _ = terms.reject_empty(tags)
    vectors = encode(terms.encoding_text(usable), encoder, "text")
    return vectors.select(
        F.col("term").alias("tag"), "ontology", F.col("rdfs_label").alias("label"), "group", "embedding"
    )


def abstract_rejects(found: DataFrame) -> DataFrame:
    """``(file, block, line, reason, text)`` of what gives no chunks: text that is no record, and records without title, abstract or doi."""
    missing = [F.when(tx.is_blank(F.col(f"record.{c}")), c) for c in ("title", "abstract")] + [F.when(F.col("record.doi").isNull(), "doi")]
    missing = F.concat(F.lit("without "), F.concat_ws(", ", *missing))
    reason = F.coalesce("reason", F.when(missing != "without ", missing))
    text = F.coalesce("text", F.to_json("record"))
    return found.select("file", "block", "line", reason.alias("reason"), text.alias("text")).where("reason IS NOT NULL")


def build_chunks(abstracts: DataFrame, encoder: Encoder) -> DataFrame:
    """``doi, chunk_idx, text, embedding`` of the valid abstracts, the first abstract of each doi."""
    return embed_chunks(documents.dedupe_documents(documents.valid_abstracts(abstracts)), encoder)


def embed_chunks(unique: DataFrame, encoder: Encoder) -> DataFrame:
    """As ``build_chunks``, of abstracts whose dois are known to differ."""
    return encode(documents.chunk_documents(unique), encoder, "text")


def annotate(
    chunks: DataFrame, tags: DataFrame, threshold_chunk: float = 0.75, threshold_tag: float = 0.75, **options
) -> DataFrame:
    """``doi, tag, similarity``: best cosine per document and tag, near-duplicate tags removed per document.

    Tag pairs are compared only among the tags that were matched, as a rule in the task that scores the document, without storing a score
    or a pair. Chunks are read for their dois first; tags are read several times, so pass stored tables.
    """
    settled = annotate_documents(chunks, tags, threshold_chunk, settle_by_vectors(threshold_tag), **options)
    if settled is not None:
        return settled
    scores = keep(score_tags(chunks, tags, threshold_chunk, **options))
    edges = tag_edges(terms.tags_in_scores(tags.select("tag", "embedding"), scores), threshold_tag, **options)
    return suppress_similar_tags(scores, edges)


def annotate_chunks(chunks: DataFrame, tags: DataFrame, threshold: float = 0.75, **options) -> DataFrame:
    """Chunk-level rows ``doi, tag, similarity``: no maximum, no suppression."""
    return similarity_join(chunks, tags, threshold, keep=["doi"], **options)


def annotate_checked(spark: SparkSession, spec: AnnotationSpec, chunk_path: str, tag_path: str) -> DataFrame:
    """Annotate stored embeddings; missing tags or abstracts are an error."""
    tags = stores.read_embeddings(spark, tag_path, spec.encoder)
    chunks = stores.read_embeddings(spark, chunk_path, spec.encoder)
    for name, df in (("tag", tags), ("abstract", chunks)):
        if df.isEmpty():
            raise FileNotFoundError(f"no {name} embeddings found")
    return annotate(chunks, tags, spec.threshold_chunk, spec.threshold_tag)


def annotate_incremental(
    chunks: DataFrame, tags: DataFrame, done: DataFrame, threshold_chunk: float, threshold_tag: float, **options
) -> DataFrame:
    """Annotate only the documents whose ``doi`` is not in ``done``."""
    fresh = chunks.join(done.select("doi").distinct(), "doi", "left_anti")
    return annotate(fresh, tags, threshold_chunk, threshold_tag, **options)


def subclass_ancestors(triples: DataFrame, prefix: str | None = None) -> DataFrame:
    edges = terms.match(triples, p=SUBCLASS_OF).where("o_kind = 'iri'")
    return closure.ancestors(edges.select(F.col("s").alias("child"), F.col("o").alias("parent")), prefix)


def reference_triples(spark: SparkSession, paths, prefixes: dict[str, str]) -> DataFrame:
    """Triples of reference files. Some end every statement by its line, with any mark; what is no Turtle is read like that."""
    found = cut(turtle.turtle_statements(spark, paths, prefixes))
    lines = found.where("reason IS NOT NULL").select(F.explode(F.split("statement", "\n")).alias("value"))
    return found.where("reason IS NULL").select(*TRIPLES.fieldNames()).unionByName(rdf.parse_statements(lines, prefixes))


def export_pubmed(spark: SparkSession, xml_paths, reference_paths, prefixes: dict[str, str]) -> DataFrame:
    """PubMed articles that have a reference id: ``title, abstract, doi, pmid, reference_id``."""
    articles = documents.articles_to_abstracts(abstract_files.read_pubmed_xml(spark, xml_paths))
    usable = documents.usable_articles(articles, require_doi=False).drop("descriptor")
    identifier = "http://purl.org/dc/terms/identifier"
    triples = terms.match(reference_triples(spark, reference_paths, prefixes), p=identifier)
    linked = documents.link_references(usable, documents.doi_references(triples))
    return linked.select("title", "abstract", "doi", "pmid", "reference_id")


def run_evaluation(scores: DataFrame, truth: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Metrics over the standard thresholds; scores should come from the lowest of them."""
    if links is None:
        return evaluate.evaluate_sweep(scores, truth)
    return evaluate.evaluate_linked_sweep(scores, truth, links)


def _documents_of_maps(maps: DataFrame) -> DataFrame:
    """``graph, doi, n, repeats``: the scores of a document of a graph, and whether a tag may be among them twice.

    Lines whose ranges of tags do not overlap share no tag; so lines are compared, scores are not.
    """
    tags = F.map_keys("scores")
    lines = maps.where(F.size("scores") > 0).select(
        "graph", "doi", F.size(tags).cast("long").alias("n"), F.array_min(tags).alias("least"), F.array_max(tags).alias("most"),
        (F.size(F.array_distinct(tags)) < F.size(tags)).alias("twice"),
    )
    before = Window.partitionBy("graph", "doi").orderBy("least").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("most").over(before) >= F.col("least"), F.lit(False))
    return lines.withColumn("reached", reached).groupBy("graph", "doi").agg(F.sum("n").alias("n"), F.max(F.col("twice") | F.col("reached")).alias("repeats"))


def build_graphs(
    spark: SparkSession,
    score_paths: str | list[str],
    spec: AnnotationSpec,
    out: str,
    layout: str = "lines",
    generated_at: str | None = None,
    **files,
) -> None:
    """One RDF graph below ``out`` for each score file (or folder of a Spark write), each with its own provenance.

    A file of several lines may hold a score twice. Only documents with lines that may share a tag are gathered for that; the scores of all
    others go from the files to the graphs without a shuffle. ``files`` are options of ``sinks.write_graphs``.
    """
    maps = stores.read_score_maps(spark, score_paths, layout).withColumn("graph", graph.graph_name(F.col("run"))).drop("run")
    known = cut(_documents_of_maps(maps))
    single, repeated = known.where("NOT repeats"), known.where("repeats").select("graph", "doi")
    counts = single.groupBy("graph").agg(F.sum("n").alias("total_triplets"), F.count("*").alias("abstracts_processed"))
    if repeated.isEmpty():
        scores = stores.score_rows(maps)
    else:
        by, repeated = ["graph", "doi"], small(repeated)
        gathered = stores.score_rows(maps.join(repeated, by, "left_semi")).groupBy(*by, "tag").agg(F.max("similarity").alias("similarity"))
        gathered = cut(gathered)
        scores = stores.score_rows(maps.join(repeated, by, "left_anti").select(*by, "scores")).unionByName(gathered)
        both = counts.unionByName(graph.graph_counts(gathered, ["graph"]))
        counts = both.groupBy("graph").agg(*[F.sum(c).alias(c) for c in ("total_triplets", "abstracts_processed")])
    provenance = graph.provenance_triples(
        scores,
        encoder_name=spec.encoder,
        system_name="termweave",
        threshold_chunk=spec.threshold_chunk,
        threshold_tag=spec.threshold_tag,
        generated_at=generated_at,
        by=["graph"],
        counts=counts,
    )
    sinks.write_graphs(graph.annotation_triples(scores, by=["graph"]).unionByName(provenance), out, **files)


def publish(
    abstracts: DataFrame, scores: DataFrame, tags: DataFrame, spec: AnnotationSpec, out: str, ancestors=None
) -> None:
    """Annotation rows, summaries and RDF below ``out``."""
    files = {"compression": spec.compression, "per_file": 0 if spec.compression == "none" else sinks.ROWS_PER_FILE}
    sinks.write_annotations(annotations.annotation_rows(abstracts, scores, ancestors), f"{out}/queryresults", **files)
    sinks.write_best_similarities(reports.best_similarities(scores, tags), f"{out}/best_similarities", **files)
    sinks.write_summary_tags(reports.summary_tags(scores, tags), f"{out}/summary")
    sinks.write_summary_ontologies(reports.summary_ontologies(scores, tags), f"{out}/summary_ontologies")
    provenance = graph.provenance_triples(
        scores,
        encoder_name=spec.encoder,
        system_name="termweave",
        threshold_chunk=spec.threshold_chunk,
        threshold_tag=spec.threshold_tag,
    )
    sinks.write_ntriples(graph.annotation_triples(scores).unionByName(provenance), f"{out}/graph", **files)


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def fingerprints(spark: SparkSession, spec: AnnotationSpec, encoder: Encoder) -> dict[str, str]:
    """What each stored stage depends on beside the documents: encoder, thresholds, ontologies and the state of their files."""
    taxonomies = [t for t in (spec.gbif, spec.ncbi) if t and t.work_dir]
    files = abstract_files.states(spark, [o.path for o in spec.ontologies if o.path] + [t.work_dir for t in taxonomies])
    described = [asdict(x) for x in (*spec.ontologies, *taxonomies)]
    tags, chunks = _digest(encoder.name, spec.cap_terms, described, files), _digest(encoder.name)
    return {"tag_embeddings": tags, "chunk_embeddings": chunks, "scores": _digest(tags, chunks, spec.threshold_chunk, spec.threshold_tag)}


def run_workflow(spark: SparkSession, spec: AnnotationSpec, out: str, encoder: Encoder | None = None) -> DataFrame:
    """From files to published annotations; each stage is written once and read back by the next. Tables that only this run needs are deleted.

    What cannot be read or encoded is listed below ``out/rejects``. A stage is built anew if its fingerprint in ``out/manifest`` is
    another one, or with ``spec.force``. Otherwise only documents whose title or abstract is new are encoded and scored, in place of
    what their doi had; documents no longer among the files stay.
    """
    with keeper(spark) as keep:
        return _run_workflow(spark, spec, out, encoder or encoder_of(spec), keep)


def _run_workflow(spark: SparkSession, spec: AnnotationSpec, out: str, encoder: Encoder, keep) -> DataFrame:
    tables = ("tag_embeddings", "chunk_embeddings", "scores", "scored_documents", "manifest")
    tag_path, chunk_path, score_path, done_path, manifest = (f"{out}/{n}" for n in tables)
    have = set(abstract_files.existing(spark, [f"{out}/{n}" for n in tables]))
    prints = fingerprints(spark, spec, encoder)
    known = dict(spark.read.parquet(manifest).collect()) if manifest in have else {}  # a row per stage
    current = {n for n, p in prints.items() if not spec.force and known.get(n) == p and {f"{out}/{n}", done_path} <= have}

    def record(stages) -> None:
        rows = spark.createDataFrame([(n, prints[n]) for n in sorted(stages)], "stage string, print string")
        sinks.write_table(rows.coalesce(1), manifest)

    # What is built anew does not count until all is written.
    record(current)
    if "tag_embeddings" not in current:
        tags = cut(build_tags(spark, spec))
        sinks.write_tags(tags, f"{out}/tags")
        sinks.write_table(terms.reject_empty(tags)[1], f"{out}/rejects/tags")
        sinks.write_embeddings(embed_tags(tags, encoder), tag_path, encoder.name, ["ontology"])
    tags = stores.read_embeddings(spark, tag_path, encoder.name)
    found = keep(abstract_files.abstract_records(spark, spec.abstract_files, spec.abstract_dirs))
    sinks.write_table(abstract_rejects(found), f"{out}/rejects/abstracts")
    source = found.where("reason IS NULL").select("record.*")
    content = F.sha2(F.to_json(F.struct("title", "abstract")), 256).alias("content")
    docs = documents.dedupe_stored(documents.valid_abstracts(source))  # not stored, as the records are
    contents = cut(docs.select("doi", content))

    if "chunk_embeddings" in current:
        before = cut(spark.read.parquet(done_path))
        # Known documents go before they are split and encoded; they are told by their dois and digests alone, texts are not shuffled for that.
        fresh = cut(contents.join(before, ["doi", "content"], "left_anti").select("doi"))
        new = docs.join(small(fresh), "doi", "left_semi")
        stored = stores.read_embeddings(spark, chunk_path, encoder.name).drop("encoder")
        replaced = cut(stored.join(small(fresh), "doi", "left_semi").select("doi").distinct())
        chunks = embed_chunks(new, encoder)
        if replaced.isEmpty():
            chunks.withColumn("encoder", F.lit(encoder.name)).write.mode("append").option("compression", "zstd").partitionBy("encoder").parquet(chunk_path)
        else:
            kept = stored.join(small(replaced), "doi", "left_anti")
            sinks.write_embeddings(keep(kept.unionByName(chunks)), chunk_path, encoder.name)
        contents = contents.unionByName(before.join(contents, "doi", "left_anti"))
    else:
        new = replaced = None
        sinks.write_embeddings(embed_chunks(docs, encoder), chunk_path, encoder.name)
    chunks = stores.read_embeddings(spark, chunk_path, encoder.name)
    if tags.isEmpty() or chunks.isEmpty():
        raise FileNotFoundError("no tag embeddings found" if tags.isEmpty() else "no abstract embeddings found")

    if "scores" in current and new is not None:
        if not replaced.isEmpty():
            sinks.write_table(cut(spark.read.parquet(score_path).join(replaced, "doi", "left_anti")), score_path)
        done = chunks.select("doi").join(small(fresh), "doi", "left_anti")
        annotate_incremental(chunks, tags, done, spec.threshold_chunk, spec.threshold_tag).write.mode("append").parquet(score_path)
    else:
        sinks.write_table(annotate(chunks, tags, spec.threshold_chunk, spec.threshold_tag), score_path)
    sinks.write_table(cut(contents), done_path)
    record(prints)
    scores = spark.read.parquet(score_path)
    sinks.write_scores_json(scores, f"{out}/scores_json")
    publish(source, scores, tags, spec, out)
    return scores
