import json
import os

import pytest
from pyspark.sql import functions as F

from termweave.functions.encode import HashingEncoder
from termweave.plans import jobs
from termweave.runtime import ensure_checkpoint_dir
from termweave.spec import AnnotationSpec, iri_of, object_of, split_path
from termweave.streaming import annotate_stream


def config(fixtures, **changes):
    return {
        "encodeur": "hashing-128",
        "threshold_similarity_tag_chunk": 0.3,
        "threshold_similarity_tag": 0.9,
        "populate_owl_tag_embeddings": {
            "prefix": {"rdfs": "http://www.w3.org/2000/01/rdf-schema#"},
            "ontologies": {
                "plants": {
                    "garden": {
                        "filepath": f"{fixtures}/ontologies/garden.owl",
                        "prefix": "http://example.org/garden#",
                        "format": "xml",
                        "label": "rdfs:label",
                        "properties": ["rdfs:comment"],
                    }
                }
            },
        },
        "populate_gbif_taxon_tag_embeddings": {"work_dir": f"{fixtures}/taxonomy", "regex": "rosa"},
        "populate_ncbi_taxon_tag_embeddings": {"work_dir": f"{fixtures}/taxonomy"},
        "populate_abstract_embeddings": {"from_file": {"json_dir": f"{fixtures}/abstracts"}},
        **changes,
    }


def test_spec(fixtures):
    spec = AnnotationSpec.from_dict(config(fixtures, encodeur=None, encoder="x", batch_size=8))
    assert (spec.encoder, spec.batch_size, spec.threshold_tag) == ("x", 8, 0.9)
    assert spec.ontologies[0].group == "plants" and spec.gbif.regex == "rosa"
    files = {"from_file": {"json_file": "a.json", "json_files": ["b.json"], "json_dir": ["d", "e"]}, "abstracts_per_file": 7}
    spec = AnnotationSpec.from_dict(config(fixtures, populate_abstract_embeddings=files))
    assert (sorted(spec.abstract_files), spec.abstract_dirs, spec.abstracts_per_file) == (["a.json", "b.json"], ["d", "e"], 7)
    with pytest.raises(ValueError, match="populate_abstract_embeddings.from_file"):
        AnnotationSpec.from_dict(config(fixtures, populate_abstract_embeddings={}))
    defaults = AnnotationSpec()
    assert (defaults.threshold_chunk, defaults.threshold_tag, defaults.batch_size) == (0.75, 0.75, 32)
    with pytest.raises(ValueError):
        jobs.encoder_of(AnnotationSpec(encoder="sentence-transformers/all-MiniLM-L6-v2"))


def test_names():
    assert iri_of("rdfs:label", {}) == "http://www.w3.org/2000/01/rdf-schema#label"
    assert object_of("'biological_process'", {}) == ("literal", "biological_process")
    assert object_of("true", {}) == ("literal", "true") and object_of("4", {}) == ("literal", "4")
    assert object_of("ex:C", {"ex": "http://e/"}) == ("iri", "http://e/C")
    assert split_path("rdfs:subClassOf*").star
    with pytest.raises(ValueError):
        split_path("rdfs:subClassOf+")
    with pytest.raises(ValueError):
        iri_of("no:x", {})


def test_workflow(spark, fixtures, tmp_path):
    spec = AnnotationSpec.from_dict(config(fixtures))
    out = str(tmp_path / "out")
    scores = jobs.run_workflow(spark, spec, out).collect()
    assert scores and all(r.similarity >= 0.3 for r in scores)
    assert {r.doi for r in scores} <= {"10.1/a", "10.1/b", "10.1/c", "10.1/e", "--"}
    tags = spark.read.parquet(f"{out}/tag_embeddings")
    assert {r.ontology for r in tags.select("ontology").distinct().collect()} == {"garden", "gbif", "ncbi"}
    for name in ("queryresults", "best_similarities", "summary", "summary_ontologies"):
        assert spark.read.option("header", True).csv(f"{out}/{name}").count() > 0
    assert spark.read.text(f"{out}/graph").count() == 3 * len(scores) + 11

    before = {tuple(r) for r in scores}
    new = {"title": "A rose", "abstract": "My rose grows by the gate.", "doi": "10.1/new"}
    (tmp_path / "late.json").write_text(json.dumps(new))
    spec.abstract_files = [str(tmp_path / "late.json")]
    after = {tuple(r) for r in jobs.run_workflow(spark, spec, out).collect()}
    assert before < after and {d for d, _, _ in after - before} == {"10.1/new"}

    tag_path, chunk_path = f"{out}/tag_embeddings", f"{out}/chunk_embeddings"
    again = jobs.annotate_checked(spark, spec, chunk_path, tag_path)
    assert {(r.doi, r.tag) for r in again.collect()} == {(d, t) for d, t, _ in after}
    spec.encoder = "hashing-5"
    with pytest.raises(FileNotFoundError):
        jobs.annotate_checked(spark, spec, chunk_path, tag_path)


def test_workflow_checkpoints_no_texts(spark, fixtures, tmp_path, monkeypatch):
    """Texts and vectors are kept compressed, and only as long as the run; published files can be compressed, too."""
    docs, stored, cut = tmp_path / "docs.json", [], jobs.cut
    monkeypatch.setattr(jobs, "cut", lambda df: stored.append(df.columns) or cut(df))
    scratch = ensure_checkpoint_dir(spark).removeprefix("file:")
    left = {p for p in os.listdir(scratch) if p.startswith("termweave-")}
    spec = AnnotationSpec.from_dict(config(fixtures))
    spec.abstract_files, spec.abstract_dirs, spec.compression = [str(docs)], [], "gzip"
    rows = [{"title": f"Title {i}", "abstract": f"Rose number {i}.", "doi": f"10.1/{i % 5}", "pmid": str(i)} for i in range(8)]
    for changed in (rows, [*rows[:6], {**rows[6], "abstract": "A fern."}, {**rows[2], "pmid": "1", "abstract": "My rose."}]):
        docs.write_text("\n".join(map(json.dumps, changed)))
        jobs.run_workflow(spark, spec, str(tmp_path / "out"))
    assert not [c for c in stored if {"abstract", "record", "embedding"} & set(c)]
    assert {p for p in os.listdir(scratch) if p.startswith("termweave-")} == left
    titles = spark.read.parquet(str(tmp_path / "out" / "chunk_embeddings")).where("chunk_idx = 1").select("doi", "text")
    assert sorted(map(tuple, titles.collect())) == [(f"10.1/{i}", "My rose." if i == 2 else f"Rose number {i}.") for i in range(5)]
    for name in ("queryresults", "best_similarities", "graph"):
        assert {p.suffix for p in (tmp_path / "out" / name).glob("part*")} == {".gz"}


def test_workflow_redoes_what_changed(spark, fixtures, tmp_path):
    changed = tmp_path / "docs.json"
    rose = {"title": "A rose", "abstract": "My rose grows by the gate.", "doi": "10.1/new"}
    changed.write_text(json.dumps(rose))
    spec = AnnotationSpec.from_dict(config(fixtures))
    spec.abstract_files = [str(changed)]
    out = str(tmp_path / "out")

    def rows(path, threshold):
        spec.threshold_chunk = threshold
        return sorted((r.doi, r.tag, round(r.similarity, 9)) for r in jobs.run_workflow(spark, spec, path).collect())

    def files(table):
        return sorted(str(p) for p in (tmp_path / "out" / table).rglob("*.parquet"))

    rows(out, 0.3)
    tags = files("tag_embeddings")
    assert rows(out, 0.2) == rows(str(tmp_path / "fresh"), 0.2) and files("tag_embeddings") == tags
    changed.write_text(json.dumps({**rose, "abstract": "A fern in the shade."}))
    assert rows(out, 0.2) == rows(str(tmp_path / "fresh2"), 0.2)
    chunks = spark.read.parquet(f"{out}/chunk_embeddings").where("doi = '10.1/new'")
    assert {r.text for r in chunks.collect()} == {"A rose", "A fern in the shade."}


def test_incremental_leaves_done_documents_alone(spark):
    encoder = HashingEncoder(32)
    docs = spark.createDataFrame([("a", "Rose", "A rose."), ("b", "Rose", "A rose.")], "doi string, title string, abstract string")
    chunks = jobs.build_chunks(docs.withColumn("pmid", F.lit("1")), encoder)
    tags = spark.createDataFrame([("t", "o", "Rose", "g")], "tag string, ontology string, label string, group string")
    tags = tags.withColumn("embedding", encoder.column(F.col("label")))
    done = spark.createDataFrame([("a",)], "doi string")
    assert [r.doi for r in jobs.annotate_incremental(chunks, tags, done, 0.5, 0.5).collect()] == ["b"]


def test_stream_runs_twice(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def land(name, rows):
        (source / name).write_text("\n".join(json.dumps(r) for r in rows))

    def run():
        args = (str(tmp_path / "out"), str(tmp_path / "checkpoint"), 0.5, 0.9)
        annotate_stream(spark, str(source), tags, encoder, *args).awaitTermination()
        return [(r.doi, r.tag) for r in spark.read.parquet(str(tmp_path / "out" / "scores")).collect()]

    encoder = HashingEncoder(512)
    tags = spark.createDataFrame([("t1", "rose"), ("t2", "fern")], "tag string, text string")
    tags = tags.withColumn("embedding", encoder.column(F.col("text"))).cache()
    rose = {"title": "Rose", "abstract": "A rose.", "doi": "a"}
    land("1.json", [rose, {**rose, "title": "Rose again"}, {"title": "Nothing", "abstract": "Else.", "doi": "b"}])
    assert run() == [("a", "t1")]
    land("2.json", [rose, {"title": "Fern", "abstract": "fern", "doi": "c"}])
    assert sorted(run()) == [("a", "t1"), ("c", "t2")]
    assert sorted(r.doi for r in spark.read.parquet(str(tmp_path / "out" / "ledger")).collect()) == ["a", "b", "c"]


def test_checkpoint_dir_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert ensure_checkpoint_dir(spark)
    if configured:
        assert configured.rstrip("/") in ensure_checkpoint_dir(spark)
