import json


import pytest
from pyspark.sql import functions as F

from termweave import sinks
from termweave.operators import documents, graph, taxa, terms
from termweave.plans import jobs
from termweave.sources import abstracts, rdf, stores, taxonomy
from termweave.schemas import PUBMED_ARTICLE
from termweave.spec import RDF, RDF_LABEL, RDFS, SUBCLASS_OF, AnnotationSpec, OntologySpec

MESHV = "http://id.nlm.nih.gov/mesh/vocab#"


def test_abstract_layouts(spark, fixtures):
    rows = abstracts.read_abstracts(spark, directories=f"{fixtures}/abstracts").collect()
    assert sorted(r.doi or "" for r in rows) == ["", "--", "10.1/a", "10.1/a", "10.1/b", "10.1/c", "10.1/d", "10.1/e", "10.1/f"]
    by_doi = {r.doi: r for r in rows}
    assert by_doi["10.1/c"].descriptor == ["D01", "D02"] and by_doi["10.1/c"].abstract == "Seeds keep {well} in [cold] rooms."
    assert by_doi["10.1/e"].reference_id == "900"


def test_files_and_missing_paths(spark, fixtures):
    files = [f"{fixtures}/abstracts/single.json", f"{fixtures}/abstracts/nowhere.json"]
    assert [r.doi for r in abstracts.read_abstracts(spark, files).collect()] == ["--"]
    assert abstracts.read_abstracts(spark, "nowhere.json").count() == 0
    both = abstracts.read_abstracts(spark, files[0], [f"{fixtures}/abstracts"])
    assert both.count() == 10


@pytest.mark.parametrize("layout,name,n", [("lines", "lines", 4), ("document", "pretty", 2), ("lines", "one_line", 2)])
def test_named_layouts(spark, fixtures, layout, name, n):
    assert abstracts.read_abstracts(spark, f"{fixtures}/abstracts/{name}.json", layout=layout).count() == n


def test_truth_reader(spark, fixtures, tmp_path):
    (tmp_path / "abstracts_1.json").write_text(json.dumps([{"doi": "d", "title": "t", "abstract": "a", "descriptor": ["D1"]}]))
    (tmp_path / "other.json").write_text('{"doi": "x"}')
    assert [(r.doi, r.descriptor) for r in abstracts.read_truth(spark, str(tmp_path)).collect()] == [("d", ["D1"])]


def test_pubmed(spark, fixtures):
    flat = documents.articles_to_abstracts(abstracts.read_pubmed_xml(spark, f"{fixtures}/pubmed/articles.xml"))
    api = documents.usable_articles(flat).collect()
    assert [(r.doi, r.abstract, r.descriptor) for r in api] == [("10.2/x", "First & part.Last part.", ["D001", "D002"])]
    export = documents.usable_articles(flat, require_doi=False)
    assert sorted((r.pmid, r.doi) for r in export.collect()) == [("101", "10.2/x"), ("102", "")]


def test_pubmed_export(spark, fixtures):
    rows = jobs.export_pubmed(
        spark, f"{fixtures}/pubmed/articles.xml", f"{fixtures}/pubmed/references.ttl", {"dcterms": "http://purl.org/dc/terms/"}
    ).collect()
    assert sorted((r.doi, r.pmid, r.reference_id) for r in rows) == [("10.2/x", "101", "7"), ("10.2/x", "101", "8")]
    assert rows[0].asDict().keys() == {"title", "abstract", "doi", "pmid", "reference_id"}


def garden(fixtures, **changes):
    fields = dict(
        name="garden", group="plants", prefix="http://example.org/garden#", path=f"{fixtures}/ontologies/garden.owl",
        label="rdfs:label", properties=["rdfs:comment", "obo:IAO_0000115", "obo:synonym"],
        prefixes={"rdfs": RDFS, "obo": "http://purl.obolibrary.org/obo/"},
    )
    return OntologySpec(**{**fields, **changes})


def test_owl_triples(spark, fixtures):
    rows = {(r.s.rpartition("#")[2], r.p.rpartition("#")[2], r.o.rpartition("#")[2], r.o_kind) for r in jobs.read_ontology(spark, garden(fixtures)).collect()}
    assert ("Shrub", "subClassOf", "Plant", "iri") in rows
    assert ("Rose", "label", "Rose", "literal") in rows and ("Rose", "subClassOf", "Shrub", "iri") in rows
    assert ("MyRose", "type", "Rose", "iri") in rows and ("MyRose", "type", "NamedIndividual", "iri") in rows
    assert ("Shrub", "http://purl.obolibrary.org/obo/synonym", "Bush", "iri") in rows
    assert len([r for r in rows if r[1] == "subClassOf"]) == 2


def test_owl_terms(spark, fixtures):
    spec = garden(fixtures)
    tags = {r.term.rpartition("#")[2]: r for r in terms.build_terms(jobs.read_ontology(spark, spec), spec).collect()}
    assert tags.keys() == {"Plant", "Shrub", "Rose", "hasColour", "MyRose"}
    assert tags["Shrub"].description == "Woody and small. A plant with stems. a scrub. bush."
    assert tags["Plant"].description == "Anything that grows here ."
    assert (tags["Rose"].description, tags["Rose"].rdfs_label) == ("", "Rose")
    assert (tags["MyRose"].ontology, tags["MyRose"].group) == ("garden", "plants")


def test_cross_product_of_values(spark, fixtures):
    spec = garden(fixtures, properties=["obo:synonym"], selected_prefix_term="http://example.org/garden#Sh")
    rows = terms.build_terms(jobs.read_ontology(spark, spec), spec, multi="cross").collect()
    assert sorted(r.description for r in rows) == ["a scrub.", "bush."]


@pytest.mark.parametrize(
    "constraints,expected",
    [
        ({"rdfs:subClassOf*": "<http://example.org/garden#Plant>"}, {"Plant", "Shrub", "Rose"}),
        ({"rdfs:subClassOf": "<http://example.org/garden#Plant>"}, {"Shrub"}),
        ({"obo:synonym": "'bush'", "rdfs:subClassOf*": "<http://example.org/garden#Plant>"}, {"Shrub"}),
        ({"obo:synonym": "'nothing'"}, set()),
    ],
)
def test_constraints(spark, fixtures, constraints, expected):
    spec = garden(fixtures, constraints=constraints)
    rows = terms.build_terms(jobs.read_ontology(spark, spec), spec).collect()
    assert {r.term.rpartition("#")[2] for r in rows} == expected


def test_caps_are_exact(spark, fixtures):
    spec = garden(fixtures)
    rows = terms.build_terms(jobs.read_ontology(spark, spec), spec, cap=2).collect()
    assert sorted(r.term.rpartition("#")[2] for r in rows) == ["MyRose", "Plant"]


def test_ancestors_of_owl(spark, fixtures):
    rows = jobs.subclass_ancestors(jobs.read_ontology(spark, garden(fixtures)), "http://example.org/garden#").collect()
    assert {(r.term.rpartition("#")[2], r.ancestor.rpartition("#")[2]) for r in rows} == {
        ("Shrub", "Plant"), ("Rose", "Shrub"), ("Rose", "Plant"),
    }


def test_ntriples(spark, fixtures):
    triples = rdf.read_ntriples(spark, f"{fixtures}/ontologies/mesh.nt")
    rows = {(r.s.rpartition("/")[2], r.p.rpartition("#")[2]): r for r in triples.collect()}
    assert triples.count() == 11
    assert rows[("M01", "label")].o == 'Calcium "ion"' and rows[("M01", "label")].lang == "en"
    assert rows[("M01", "scopeNote")].o == "A café note\\ with \t tab.\n"
    assert rows[("M01", "active")].datatype == "http://www.w3.org/2001/XMLSchema#boolean"
    assert rows[("_:node", "http://example.org/p")].o_kind == "bnode"


def test_mesh_terms_and_links(spark, fixtures):
    spec = OntologySpec(
        "mesh", "mesh_link", "http://id.nlm.nih.gov/mesh/M", f"{fixtures}/ontologies/mesh.nt", "nt", "rdfs:label",
        [f"<{MESHV}scopeNote>"], {"meshv:active": "true", "rdf:type": "meshv:Concept"}, None, {"meshv": MESHV, "rdf": RDF},
    )
    triples = jobs.read_ontology(spark, spec)
    rows = terms.build_terms(triples, spec).collect()
    assert [(r.term.rpartition("/")[2], r.rdfs_label) for r in rows] == [("M01", 'Calcium "ion"')]
    links = terms.concept_links(triples, MESHV)
    assert {tuple(r) for r in links.collect()} == {
        ("M01", "preferredConcept", "D10"), ("M01", "concept", "D11"), ("M02", "concept", "D11"),
    }
    subset = terms.subset_triples(triples, "http://id.nlm.nih.gov/mesh/M", ["vocab#scopeNote", "#label"])
    assert subset.count() == 3
    assert terms.match(triples, s="http://id.nlm.nih.gov/mesh/M02", p=RDF_LABEL).first().o == "Old"


def test_ncbi(spark, fixtures):
    d = f"{fixtures}/taxonomy"
    compiled = taxa.compile_ncbi(
        taxonomy.read_names(spark, f"{d}/names.dmp"), taxonomy.read_nodes(spark, f"{d}/nodes.dmp"), taxonomy.read_divisions(spark, f"{d}/division.dmp")
    )
    rows = {r.term.rpartition("_")[2]: r for r in taxa.ncbi_tags(compiled).collect()}
    assert rows.keys() == {"1", "3", "4"}
    assert rows["3"].description == (
        'Brassica "x" alba is a species whose direct parent taxon is root and the division is Plants and Fungi.'
    )
    assert "parent taxon is  and" in rows["4"].description
    assert [r.rdfs_label for r in taxa.ncbi_tags(compiled, "brassica").collect()] == ['Brassica "x" alba']
    assert taxa.ncbi_tags(compiled, cap=1).count() == 1
    assert {r.name for r in taxonomy.read_compiled_ncbi(spark, f"{d}/ncbi_compile.tsv").collect()} == {"Brassica", "Rosa"}


def test_gbif(spark, fixtures):
    from termweave.spec import TaxonSpec

    spec = TaxonSpec(f"{fixtures}/taxonomy", "brassica")
    rows = {r.term.rpartition("/")[2]: r.description for r in jobs.build_gbif_tags(spark, spec).collect()}
    assert rows == {"21": "colza, rape", "24": ""}
    everything = jobs.build_gbif_tags(spark, TaxonSpec(f"{fixtures}/taxonomy")).collect()
    assert {r.rdfs_label for r in everything} == {"Brassica napus", "Rosa canina", "BRASSICA alba"}


def test_scores_files(spark, tmp_path):
    scores = spark.createDataFrame(
        [("d1", f"t{i:02d}", 0.5 + i / 100) for i in range(30)] + [("d2", "t00", 0.9)], "doi string, tag string, similarity double"
    )
    lines = sinks.scores_json(scores, tags_per_line=8).collect()
    assert len(lines) > 3
    sinks.write_scores_json(scores, str(tmp_path / "lines"))
    back = stores.read_scores_json(spark, str(tmp_path / "lines"))
    assert {tuple(r)[:2] + (r.similarity,) for r in back.select("doi", "tag", "similarity").collect()} == {tuple(r) for r in scores.collect()}
    folder = tmp_path / "objects" / "sub"
    folder.mkdir(parents=True)
    (folder / "a_scores.json").write_text(json.dumps({"d": {"t": 0.5, "u": 0.25}}, indent=1))
    (folder / "b_scores.json").write_text("not json")
    objects = stores.read_scores_json(spark, str(tmp_path / "objects"), "object")
    assert {(r.doi, r.tag, r.similarity) for r in objects.collect()} == {("d", "t", 0.5), ("d", "u", 0.25)}


def test_tag_files_lose_copies_across_files(spark, tmp_path):
    row = {"ontology": "o", "term": "t", "rdfs_label": "l", "description": "", "group": "g"}
    for name, rows in (("a.json", [row, row]), ("b.json", [row, {**row, "term": "u"}])):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows))
    assert sorted(r.term for r in stores.read_tag_json(spark, str(tmp_path)).collect()) == ["t", "u"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("10.1/a", "http://e/T_1", "1", None)], "doi string, topicalDescriptor string, pmid string, reference_id string")
    sinks.write_annotations(df.coalesce(1), str(tmp_path / "csv"))
    text = [f.read_text() for f in (tmp_path / "csv").glob("part*.csv")]
    assert text == ["doi,topicalDescriptor,pmid,reference_id\n10.1/a,http://e/T_1,1,\n"]
    best = spark.createDataFrame([("a", "o", "t", "l", 0.5)], "a string, b string, c string, d string, e double")
    sinks.write_best_similarities(best, str(tmp_path / "best"))
    assert next((tmp_path / "best").glob("part*")).read_text().startswith("DOI,Ontology,Tag,Label,Similarity\n")
    many = spark.range(25).select(F.col("id").cast("string").alias("doi")).coalesce(1)
    sinks.write_abstracts(many, str(tmp_path / "abstracts"), per_file=10)
    assert sorted(len(f.read_text().splitlines()) for f in (tmp_path / "abstracts").glob("part*")) == [5, 10, 10]
    sinks.write_records([spark.range(1).toDF("id"), spark.createDataFrame([("x",)], "name string")], str(tmp_path / "records"))
    assert spark.read.option("header", True).csv(str(tmp_path / "records")).columns == ["id", "name"]
    sinks.write_records([spark.range(2)], str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_embedding_store_replaces_only_its_partition(spark, tmp_path):
    path = str(tmp_path / "store")
    row = "tag string, ontology string, embedding array<float>"
    sinks.write_embeddings(spark.createDataFrame([("a", "o1", [1.0]), ("b", "o2", [2.0])], row), path, "enc", ["ontology"])
    sinks.write_embeddings(spark.createDataFrame([("c", "o1", [3.0])], row), path, "enc", ["ontology"])
    sinks.write_embeddings(spark.createDataFrame([("d", "o1", [4.0])], row), path, "other", ["ontology"])
    assert {r.tag for r in stores.read_embeddings(spark, path, "enc").collect()} == {"b", "c"}
    assert {r.tag for r in stores.read_embeddings(spark, path, "enc", ["o1"]).collect()} == {"c"}


def test_long_escapes(spark):
    written = [r"\U0001F600 \U00000041", r"a \\U0001F600", r"\U00000022 it\'s", r"\\'", r"\U0011FFFF", r"\uD83D\uDE00\n"]
    lines = spark.createDataFrame([(f'<http://e/{i}> <http://e/p> "{text}" .',) for i, text in enumerate(written)], "value string")
    got = {r.s: r.o for r in rdf.parse_statements(lines).collect()}
    want = ["\U0001F600 A", "a \\U0001F600", '" it\'s', "\\'", r"\U0011FFFF", "\U0001F600\n"]
    assert [got[f"http://e/{i}"] for i in range(len(written))] == want


def test_graph_per_file(spark, tmp_path):
    for folder, scores in (("a", {"d": {"t": 0.5, "u": 0.25}}), ("b", {"d": {"t": 0.75}, "e": {}})):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "scores.json").write_text(json.dumps(scores, indent=1))
    paths = [str(tmp_path / f / "scores.json") for f in "ab"]
    jobs.build_graphs(spark, paths, AnnotationSpec(), str(tmp_path / "out"), layout="object")
    rows = spark.read.text(str(tmp_path / "out")).collect()
    graphs = {r.graph for r in rows}
    assert len(graphs) == 2 and all(g.startswith("scores-") for g in graphs)
    assert sorted(sum(r.graph == g for r in rows) for g in graphs) == [11 + 3, 11 + 6]
    totals = sorted(r.value.split('"')[1] for r in rows if "totalTriplets" in r.value)
    assert totals == ["1", "2"]


def test_graph_stores_documents_not_scores(spark, tmp_path, monkeypatch):
    folder, stored = tmp_path / "run", []
    folder.mkdir()
    lines = [
        {"apart": {f"t{i:03}": 0.5 for i in range(50)}},
        {"apart": {f"t{i:03}": 0.5 for i in range(50, 100)}},
        {"met": {"a": 0.5, "c": 0.25}},
        {"met": {"b": 0.5, "c": 0.75}},
        {"none": {}},
    ]
    (folder / "part-0.txt").write_text("\n".join(map(json.dumps, [*lines, *lines[2:4]])))
    (folder / "part-1.txt").write_text('{"twice": {"a": 0.5, "a": 0.25}}\n')
    cut = jobs.cut
    monkeypatch.setattr(jobs, "cut", lambda df: stored.append((df.columns, df.count())) or cut(df))
    jobs.build_graphs(spark, [str(folder)], AnnotationSpec(), str(tmp_path / "out"), compression="gzip", per_file=100)
    assert [n for columns, n in stored if "tag" in columns] == [3 + 1]  # the scores of documents whose lines may share a tag
    files = list((tmp_path / "out").glob("graph=*/part*"))
    assert len(files) > 3 and all(f.name.endswith(".txt.gz") for f in files)
    values = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(values) == len(set(values)) == 11 + 3 * (100 + 3 + 1)
    scores = [v.split('"')[1] for v in values if "similarityScore" in v]
    assert sorted(scores) == ["0.5"] * 103 + ["0.75"]
    assert [v.split('"')[1] for v in values if "totalTriplets" in v or "abstractsProcessed" in v] in (["104", "3"], ["3", "104"])


def test_graphs_leave_the_settings(spark, tmp_path):
    triples = graph.annotation_triples(
        spark.createDataFrame([(f"g{i % 3}", "10.1/a", f"http://e/{i}", 0.5) for i in range(30)], "graph string, doi string, tag string, similarity double"),
        by=["graph"],
    )
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    sinks.write_graphs(triples.coalesce(1), str(tmp_path / "out"))
    (first,) = (tmp_path / "out" / "graph=g0").glob("part*")
    assert len(first.read_text().splitlines()) == 30
    assert len(list((tmp_path / "out").glob("graph=*/part*"))) == 3
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_truth_takes_numbered_files_only(spark, tmp_path):
    for name in ("abstracts_1", "abstracts_22", "abstracts_1x", "my_abstracts_3", "abstracts_"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"doi": name, "descriptor": ["D1"]}))
    for layout in ("auto", "lines"):
        assert {r.doi for r in abstracts.read_truth(spark, str(tmp_path), layout=layout).collect()} == {"abstracts_1", "abstracts_22"}


def test_ntriples_lines(spark, tmp_path):
    scores = spark.createDataFrame([("10.1/a b", 'http://e/T"1', 0.5)], "doi string, tag string, similarity double")
    triples = graph.annotation_triples(scores)
    lines = [r.value for r in graph.ntriples_lines(triples).collect()]
    assert lines[0].startswith("<https://doi.org/10.1/a%20b> <http://purl.org/dc/elements/1.1/subject> _:b")
    assert lines[2].endswith('"0.5"^^<http://www.w3.org/2001/XMLSchema#float> .')
    sinks.write_ntriples(triples, str(tmp_path / "graph"))
    assert rdf.read_ntriples(spark, str(tmp_path / "graph")).count() == 3
    with pytest.raises(ValueError):
        graph.provenance_triples(scores, encoder_name="e", system_name="s", threshold_chunk=0.5, threshold_tag=0.5, method="l1")
    made = graph.provenance_triples(scores, encoder_name="e", system_name="s", threshold_chunk=0.5, threshold_tag=0.5)
    assert made.count() == 11


def test_turtle_prefixes_bound_by_their_file(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix ex: <http://one/> .\nex:A ex:p ex:B .\nown:A a <http://c> .\n")
    (tmp_path / "b.ttl").write_text('PREFIX ex: <http://two/>\nex:A <http://p> "x"@en .\n')
    (tmp_path / "c.ttl").write_text("ex:A ex:p ex:B .\n<http://s> <http://p> <http://o> .\n")
    rows = rdf.read_turtle_lines(spark, str(tmp_path), {"own": "http://own/"}).collect()
    assert sorted((r.s, r.p, r.o, r.lang) for r in rows) == [
        ("http://one/A", "http://one/p", "http://one/B", None),
        ("http://own/A", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://c", None),
        ("http://s", "http://p", "http://o", None),
        ("http://two/A", "http://p", "x", "en"),
    ]


def test_layout_is_decided_by_most_lines_of_a_file(spark, tmp_path):
    from termweave.schemas import ABSTRACTS
    from termweave.sources.abstracts import read_json_records

    files = {
        "first_key_on_opening_line": '{"doi": "a1",\n "title": "t"}\n',
        "array_beside_first_object": '[{"doi": "b1", "title": "t"},\n{"doi": "b2", "title": "t"}]\n',
        "lines_with_a_lone_bracket": '{"doi": "c1"}\n{\n{"doi": "c2"}\n{"doi": "c3"}\n',
        "pretty": '[\n  {\n    "doi": "d1"\n  },\n  {\n    "doi": "d2"\n  }\n]\n',
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = read_json_records(spark, [str(tmp_path)], ABSTRACTS).select("doi").collect()
    assert sorted(r.doi for r in found if r.doi) == ["a1", "b1", "b2", "c1", "c2", "c3", "d1", "d2"]


def test_pubmed_files_of_several_splits(spark, tmp_path):
    """A file is read by several tasks; tags in comments and literal text are none."""
    articles = [
        f"<PubmedArticle>\n<MedlineCitation><PMID>{i}</PMID><Article><ArticleTitle>T {i} <i>x</i></ArticleTitle>"
        f"<Abstract><AbstractText><![CDATA[</PubmedArticle> {i}]]></AbstractText>\n</Abstract></Article></MedlineCitation>\n"
        f"<!-- <PubmedArticle>\n --></PubmedArticle>{'' if i % 2 else chr(10)}"
        for i in range(200)
    ]
    path = tmp_path / "a.xml"
    path.write_text("<?xml version='1.0'?>\n<PubmedArticleSet>" + "".join(articles) + "<PubmedArticle><MedlineCitation><PMID>cut</PMID>")
    plain = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(PUBMED_ARTICLE).load(str(path))
    expected = sorted(str(r) for r in plain.collect())
    assert len(expected) == 201  # one is cut short
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    read = abstracts.read_pubmed_xml(spark, str(path))
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
    got = sorted(str(r) for r in read.collect())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == expected


def test_scores_that_stand_together_are_not_shuffled(spark):
    rows = [(f"d{i // 37:02d}", f"t{i % 37}", i / 1000) for i in range(370)]
    scores = spark.createDataFrame(rows, "doi string, tag string, similarity double").coalesce(1)
    lines = sinks.scores_json(scores, tags_per_line=8, together=True)
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    assert lines.count() == 10 * 5 and max(len(next(iter(json.loads(r.value).values()))) for r in lines.collect()) == 8
    assert sorted(tuple(r) for r in stores.parse_scores(lines).collect()) == sorted(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)  # documents and lines over several batches
    try:
        assert sorted(r.value for r in sinks.scores_json(scores, tags_per_line=8, together=True).collect()) == sorted(r.value for r in lines.collect())
        apart = scores.orderBy("tag").coalesce(1)
        assert sorted(tuple(r) for r in stores.parse_scores(sinks.scores_json(apart, 8, together=True)).collect()) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sinks.scores_json(scores.where("false"), together=True).collect() == []


def test_compressed_annotations_are_small_files_with_the_same_rows(spark, tmp_path):
    df = spark.range(3000).selectExpr(
        "'10.5555/' || id div 300 doi", "'http://example.org/onto/T_' || id % 300 topicalDescriptor", "if(id % 7 = 0, null, id div 300 || '') pmid", "cast(null as string) reference_id"
    )
    plain, packed = tmp_path / "plain", tmp_path / "packed"
    sinks.write_annotations(df.coalesce(1), str(plain))
    sinks.write_annotations(df.coalesce(1), str(packed), compression="gzip", per_file=1000)
    files = list(packed.glob("*.csv.gz"))
    assert len(files) == 3 and not list(plain.glob("*.gz"))
    assert 4 * sum(f.stat().st_size for f in files) < sum(f.stat().st_size for f in plain.glob("*.csv"))
    read = [spark.read.schema(df.schema).option("header", True).csv(str(x)) for x in (plain, packed)]
    assert all(sorted(map(str, r.collect())) == sorted(map(str, df.collect())) for r in read)


def test_annotation_files_writes_compressed(spark, monkeypatch, tmp_path):
    from termweave.workload import reports as queries

    given = {}
    monkeypatch.setattr(queries.sinks, "write_annotations", lambda rows, path, **options: given.update(options))
    monkeypatch.setattr(queries, "vector_abstracts", lambda *_: None)
    monkeypatch.setattr(queries, "scores", lambda *_: None)
    monkeypatch.setattr(queries.annotations, "annotation_rows", lambda *_: None)
    monkeypatch.setattr(queries, "scratch", lambda _: str(tmp_path))
    queries.annotation_files(spark, "")
    assert given["compression"] == "gzip" and given["per_file"] > 0
