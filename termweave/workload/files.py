"""Queries that go through files: the given tables are written in a source's format and read back by its reader."""

import pyarrow as pa
from pyspark.sql import functions as F

from termweave import sinks
from termweave.operators import documents, taxa, terms
from termweave.plans import jobs
from termweave.runtime import spread
from termweave.sources import abstracts, rdf, rdfxml, stores, taxonomy, turtle
from termweave.spec import OWL, RDF, RDFS, AnnotationSpec, TaxonSpec
from termweave.workload.registry import (
    ENCODER,
    SQL_VECTORS,
    document_abstracts,
    query,
    scratch,
    table,
    text_of,
    vector_tags,
)
from termweave.workload.terms import EX, SQL_NCBI, SQL_TAXA, part_spec, reference_lines, taxonomy_tables


def write_pubmed(spark, sf, path):
    """Customers as PubMed articles: two abstract parts, inline markup, several ids, a heading; some lack an abstract or a doi."""
    key, balance = text_of("c_custkey"), F.col("c_acctbal")
    pmid_id = F.struct(key.alias("_VALUE"), F.lit("pubmed").alias("_IdType"))
    doi = F.struct(F.concat(F.lit("10.5555/"), key).alias("_VALUE"), F.lit("doi").alias("_IdType"))
    other = F.struct(F.lit("10.5555/other").alias("_VALUE"), F.lit("doi").alias("_IdType"))
    ids = F.when(balance < 1000, F.array(pmid_id)).otherwise(F.array(pmid_id, doi, other))
    texts = F.array(
        F.struct(F.lit("Customer {i}& of{/i} the").alias("_VALUE"), F.lit("BACKGROUND").alias("_Label")),
        F.struct(F.concat(F.lit("<"), "c_mktsegment", F.lit("> seg{sub}{b}men{/b}{/sub}t.")).alias("_VALUE"), F.lit("RESULTS").alias("_Label")),
    )
    heading = F.struct(
        F.struct(
            F.col("c_mktsegment").alias("_VALUE"), F.concat(F.lit("D"), text_of("c_nationkey")).alias("_UI")
        ).alias("DescriptorName")
    )
    article = F.struct(
        F.concat(F.lit("{i}"), "c_name", F.lit("{/i}")).alias("ArticleTitle"),
        F.when(balance >= 0, F.struct(texts.alias("AbstractText"))).alias("Abstract"),
    )
    rows = spread(table(spark, sf, "customer")).select(
        F.struct(
            key.alias("PMID"), article.alias("Article"), F.struct(F.array(heading).alias("MeshHeading")).alias("MeshHeadingList")
        ).alias("MedlineCitation"),
        F.struct(F.struct(ids.alias("ArticleId")).alias("ArticleIdList")).alias("PubmedData"),
    )
    # The writer escapes markup; braces stand for inline elements until the text is made.
    xml = F.to_xml(F.struct("MedlineCitation", "PubmedData"), {"rowTag": "PubmedArticle"})
    rows.select(F.regexp_replace(xml, r"\{(/?[a-z]+)\}", "<$1>").alias("value")).mapInArrow(_articles, "value string").write.text(path)


def _articles(batches):
    """Every part file is a document of its own."""
    layout = pa.schema([("value", pa.string())])
    yield pa.RecordBatch.from_pydict({"value": ["<PubmedArticleSet>"]}, schema=layout)
    for batch in batches:
        yield pa.RecordBatch.from_arrays(batch.columns, schema=layout)
    yield pa.RecordBatch.from_pydict({"value": ["</PubmedArticleSet>"]}, schema=layout)


SQL_ARTICLES = """
a AS (
  SELECT c_custkey, c_name AS title, 'Customer & of the<' || c_mktsegment || '> segment.' AS abstract,
         CASE WHEN c_acctbal >= 1000 THEN '10.5555/' || c_custkey END AS doi, c_custkey::VARCHAR AS pmid,
         'D' || c_nationkey AS descriptor
  FROM customer WHERE c_acctbal >= 0)"""


@query("pubmed_articles", f"WITH {SQL_ARTICLES} SELECT title, abstract, doi, pmid, descriptor FROM a WHERE doi IS NOT NULL")
def pubmed_articles(spark, sf):
    path = scratch(spark)
    write_pubmed(spark, sf, path)
    flat = documents.articles_to_abstracts(abstracts.read_pubmed_xml(spark, path))
    return documents.usable_articles(flat).withColumn("descriptor", F.array_join("descriptor", ","))


@query(
    "pubmed_export",
    f"""WITH {SQL_ARTICLES} SELECT title, abstract, doi, pmid, page_id::VARCHAR AS reference_id
    FROM a JOIN pages ON page_id = c_custkey WHERE doi IS NOT NULL""",
)
def pubmed_export(spark, sf):
    """Articles joined with the identifier statements of another source, by doi."""
    folder = scratch(spark)
    write_pubmed(spark, sf, f"{folder}/xml")
    reference_lines(spark, sf).write.text(f"{folder}/references")
    return jobs.export_pubmed(spark, f"{folder}/xml", f"{folder}/references", {"dcterms": "http://purl.org/dc/terms/"})


def write_owl(spark, sf, path):
    """Parts as RDF/XML classes with relative ids, two languages, two synonyms and a parent."""

    def element(name, value, lang=""):
        return F.concat(F.lit(f"  <{name}{lang}>"), value, F.lit(f"</{name}>"))

    name = F.col("p_name")
    classes = table(spark, sf, "part").select(
        F.concat_ws(
            "\n",
            F.concat(F.lit('<owl:Class rdf:about="#P_'), text_of("p_partkey"), F.lit('">')),
            element("rdfs:label", name, ' xml:lang="en"'),
            element("rdfs:label", F.concat(F.lit("fr "), name), ' xml:lang="fr"'),
            F.concat(F.lit(f'  <rdfs:subClassOf rdf:resource="{EX}type/'), "p_type", F.lit('"/>')),
            element("ex:note", F.concat(F.lit("Made by "), "p_brand", F.lit("."))),
            element("ex:synonym", F.col("p_type")),
            element("ex:synonym", F.concat(F.lit("a "), name)),
            F.lit("</owl:Class>"),
        ).alias("value")
    )
    head = (
        f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:rdfs="{RDFS}" xmlns:owl="{OWL}" xmlns:ex="{EX}"'
        ' xml:base="http://example.org/parts">'
    )

    def as_document(batches):
        """Every part file is a document of its own."""
        layout = pa.schema([("value", pa.string())])
        yield pa.RecordBatch.from_pydict({"value": [head]}, schema=layout)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, schema=layout)
        yield pa.RecordBatch.from_pydict({"value": ["</rdf:RDF>"]}, schema=layout)

    classes.mapInArrow(as_document, "value string").write.text(path)


@query(
    "owl_tags",
    """SELECT 'http://example.org/parts#P_' || p_partkey AS term, p_name AS rdfs_label,
    'Made by ' || p_brand || '. ' || p_type || '. a ' || p_name || '.' AS description FROM part""",
)
def owl_tags(spark, sf):
    path = scratch(spark)
    write_owl(spark, sf, path)
    spec = part_spec(prefix="http://example.org/parts#", path=path)
    return jobs.build_owl_tags(spark, AnnotationSpec(ontologies=[spec])).select("term", "rdfs_label", "description")


@query(
    "owl_triples",
    """SELECT 'http://example.org/parts#P_' || p_partkey AS s, unnest(['label', 'label', 'subClassOf', 'type']) AS p,
    unnest([p_name, 'fr ' || p_name, 'http://example.org/type/' || p_type, 'http://www.w3.org/2002/07/owl#Class']) AS o,
    unnest(['literal', 'literal', 'iri', 'iri']) AS o_kind, unnest(['en', 'fr', NULL, NULL]) AS lang FROM part""",
)
def owl_triples(spark, sf):
    path = scratch(spark)
    write_owl(spark, sf, path)
    return rdf.read_owl(spark, path).select("s", F.substring_index("p", "#", -1).alias("p"), "o", "o_kind", "lang")


def framed(head, tail):
    """Every part file is a document of its own."""
    layout = pa.schema([("value", pa.string())])

    def run(batches):
        yield pa.RecordBatch.from_pydict({"value": [head]}, schema=layout)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, schema=layout)
        yield pa.RecordBatch.from_pydict({"value": [tail]}, schema=layout)

    return run


def write_concepts(spark, sf, folder):
    """Parts as concepts of two bases: entities, literals in attributes, a node inside a property; every seventh has an unknown entity."""
    key = text_of("p_partkey")
    concept = F.concat(
        F.lit('<skos:Concept rdf:about="#P_'), key, F.lit('" skos:notation="'), key, F.lit('"><!-- <p> -->\n<skos:prefLabel>'), F.col("p_name"),
        F.lit(" &amp; &co;\n"), F.when(F.col("p_partkey") % 7 == 0, "&nope;").otherwise(""), F.lit("</skos:prefLabel><skos:broader\n><t:"),
        F.lit("Type rdf:about='&ex;type/"), F.col("p_type"), F.lit("'/></skos:broader></skos:Concept>"),
    )
    for i in range(2):
        head = (
            f'<?xml version="1.0"?>\n<!DOCTYPE rdf:RDF [ <!ENTITY co "Base > {i}">\n<!ENTITY ex "{EX}"> ]>\n<rdf:RDF xmlns:rdf="{RDF}"'
            f' xmlns:skos="http://www.w3.org/2004/02/skos/core#"\n xmlns:t="&ex;kinds{i}#" xml:base="http://example.org/base{i}" xml:lang="en">'
        )
        rows = table(spark, sf, "part").where(F.col("p_partkey") % 2 == i).select(concept.alias("value"))
        rows.mapInArrow(framed(head, "</rdf:RDF>"), "value string").write.text(f"{folder}/{i}")


@query(
    "owl_elements",
    f"""WITH p AS (SELECT *, 'http://example.org/base' || p_partkey % 2 || '#P_' || p_partkey AS s FROM part WHERE p_partkey % 7 <> 0)
    SELECT s, unnest(['type', 'notation', 'prefLabel', 'broader']) AS p,
           unnest(['http://www.w3.org/2004/02/skos/core#Concept', p_partkey::VARCHAR,
                   p_name || ' & Base > ' || p_partkey % 2 || chr(10), '{EX}type/' || p_type]) AS o,
           unnest(['iri', 'literal', 'literal', 'iri']) AS o_kind, unnest([NULL, 'en', 'en', NULL]) AS lang FROM p
    UNION ALL SELECT '{EX}type/' || p_type, 'type', '{EX}kinds' || p_partkey % 2 || '#Type', 'iri', NULL FROM p""",
)
def owl_elements(spark, sf):
    """All triples of RDF/XML files with tables of symbols of their own."""
    path = scratch(spark)
    write_concepts(spark, sf, path)
    triples = rdfxml.read_rdfxml(spark, [f"{path}/0", f"{path}/1"])
    return triples.select("s", F.substring_index("p", "#", -1).alias("p"), "o", "o_kind", "lang")


@query(
    "owl_rejects",
    """SELECT 'P_' || p_partkey AS node, 'undefined entity' AS reason FROM part WHERE p_partkey % 7 = 0""",
)
def owl_rejects(spark, sf):
    """The elements that could not be read."""
    path = scratch(spark)
    write_concepts(spark, sf, path)
    bad = rdfxml.rdfxml_elements(spark, [f"{path}/0", f"{path}/1"]).where("reason IS NOT NULL")
    return bad.select(F.regexp_extract("element", "#(P_\\d+)", 1).alias("node"), F.substring_index("reason", ":", 1).alias("reason"))


def write_turtle(spark, sf, path):
    """Documents as statements over several lines; every eleventh uses a prefix that nobody binds."""
    key = text_of("doc_id")
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    good = F.concat(
        F.lit("d:"), key, F.lit(" a ex:Text , <#document> ; # a comment. \"open\n  ex:chars "), F.length("text").cast("string"),
        F.lit(';\n  ex:body """'), text, F.lit('"""@x-prose ;\n  ex:origin [ ex:name "'), F.coalesce("source", F.lit("")), F.lit('" ] .'),
    )
    bad = F.concat(F.lit("d:"), key, F.lit(' nope:p "x" .'))
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select(F.when(F.col("doc_id") % 11 == 0, bad).otherwise(good).alias("value"))
    head = f"@prefix d: <{EX}doc/> .\nPREFIX ex: <{EX}>\n@base <{EX}base> ."
    rows.mapInArrow(framed(head, "# end"), "value string").write.text(path)


@query(
    "turtle_statements",
    f"""WITH d AS (SELECT * FROM documents WHERE text IS NOT NULL AND doc_id % 11 <> 0)
    SELECT '{EX}doc/' || doc_id AS s, unnest(['type', 'type', 'chars', 'body']) AS p,
           unnest(['{EX}Text', '{EX}base#document', length(text)::VARCHAR, text]) AS o, unnest(['iri', 'iri', 'literal', 'literal']) AS o_kind,
           unnest([NULL, NULL, NULL, 'x-prose']) AS lang, unnest([NULL, NULL, 'integer', NULL]) AS datatype FROM d
    UNION ALL SELECT '{EX}doc/' || doc_id, 'name', coalesce(source, ''), 'literal', NULL, NULL FROM d""",
)
def turtle_statements(spark, sf):
    """Documents to Turtle and back; the blank node between a document and its origin is joined away."""
    path = scratch(spark)
    write_turtle(spark, sf, path)
    triples = turtle.read_turtle(spark, path)
    owner = triples.where("o_kind = 'bnode'").select(F.col("o").alias("s"), F.col("s").alias("owner"))
    named = triples.where("o_kind <> 'bnode'").join(owner, "s", "left").withColumn("s", F.coalesce("owner", "s"))
    local = F.regexp_extract("p", "[^/#]*$", 0)
    return named.select("s", local.alias("p"), "o", "o_kind", "lang", F.substring_index("datatype", "#", -1).alias("datatype"))


@query(
    "turtle_rejects",
    """SELECT 'd:' || doc_id || ' nope:p "x" .' AS statement, 'prefix ''nope'' is not bound' AS reason
    FROM documents WHERE text IS NOT NULL AND doc_id % 11 = 0""",
)
def turtle_rejects(spark, sf):
    """The statements that could not be read."""
    path = scratch(spark)
    write_turtle(spark, sf, path)
    bad = turtle.turtle_statements(spark, path).where("reason IS NOT NULL")
    return bad.select(F.trim("statement", F.lit(" \n")).alias("statement"), "reason")


def write_ncbi_dump(spark, sf, folder):
    names, nodes, divisions = taxonomy_tables(spark, sf)

    def lines(df, *columns):
        return df.select(F.concat(F.concat_ws("\t|\t", *columns), F.lit("\t|")).alias("value"))

    synonyms = names.select("tax_id", F.concat(F.lit("syn "), "name").alias("name"), F.lit("synonym").alias("kind"))
    every = names.withColumn("kind", F.lit("scientific name")).unionByName(synonyms)
    lines(every, "tax_id", "name", F.lit(""), "kind").write.text(f"{folder}/names.dmp")
    lines(nodes, "tax_id", "parent_tax_id", "rank", F.lit("XX"), "division_id").write.text(f"{folder}/nodes.dmp")
    lines(divisions, "division_id", F.lit("COD"), "division").write.text(f"{folder}/division.dmp")


@query("ncbi_dump_tags", f"WITH {SQL_TAXA} {SQL_NCBI}")
def ncbi_dump_tags(spark, sf):
    folder = scratch(spark)
    write_ncbi_dump(spark, sf, folder)
    return jobs.build_ncbi_tags(spark, TaxonSpec(folder)).select("term", "rdfs_label", "description")


@query(
    "ncbi_compiled_file",
    f"""WITH {SQL_TAXA}
    SELECT substr(t.id, 2)::BIGINT AS tax_id, t.name, coalesce(p.name, '') AS parent_tax,
           t.rank, lower(t.division) AS division
    FROM taxa t LEFT JOIN taxa p ON p.id = t.parent""",
)
def ncbi_compiled_file(spark, sf):
    """The whole compiled table to a file and back; ids are numbers there."""
    path = scratch(spark)
    compiled = taxa.compile_ncbi(*taxonomy_tables(spark, sf))
    sinks.write_compiled_ncbi(compiled.withColumn("tax_id", F.substring("tax_id", 2, 20)), path)
    return taxonomy.read_compiled_ncbi(spark, path)


SQL_GBIF = """SELECT 'https://www.gbif.org/species/' || n_nationkey AS term, n_name AS rdfs_label,
    coalesce((SELECT string_agg(s_name, ', ' ORDER BY s_name) FROM supplier WHERE s_nationkey = n_nationkey), '') AS description
    FROM nation"""


@query("gbif_file_tags", SQL_GBIF)
def gbif_file_tags(spark, sf):
    """Full dump files with headers and short rows."""
    folder = scratch(spark)
    write_gbif_dump(spark, sf, folder)
    taxa_rows = taxonomy.read_gbif_taxa(spark, f"{folder}/Taxon.tsv", raw=True)
    vernacular = taxonomy.read_gbif_vernacular(spark, f"{folder}/VernacularName.tsv")
    return taxa.gbif_tags(taxa_rows, vernacular).select("term", "rdfs_label", "description")


@query("gbif_dump_job", SQL_GBIF + " WHERE contains(lower(n_name), 'ation_1')")
def gbif_dump_job(spark, sf):
    """The job over a folder that has the dump's own files only."""
    folder = scratch(spark)
    write_gbif_dump(spark, sf, folder)
    return jobs.build_gbif_tags(spark, TaxonSpec(folder, "ation_1")).select("term", "rdfs_label", "description")


@query("gbif_extract_job", SQL_GBIF)
def gbif_extract_job(spark, sf):
    """The job over two-column extracts; the dump's files beside them are not read."""
    folder = scratch(spark)
    write_gbif_dump(spark, sf, folder)
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    nation.select(F.concat_ws("\t", text_of("n_nationkey"), "n_name").alias("value")).write.text(f"{folder}/taxon_own.tsv")
    supplier.select(F.concat_ws("\t", text_of("s_nationkey"), "s_name").alias("value")).write.text(f"{folder}/names_own.tsv")
    spec = TaxonSpec(folder, taxon_file="taxon_own.tsv", vernacular_file="names_own.tsv")
    return jobs.build_gbif_tags(spark, spec).select("term", "rdfs_label", "description")


def write_gbif_dump(spark, sf, folder):
    head = spark.range(1).select(F.lit("taxonID\tdatasetID\tx\ty\tz\tscientificName\trank").alias("value"))
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    full = nation.select(F.concat_ws("\t", text_of("n_nationkey"), *[F.lit("-")] * 4, "n_name", F.lit("nation")).alias("value"))
    short = nation.select(F.concat_ws("\t", text_of("n_nationkey"), F.lit("too short")).alias("value"))
    head.unionByName(full).unionByName(short).write.text(f"{folder}/Taxon.tsv")
    names_head = spark.range(1).select(F.lit("taxonID\tvernacularName\tlanguage").alias("value"))
    names = supplier.select(F.concat_ws("\t", text_of("s_nationkey"), "s_name", F.lit("en")).alias("value"))
    names_head.unionByName(names).write.text(f"{folder}/VernacularName.tsv")


@query(
    "embedding_store",
    f"WITH {SQL_VECTORS} SELECT tag, ontology, label, len(v)::INTEGER AS width, round(v[1], 6) AS first_value FROM tags",
)
def embedding_store(spark, sf):
    """Tag vectors to the partitioned store and back."""
    path = scratch(spark)
    sinks.write_embeddings(vector_tags(spark, sf), path, ENCODER.name, ["ontology"])
    stored = stores.read_embeddings(spark, path, ENCODER.name)
    first = F.get("embedding", F.lit(0)).cast("double")
    return stored.select(
        "tag", "ontology", "label", F.size("embedding").alias("width"), F.round(first, 6).alias("first_value")
    )


@query(
    "tag_files",
    "SELECT 'parts' AS ontology, p_partkey::VARCHAR AS term, p_name AS rdfs_label, p_type || ', \"' || p_brand || '\"' AS description FROM part",
)
def tag_files(spark, sf):
    """Tags to CSV folders by ontology and back."""
    path = scratch(spark)
    tags = table(spark, sf, "part").select(
        F.lit("parts").alias("ontology"),
        text_of("p_partkey").alias("term"),
        F.col("p_name").alias("rdfs_label"),
        F.concat("p_type", F.lit(', "'), "p_brand", F.lit('"')).alias("description"),
    )
    sinks.write_tags(tags, path)
    layout = "term string, rdfs_label string, description string, ontology string"
    return spark.read.schema(layout).option("header", True).option("escape", '"').csv(path)


@query(
    "abstract_files_mixed",
    "SELECT '10.5555/' || doc_id AS doi, length(text) AS chars FROM documents UNION ALL SELECT '10.5556/' || item_id, length(text) FROM benchmark",
)
def abstract_files_mixed(spark, sf):
    """JSON lines next to a file per passage with one array on a single line."""
    folder = scratch(spark)
    document_abstracts(spark, sf).select("doi", "title", "abstract").write.json(f"{folder}/lines")
    passage = F.struct(F.concat(F.lit("10.5556/"), text_of("item_id")).alias("doi"), F.col("text").alias("abstract"))
    arrays = table(spark, sf, "benchmark").select(F.to_json(F.array(passage)).alias("value"))
    arrays.write.text(f"{folder}/arrays")
    read = abstracts.read_abstracts(spark, [f"{folder}/lines", f"{folder}/arrays", f"{folder}/missing"])
    return read.select("doi", F.length("abstract").cast("long").alias("chars"))


BROKEN = {
    3: ('{"doi": "10.5555/%s", "title": "cut', "cut short or malformed"),
    4: ('{"doi": "10.5555/%s"', "cut short or malformed"),
    5: ("no record of %s", "not an object"),
}


def write_cut_lines(spark, sf, path):
    """Documents as JSON lines; beside some of them a line that was cut short or is no JSON, beside others a record without a title."""
    key, broken = text_of("doc_id"), F.lit(None).cast("string")
    for rest, (text, _) in BROKEN.items():
        head, tail = text.split("%s")
        broken = F.when(F.col("doc_id") % 6 == rest, F.concat(F.lit(head), F.col("key"), F.lit(tail))).otherwise(broken)
    untitled = F.concat(F.lit('{"doi":"10.5557/'), "key", F.lit('","abstract":"a"}'))
    broken = F.when(F.col("doc_id") % 6 == 2, untitled).otherwise(broken)
    rows = document_abstracts(spark, sf).where("abstract IS NOT NULL").withColumn("key", key)
    rows = rows.select(F.array(F.to_json(F.struct("doi", "title", "abstract")), broken).alias("lines"))
    rows.select(F.explode("lines").alias("value")).where("value IS NOT NULL").write.text(path)


@query(
    "abstract_files_cut",
    """SELECT '10.5555/' || doc_id AS doi, length(text) AS chars FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT '10.5557/' || doc_id, 1 FROM documents WHERE text IS NOT NULL AND doc_id % 6 = 2""",
)
def abstract_files_cut(spark, sf):
    """The records of files half of whose lines are broken."""
    path = scratch(spark)
    write_cut_lines(spark, sf, path)
    return abstracts.read_abstracts(spark, path).select("doi", F.length("abstract").cast("long").alias("chars"))


@query(
    "abstract_rejects",
    " UNION ALL ".join(
        f"""SELECT '{text.replace("%s", "' || doc_id || '")}' AS text, '{reason}' AS reason FROM documents WHERE text IS NOT NULL AND doc_id % 6 = {rest}"""
        for rest, (text, reason) in BROKEN.items()
    )
    + """ UNION ALL SELECT '{"abstract":"a","doi":"10.5557/' || doc_id || '"}', 'without title' FROM documents WHERE text IS NOT NULL AND doc_id % 6 = 2
    UNION ALL SELECT 'blank', CASE WHEN regexp_matches(text, '[^\t-\r\x1c-\x20\x85\p{Z}]') THEN 'without title' ELSE 'without title, abstract' END
    FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(split_part(text, chr(10), 1), '[^\t-\r\x1c-\x20\x85\p{Z}]')""",
)
def abstract_rejects(spark, sf):
    """What is no record or has no title or abstract, with the reason."""
    path = scratch(spark)
    write_cut_lines(spark, sf, path)
    found = jobs.abstract_rejects(abstracts.abstract_records(spark, path))
    whole = F.contains("text", F.lit('"doi":"10.5555/'))
    return found.select(F.when(whole, "blank").otherwise(F.col("text")).alias("text"), "reason")


@query(
    "tag_rejects",
    """SELECT p_partkey::VARCHAR AS term FROM part WHERE p_partkey % 5 = 0""",
)
def tag_rejects(spark, sf):
    """Tags without label and description, as the workflow lists them, from the files that tags are kept in."""
    path = scratch(spark)
    empty = F.when(F.col("p_partkey") % 5 == 0, " ")
    tags = table(spark, sf, "part").select(
        F.lit("parts").alias("ontology"), text_of("p_partkey").alias("term"), F.coalesce(empty, "p_name").alias("rdfs_label"), empty.alias("description")
    )
    sinks.write_tags(tags, path)
    layout = "term string, rdfs_label string, description string, ontology string"
    stored = spark.read.schema(layout).option("header", True).option("escape", '"').csv(path)
    return terms.reject_empty(stored)[1].select("term")
