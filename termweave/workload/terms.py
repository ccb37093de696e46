"""Queries over triples and taxonomies derived from the relational tables."""

from pyspark.sql import functions as F

from termweave.functions import text as tx
from termweave.operators import closure, documents, graph, taxa, terms
from termweave.plans import jobs
from termweave.runtime import cut, spread
from termweave.sinks import union_frames
from termweave.sources import rdf
from termweave.spec import RDF, RDF_LABEL, RDFS, SUBCLASS_OF, OntologySpec
from termweave.workload.registry import query, table, text_of

EX = "http://example.org/"
MESH_VOCAB = "http://id.nlm.nih.gov/mesh/vocab#"


def _statement(s, p, o, kind="literal", lang=None):
    none = F.lit(None).cast("string")
    return F.struct(
        s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"),
        (none if lang is None else lang).alias("lang"), none.alias("datatype"),
    )


def part_triples(spark, sf):
    """Parts as ontology terms: label, note, two synonyms, an IRI-valued synonym, type, state and class."""
    name, size = F.col("p_name"), F.col("p_size")
    s = F.concat(F.lit(EX + "part/P_"), text_of("p_partkey"))
    label = F.when(size == 50, F.concat(F.lit("obsolete "), name)).otherwise(F.concat(name, F.lit(" \t")))
    lang = F.when(size <= 5, "fr").when(size <= 20, "en").otherwise("")
    note = F.concat(
        F.when(size == 49, "OBSOLETE size ").otherwise("Size "), F.lit("(SZ:"), text_of("p_size"), F.lit(") of "), name, F.lit("..")
    )
    rows = F.array(
        _statement(s, RDF_LABEL, label, lang=lang),
        _statement(s, EX + "note", note, lang=F.when(size % 3 == 0, "de").otherwise("en")),
        _statement(s, EX + "synonym", F.concat_ws(" ", "p_brand", "p_type")),
        _statement(s, EX + "synonym", F.concat(F.lit("a "), name, F.lit("."))),
        _statement(s, EX + "synonym", F.concat(F.lit(EX), "p_brand"), "iri"),
        _statement(s, RDF + "type", F.lit(EX + "Part"), "iri"),
        _statement(s, EX + "active", F.when(size > 10, "true").otherwise("false")),
        _statement(s, SUBCLASS_OF, F.concat(F.lit(EX + "type/"), "p_type"), "iri"),
    )
    kinds = table(spark, sf, "part").select("p_type").distinct()
    above = kinds.select(
        F.concat(F.lit(EX + "type/"), "p_type").alias("s"),
        F.lit(SUBCLASS_OF).alias("p"),
        F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), EX + "type/PLAIN").otherwise(EX + "type/FANCY").alias("o"),
        F.lit("iri").alias("o_kind"),
        F.lit(None).cast("string").alias("lang"),
        F.lit(None).cast("string").alias("datatype"),
    )
    return table(spark, sf, "part").select(F.inline(rows)).unionByName(above)


def part_spec(**changes):
    fields = {
        "name": "parts",
        "group": "catalogue",
        "prefix": EX + "part/",
        "label": "rdfs:label",
        "properties": ["ex:note", "<" + EX + "synonym>"],
        "prefixes": {"ex": EX, "rdfs": RDFS, "rdf": RDF},
    }
    return OntologySpec(**{**fields, **changes})


SQL_PARTS = """
p AS (
  SELECT *, 'http://example.org/part/P_' || p_partkey AS term,
         CASE WHEN p_size = 50 THEN 'obsolete ' || p_name ELSE p_name END AS label,
         CASE WHEN p_size % 3 = 0 THEN '' ELSE
              CASE WHEN p_size = 49 THEN 'OBSOLETE size ' ELSE 'Size ' END || '(SZ:' || p_size || ') of ' || p_name END AS note,
         p_brand || ' ' || p_type AS syn1, 'a ' || p_name || '.' AS syn2
  FROM part),
named AS (SELECT * FROM p WHERE p_size > 5),
current_parts AS (
  SELECT * FROM named WHERE NOT contains(label, 'obsolete') AND NOT (contains(lower(note), 'obsolete')))"""

SQL_TAGS = r"""
tags AS (
  SELECT 'parts' AS ontology, term, label AS rdfs_label, p_size, p_type,
         regexp_replace(CASE WHEN note = '' THEN '' ELSE note || '. ' END || syn1 || '. ' || rtrim(syn2, '.') || '.',
                        '\([A-Z]+:\d+\)', '', 'g') AS description
  FROM current_parts)"""


@query("build_terms", f"WITH {SQL_PARTS}, {SQL_TAGS} SELECT ontology, term, rdfs_label, description FROM tags")
def build_terms(spark, sf):
    return terms.build_terms(part_triples(spark, sf), part_spec()).drop("group")


@query(
    "constrained_terms",
    f"""WITH {SQL_PARTS}, {SQL_TAGS} SELECT ontology, term, rdfs_label, description FROM tags
    WHERE p_size > 10 AND p_type IN ('ECONOMY', 'STANDARD')""",
)
def constrained_terms(spark, sf):
    constraints = {"ex:active": "true", "rdf:type": "ex:Part", "rdfs:subClassOf*": f"<{EX}type/PLAIN>"}
    return terms.build_terms(cut(part_triples(spark, sf)), part_spec(constraints=constraints)).drop("group")


@query(
    "selected_prefix_terms",
    f"""WITH {SQL_PARTS} SELECT term, label AS rdfs_label FROM current_parts
    WHERE starts_with(term, 'http://example.org/part/P_1')""",
)
def selected_prefix_terms(spark, sf):
    """The second, narrower prefix of a specification."""
    spec = part_spec(properties=["ex:note"], selected_prefix_term=EX + "part/P_1")
    return terms.build_terms(part_triples(spark, sf), spec).select("term", "rdfs_label")


@query(
    "optional_properties",
    f"""WITH {SQL_PARTS} SELECT term, CASE WHEN note <> '' THEN note || '..' END AS note,
    syn1 || '. ' || rtrim(syn2, '.') || '.' AS synonyms FROM named""",
)
def optional_properties(spark, sf):
    triples = part_triples(spark, sf)
    rows = terms.optional_properties(terms.labels(triples), triples, [EX + "note", EX + "synonym"])
    return rows.select("term", F.col("prop0").alias("note"), F.col("prop1").alias("synonyms"))


@query(
    "optional_properties_cross",
    f"""WITH {SQL_PARTS} SELECT term, CASE WHEN note <> '' THEN note || '..' END AS note, unnest([syn1, syn2]) AS synonym
    FROM named""",
)
def optional_properties_cross(spark, sf):
    triples = part_triples(spark, sf)
    rows = terms.optional_properties(terms.labels(triples), triples, [EX + "note", EX + "synonym"], multi="cross")
    return rows.select("term", F.col("prop0").alias("note"), F.col("prop1").alias("synonym"))


@query("drop_obsolete", f"WITH {SQL_PARTS} SELECT p_partkey, label, note FROM p WHERE NOT contains(label, 'obsolete') AND NOT contains(lower(note), 'obsolete')")
def drop_obsolete(spark, sf):
    name, size = F.col("p_name"), F.col("p_size")
    start = F.when(size == 49, "OBSOLETE size ").otherwise("Size ")
    note = F.concat(start, F.lit("(SZ:"), text_of("p_size"), F.lit(") of "), name)
    parts = table(spark, sf, "part").select(
        "p_partkey",
        F.when(size == 50, F.concat(F.lit("obsolete "), name)).otherwise(name).alias("label"),
        F.when(size % 3 == 0, "").otherwise(note).alias("note"),
    )
    return parts.where(~tx.mentions_obsolete(F.col("label"), F.col("note")))


@query(
    "clean_description",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(
      rtrim(text, '.') || ' (AB:' || n_chars || ')() x. ' || rtrim(source || '...', '.') || '.', '\([A-Z]+:\d+\)', '', 'g'),
      '\(\)', '', 'g')) AS digest
    FROM documents""",
)
def clean_description(spark, sf):
    """Whole documents as property values: trailing dots, joining, inline ids, empty parentheses."""
    docs = table(spark, sf, "documents")
    value = F.concat(F.rtrim("text", F.lit(".")), F.lit(" (AB:"), text_of("n_chars"), F.lit(")() x.."))
    text = tx.describe(value, F.lit(""), F.lit(None).cast("string"), F.concat("source", F.lit("...")))
    return docs.select("doc_id", F.md5(tx.strip_obo_ids(F.concat(_lead(value), text))).alias("digest"))


def _lead(text):
    """White space at the start of a text, which ``describe`` strips."""
    return F.regexp_extract(text, f"^({tx.WHITE_SPACE}*)", 1)


@query(
    "cap_terms",
    """SELECT p_type AS ontology, term FROM (
      SELECT p_type, 'http://example.org/part/P_' || p_partkey AS term,
             row_number() OVER (PARTITION BY p_type ORDER BY 'http://example.org/part/P_' || p_partkey) AS n FROM part)
    WHERE n <= 7""",
)
def cap_terms(spark, sf):
    tags = table(spark, sf, "part").select(
        F.col("p_type").alias("ontology"),
        F.concat(F.lit(EX + "part/P_"), text_of("p_partkey")).alias("term"),
        F.col("p_name").alias("rdfs_label"),
        F.col("p_brand").alias("description"),
    )
    return terms.cap_terms(tags, 7).select("ontology", "term")


def _store(df, key, label, description, ontology):
    return df.select(
        F.lit(ontology).alias("ontology"),
        F.concat(F.lit(EX + "thing/"), text_of(key)).alias("term"),
        F.col(label).alias("rdfs_label"),
        F.col(description).alias("description"),
        F.lit("things").alias("group"),
    )


def _stores(spark, sf):
    return (
        _store(table(spark, sf, "part"), "p_size", "p_name", "p_type", "parts"),
        _store(table(spark, sf, "customer"), "c_custkey", "c_name", "c_mktsegment", "customers"),
        _store(table(spark, sf, "supplier"), "s_suppkey", "s_name", "s_name", "suppliers"),
    )


SQL_STORES = """
stores AS (
  SELECT 0 AS r, 'parts' AS ontology, p_size AS k, p_name AS rdfs_label, p_type AS description FROM part
  UNION ALL SELECT 1, 'customers', c_custkey, c_name, c_mktsegment FROM customer
  UNION ALL SELECT 2, 'suppliers', s_suppkey, s_name, s_name FROM supplier)"""


@query(
    "merge_tags",
    f"""WITH {SQL_STORES} SELECT 'http://example.org/thing/' || k AS term, ontology, rdfs_label, description FROM (
      SELECT *, row_number() OVER (PARTITION BY k ORDER BY r DESC, description DESC, rdfs_label DESC) AS n FROM stores)
    WHERE n = 1""",
)
def merge_tags(spark, sf):
    return terms.merge_tags(*_stores(spark, sf)).drop("group")


@query(
    "distinct_tags",
    f"""WITH {SQL_STORES} SELECT DISTINCT 'http://example.org/thing/' || k AS term, ontology, rdfs_label, description
    FROM stores""",
)
def distinct_tags(spark, sf):
    parts, customers, suppliers = _stores(spark, sf)
    return terms.distinct_tags(parts.unionByName(customers).unionByName(suppliers)).drop("group")


@query(
    "union_records",
    """SELECT p_partkey AS id, p_name AS name, p_brand AS brand, NULL::DOUBLE AS balance FROM part
    UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""",
)
def union_records(spark, sf):
    parts = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_name AS name", "p_brand AS brand")
    suppliers = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance")
    return union_frames([parts, suppliers])


@query(
    "reject_empty_tags",
    "SELECT (p_size > 3) AS usable, count(*) AS n FROM part GROUP BY p_size > 3",
)
def reject_empty_tags(spark, sf):
    parts = table(spark, sf, "part").select(
        F.when(F.col("p_size") > 2, F.lit(" ")).otherwise(F.lit("")).alias("description"),
        F.when(F.col("p_size") > 3, F.col("p_name")).alias("rdfs_label"),
    )
    usable, rejected = terms.reject_empty(parts)
    both = usable.withColumn("usable", F.lit(True)).unionByName(rejected.withColumn("usable", F.lit(False)))
    return both.groupBy("usable").agg(F.count("*").alias("n"))


@query(
    "match_triples",
    """SELECT 'http://example.org/part/P_' || p_partkey AS s, 'http://example.org/active' AS p FROM part WHERE p_size > 10""",
)
def match_triples(spark, sf):
    found = terms.match(part_triples(spark, sf), p=[EX + "active", EX + "inactive"], o="true")
    return found.select("s", "p")


# Taxonomies


def taxonomy_tables(spark, sf):
    """Regions, nations and customers as one taxonomy; the market segment is the division of a customer."""
    customer, nation, region = (table(spark, sf, t) for t in ("customer", "nation", "region"))

    def rows(df, key, name, parent, rank, division):
        return df.select(
            key.alias("tax_id"), F.col(name).alias("name"), parent.alias("parent_tax_id"), F.lit(rank).alias("rank"),
            division.alias("division_id"),
        )

    def ident(letter, column):
        return F.concat(F.lit(letter), text_of(column))

    place = F.lit("PLACE")
    taxa_rows = (
        rows(customer, ident("c", "c_custkey"), "c_name", ident("n", "c_nationkey"), "customer", F.col("c_mktsegment"))
        .unionByName(rows(nation, ident("n", "n_nationkey"), "n_name", ident("r", "n_regionkey"), "nation", place))
        .unionByName(rows(region, ident("r", "r_regionkey"), "r_name", F.lit("world"), "region", place))
    )
    divisions = taxa_rows.select("division_id").distinct().withColumn("division", F.lower("division_id"))
    return taxa_rows.select("tax_id", "name"), taxa_rows.drop("name"), divisions


SQL_TAXA = """
taxa AS (
  SELECT 'c' || c_custkey AS id, c_name AS name, 'n' || c_nationkey AS parent, 'customer' AS rank, c_mktsegment AS division
  FROM customer
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey, 'nation', 'PLACE' FROM nation
  UNION ALL SELECT 'r' || r_regionkey, r_name, 'world', 'region', 'PLACE' FROM region),
compiled AS (
  SELECT t.id, t.name, p.name AS parent_tax, t.rank, lower(t.division) AS division
  FROM taxa t LEFT JOIN taxa p ON p.id = t.parent)"""

SQL_NCBI = """
SELECT 'http://purl.obolibrary.org/obo/NCBITaxon_' || id AS term, name AS rdfs_label,
       name || ' is a ' || rank || ' whose direct parent taxon is ' || coalesce(parent_tax, '') ||
       ' and the division is ' || division || '.' AS description
FROM compiled"""


@query("ncbi_tags", f"WITH {SQL_TAXA} {SQL_NCBI} WHERE regexp_matches(name, '(?i)nation|r#0*[1-9]')")
def ncbi_tags(spark, sf):
    compiled = taxa.compile_ncbi(*taxonomy_tables(spark, sf))
    return taxa.ncbi_tags(compiled, "NATION|R#0*[1-9]").select("term", "rdfs_label", "description")


@query(
    "gbif_tags",
    """SELECT 'https://www.gbif.org/species/' || n_nationkey AS term, n_name AS rdfs_label,
    coalesce((SELECT string_agg(s_name, ', ' ORDER BY s_name) FROM supplier WHERE s_nationkey = n_nationkey), '') AS description
    FROM nation WHERE regexp_matches(n_name, '(?i)ation_1')""",
)
def gbif_tags(spark, sf):
    nations = table(spark, sf, "nation").select(
        text_of("n_nationkey").alias("taxon_id"), F.col("n_name").alias("scientific_name")
    )
    names = table(spark, sf, "supplier").select(
        text_of("s_nationkey").alias("taxon_id"), F.col("s_name").alias("vernacular_name")
    )
    return taxa.gbif_tags(nations, names, "ATION_1").select("term", "rdfs_label", "description")


def taxonomy_edges(spark, sf):
    _, nodes, _ = taxonomy_tables(spark, sf)
    return nodes.select(F.col("tax_id").alias("child"), F.col("parent_tax_id").alias("parent"))


@query(
    "ancestors",
    f"""WITH RECURSIVE {SQL_TAXA}, up AS (
      SELECT id AS term, parent AS ancestor FROM taxa
      UNION SELECT up.term, t.parent FROM up JOIN taxa t ON t.id = up.ancestor)
    SELECT term, ancestor FROM up WHERE term <> ancestor""",
)
def ancestors(spark, sf):
    return closure.ancestors(taxonomy_edges(spark, sf))


@query(
    "descendants",
    f"""WITH RECURSIVE {SQL_TAXA}, down AS (
      SELECT 'r' || r_regionkey AS term FROM region WHERE r_name = 'ASIA'
      UNION SELECT t.id FROM down JOIN taxa t ON t.parent = down.term)
    SELECT term FROM down""",
)
def descendants(spark, sf):
    """One region and everything below it."""
    root = table(spark, sf, "region").where("r_name = 'ASIA'")
    return closure.descendants_or_self(
        taxonomy_edges(spark, sf), root.select(F.concat(F.lit("r"), text_of("r_regionkey")).alias("root"))
    )


@query(
    "subclass_ancestors",
    """SELECT 'http://example.org/part/P_' || p_partkey AS term, unnest(['http://example.org/type/' || p_type,
      CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'http://example.org/type/PLAIN'
           ELSE 'http://example.org/type/FANCY' END]) AS ancestor FROM part
    UNION ALL SELECT DISTINCT 'http://example.org/type/' || p_type,
      CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'http://example.org/type/PLAIN'
           ELSE 'http://example.org/type/FANCY' END FROM part""",
)
def subclass_ancestors(spark, sf):
    return jobs.subclass_ancestors(part_triples(spark, sf), EX)


# Statement lines, links


@query(
    "ntriples_round_trip",
    """SELECT doc_id, 'http://example.org/text' AS p, 'literal' AS o_kind, lang, length(text) AS chars, md5(text) AS digest
    FROM documents WHERE text IS NOT NULL""",
)
def ntriples_round_trip(spark, sf):
    """Whole documents as literals of N-Triples lines: escaped, parsed, unescaped."""
    s = F.concat(F.lit(EX + "doc/"), text_of("doc_id"))
    docs = spread(table(spark, sf, "documents")).where("text IS NOT NULL")
    lines = graph.ntriples_lines(docs.select(F.inline(F.array(_statement(s, EX + "text", F.col("text"), lang=F.col("lang"))))))
    parsed = rdf.parse_statements(lines)
    return parsed.select(
        tx.local_name(F.col("s")).cast("long").alias("doc_id"), "p", "o_kind", "lang",
        F.length("o").cast("long").alias("chars"), F.md5("o").alias("digest"),
    )


def reference_lines(spark, sf):
    """Pages as identifier statements; the doi is that of the document with the page's number."""
    key = text_of("page_id")
    end = F.when(F.col("page_id") % 2 == 0, " ,").otherwise(" .")
    return table(spark, sf, "pages").select(
        F.concat(
            F.lit(f"<{EX}reference/"), key, F.lit(">\tdcterms:identifier\t<https://doi.org/10.5555/"), key, F.lit(">"), end
        ).alias("value")
    )


@query(
    "link_references",
    """SELECT '10.5555/' || doc_id AS doi, doc_id::VARCHAR AS pmid, page_id::VARCHAR AS reference_id
    FROM documents JOIN pages ON page_id = doc_id""",
)
def link_references(spark, sf):
    from termweave.workload.registry import document_abstracts

    triples = rdf.parse_statements(reference_lines(spark, sf), {"dcterms": "http://purl.org/dc/terms/"})
    triples = terms.match(triples, p="http://purl.org/dc/terms/identifier")
    linked = documents.link_references(document_abstracts(spark, sf), documents.doi_references(triples))
    return linked.select("doi", "pmid", "reference_id")


def concept_triples(spark, sf):
    """Vectors as concepts, labels as descriptors, parts of them under other id classes or as literals."""
    s = F.concat(F.lit("http://id.nlm.nih.gov/mesh/"), F.when(F.col("label") == 9, "Q").otherwise("D"), text_of("label"))
    o = F.concat(F.lit("http://id.nlm.nih.gov/mesh/M"), text_of("vec_id"))
    label = F.concat(F.lit("label "), text_of("vec_id"))
    return table(spark, sf, "embeddings").select(
        F.inline(
            F.array(
                _statement(s, MESH_VOCAB + "concept", o, "iri"),
                _statement(s, MESH_VOCAB + "preferredConcept", o, "iri"),
                _statement(s, MESH_VOCAB + "preferredConcept", F.lit("M literal")),
                _statement(o, RDF_LABEL, label),
                _statement(o, MESH_VOCAB + "scopeNote", label),
                _statement(o, MESH_VOCAB + "active", F.lit("true")),
            )
        )
    )


@query(
    "concept_links",
    """SELECT 'M' || vec_id AS concept, unnest(['concept', 'preferredConcept']) AS prop, 'D' || label AS descriptor
    FROM embeddings WHERE label <> 9""",
)
def concept_links(spark, sf):
    return terms.concept_links(concept_triples(spark, sf), MESH_VOCAB)


@query(
    "subset_triples",
    """SELECT 'http://id.nlm.nih.gov/mesh/M' || vec_id AS s, unnest(['label', 'scopeNote']) AS p, 'label ' || vec_id AS o
    FROM embeddings""",
)
def subset_triples(spark, sf):
    found = terms.subset_triples(
        concept_triples(spark, sf), "http://id.nlm.nih.gov/mesh/M", ["vocab#scopeNote", "#label"]
    )
    return found.select("s", tx.fragment(F.col("p")).alias("p"), "o")


@query(
    "identifiers",
    r"""SELECT page_id, split_part(url, '/', -1) AS local, split_part(url, '#', -1) AS fragment,
    'https://doi.org/' || replace(replace(url_encode(url || ' ~*+é'), '%2F', '/'), '*', '%2A') AS iri,
    'https://doi.org/' || url AS plain,
    CASE WHEN page_id % 2 = 0 THEN 'http://example.org/' || page_id END AS expanded
    FROM pages""",
)
def identifiers(spark, sf):
    """Local names, fragments, doi IRIs and prefixed names."""
    url = F.col("url")
    curie = F.concat(F.when(F.col("page_id") % 2 == 0, "ex:").otherwise("no:"), text_of("page_id"))
    return table(spark, sf, "pages").select(
        "page_id",
        tx.local_name(url).alias("local"),
        tx.fragment(url).alias("fragment"),
        tx.doi_iri(F.concat(url, F.lit(" ~*+é"))).alias("iri"),
        tx.doi_url(url).alias("plain"),
        tx.expand_curie(curie, {"ex": EX}).alias("expanded"),
    )
