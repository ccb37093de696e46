"""Ontology triples to tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import text as tx
from termweave.operators.closure import descendants_or_self
from termweave.spec import RDF_LABEL, OntologySpec, iri_of, object_of, split_path

SALTS = 64


def match(triples: DataFrame, s: str | None = None, p: str | list[str] | None = None, o: str | None = None):
    """Triple pattern: ``None`` matches everything, a list of predicates matches any of them."""
    if s is not None:
        triples = triples.where(F.col("s") == s)
    if p is not None:
        triples = triples.where(F.col("p").isin([p] if isinstance(p, str) else list(p)))
    return triples if o is None else triples.where(F.col("o") == o)


def in_language(kind: Column, lang: Column) -> Column:
    """English or untagged literals."""
    return (kind == "literal") & F.coalesce(lang, F.lit("")).isin("en", "")


def under_prefix(triples: DataFrame, *prefixes: str | None) -> DataFrame:
    """Triples whose subject starts with every given prefix."""
    for prefix in prefixes:
        if prefix:
            triples = triples.where(F.startswith("s", F.lit(prefix)))
    return triples


def labels(triples: DataFrame, label: str = RDF_LABEL) -> DataFrame:
    """``term, rdfs_label``, one row per accepted label."""
    return match(triples, p=label).where(in_language(F.col("o_kind"), F.col("lang"))).select(
        F.col("s").alias("term"), F.col("o").alias("rdfs_label")
    )


def optional_properties(terms: DataFrame, triples: DataFrame, properties: list[str], multi: str = "agg") -> DataFrame:
    """Add ``prop0 .. propK``: values of optional properties, null when missing.

    ``multi="agg"`` keeps one row per label; several values of a property are sorted and joined as sentences (a single
    value stays as it is), all properties in one aggregation. ``multi="cross"`` gives one row per combination of values.
    """
    values = match(triples, p=properties).where(in_language(F.col("o_kind"), F.col("lang")))
    names = [f"prop{i}" for i in range(len(properties))]
    if not properties:
        return terms
    if multi == "cross":
        for name, p in zip(names, properties):
            one = values.where(F.col("p") == p).select(F.col("s").alias("term"), F.col("o").alias(name))
            terms = terms.join(one, "term", "left")
        return terms
    distinct = values.select("s", "p", "o").distinct()
    collected = distinct.groupBy(F.col("s").alias("term")).agg(
        *[F.sort_array(F.collect_list(F.when(F.col("p") == p, F.col("o")))).alias(n) for n, p in zip(names, properties)]
    )

    def merged(name: str) -> Column:
        several = tx.join_sentences(F.col(name))
        return F.when(F.size(name) > 1, several).when(F.size(name) == 1, F.get(name, F.lit(0))).alias(name)

    return terms.join(collected.select("term", *[merged(n) for n in names]), "term", "left")


def constrained(triples: DataFrame, terms: DataFrame, spec: OntologySpec) -> DataFrame:
    """Terms that meet every ``property value`` constraint, one semi join each.

    A property path ``p*`` keeps the value itself and all terms that reach it over ``p``.
    """
    for prop, value in spec.constraints.items():
        path = split_path(prop)
        predicate = iri_of(path.predicate, spec.prefixes)
        kind, wanted = object_of(value, spec.prefixes)
        if path.star:
            spark = triples.sparkSession
            edges = match(triples, p=predicate).select(F.col("s").alias("child"), F.col("o").alias("parent"))
            found = descendants_or_self(edges, spark.createDataFrame([(wanted,)], "term string"))
        else:
            found = match(triples, p=predicate, o=wanted).where(F.col("o_kind") == kind)
            found = found.select(F.col("s").alias("term"))
        terms = terms.join(found.distinct(), "term", "left_semi")
    return terms


def build_terms(triples: DataFrame, spec: OntologySpec, multi: str = "agg", cap: int | None = None) -> DataFrame:
    """Tags ``ontology, term, rdfs_label, description, group`` of one ontology."""
    own = under_prefix(triples, spec.prefix, spec.selected_prefix_term)
    terms = constrained(triples, labels(own, iri_of(spec.label, spec.prefixes)), spec)
    wanted = [iri_of(p, spec.prefixes) for p in spec.properties]
    rows = optional_properties(terms, own, wanted, multi)
    description = tx.describe(*[F.col(f"prop{i}") for i in range(len(wanted))]) if wanted else F.lit("")
    tags = (
        rows.select("term", tx.strip(F.col("rdfs_label")).alias("rdfs_label"), description.alias("raw"))
        .where(~tx.mentions_obsolete(F.col("rdfs_label"), F.col("raw")))
        .select(
            F.lit(spec.name).alias("ontology"),
            "term",
            "rdfs_label",
            tx.strip_obo_ids(F.col("raw")).alias("description"),
            F.lit(spec.group).alias("group"),
        )
    )
    return cap_terms(tags, cap) if cap and cap > 0 else tags


def cap_terms(tags: DataFrame, n: int) -> DataFrame:
    """The first ``n`` terms per ontology, by term: first inside salted parts, then over what is left of them."""
    salted = tags.withColumn("__salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)))
    order = [F.col(c) for c in ("term", "rdfs_label", "description")]
    inner = Window.partitionBy("ontology", "__salt").orderBy(*order)
    outer = Window.partitionBy("ontology").orderBy(*order)
    part = salted.withColumn("__n", F.row_number().over(inner)).where(F.col("__n") <= n).drop("__n", "__salt")
    return part.withColumn("__n", F.row_number().over(outer)).where(F.col("__n") <= n).drop("__n")


def reject_empty(tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags that can be encoded, and those with neither label nor description."""
    empty = tx.is_blank(F.col("rdfs_label")) & tx.is_blank(F.col("description"))
    return tags.where(~empty), tags.where(empty)


def encoding_text(tags: DataFrame) -> DataFrame:
    return tags.withColumn("text", tx.tag_text(F.col("rdfs_label"), F.col("description")))


def merge_tags(*stores: DataFrame) -> DataFrame:
    """One row per term; a later store wins, then the greater description."""
    ranked = [s.withColumn("__store", F.lit(i)) for i, s in enumerate(stores)]
    return last_per_term(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked), "__store")


def last_per_term(tags: DataFrame, rank: str) -> DataFrame:
    row = F.struct(*[c for c in tags.columns if c != rank])
    best = tags.groupBy(F.col("term").alias("__key")).agg(
        F.max_by(row, F.struct(rank, "description", "rdfs_label", "ontology", "group")).alias("row")
    )
    return best.select("row.*")


def distinct_tags(tags: DataFrame) -> DataFrame:
    return tags.dropDuplicates()


def tags_in_scores(tags: DataFrame, scores: DataFrame) -> DataFrame:
    return tags.join(scores.select("tag").distinct(), "tag", "left_semi")


def concept_links(triples: DataFrame, namespace: str) -> DataFrame:
    """``concept, prop, descriptor``: M-concepts and the D-descriptors that name them."""
    props = [namespace + p for p in ("preferredConcept", "concept")]
    found = match(triples, p=props).where(F.col("o_kind") == "iri")
    return found.select(
        tx.local_name(F.col("o")).alias("concept"),
        tx.fragment(F.col("p")).alias("prop"),
        tx.local_name(F.col("s")).alias("descriptor"),
    ).where(F.startswith("concept", F.lit("M")) & F.startswith("descriptor", F.lit("D")))


def subset_triples(triples: DataFrame, subject_prefix: str, predicates: list[str]) -> DataFrame:
    """Triples of one subject family, restricted to predicates whose IRI ends with one of the given endings."""
    endings = reduce(lambda a, b: a | b, [F.endswith("p", F.lit(e)) for e in predicates])
    return triples.where(F.startswith("s", F.lit(subject_prefix)) & endings)
