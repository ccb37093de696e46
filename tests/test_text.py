import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.functions import text as tx
from termweave.functions.encode import BatchEncoder, HashingEncoder, encode
from termweave.operators import documents, terms


def one(spark, col, **values):
    layout = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], layout).select(col.alias("x")).first().x


@pytest.mark.parametrize(
    "text,parts",
    [
        ("One. Two! Three? four. Five", ["One.", "Two!", "Three? four.", "Five"]),
        ("In E. coli. E. Coli too.", ["In E. coli.", "E.", "Coli too."]),
        ("A.\n B", ["A.", "B"]),
        ("no break", ["no break"]),
        ("Étude. École. Tail", ["Étude. École.", "Tail"]),
        ("", [""]),
    ],
)
def test_sentences(spark, text, parts):
    assert one(spark, tx.sentences(F.col("t")), t=text) == parts


def test_strip_and_blank(spark):
    assert one(spark, tx.strip(F.col("t")), t=" \t a b\r\n") == "a b"
    for text, blank in ((" \n ", True), ("", True), (None, True), (" x ", False)):
        assert one(spark, tx.is_blank(F.col("t")), t=text) is blank


@pytest.mark.parametrize(
    "values,text",
    [(["a.", "", "b..."], "a. b."), ([], ""), ([""], ""), (["..."], ""), (["x", None], "x."), ([" a "], "a .")],
)
def test_description(spark, values, text):
    assert one(spark, tx.join_sentences(F.col("v")), v=values) == text


def test_obo_ids_and_obsolete(spark):
    assert one(spark, tx.strip_obo_ids(F.col("t")), t="a (GO:12) b () (go:1) ((X:1))") == "a  b  (go:1) "
    for label, description, found in (("obsolete x", "", True), ("Obsolete x", "", False), ("x", "ObSoLete", True)):
        assert one(spark, tx.mentions_obsolete(F.col("a"), F.col("b")), a=label, b=description) is found


def test_identifiers(spark):
    assert one(spark, tx.doi_iri(F.col("d")), d="10.1/a(b)<c> *~+é") == "https://doi.org/10.1/a%28b%29%3Cc%3E%20%2A~%2B%C3%A9"
    assert one(spark, tx.local_name(F.col("d")), d="http://x/obo/TO_0000394") == "TO_0000394"
    assert one(spark, tx.fragment(F.col("d")), d="http://x/vocab#concept") == "concept"
    assert one(spark, tx.expand_curie(F.col("d"), {"ex": "http://e/"}), d="ex:a:b") == "http://e/a:b"
    assert one(spark, tx.expand_curie(F.col("d"), {"ex": "http://e/"}), d="<http://x>") == "http://x"
    assert one(spark, tx.expand_curie(F.col("d"), {}), d="no:a") is None


def test_tag_text_and_reject(spark):
    rows = [("L", "D"), ("L", " "), ("", "D"), ("", "")]
    tags = spark.createDataFrame(rows, "rdfs_label string, description string")
    usable, rejected = terms.reject_empty(tags)
    assert rejected.count() == 1
    assert sorted(r.text for r in terms.encoding_text(usable).collect()) == [" - D", "L", "L - D"]


def reference_vector(text, dim):
    import regex

    v = np.zeros(dim)
    for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()):
        if t:
            v[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim] += 1
    n = np.linalg.norm(v)
    return v / n if n else v


def test_hashing_encoder(spark):
    texts = ["Root growth, root GROWTH.", "", "!!!", None, "Été 3x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.embedding for r in encode(df, HashingEncoder(32), "t").collect()}
    assert got[3] is None
    for i in (0, 1, 2, 4):
        assert np.allclose(got[i], reference_vector(texts[i], 32), atol=1e-7)


def test_batch_encoder_keeps_order_and_nulls(spark):
    def make():
        return lambda texts: np.array([[len(t), 1] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([(i, None if i % 7 == 0 else "x" * i) for i in range(50)], "i int, t string").repartition(3)
    got = {r.i: r.embedding for r in encode(df, BatchEncoder("lengths", 2, make, 4), "t").collect()}
    assert all(got[i] == (None if i % 7 == 0 else [float(i), 1.0]) for i in range(50))


def test_chunks(spark):
    docs = spark.createDataFrame(
        [("d", "Title", "One. Two."), ("e", " ", "x"), ("f", "T", "\n"), (None, "T", "x")], "doi string, title string, abstract string"
    )
    rows = documents.chunk_documents(docs).orderBy("chunk_idx").collect()
    assert [(r.doi, r.chunk_idx, r.text) for r in rows] == [("d", 0, "Title"), ("d", 1, "One."), ("d", 2, "Two.")]


def test_first_per_key_with_a_hot_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("doi"), F.col("id").alias("n")
    )
    rows = documents.dedupe_documents(df, F.desc("n"))
    assert rows.count() == 2001
    assert rows.where("doi = 'hot'").first().n == 2997


def test_dedupe_stored(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5), ("c", 3), ("c", 3), ("d", 0)], "doi string, n int").select("n", "doi").repartition(3)
    for rows in (df, df.where("doi IN ('b', 'd')"), df.where("n < 0")):
        got = documents.dedupe_stored(rows, F.col("n"))
        assert got.columns == ["n", "doi"] and sorted(got.collect()) == sorted(documents.dedupe_documents(rows, F.col("n")).select("n", "doi").collect())


def test_chunk_vector_slices(spark):
    df = spark.createDataFrame([("d", i, [float(i)]) for i in reversed(range(7))], "doi string, chunk_idx int, embedding array<float>")
    rows = {(r.doi, r.slice): r.embeddings for r in documents.collect_chunk_vectors(df, 3).collect()}
    assert rows == {("d", 0): [[0.0], [1.0], [2.0]], ("d", 1): [[3.0], [4.0], [5.0]], ("d", 2): [[6.0]]}


def test_hits(spark):
    layout = "title string, abstract string, doi array<string>, keywords struct<teeft: array<string>>"
    rows = spark.createDataFrame([("t", None, ["a", "b"], (["k"],)), (None, "x", [], None), (None, None, None, None)], layout)
    got = [tuple(r) for r in documents.hits_to_abstracts(rows).collect()]
    assert got == [("t", "", "a", ["k"]), ("", "x", None, []), ("", "", None, [])]


def test_merge_tags_last_store_wins(spark):
    layout = "ontology string, term string, rdfs_label string, description string, group string"
    a = spark.createDataFrame([("o", "t", "first", "x", "g"), ("o", "u", "only", "", "g"), ("o", "u", "only", "longer", "g")], layout)
    b = spark.createDataFrame([("p", "t", "second", "", "h")], layout)
    rows = {r.term: r for r in terms.merge_tags(a, b).collect()}
    assert rows["t"].rdfs_label == "second" and rows["u"].description == "longer" and len(rows) == 2
