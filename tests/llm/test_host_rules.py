import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from termweave.llm import host_rules as h

WORD = r"[^\x20\x09-\x0D]+"


def measures(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, host int")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in h.measure(docs).collect()}
    assert got == {i: measures(t) for i, t in enumerate(texts)}


def test_measures_against_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "a", "a b c d e f g h", " ".join("abcdefgh" * 2), "x\nx\n\nx \n é|é\x0bé"]
    for _ in range(60):
        block = [rng.choice(["a", "b", "é", "#x", "y"]) for _ in range(rng.randint(1, 12))]
        words = [w for _ in range(rng.randint(1, 5)) for w in block + [rng.choice("pqrst")] * rng.randint(0, 2)]
        texts.append("".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words))
    check(spark, texts)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab \n| ", max_size=40), min_size=1, max_size=8))
def test_any_text(spark, texts):
    check(spark, texts)


def test_bad_hosts_take_their_documents_along(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, good, "fine") for i in range(300)] + [(1000 + i, good if i % 10 == 0 else "no", "spam") for i in range(300)]
    rows += [(2000, "no", "tiny"), (2001, good, "tiny"), (3000, good, None), (3000, good, None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = h.judge(docs.withColumn("kept", F.lit(1)).withColumn("rate", F.lit(2)))
    kept = sorted(r.doc_id for r in out.where("kept").collect())
    assert kept == [*range(300), 2001, 3000, 3000]
    assert out.count() == len(rows)
    rates = {r.host: r.rate for r in h.host_rates(h.measure(docs)).collect()}
    assert rates["fine"] < 0.05 and rates["spam"] > 0.85 and 0.4 < rates["tiny"] < 0.6
    assert h.judge(docs.limit(0)).count() == 0
