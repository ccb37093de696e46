import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from termweave.llm.ngram_join import jaccard_components, keep_one_per_component

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, k, percent):
    def shingles(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if x and y and 100 * len(x & y) >= percent * len(x | y) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return sorted((i, len(s), label[i]) for i, s in sets)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "x", 1) for i, t in rows], SCHEMA)


def found(spark, rows, k=4, percent=85):
    return sorted(tuple(r) for r in jaccard_components(frame(spark, rows), k, percent).collect())


def corpus(seed, n=70):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(50)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.5:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                words = [w.upper() for w in words]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 20, 90]))]
            if kind > 0.7:
                words = passage + words
        rows.append((i, " ".join(words)))
    return rows


def test_components_against_all_pairs(spark):
    for seed in range(2):
        rows = corpus(seed) + [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "one two")]
        assert found(spark, rows) == brute(rows, 4, 85)


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab \n", max_size=12), max_size=12))
def test_tiny_texts(spark, texts):
    rows = list(enumerate(texts))
    assert found(spark, rows, 2, 60) == brute(rows, 2, 60)


def test_edges(spark):
    assert found(spark, []) == []
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "A B\tC d  e"), (3, None), (3, "")]
    out = jaccard_components(frame(spark, rows).withColumn("component", F.lit(1)), 4, 85)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(None, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 0, 3)], key=str
    )
    kept = keep_one_per_component(frame(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(None, "a b c d e"), (1, "a b c d e"), (3, None), (3, "")], key=str
    )
    assert kept.columns == frame(spark, rows).columns


def test_a_chain_of_edits_is_one_component(spark):
    words = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(25):
        words[i] = f"new{i}"
        rows.append((i, " ".join(words)))
    got = found(spark, rows)
    assert got == brute(rows, 4, 85)
    assert {c for _, _, c in got} == {0}


def test_rows_of_one_id_with_different_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a + " longer still"), (5, b), (7, b), (9, b + " one"), (5, a + " longer still"), (11, c), (2**62, c + " x y")]
    got = {(i, n): comp for i, n, comp in found(spark, rows)}
    assert {i: comp for (i, _), comp in got.items()} == {5: 5, 7: 5, 9: 5, 11: 11, 2**62: 11}
    kept = keep_one_per_component(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(5, a + " longer still"), (7, b), (11, c)])
    other = [(5, a), (5, c), (2**63 - 1, b), (-(2**63) + 9, "x y z")]  # no room after the largest id
    assert sorted((r.doc_id, r.text) for r in keep_one_per_component(frame(spark, other)).collect()) == sorted(other)


def test_repeated_ids_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i % 23 if rng.random() < 0.5 else i, t) for i, t in corpus(3, 60)]
    sets = brute(list(enumerate(t for _, t in rows)), 4, 85)  # by row
    label = {i: c for i, _, c in sets}
    joined = {}
    for (doc, _), (i, n, _) in zip(rows, sets):
        if n:
            joined.setdefault(doc, []).append(i)
    changed = True
    while changed:  # rows of one id are joined
        changed = False
        for members in list(joined.values()) + [[i for i in label if label[i] == c] for c in set(label.values())]:
            low = min(label[i] for i in members)
            for i in members:
                if label[i] != low:
                    label[i], changed = low, True
    least = {}
    for (doc, _), (i, _, _) in zip(rows, sets):
        least[label[i]] = min(doc, least.get(label[i], doc))
    assert found(spark, rows) == sorted((doc, n, least[label[i]] if n else doc) for (doc, _), (i, n, _) in zip(rows, sets))
