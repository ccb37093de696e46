import random

import numpy as np
import pyarrow as pa

from termweave.llm import factorization as fm


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        good = rng.random() < 0.7
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [words[0]] * len(words)
        rows.append((i, " ".join(words), len(words)))
        labels.append((i, int(good)))
    return rows, labels


def test_pairwise_sum_against_all_pairs():
    rng = np.random.default_rng(1)
    features = fm.BUCKETS + fm.STATISTICS
    model = fm.Model(0.3, rng.normal(0, 0.1, features), rng.normal(0, 0.1, (features, fm.FACTORS)), np.zeros(fm.STATISTICS), np.ones(fm.STATISTICS), [])
    texts = pa.array(["a b c a", "", None, "word\nword word|"])
    got = model.score(pa.record_batch([texts], ["text"]))
    row, bucket, value = fm.word_features(texts)
    dense = model.standard(fm.structure(texts))
    for i in range(len(texts)):
        x = np.zeros(features)
        x[bucket[row == i]] = value[row == i]
        x[fm.BUCKETS :] = dense[i]
        z = model.bias + model.weights @ x
        on = np.flatnonzero(x)
        z += sum(model.factors[a] @ model.factors[b] * x[a] * x[b] for a in on for b in on if a < b)
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-6


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus(2)
    docs = spark.createDataFrame([*rows, (None, None, None), (900, "", None), (900, "", 2)], "doc_id long, text string, n_chars long")
    known = spark.createDataFrame([*labels[:200], (1, None), (500, 1), (None, 0)], "doc_id long, quality int")
    model = fm.fit(docs, known, "quality", ["n_chars"])
    scores = {r.doc_id: r.score for r in fm.score(docs, model).collect()}
    assert np.mean([(scores[i] >= 0.7) == bool(y) for i, y in labels[200:]]) > 0.95
    assert all(0 <= s <= 1 for s in scores.values())
    again = {r.doc_id: r.score for r in fm.score(docs.repartition(7), fm.fit(docs.repartition(5), known, "quality", ["n_chars"])).collect()}
    assert all(abs(scores[i] - again[i]) < 1e-6 for i in scores)
    kept = fm.keep_good(docs, model, 0.7)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.7}
    nothing = fm.fit(docs, known.limit(0), "quality", train_rows=5)
    assert {r.score for r in fm.score(docs, nothing).collect()} == {0.5}
    assert fm.score(docs.limit(0), model).count() == 0
