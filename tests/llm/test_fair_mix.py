import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from termweave.llm import fair_mix as m

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(rows):
    """Share, cap, share the excess again, until no source is above its cap."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += size(text)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {s: share.get(s, 3.0 * sizes[s]) for s in order}, sizes
        capped.update(over)


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        source = rng.choice(["big"] * 8 + ["s1", "s2", "é", "A", None, "tiny"])
        if source == "tiny" and rng.random() < 0.8:
            source = "big"
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 80])), source))
    return rows + [(900, None, "none"), (901, "", None), (950, "w w w", "big"), (950, "w w w", "big"), (None, "w w", "s1")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, 1) for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_takes(spark, seed):
    rows = rows_of(seed)
    want, sizes = targets(rows)
    source = {i: s for i, _, s in rows}
    got = m.taken(frame(spark, rows).withColumn("size", F.lit("x"))).collect()
    assert len(got) == len(rows)
    total = Counter()
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"])
        total[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(total[s] - t) <= 160, s
    assert sum(total.values()) <= sum(sizes.values())
    again = m.taken(frame(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    made = m.mix(frame(spark, rows))
    assert made.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    per = Counter()
    for r in made.collect():
        per[r.doc_id] += size(r.text)
    wanted = Counter()
    for r in got:
        wanted[r.doc_id] += r.taken
    assert +wanted == +per


def test_order_follows_finish_times(spark):
    rows, chosen = m.queue(frame(spark, rows_of(3)))
    mixed = sorted(chosen.collect(), key=lambda r: r.total)
    assert [r.finish for r in mixed] == sorted(r.finish for r in mixed)
    assert mixed[-1].finish < 1.2


def test_empty(spark):
    assert m.taken(frame(spark, [])).count() == 0
    got = m.taken(frame(spark, [(1, None, None), (2, "", "a")])).collect()
    assert sorted((r.doc_id, r.target, r.taken) for r in got) == [(1, 0.0, 0), (2, 0.0, 0)]
    assert m.mix(frame(spark, [(1, None, None)])).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    rows = [(None, f"text number {i} here", "a") for i in range(5)] + [(3, f"other {i}", "b") for i in range(4)] + [(3, "other 0", "b")]
    docs = frame(spark, rows)
    taken = Counter()
    for r in m.taken(docs).collect():
        taken[r.doc_id] += r.taken
    made = Counter((r.doc_id, r.text) for r in m.mix(docs).collect())
    total = Counter()
    for (doc, text), n in made.items():
        total[doc] += n * size(text)
    assert total == +taken
    # Nobody stands for another text: no text comes more often than its rows may repeat.
    wanted = Counter((i, t) for i, t, _ in rows)
    assert set(made) <= set(wanted) and all(n <= 3 * wanted[k] for k, n in made.items())
    assert {n for (i, _), n in made.items() if i is None} == {1}  # its target is below its size
