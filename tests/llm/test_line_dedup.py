import random
from collections import Counter

from pyspark.sql import functions as F

from termweave.llm import line_dedup as ld

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_documents, min_chars):
    found = Counter(k for _, text in rows for k in {key(x) for x in (text or "").split("\n")})
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or found[key(x)] < min_documents]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def rows_of(seed, n=120):
    rng = random.Random(seed)
    pool = ["shared", "  Shared\t", "ÉTÉ", "été", "É", "", "   ", " x", "x", "license\r", "License", "a\x85", "日本", "\x1cq"]
    rows = [(i, "\n".join(rng.choice(pool) + (str(rng.randrange(40)) if rng.random() < 0.4 else "") for _ in range(rng.randrange(9)))) for i in range(n)]
    return rows + [(None, None), (None, "shared"), (None, "shared"), (7, "x\nx\nx"), (7, "x\nx\nx"), (900, ""), (901, "word " * 60_000 + "\nx\n" * 4000)]


def run(spark, rows, *args):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_lines": F.lit("clash"), "gone": F.lit(1), "t1": F.lit(2)})
    got = ld.drop_shared_lines(frame, *args)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_against_brute_force(spark):
    for seed, min_documents, min_chars in ((1, 10, 1), (2, 2, 1), (3, 5, 3), (4, 3, 0)):
        rows = rows_of(seed)
        assert run(spark, rows, min_documents, min_chars) == brute(rows, min_documents, min_chars)


def test_shuffled_way_for_rarer_lines(spark):
    rows = rows_of(5)
    for limit in (1, 4, 20):
        assert run(spark, rows, 2, 1, limit) == brute(rows, 2, 1)


def test_hashes_that_agree_in_half():
    import numpy as np

    members = ld.Members(np.array([1, 1, 2]), np.array([5, 6, 5]))
    asked = np.array([(1, 5, 1), (1, 6, 1), (1, 7, 1), (2, 5, 1), (2, 6, 1), (3, 5, 1), (1, 5, 0)])
    assert members.has(asked).tolist() == [True, True, False, True, False, False, False]


def test_empty_and_all_dropped(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ld.drop_shared_lines(empty).count() == 0
    assert run(spark, [(i, "same\nSAME ") for i in range(12)], 10, 1) == [(i, 2, 2, "") for i in sorted(range(12), key=lambda i: repr((i,)))]
