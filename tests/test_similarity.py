import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.functions import vectors as vx
from termweave.operators import similarity as sim

CHUNK = "doi string, chunk_idx int, embedding array<float>"
TAG = "tag string, embedding array<float>"


def brute(chunks, tags, threshold, strict=False):
    out = {}
    for doi, i, v in chunks:
        for tag, w in tags:
            if v is None or w is None or len(v) != len(w) or not len(v):
                continue
            a, b = np.float32(v).astype(float), np.float32(w).astype(float)
            n = np.linalg.norm(a) * np.linalg.norm(b)
            if n > 0 and np.isfinite(n):
                s = a @ b / n
                if s > threshold or (s >= threshold and not strict):
                    out[(doi, i, tag)] = s
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    tags = [(f"t{i}", rng.normal(size=8).tolist()) for i in range(60)]
    chunks = [(f"d{i // 5}", i % 5, rng.normal(size=8).tolist()) for i in range(300)]
    chunks += [("z", 0, [0.0] * 8), ("z", 1, None), ("z", 2, []), ("z", 3, [1.0] * 5), ("z", 4, [float("nan")] * 8)]
    tags += [("zero", [0.0] * 8), ("narrow", [1.0] * 5), ("none", None), ("inf", [float("inf")] * 8)]
    chunks += [("hot", 0, tags[0][1])] * 150  # a third of all rows are copies
    return chunks, tags


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "share_bytes": 700}, {"broadcast_bytes": 0}])
def test_join_equals_brute_force(spark, data, options):
    chunks, tags = data
    c, t = spark.createDataFrame(chunks, CHUNK).repartition(5), spark.createDataFrame(tags, TAG)
    rows = sim.similarity_join(c, t, 0.35, **options).collect()
    expected = brute(chunks, tags, 0.35)
    assert len(rows) == len(expected) + 149 * len([k for k in expected if k[0] == "hot"])
    assert {(r.doi, r.chunk_idx, r.tag) for r in rows} == set(expected)
    assert all(abs(r.similarity - expected[(r.doi, r.chunk_idx, r.tag)]) < 1e-12 for r in rows)
    assert ("z", 3, "narrow") in expected


def test_small_blocks_give_the_same(spark, data, monkeypatch):
    chunks, tags = data
    for name, value in (("ROWS", 7), ("COLS", 11), ("PAIRS", 3)):
        monkeypatch.setattr(sim, name, value)
    blocks = sim._blocks(sim.pa.array([v for _, _, v in chunks], sim.pa.list_(sim.pa.float32())))
    right = sim._blocks(sim.pa.array([v for _, v in tags], sim.pa.list_(sim.pa.float32())))
    found = [x for w in blocks if w in right for x in sim.cosine_above(0.35)(blocks[w], right[w])]
    assert sum(len(i) for i, _, _ in found) == sum(
        1 for c in chunks for t in tags if brute([c], [t], 0.35)
    )


def test_score_is_max_over_chunks(spark, data):
    chunks, tags = data
    c, t = spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(tags, TAG)
    expected = {}
    for (doi, _, tag), s in brute(chunks, tags, 0.4).items():
        expected[(doi, tag)] = max(s, expected.get((doi, tag), -1))
    got = {(r.doi, r.tag): r.similarity for r in sim.score_tags(c, t, 0.4).collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-12 for k in got)


@pytest.mark.parametrize("metric", ["manhattan", "cosine"])
@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "share_bytes": 700}])
def test_best_similarity(spark, data, metric, options):
    chunks = [c for c in data[0] if c[0] in ("d0", "d1", "hot")]
    tags = data[1][:60]
    c, t = spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(tags, TAG)
    got = {r.doi: r.best_similarity for r in sim.best_similarity(c, t, metric, **options).collect()}
    for doi in got:
        best = -np.inf
        for d, _, v in chunks:
            for _, w in tags if d == doi else []:
                a, b = np.float32(v).astype(float), np.float32(w).astype(float)
                s = -np.abs(a - b).sum() if metric == "manhattan" else a @ b / np.linalg.norm(a) / np.linalg.norm(b)
                best = max(best, s)
        assert abs(got[doi] - best) < 1e-9
    assert len(got) == 3


def test_zero_vectors_have_a_distance_but_no_angle(spark):
    chunks = spark.createDataFrame([("z", 0, [0.0, 0.0]), ("a", 0, [3.0, 4.0])], CHUNK)
    tags = spark.createDataFrame([("t", [1.0, 1.0]), ("o", [0.0, 0.0])], TAG)
    for options in ({}, {"broadcast_bytes": 0, "share_bytes": 8}):
        near = {r.doi: r.best_similarity for r in sim.best_similarity(chunks, tags, "manhattan", **options).collect()}
        assert near == {"z": 0.0, "a": -5.0}
        angle = {r.doi for r in sim.best_similarity(chunks, tags, "cosine", **options).collect()}
        assert angle == {"a"}


def test_edges_are_strict_and_ordered(spark):
    tags = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("d", [2.0, 0.0])], TAG)
    rows = {(r.tag_a, r.tag_b) for r in sim.tag_edges(tags, 0.70).collect()}
    assert rows == {("a", "c"), ("a", "d"), ("b", "c"), ("c", "d")}
    equal = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [3.0, 4.0])], TAG)
    assert sim.tag_edges(equal, 1.0).count() == 0
    assert sim.similarity_join(equal.select(F.col("tag").alias("doi"), "embedding"), equal, 1.0).count() == 4


@pytest.mark.parametrize("options", [{"ring": 9}, {"ring": 3, "broadcast_bytes": 0, "share_bytes": 700}, {"ring": 5, "broadcast_bytes": 0}])
def test_self_join_compares_two_tags_once(spark, data, options, monkeypatch):
    tags = [t for t in data[1] if t[0] != "none"] + [(None, [1.0] * 8), ("t0", [1.0] * 8), ("t0", [1.0] * 8)]
    table = spark.createDataFrame(tags, TAG).repartition(3)
    expected = {}
    for (a, _, b), s in brute([(t, 0, v) for t, v in tags if t], [x for x in tags if x[0]], 0.1, True).items():
        if a < b:
            expected[a, b] = s
    rows = sim.tag_edges(table, 0.1, **options).collect()
    assert {(r.tag_a, r.tag_b) for r in rows} == set(expected)
    # Three vectors are named t0; every other pair comes once.
    assert len([r for r in rows if "t0" not in (r.tag_a, r.tag_b)]) == len([p for p in expected if "t0" not in p])
    met = spark.sparkContext.accumulator(0)

    def counted(a, b):
        met.add(len(a.raw) * len(b.raw))
        return iter(())

    left = table.select(F.col("tag").alias("tag_a"), "embedding")
    sim.block_join(left, table, counted, **options).collect()
    assert met.value < 0.75 * 63**2


def test_no_tags_no_rows(spark, data):
    c = spark.createDataFrame(data[0][:10], CHUNK)
    assert sim.similarity_join(c, spark.createDataFrame([], TAG), 0.1).count() == 0


def test_vector_expressions(spark):
    rows = [([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 2.0]), ([1.0], [1.0, 2.0]), ([], []), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    got = df.select(vx.cosine(a, b).alias("c"), vx.neg_manhattan(a, b).alias("m"), vx.l2_norm(a).alias("n")).collect()
    assert [r.c for r in got] == [1.0, None, None, None, None]
    assert [r.m for r in got] == [0.0, -3.0, None, None, None]
    assert got[0].n == 5.0
    assert df.limit(1).select(vx.unit(a).alias("u")).first().u == [0.6, 0.8]


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "share_bytes": 700}])
def test_scores_are_combined_where_they_are_found(spark, data, options, monkeypatch):
    """Pairs are not shuffled, and documents of many chunks, null names and repeated tags give what the plain way gives."""
    chunks = data[0] + [(None, 0, data[1][3][1]), (None, 1, data[1][4][1])]
    tags = data[1] + [(None, data[1][5][1]), ("t0", data[1][6][1])]
    c, t = spark.createDataFrame(chunks, CHUNK).repartition(5), spark.createDataFrame(tags, TAG)
    pairs = sim.similarity_join(c, t, 0.3, keep=["doi"])
    expected = {(r.doi, r.tag): r.s for r in pairs.groupBy("doi", "tag").agg(F.max("similarity").alias("s")).collect()}
    scored = sim.score_tags(c, t, 0.3, **options)
    assert "Aggregate" not in scored._jdf.queryExecution().executedPlan().toString()
    assert {(r.doi, r.tag): r.similarity for r in scored.collect()} == expected
    monkeypatch.setattr(sim, "DOCUMENT_CHUNKS", 3)
    monkeypatch.setattr(sim, "CELLS", 200)
    rows = sim.score_tags(c, t, 0.3, **options).collect()
    assert len(rows) == len(expected) and {(r.doi, r.tag): r.similarity for r in rows} == expected


def test_manhattan_tiles_are_exact(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(150, 16)).astype(np.float32), rng.normal(size=(400, 16)).astype(np.float32)
    y[300:] = y[:100]
    monkeypatch.setattr(sim, "TILE", (32, 50))
    monkeypatch.setattr(sim, "PAIRS", 7)
    for scale in (1, 1e-42, 1e35):
        a, b = (x * np.float32(scale)).astype(np.float32), (y * np.float32(scale)).astype(np.float32)
        top, at = sim._nearest(a, b, np.full(len(a), -np.inf))
        far = -np.abs(a[:, None].astype(float) - b[None].astype(float)).sum(axis=2)
        assert np.allclose(top, far.max(axis=1), rtol=1e-13, atol=0) and (at == far.argmax(axis=1)).mean() > 0.9
        # In float32 alone the sums are further off, by four orders.


def test_chunks_are_not_sent_to_every_share(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=8).tolist() for _ in range(240)]
    chunks = spark.createDataFrame([(f"d{i}", v) for i, v in enumerate(vectors)], "doi string, embedding array<double>")
    tags = spark.createDataFrame([(f"t{i}", v) for i, v in enumerate(vectors)], "tag string, embedding array<double>")
    sent, mapped = [], type(chunks).mapInArrow
    monkeypatch.setattr(type(chunks), "mapInArrow", lambda self, *a, **b: (sent.append(self.count()), mapped(self, *a, **b))[1])
    small_shares = {"broadcast_bytes": 0, "share_bytes": 96}  # 240 shares or so

    def rows(**options):
        joined = sim.similarity_join(chunks, tags, 0.7, **options).select("doi", "tag").collect()
        edges = sim.tag_edges(tags, 0.7, **options).select("tag_a", "tag_b").collect()
        return [sorted(tuple(r) for r in found) for found in (joined, edges)]

    found = rows(**small_shares)
    assert all(len(r) > 100 for r in found) and max(sent) < 12 * 240
    assert found == rows()


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "share_bytes": 700}])
def test_ranked_scores_are_in_order(spark, options, monkeypatch):
    rng = np.random.default_rng(6)
    chunks = spark.createDataFrame([(f"d{i // 3}", rng.normal(size=4).tolist()) for i in range(90)] + [(None, [1.0, 0.0, 0.0, 0.0])], "doi string, embedding array<double>")
    vectors = [rng.normal(size=4).tolist() for _ in range(20)]
    tags = spark.createDataFrame([(f"http://{'ab'[i % 2]}/T{i // 2}", vectors[i // 4]) for i in range(40)], "tag string, embedding array<double>")
    for most in (10_000, 2):  # the second time all documents but one are large
        monkeypatch.setattr(sim, "DOCUMENT_CHUNKS", most)
        rows = [(r.doi, r.similarity, r.tag) for r in sim.score_tags(chunks, tags, 0.2, ranked=True, **options).collect()]
        assert sorted(rows, key=str) == sorted([(r.doi, r.similarity, r.tag) for r in sim.score_tags(chunks, tags, 0.2, **options).collect()], key=str)
        named = [r for r in rows if r[0] is not None]
        assert rows[: len(named)] == named
        order = [(r[0], r[1]) for r in named]
        assert order == sorted(order, reverse=True)
        names = {}
        for doi, score, tag in rows:
            names.setdefault((doi, score), []).append(tag.rpartition("/")[2])
        assert any(len(x) > 1 for x in names.values()) and all(x == sorted(x) for x in names.values())


@pytest.mark.parametrize("kind", [np.float32, np.float64])
@pytest.mark.parametrize("width", [1, 64, 150])
def test_nearest_by_whole_numbers(monkeypatch, kind, width):
    """Sums of whole numbers leave few candidates of usual vectors, all that count of any."""
    rng = np.random.default_rng(5)
    usual = lambda n: rng.normal(size=(n, width))
    makers = [
        usual,
        lambda n: rng.integers(0, 3, (n, width)),
        lambda n: np.where(rng.random((n, width)) < 0.01, 1e6, usual(n)),
        lambda n: np.full((n, width), 0.5),
        lambda n: 1e8 + usual(n),
        lambda n: usual(n) * 1e-300,
    ]
    found, near = [], sim._Steps.near
    monkeypatch.setattr(sim._Steps, "near", lambda self, *a: found.append(near(self, *a)) or found[-1])
    for make in makers:
        x, y = make(140).astype(kind), make(1100).astype(kind)
        distances = np.zeros((len(x), len(y)))
        for k in range(width):
            distances += np.abs(x[:, k, None].astype(float) - y[None, :, k].astype(float))
        best, where = -distances.min(axis=1), distances.argmin(axis=1)
        for known in (np.full(len(x), -np.inf), best + np.where(np.arange(len(x)) % 2, 0.1, -0.1) * np.abs(best)):
            top, at = sim._nearest(x, y, known)
            better = best > known
            assert np.array_equal(top[better], best[better]) and np.array_equal(at[better], where[better])
            assert (top[~better] <= known[~better]).all()
        if make is usual:
            assert len(found) == 12 and sum(len(i) for i, _ in found) < 0.02 * 2 * distances.size
