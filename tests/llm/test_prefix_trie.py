import hashlib
import random
import zlib

from pyspark.sql import functions as F

from termweave.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    """Turns of every conversation; equal turns go by fingerprint."""
    out = {}
    mark = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest()
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, mark(r))):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(seqs):
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}

    def below(p):
        leaves, saved = (not kids[p]), (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for q in kids[p]:
            a, b = below(q)
            leaves, saved = leaves + a, saved + b
        return int(leaves), saved

    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(kids[p]), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def collected(nodes, ends):
    rows = nodes.join(pt.end_digests(ends), "node", "left").fillna({"ends_sha256": hashlib.sha256(b"").hexdigest()})
    columns = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r) for r in rows.select(*columns).collect()), key=repr)


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-4, 4 * n), n):
        for t in range(rng.randrange(1, longest + 1)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "user", "é" if rng.random() < 0.8 else str(rng.randrange(3))))
    odd = [(None, 1, "user", "x"), (400, None, None, None), (400, 1, "a", "bc"), (400, 1, "ab", "c"), (400, 1, "ab", "c"), (401, 5, "user", "")]
    same = [(c, t, "user", "copy") for c in range(500, 530) for t in range(3)]
    return rows + odd + same


def test_nodes_and_totals_against_brute_force(spark):
    for seed, n, longest in ((1, 25, 9), (2, 12, 37)):
        rows = conversations(seed, n, longest)
        frame = spark.createDataFrame(rows, SCHEMA).withColumns({"pos": F.lit(1), "name": F.lit("x"), "node": F.lit(0)})
        turns = pt.turns_of(frame)
        own = ordered(rows)
        assert collected(*pt.trie(turns.select("conv_id").distinct(), turns)) == brute(own)
        if longest < 10:
            convs, openings = pt.with_shared_openings(turns)
            assert collected(*pt.trie(convs, openings)) == brute(rebuilt(own))


def test_chunks_of_ids_join_to_one_digest(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK", 3)
    ends = spark.createDataFrame([(b"a", i) for i in range(-5, 20)] + [(b"b", 7)], "node binary, conv_id long")
    got = {bytes(r.node): r.ends_sha256 for r in pt.end_digests(ends).collect()}
    assert got == {b"a": hashlib.sha256(",".join(map(str, range(-5, 20))).encode()).hexdigest(), b"b": hashlib.sha256(b"7").hexdigest()}


def test_empty_single_turns_and_turnless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    turns = pt.turns_of(empty)
    assert collected(*pt.trie(turns.select("conv_id").distinct(), turns)) == []
    turns = pt.turns_of(spark.createDataFrame([(1, 0, "u", "a"), (2, 0, "u", "a"), (3, 0, "u", "b")], SCHEMA))
    convs = spark.createDataFrame([(i,) for i in range(1, 5)], "conv_id long")
    assert collected(*pt.trie(convs, turns)) == brute({1: [("u", "a")], 2: [("u", "a")], 3: [("u", "b")], 4: []})
