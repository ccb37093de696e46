import random
import re

import numpy as np

from termweave.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            gain = d.MATCH if a[i - 1] == b[j - 1] else d.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + gain, h[i - 1][j] + d.GAP, h[i][j - 1] + d.GAP)
    return max(map(max, h))


def test_align_is_smith_waterman():
    rng = np.random.default_rng(3)
    item = rng.integers(1, 6, (40, 9)).astype(np.uint64)
    window = rng.integers(1, 6, (40, 14)).astype(np.uint64)
    item[:20, 6:] = 0
    best, first, last = d.align(item, window)
    for i in range(40):
        a = [x for x in item[i].tolist() if x]
        assert best[i] == smith_waterman(a, window[i].tolist())
        assert best[i] == smith_waterman(a, window[i, first[i] : last[i]].tolist())


def test_against_alignment_with_every_item(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(2000)] + ["the", "of"] * 200
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(15, 40)))) for i in range(12)] + [(12, None), (13, ""), (None, "a b c d e f")]
    rows = [(i, " ".join(text(rng.choice([3, 60, 300])))) for i in range(40)]
    for i in range(40, 90):
        copy = words(rng.choice(items[:12])[1])
        for _ in range(int(len(copy) * rng.choice([0, 0.1, 0.2, 0.5, 0.8]))):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[], ["new"], ["two", "more"]])
        rows.append((i, " ".join(text(20) + [w.upper() for w in copy] + text(20))))
    rows += [(90, items[3][1])] * 2 + [(91, None), (92, ""), (None, items[0][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in rows:
        for item, body in items:
            if item is not None and words(body) and smith_waterman(words(body), words(t)) >= d.THRESHOLD * d.MATCH * len(words(body)):
                want.add((i, item))
    for share in (d.ITEM_WORDS, 300):
        monkeypatch.setattr(d, "ITEM_WORDS", share)
        found = d.best_matches(docs, bench).collect()
        assert len(found) == len(rows)
        assert {(r.doc_id, r.item_id) for r in found if r.item_id is not None} == want
        clean = d.remove_contaminated(docs, bench)
        assert clean.columns == docs.columns
        dirty = {i for i, _ in want}
        assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in rows if i not in dirty)
    assert d.best_matches(docs, bench.limit(0)).where("item_id IS NOT NULL").count() == 0
    assert d.remove_contaminated(docs.limit(0), bench).count() == 0


def test_edited_copies_are_found_by_the_runs_they_kept(spark, monkeypatch):
    text = lambda i, n: [f"t{i}w{j}" for j in range(n)]
    edited = lambda i, step: [w if j % step < step - 1 else f"e{j}" for j, w in enumerate(text(i, 20))]
    # Items 0 and 1: the edited copy is the only trace. Item 2: an exact copy stands in another document. Item 3: the only run
    # that the copy kept is in every document and every item.
    items = [(i, text(i, 20)) for i in range(4)]
    items = [(i, x + ["as", "we", "all", "know"]) if i == 3 else (i, x) for i, x in items] + [(9, ["as", "we", "all", "know"] + text(9, 8))]
    lost = [w if j % 3 < 2 else "e" for j, w in enumerate(text(3, 20))] + ["as", "we", "all"]
    rows = [(0, edited(0, 4)), (1, edited(1, 5)), (2, edited(2, 4)), (3, text(2, 20)), (4, lost)]
    rows = [(i, [f"d{i}"] * 30 + x + ["as", "we", "all", "know"] * 5) for i, x in rows]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    want = {(i, j) for i, x in rows for j, y in items if smith_waterman(y, x) >= d.THRESHOLD * d.MATCH * len(y)}
    assert want == {(0, 0), (1, 1), (2, 2), (3, 2), (4, 3)}
    found = d.best_matches(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.item_id is not None} == want
    assert d.remove_contaminated(docs, bench).count() == 0
    here = d._Items(np.array([i for i, _ in items]), [" ".join(x) for _, x in items])
    hashed = d.word_hashes(d.pa.array([" ".join(x) for _, x in rows]))
    whole = sorted(zip(*(x.tolist() for x in d._score(here, *hashed, d.THRESHOLD))))
    monkeypatch.setattr(d, "_HITS_AT_ONCE", 7)
    assert sorted(zip(*(x.tolist() for x in d._score(here, *hashed, d.THRESHOLD)))) == whole
