import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from termweave.llm import cross_alignment as ca
from termweave.llm.word_pieces import byte_characters

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def plain_tokens(text):
    """Ids and bytes of both tokenizations, straight from the libraries; nothing if one does not give the text back."""
    if not text:
        return [], []
    t = Tokenizer.from_file(public_tokenizers.path(A)) if not hasattr(plain_tokens, "t") else plain_tokens.t
    plain_tokens.t = t
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B)) if not hasattr(plain_tokens, "m") else plain_tokens.m
    plain_tokens.m = m
    of = byte_characters()
    a = [(i, bytes(of[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()) for i in m.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def plain_groups(a, b):
    ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
    both = sorted(set(ends[0]) & set(ends[1]))
    out = [([], []) for _ in both]
    for k, side in enumerate((a, b)):
        for (i, _), end in zip(side, ends[k]):
            out[bisect_left(both, end)][k].append(i)
    return out


def brute(rows):
    groups = [plain_groups(*plain_tokens(text)) for _, text in rows]
    links = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for g in groups]
    count = Counter(p for c in links for p in c)
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (doc, _), g, c in zip(rows, groups, links):
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        best = sum(n for p, n in c.items() if count[p] == most[p[0]])
        out.append((doc, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), best, sum(n * count[p] for p, n in c.items()), shown))
    return sorted(out, key=repr)


ROWS = [
    (1, "Plain words, unhappily misaligned tokenization."),
    (2, "Ünïcode 漢字 😀😀 tab\tnew\nline  double   blanks\n\n"),
    (3, None),
    (4, ""),
    (5, "a literal ▁ block"),
    (6, "<s> <|endoftext|> <0x41> </s>"),
    (7, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa " * 3),
    (7, "Plain words again"),
    (None, "Plain words"),
    (None, "Plain words"),
    (8, " leading blank"),
    (9, "\x00\r\x1c 　"),
    (10, "unhappily mis" + "x" * 5000 + " words" * 20_000),
]


def run(spark, rows, tmp_path, name, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("x"), "pairs": F.lit(1), "n_a": F.lit(None)})
    path = str(tmp_path / name)
    stored = ca.store(ca.alignments(frame, A, B), path)
    shown = {r.row: r.groups for r in stored.collect()}
    got = ca.with_link_counts(stored, **options).collect()
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, shown[r.row]) for r in got), key=repr)


def test_against_the_libraries(spark, tmp_path):
    rng = random.Random(2)
    words = ["unhappily", "tokenization", "Straße", "naïve", "x1y2", "(foo_bar)", "misaligned", "漢", "of"]
    rows = ROWS + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(30)]
    want = brute(rows)
    assert run(spark, rows, tmp_path, "a") == want
    for limit in (3, 200):  # rarer pairs by the shuffled way
        assert run(spark, rows, tmp_path, f"b{limit}", limit=limit) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.lists(st.integers(1, 4), max_size=60), st.integers(0, 60))
def test_common_ends(x, y, same):
    x, y = [1] * same + x + [2] * same, [1] * same + y + [2] * same
    gap = sum(x) - sum(y)
    x, y = x + [1 + max(0, -gap)], y + [1 + max(0, gap)]
    a, b = np.cumsum(x), np.cumsum(y)
    close_a, close_b = ca.common_ends(a, b)
    assert close_a.tolist() == np.isin(a, b).tolist() and close_b.tolist() == np.isin(b, a).tolist()


def test_long_groups_are_not_expanded(monkeypatch):
    monkeypatch.setattr(ca, "PAIRS_AT_ONCE", 7)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 400), rng.integers(0, 9, 300)
    off_a, off_b, doc = np.array([0, 1, 300, 301, 400]), np.array([0, 1, 2, 200, 300]), np.array([0, 0, 1, 1])
    want = Counter((int(doc[g]), int(x) << 32 | int(y)) for g in range(4) for x in a[off_a[g] : off_a[g + 1]] for y in b[off_b[g] : off_b[g + 1]])
    got = ca.pair_counts(a, b, off_a, off_b, doc)
    assert {(int(d), int(p)): int(n) for d, p, n in zip(*got)} == want


def test_empty(spark, tmp_path):
    assert run(spark, [], tmp_path, "empty") == []
