import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from termweave.llm import guess_cost as g


def cheapest(value):
    """All segmentations, one by one."""
    runs = g.run_starts(value)

    def walk(end):
        if not end:
            return 0.0
        return min(cost + walk(start) for start, cost, _ in g.pieces_ending(value, runs, end))

    return walk(len(value))


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("pas1w0rdqe2Z!"), min_size=1, max_size=9))
def test_programme_finds_the_cheapest_segmentation(value):
    assert abs(g.guess_cost(value) - cheapest(value)) < 1e-9


def test_chosen_values_are_cheap_and_generated_ones_are_not():
    for value in ("Password2019", "qwertyuiop", "aaaaaaaaaaaa", "abcdefgh1234", "P@ssw0rd123", "summer2020summer2020", "12.05.1987"):
        assert g.guess_cost(value) < g.STRONG, value
    for value in ("xK9#mQ2$vL7p", "f3Jw8zRt1QpZ", "b7db7aa4a5fcc783"):
        assert g.guess_cost(value) >= g.STRONG, value


def test_spans():
    text = 'é Password = "abc" token:abcdef_1 AKIA' + "A1" * 8 + " " + "0f" * 12 + " pwd: xK9#mQ2$vL7p, pwd: password1 tokenſecret=zz"
    assert g.written(g.find_spans(text)).split(",")[0] == "assign:19:33"
    kinds = [k for _, _, k in g.find_spans(text)]
    assert kinds == ["assign", "access", "hex", "guess"]
    start, end, _ = g.find_spans(text)[-1]
    assert text[start:end] == "xK9#mQ2$vL7p"
    assert g.find_spans("AKIA" + "B" * 15) == [] and g.find_spans("a" * 23) == []
    assert [k for _, _, k in g.find_spans("secret=" + "a" * 24)] == ["assign", "hex"]
    assert g.find_spans("Kſecret=abcdefg") == []


def test_the_cost_alone_decides():
    def guessed(text):
        return [text[a:b] for a, b, kind in g.find_spans(text) if kind == "guess"]

    assert guessed("passphrase: qzvkxjwpbtrmhgfdlcny") == ["qzvkxjwpbtrmhgfdlcny"]
    assert guessed("pwd: 84930284756610293, pwd: QZVKXJWPBTRM.") == ["84930284756610293", "QZVKXJWPBTRM"]
    for scheme in ("Bearer", "Basic", "token"):
        for text in (f"Authorization: {scheme} xK9mQ2vL7pRt", f'"authorization": "{scheme} xK9mQ2vL7pRt"'):
            assert guessed(text) == ["xK9mQ2vL7pRt"], text
    assert guessed("auth: pwd: xK9#mQ2$vL7p") == ["xK9#mQ2$vL7p"]
    text = "password=Tr0ub4dor&3xK9!z rest"
    assert g.find_spans(text) == [(0, 18, "assign"), (9, 25, "guess")]
    assert guessed("password=xK9mQ2vL7pRt, token=" + "0f" * 14) == []  # wholly in base spans
    for text in ("the password is required.", "pwd: ********", "Authorization: Bearer", "the secret is understanding people", "pwd: 1234567890"):
        assert guessed(text) == [], text


def test_query_rows(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("token=:api_key 0af9 AKIAZ\"'") for _ in range(400))) for i in range(60)]
    rows += [(None, "password=abcdefgh"), (7, None), (8, ""), (8, ""), (9, "x" * 200_000 + "token=abcdefgh")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, spans int")
    got = sorted((tuple(r) for r in g.scan(docs).collect()), key=str)
    want = []
    for i, t in rows:
        spans = g.find_spans(t or "")
        base = g.written([s for s in spans if s[2] != "guess"])
        want.append((i, *[sum(s[2] == k for s in spans) for k in g.KINDS], hashlib.sha256(base.encode()).hexdigest(), g.written(spans)))
    assert got == sorted(want, key=str)
    assert g.scan(docs.limit(0)).count() == 0
