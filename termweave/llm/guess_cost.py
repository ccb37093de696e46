"""Secret scan: fixed patterns, plus values beside credential words whose guess cost is high.

The guess cost of a value is the least sum of costs (log10 of guesses) over all ways to cut it into words, dates, repeats,
sequences, keyboard walks and brute-force characters; a dynamic programme over the positions finds it. A value that people
choose ("Password2019!", "qwerty12345") is cheap, a generated one is not. The cost alone decides: of letters only, of digits
only or short, every value beside a credential word is weighed. Common English words are cheap too, so that "the password is
required" gives no span.

Kinds of spans: ``assign``, ``access`` and ``hex`` from the patterns, the whole match each; ``guess`` for further values,
also one that reaches beyond the base spans over it. A scheme ("Authorization: Bearer ...") may stand before the value.
Offsets are code points, ends exclusive.

Defined results: null text is empty text; an empty text has no spans; a text is scanned whole, whatever its length; equal rows give
equal results. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import remembered

KINDS = ("assign", "access", "hex", "guess")

# The patterns of the base spans, matched leftmost and without overlap per kind.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Credential words that make the value after ``:``, ``=`` or "is", and after a scheme if there is one, a candidate for the guess cost.
CONTEXT = re.compile(
    r"""(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|bearer|credentials?)"""
    r"""["']?[\x20\t]{0,3}(?:[:=]{1,2}>?|(?<=\x20)(?:is|ist|est|es)(?=\x20))[\x20\t]{0,3}["'`]?"""
    r"""(?:(?ai:bearer|basic|digest|negotiate|token|api[_-]?key)[\x20\t]{1,3}["'`]?)?([^\s"'`]+)"""
)
_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential")
STRONG = 11.0  # log10 of guesses

# Common password words, most common first, then words and parts of words of plain text.
WORDS = """password admin welcome login letmein qwerty monkey dragon master secret sunshine princess football baseball shadow
superman batman trustno iloveyou summer winter spring autumn hello freedom whatever charlie michael jordan thomas daniel
robert george andrew jessica jennifer ashley nicole computer internet server access system user guest root test demo default
changeme private public company office manager service support database oracle google apple orange banana cookie cheese
chocolate flower garden house family friend angel lucky happy love money dollar silver golden diamond tiger lion eagle
falcon phoenix hunter ranger soccer hockey tennis guitar music summer january february march april june july august
september october november december monday tuesday wednesday thursday friday saturday sunday pass word key token
bearer basic digest negotiate authorization authentication credentials required request reset changed change expired invalid
incorrect correct wrong valid missing empty unknown undefined null none true false string number value values encrypted
encryption protected protect stored stores generated generator provided provide sent send received receive needed necessary
important optional mandatory sensitive private secure security strong stronger weak hidden visible available unavailable
different similar possible impossible unique random simple complex following followed longer shorter usually always never
probably definitely something anything nothing everything someone anyone everyone another between before after because
through without within against should would could might please contact enter entered entering confirm confirmed forgotten
forgot update updated username login account address email website browser network protocol service application program
development production environment variable parameter function configuration settings option options document documents
information knowledge understanding example examples sample placeholder redacted removed replace replaced
recovery recover ingredient ingredients sauce success successful identifier signature certificate instrument instruments
currency economy language linguistic sequence separator character characters letters digits symbols numeric alphabetic
minimum maximum length length limit limited limitless accept accepted accepting allow allowed denied granted
permission permissions authority authorized unauthorized authenticate response client session cookie storage database
memory hardware software computer machine physical digital electronic government community relationship happiness
meaning purpose ancient mystery treasure century history hundred thousand million about above across again along also
around being below both case come data does done during each easy even every find first form from full give given
good great hard have help here high hold home inside into just keep kept known large last less life like line list
little long look made make many mean more most much must name near need next note often once only open order other
over part people place point real right same seen set shared short show side small some such sure take than that
their them then there these they thing think this those three time together under until used using very want well what when
where which while whole will with word words work world written year your
ation ition ment ness able ible ing tion sion ally ance ence ity ful less ous ive ized ised izing ising ated ating ary ory
inter trans under over anti auto counter multi non pre pro super con com dis mis""".split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
LONGEST = max(map(len, WORDS))
LEET = str.maketrans("4@31!05$7", "aaeiiosst")
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATES = re.compile(
    r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:(?:19|20)\d\d|\d\d)"
    r"|(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d\d"
)
YEAR = re.compile(r"(?:19|20)\d\d")
PIECE = 0.4  # what one more piece adds


@remembered()
def _neighbours() -> frozenset[tuple[str, str]]:
    """Pairs of keys beside each other on a keyboard whose rows are shifted by half a key."""
    place = {c: (x + row / 2, row) for row, keys in enumerate(KEY_ROWS) for x, c in enumerate(keys)}
    return frozenset((a, b) for a, (x, r) in place.items() for b, (y, s) in place.items() if a != b and abs(r - s) <= 1 and abs(x - y) <= 1)


def char_cost(c: str) -> float:
    if c.isdigit():
        return 1.0
    if c.isascii() and c.isalpha():
        return math.log10(26)
    return math.log10(33 if c.isascii() else 100)


def _spelling(piece: str, plain: str) -> float:
    """Extra cost of capitals and replaced letters."""
    upper = sum(c.isupper() for c in piece)
    case = 0.0 if not upper else 0.3 if upper == len(piece) or (upper == 1 and piece[0].isupper()) else math.log10(math.comb(len(piece), upper) + 1)
    return case + 0.3 * sum(a != b for a, b in zip(piece.lower(), plain))


def pieces_ending(value: str, runs: dict[str, list[int]], end: int) -> Iterator[tuple[int, float, str]]:
    """(start, cost, kind) of the pieces that end at ``end``. ``runs`` has where the run at each place starts."""
    yield end - 1, char_cost(value[end - 1]), "brute"
    for start in range(max(0, end - LONGEST), end - 2):
        piece = value[start:end]
        plain = piece.lower().translate(LEET)
        for word in {piece.lower(), plain}:
            if word in RANK:
                yield start, PIECE + math.log10(RANK[word] + 1) + _spelling(piece, word), "word"
    for start in range(max(0, end - 10), end - 5):
        if DATES.fullmatch(value, start, end):
            yield start, PIECE + 4.6 + 0.3 * (not value[start:end].isdigit()), "date"
    if end >= 4 and YEAR.fullmatch(value, end - 4, end):
        yield end - 4, PIECE + 2.1, "date"
    for kind in ("repeat", "sequence", "walk"):
        start = runs[kind][end - 1]
        n = end - start
        if kind == "repeat" and n >= 3:
            yield start, PIECE + char_cost(value[start]) + math.log10(n), kind
        elif kind == "sequence" and n >= 3:
            yield start, PIECE + char_cost(value[start]) + 0.3 + math.log10(n), kind
        elif kind == "walk" and n >= 3:
            turns = runs["turns"][end - 1] - runs["turns"][start + 1]
            yield start, PIECE + math.log10(47 * 6) + 0.5 * turns + math.log10(n), kind
    for period in range(2, min(12, end // 2) + 1):  # a block and its repetitions
        start = end - 2 * period
        if value[start : start + period] == value[start + period : end]:
            yield end - period, 0.4, "again"


def run_starts(value: str) -> dict[str, list[int]]:
    """For every place, where the longest repeat, sequence and keyboard walk that covers it and the place before starts.

    ``turns`` counts the places before it at which the characters change from rising to falling or back.
    """
    near = _neighbours()
    low = value.lower()
    out: dict[str, list[int]] = {"repeat": [], "sequence": [], "walk": []}
    step = 0
    for i, c in enumerate(low):
        before = low[i - 1] if i else ""
        out["repeat"].append(out["repeat"][-1] if before == c else i)
        out["walk"].append(out["walk"][-1] if (before, c) in near else i)
        now = ord(c) - ord(before) if i and c.isalnum() and before.isalnum() else 0
        if abs(now) == 1:
            out["sequence"].append(out["sequence"][-1] if now == step else i - 1)
        else:
            out["sequence"].append(i)
        step = now
    turns = [0] * len(value)
    for i in range(2, len(value)):
        a, b, c = map(ord, value[i - 2 : i + 1])
        turns[i] = turns[i - 1] + ((c - b) * (b - a) < 0)
    out["turns"] = turns
    return out


def guess_cost(value: str) -> float:
    """log10 of the guesses that the cheapest segmentation needs."""
    runs, best = run_starts(value), [0.0]
    for end in range(1, len(value) + 1):
        best.append(min(best[start] + cost for start, cost, _ in pieces_ending(value, runs, end)))
    return best[-1]


def _value(match: re.Match) -> tuple[int, int]:
    start, end = match.span(1)
    while end > start and match.string[end - 1] in ".,;:)]}>":
        end -= 1
    return start, end


def _covered(start: int, end: int, spans: list[tuple[int, int, str]]) -> bool:
    """Whether the spans together, in the order of their starts, hold all of ``start`` to ``end``."""
    for a, b, _ in spans:
        if a <= start < b:
            start = b
    return start >= end


def _guesses(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Values beside credential words that cost enough and are not wholly in base spans."""
    found, base, at, i = [], sorted(base), 0, 0
    while m := CONTEXT.search(text, at):
        start, end = _value(m)
        at = m.end()
        while i < len(base) and base[i][1] <= start:  # values start ever later
            i += 1
        if _covered(start, end, base[i : bisect_left(base, (end,))]):
            continue
        if guess_cost(text[start:end]) >= STRONG:
            found.append((start, end, "guess"))
        else:
            at = m.start(1)  # a cheap value may hold a credential word itself
    return found


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind."""
    spans = []
    low = text.lower()
    hinted = any(h in low for h in _HINTS)
    if hinted:
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if hinted:
        spans += _guesses(text, spans)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_OUT = pa.schema(
    [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            spans = find_spans(text or "")
            base = written([s for s in spans if s[2] != "guess"])
            counts = [sum(s[2] == k for s in spans) for k in KINDS]
            rows.append([*counts, hashlib.sha256(base.encode()).hexdigest(), written(spans)])
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), _OUT.types[1:])] if rows else [pa.array([], t) for t in _OUT.types[1:]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=_OUT)


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans)`` of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(_scan, f"doc_id long, {counts}, base_sha256 string, spans string")
