"""Surrogates for personal data: keyed, type-consistent, one to one.

Every detected entity is replaced by another value of its type and format. The replacement is a keyed permutation of all values of that
format (a Feistel network on the value's number, walked past values outside the format), stepped once along its cycle, so

- the same value has the same surrogate in every document and in every notation (coreference);
- two values of a type never share a surrogate (distinctness), and no value is its own surrogate;
- nothing has to be looked up, joined or kept: a lost task gives the same text again.

Types: e-mail addresses, IPv4 and IPv6 addresses (private stays private), payment card numbers (Luhn remainder and first digit
stay), IBANs (country and check digits valid), social security numbers, phone numbers (country code and punctuation stay),
persons after a form of address (gender and script stay; later mentions of the name in the same text follow).
Letters are replaced within their script and case, digits by digits, all else stays. An IPv6 address may be compressed or end in
an IPv4 one; its surrogate is written in full. An IPv4-mapped one is the IPv4 address and stays mapped.

``clashes`` checks a corpus: it lists surrogates that stand for two originals and originals with two surrogates.
It is empty unless code or key differ between workers. Each text is checked as well when it is written.

Defined results: null text stays null, empty text empty; texts without entities are unchanged; a text is treated whole; overlapping finds go to the
type listed first; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import remembered

KINDS = ("email", "ip", "card", "iban", "ssn", "phone", "person")

# Letters that replace one another, by script and case. ``_others`` has those of all other letters.
ALPHABETS = (
    "0-9",
    "a-z",
    "A-Z",
    "ß-ö",
    "ø-ÿ",
    "À-Ö",
    "Ø-Þ",
    "α-ω",
    "Α-Ρ",
    "а-я",
    "А-Я",
    "א-ת",
    "ا-غ",
    "ف-ي",
    "अ-ह",
    "ぁ-ゖ",
    "ァ-ヺ",
    "一-龥",
    "가-힣",
)
_RANGES = tuple((ord(a[0]), ord(a[2])) for a in ALPHABETS)

# Forms of address and given names by gender.
ADDRESS = {
    "m": ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "M", "Señor", "Sr"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra"),
    "": ("Dr", "Prof", "Professor"),
}
NAMES = {
    "m": """James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Paul Mark George Peter
    Hans Klaus Jürgen Stefan Pierre Jean Michel Jacques Carlos José Luis Miguel Antonio Javier""".split(),
    "f": """Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Emily Anna Laura Helen
    Ursula Monika Petra Sabine Marie Isabelle Sophie Claire María Carmen Ana Isabel Pilar Lucía""".split(),
}
_GENDER = {name: gender for gender, names in NAMES.items() for name in names}

_NAME = r"[^\W\d_a-zß-öø-ÿα-ωа-я][^\W\d_]+(?:-[^\W\d_]+)?"
_OCTET, _GROUP = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)", "[0-9a-fA-F]{1,4}"
_IP4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"


def _ip6_forms() -> Iterator[str]:
    """Eight groups, or n groups, ``::`` and at most 7 - n others; an IPv4 address may stand for the last two."""
    yield f"(?:{_GROUP}:){{6}}{_IP4}"
    yield f"(?:{_GROUP}:){{7}}{_GROUP}"
    for n in range(7, -1, -1):
        left = f"{_GROUP}(?::{_GROUP}){{{n - 1}}}::" if n else "::"
        if n <= 5:
            yield f"{left}(?:{_GROUP}:){{0,{5 - n}}}{_IP4}"
        if n < 7:
            yield f"{left}{_GROUP}(?::{_GROUP}){{0,{6 - n}}}"
        if n:
            yield left


_IP6 = "|".join(rf"(?:{form})(?!\w|:[\w:]|\.\d)" for form in _ip6_forms())
_PATTERNS = (
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]+@(?:[\w-]+\.)+[A-Za-z]{2,}(?![\w-])")),
    ("ip", re.compile(rf"(?<![\w.]){_IP4}(?![\w]|\.\d)|(?:(?<![\w:])|(?<=[G-Zg-z]:))(?:{_IP6})", re.A)),
    ("card", re.compile(r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w]|[.-]\d)", re.A)),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A)),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A)),
    ("phone", re.compile(r"(?!\d{4}-\d\d-\d\d(?!\d)|\d{1,2}[.-]\d{1,2}[.-]\d{4}(?!\d))(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ ]?|\d{2,4}[ .-])\d{2,4}(?:[ .-]\d{2,4}){1,3}(?!\w|[.-]\d)|(?<![\w.+-])\+\d{8,15}(?!\w)", re.A)),
)
# Country codes of one and two digits; all others have three. The digits decide, not the punctuation.
_COUNTRY = re.compile(r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})|")
_PERSON = re.compile(rf"(?<!\w)({'|'.join(a for group in ADDRESS.values() for a in group)})\.?[ ]({_NAME}(?:[ ]{_NAME}){{0,2}})")
_PERSON_HINTS = tuple(a + end for group in ADDRESS.values() for a in group for end in (" ", "."))
_TITLE_GENDER = {a: gender for gender, group in ADDRESS.items() for a in group}


class Permutation:
    """Keyed permutations of 0..n-1 with a single cycle, one per label."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, label: str, i: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        data = f"{label}|{i}|{bits}|".encode() + half.to_bytes(size, "big")
        out = b""
        while len(out) < size:
            out += hashlib.blake2b(data + bytes([len(out) & 255]), key=self.key, digest_size=32).digest()
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _feistel(self, label: str, x: int, bits: int, back: bool) -> int:
        left, right, mask = x >> bits, x & ((1 << bits) - 1), (1 << bits) - 1
        for i in reversed(range(8)) if back else range(8):
            if back:
                left, right = (right ^ self._round(label, i, left, bits)) & mask, left
            else:
                left, right = right, (left ^ self._round(label, i, right, bits)) & mask
        return left << bits | right

    def _shuffle(self, label: str, x: int, n: int, back: bool) -> int:
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        x = self._feistel(label, x, bits, back)
        while x >= n:
            x = self._feistel(label, x, bits, back)
        return x

    def step(self, label: str, x: int, n: int) -> int:
        """The value after x on the cycle; never x itself if n > 1."""
        if n < 2:
            return x
        return self._shuffle(label, (self._shuffle(label, x, n, True) + 1) % n, n, False)

    def walk(self, label: str, x: int, n: int, fits: Callable[[int], bool]) -> int:
        """The next value on the cycle that fits; x must fit."""
        y = self.step(label, x, n)
        while not fits(y):
            y = self.step(label, y, n)
        return y


Alphabet = tuple[int, int] | str  # code points from and to, or letters


@remembered()
def _alphabet(c: str) -> Alphabet | None:
    for low, high in _RANGES:
        if low <= ord(c) <= high:
            return low, high
    return _others(ord(c) >> 8, *_script(c)) if c.isalpha() else None


def _script(c: str) -> tuple[str, str]:
    return unicodedata.name(c, "").split(" ")[0], unicodedata.category(c)


@remembered()
def _others(page: int, script: str, category: str) -> str | None:
    """Letters outside ``ALPHABETS`` with the script and case, out of 256 code points; none if a letter stands alone there."""
    letters = map(chr, range(page << 8, (page + 1) << 8))
    found = [c for c in letters if c.isalpha() and _script(c) == (script, category) and not any(a <= ord(c) <= b for a, b in _RANGES)]
    return "".join(found) if len(found) > 1 else None


def _size(span: Alphabet) -> int:
    return len(span) if isinstance(span, str) else span[1] - span[0] + 1


def _numbered(text: str, spans: list[Alphabet | None]) -> tuple[int, int]:
    """Number of a text among all texts of its shape, and how many there are."""
    x, n = 0, 1
    for c, span in zip(text, spans):
        if span:
            size = _size(span)
            x, n = x * size + (span.index(c) if isinstance(span, str) else ord(c) - span[0]), n * size
    return x, n


def _spelled(text: str, spans: list[Alphabet | None], x: int) -> str:
    out = list(text)
    for i in reversed(range(len(text))):
        if span := spans[i]:
            x, rest = divmod(x, _size(span))
            out[i] = span[rest] if isinstance(span, str) else chr(span[0] + rest)
    return "".join(out)


class Surrogates:
    def __init__(self, key: bytes):
        self.permute = Permutation(key)
        self.of = lru_cache(maxsize=100_000)(self._of)

    def shaped(self, label: str, text: str, spans=None, fits: Callable[[str], bool] | None = None) -> str:
        """Another text of the same shape; characters without an alphabet are part of the shape."""
        spans = spans or [_alphabet(c) for c in text]
        x, n = _numbered(text, spans)
        label = f"{label}|{''.join(c if not s else s[0] if isinstance(s, str) else chr(s[0]) for c, s in zip(text, spans))}"
        if fits is None:
            return _spelled(text, spans, self.permute.step(label, x, n))
        return _spelled(text, spans, self.permute.walk(label, x, n, lambda y: fits(_spelled(text, spans, y))))

    def _of(self, kind: str, value: str) -> str:
        return getattr(self, f"_{kind}")(value)

    def _email(self, value: str) -> str:
        local, domain = value.rsplit("@", 1)
        host, top = domain.rsplit(".", 1)
        return f"{self.shaped('local', local)}@{self.shaped('host', host.lower())}.{top}"

    def _ip(self, value: str) -> str:
        bits, x = _address(value)
        if bits == 128:
            x = self.permute.walk("ip6", x, 1 << 128, lambda y: y >> 32 != 0xFFFF)
            return ":".join(f"{x >> shift & 0xFFFF:x}" for shift in range(112, -1, -16))
        block = _private_block(x)
        if block:
            low, size = block
            x = low + self.permute.step(f"ip{low}", x - low, size)
        else:
            x = self.permute.walk("ip", x, 1 << 32, lambda y: not _private_block(y))
        return "::ffff:" * (":" in value) + ".".join(str(x >> shift & 255) for shift in (24, 16, 8, 0))

    def _digits(self, label: str, value: str, change: Callable[[str], str]) -> str:
        digits = iter(change("".join(c for c in value if c.isdigit())))
        return "".join(next(digits) if c.isdigit() else c for c in value)

    def _card(self, value: str) -> str:
        def change(digits: str) -> str:
            body = digits[0] + self.shaped("card" + digits[0], digits[1:-1])
            return body + str((_luhn(digits) - _luhn(body + "0")) % 10)

        return self._digits("card", value, change)

    def _iban(self, value: str) -> str:
        plain = value.replace(" ", "")
        body = self.shaped("iban" + plain[:2], plain[4:])
        check = 98 - _mod97(body + plain[:2] + "00")
        new = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(" " if c == " " else next(new) for c in value)

    def _ssn(self, value: str) -> str:
        return self.shaped("ssn", value)

    def _phone(self, value: str) -> str:
        code = _COUNTRY.match(canonical("phone", value))[0]
        country = len(code[1:])

        def change(digits: str) -> str:
            # Area code and exchange keep to 2-9 where they did.
            rest = digits[country:]
            spans = [(50, 57) if i % 3 == 0 and i < 6 and c >= "2" else (48, 49) if i % 3 == 0 and i < 6 else (48, 57) for i, c in enumerate(rest)]
            return digits[:country] + self.shaped("phone" + code, rest, spans)

        return self._digits("phone", value, change)

    def _given(self, gender: str, name: str) -> str:
        names = NAMES[gender]
        return names[self.permute.step("given" + gender, names.index(name), len(names))]

    def name(self, name: str) -> str:
        """A name of the same gender if it is a known given name, else one of the same script and length."""
        if name in _GENDER:
            return self._given(_GENDER[name], name)
        return self.shaped("name", name, fits=lambda x: x not in _GENDER)

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with surrogates, and the number of finds by kind."""
        finds = find(text)
        counts = dict.fromkeys(KINDS, 0)
        out, at, used = [], 0, {}
        for start, end, kind in finds:
            value = text[start:end]
            new = self.name(value) if kind == "name" else self.of(kind, value)
            key = (kind, canonical(kind, new))
            if used.setdefault(key, canonical(kind, value)) != canonical(kind, value):
                raise ValueError(f"two values of kind {kind} have one surrogate")
            out += [text[at:start], new]
            at = end
            if kind != "name":
                counts[kind] += 1
        counts["person"] = sum(1 for _ in _persons(text))
        return "".join(out) + text[at:], counts


def canonical(kind: str, value: str) -> str:
    """What makes two notations the same value."""
    if kind in ("card", "phone"):
        return ("+" if value.startswith("+") else "") + re.sub(r"\D", "", value)
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        return f"{local}@{domain.lower()}"
    if kind == "ip":
        return "{}:{:x}".format(*_address(value))
    return value.replace(" ", "") if kind == "iban" else value


def _address(value: str) -> tuple[int, int]:
    """Bits and number of an IP address; an IPv4-mapped one is the IPv4 address."""

    def number(dotted: str) -> int:
        return int.from_bytes(bytes(int(part) for part in dotted.split(".")), "big")

    def groups(part: str) -> list[int]:
        out = []
        for g in part.split(":") if part else []:
            out += [number(g) >> 16, number(g) & 0xFFFF] if "." in g else [int(g, 16)]
        return out

    if ":" not in value:
        return 32, number(value)
    head, _, tail = value.partition("::")
    left, right = groups(head), groups(tail)
    x = 0
    for g in (*left, *[0] * (8 - len(left) - len(right)), *right):
        x = x << 16 | g
    return (32, x & 0xFFFFFFFF) if x >> 32 == 0xFFFF else (128, x)


def _private_block(x: int) -> tuple[int, int] | None:
    for low, size in ((10 << 24, 1 << 24), (127 << 24, 1 << 24), ((172 << 24) + (16 << 16), 1 << 20), ((192 << 24) + (168 << 16), 1 << 16)):
        if low <= x < low + size:
            return low, size
    return None


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _persons(text: str) -> Iterator[tuple[str, int, int]]:
    if any(h in text for h in _PERSON_HINTS):
        for m in _PERSON.finditer(text):
            yield m[1], *m.span(2)


def find(text: str) -> list[tuple[int, int, str]]:
    """Entities as (start, end, kind), ordered, without overlap; names of persons come word by word as kind ``name``."""
    spans: list[tuple[int, int, str]] = []
    digits = any(d in text for d in "0123456789")
    for kind, pattern in _PATTERNS:
        if kind == "email" and "@" not in text or kind != "email" and not digits and not (kind == "ip" and ":" in text):
            continue
        for m in pattern.finditer(text):
            if kind == "iban" and _mod97(m[0].replace(" ", "")[4:] + m[0][:4]) != 1:
                continue
            spans.append((*m.span(), kind))
    names = {text[a:b] for _, s, e in _persons(text) for a, b in _words(text, s, e)}
    if names:
        word = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
        spans += [(*m.span(), "name") for m in word.finditer(text) if m[0] in names]
    rank = {k: i for i, k in enumerate((*KINDS, "name"))}
    return _without_overlap(sorted(spans, key=lambda s: (s[0], rank[s[2]])), rank)


def _without_overlap(spans: list[tuple[int, int, str]], rank: dict[str, int]) -> list[tuple[int, int, str]]:
    """Of overlapping spans the kind listed first stays, then the earlier one."""
    out: list[tuple[int, int, str]] = []
    for span in spans:
        while out and out[-1][1] > span[0] and rank[out[-1][2]] > rank[span[2]]:
            out.pop()
        if not out or out[-1][1] <= span[0]:
            out.append(span)
    return out


def _words(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    for m in re.finditer(r"[^ ]+", text[start:end]):
        yield start + m.start(), start + m.end()


_OUT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), *((f"n_{k}", pa.int64()) for k in KINDS)])


def _replacer(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = batch.slice(part, 500)
                done = [surrogates.replace(t or "") for t in rows.column("text").to_pylist()]
                texts = [None if not given.is_valid else t for (t, _), given in zip(done, rows.column("text"))]
                counts = [pa.array([c[k] for _, c in done], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(texts, pa.string()), *counts], schema=_OUT)

    return run


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``(doc_id, text, n_email, ...)`` of every row, with surrogates in the text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_replacer(key), "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS))


def clashes(docs: DataFrame, key: bytes) -> DataFrame:
    """``(kind, n_values, n_surrogates)`` of groups of values and surrogates that are not one to one; normally empty."""
    schema = pa.schema([("kind", pa.string()), ("value", pa.string()), ("surrogate", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            found = set()
            for text in batch.column("text").to_pylist():
                for start, end, kind in find(text or ""):
                    value = text[start:end]
                    new = surrogates.name(value) if kind == "name" else surrogates.of(kind, value)
                    found.add((kind, canonical(kind, value), canonical(kind, new)))
            columns = list(zip(*sorted(found))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], schema=schema)

    pairs = docs.select(F.col("text").cast("string")).mapInArrow(run, "kind string, value string, surrogate string").distinct()
    one = pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("n_values")).where("n_values > 1")
    two = pairs.groupBy("kind", "value").agg(F.count("*").alias("n_surrogates")).where("n_surrogates > 1")
    return one.select("kind", "n_values", F.lit(1).cast("long").alias("n_surrogates")).union(
        two.select("kind", F.lit(1).cast("long").alias("n_values"), "n_surrogates")
    )
