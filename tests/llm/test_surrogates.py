import itertools
import random
import re

from termweave.llm import surrogates as s

KEY = b"test key"


def test_steps_are_one_cycle():
    p = s.Permutation(KEY)
    for n in (2, 3, 10, 97, 256, 1000):
        seen, x = set(), 0
        while x not in seen:
            seen.add(x)
            x = p.step("x", x, n)
        assert len(seen) == n
    assert s.Permutation(b"other").step("x", 5, 10**9) != p.step("x", 5, 10**9)


def test_formats():
    make = s.Surrogates(KEY)
    rng = random.Random(4)
    for _ in range(50):
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        new = make.of("card", digits)
        assert new != digits and new[0] == "4" and s._luhn(new) == s._luhn(digits)
        assert make.of("card", "-".join(re.findall("....", digits))).replace("-", "") == new
        area, rest = rng.randint(200, 999), f"{rng.randint(200, 999)}{rng.randint(0, 9999):04d}"
        phone = make.of("phone", f"+1 ({area}) {rest[:3]}-{rest[3:]}")
        assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", phone)
        assert re.sub(r"\D", "", make.of("phone", f"+1 {area} {rest[:3]} {rest[3:]}")) == re.sub(r"\D", "", phone)
    iban = make.of("iban", "DE89 3704 0044 0532 0130 00")
    assert iban[:2] == "DE" and s._mod97(iban.replace(" ", "")[4:] + iban[:4]) == 1 and iban != "DE89 3704 0044 0532 0130 00"
    assert make.of("ip", "10.1.2.3").startswith("10.") and make.of("ip", "8.8.8.8") != "8.8.8.8"
    assert re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", make.of("email", "eop.13@mail5.example.com"))
    assert make.name("Mary") in s.NAMES["f"] and make.name("Hans") in s.NAMES["m"]
    assert re.fullmatch("[А-Я][а-я]{5}", make.name("Иванов"))
    shapes = ["".join(x) for x in itertools.product("01", "ab", "-")]
    assert len({make.shaped("t", x) for x in shapes}) == len(shapes)


def test_texts():
    make = s.Surrogates(KEY)
    text = "Mr John Smith (js@x.org, +1 (319) 555-5132) met Frau Petra Müller. Smith pays with 4799134681044206 from 55.63.178.142."
    new, counts = make.replace(text)
    assert counts == dict(email=1, ip=1, card=1, iban=0, ssn=0, phone=1, person=2)
    for secret in ("John", "Smith", "js@x", "555-5132", "Petra", "Müller", "4799134681044206", "55.63"):
        assert secret not in new
    name = re.match(r"Mr (\w+) (\w+) \(", new)
    assert name[1] in s.NAMES["m"] and new.count(name[2]) == 2
    assert make.replace("plain text 12 and 2020-01-02")[0] == "plain text 12 and 2020-01-02"
    assert make.replace("")[0] == ""


def test_query_rows(spark):
    rng = random.Random(6)
    rows = []
    for i in range(80):
        values = [f"u{rng.randint(1, 30)}@mail.org", f"4{rng.randint(0, 10**15 - 1):015d}", f"{rng.randint(1, 223)}.2.3.{rng.randint(0, 9)}"]
        rows.append((i, "text " + " and ".join(rng.sample(values, 2)), "n"))
    rows += [(None, "a@b.org", None), (80, None, None), (81, "", None), (81, "", None), (82, "word " * 50_000 + "a@b.org", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_email string")
    make = s.Surrogates(KEY)
    got = sorted(((r.doc_id, r.text) for r in s.pseudonymise(docs, KEY).collect()), key=str)
    assert got == sorted(((i, t if t is None else make.replace(t)[0]) for i, t, _ in rows), key=str)
    assert s.clashes(docs, KEY).count() == 0
    assert s.pseudonymise(docs.limit(0), KEY).count() == 0


def test_phone_notations_agree():
    from termweave.llm.surrogates import Surrogates, canonical

    s = Surrogates(b"k")
    for group in (("+353 1 234 5678", "+35312345678", "+353-1-234-5678"), ("+44 20 7946 0958", "+442079460958"), ("+1 (555) 234-5678", "+15552345678")):
        made = {canonical("phone", s.of("phone", v)) for v in group}
        assert len(made) == 1
        assert made != {canonical("phone", group[0])}
        assert made.pop()[:2] == group[0][:2]


def test_notations_of_one_address_have_one_surrogate():
    from termweave.llm import surrogates as module

    made = module.Surrogates(b"k")
    for group in (
        ("2001:DB8:0:0:0:0:0:1", "2001:db8:0:0:0:0:0:1", "2001:db8::1", "2001:0db8::0:1"), ("10.0.0.1", "10.0.0.01"),
        ("::1", "0:0:0:0:0:0:0:1"), ("fe80::", "fe80:0::0"), ("dead::beef", "DEAD:0::beef"), ("64:ff9b::10.0.0.1", "64:ff9b::a00:1"),
    ):
        text = "from " + " to ".join(group) + ": done."
        assert [text[a:b] for a, b, kind in module.find(text) if kind == "ip"] == list(group)
        new, counts = made.replace(text)
        parts = new[len("from ") : -len(": done.")].split(" to ")
        assert len(set(parts)) == 1 and parts[0] not in group and counts["ip"] == len(group)
    new, counts = made.replace("10.0.0.1 and ::ffff:10.0.0.1 and [::FFFF:a00:1]:80")
    plain, mapped, other = new.split(" and ")
    assert mapped == "::ffff:" + plain and other == f"[::ffff:{plain}]:80" and plain.startswith("10.") and counts["ip"] == 3
    for text in ("std::vector", "a :: b", "12:30:45", "1:2:3:4:5:6:7:8:9", "::"):
        assert not [s for s in module.find(text) if s[2] == "ip"], text


def test_letters_of_any_script_are_replaced():
    import unicodedata

    from termweave.llm import surrogates as module

    made = module.Surrogates(b"k")
    for name in ("Šěžů", "Ābčďē", "Արամ", "გიორგი", "สมชาย", "Άννα"):
        new, counts = made.replace(f"Dr. {name} came")
        new = new[len("Dr. ") : -len(" came")]
        assert counts["person"] == 1 and len(new) == len(name) and new != name
        for a, b in zip(name, new):
            assert unicodedata.category(a) == unicodedata.category(b)
            assert unicodedata.name(a).split(" ")[0] == unicodedata.name(b).split(" ")[0]
    assert all(made.name(x) != x for x in ("Šěžů", "Ārčē"))
    words = [a + b for a in "աբգ" for b in "աբգ"]
    assert len({made.name(w) for w in words}) == len(words)
