"""URL filter: host and path rules, and a ratio of character language models for all other URLs. DataFrame functions only.

Two variable-order Markov models of characters are counted, over URLs that a rule allows and over URLs that a rule
blocks. A character's probability backs off through contexts of 4, 3, 2, 1, 0 characters: each order mixes its counts with the next shorter
one by Witten-Bell weights, ``(count(context, char) + kinds(context) * shorter) / (count(context) + kinds(context))``, and order 0 rests
on an even distribution. A URL's score is the difference of the two log-likelihoods per character. The threshold is calibrated on
URLs held out from counting: it lies where a normal fit to the scores of both classes errs equally often.

With ``whole``, as in the registered query, the models read the URL as it stands: scheme, host, path, query, fragment, digits.
Without it they read host and path with every digit run as one ``0``, so that URLs that differ only elsewhere share a verdict.
Equal texts are counted and scored once, with their number as weight, so a page repeated many times costs no more than once.
Every page is judged.

Defined results: a null URL is an empty one; one without ``://`` has empty host and path, so no rule fits it, and with ``whole``
the models read all of it;
without accepted or without rejected URLs everything else is allowed; repeated rows are judged alike; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.runtime import cut

ORDER = 4
ALPHABET = 256  # of the even distribution below order 0
HELD_OUT = 8  # one text of the models in so many is for calibration
BEGIN, STOP = "\x02", "\x03"

Rule = tuple[str, str]  # host/path prefix, allow or block
RULES: tuple[Rule, ...] = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z, and path of what follows the first ``://``; empty without it."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return _lower(host), path


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grams(urls: DataFrame) -> DataFrame:
    """One row per character of each URL, with the context before it: ``(..., context, char)``."""
    padded = F.concat(F.lit(BEGIN * ORDER), F.col("reduced"), F.lit(STOP))
    places = F.sequence(F.lit(ORDER + 1), F.length(padded))
    grams = F.transform(places, lambda i: F.substring(padded, i - ORDER, F.lit(ORDER + 1)))
    others = [c for c in urls.columns if c != "reduced"]
    return urls.select(*others, F.explode(grams).alias("gram"))


def _log_ratio(counts: DataFrame) -> DataFrame:
    """``(gram, ratio)`` for every gram of ``counts(gram, accepted, rejected)``; also for those with zero counts.

    Goes from order 0 up. Each order's tables are aggregates of the grams, so they have at most as many rows.
    """
    table = counts
    shorter = {"accepted": F.lit(1.0 / ALPHABET), "rejected": F.lit(1.0 / ALPHABET)}
    for order in range(ORDER + 1):
        context, gram = F.substring("gram", ORDER + 1 - order, order), F.substring("gram", ORDER + 1 - order, order + 1)
        sums = counts.groupBy(gram.alias("__gram"), context.alias("__context")).agg(
            *[F.sum(c).alias(f"__{c}") for c in ("accepted", "rejected")]
        )
        of_context = sums.groupBy(F.col("__context").alias("__c")).agg(
            *[F.sum(f"__{c}").alias(f"__all_{c}") for c in ("accepted", "rejected")],
            *[F.sum((F.col(f"__{c}") > 0).cast("long")).alias(f"__kinds_{c}") for c in ("accepted", "rejected")],
        )
        level = sums.join(of_context, F.col("__context") == F.col("__c")).drop("__c", "__context")
        table = table.join(level, gram == F.col("__gram"))
        new = {}
        for c in ("accepted", "rejected"):
            below = shorter[c] if order == 0 else F.col(f"p_{c}")
            weight = F.col(f"__all_{c}") + F.col(f"__kinds_{c}")
            mixed = (F.col(f"__{c}") + F.col(f"__kinds_{c}") * below) / weight
            new[f"p_{c}"] = F.when(weight > 0, mixed).otherwise(below)
        kept = [c for c in table.columns if not c.startswith(("__", "p_"))]
        table = table.withColumns(new).select(*kept, "p_accepted", "p_rejected")
        if order == 2:
            table = cut(table)
    return table.select("gram", (F.log("p_accepted") - F.log("p_rejected")).alias("ratio"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, whole: bool = False) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` of every row; ``score`` is the models', null where they are not asked.

    The models read the whole URL with ``whole``, else its host and path without the values of digits.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    rule, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    reduced = F.col("url") if whole else F.regexp_replace(F.concat("host", "path"), "[0-9]+", "0")
    rows = rows.withColumns({"rule": rule, "ruled": ruled, "reduced": reduced}).drop("url")
    key = ["reduced", "ruled"]
    urls = cut(rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("id", F.xxhash64("reduced")))
    held = F.pmod(F.xxhash64(F.lit("calibration"), "reduced"), F.lit(HELD_OUT)) == 0
    counted = {
        name: F.when((F.col("ruled") == verdict) & ~held, F.col("n")).otherwise(0)
        for name, verdict in (("accepted", "allow"), ("rejected", "block"))
    }
    counts = _grams(urls.select("reduced", *[c.alias(name) for name, c in counted.items()]))
    counts = cut(counts.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    ratios = _log_ratio(counts)
    # Only URLs that need a score: those without a rule and those for calibration.
    asked = urls.where(F.col("ruled").isNull() | held)
    scores = _grams(asked.select("reduced", F.col("reduced").alias("url"))).join(ratios, "gram").groupBy("url").agg(F.avg("ratio").alias("score"))
    scored = cut(asked.join(scores, F.col("reduced") == F.col("url")).select(*key, "n", "score"))
    threshold = calibrated(scored)
    known = scored.where("ruled IS NULL").select(F.col("reduced").alias("__reduced"), "score")
    judged = rows.join(known, F.col("ruled").isNull() & (F.col("reduced") == F.col("__reduced")), "left")
    by_model = F.when(F.col("score") < threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")


def calibrated(scored: DataFrame) -> float:
    """Where normal fits to the accepted and the rejected scores have equal tails; below everything if a class is missing."""
    moments = scored.where("ruled IS NOT NULL").groupBy("ruled")
    moments = moments.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("score")).alias("s"), F.sum(F.col("n") * F.col("score") ** 2).alias("q")
    )
    found = {r.ruled: (r.s / r.n, math.sqrt(max(r.q / r.n - (r.s / r.n) ** 2, 0.0)) + 1e-3) for r in moments.collect()}  # two rows
    if len(found) < 2:
        return -math.inf
    (good, g), (bad, b) = found["allow"], found["block"]
    return (good * b + bad * g) / (g + b)
