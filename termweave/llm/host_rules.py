"""Quality rules by document and by host, in DataFrame functions only.

A document fails the base rules by having few words or many repeated windows, and soft rules by symbols, word length, repeated
lines. Failures are counted by host; hosts differ in size, so their rates are shrunk with a beta prior whose mean and weight
are estimated from all hosts (method of moments): ``rate = (failures + alpha) / (documents + alpha + beta)``. Documents of
a host whose shrunk rate passes ``host_limit`` are dropped with it.

Host counts are pre-aggregated before the shuffle, so a host with a third of all documents is one partial row per task; the verdicts go back to
the documents by a join on slim rows that Spark splits where a host is frequent.

Defined results: null text has no words and fails; a null host is a host of its own; every row of a repeated id is judged by
itself and counts; without any rows the prior is even; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import SPACE
from termweave.runtime import cut

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
HOST_LIMIT = 0.6


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a run of ``window`` words found at least twice in the list, the first one included."""

    def marked(hashes: Column) -> Column:
        # Positions of windows whose hash occurs again; sorting brings equal hashes together.
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(
            pairs,
            lambda p: F.array_sort(
                F.filter(
                    F.transform(
                        p,
                        lambda x, i: F.when(
                            (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]), x["i"]
                        ),
                    ),
                    lambda x: x.isNotNull(),
                )
            ),
        )
        # Each window covers up to the start of the next one.
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, x: F.struct((a["n"] + x + window - F.greatest(a["end"], x)).alias("n"), (x + window).alias("end")),
            lambda a: a["n"],
        )

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))

    def counted(w: Column) -> Column:
        return let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), marked(h)).otherwise(0))

    return let(words, lambda w: F.when(F.size(w) > window, counted(w)).otherwise(0)).cast("long")


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(rf"[^{SPACE}]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """``(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)`` of every row."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), text.alias("text"))
    measured = let(
        words_of(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    symbols = F.coalesce(F.regexp_count("text", F.lit("[#*$%&|<>]")), F.lit(0)).cast("long")
    return rows.select(
        "doc_id", "host", measured.alias("m"), symbols.alias("n_symbols"), _duplicate_lines(F.col("text")).alias("n_dup_lines")
    ).select("doc_id", "host", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def failed() -> Column:
    """The base rules or a soft rule."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return (
        base_failed()
        | (F.col("n_symbols") > 0.3 * words)
        | (F.col("word_chars") > 14 * words)
        | (F.col("word_chars") < 2 * words)
        | (10 * F.col("n_dup_lines") > 3 * F.col("n_words"))
    )


def host_rates(measured: DataFrame) -> DataFrame:
    """``(host, n_docs, n_failed, rate)``: failure rates shrunk with the prior of all hosts."""
    hosts = cut(
        measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(failed().cast("long")).alias("n_failed"))
    )
    share = F.col("n_failed") / F.col("n_docs")
    # Moments over hosts: one row. The spread beyond that of coin tosses sets the prior's weight.
    total = hosts.agg(F.sum("n_docs"), F.sum("n_failed"), F.count("*")).first()
    docs, fails, n = (x or 0 for x in total)
    mean = (fails + 0.5) / (docs + 1)
    spread, noise = hosts.agg(
        F.sum(F.col("n_docs") * (share - mean) ** 2), F.sum(F.lit(mean * (1 - mean)))
    ).first()
    excess = max(((spread or 0.0) - (noise or 0.0)) / max(docs, 1), 1e-6)
    weight = min(max(mean * (1 - mean) / excess - 1, 1.0), 1000.0)
    alpha, beta = mean * weight, (1 - mean) * weight
    return hosts.withColumn("rate", (F.col("n_failed") + alpha) / (F.col("n_docs") + alpha + beta))


def judge(docs: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The measures of every row with ``base_failed``, ``host_rate`` and ``kept``."""
    measured = cut(measure(docs, host))
    rates = host_rates(measured).select(F.col("host").alias("__host"), F.col("rate").alias("host_rate"))
    joined = measured.join(rates, F.col("host").eqNullSafe(F.col("__host"))).drop("__host")
    return joined.withColumns(
        {
            "base_failed": base_failed(),
            "kept": ~failed() & (F.col("host_rate") <= host_limit),
        }
    )
