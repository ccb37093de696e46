"""Chat formatting in windows of a token budget, in DataFrame functions only.

Prefix sums of the turns' tokens give each turn its place in the conversation. A window takes the turns that start in one span of half the
room; a turn longer than that stands alone. So every window keeps the budget unless a single turn, with the system turn, is longer.
A window shows, in order: the system turn, up to ``HISTORY_TURNS`` turns from just before it that fit into the history share, and
its own turns. The loss mask covers the text of assistant turns among its own turns only, so each is learnt once.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line end per turn; turns shown again begin with ``<|im_again|>``.
In roles and texts every ``<`` that has any number of ``\\`` and then ``|`` after it gets one more ``\\``: no control string is left,
and taking one away restores the text.

Only running sums and look-ahead over slim rows (no texts) go over whole conversations; texts meet in windows, which the budget
bounds.

Defined results: null roles and texts are empty; turns of equal number are ordered by role and text, null numbers come first; repeated
rows are turns of their own; rows with a null ``conv_id`` are one conversation; the system turn is the first turn if its role is
``system``; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.common import word_count

BUDGET = 512
HISTORY_SHARE = 0.25
HISTORY_TURNS = 2
START, AGAIN, SEP, END = "<|im_start|>", "<|im_again|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def turn_tokens(text: Column | str) -> Column:
    """Budget units of a turn: its words, and one for its marks."""
    return word_count(text) + 1


def _turns(conversations: DataFrame) -> DataFrame:
    clean = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return clean.withColumn("tokens", turn_tokens("text"))


def windows(conversations: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``(conv_id, window, text, loss, n_tokens)``: formatted windows; ``loss`` has (start, end) in characters of ``text``.

    Windows of a conversation are numbered from 0 in order.
    """
    conv = Window.partitionBy("conv_id")
    turns = _turns(conversations).withColumn("i", F.row_number().over(conv.orderBy("turn", "role", "text")))
    ordered = conv.orderBy("i")
    system = (F.col("i") == 1) & (F.col("role") == "system")
    turns = turns.withColumns({"system": system, "sum": F.sum("tokens").over(ordered.rowsBetween(Window.unboundedPreceding, -1))})
    room = F.max(F.when(F.col("system"), F.col("tokens"))).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    room = F.greatest(F.lit(budget) - F.coalesce(room, F.lit(0)), F.lit(2))
    history = F.floor(room * HISTORY_SHARE)
    half = F.greatest(F.floor((room - history) / 2), F.lit(1))
    turns = turns.withColumns({"history": history, "span": F.floor(F.coalesce("sum", F.lit(0)) / half), "long": F.col("tokens") > half})
    before = F.lag(F.struct("span", "long", "system")).over(ordered)
    opens = before.isNull() | before["system"] | before["long"] | F.col("long") | (before["span"] != F.col("span"))
    # The system turn opens no window of its own if a turn follows.
    follows = F.lead("i").over(ordered)
    turns = turns.withColumn("opens", opens & (~F.col("system") | follows.isNull()))
    turns = turns.withColumn("window", F.greatest(F.sum(F.col("opens").cast("long")).over(ordered) - 1, F.lit(0)))
    # A turn is shown again in the window that opens one or two turns later, if the turns between fit the history share.
    shown, held = [], F.col("tokens")
    for step in range(1, HISTORY_TURNS + 1):
        later = F.lead(F.struct("opens", "window", "history", "tokens"), step).over(ordered)
        shown.append(F.when(later["opens"] & ~F.col("system") & (held <= later["history"]), later["window"]))
        held = held + later["tokens"]
    turns = turns.withColumns({f"again{k}": c for k, c in enumerate(shown)} | {"last": F.max("window").over(conv)})
    repeats = F.array_compact(F.array_distinct(F.array(*[f"again{k}" for k in range(HISTORY_TURNS)])))
    repeats = F.when(
        F.col("system"), F.when(F.col("last") > 0, F.sequence(F.lit(1), "last")).otherwise(F.array().cast("array<bigint>"))
    ).otherwise(F.filter(repeats, lambda w: w != F.col("window")))
    places = F.concat(
        F.array(F.struct(F.col("window").alias("window"), F.lit(True).alias("own"))),
        F.transform(repeats, lambda w: F.struct(w.alias("window"), F.lit(False).alias("own"))),
    )
    head = F.concat(F.when(F.col("place.own"), F.lit(START)).otherwise(F.lit(AGAIN)), escape(F.col("role")), F.lit(SEP))
    parts = turns.select("conv_id", "i", "role", "text", "tokens", F.explode(places).alias("place")).select(
        "conv_id",
        F.col("place.window").alias("window"),
        F.struct(
            "i",
            head.alias("head"),
            F.concat(escape(F.col("text")), F.lit(END)).alias("body"),
            (F.col("place.own") & (F.col("role") == "assistant")).alias("learn"),
            "tokens",
        ).alias("part"),
    )
    # A window: bounded by the budget, or one turn.
    grouped = parts.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    end_mark = len(END)

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["head"])
        stop = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), (stop - end_mark).alias("end")))
        return F.struct(stop.alias("at"), F.when(p["learn"], F.concat(a["loss"], span)).otherwise(a["loss"]).alias("loss"))

    return grouped.select(
        "conv_id",
        "window",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.aggregate("parts", state, step)["loss"].alias("loss"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("n_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, window, place, role, text, own)``: the turns that the windows' texts show, restored."""
    pieces = F.filter(F.split("text", END.replace("|", r"\|"), -1), lambda p: p != "")
    shown = formatted.select("conv_id", "window", F.posexplode(pieces).alias("place", "piece"))
    rest = F.expr(f"substr(piece, {len(START) + 1})")
    at = F.instr(rest, SEP)
    return shown.select(
        "conv_id",
        "window",
        "place",
        unescape(F.substring(rest, F.lit(1), at - 1)).alias("role"),
        unescape(F.substring(rest, at + len(SEP), F.length(rest))).alias("text"),
        F.col("piece").startswith(START).alias("own"),
    )


def learnt(formatted: DataFrame) -> DataFrame:
    """``(conv_id, window, text)``: what lies under the loss mask of each window, restored and joined."""
    spans = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", "window", F.array_join(spans, "").alias("text"))
