"""Chat formatting in budgeted windows.

A conversation's turns get running token sums; the sums choose spans of whole turns that fit a budget.
Every window after the first repeats the system turn and as much history as its share of the budget
allows and the turn behind it leaves room for, and the loss mask covers the assistant turns that are new in the window only, so every target is
learned once. A turn that exceeds the budget alone gets a window of its own and is never cut.

The template writes a turn as ``<s>[INST] role [/INST]text</s>``. Control strings inside texts and roles get
a backslash behind their first character, one more if there are some already, so reading back is exact.

A conversation is gathered in one row, as it is one training example; windows are rows.

Defined cases: a null text or role is empty; turns of equal number come by role, then text, repeated rows
stay repeated turns; a null conversation id is a conversation of its own; a null turn number comes first;
an empty table gives an empty table; extra columns are not passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 512
#: Share of the budget, and turns, that repeated history may take.
HISTORY_TOKENS = 128
HISTORY_TURNS = 2
#: Tokens of the markers around a turn.
MARKERS = 4
CONTROL = r"(/?s>|/?INST\]|</?SYS>>)"
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def word_tokens(text: Column) -> Column:
    """Default count of a text's tokens: its words."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def format_windows(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS,
    count_tokens=word_tokens,
) -> DataFrame:
    """One row per window: conv_id, window, text, loss_spans (code points), n_repeated, n_new."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("tokens", (count_tokens(F.col("text")) + MARKERS).cast("long"))
    # the system turn stands outside the sums of the others
    rows = rows.withColumn("at", F.row_number().over(order))
    rows = rows.withColumn("system", (F.col("at") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("sum", F.sum(F.when(F.col("system"), 0).otherwise(F.col("tokens"))).over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE), escape(F.col("text")), F.lit(CLOSE))
    rows = rows.withColumn("piece", piece)
    rows = rows.withColumn("head", F.length(escape(F.col("role"))) + len(OPEN) + len(MIDDLE))
    turn_of = F.struct("at", "system", "tokens", "sum", (F.col("role") == "assistant").alias("target"), "piece", "head")
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn_of)).alias("all"))
    convs = convs.select(
        "conv_id", F.filter("all", lambda t: t["system"]).alias("sys"), F.filter("all", lambda t: ~t["system"]).alias("ts"))
    convs = convs.withColumn("sys_tokens", F.coalesce(F.get("sys", F.lit(0))["tokens"], F.lit(0).cast("long")))

    def before(i):
        """Tokens of the turns before the i-th."""
        return F.coalesce(F.get("ts", i - 1)["sum"], F.lit(0).cast("long"))

    def history(i):
        """Turns before the i-th that a window starting there repeats."""
        room = F.least(F.lit(history_tokens), budget - F.col("sys_tokens") - F.get("ts", i)["tokens"])
        fits = [((i >= h) & (before(i) - before(i - h) <= room), h) for h in range(history_turns, 0, -1)]
        out = F.lit(0)
        for condition, h in reversed(fits):
            out = F.when(condition, F.lit(h)).otherwise(out)
        return out

    def step(state, t, i):
        full = (i > 0) & (state["used"] + t["tokens"] > budget)
        h = history(i)
        return F.struct(
            F.when(full, F.concat(state["starts"], F.array(i))).otherwise(state["starts"]).alias("starts"),
            F.when(full, F.col("sys_tokens") + before(i) - before(i - h) + t["tokens"])
            .otherwise(state["used"] + t["tokens"]).alias("used"))

    first = F.struct(F.array(F.lit(0)).alias("starts"), F.col("sys_tokens").alias("used"))
    numbered = F.transform("ts", lambda t, i: F.struct(t["tokens"].alias("tokens"), i.alias("i")))
    convs = convs.withColumn("starts", F.aggregate(numbered, first, lambda s, t: step(s, t, t["i"]))["starts"])
    windows = convs.select("conv_id", "sys", "sys_tokens", "ts", "starts", F.posexplode("starts").alias("window", "start"))
    windows = windows.withColumn("stop", F.coalesce(F.get("starts", F.col("window") + 1), F.size("ts")))
    windows = windows.withColumn("h", F.when(F.col("window") > 0, history(F.col("start"))).otherwise(0))
    mine = F.concat("sys", F.slice("ts", F.col("start") - F.col("h") + 1, F.col("h") + F.col("stop") - F.col("start")))
    windows = windows.select(
        "conv_id", "window", mine.alias("mine"),
        F.when(F.col("window") > 0, F.size("sys") + F.col("h")).otherwise(0).alias("n_repeated"))

    def spans(state, t):
        at, end = state["at"] + t["head"], state["at"] + F.length(t["piece"])
        new = F.array(F.struct(at.alias("start"), (end - len(CLOSE)).alias("end")))
        return F.struct(end.alias("at"), F.when(t["new"] & t["target"], F.concat(state["spans"], new))
                        .otherwise(state["spans"]).alias("spans"))

    marked = F.transform("mine", lambda t, i: F.struct(t["head"], t["piece"], t["target"], (
        i >= F.col("n_repeated")).alias("new")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return windows.withColumn("mine", marked).select(
        "conv_id", F.col("window").cast("int").alias("window"),
        F.array_join(F.transform("mine", lambda t: t["piece"]), "").alias("text"),
        F.aggregate("mine", F.struct(F.lit(0).alias("at"), none.alias("spans")), spans)["spans"].alias("loss_spans"),
        F.col("n_repeated").cast("int").alias("n_repeated"),
        (F.size("mine") - F.col("n_repeated")).cast("int").alias("n_new"))


def read_back(windows: DataFrame) -> DataFrame:
    """Conversations read from formatted windows: conv_id, turns (role, text), loss_text, formatted_chars."""
    whole = windows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "window", "text", "loss_spans", "n_repeated"))).alias("ws"))

    def turns(w):
        parts = F.split(w["text"], CLOSE)
        new = F.slice(parts, w["n_repeated"] + 1, F.greatest(F.size(parts) - 1 - w["n_repeated"], F.lit(0)))
        heads = F.transform(new, lambda p: F.struct(p.alias("p"), F.substring_index(p, MIDDLE, 1).alias("h")))
        return F.transform(heads, lambda x: F.struct(
            unescape(F.substr(x["h"], F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substr(x["p"], F.length(x["h"]) + len(MIDDLE) + 1)).alias("text")))

    def learned(w):
        return F.array_join(F.transform(w["loss_spans"], lambda s: unescape(
            F.substr(w["text"], s["start"] + 1, s["end"] - s["start"]))), "")

    return whole.select(
        "conv_id", F.flatten(F.transform("ws", turns)).alias("turns"),
        F.array_join(F.transform("ws", learned), "").alias("loss_text"),
        _total(F.transform("ws", lambda w: F.length(w["text"]).cast("long"))).alias("formatted_chars"))
