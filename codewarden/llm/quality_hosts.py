"""Quality rules with verdicts on hosts.

Every document gets rule figures computed inside its row. Failures are counted per host with map-side
aggregation; the hosts' failure rates are shrunk towards the corpus by a beta prior whose mean and
strength are estimated from the hosts themselves (method of moments, binomial noise taken off). The
verdict on a host comes back to its documents: a document that passes the base rules goes only if its
host is rejected *and* it fails a milder rule itself, so a clean document of a bad host stays.

Defined cases: a null text has no words (it fails for being short); rows without a host form one host of
their own; repeated rows count as often as they come; an empty table gives an empty table. Input columns
named like an output column are replaced in :func:`judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.llm.common import WHITE_RUN, pieces, saved, set_aside, sized

MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
#: Milder rules: symbols against words, repeated lines against lines, in percent.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
#: A host is rejected when its shrunken failure rate reaches this.
MAX_HOST_RATE = 0.5
FIGURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _window_hashes(hashes: Column, size: int) -> Column:
    inside = F.sequence(F.lit(0), F.size(hashes) - size)
    each = F.transform(inside, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
    return F.when(F.size(hashes) >= size, each).otherwise(F.array().cast("array<bigint>"))


def text_figures(docs: DataFrame, text: str = "text", into: str = "figures") -> DataFrame:
    """``docs`` plus a struct column of rule figures (see FIGURES), without any shuffle."""
    body = F.coalesce(F.col(text), F.lit(""))
    keep = [c for c in docs.columns if c != into]
    df = docs.select(*keep, pieces(body, WHITE_RUN).alias("__words"),
                     F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
                     F.length(F.regexp_replace(body, WHITE_RUN, "")).alias("__chars"),
                     F.regexp_count(body, F.lit(r"[#*$%&|<>]")).alias("__symbols"))
    df = df.select(*keep, "__chars", "__symbols", F.size("__words").alias("__n"),
                   F.size("__lines").alias("__n_lines"),
                   (F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("__dup_lines"),
                   F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"))
    df = df.withColumn("__windows", _window_hashes(F.col("__hashes"), WINDOW)).drop("__hashes")
    # only texts with an equal pair of windows are sorted
    some = F.size(F.array_distinct("__windows")) < F.size("__windows")
    pairs = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("__sorted", F.when(some, pairs).otherwise(none)).drop("__windows")
    s = F.col("__sorted")
    repeated = F.filter(s, lambda x, k: (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)))
                        | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
    df = df.withColumn("__starts", F.sort_array(F.transform(repeated, lambda x: x["i"]))).drop("__sorted")
    p = F.col("__starts")
    covered = F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    values = ["__n", "__chars", "__symbols", "__n_lines", "__dup_lines", covered]
    return df.select(*keep, F.struct(*[
        (F.col(v) if isinstance(v, str) else v).cast("long").alias(n) for n, v in zip(FIGURES, values, strict=True)
    ]).alias(into))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])


def mild_failed(f: Column) -> Column:
    return ((100 * f["n_symbols"] > MAX_SYMBOL_PERCENT * f["n_words"])
            | (100 * f["n_dup_lines"] > MAX_DUP_LINE_PERCENT * f["n_lines"]))


def host_rates(figures: DataFrame, host: str = "source", column: str = "figures") -> DataFrame:
    """One row per host: n_docs, n_failed, host_rate (shrunken failure rate)."""
    f = F.col(column)
    failed = (base_failed(f) | mild_failed(f)).cast("long")
    hosts = figures.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n_docs"), F.sum(failed).alias("n_failed"))
    hosts = saved(hosts)
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n_docs")).alias("i"))
    spread = F.col("m") * (1 - F.col("m"))
    true_var = F.greatest(F.col("v") - spread * F.col("i"), F.lit(1e-9))
    strength = F.least(F.greatest(spread / true_var - 1, F.lit(1.0)), F.lit(1e6))
    prior = moments.select(F.struct(F.col("m").alias("mean"), strength.alias("strength")).alias("p"))
    p = prior.scalar()
    return saved(hosts.withColumn("__p", p).select(
        "host", "n_docs", "n_failed",
        ((F.col("n_failed") + F.col("__p.mean") * F.col("__p.strength"))
         / (F.col("n_docs") + F.col("__p.strength"))).alias("host_rate")))


def judge(figures: DataFrame, rates: DataFrame, host: str = "source", column: str = "figures",
          max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``figures`` plus base_failed, host_rejected and kept.

    Only rejected hosts are joined; they are broadcast if few, else joined by a shuffle.
    """
    out = figures.drop("base_failed", "host_rejected", "kept")
    bad = saved(rates.where(F.col("host_rate") >= max_host_rate).select(F.col("host").alias("__host")))
    out = out.join(sized(bad).withColumn("__bad", F.lit(True)), F.col(host).eqNullSafe(F.col("__host")), "left")
    f = F.col(column)
    rejected = F.coalesce("__bad", F.lit(False))
    return out.withColumns({
        "base_failed": base_failed(f), "host_rejected": rejected,
        "kept": ~(base_failed(f) | (rejected & mild_failed(f))),
    }).drop("__host", "__bad")


def keep_good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns.

    The figures are computed twice, once for the hosts and once next to the documents, so that no text
    is shuffled or saved.
    """
    docs, columns, own = set_aside(docs, ["base_failed", "host_rejected", "kept"])
    rates = host_rates(text_figures(docs.select(host, text), text, "__figures"), host, "__figures")
    judged = judge(text_figures(docs, text, "__figures"), rates, host, "__figures")
    # a generator, as a filter would be pushed below the join with the whole computation copied into it
    row = F.struct(*[F.col(c) for c in columns])
    return judged.select(F.inline(F.when(F.col("kept"), F.array(row)))).select(*own)
