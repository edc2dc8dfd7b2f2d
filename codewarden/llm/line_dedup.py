"""Line dedup: lines that several documents share stay only in the first of them.

Lines are exploded and normalised (white space at both ends stripped, A-Z lower-cased) and reduced to a
128-bit hash. Per hash the distinct documents are counted, with map-side aggregation; hashes over the
threshold go back to the lines that carry them by an equi-join, which Spark can split for very common
lines. What reaches a document is the list of its dropped line numbers; the kept lines are put together
again by position inside the row.

Defined cases: a null or empty text is one empty line. A row without id passes unchanged and counts for
no other. Repeated rows of one id are the same document: none of its lines is dropped for the sake of
another row of the same id. An empty table gives an empty table. Input columns named ``n_lines`` or
``n_dropped`` are replaced, other columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm.common import WHITE, left_join, lower_ascii, saved, set_aside

MIN_CHARS = 10
MIN_DOCUMENTS = 2


def drop_shared_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """``docs`` with shared lines removed from ``text``, plus ``n_lines`` (before) and ``n_dropped``."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*columns, F.xxhash64(body).alias("__text"))
    lines = rows.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("__id"), "__text", F.posexplode(F.split(body, "\n")).alias("__at", "__line"))
    key = lower_ascii(F.btrim(F.col("__line"), F.lit(WHITE)))
    occurrences = (
        lines.select("__id", "__text", "__at", key.alias("__key"))
        .where(F.length("__key") >= min_chars)
        .select("__id", "__text", "__at", F.xxhash64("__key").alias("__h"),
                F.xxhash64(F.lit(1), F.col("__key")).alias("__g"))
    )
    keys = ["__h", "__g"]
    if min_documents == 2:
        # two different documents hold a line exactly if the smallest and the largest id differ
        counted = occurrences.groupBy(*keys).agg(F.min("__id").alias("__first"), F.max("__id").alias("__last"))
        shared = counted.where(F.col("__first") < F.col("__last"))
    else:
        counted = occurrences.select("__id", *keys).distinct().groupBy(*keys).agg(
            F.min("__id").alias("__first"), F.count("*").alias("__docs"))
        shared = counted.where(F.col("__docs") >= min_documents)
    shared = saved(shared.select(*keys, "__first"))
    dropped = (
        occurrences.join(shared, keys).where(F.col("__id") > F.col("__first"))
        .groupBy(F.col("__id").alias(doc_id), "__text").agg(F.collect_set("__at").alias("__drop"))
    )
    body_lines = F.split(body, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    out = left_join(rows, dropped, [doc_id, "__text"]).withColumn("__lines", body_lines)
    joined = F.array_join(F.transform(kept, lambda i: F.get(F.col("__lines"), i)), "\n")
    return out.select(
        *[F.when(F.col("__drop").isNull(), F.col(text)).otherwise(joined).alias(text) if c == text else F.col(c)
          for c in columns],
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def clean_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with shared lines removed, with its own columns only."""
    docs, _, own = set_aside(docs, ["n_lines", "n_dropped"])
    return drop_shared_lines(docs, **options).select(*own)
