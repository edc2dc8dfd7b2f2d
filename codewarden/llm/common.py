"""What the operators share: tables, words, saved intermediate results, joins back to rows."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space of the words: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
#: What stands between alphanumeric words, in lower-cased text.
NOT_ALNUM_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a side that may be broadcast; a side is counted before, and beyond this it is shuffled.
BROADCAST_ROWS = 500_000


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver found it, if it is not installed there."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; where that is unset and all of Spark runs on this
    machine, a temporary one."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = sc.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="codewarden-checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """The rows of ``df`` kept in the shared checkpoint folder; later use reads them there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`saved`, as a compressed Parquet table of its own: for large results."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is.

    ``df`` is a saved result, so counting reads it once more and computes nothing.
    """
    return F.broadcast(df) if df.count() <= rows else df


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters unchanged."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def pieces(text: Column, between: str) -> Column:
    """The non-empty pieces of ``text`` between matches of ``between``."""
    return F.filter(F.split(text, between), lambda w: w != F.lit(""))


def white_words(text: Column) -> Column:
    return pieces(F.coalesce(text, F.lit("")), WHITE_RUN)


def alnum_words(text: Column) -> Column:
    return pieces(lower_ascii(F.coalesce(text, F.lit(""))), NOT_ALNUM_RUN)


def same_row(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the named key columns of two frames."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on null-safe keys, keeping the left side's key columns."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__right_{k}")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__right_{k}"))
    return left.join(renamed, on, "left").drop(*[f"__right_{k}" for k in keys])


def set_aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, list[str], list[Column]]:
    """Columns named like an operator's outputs get other names for a while.

    Returns the renamed frame, its columns, and those columns under their old names.
    """
    renamed = {c: f"__own_{c}" for c in docs.columns if c in names}
    out = docs.withColumnsRenamed(renamed)
    return out, out.columns, [F.col(renamed.get(c, c)).alias(c) for c in docs.columns]
