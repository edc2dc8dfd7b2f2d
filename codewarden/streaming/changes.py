"""Change streams and their per-file debounce."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codewarden.functions import text
from codewarden.functions.sql import q
from codewarden.sources.code_files import EXTENSIONS

# The default quiet gap.
DEBOUNCE_SECONDS = 1.0
#: Behind all changes of a replay.
END = "9999-01-01 00:00:00"
CHANGES = "path string, ts timestamp, event_type string"


def read_changes(spark: SparkSession, directory: str, fmt: str = "json", schema: str = CHANGES, **options) -> DataFrame:
    """File-based change stream; other streaming sources can be used as they are."""
    stream = spark.readStream.format(fmt).schema(schema).options(**options).load(directory)
    return watchable(stream)


def watchable(changes: DataFrame) -> DataFrame:
    """Changes of code files; reads the path only, so the source can skip the rest."""
    wanted = ", ".join(q(e) for e in EXTENSIONS)
    return changes.where(f"{text.extname('path')} IN ({wanted})")


def sessions(changes: DataFrame, gap_seconds: float = DEBOUNCE_SECONDS) -> DataFrame:
    """Bursts of changes per file in a finished table: path, first_ts, last_ts, session_end, n, last_event.

    Changes are first summed per path and gap-wide time slot, with a map-side combine: all changes of a
    slot belong to one burst, so a file with a third of all changes shrinks to at most one row per slot
    before its bursts are put together.
    """
    gap = int(gap_seconds * 1_000_000)
    micros = F.unix_micros("ts")
    slots = (
        changes.groupBy("path", F.floor(micros / F.lit(gap)).alias("slot"))
        .agg(
            F.min(micros).alias("first"), F.max(micros).alias("last"), F.count("*").alias("n"),
            F.max_by("event_type", F.struct("ts", "event_type")).alias("last_event"),
        )
    )
    in_order = Window.partitionBy("path").orderBy("slot")
    starts = F.col("first") - F.lag("last").over(in_order) > gap
    marked = slots.withColumn("starts", F.coalesce(starts, F.lit(True)).cast("long"))
    numbered = marked.withColumn("burst", F.sum("starts").over(in_order))
    return (
        numbered.groupBy("path", "burst")
        .agg(
            F.timestamp_micros(F.min("first")).alias("first_ts"),
            F.timestamp_micros(F.max("last")).alias("last_ts"),
            F.timestamp_micros(F.max("last") + gap).alias("session_end"),
            F.sum("n").alias("n"), F.max_by("last_event", "slot").alias("last_event"),
        )
        .drop("burst")
    )


def with_clock(changes: DataFrame) -> DataFrame:
    """A live stream with a row per second that moves the watermark, so that the last burst closes, too."""
    ticks = changes.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    return changes.unionByName(ticks.select(F.col("timestamp").alias("ts")), allowMissingColumns=True)


def with_end(changes: DataFrame, folder: str) -> DataFrame:
    """A replay with a last row, kept in ``folder``, behind which no burst stays open.

    For a finished set of changes read in one batch (``availableNow`` without a limit of files); further
    changes under the same checkpoint would be late.
    """
    spark = changes.sparkSession
    end = spark.range(1).select(F.expr(f"timestamp '{END}'").alias("ts"))
    end.write.mode("overwrite").parquet(folder)
    rows = spark.readStream.schema(end.schema).parquet(folder)
    return changes.unionByName(rows, allowMissingColumns=True)


def stream_sessions(changes: DataFrame, gap_seconds: float, lateness: str) -> DataFrame:
    """The same bursts on a stream; one is emitted once the watermark has passed its end.

    A change counts if it arrives at most ``lateness`` after a newer one of any file; session windows in
    append mode have to drop later ones, so choose it by the source. Rows without a path only move the
    watermark (see :func:`with_clock` and :func:`with_end`).
    Bursts are merged within each input partition before the shuffle, so a hot file sends few rows.
    """
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    window = F.session_window("ts", f"{int(gap_seconds * 1000)} milliseconds")
    return (
        changes.withWatermark("ts", lateness)
        .groupBy("path", window.alias("w"))
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("path").alias("n"),
             F.max_by("event_type", F.struct("ts", "event_type")).alias("last_event"))
        # a condition on the path would be moved below the watermark
        .where("n > 0")
        .select("path", "first_ts", "last_ts", F.col("w.end").alias("session_end"), "n", "last_event")
    )
