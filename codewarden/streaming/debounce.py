"""The debounce of a live stream by timers: a file's burst ends when nothing has come for a while.

Event-time windows have to be told how late a change may come, drop later ones, and wait for newer changes of
other files. Here each file has a timer in processing time, set anew by every change, as the editor's debounce
has. When it runs out, the file's bursts are handed on and forgotten; a change that comes later
still starts a burst of its own, so none is lost, and an idle source closes its last bursts by itself.

Files are dealt to buckets by a hash. A bucket's open bursts are one value of the state, put together column by column,
and Spark's timer of a bucket is the earliest of its files'; so no step is taken for a single file or burst.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of files that have their state, and Spark's timer, together.
BUCKETS = 4096
#: New rows of a bucket that are held before they are put together, beside as many as its open bursts.
_MERGED_ROWS = 100_000
#: Times are microseconds; ``last_event`` is the event of the newest change.
_SESSION = "path string, first long, last long, n long, last_event string"
#: Open bursts as a bucket holds them; ``until`` (milliseconds) is when the file's bursts are handed on.
_OPEN = pa.schema([("path", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64()),
                   ("last_event", pa.string()), ("until", pa.int64())])


def _combined(gap: int):
    """Changes of a file that lie in one gap-wide slot, added up inside their partition before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.assign(slot=batch["at"] // gap)
            shared = batch.duplicated(["path", "slot"], keep=False)
            alone = batch[~shared]
            yield pd.DataFrame({"path": alone["path"], "first": alone["at"], "last": alone["at"], "n": 1,
                                "last_event": alone["event_type"]})
            if shared.any():
                # the newest change of a slot comes last, ties by the event's name
                slots = batch[shared].sort_values(["at", "event_type"], kind="stable").groupby(
                    ["path", "slot"], sort=False).agg(
                    first=("at", "min"), last=("at", "max"), n=("at", "size"), last_event=("event_type", "last"))
                yield slots.reset_index().drop(columns="slot")[["path", "first", "last", "n", "last_event"]]

    return run


def _bursts(rows: pd.DataFrame, gap: int) -> pd.DataFrame:
    """Bursts of files whose parts come in any order: a file's neighbours at most ``gap`` apart are one.

    ``until``, the time at which a file is handed on, is the latest of all its parts.
    """
    rows = rows.assign(event=rows["last_event"].fillna("")).sort_values(
        ["path", "first", "last", "event"], kind="stable", ignore_index=True)
    path, last = rows["path"].to_numpy(), rows["last"].to_numpy()
    files = np.r_[True, path[1:] != path[:-1]]
    file = files.cumsum() - 1
    reach = rows["last"].groupby(file).cummax().to_numpy()
    starts = files | np.r_[True, rows["first"].to_numpy()[1:] - reach[:-1] > gap]
    heads = np.flatnonzero(starts)
    ends = np.r_[heads[1:], len(rows)] - 1
    newest = rows
    if len(heads) < len(rows):
        newest = rows.assign(burst=starts.cumsum()).sort_values(["burst", "last", "event"], kind="stable")
    return pd.DataFrame({
        "path": path[heads], "first": rows["first"].to_numpy()[heads], "last": np.maximum.reduceat(last, heads),
        "n": np.add.reduceat(rows["n"].to_numpy(), heads), "last_event": newest["last_event"].to_numpy()[ends],
        "until": np.maximum.reduceat(rows["until"].to_numpy(), np.flatnonzero(files))[file[heads]]})


def merged(parts: list[tuple], gap: int) -> list[tuple]:
    """Bursts (first, last, n, last event) of one file's parts in any order."""
    if not parts:
        return []
    rows = pd.DataFrame(parts, columns=["first", "last", "n", "last_event"]).assign(path="", until=0)
    return list(_bursts(rows, gap)[["first", "last", "n", "last_event"]].itertuples(index=False, name=None))


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, schema=_OPEN, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _OPEN) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_all().to_pandas()


def _debounced(gap: int, quiet_ms: int):
    """New rows of a bucket's files, or none when a time has run out, with the bucket's open bursts."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        parts = [_unpacked(state.get[0])] if state.exists else []
        held = sum(map(len, parts))
        enough = held + _MERGED_ROWS
        if not state.hasTimedOut:
            for batch in batches:
                parts.append(batch.drop(columns="bucket").assign(until=now + quiet_ms))
                held += len(batch)
                if held > enough:
                    parts = [_bursts(pd.concat(parts, ignore_index=True), gap)]
                    held = len(parts[0])
                    enough = 2 * held + _MERGED_ROWS
        rows = _bursts(pd.concat(parts, ignore_index=True), gap)
        due = rows["until"] <= now
        still = rows[~due]
        if len(still):
            state.update((_packed(still),))
            state.setTimeoutDuration(max(int(still["until"].min()) - now, 1))
        else:
            state.remove()
        if due.any():
            yield rows.loc[due, ["path", "first", "last", "n", "last_event"]]

    return run


def live_sessions(changes: DataFrame, gap_seconds: float, quiet_seconds: float | None = None) -> DataFrame:
    """Bursts of a live stream, as :func:`codewarden.streaming.changes.sessions` has them for a table.

    A file's bursts come out when it had no change for ``quiet_seconds`` (the gap, if not given). Changes
    of a file that arrive before that are put together by their own times, in whatever order they come. The
    state of a bucket is its files' open bursts. Needs a trigger that goes on while no data comes.
    """
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    gap = int(gap_seconds * 1_000_000)
    quiet = int((gap_seconds if quiet_seconds is None else quiet_seconds) * 1000)
    rows = changes.where("path IS NOT NULL AND ts IS NOT NULL").select("path", F.unix_micros("ts").alias("at"), "event_type")
    slots = rows.mapInPandas(_combined(gap), _SESSION)
    buckets = slots.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(BUCKETS)))
    bursts = buckets.groupBy("bucket").applyInPandasWithState(
        _debounced(gap, max(quiet, 1)), _SESSION, "held binary", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return bursts.select(
        "path", F.timestamp_micros("first").alias("first_ts"), F.timestamp_micros("last").alias("last_ts"),
        F.timestamp_micros(F.col("last") + gap).alias("session_end"), "n", "last_event")
