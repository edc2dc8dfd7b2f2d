"""Exact dedup by a tree merge of sorted digest runs.

Each row's text, with white space runs as one blank, becomes its SHA-256 digest. Rows are dealt into runs
without regard to their text, so a text that a third of all rows have is spread over all runs. A run is
sorted by digest and has each digest once, with its smallest id and its number of rows.

Runs exchange in rounds. The number of runs is ``FAN ** rounds``, and a run's number written to the base
``FAN`` has one digit per round. In round r the runs that differ in digit r only form a group; each cuts what
it has into ``FAN`` equal ranges of digests, hands the j-th range to the member whose digit is j, and merges
what it was handed: equal digests become one entry with the smallest id. After the last round a run holds
its own range of all digests, with the smallest id in the whole table. No task ever receives more than
``FAN`` runs of different digests, whatever the number of copies, and none receives them all.

The answers go back by the same rounds in the opposite direction: what a member was handed in a round tells
which digests it has to answer. So each run gets one answer per digest it has, and no join by digest is made.

Entries are sorted by the first eight bytes of the digest, and taken as equal only if all 32 bytes are.

Defined cases: a null text is empty, and empty texts are copies of each other; a null id comes behind every
other; of rows that share the smallest id and the text, the one that is read first stays, and the others go
though they carry ``keep_id`` themselves; an empty table gives an empty result; other columns keep their
names and values in :func:`drop_copies` and are not read by :func:`mark_copies`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.llm.common import WHITE_RUN, on_workers, stored

#: Runs that exchange with each other in a round.
FAN = 8
_NO_ID = np.iinfo(np.int64).max
#: An entry: the digest in four parts, the smallest id, which row of that id was read first, the number of rows.
_ENTRY = np.dtype([("d0", "<u8"), ("d1", "<u8"), ("d2", "<u8"), ("d3", "<u8"), ("id", "<i8"), ("null", "<i8"), ("place", "<i8"),
                   ("rows", "<i8")])
_DIGEST = ["d0", "d1", "d2", "d3"]
_ANSWER = np.dtype([("id", "<i8"), ("null", "<i8"), ("place", "<i8"), ("rows", "<i8")])


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text with every white space run as one blank."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_RUN, " "), 256)


def _merged(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One entry per digest, sorted, and for each given entry the number of its own."""
    order = np.lexsort([entries[c] for c in ("place", "id", "null", *reversed(_DIGEST))])
    ranked = entries[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = False
    for c in _DIGEST:
        new[1:] |= ranked[c][1:] != ranked[c][:-1]
    first = np.flatnonzero(new)
    out = ranked[first].copy()
    if len(first):
        out["rows"] = np.add.reduceat(ranked["rows"], first)
    number = np.empty(len(entries), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return out, number


def _entries(rows: pa.Table) -> np.ndarray:
    """The rows of a run as entries of one row each."""
    out = np.zeros(rows.num_rows, dtype=_ENTRY)
    digests = rows.column("digest").combine_chunks()
    if rows.num_rows:
        parts = np.frombuffer(digests.buffers()[2], ">u8")[4 * digests.offset:][:4 * len(digests)]
        for k, c in enumerate(_DIGEST):
            out[c] = parts[k::4]
    ids = rows.column("doc_id")
    out["null"] = ids.is_null().to_numpy()
    out["id"] = ids.fill_null(_NO_ID).to_numpy()
    out["place"] = rows.column("place").to_numpy()
    out["rows"] = 1
    return out


def _range_edges(run: int, done: int, fan: int, rounds: int) -> list[int]:
    """The ``fan + 1`` bounds of a run's digest ranges after ``done`` rounds, by the first 64 bits."""
    width = fan ** (rounds - done)
    low = run // width * width
    return [(low + j * width // fan) * 2**64 // fan**rounds for j in range(fan + 1)]


def _handed(run: int, entries: np.ndarray, done: int, fan: int, rounds: int) -> list[tuple]:
    """What a run hands to the members of its group: (to, from digit, entries)."""
    edges = _range_edges(run, done, fan, rounds)
    at = [0, *(int(np.searchsorted(entries["d0"], np.uint64(e))) for e in edges[1:-1]), len(entries)]
    width = fan ** (rounds - 1 - done)
    mine = run // width % fan
    return [(run + (j - mine) * width, mine, entries[at[j]:at[j + 1]].tobytes()) for j in range(fan)]


_HANDED = "run long, sender long, entries binary"
_ANSWERS = "run long, slot long, answers binary"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.table({n: pa.array(c, kinds[t]) for (n, t), c in zip(fields, columns, strict=True)})


def _received(rows: pa.Table) -> tuple[list[int], list[np.ndarray]]:
    """Senders in order and what each has handed over."""
    got = sorted(zip(rows.column("sender").to_pylist(), rows.column("entries").to_pylist(), strict=True))
    return [s for s, _ in got], [np.frombuffer(e, _ENTRY) for _, e in got]


def _first_round(fan: int, rounds: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        number = key[0].as_py()
        return _table(_handed(number, _merged(_entries(rows))[0], 0, fan, rounds), _HANDED)

    return lambda key, rows: run(key, rows)


def _next_round(done: int, fan: int, rounds: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        number = key[0].as_py()
        entries, _ = _merged(np.concatenate(_received(rows)[1]))
        return _table(_handed(number, entries, done, fan, rounds), _HANDED)

    return lambda key, rows: run(key, rows)


def _answer(done: int, fan: int, rounds: int):
    """A run's answers to the members that handed it entries in round ``done - 1``.

    After the last round the run's own entries are the answers; before, they come from the members that this
    run handed its entries to, and stand in the order of their ranges.
    """

    def run(key: tuple, rows: pa.Table, above: pa.Table | None) -> pa.Table:
        number = key[0].as_py()
        senders, parts = _received(rows)
        entries, place = _merged(np.concatenate(parts)) if parts else (np.zeros(0, _ENTRY), np.zeros(0, np.int64))
        if above is None:
            answers = np.zeros(len(entries), dtype=_ANSWER)
            for c in _ANSWER.names:
                answers[c] = entries[c]
        else:
            answers = _joined(above)
        width = fan ** (rounds - done)
        mine = number // width % fan
        out, at = [], 0
        for sender, part in zip(senders, parts, strict=True):
            out.append((number + (sender - mine) * width, mine, answers[place[at:at + len(part)]].tobytes()))
            at += len(part)
        return _table(out, _ANSWERS)

    if done == rounds:
        return lambda key, rows: run(key, rows, None)
    return lambda key, rows, above: run(key, rows, above)


def _joined(answers: pa.Table) -> np.ndarray:
    got = sorted(zip(answers.column("slot").to_pylist(), answers.column("answers").to_pylist(), strict=True))
    return np.concatenate([np.frombuffer(a, _ANSWER) for _, a in got]) if got else np.zeros(0, _ANSWER)


def _marked(rows: pa.Table, above: pa.Table) -> pa.Table:
    entries = _entries(rows)
    answers = _joined(above)[_merged(entries)[1]]
    kept = (entries["place"] == answers["place"])
    return pa.table({
        "doc_id": rows.column("doc_id"), "place": rows.column("place"),
        "keep_id": pa.array(answers["id"], mask=answers["null"] > 0), "group_size": pa.array(answers["rows"]),
        "kept": pa.array(kept), "digest": rows.column("digest")})


def _marks(docs: DataFrame, fan: int) -> DataFrame:
    """doc_id, place, keep_id, group_size, kept, digest of rows with doc_id and text."""
    spark = on_workers(docs.sparkSession)
    wanted, rounds = int(spark.conf.get("spark.sql.shuffle.partitions")), 1
    while fan**rounds < wanted:
        rounds += 1
    runs = fan**rounds
    # written down, so that a row has the same place however often it is read
    rows = stored(docs.select("doc_id", F.unhex(digest(F.col("text"))).alias("digest"),
                              F.monotonically_increasing_id().alias("place")), "digests")
    rows = rows.withColumn("run", F.pmod(F.xxhash64("place"), F.lit(runs)))
    handed = [stored(rows.groupBy("run").applyInArrow(_first_round(fan, rounds), _HANDED), "round-0")]
    for done in range(1, rounds):
        handed.append(stored(handed[-1].groupBy("run").applyInArrow(_next_round(done, fan, rounds), _HANDED), f"round-{done}"))
    answers = handed[-1].groupBy("run").applyInArrow(_answer(rounds, fan, rounds), _ANSWERS)
    for done in range(rounds - 1, 0, -1):
        answers = handed[done - 1].groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(
            _answer(done, fan, rounds), _ANSWERS)
    return rows.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(
        _marked, "doc_id long, place long, keep_id long, group_size long, kept boolean, digest binary")


def mark_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    marks = _marks(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), fan)
    return marks.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fan: int = FAN) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each group of equal texts.

    Of rows that share the smallest id and the text, any one stays. Texts that no row repeats under the
    same id, which is the rule, are not moved.
    """
    out = docs.withColumns({"__id": F.col(doc_id).cast("long"), "__digest": F.unhex(digest(F.col(text)))})
    marks = _marks(out.select(F.col("__id").alias("doc_id"), F.col(text).alias("text")), fan)
    best = marks.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", "digest").agg(
        F.count("*").alias("__alike"))
    best = stored(best.select(F.col("doc_id").alias("__kept_id"), F.col("digest").alias("__kept"), "__alike"), "winners")
    found = out.join(best, out["__id"].eqNullSafe(best["__kept_id"]) & (out["__digest"] == best["__kept"]))
    alone = found.where("__alike = 1")
    alike = found.where("__alike > 1").dropDuplicates(["__id", "__digest"])
    return alone.unionByName(alike).select(*docs.columns)
