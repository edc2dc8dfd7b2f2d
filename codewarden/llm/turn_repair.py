"""Repair of the turn structure of conversations at least cost, with an audit of the edits.

A conversation's rows are taken by turn. A row's first fault counts: blank, duplicate (role and text of an
earlier row), truncated (its text does not end in a full stop, exclamation or question mark). Roles must read
``(s?(ua)+)?`` by their initials. A row is Kept (0), Reroled to user or assistant (3) or Deleted (4, and a
must for blank and duplicate rows); a row with an empty text is Inserted anywhere (3); a truncated row that
stays costs 3 more. The cheapest edits are taken, of equally cheap ones those whose initials are least.

The audit DP. Four states say what stands at the end so far: nothing, system, user, assistant. For each
row and state the best cost and its edits are kept. Edits are linked nodes that share their prefixes
(:class:`_Trail`); a node knows its 2**k-th ancestors and a rolling hash of its prefix, so two
equally cheap trails are compared by searching their longest common prefix from hash to hash.
Prefixes that the hashes call equal are followed back to their common node, and if they turn out to differ
the trails are compared letter by letter.

How long conversations are spread. Rows are dealt by ranges of (conversation, turn, row) and sorted there, so a
conversation with a third of all rows takes a third of the tasks, and equal rows can be parted too. A block is
what one task got. Blocks cut conversations into pieces of at most PIECE rows. A piece that may not
start at a conversation's beginning is solved from all four states: 4 x 4 costs and, for each
start, the order of the trails to the four ends. No trail is the beginning of another one
over the same rows, as inserts are always put before the next row. So the pieces of a conversation are
chained by costs and orders alone, a hundred bytes each, and the pieces' own trails are looked up afterwards.
Duplicates across blocks are found by the least block of each (conversation, role and text), for
the conversations that cross a border only: at most one per border, which are broadcast.

Defined cases: a null role or text is empty; a null turn comes first and has no part in gaps; a null id is one
conversation; rows of one turn are ordered by a digest of role and text, so repeated rows are
neighbours and all but the first are duplicates; an empty table gives empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm.common import left_join, on_workers, stored

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: Rows that are solved at once.
PIECE = 4096
#: States by what stands last, and the role that an added or reroled row gets there.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT_ROLE = ["user", "user", "assistant", "user"]
_NEVER = 2**60
_MODULUS, _BASE = 2**61 - 1, 1_000_003_579


class _Trail:
    """The edits up to a row: the last one, and all before it shared with other trails."""

    __slots__ = ("depth", "edit", "hash", "up")

    def __init__(self, before: _Trail | None, edit: str):
        self.edit = edit
        #: Ancestors 1, 2, 4, ... edits before.
        self.up: list[_Trail] = []
        if before is None:
            self.depth, self.hash = 0, 0
            return
        self.depth = before.depth + 1
        self.hash = (before.hash * _BASE + ord(edit)) % _MODULUS
        ancestor, k = before, 0
        while True:
            self.up.append(ancestor)
            if len(ancestor.up) <= k:
                break
            ancestor = ancestor.up[k]
            k += 1

    def at(self, depth: int) -> _Trail:
        node, over, k = self, self.depth - depth, 0
        while over:
            if over & 1:
                node = node.up[k]
            over >>= 1
            k += 1
        return node

    def text(self) -> str:
        out, node = [], self
        while node.up:
            out.append(node.edit)
            node = node.up[0]
        return "".join(reversed(out))


def _alike(a: _Trail, b: _Trail) -> bool:
    """Whether two trails of one depth and hash really are equal; they usually meet at once."""
    while a is not b and a.up:
        if a.edit != b.edit:
            return False
        a, b = a.up[0], b.up[0]
    return True


def before(a: _Trail, b: _Trail) -> bool:
    """Whether the edits of ``a`` come before those of ``b`` in the order of their letters."""
    depth = min(a.depth, b.depth)
    x, y = a.at(depth), b.at(depth)
    if x.hash == y.hash:
        return a.depth < b.depth if _alike(x, y) else a.text() < b.text()
    for k in range(len(x.up) - 1, -1, -1):
        if k < len(x.up) and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
    if not _alike(x.up[0], y.up[0]):
        return a.text() < b.text()
    return x.edit < y.edit


def _best(*choices: tuple[int, _Trail, str]) -> tuple[int, _Trail | None]:
    """The cheapest of (cost, trail, one more edit or none), among equals the first in order."""
    cost = min(c[0] for c in choices)
    if cost >= _NEVER:
        return _NEVER, None
    best = None
    for c, trail, edit in choices:
        if c == cost:
            trail = _Trail(trail, edit) if edit else trail
            if best is None or before(trail, best):
                best = trail
    return cost, best


def _with_inserts(states: list) -> tuple[tuple, tuple]:
    """The states user and assistant, with rows inserted if that is the way."""
    user = _best((*states[USER], ""), *[(states[s][0] + INSERT_COST, states[s][1], INSERT) for s in (NOTHING, SYSTEM, ASSISTANT)])
    assistant = _best((*states[ASSISTANT], ""), (user[0] + INSERT_COST, user[1], INSERT))
    return user, assistant


def solve(rows: list[tuple[str, bool, bool]], start: int = NOTHING) -> list[tuple[int, _Trail | None]]:
    """For each end state the cheapest trail; rows are (initial, has to go, is truncated)."""
    states: list = [(_NEVER, None)] * 4
    states[start] = (0, _Trail(None, ""))
    for initial, gone, cut in rows:
        new = [[(c + DELETE_COST, t, DELETE)] for c, t in states]
        if not gone:
            extra = TRUNCATED_COST if cut else 0
            user, assistant = _with_inserts(states)
            if initial == "s":
                new[SYSTEM].append((states[NOTHING][0] + extra, states[NOTHING][1], KEEP))
            for c, t in (states[NOTHING], states[SYSTEM], assistant):
                new[USER].append((c + extra, t, KEEP) if initial == "u" else (c + extra + REROLE_COST, t, REROLE))
            c, t = user
            new[ASSISTANT].append((c + extra, t, KEEP) if initial == "a" else (c + extra + REROLE_COST, t, REROLE))
        states = [_best(*x) for x in new]
    return states


def finish(states: list) -> tuple[int, _Trail]:
    """The cheapest trail to a whole conversation, or to none at all."""
    return _best((*states[NOTHING], ""), (*_with_inserts(states)[1], ""))


#: What is inserted behind a conversation's last row to end in each state's nearest whole conversation.
_TAILS = {NOTHING: ["", INSERT * 2], SYSTEM: [INSERT * 2], USER: [INSERT], ASSISTANT: [""]}


def chain(pieces: list[tuple[list[int], list[int]]]) -> list[tuple[int, int, str]]:
    """For consecutive pieces, each with 16 costs and 16 orders (start * 4 + end): start, end, inserts behind."""
    # per state: cost, order among the states, the ends so far
    states = {NOTHING: (0, 0, None)}
    for costs, orders in pieces:
        found = {}
        for end in range(4):
            ways = [(c + costs[s * 4 + end], order, orders[s * 4 + end], s)
                    for s, (c, order, _) in states.items() if costs[s * 4 + end] < _NEVER]
            if ways:
                found[end] = min(ways)
        ranked = sorted(found, key=lambda end: found[end][1:3])
        states = {end: (found[end][0], ranked.index(end), (end, states[found[end][3]][2])) for end in found}
    cost, order, tail, path = min(
        (c + INSERT_COST * len(tail), order, tail, path) for s, (c, order, path) in states.items() for tail in _TAILS[s])
    ends = []
    while path is not None:
        ends.append(path[0])
        path = path[1]
    ends.reverse()
    starts = [NOTHING, *ends[:-1]]
    return [(s, e, tail if k == len(ends) - 1 else "") for k, (s, e) in enumerate(zip(starts, ends, strict=True))]


_SOLVED = pa.schema([
    ("block", pa.int64()), ("piece", pa.int64()), ("conv_id", pa.int64()), ("rows", pa.int64()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first_turn", pa.int64()),
    ("last_turn", pa.int64()), ("turns", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string()),
    ("cost", pa.int64()), ("audit", pa.string()), ("costs", pa.list_(pa.int64())), ("orders", pa.list_(pa.int64())),
    ("audits", pa.list_(pa.string()))])
_SOLVED_SQL = ("block long, piece long, conv_id long, rows long, blank long, duplicate long, truncated long, illegal long, "
               "first_turn long, last_turn long, turns long, first_initial string, last_initial string, cost long, "
               "audit string, costs array<long>, orders array<long>, audits array<string>")
_LEGAL = {"su", "ua", "au"}


def _matrix(rows: list) -> dict:
    """Costs, orders and trails from each state to each state."""
    costs, orders, audits = [], [], []
    for start in range(4):
        ends = solve(rows, start)
        texts = [t.text() if t else None for _, t in ends]
        ranked = sorted(t for t in texts if t is not None)
        costs += [c for c, _ in ends]
        orders += [ranked.index(t) if t is not None else 0 for t in texts]
        audits += texts
    return {"costs": costs, "orders": orders, "audits": audits}


def _solve_block(key: tuple, rows: pa.Table, seen: pa.Table) -> pa.Table:
    """The pieces of a block; those of conversations that lie inside it and are one piece are solved for good."""
    order = np.argsort(rows.column("pos").to_numpy(), kind="stable")
    conv, turn, digest, initial, blank, cut = (
        rows.column(c).take(order).to_pylist() for c in ("conv_id", "turn", "digest", "initial", "blank", "cut"))
    elsewhere: dict = {}
    for c, d in zip(seen.column("conv_id").to_pylist(), seen.column("digest").to_pylist(), strict=True):
        elsewhere.setdefault(c, set()).add(d)
    out, n, begin = [], len(conv), 0
    while begin < n:
        end = begin
        while end < n and conv[end] == conv[begin]:
            end += 1
        known = elsewhere.get(conv[begin], set())
        # the first and the last conversation of a block may go on in others
        whole = begin > 0 and end < n and end - begin <= PIECE
        for a in range(begin, end, PIECE):
            b = min(a + PIECE, end)
            todo, faults = [], [0, 0, 0]
            for k in range(a, b):
                copy = not blank[k] and digest[k] in known
                known.add(digest[k])
                cut_here = cut[k] and not blank[k] and not copy
                faults[0] += blank[k]
                faults[1] += copy
                faults[2] += cut_here
                todo.append((initial[k], blank[k] or copy, cut_here))
            turns = [t for t in turn[a:b] if t is not None]
            row = dict.fromkeys(_SOLVED.names) | {
                "block": key[0].as_py(), "piece": len(out), "conv_id": conv[a], "rows": b - a, "blank": faults[0],
                "duplicate": faults[1], "truncated": faults[2],
                "illegal": sum(x + y not in _LEGAL for x, y in zip(initial[a:b], initial[a + 1:b], strict=False)),
                "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
                "turns": len(set(turns)), "first_initial": initial[a], "last_initial": initial[b - 1]}
            if whole:
                cost, trail = finish(solve(todo))
                row |= {"cost": cost, "audit": trail.text()}
            else:
                row |= _matrix(todo)
            out.append(row)
        begin = end
    return pa.Table.from_pylist(out, schema=_SOLVED)


_CHAINED = "block long, piece long, start long, end long, tail string, illegal_more long, turns_less long"


def _chain_pieces(rows: pa.Table) -> pa.Table:
    pieces = sorted(rows.to_pylist(), key=lambda r: (r["block"], r["piece"]))
    steps = chain([(r["costs"], r["orders"]) for r in pieces])
    out, last_turn, last = [], None, None
    for r, (start, end, tail) in zip(pieces, steps, strict=True):
        out.append({
            "block": r["block"], "piece": r["piece"], "start": start, "end": end, "tail": tail,
            "illegal_more": int(last is not None and last + r["first_initial"] not in _LEGAL),
            "turns_less": int(last_turn is not None and last_turn == r["first_turn"])})
        last = r["last_initial"]
        last_turn = r["last_turn"] if r["last_turn"] is not None else last_turn
    return pa.Table.from_pylist(out, schema=pa.schema([
        *[(c, pa.int64()) for c in ("block", "piece", "start", "end")], ("tail", pa.string()),
        ("illegal_more", pa.int64()), ("turns_less", pa.int64())]))


def _apply_block(key: tuple, rows: pa.Table, pieces: pa.Table) -> pa.Table:
    """The repaired rows of a block: (conv_id, block, place, edit, role, text)."""
    rows = rows.take(np.argsort(rows.column("pos").to_numpy(), kind="stable"))
    roles, of, edits, new_roles, convs, at = rows.column("role").to_pylist(), [], [], [], [], 0
    for p in sorted(pieces.select(["piece", "conv_id", "start", "audit"]).to_pylist(), key=lambda r: r["piece"]):
        state = p["start"]
        for edit in p["audit"]:
            if edit == DELETE:
                at += 1
                continue
            role = roles[at] if edit == KEEP else NEXT_ROLE[state]
            of.append(None if edit == INSERT else at)
            at += edit != INSERT
            state = SYSTEM if role[0] == "s" else USER if role[0] == "u" else ASSISTANT
            edits.append(edit)
            new_roles.append(role)
            convs.append(p["conv_id"])
    return pa.table({
        "conv_id": pa.array(convs, pa.int64()), "block": pa.array([key[0].as_py()] * len(of), pa.int64()),
        "place": pa.array(range(len(of)), pa.int64()), "edit": pa.array(edits, pa.string()),
        "role": pa.array(new_roles, pa.string()),
        "text": rows.column("text").take(pa.array(of, pa.int64())).fill_null("") if len(of) else pa.array([], pa.string())})


class Repair(NamedTuple):
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    audits: DataFrame
    #: conv_id, block, place, edit, role, text; a conversation's rows are in the order of block and place
    turns: DataFrame


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Every conversation of ``turns`` with its audit, and its repaired rows."""
    spark = on_workers(turns.sparkSession)
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    # a number of its own lets equal rows go to several blocks
    rows = rows.withColumns({"digest": digest, "number": F.monotonically_increasing_id()})
    by = ["conv_id", "turn", "digest", "number"]
    rows = rows.repartitionByRange(blocks, *by).sortWithinPartitions(*by)
    rows = stored(rows.select(F.spark_partition_id().cast("long").alias("block"), F.monotonically_increasing_id().alias("pos"),
                              "conv_id", "turn", "digest", "role", "text"), "turns")
    slim = rows.select(
        "block", "pos", "conv_id", "turn", "digest", F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))

    # rows of earlier blocks, for conversations in several blocks: fewer than there are blocks
    crossing = rows.groupBy("conv_id").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high")
    crossing = crossing.select(F.col("conv_id").alias("crossing"))
    keys = rows.join(F.broadcast(crossing), F.col("conv_id").eqNullSafe(F.col("crossing")), "left_semi")
    where = keys.groupBy("conv_id", "digest").agg(F.array_sort(F.collect_set("block")).alias("blocks")).where("size(blocks) > 1")
    seen = stored(where.select("conv_id", "digest", F.explode(F.slice("blocks", 2, F.size("blocks") - 1)).alias("block")), "seen")
    solved = stored(slim.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(
        lambda key, a, b: _solve_block(key, a, b), _SOLVED_SQL), "solved")

    chained = solved.where("audit IS NULL").drop("audits").groupBy("conv_id").applyInArrow(
        lambda table: _chain_pieces(table), _CHAINED)
    pieces = solved.join(chained.withColumnsRenamed({"block": "__block", "piece": "__piece"}),
                         (F.col("block") == F.col("__block")) & (F.col("piece") == F.col("__piece")), "left")
    way = F.col("start") * 4 + F.col("end")
    pieces = stored(pieces.select(
        "block", "piece", "conv_id", "blank", "duplicate", "truncated", "first_turn", "last_turn",
        (F.col("illegal") + F.coalesce("illegal_more", F.lit(0))).alias("illegal"),
        (F.col("turns") - F.coalesce("turns_less", F.lit(0))).alias("turns"),
        F.coalesce("start", F.lit(0)).alias("start"),
        F.coalesce("cost", F.get("costs", way) + INSERT_COST * F.length("tail")).alias("cost"),
        F.coalesce("audit", F.concat(F.get("audits", way), F.col("tail"))).alias("audit")), "pieces")

    in_order = F.array_sort(F.collect_list(F.struct("block", "piece", "audit")))
    audits = pieces.groupBy("conv_id").agg(
        F.coalesce(F.max("last_turn") - F.min("first_turn") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(in_order, lambda p: p["audit"]), "").alias("audit"))
    repaired = rows.select("block", "pos", "role", "text").groupBy("block").cogroup(pieces.groupBy("block")).applyInArrow(
        lambda key, a, b: _apply_block(key, a, b), "conv_id long, block long, place long, edit string, role string, text string")
    return Repair(audits, repaired)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` lines, whose rows follow each other; one is held at a time."""
    current, digest, out = None, None, []
    for batch in batches:
        for c, r, t in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "role", "text")], strict=True):
            if digest is None or c != current:
                if digest is not None:
                    out.append((current, digest.hexdigest()))
                current, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{r}:{t}".encode())
        if out:
            yield _digest_rows(out)
            out = []
    if digest is not None:
        yield _digest_rows([(current, digest.hexdigest())])


def _digest_rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([c for c, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.string())], names=["conv_id", "sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 of the repaired rows of every conversation that has some.

    A digest is made in order, so a conversation's rows pass through one task, a batch at a time.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "block", "place")
    return dealt.select("conv_id", "role", "text").mapInArrow(_digests, "conv_id long, sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) spoilt by a checksum of conversation and turn; nulls are one blank.

    Of each twenty, one is dropped, one emptied, one loses its sentence ends, one stands twice and one is the user's.
    """
    blank = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank),
                               F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
                        kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(
        F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))))
    return rows.drop("col")


def repair_all(turns: DataFrame, damaged: DataFrame) -> DataFrame:
    """Every conversation of ``turns`` with what the repair of ``damaged`` found: audits and sha256."""
    audits, rows = repair(damaged)
    out = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for found in (audits, digests(rows)):
        out = left_join(out, found, ["conv_id"])
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
