"""Conversation repair against a plain DP over whole strings, and that against all edits of short ones."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

from codewarden.llm import turn_repair
from codewarden.llm.queries import op12_conversation_repair
from tests.llm.brute import sha

NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def judged(rows):
    """rows (role, text) in order -> (initial, fault)"""
    out, seen = [], set()
    for role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def plain(rows):
    """cost, audit, repaired lines: least (cost, audit) for every last role, inserts tried two at a time"""
    best = {"": (0, "", [])}

    def inserted(best):
        out = dict(best)
        for _ in range(2):
            for last, (c, audit, lines) in list(out.items()):
                role = "assistant" if last == "u" else "user"
                way = (c + 3, audit + "I", [*lines, role + ":"])
                if role[0] not in out or way[:2] < out[role[0]][:2]:
                    out[role[0]] = way
        return out

    for (role, text), (initial, fault) in zip(rows, judged(rows)):
        new = {}
        for last, (c, audit, lines) in inserted(best).items():
            ways = [(last, (c + 4, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if initial and initial in NEXT[last]:
                    ways.append((initial, (c + more, audit + "K", [*lines, f"{role}:{text}"])))
                other = "assistant" if last == "u" else "user"
                ways.append((other[0], (c + 3 + more, audit + "R", [*lines, f"{other}:{text}"])))
            for end, way in ways:
                if end not in new or way[:2] < new[end][:2]:
                    new[end] = way
        best = new
    best = inserted(best)
    return min(best[k] for k in ("", "a") if k in best)


def exhaustive(rows):
    """least (cost, audit) over all ways to edit, with up to two inserts in every place"""
    faults, found = judged(rows), []
    for edits in product("KDua", repeat=len(rows)):
        for added in product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
            cost, audit, roles = 0, "", ""
            for (initial, fault), edit, add in zip([*faults, ("", "")], [*edits, ""], added):
                cost, audit, roles = cost + 3 * len(add), audit + "I" * len(add), roles + add
                if edit == "D":
                    cost, audit = cost + 4, audit + "D"
                elif edit:
                    if fault in ("blank", "duplicate"):
                        cost = 999
                    cost += 3 * (fault == "truncated") + 3 * (edit != "K")
                    audit, roles = audit + ("K" if edit == "K" else "R"), roles + (initial or "-" if edit == "K" else edit)
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, audit))
    return min(found)


def sample(n, draw, kinds=("system", "user", "assistant", "tool", "")):
    return [(draw.choice(kinds), draw.choice(["Yes.", "No!", "cut", " ", "", "b. ", "c. ", "d.\n", f"t{draw.randrange(99)}?"]))
            for _ in range(n)]


def run(rows):
    cost, trail = turn_repair.finish(turn_repair.solve([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in judged(rows)]))
    return cost, trail.text()


def test_all_edits_of_short_conversations():
    draw = random.Random(2)
    for n in (0, 1, 1, 1, 2, 2, 2, 2, 2, 2, 3, 3):
        rows = sample(n, draw)
        assert run(rows) == plain(rows)[:2] == exhaustive(rows)


def test_long_conversations_and_pieces():
    draw = random.Random(3)
    for n in (5, 30, 30, 30, 200, 200):
        for kinds in (("user", "assistant"), ("assistant", "assistant", "user", "tool"), ("system", "user", "tool"), ("user",)):
            rows = [(r, t + str(k) + draw.choice(".?x")) for k, (r, t) in enumerate(sample(n, draw, kinds))]
            want = plain(rows)[:2]
            assert run(rows) == want
            todo = [(i, f in ("blank", "duplicate"), f == "truncated") for i, f in judged(rows)]
            parts = [turn_repair._matrix(todo[a:a + 7]) for a in range(0, n, 7)]
            steps = turn_repair.chain([(p["costs"], p["orders"]) for p in parts])
            audit = "".join(p["audits"][s * 4 + e] + tail for p, (s, e, tail) in zip(parts, steps))
            assert audit == want[1]
            cost = sum(p["costs"][s * 4 + e] + 3 * len(tail) for p, (s, e, tail) in zip(parts, steps))
            assert cost == want[0]


def grown(text):
    trail = turn_repair._Trail(None, "")
    for c in text:
        trail = turn_repair._Trail(trail, c)
    return trail


def test_trails_compare_like_text(monkeypatch):
    draw = random.Random(5)
    pairs = [("", ""), ("", "D"), ("KK", "KK"), ("KD", "KDI"), ("K" * 70 + "D", "K" * 70 + "I")]
    for _ in range(200):
        same = "".join(draw.choices("DIKR", k=draw.randrange(40)))
        pairs.append(tuple(same + "".join(draw.choices("DIKR", k=draw.randrange(6))) for _ in "ab"))
    for modulus in (turn_repair._MODULUS, 5, 1):
        # few hash values make collisions, which the comparison has to notice
        monkeypatch.setattr(turn_repair, "_MODULUS", modulus)
        for a, b in pairs:
            x, y = grown(a), grown(b)
            assert turn_repair.before(x, y) == (a < b)
            assert x.text() == a and x.at(min(3, x.depth)).text() == a[:3]
        shared = grown("KDR")
        assert turn_repair.before(turn_repair._Trail(shared, "D"), turn_repair._Trail(shared, "I"))


def expected(rows):
    """conv_id -> figures, from rows (conv_id, turn, role, text) in any order"""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, found in by.items():
        found.sort(key=lambda r: (r[:2], hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).digest()))
        turns = [t for known, t, _, _ in found if known]
        lines = [r[2:] for r in found]
        faults = [f for _, f in judged(lines)]
        cost, audit, repaired = plain(lines)
        initials = [r[:1] for r, _ in lines]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha("\n".join(repaired)))
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def check(df, rows, ids):
    want = expected(rows)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}
    assert set(got) == set(ids)
    for conv in ids:
        assert got[conv] == want.get(conv, (0,) * 6 + ("", sha("")))


def awkward():
    draw = random.Random(6)
    rows = []
    for conv in [None, *range(60)]:
        rows += [(conv, draw.choice([None, k, k, k]), *x) for k, x in enumerate(sample(draw.randrange(12), draw, ("system", "user", "assistant", None)))]
    # a third of all rows in one conversation, many of them equal
    rows += [(7, draw.choice([None, draw.randrange(60)]), draw.choice(["user", "assistant"]), draw.choice(["again.", f"w{k}."])) for k in range(250)]
    return rows + [(7, 3, "user", "again.")] * 30 + [(61, None, None, None), (62, 2**40, "user", "x" * 300_000), (62, -5, "user", "y.")]


def test_repair(spark):
    rows = awkward()
    turns = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, block string, cost int")
    check(turn_repair.repair_all(turns, turns), rows, {r[0] for r in rows})
    check(turn_repair.repair_all(turns, turn_repair.damage(turns)), damaged(rows), {r[0] for r in rows})
    none = turns.limit(0)
    assert turn_repair.repair_all(none, none).collect() == []
    assert turn_repair.repair_all(turns.limit(3), none).count() > 0


def test_repaired_rows_keep_the_rules(spark):
    rows = awkward()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = defaultdict(list)
    for r in turn_repair.repair(turns).turns.collect():
        found[r.conv_id].append((r.block, r.place, r.role, r.text, r.edit))
    for lines in found.values():
        lines.sort()
        assert re.fullmatch("s?(ua)+", "".join(x[2][0] for x in lines))
        assert all((x[3] == "") == (x[4] == "I") for x in lines)


def test_query_on_given_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(op12_conversation_repair(spark, sf_dir), damaged(rows), {r[0] for r in rows})
