"""Exact dedup against a plain grouping of whole texts."""

import random
import re

from codewarden.llm import digest_merge
from tests.llm.brute import sha

WHITE = re.compile(r"[\x20\x09-\x0D]+")
AWKWARD = [None, "", " ", "\n\n", "a  b", "a b", "a\tb", "a\x0bb", "a\xa0b", " a b", "é" * 100_000, "word " * 50_000]


def groups(rows):
    """digest -> (smallest id, rows)"""
    by = {}
    for i, t, *_ in rows:
        by.setdefault(sha(WHITE.sub(" ", t or "")), []).append(i)
    return {k: (min(v, key=lambda i: (i is None, i or 0)), len(v)) for k, v in by.items()}


def check(rows, got):
    want = groups(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert sorted(r.text_sha256 for r in kept) == sorted(want)


def sample():
    """Awkward texts, some groups, rows without id and one text that a third of all rows have."""
    draw = random.Random(4)
    rows = [(draw.choice([None, *range(200)]), t, "x") for t in AWKWARD * 2]
    rows += [(draw.choice([None, *range(300)]), f"t{draw.randrange(50)}  x", "y") for _ in range(300)]
    return rows + [(draw.randrange(5, 400), draw.choice(["hot text", "hot\n\ntext"]), "z") for _ in range(160)]


def test_groups_of_copies(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(5)
    check(rows, digest_merge.mark_copies(docs).collect())


def test_more_rounds_and_negative_ids(spark):
    rows = [(7 - i, t, "") for i, (_, t, _) in enumerate(sample())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string").repartition(3)
    check(rows, digest_merge.mark_copies(docs, fan=3).collect())


def test_rows_kept(spark):
    rows = sample() + [(1, "twice", "first"), (1, "twice", "second"), (0, "other", "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    left = digest_merge.drop_copies(docs)
    assert left.columns == docs.columns
    got = [(r.doc_id, sha(WHITE.sub(" ", r.text or ""))) for r in left.collect()]
    want = [(i, k) for k, (i, _) in groups(rows).items()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, kept string")
    assert digest_merge.mark_copies(docs).collect() == []
    assert digest_merge.drop_copies(docs).collect() == []


def test_rounds_merge_and_keep_ranges():
    import numpy as np

    # three runs to the power of two rounds: each run ends with its own ninth of all digests
    draw = np.random.default_rng(1)
    held = {}
    for run in range(9):
        e = np.zeros(40, digest_merge._ENTRY)
        e["d0"] = draw.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2)
        e["d0"][:3] = [0, 2**64 - 1, 2**63]
        e["id"], e["rows"] = np.arange(40) + run, 1
        held[run] = digest_merge._merged(e)[0]
    for done in range(2):
        handed = {}
        for run, entries in held.items():
            for to, _, part in digest_merge._handed(run, entries, done, 3, 2):
                handed.setdefault(to, []).append(np.frombuffer(part, digest_merge._ENTRY))
        held = {run: digest_merge._merged(np.concatenate(parts))[0] for run, parts in handed.items()}
    assert sum(int(e["rows"].sum()) for e in held.values()) == 9 * 40
    for run, e in held.items():
        assert all(run * 2**64 // 9 <= int(x) < (run + 1) * 2**64 // 9 for x in e["d0"])
    assert held[0]["rows"][0] == 9 and held[8]["rows"][-1] == 9 and held[0]["id"][0] == 0
