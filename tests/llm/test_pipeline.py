"""The pipeline's stages against plain versions, and on awkward tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from codewarden.llm.oracle import ORACLE
from tests.llm.brute import LOWER, linked
from verification.compare import connect

SF_DIR = "/root/testdata/sf0.001"


def plain_lines(rows):
    """rows of (id, text), ids distinct"""
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out.append((i, "\n".join(kept)))
    return out


def check_packing(rows, pieces, capacity=2048):
    """Every text's ids once, in order, in sequences without gaps; returns sequences and their lower bound."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a:a + capacity]
            want[i, k, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == want
    by = defaultdict(list)
    for r in pieces:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by), -(-sum(k[3] * n for k, n in want.items()) // capacity)


def test_pipeline_equals_plain_stages(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    con = connect(SF_DIR)
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLE['op9_host_quality']}) WHERE kept").fetchall()}
    rows = plain_lines([r for r in rows if r[0] in good])
    labels = linked(rows, 5, 80)
    rows = [(i, t) for i, t in rows if labels[i][1] == i]
    con.execute("CREATE OR REPLACE TABLE cleaned AS SELECT * FROM (VALUES (0::BIGINT, 'x')) t(doc_id, text) LIMIT 0")
    con.executemany("INSERT INTO cleaned VALUES (?, ?)", rows)
    sql = ORACLE["op5_positional_decontamination"].replace("FROM documents", "FROM cleaned")
    clean = {r[0] for r in con.execute(f"SELECT doc_id FROM ({sql}) WHERE NOT contaminated").fetchall()}
    rows = [r for r in rows if r[0] in clean]
    sequences, bound = check_packing(rows, corpus_pipeline.run(spark, SF_DIR).collect())
    assert sequences <= bound + 2


@pytest.mark.parametrize("size", ["awkward", "empty"])
def test_stages_take_awkward_tables(spark, size):
    body = " ".join(f"word{k}" for k in range(80))
    rows = [(1, body, "en", "a", 5), (1, body, "en", "a", 5), (2, body.upper(), None, None, None), (None, body, None, "a", 1),
            (None, None, None, None, None), (3, "", "en", "a", 0), (4, "x " * 20000, "en", "b", 1), (5, "\n \n", "en", "b", 3)]
    names = ["kept", "n_lines", "n_words", "figures", "words", "term", "pos", "label", "node", "contaminated"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], schema)
    if size == "empty":
        docs = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, SF_DIR).checkpoint()
        assert sorted(docs.columns) == sorted([*("doc_id", "text", "lang", "source", "n_chars"), *names]), name
        assert all(tuple(r)[5:] == tuple(range(len(names))) for r in docs.select(
            "doc_id", "text", "lang", "source", "n_chars", *names).collect())
        assert len(docs.collect()) <= len(before)
    left = sorted((r["doc_id"] or 0) for r in docs.collect())
    # the second text is one line that the first one has: it stays, without a word
    assert left == ([] if size == "empty" else [0, 1, 2])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], pieces)
