"""Alignment of two tokenizers against a plain version that tokenises whole texts."""

import random
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from codewarden.llm import alignment
from codewarden.llm.queries import op11_tokenizer_alignment
from tests.llm.brute import sha

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = [
    None, "", " ", "\n", "  lead", "a  b", "a  b   c ", "x ▁ y", "<|endoftext|> <s> </s> <0x41>", "日本語 テキスト",
    "\x00 \x1c a \x1d", "é ﬁ", "'s 't I'll '", "I'LL we've", "…  …", " a 　 b", "a​ b", "x\u0085y   z", "z" * 3000,
    "日" * 3000, "\U0001F600 ́a", "aaaa aaa aa a", "the", "the the",
]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in shown}
    of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    return a, {i: bytes(of[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}, SentencePieceProcessor(
        model_file=PATHS[1])


def plain(tools, text):
    """n_a, n_b, groups as text, links"""
    a, bytes_of, b = tools
    if not text:
        return 0, 0, "", []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    pieces = [b.id_to_piece(i) for i in ids_b]
    parts = [bytes_of[i] for i in ids_a], [
        bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
    if {b"".join(p) for p in parts} != {(" " + text).encode()}:
        return 0, 0, "", []
    spans = []
    for side in parts:
        ends = list(accumulate(map(len, side)))
        spans.append([(e - len(x), e) for e, x in zip(ends, side)])
    common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    sides = [[[] for _ in common] for _ in spans]
    for ids, sp, side in zip((ids_a, ids_b), spans, sides):
        for i, (_, e) in zip(ids, sp):
            side[bisect_left(common, e)].append(str(i))
    groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*sides)]
    links, j0 = [], 0
    for i, (s, e) in zip(ids_a, spans[0]):
        while spans[1][j0][1] <= s:
            j0 += 1
        j = j0
        while j < len(spans[1]) and spans[1][j][0] < e:
            links.append((i, ids_b[j]))
            j += 1
    return len(ids_a), len(ids_b), ";".join(groups), links


def expected(tools, rows):
    found = [(i, plain(tools, t)) for i, t in rows]
    count, best = Counter(), defaultdict(int)
    for _, (_, _, _, links) in found:
        count.update(set(links))
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return sorted(((i, n_a, n_b, len(g.split(";")) if g else 0, len(links), sum(count[x] == best[x[0]] for x in links),
                    sum(count[x] for x in links), sha(g) if g else "") for i, (n_a, n_b, g, links) in found), key=str)


def prose(n):
    draw = random.Random(8)
    parts = ["the", "un", "ing", "stra", "ße", "é", "01", "Ab", ".", ",", "-", "tion", "zz", "λ", "\n", " "]
    return [" ".join("".join(draw.choices(parts, k=draw.randrange(1, 4))) for _ in range(draw.randrange(60))) for _ in range(n)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a long, block string")


def result(df):
    return sorted((tuple(r) for r in df.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()), key=str)


def test_alignment(spark, tools):
    texts = AWKWARD + prose(150)
    rows = [*enumerate(texts), (3, "the"), (None, "no id"), (None, "no id"), *[(1000 + k, "the hot, hot text") for k in range(90)]]
    got = result(alignment.align(docs(spark, rows).repartition(4), *PATHS, whole_groups=False))
    assert got == expected(tools, rows)


def test_whole_groups_and_no_rows(spark, tools):
    rows = [(1, "straße 42"), (2, "")]
    got = {r.doc_id: r.groups for r in alignment.align(docs(spark, rows), *PATHS).collect()}
    assert got == {1: plain(tools, "straße 42")[2], 2: ""}
    assert alignment.align(docs(spark, []), *PATHS).collect() == []


def test_parts_and_long_runs(tools, monkeypatch):
    texts = [t for t in AWKWARD + prose(40) if t]
    whole = alignment._Aligner(*PATHS)
    assert whole.cuts and whole.quick is not None
    want = whole.documents(texts)
    monkeypatch.setattr(alignment, "PART", 20)
    monkeypatch.setattr(alignment, "LONG_RUN", 3)
    got = whole.documents(texts)
    assert (got[0] == want[0]).all() and got[1] == want[1]
    for (v, n), (w, m) in zip(got[2], want[2], strict=True):
        assert v.tolist() == w.tolist() and n.tolist() == m.tolist()


def test_query_on_given_table(spark, tools):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op11_tokenizer_alignment(spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(tools, rows)
