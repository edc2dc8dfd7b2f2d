"""Packing, Jaccard join, language model and repeats against plain versions, and on awkward input."""

import math
import random
from collections import Counter

import public_tokenizers

from codewarden.llm import jaccard, packing, pitman_yor, repeats
from tests.llm.brute import LOWER, WHITE, held_out, linked, passage_words, shingles
from tests.llm.brute import repeats as plain_repeats
from tests.llm.test_pipeline import check_packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [
    "", None, " ", "a", "two words", "<|endoftext|> <|ENDOFTEXT|>X<|startoftext|>", "It's ÉCOLE straße ﬁn É é İ Σας 42.5, ...",
    "x\x1cy z w | a|b ||", "\x00\x01 tab\tvt\x0bff\x0c", "word " * 3000, "é" * 5000, "ab" * 1500, "z" * 3000,
]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n long, tag long")


def copies():
    """Chains of near copies around some texts, exact copies, and texts that share little."""
    draw = random.Random(5)
    rows = []
    for g in range(4):
        base = [f"g{g}w{draw.randrange(400)}" for _ in range(120)]
        for _ in range(25):
            words = list(base)
            for _ in range(draw.randrange(5)):
                words[draw.randrange(len(words))] = f"m{draw.randrange(6)}"
            rows.append(" ".join(words))
            if draw.random() < 0.3:
                base = words
    return list(enumerate(rows + rows[:10] + AWKWARD))


def test_packing(spark):
    rows = [*enumerate(AWKWARD), (3, "a"), (None, "no id")]
    sequences, bound = check_packing(rows, packing.pack(docs(spark, rows), TOKENIZER).collect())
    assert sequences <= bound + 1
    assert packing.pack(docs(spark, []), TOKENIZER).count() == 0


def test_plan_uses_every_piece():
    draw = random.Random(3)
    for capacity in (16, 64):
        counts = Counter(draw.randint(1, capacity) for _ in range(800))
        used = Counter()
        patterns = packing.plan(dict(counts), capacity)
        for lengths, n in patterns:
            assert sum(lengths) <= capacity
            used.update({x: n * k for x, k in Counter(lengths).items()})
        assert used == counts
        assert sum(n for _, n in patterns) <= 1.03 * sum(x * n for x, n in counts.items()) / capacity + 1


def test_jaccard_join(spark):
    rows = copies()
    for words, percent in ((4, 85), (5, 80)):
        found = jaccard.join_similar(docs(spark, rows), words=words, percent=percent).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == linked(rows, words, percent)
    extra = docs(spark, [*rows, (None, rows[0][1]), (0, rows[0][1])])
    kept = [r["doc_id"] for r in jaccard.keep_one(extra, words=4, percent=85).collect()]
    assert sorted(kept, key=str) == sorted([None, *{c for _, c in linked(rows, 4, 85).values()}], key=str)
    assert jaccard.join_similar(docs(spark, [])).count() == 0


def test_jaccard_links_are_all_counted(spark):
    rows = copies()
    sets = {i: shingles(t, 4) for i, t in rows}
    want = dict.fromkeys(sets, 0)
    for a, x in sets.items():
        for b, y in sets.items():
            if a != b and x and y and 100 * len(x & y) >= 85 * len(x | y):
                want[a] += 1
    found = jaccard.join_similar(docs(spark, [*rows, (None, rows[0][1])]), words=4, percent=85).collect()
    assert {r["doc_id"]: r["n_links"] for r in found} == want | {None: 0}


def test_keep_one_judges_each_text_of_an_id(spark):
    text = {k: " ".join(f"{k}{j}" for j in range(60)) for k in "abc"}
    rows = [(1, text["a"]), (2, text["a"] + " more"), (2, text["b"]), (2, text["b"]), (3, text["b"] + " more"), (3, text["c"]),
            (3, None), (None, text["a"])]
    kept = jaccard.keep_one(docs(spark, rows), words=4, percent=85).collect()
    want = [(1, text["a"]), (2, text["b"]), (3, text["c"]), (3, None), (None, text["a"])]
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(want, key=str)


def test_language_model(spark):
    rows = [*copies(), (None, "no id")]
    tokens = {i: [*WHITE.findall((t or "").translate(LOWER)), None] for i, t in rows}
    counts = Counter(w for i, ws in tokens.items() if i is not None and not held_out(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    found = {r["doc_id"]: r for r in pitman_yor.score_texts(docs(spark, rows)).collect()}
    assert len(found) == len(rows)
    for i, ws in tokens.items():
        r = found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["held_out"] == (i is None or held_out(i))
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
    out = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    twice = [r for r in pitman_yor.score_texts(docs(spark, [(1, "a b"), (1, "a b"), (1, "c")])).collect()]
    assert sorted(r["n_tokens"] for r in twice) == [2, 3, 3]
    assert pitman_yor.score_texts(docs(spark, [])).count() == 0


def test_language_model_is_the_same_in_any_number_of_fragments(spark):
    # pairs that come often, in contexts with one follower and with many
    rows = [(i, f"{t} " + "only follower " * 40 + f"the w{i} the w{i % 7} of w{i}") for i, t in copies()]
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in (1, 5, 24):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found.append({r["doc_id"]: r["score"] for r in pitman_yor.score_texts(docs(spark, rows)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for other in found[1:]:
        assert all(math.isclose(s, other[i], rel_tol=1e-9) for i, s in found[0].items())


def test_repeats(spark):
    draw = random.Random(9)
    shared = "".join(draw.choice("abcd é") for _ in range(700))
    rows = [(k, "".join(draw.choice("wxyz") for _ in range(draw.randrange(80))) + shared[a:a + n]
             + "".join(draw.choice("wxyz") for _ in range(draw.randrange(80))))
            for k, (a, n) in enumerate((draw.randrange(300), draw.randrange(500)) for _ in range(60))]
    rows += [(100 + k, t) for k, t in enumerate(AWKWARD)]
    for size in (100, 400):
        want = plain_repeats(rows, size)
        for r in repeats.remove_repeats(docs(spark, rows), size=size).collect():
            removed = sum(s["end"] - s["start"] for s in r["spans"])
            assert (r["n_bytes"], removed, len(r["spans"]), bytes(r["kept"])) == want[r["doc_id"]]
    same = repeats.remove_repeats(docs(spark, [(1, shared), (1, shared), (None, "q" * 99)])).collect()
    assert sorted(len(r["kept"]) for r in same) == [0, 0, 99]
    assert repeats.remove_repeats(docs(spark, [])).count() == 0


def test_passages_that_other_documents_have(spark):
    draw = random.Random(12)
    own = (f"own{k}" for k in range(10**6))

    def words(n):
        return [next(own) for _ in range(n)]

    # of few bytes: below the 400 that are removed
    passages = [[draw.choice("abcdefg") + str(draw.randrange(9)) for _ in range(n)] for n in (51, 52, 58, 70, 130)]
    texts = [words(draw.randrange(40)) + p + words(draw.randrange(40)) for p in passages for _ in range(4)]
    # a passage cut at either end, or with a word changed; one that only its own document has, whole and cut
    long = passages[-1]
    texts += [words(3) + long[a:b] + words(3) for a, b in ((0, 50), (0, 51), (40, 97), (10, 61), (79, 130), (81, 130))]
    texts += [[*long[:k], "other", *long[k + 1:]] for k in (50, 51, 65, 79, 80)]
    twice = words(60)
    texts += [twice + words(2) + twice + words(2) + twice[3:56], words(200), passages[2] + words(1) + passages[2][1:]]
    joined = [draw.choice((" ", "\n", " \t")).join(t) for t in texts]
    rows = list(enumerate([*joined, "", None, " ", "é" * 3000, "z " * 60, "z " * 50]))
    want = passage_words(rows, 51)
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs(spark, rows)).collect()}
    assert {i: sum(s["end"] - s["start"] for s in r["passages"]) for i, r in got.items()} == want
    assert all(want[i] >= 51 and not got[i]["spans"] for i in range(12)) and sum(w > 0 for w in want.values()) < len(rows) - 8
    assert passage_words(rows, 24) == {
        r["doc_id"]: sum(s["end"] - s["start"] for s in r["passages"])
        for r in repeats.remove_repeats(docs(spark, rows), words=24).collect()}
    # rows of one id are documents of their own
    same = repeats.remove_repeats(docs(spark, [(1, " ".join(twice)), (1, " ".join(twice)), (None, "q " * 99)])).collect()
    assert sorted(sum(s["end"] - s["start"] for s in r["passages"]) for r in same) == [0, 60, 60]


def test_rows_of_one_id_are_scored_apart(spark):
    training = [i for i in range(60) if not held_out(i)]
    unseen = [i for i in range(400) if held_out(i)]
    texts = ["a b c d a b c d", "d c b a d c b a", "b a c d a b c d", "a b c d a b c d"]
    rows = [(i, "a b c d a b c d e f") for i in training]
    alone = {r.doc_id: r.score for r in pitman_yor.score_texts(docs(spark, rows + list(zip(unseen, texts)))).collect()}
    want = sorted(alone[i] for i in unseen[:4])
    for shared in (None, unseen[0]):
        got = pitman_yor.score_texts(docs(spark, rows + [(shared, t) for t in texts])).where("held_out").collect()
        scores = sorted(r.score for r in got if r.doc_id == shared)
        assert len(scores) == 4 and all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(scores, want))
    assert want[0] < want[-1] - 5


def test_links_below_half(spark):
    shared = " ".join(f"s{k}" for k in range(90))
    rows = [(k, " ".join([*(f"x{k}_{j}" for j in range(55)), shared, *(f"y{k}_{j}" for j in range(55))])) for k in range(3)]
    found = jaccard.join_similar(docs(spark, rows), words=5, percent=25).collect()
    assert {(r.doc_id, r.component_id, r.n_links) for r in found} == {(0, 0, 2), (1, 0, 2), (2, 0, 2)}
    assert {r.component_id for r in jaccard.join_similar(docs(spark, rows), words=5, percent=30).collect()} == {0, 1, 2}


def test_links_over_several_tiles():
    draw = random.Random(8)
    import numpy as np

    fragments = jaccard.PAIR_FRAGMENTS
    sets = [sorted(draw.sample(range(-2**62, 2**62, 2**55), 90)) for _ in range(40)]
    cut = [[np.array([g for g in s if ((g % 2**64) >> 61) == f], dtype=np.int64) for f in range(fragments)] for s in sets]
    got = jaccard._overlaps(cut[:15], cut[15:])
    for i, a in enumerate(sets[:15]):
        for j, b in enumerate(sets[15:]):
            assert got[i, j] == len(set(a) & set(b))


def test_many_near_copies_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_SETS", 7)
    rows = copies()
    want = linked(rows, 4, 85)
    sets = {i: shingles(t, 4) for i, t in rows}
    for r in jaccard.join_similar(docs(spark, rows), words=4, percent=85).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        near = sum(1 for j, s in sets.items() if j != r.doc_id and s and sets[r.doc_id]
                   and 100 * len(s & sets[r.doc_id]) >= 85 * len(s | sets[r.doc_id]))
        assert r.n_links == near
