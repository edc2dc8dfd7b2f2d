"""The operators in DataFrame functions: against plain versions, and on awkward input."""

import time

import pytest

from codewarden.llm import chat, decontaminate, license_index, line_dedup, pii, quality_hosts
from codewarden.llm.oracle import ORACLE
from codewarden.llm.queries import QUERIES
from tests.llm.brute import base_pii, conversations, sha
from verification.compare import connect, rows_of

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, pos int, term long"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(SF_DIR).execute(ORACLE[name])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())


def docs(spark, rows):
    """Rows of (doc_id, text[, source]) with columns that clash with inner names."""
    return spark.createDataFrame(
        [(r[0], r[1], None, r[2] if len(r) > 2 else None, None, "x", 1, 2) for r in rows], DOCS)


AWKWARD = [
    "", None, "\n\n", " \t ", "a", "1.2.3.4 1.2.3.4.5.6.7.8 300.1.1.1 01.002.3.255 1.2.3", "a@b.c_d@e.f x@y@z.com a@b..c é@x.de",
    "4539 1488 0343 6467, 4539148803436467 1234567890123456", "+1 (555) 555-0100 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +1-",
    "7" * 30000, "1 " * 20000, "a." * 20000 + "@b.c", "x@" + "a." * 20000 + "b", "😀 mail: joe@example.com 😀 10.0.0.1",
    "call 212-555-0143 or (212) 555-0143, ssn 123-45-6789", "1.1.1.1 " * 1200,
]


def test_pii_base_spans_equal_the_plain_patterns(spark):
    df = docs(spark, list(enumerate(AWKWARD)) + [(1, ""), (None, "a@b.cd")])
    for r in pii.find_pii(df).collect():
        got = [(s["start"], s["kind"], s["end"], pii.KINDS[s["kind"]]) for s in r["pii"] if s["base"]]
        assert got == base_pii(r["text"])
    assert pii.find_pii(df.limit(0)).count() == 0


def test_pii_query_on_the_table(spark):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op1_weak_supervision_pii"](spark, SF_DIR).collect():
        want = [f"{k}:{s}:{e}" for s, _, e, k in base_pii(texts[r["doc_id"]])]
        assert r["base_sha256"] == sha(",".join(want))
        assert set(want) <= set(filter(None, r["spans"].split(",")))
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == len(want)


def test_pii_learns_from_votes(spark):
    good = [f"please call the phone {a}-555-0{b} today" for a in range(200, 260) for b in (100, 200)]
    bad = [f"as of order {a}-555-0{b} we know" for a in range(100, 160) for b in (100, 200)]
    mails = [f"mail joe{a}[at]example[dot]com now" for a in range(60)]
    df = docs(spark, list(enumerate(good + bad + mails)))
    found = {r["text"]: r["pii"] for r in pii.find_pii(df).collect()}
    assert all(len(found[t]) == 1 for t in good)
    assert not any(found[t] for t in bad)
    assert sum(len(found[t]) for t in mails) >= 54


def test_chat_round_trip(spark):
    hard = ["</s>", r"<\/s>", r"\\<<SYS>>", "[[INST][/INST]]", "<", "[", "\\", None, "", "a\nb</s", "/s>", "<</s>", "😀<s>"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(hard)]
    rows += [(2, 0, "system", "be brief"), *[(2, k, ("user", "assistant")[k % 2], f"word {k} " * 60) for k in range(1, 40)]]
    rows += [(3, 0, "assistant", "x " * 5000), (3, 1, "user", "y"), (3, 1, "user", "y"), (4, 0, "system", "s"),
             (5, None, None, "n"), (None, 0, "[/INST]", "z"), (6, 0, "assistant", "a"), (6, 1, "assistant", "b")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, window int")
    windows = chat.format_windows(df).cache()
    read = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    want = conversations(rows)
    assert set(read) == set(want)
    for c, (turns, loss) in want.items():
        assert [tuple(t) for t in read[c]["turns"]] == turns
        assert read[c]["loss_text"] == loss
    mine = [w for w in windows.collect() if w["conv_id"] == 2]
    assert len(mine) > 5
    for w in sorted(mine, key=lambda w: w["window"]):
        assert w["text"].startswith("<s>[INST] system [/INST]be brief</s>")
        assert len(w["text"].replace(chat.CLOSE, " ").split()) <= chat.BUDGET + 20
        assert (w["n_repeated"] > 1) == (w["window"] > 0)
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0


def test_chat_windows_keep_the_budget(spark):
    sizes = [450, 60, 400, 120, 500, 30, 508, 90, 380, 20, 470, 110, 497, 495, 100, 600, 10]
    rows = [(c, k, ("user", "assistant")[k % 2], "x " * sizes[(k + c) % len(sizes)]) for c in range(17) for k in range(1, 30)]
    rows += [(c, 0, "system", "be brief and kind") for c in range(0, 17, 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    repeated = 0
    for w in chat.format_windows(df).collect():
        turns = [t.split(chat.MIDDLE)[1] for t in w["text"].split(chat.CLOSE)[:-1]]
        tokens = sum(len(t.split()) + chat.MARKERS for t in turns)
        system = w["conv_id"] % 2 == 0
        history, new = (w["n_repeated"] - system, w["n_new"]) if w["window"] else (0, w["n_new"] - system)
        # more than the budget only where a new turn does not fit behind the system turn alone
        assert tokens <= chat.BUDGET or (new <= 1 and history == 0), (w["conv_id"], w["window"], tokens)
        repeated += history
    assert repeated > 0


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = conversations(rows)
    got = QUERIES["op8_chat_windows"](spark, SF_DIR).collect()
    assert {r["conv_id"] for r in got} == set(want)
    for r in got:
        turns, loss = want[r["conv_id"]]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


def test_line_dedup_cases(spark):
    line = "A shared line of text"
    rows = [(2, f" {line.upper()}\t\nown words here\nshort"), (1, f"{line}\n{line}\nshort"), (3, line), (3, line),
            (4, None), (5, ""), (None, line), (6, "x\n" * 50000 + line)]
    out = {(r["doc_id"], i): r for i, r in enumerate(line_dedup.drop_shared_lines(docs(spark, rows)).collect())}
    by = {}
    for (i, _), r in out.items():
        by.setdefault(i, []).append((r["text"], r["n_lines"], r["n_dropped"]))
    assert by[1] == [(f"{line}\n{line}\nshort", 3, 0)]
    assert by[2] == [("own words here\nshort", 3, 1)]
    assert by[3] == [("", 1, 1)] * 2
    assert by[4] == [(None, 1, 0)] and by[5] == [("", 1, 0)] and by[None] == [(line, 1, 0)]
    assert by[6] == [("\n".join(["x"] * 50000), 50001, 1)]
    assert line_dedup.drop_shared_lines(docs(spark, []), min_documents=3).count() == 0
    three = line_dedup.drop_shared_lines(docs(spark, rows), min_documents=5).collect()
    assert sum(r["n_dropped"] for r in three) == 0


def test_quality_cases(spark):
    clean = " ".join(f"word{k}" for k in range(60))
    rows = [(k, clean, "good") for k in range(20)] + [(100 + k, "too short", "bad") for k in range(40)]
    rows += [(200, clean, "bad"), (201, clean + " # $ % & | < > *", "bad"), (202, clean + " # $ % & | < > *", "good"),
             (300, None, None), (301, "", None), (302, "same line\nsame line\n" * 3, None), (None, "a b c d e " * 2000, None)]
    df = docs(spark, rows)
    kept = sorted(r["doc_id"] for r in quality_hosts.keep_good(df).collect())
    assert kept == [*range(20), 200, 202]
    assert quality_hosts.keep_good(df).columns == df.columns
    assert quality_hosts.keep_good(df.limit(0)).count() == 0
    f = {r["doc_id"]: r["figures"] for r in quality_hosts.text_figures(df).collect()}
    assert f[302]["n_dup_lines"] == 5 and f[302]["n_repeat_words"] == 12 and f[302]["word_chars"] == 48
    assert f[None]["n_repeat_words"] == 10000 and f[300]["n_words"] == 0


def test_license_cases(spark):
    rows = [(1, "Released under the MIT License. See the gnu general public-license; GNU GENERAL PUBLIC LICENSE"),
            (2, None), (3, ""), (4, "cc by cc by cc"), (4, "cc by cc by cc"), (5, "the of and " * 30000 + "apache license"),
            (6, "redistribution and use in source and binary forms with or without changes are permitted"),
            (None, "mit mit license")]
    got = {r["doc_id"]: r for r in license_index.find_licenses(docs(spark, rows)).collect()}
    spans = {i: sorted((m["label"], m["start"]) for m in r["licenses"]) for i, r in got.items()}
    assert spans[1] == [("gpl", 7), ("gpl", 11), ("mit", 0), ("mit", 3)]
    assert spans[4] == [("cc-by", 0), ("cc-by", 2)] and spans[2] == spans[3] == []
    assert spans[5] == [("apache", 90000)] and spans[None] == [("mit", 1)]
    assert spans[6] == [("bsd", 0)]
    assert license_index.find_licenses(docs(spark, [])).count() == 0


def test_decontamination_cases(spark):
    item = [f"w{k}" for k in range(14)]
    near = item[:4] + ["other"] + item[5:]
    rows = [(1, "pre " + " ".join(item) + " post"), (2, " ".join(near)), (3, " ".join(item[:9])), (4, None), (5, ""),
            (6, "tiny Item tiny item"), (6, "tiny Item tiny item"), (None, " ".join(item[4:])), (7, "w0 " * 30000)]
    items = spark.createDataFrame(
        [(1, " ".join(item)), (1, " ".join(item)), (2, "Tiny, item"), (3, None), (4, ""), (None, "pre")],
        "item_id long, text string")
    out = decontaminate.mark(docs(spark, rows), items).collect()
    got = {r["doc_id"]: (r["n_hit"], r["hit_items"], r["near_items"]) for r in out}
    assert len(out) == len(rows)
    # of the first window nine words stand in document 3, and of the last but one nine in the one without id
    assert got[1] == (14, ["1"], []) and got[3] == (0, [], ["1"]) and got[None] == (10, ["1"], ["1"])
    assert got[2] == (0, [], ["1"]) and got[6] == (4, ["2"], []) and got[4] == got[5] == got[7] == (0, [], [])
    clean = decontaminate.clean(docs(spark, rows), items)
    assert sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 4, 5, 7] and clean.columns == docs(spark, []).columns
    assert decontaminate.mark(docs(spark, rows), items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.mark(docs(spark, []), items).count() == 0
    assert out[0]["lang"] is None


def test_near_items_without_their_rarest_words(spark):
    item = [f"w{k}" for k in range(10)]

    def changed(*places):
        return " ".join("other" if k in places else w for k, w in enumerate(item))

    # w0, w1 and w2 occur nowhere else; w9 is the rarest of the others
    common = [(100 + k, " ".join(reversed(item[3:9]))) for k in range(20)]
    rows = [(1, changed(0)), (2, changed(0, 9)), (3, changed(0, 1)), (4, changed(0, 1, 2)), (5, changed(3, 9)), *common]
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join([*item[:4], "lacking", *item[5:]])),
                                   (3, " ".join(["none", *item[1:8]])), (4, " ".join(item[1:9] + ["none"]))], "item_id long, text string")
    got = {r["doc_id"]: (r["near_items"], r["hit_items"]) for r in decontaminate.mark(docs(spark, rows), items).collect()}
    assert got[1] == (["1", "2", "4"], []) and got[2] == (["1", "4"], [])
    assert got[3] == (["1"], []) and got[4] == ([], []) and got[5] == (["1"], [])
    assert not any(a or b for i, (a, b) in got.items() if i >= 100)


def test_licenses_of_very_many_mentions(spark):
    """Twice the mentions take about twice the time, and each is found once at its place."""
    def run(n):
        table = docs(spark, [(1, "mit license and cc by " * n)])
        begun = time.perf_counter()
        found = license_index.find_licenses(table).select("licenses").first()["licenses"]
        return time.perf_counter() - begun, sorted((m["start"], m["label"]) for m in found)

    run(100)
    run(20_000)
    short, _ = run(20_000)
    long, found = run(40_000)
    assert found == sorted([(5 * i, "mit") for i in range(40_000)] + [(5 * i + 3, "cc-by") for i in range(40_000)])
    # with the square of the mentions it would be four times
    assert long < 3 * short + 2
