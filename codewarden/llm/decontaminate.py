"""Benchmark decontamination by a positional inverted index.

The training side's index holds a posting (term, document, position) for every occurrence of a term of
the benchmark; it is written to shared storage once. A window of an item that may miss m words is looked up
through its m + 2 rarest places, terms that occur nowhere counting as the rarest: any match has two of them in
place. Their postings, moved by their place in the item, give (document, item, offset) candidates, and only where
two meet are the lists of the item's other terms intersected, at their relative
positions. Exact windows mark the words they cover; windows with most words in place are proximity
matches and are reported apart.

The vocabulary, the anchors and the items are broadcast only when counted small, else joined by a
shuffle; postings and candidates are rows, so a passage or a term that many documents share is spread
over many tasks. Texts move once, to their candidates.

Defined cases: a null text has no words; items without words, or without an id, match nothing; repeated
items count once; repeated documents are judged each; empty tables give empty results, an empty benchmark
gives clean documents. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm.common import alnum_words, left_join, saved, set_aside, sized, stored

WINDOW = 10
#: Words of a window that must stand in place for a proximity match.
NEAR = 8
OUTPUTS = ["n_words", "n_hit", "hit_items", "near_items", "hit_spans", "contaminated"]


def benchmark_items(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct items with words: __item (row key), item_id, __terms."""
    words = items.where(F.col(item_id).isNotNull()).select(
        F.col(item_id).alias("item_id"), alnum_words(F.col(text)).alias("__terms"))
    words = words.where(F.size("__terms") > 0).distinct()
    return saved(words.select(F.xxhash64("item_id", "__terms").alias("__item"), "item_id", "__terms"))


def build_index(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (doc_id, __text, pos, term) of the items' terms; ``__text`` tells rows of one id apart."""
    terms = saved(items.select(F.explode(F.transform("__terms", lambda w: F.xxhash64(w))).alias("term")).distinct())
    tokens = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("__text"),
        F.posexplode(F.transform(alnum_words(F.col(text)), lambda w: F.xxhash64(w))).alias("pos", "term"))
    return stored(tokens.join(sized(terms), "term").select("doc_id", "__text", "pos", "term"), "postings")


def rarest_terms(items: DataFrame, postings: DataFrame, window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """The rarest places of the items' windows that have postings: distinct (__item, at, term, need).

    A window of n words that matches with m of them out of place has ``need`` of its m + ``need`` rarest
    places in place; places of terms that occur nowhere are the rarest.
    """
    counts = saved(postings.groupBy("term").agg(F.count("*").alias("n")))
    placed = items.select("__item", F.posexplode(F.transform("__terms", lambda w: F.xxhash64(w))).alias("at", "term"))
    listed = placed.join(sized(counts), "term", "left").groupBy("__item").agg(F.sort_array(F.collect_list(F.struct(
        "at", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("__have"))
    size = F.least(F.lit(window), F.size("__have"))
    windows = listed.select("__item", "__have", size.alias("__window"), F.explode(
        F.sequence(F.lit(0), F.size("__have") - size)).alias("__from"))
    missed = F.greatest(F.col("__window") - near, F.lit(0))
    need = F.least(F.lit(2), F.col("__window") - missed)
    places = F.array_sort(F.transform(F.slice("__have", F.col("__from") + 1, F.col("__window")), lambda x: F.struct(
        x["n"].alias("n"), x["at"].alias("at"), x["term"].alias("term"))))
    rare = windows.select("__item", need.alias("need"), F.explode(F.slice(places, F.lit(1), missed + need)).alias("r"))
    return saved(rare.where("r.n > 0").select(
        "__item", F.col("r.at").alias("at"), F.col("r.term").alias("term"), "need").distinct())


def mark(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """``docs`` plus n_words, n_hit, hit_items (ids), near_items, hit_spans and contaminated.

    ``hit_spans`` lists the covered words as (start, end) word numbers, one per exact window.
    """
    keep = [c for c in docs.columns if c not in OUTPUTS]
    chosen = benchmark_items(items, item_id, item_text)
    postings = build_index(docs, chosen, doc_id, text)
    anchors = rarest_terms(chosen, postings, window, near)
    # repeated documents have the same postings, and places are counted once
    met = postings.join(sized(anchors), "term").groupBy(
        "doc_id", "__text", "__item", (F.col("pos") - F.col("at")).alias("shift"))
    candidates = met.agg(F.min("at").alias("low"), F.max("at").alias("high"), F.max("need").alias("need")).where(
        "need < 2 or low < high").select("doc_id", "__text", "__item", "shift")
    lists = (
        candidates.join(sized(chosen), "__item")
        .groupBy(F.col("doc_id").alias(doc_id), "__text")
        .agg(F.collect_list(F.struct("item_id", "__terms", "shift")).alias("__candidates"))
    )
    rows = left_join(docs.select(*keep, F.xxhash64(text).alias("__text")), lists, [doc_id, "__text"])
    rows = rows.drop("__text")

    def judged(words, c):
        # in place: the item's terms against the document's words, both at their own positions
        return F.struct(c["item_id"], c["shift"], F.transform(c["__terms"], lambda w, i: F.coalesce(
            (c["shift"] + i >= 0) & (F.get(words, c["shift"] + i) == w), F.lit(False)).cast("int")).alias("hit"))

    def summed(c):
        size = F.least(F.lit(window), F.size(c["hit"]))
        counts = F.transform(F.sequence(F.lit(0), F.size(c["hit"]) - size), lambda s: F.struct(
            s.alias("s"), F.aggregate(F.slice(c["hit"], s + 1, size), F.lit(0), lambda a, x: a + x).alias("n")))
        return F.struct(
            c["item_id"], (F.filter(counts, lambda x: x["n"] == size)).alias("exact"), size.alias("size"),
            c["shift"], F.exists(counts, lambda x: (x["n"] >= near) & (x["n"] < size)).alias("near"))

    # the words are bound by an outer lambda: as a column they could be computed anew for every place
    words = F.array(alnum_words(F.col(text)))
    rows = rows.withColumn("__judged", F.transform(words, lambda ws: F.struct(
        F.size(ws).alias("n"), F.transform("__candidates", lambda c: judged(ws, c)).alias("found")))[0]).drop("__candidates")
    rows = rows.withColumn("__found", F.transform("__judged.found", summed))
    spans = F.flatten(F.transform("__found", lambda c: F.transform(c["exact"], lambda x: F.struct(
        (c["shift"] + x["s"]).alias("start"), (c["shift"] + x["s"] + c["size"]).alias("end")))))
    rows = rows.select(
        *keep, F.col("__judged.n").cast("long").alias("n_words"),
        F.coalesce(F.array_sort(F.array_distinct(spans)), F.array().cast("array<struct<start:int,end:int>>"))
        .alias("hit_spans"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform(
            F.filter("__found", lambda c: F.size(c["exact"]) > 0), lambda c: c["item_id"].cast("string")))),
            F.array().cast("array<string>")).alias("hit_items"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform(
            F.filter("__found", lambda c: c["near"]), lambda c: c["item_id"].cast("string")))),
            F.array().cast("array<string>")).alias("near_items"))
    # spans are sorted by start and no longer than a window, so a word is new from the last end on
    ends = F.transform("hit_spans", lambda x, k: F.struct(
        x["start"].alias("a"), x["end"].alias("b"), F.coalesce(F.get("hit_spans", k - 1)["end"], F.lit(0)).alias("z")))
    rows = rows.withColumn("__ends", ends)
    n_hit = F.aggregate("__ends", F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")), lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(a["last"], x["a"]))).alias("n"),
        F.greatest(a["last"], x["b"]).alias("last")))["n"]
    return rows.select(*keep, "n_words", n_hit.cast("long").alias("n_hit"), "hit_items", "near_items", "hit_spans",
                       (F.size("hit_spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """The documents without an exact window of the benchmark, with their own columns."""
    docs, columns, own = set_aside(docs, OUTPUTS)
    row = F.struct(*[F.col(c) for c in columns])
    kept = F.when(~F.col("contaminated"), F.array(row))
    return mark(docs, items, **names).select(F.inline(kept)).select(*own)
