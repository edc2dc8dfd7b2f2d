"""License scans by a positional index of rare words.

Templates are short word sequences with a label, a mandatory key phrase and the share of their weight
that must stand in place. Word weights are inverse document frequencies over the whole corpus. A template
is indexed under its rarest words only: as many as carry more weight than a match may miss, so that every
match contains one of them. A file's hits of those words are moved by the postings' places, which gives
candidate starts; the postings of the whole template are then intersected with the file's words at their
relative positions, weights are summed, and the key phrase must stand whole. All of that happens inside a
file's row: contents are read twice (frequencies, search) and never shuffled.

Defined cases: a null text has no words; repeated rows are scanned each; an empty table gives an empty
table. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.llm.common import alnum_words


class Template(NamedTuple):
    label: str
    words: str
    #: Key phrase that must stand whole (part of ``words``).
    key: str
    #: Percent of the template's weight that must stand in place.
    percent: int = 80


#: Phrases that count as mentions.
MENTIONS = [
    Template("gpl", "gnu general public license", "gnu general public license", 100),
    Template("apache", "apache license", "apache license", 100),
    Template("cc-by", "cc by", "cc by", 100),
    Template("mit", "mit license", "mit license", 100),
]
#: Sentences of license notices.
NOTICES = [
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3",
             "gnu general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2",
             "gnu general public license version 2"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             "use copy modify"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "unencumbered software"),
]


#: Added to a start, which may lie before the text, in a number of 32 bits.
_ZERO = 1 << 31


def vocabulary(templates: list[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words.split()})


def word_weights(docs: DataFrame, templates: list[Template], text: str = "text") -> dict[str, int]:
    """Weight of each template word: 1 + 1000 * ln((N + 1) / (df + 1)), rounded, over all documents.

    What reaches the driver is one row per template word, whatever the corpus holds.
    """
    words = vocabulary(templates)
    found = F.array_distinct(F.filter(alnum_words(F.col(text)), lambda w: w.isin(words)))
    # the empty word counts the documents
    rows = docs.select(F.explode(F.concat(found, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    counts = {r["w"]: r["count"] for r in rows}
    n = counts.get("", 0)
    return {w: 1 + math.floor(1000 * math.log((n + 1) / (counts.get(w, 0) + 1)) + 0.5) for w in words}


def _postings(templates: list[Template], weights: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """word -> (template, place) for the rarest words of each template that no match can miss entirely."""
    out: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        words = t.words.split()
        total = sum(weights[w] for w in words)
        gathered = 0
        for p in sorted(range(len(words)), key=lambda p: (-weights[words[p]], p)):
            out.setdefault(words[p], []).append((k, p))
            gathered += weights[words[p]]
            if gathered * 100 > total * (100 - t.percent):
                break
    return out


def _literal(xs) -> Column:
    return F.array(*[_literal(x) if isinstance(x, list) else F.lit(x) for x in xs])


def find_licenses(docs: DataFrame, templates: list[Template] | None = None, text: str = "text",
                  into: str = "licenses") -> DataFrame:
    """``docs`` plus ``into``: array of (template, label, start, score) for every match.

    ``start`` counts words from 0; ``template`` is the place in ``templates``; ``score`` the share of the
    template's weight that stands in place.
    """
    templates = MENTIONS + NOTICES if templates is None else templates
    weights = word_weights(docs, templates, text)
    keep = [c for c in docs.columns if c not in (into, "n_words")]
    postings = _postings(templates, weights)
    anchors = list(postings)
    lists = F.create_map(*[x for w in anchors for x in (F.lit(w), F.array(*[
        F.struct(F.lit(k).alias("t"), F.lit(p).alias("p")) for k, p in postings[w]]))])
    df = docs.select(*keep, alnum_words(F.col(text)).alias("__words"))
    hits = F.array_compact(F.transform("__words", lambda w, i: F.when(
        w.isin(anchors), F.struct(w.alias("w"), i.alias("i")))))
    df = df.withColumn("__hits", hits)
    # template and start in one number: Spark finds distinct numbers by hashing, distinct structs by comparing all with all
    starts = F.array_distinct(F.flatten(F.transform("__hits", lambda h: F.transform(
        F.element_at(lists, h["w"]), lambda a: F.shiftleft(a["t"].cast("long"), 32) + (h["i"] - a["p"] + F.lit(_ZERO))))))
    starts = F.transform(starts, lambda x: F.struct(
        F.shiftright(x, 32).cast("int").alias("t"), (x.bitwiseAND(F.lit((1 << 32) - 1)) - _ZERO).cast("int").alias("s")))
    df = df.withColumn("__starts", F.when(F.size("__hits") > 0, starts)).drop("__hits")

    texts = _literal([t.words.split() for t in templates])
    worth = _literal([[weights[w] for w in t.words.split()] for t in templates])
    totals = _literal([sum(weights[w] for w in t.words.split()) for t in templates])
    percents = _literal([t.percent for t in templates])
    labels = _literal([t.label for t in templates])
    keys = []
    for t in templates:
        words, key = t.words.split(), t.key.split()
        at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
        keys.append([int(at <= i < at + len(key)) for i in range(len(words))])
    needed = _literal(keys)

    def in_place(file, c, i, w):
        at = c["s"] + i
        return F.coalesce((at >= 0) & (F.get(file, at) == w), F.lit(False))

    def matched(file, c):
        here = F.get(texts, c["t"])
        gained = F.aggregate(
            F.transform(here, lambda w, i: F.when(in_place(file, c, i, w), F.get(F.get(worth, c["t"]), i)).otherwise(0)),
            F.lit(0), lambda a, x: a + x)
        key_missed = F.exists(
            F.transform(here, lambda w, i: (F.get(F.get(needed, c["t"]), i) == 1) & ~in_place(file, c, i, w)), lambda x: x)
        return F.struct(c["t"].alias("template"), F.get(labels, c["t"]).alias("label"), c["s"].alias("start"),
                        gained.alias("gained"), key_missed.alias("key_missed"))

    # the words are bound by an outer lambda: as a column they could be computed anew for every place
    df = df.withColumn("__found", F.transform(F.array("__words"), lambda file: F.transform(
        "__starts", lambda c: matched(file, c)))[0]).drop("__starts")
    full = F.filter("__found", lambda m: ~m["key_missed"] & (
        m["gained"] * 100 >= F.get(totals, m["template"]) * F.get(percents, m["template"])))
    spans = F.transform(full, lambda m: F.struct(
        m["template"], m["label"], m["start"], F.round(m["gained"] / F.get(totals, m["template"]), 6).alias("score")))
    none = F.array().cast("array<struct<template:int,label:string,start:int,score:double>>")
    return df.select(*keep, F.size("__words").cast("long").alias("n_words"),
                     F.coalesce(spans, none).alias(into))
