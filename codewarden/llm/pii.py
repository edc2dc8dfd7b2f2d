"""Personal data by weak supervision.

Candidate spans come from patterns: strict ones, whose valid matches (checksum, number range, digit count)
always count, and loose ones. Five labelers vote on every candidate (1 personal, 0 not, -1 no opinion):
the format check, a context word before it, a gazetteer (top-level domains, card issuers, area codes), its
standing alone, and a context that speaks against it. The votes are counted per pattern of votes over the
whole corpus; expectation-maximisation on those counts estimates each labeler's reliability without any
labels, and a logistic span classifier is trained on the posteriors. It decides on the loose candidates.

Candidates, votes and scores are array expressions inside a document's row: texts are read twice and never
shuffled. What is aggregated has at most ``len(KINDS) * 3**5 * 4`` rows, whatever the corpus holds, and EM
and training work on that table.

Defined cases: a null text is empty; repeated rows are scanned each (and their votes counted each); an
empty table gives an empty table. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of the digest; the first four have strict patterns.
KINDS = ["email", "ip", "card", "phone", "ssn"]
_LOCAL = "[A-Za-z0-9._%+-]"
#: Same matches as the plain patterns, leftmost and not overlapping. Possessive groups keep the search
#: linear and off the stack; a local part is tried only at its beginning or right after a match.
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+ ?(?:\(at\)|\[at\]|\{{at\}}) ?[A-Za-z0-9-]++"
             r"(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]++){1,5}",
    "phone": r"(?<![0-9+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text with a match contains, as a cheap test before the search.
HINT = {"email": "@", "phone": "+"}
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|address|kontakt|courriel|correo)\W{0,20}$",
    "ip": r"(?i)(?:\bip\b|host|server|address|client|login)\W{0,20}$",
    "card": r"(?i)(?:card|visa|master|credit|debit|karte|carte|tarjeta|payment)\W{0,20}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|contact|telefon|whatsapp)\W{0,20}$",
    "ssn": r"(?i)(?:ssn|social security|tax id|security number)\W{0,20}$",
}
AGAINST = r"(?i)(?:version|section|chapter|table|figure|isbn|order|part|model|release|page|rfc|id)\W{0,5}$"
DOMAINS = ("com|org|net|edu|gov|io|co|de|fr|es|uk|us|it|nl|eu|ch|at|info|biz|dev|app|me|example")
GAZETTEER = {
    "email": rf"(?i)(?:\.|dot[\])}}] ?)(?:{DOMAINS})$",
    "ip": r"^(?:[1-9][0-9]?|1[0-9][0-9]|2[0-2][0-9])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\D{0,2}[2-9]|^\+",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)",
}
#: Characters looked at before a candidate.
BEFORE = 40
BLOCK = 256
LABELERS = ["format", "context", "gazetteer", "alone", "against"]


def located(text: Column, pattern: str, hint: str | None = None) -> Column:
    """Matches as array<struct<start, end, hit>>, in code points, ``end`` exclusive.

    Starts are running sums of the lengths between and of the matches, in blocks, so that a text of very
    many matches stays cheap.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if hint:
        found = F.when(F.contains(text, F.lit(hint)), found)

    def placed(hits):
        gaps = F.transform(F.split(text, pattern), lambda p: F.length(p))
        steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), F.transform(hits, lambda h: F.length(h)),
                           lambda g, n: F.struct(g.alias("g"), n.alias("n")))
        return F.transform(F.array(F.struct(hits.alias("h"), steps.alias("s"))), with_sums)[0]

    def total(xs):
        return F.aggregate(xs, F.lit(0), lambda a, x: a + x["g"] + x["n"])

    def with_sums(v):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v["s"]) - 1) / BLOCK).cast("int")),
                             lambda b: total(F.slice(v["s"], b * BLOCK + 1, F.lit(BLOCK))))
        return F.transform(F.array(F.struct(v["h"].alias("h"), v["s"].alias("s"), blocks.alias("b"))), spans)[0]

    def spans(v):
        def one(h, i):
            block = F.floor(i / BLOCK).cast("int")
            start = (F.aggregate(F.slice(v["b"], F.lit(1), block), F.lit(0), lambda a, x: a + x)
                     + total(F.slice(v["s"], block * BLOCK + 1, i - block * BLOCK)) + F.get(v["s"], i)["g"])
            return F.transform(F.array(start), lambda s: F.struct(
                s.alias("start"), (s + F.length(h)).alias("end"), h.alias("hit")))[0]

        return F.transform(v["h"], one)

    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    held = F.transform(F.array(found), lambda h: F.when(F.size(h) > 0, placed(h)))[0]
    return F.coalesce(held, none)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)

    def part(i):
        x = F.substring(number, i, F.lit(1)).cast("int") * (1 + ((n - i) % 2))
        return x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    """The format check of a kind: number range, checksum, digit count."""
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.regexp_like(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        # the length test comes first: only short digit strings reach the checksum
        d = digits(hit)
        return F.when(F.length(hit) <= 40, F.transform(F.array(d), lambda x: F.when(
            F.length(x).between(14, 19), luhn(x)).otherwise(False))[0]).otherwise(False)
    if kind == "phone":
        return F.length(digits(hit)).between(10, 15)
    return F.lit(True)


def _candidates(text: Column, kind: str) -> Column:
    """Candidates of one kind with their votes."""
    both = []
    if kind in STRICT:
        both.append(F.transform(located(text, STRICT[kind], HINT.get(kind)), lambda m: F.struct(
            m["start"], m["end"], m["hit"], valid(kind, m["hit"]).alias("base"))))
    if kind in LOOSE:
        both.append(F.transform(located(text, LOOSE[kind]), lambda m: F.struct(
            m["start"], m["end"], m["hit"], F.lit(False).alias("base"))))
    found = F.concat(*both)
    if kind not in LOOSE:
        found = F.filter(found, lambda m: m["base"])

    def voted(m):
        before = F.substring(text, F.greatest(m["start"] - BEFORE, F.lit(0)) + 1, F.least(m["start"], F.lit(BEFORE)))
        after = F.substring(text, m["end"] + 1, F.lit(1))
        alone = ~(before.rlike(r"[\p{L}\p{N}._@/-]$") | after.rlike(r"^[\p{L}\p{N}@/]"))
        yes = lambda c: F.when(c, 1).otherwise(-1)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), m["start"], m["end"], m["base"],
            F.when(m["base"], 1).otherwise(F.when(F.lit(kind in ("email", "ssn")), -1).otherwise(
                F.when(valid(kind, m["hit"]), 1).otherwise(0))).alias("format"),
            yes(before.rlike(CONTEXT[kind])).alias("context"),
            F.when(m["hit"].rlike(GAZETTEER[kind]), 1).otherwise(0).alias("gazetteer"),
            F.when(alone, 1).otherwise(0).alias("alone"),
            F.when(before.rlike(AGAINST), 0).otherwise(-1).alias("against"),
            F.least(F.floor((m["end"] - m["start"]) / 8), F.lit(3)).cast("int").alias("length"))

    return F.transform(found, voted)


def with_candidates(docs: DataFrame, text: str, into: str) -> DataFrame:
    """``docs`` plus the array of all candidates with votes."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__body", body)
    out = out.withColumns({f"__{k}": _candidates(F.col("__body"), k) for k in KINDS})
    return out.withColumn(into, F.concat(*[F.col(f"__{k}") for k in KINDS])).drop("__body", *[f"__{k}" for k in KINDS])


def reliabilities(counts: list[tuple[tuple, int]], rounds: int = 50) -> tuple[dict, dict]:
    """EM over vote patterns ``(kind, votes...) -> n``: reliabilities and posteriors.

    Two hidden classes per kind; a labeler's chance of each vote given the class is estimated together with
    the share of the class. It starts from the majority of the votes.
    """
    posterior = {}
    for pattern, _ in counts:
        votes = [v for v in pattern[1:1 + len(LABELERS)] if v >= 0]
        posterior[pattern] = (0.5 + sum(votes)) / (1 + len(votes))
    rates: dict = {}
    for _ in range(rounds):
        mass = defaultdict(lambda: 0.5)
        for pattern, n in counts:
            p = posterior[pattern]
            for j, v in enumerate(pattern[1:1 + len(LABELERS)]):
                mass[pattern[0], j, v, 1] += n * p
                mass[pattern[0], j, v, 0] += n * (1 - p)
            mass[pattern[0], "share", 1] += n * p
            mass[pattern[0], "share", 0] += n * (1 - p)
        rates = {}
        for (kind, j, *rest), m in list(mass.items()):
            if j != "share":
                v, c = rest
                rates[kind, j, v, c] = m / sum(mass[kind, j, x, c] for x in (-1, 0, 1))
            else:
                rates[kind, "share", rest[0]] = m / (mass[kind, "share", 0] + mass[kind, "share", 1])
        for pattern, _ in counts:
            logs = []
            for c in (0, 1):
                total = math.log(rates[pattern[0], "share", c])
                for j, v in enumerate(pattern[1:1 + len(LABELERS)]):
                    total += math.log(rates[pattern[0], j, v, c])
                logs.append(total)
            posterior[pattern] = 1 / (1 + math.exp(max(-500.0, min(500.0, logs[0] - logs[1]))))
    return rates, posterior


def _features(pattern: tuple) -> list[str]:
    kind, *votes, length = pattern
    return ["bias", f"kind={kind}", f"length={length}", *[f"{n}={v}" for n, v in zip(LABELERS, votes, strict=True)]]


def train(counts: list[tuple[tuple, int]], posterior: dict, rounds: int = 400, rate: float = 0.5) -> dict[str, float]:
    """Logistic regression on the posteriors, by gradient steps over the table of patterns."""
    weights: dict[str, float] = defaultdict(float)
    total = sum(math.log1p(n) for _, n in counts) or 1.0
    for _ in range(rounds):
        step: dict[str, float] = defaultdict(float)
        for pattern, n in counts:
            names = _features(pattern)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[f] for f in names)))))
            for f in names:
                # frequent patterns count more, but rare kinds are still learned
                step[f] += math.log1p(n) * (posterior[pattern] - p)
        for f, g in step.items():
            weights[f] += rate * (g / total * 4 - 0.001 * weights[f])
    return dict(weights)


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii", least: float = 0.5) -> DataFrame:
    """``docs`` plus ``into``: array of (start, kind, end, base), by start, then kind.

    ``kind`` is a place in KINDS; ``base`` tells valid strict matches from spans the classifier added.
    """
    keep = [c for c in docs.columns if c != into]
    names = ["kind", *LABELERS, "length"]
    patterns = (
        with_candidates(docs.select(text), text, "__c").select(F.explode("__c").alias("c"))
        .groupBy(*[F.col(f"c.{n}").alias(n) for n in names]).count().collect()
    )
    counts = sorted((tuple(r[n] for n in names), r["count"]) for r in patterns)
    _, posterior = reliabilities(counts)
    weights = train(counts, posterior)

    def score(c):
        def weight(name, value):
            known = [(v, weights[f"{name}={v}"]) for v in range(-1, len(KINDS)) if f"{name}={v}" in weights]
            out = F.lit(0.0)
            for v, w in known:
                out = F.when(value == v, F.lit(w)).otherwise(out)
            return out

        total = F.lit(weights.get("bias", 0.0))
        for n in names:
            total = total + weight(n, c[n])
        return 1 / (1 + F.exp(-total))

    df = with_candidates(docs.select(*keep), text, "__c")
    base = F.filter("__c", lambda c: c["base"])
    df = df.withColumn("__base", base)
    added = F.filter("__c", lambda c: ~c["base"] & (score(c) >= least) & ~F.exists(
        "__base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    spans = F.array_sort(F.transform(F.concat("__base", added), lambda c: F.struct(
        c["start"], c["kind"], c["end"], c["base"])))
    return df.select(*keep, spans.alias(into))
