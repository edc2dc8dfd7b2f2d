"""Regular expressions with line and column positions, as native SQL expressions.

Patterns are written in the usual ``\\s`` / ``.`` notation and translated by :func:`js` to explicit
character classes, so that whitespace and line ends mean the same thing in Java's regex engine, in RE2
and in the source language of the analysed files (Unicode spaces included).
"""

from __future__ import annotations

import re

from codewarden.functions.sql import let, q, struct, transform

SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
NOT_LINE_END = r"[^\n\r\x{2028}-\x{2029}]"
ANY = r"(?s:.)"

_TOKEN = re.compile(r"\[\\s\\S\]|\\.|\[[^\]]*\]|\.")
_HITS = "array<struct<text:string,line:int,col:int>>"
NO_HITS = f"cast(array() AS {_HITS})"

#: Matches handled per block when positions are accumulated (see ``_positions``).
BLOCK = 512


def js(pattern: str, ignore_case: bool = False) -> str:
    """Spell out ``\\s``, ``.`` and ``[\\s\\S]`` so that every engine reads them alike."""
    spelled = {r"[\s\S]": ANY, r"\s": SPACE, ".": NOT_LINE_END}
    out = _TOKEN.sub(lambda m: spelled.get(m.group(0), m.group(0)), pattern)
    return f"(?i){out}" if ignore_case else out


def starting(letters: str, pattern: str) -> str:
    """Say which letters a pattern that begins with alternatives can start with; see :func:`quick`."""
    return f"(?=[{letters}]){pattern}"


def _one_of(*words: str) -> str:
    return "|".join(f"(?<={w[0]}){w[1:]}" for w in words)


def quick(pattern: str) -> str:
    """A pattern made by :func:`starting` as it is searched; other patterns as they are.

    Java tries every alternative at every character, and a look-ahead costs about as much. A letter class that is
    matched first, and what the letter was behind it, is several times faster and matches the same.
    """
    head = re.match(r"\(\?=(\[[a-z]+\])\)", pattern)
    if head is None:
        return pattern
    # the leading group's words lose their first letter, which the class has matched
    out = pattern[head.end():]
    for words in (("let", "const", "var"), ("const", "let"), ("function",)):
        out = out.replace(f"(?:{'|'.join(words)}", f"(?:{_one_of(*words)}", 1)
    return head.group(1) + out


def contains(text: str, literal: str) -> str:
    return f"contains({text}, {q(literal)})"


#: Characters that are frequent in prose, the most frequent first; others are rarer.
_FREQUENT = " etaoinshrdlucmwfgypbvk"


def _rare_end(literal: str) -> str:
    """The end of a literal, of three characters at least, that begins with its rarest character."""
    ends = [literal[k:] for k in range(max(len(literal) - 2, 1))]
    return max(ends, key=lambda e: _FREQUENT.index(e[0]) if e[0] in _FREQUENT else len(_FREQUENT))


def may_contain(text: str, literals) -> str:
    """A cheap condition that holds for every text with all the literals, and for few others.

    Where a literal's first character is frequent the search stops at each of them, so the end behind a rarer one is
    looked for; the literals with the rarest come first.
    """
    ends = sorted({_rare_end(x) for x in literals}, key=lambda e: -(_FREQUENT.find(e[0]) % (len(_FREQUENT) + 1)))
    return " AND ".join(contains(text, x) for x in ends)


def matches(text: str, pattern: str) -> str:
    return f"({text} RLIKE {q(pattern)})"


def called(key: str, then: str = "") -> str:
    """``key\\s*\\([^)]*\\)`` followed by ``then``, found in one pass over the text.

    A search from every ``key(`` walks to the same closing parenthesis again and again. Here the stretch since
    the parenthesis before is walked once, and of the ``key(`` in it the first one stands for all.
    """
    return rf"(?<![^)])(?>[^)]*?{key}\s*\()[^)]*+\){then}"


def in_order(text: str, parts) -> str:
    """Whether matches of all patterns stand behind each other: the first of the first, then on from its end."""
    first, *rest = parts
    if not rest:
        return matches(text, js(first))
    behind = f"get(split({text}, {q(js(first))}, 2), 1)"
    return let(behind, lambda b: f"({b} IS NOT NULL AND {in_order(b, rest)})")


def upto_last(text: str, literal: str, extra: int = 0) -> str:
    """Text up to and including the last ``literal`` (plus ``extra`` characters); '' without one."""
    rest = f"length(substring_index({text}, {q(literal)}, -1))"
    return f"if({contains(text, literal)}, left({text}, length({text}) - {rest} + {extra}), '')"


def upto_close_after(text: str, literal: str, close: str = "*/") -> str:
    """Text up to the first ``close`` that follows the last ``literal`` having one."""

    def cut(closed):
        tail = f"substring_index({closed}, {q(literal)}, -1)"
        end = f"length({closed}) - length({tail}) + locate({q(close)}, {tail}) + {len(close) - 1}"
        return f"if({contains(closed, literal)}, left({closed}, {end}), '')"

    return let(upto_last(text, close), cut)


def newlines(text: str) -> str:
    # a line feed is one byte, and byte lengths are known without walking through the text
    return f"(octet_length({text}) - octet_length(replace({text}, '\\n', '')))"


def _then(a: str, b: str) -> str:
    return struct(nl=f"{a}.nl + {b}.nl", tail=f"if({b}.nl > 0, {b}.tail, {a}.tail + {b}.tail)")


_ORIGIN = struct(nl="0", tail="0")


def _scan(marks: str, start: str) -> str:
    """Running cursor of a block of marks."""
    seed = struct(out="cast(array() AS array<struct<nl:int,tail:int>>)", at=start)
    moved = let(_then("acc.at", "mark"), lambda at: struct(out=f"concat(acc.out, array({at}))", at=at))
    return f"aggregate({marks}, {seed}, (acc, mark) -> {moved}, acc -> acc.out)"


def _positions(chunks: str) -> str:
    """Running cursor after each chunk.

    Appending to one array per match copies it every time, which is quadratic in the matches of a file.
    Cursor moves are associative, so blocks are summed first and then expanded from their start: the
    copying stays within a block and a file with a million matches is still fine.
    """
    marks = transform(
        chunks, lambda c: struct(nl=newlines(c), tail=f"length(substring_index({c}, '\\n', -1))")
    )
    blocks = let(marks, lambda m: transform(
        f"sequence(0, cast(floor((size({m}) - 1) / {BLOCK}) AS int))",
        lambda b: f"slice({m}, {b} * {BLOCK} + 1, {BLOCK})",
    ))

    def expand(bs):
        sums = transform(bs, lambda b: f"aggregate({b}, {_ORIGIN}, (acc, mark) -> {_then('acc', 'mark')})")
        starts = f"concat(array({_ORIGIN}), {_scan(sums, _ORIGIN)})"
        return f"flatten(zip_with({bs}, slice({starts}, 1, size({bs})), (b, s) -> {_scan('b', 's')}))"

    return let(blocks, expand)


def all_hits(text: str, specs) -> str:
    """Matches of several patterns with 1-based ``line`` and ``col``: array<array<struct<text,line,col>>>.

    Each spec is (pattern, gate, scope, whole). ``gate`` is a cheap condition without which the pattern cannot
    match, '' for none. ``scope`` is a prefix of ``text`` known to hold every match
    (see the ``upto_*`` cuts); it keeps lazy patterns linear when their closing part is missing.
    ``whole``, if given, is the pattern that counts; ``pattern`` then also matches where it fails, up to where it
    can be tried again, so that no stretch is walked twice.

    The position arithmetic is one expression applied to all patterns, which keeps plans small.
    """

    def find(pattern, gate, scope, whole=None):
        pattern = quick(pattern)
        good = lambda found: "cast(NULL AS array<boolean>)" if whole is None else transform(found, lambda t: matches(t, _all(whole)))

        def split(body):
            return let(
                f"regexp_extract_all({body}, {q(pattern)}, 0)",
                lambda found: f"if(size({found}) > 0, "
                f"{struct(texts=found, pieces=f'split({body}, {q(pattern)}, -1)', good=good(found))}, NULL)",
            )

        out = split(text) if scope is None else let(scope, split)
        return f"if({gate}, {out}, NULL)" if gate else out

    def place(found):
        texts, pieces = f"{found}.texts", f"{found}.pieces"
        chunks = (
            f"zip_with(concat(array(''), slice({texts}, 1, size({texts}) - 1)), "
            f"slice({pieces}, 1, size({texts})), (a, b) -> concat(a, b))"
        )
        placed = struct(text="t", line="p.nl + 1", col="p.tail + 1")
        hits = f"zip_with({texts}, {_positions(chunks)}, (t, p) -> {placed})"
        kept = f"filter({hits}, (h, i) -> {found}.good IS NULL OR get({found}.good, i))"
        return f"if({found} IS NULL, {NO_HITS}, {kept})"

    found = [find(*spec) for spec in specs]
    return transform(f"array({', '.join(found)})", place)


def _all(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def hits(text: str, pattern: str, gate: str = "", scope: str | None = None, whole: str | None = None) -> str:
    """All matches of one pattern: array<struct<text,line,col>>."""
    return f"get({all_hits(text, [(pattern, gate, scope, whole)])}, 0)"


def count(text: str, pattern: str, gate: str = "", scope: str | None = None, whole: str | None = None) -> str:
    """Number of matches, without their positions; see :func:`all_hits`."""
    body, pattern = text if scope is None else scope, quick(pattern)
    n = f"regexp_count({body}, {q(pattern)})"
    if whole is not None:
        n = f"size(filter(regexp_extract_all({body}, {q(pattern)}, 0), t -> {matches('t', _all(whole))}))"
    return f"if({gate}, {n}, 0)" if gate else n


def group(text: str, pattern: str, *indexes: int) -> str:
    """First non-empty capture group of a match text."""
    parts = [f"nullif(regexp_extract({text}, {q(pattern)}, {i}), '')" for i in indexes]
    return f"coalesce({', '.join(parts)})" if len(parts) > 1 else parts[0]
