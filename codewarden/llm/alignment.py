"""Alignment of two tokenizers: A byte-level BPE, B SentencePiece BPE with byte fallback.

A text's bytes are a blank and the text; both tokenizers' tokens cover them. Offsets where tokens of both
end cut them into groups. Two tokens are linked where their bytes overlap, and a pair of ids counts once for
each document that holds it linked.

Most groups are one token of A and the token of B with the same bytes. Which token of B that is, is looked
up before (``same``, an array over A's ids). Such links need no pair: a document's ids of A so linked are
added to a vector as long as A's vocabulary, and vectors are summed. All other links travel as pairs of
ids, summed per block of documents before they are shuffled. A pair equal to the identity that
stands in an irregular group is counted in the vector, too.

How it is spread. The first pass tokenises each text once and writes the document's figures and distinct
links, and per block of about BLOCK_BYTES of text the block's vector and pairs. Texts of more than PART
characters are tokenised in parts, cut before a single blank between other characters, which neither
tokenizer joins (whether the files at hand allow it is checked when they are opened). Sums over blocks are at most one row per pair and block, so a pair
that a third of all documents hold is no hot key. The sums go back to the blocks that asked, and each
block's documents look theirs up. Only the vectors of A's vocabulary (identity counts, highest count of each
id) pass the driver: some 50,000 numbers each, whatever the corpus.

Defined cases: a null or empty text, and a text whose bytes one of the tokenizers changes, has no tokens,
zeros and an empty ``groups``; a null id stays null; repeated rows are documents of their own; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from codewarden.llm.common import on_workers, stored
from codewarden.llm.wordhash import slices

#: Bytes of text whose links are put together before they are shuffled.
BLOCK_BYTES = 16_000_000
SLICE_BYTES = 2_000_000
#: Characters of a text that are tokenised at once, and of an unbroken run that the quick tokenizer gets.
PART = 500_000
LONG_RUN = 1_000
#: Parts of A's vocabulary whose counts are summed apart.
PARTS = 8
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: What byte-level BPE splits a text by.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that byte-level BPE shows as themselves; the others are moved up, in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(256 + k): b for k, b in enumerate(_HIDDEN)}
_state: dict = {}


class _Aligner:
    """Both tokenizers, their tokens' bytes, and the token of B with the same bytes as each of A."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(_BYTE_OF[c] for c in token) if all(c in _BYTE_OF for c in token) else token.encode()
        self.bytes_b, pieces, single = [], {}, {}
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("\u2581", " ").encode())
            if self.b.is_byte(i):
                single[self.bytes_b[-1]] = i
            elif not (self.b.is_control(i) or self.b.is_unknown(i)):
                pieces[self.bytes_b[-1]] = i
        self.same = np.array([pieces.get(x, single.get(x, -1)) for x in self.bytes_a], dtype=np.int64)
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        #: Texts of ids with what may follow: another id, the other side, the next group.
        n = max(len(self.bytes_a), len(self.bytes_b))
        self.shown = [f"{i}{mark}" for mark in ",|;" for i in range(n)]
        made = json.loads(self.a.to_str())
        split = made["pre_tokenizer"] or {}
        plain = made["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split["add_prefix_space"]
        # a long text may be cut if A's splitter parts it there and no token of B holds a blank behind another character
        self.cuts = bool(plain) and not any(b" " in x.lstrip(b" ") for x in self.bytes_b)
        self.quick = _quick(made["model"], self.bytes_a) if plain else None

    def ids_a(self, wholes: list[str]) -> list[list[int]]:
        if self.quick is None:
            return [self.a.encode(w, add_special_tokens=False).ids for w in wholes]
        # the quick one takes time by the square of an unbroken run
        return [self.quick.encode_ordinary(w) if max(map(len, w.split(" "))) <= LONG_RUN
                else self.a.encode(w, add_special_tokens=False).ids for w in wholes]

    def parts(self, text: str) -> list[str]:
        """A blank and the text, cut into parts of about PART characters that begin with a blank."""
        whole, out, start = f" {text}", [], 0
        while self.cuts and len(whole) - start > PART:
            cut = _CUT.search(whole, start + PART)
            if cut is None:
                break
            out.append(whole[start:cut.start()])
            start = cut.start()
        return [*out, whole[start:]]

    def align(self, wholes: list[str]) -> tuple[np.ndarray, list[str], list[np.ndarray], np.ndarray]:
        """Of texts that begin with a blank: n_a, n_b, n_groups and n_links, groups, links (a * 2**32 + b),
        and whether both tokenizers' tokens give back the text's bytes; all others have nothing."""
        out = np.zeros((len(wholes), 4), dtype=np.int64), [""] * len(wholes), [np.zeros(0, np.int64)] * len(wholes)
        all_a, all_b = self.ids_a(wholes), self.b.encode([w[1:] for w in wholes], num_threads=1)
        good = np.array([
            b"".join(map(self.bytes_a.__getitem__, x)) == (data := w.encode()) == b"".join(map(self.bytes_b.__getitem__, y))
            for w, x, y in zip(wholes, all_a, all_b, strict=True)], dtype=bool)
        rows = np.flatnonzero(good)
        if not len(rows):
            return *out, good
        n_a, n_b = (np.array([len(x[k]) for k in rows]) for x in (all_a, all_b))
        a, b = (np.fromiter(chain.from_iterable(x[k] for k in rows), np.int64, n.sum()) for x, n in ((all_a, n_a), (all_b, n_b)))
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        # offsets run on over all texts, whose ends are ends of groups
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        n_groups = np.diff(np.r_[0, np.searchsorted(common, end_a[last_a - 1]) + 1])
        # a token of A is linked with the tokens of B from the first that ends behind its beginning
        first = np.searchsorted(end_b, end_a - self.size_a[a], "right")
        n = np.searchsorted(end_b, end_a, "left") - first + 1
        ends = np.cumsum(n)
        partner = np.repeat(first - (ends - n), n) + np.arange(ends[-1])
        links = np.repeat(a, n) * 2**32 + b[partner]
        link_ends = ends[last_a - 1]
        # all ids in the order of the groups, A's before B's
        key = np.concatenate([group_a * 2, group_b * 2 + 1])
        order = np.argsort(key, kind="stable")
        key = key[order]
        mark = np.where(np.r_[key[1:] != key[:-1], True], 1 + key % 2, 0)
        shown = (mark * (len(self.shown) // 3) + np.concatenate([a, b])[order]).tolist()
        out[0][rows] = np.stack([n_a, n_b, n_groups, np.diff(np.r_[0, link_ends])], axis=1)
        at = [0, *(last_a + last_b).tolist()]
        for j, k in enumerate(rows.tolist()):
            out[1][k] = "".join(map(self.shown.__getitem__, shown[at[j]:at[j + 1]]))[:-1]
            out[2][k] = links[link_ends[j - 1] if j else 0:link_ends[j]]
        return *out, good

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[tuple[np.ndarray, np.ndarray]]]:
        """Per text: n_a, n_b, n_groups and n_links; groups; its distinct links and how often each occurs."""
        parts = [self.parts(t) if t else [] for t in texts]
        of = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        figures, groups, links, good = self.align([w for p in parts for w in p])
        whole = np.ones(len(texts), dtype=bool)
        whole[of[~good]] = False
        total = np.zeros((len(texts), 4), dtype=np.int64)
        np.add.at(total, of, figures)
        total[~whole] = 0
        text, distinct, at = [], [], 0
        for p, fine in zip(parts, whole.tolist(), strict=True):
            mine = slice(at, at + len(p) if fine else at)
            text.append(";".join(groups[mine]))
            distinct.append(_summed([_counted(v) for v in links[mine]]) if len(p) > 1 else _counted(
                links[at] if p and fine else np.zeros(0, np.int64)))
            at += len(p)
        return total, text, distinct


def _quick(model: dict, bytes_of: list[bytes]) -> tiktoken.Encoding | None:
    """The same byte-level BPE by ranks, if the ids of merged tokens are in the order of the merges."""
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"].get("".join(m), -1) for m in merges]
    if model["type"] != "BPE" or any(x >= y for x, y in zip(made, made[1:], strict=False)) or len(made) + 256 != len(model["vocab"]):
        return None
    ranks = {bytes_of[i]: i for i in model["vocab"].values()}
    return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


def _aligner(path_a: str, path_b: str) -> _Aligner:
    if (path_a, path_b) not in _state:
        _state[path_a, path_b] = _Aligner(path_a, path_b)
    return _state[path_a, path_b]


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.r_[first, len(values)])


#: A document's row has figures and its distinct links (a, b, how often); a block's row has its vector of
#: identities and its other pairs.
_ALIGNED = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups", pa.string()), ("links", pa.binary()), ("times", pa.binary()),
    ("vector", pa.binary()), ("pairs", pa.binary()), ("counts", pa.binary())])
_ALIGNED_SQL = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, "
                "times binary, vector binary, pairs binary, counts binary")


def _align(path_a: str, path_b: str, whole_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        same = aligner.same
        task, number, size = TaskContext.get().partitionId() * 2**32, 0, 0
        vector, held = np.zeros(len(same), dtype=np.int64), []

        def closed():
            pairs, counts = _summed(held)
            empty = dict.fromkeys(_ALIGNED.names)
            return pa.RecordBatch.from_pylist([empty | {
                "block": task + number, "vector": vector.astype("<i8").tobytes(), "pairs": pairs.astype("<i8").tobytes(),
                "counts": counts.astype("<i8").tobytes()}], schema=_ALIGNED)

        for batch in batches:
            for x, y in slices(batch, "text", SLICE_BYTES):
                part = batch.slice(x, y - x)
                texts = part.column("text").to_pylist()
                size += sum(map(len, filter(None, texts)))
                figures, groups, distinct = aligner.documents(texts)
                every = np.concatenate([v for v, _ in distinct]) if distinct else np.zeros(0, np.int64)
                identity = same[every >> 32] == (every & 0xFFFFFFFF)
                vector += np.bincount(every[identity] >> 32, minlength=len(same))
                held.append(_counted(every[~identity]))
                if len(held) > 64:
                    held = [_summed(held)]
                if not whole_groups:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(texts), task + number)), part.column("doc_id"), *[pa.array(f) for f in figures.T],
                    pa.array(groups, pa.string()), pa.array([v.astype("<i8").tobytes() for v, _ in distinct], pa.binary()),
                    pa.array([n.astype("<u4").tobytes() for _, n in distinct], pa.binary()),
                    *[pa.nulls(len(texts), pa.binary())] * 3], schema=_ALIGNED)
                if size >= BLOCK_BYTES:
                    yield closed()
                    vector, held, size = np.zeros(len(same), dtype=np.int64), [], 0
                    number += 1
        if size or held:
            yield closed()

    return run


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of several lists of values, sorted, with the sums of their counts."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return values, np.bincount(at, np.concatenate([n for _, n in parts]), len(values)).astype(np.int64)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of a partition added up, in PARTS rows."""
    total = None
    for batch in batches:
        for x in batch.column("vector"):
            v = np.frombuffer(x.as_buffer(), "<i8")
            total = v.copy() if total is None else total + v
    if total is not None:
        cut = np.array_split(total, PARTS)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int64()), "vector": [c.tobytes() for c in cut]})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each part of the vectors; rows are added as they come."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for p, x in zip(batch.column("part").to_pylist(), batch.column("vector"), strict=True):
            v = np.frombuffer(x.as_buffer(), "<i8")
            totals[p] = totals[p] + v if p in totals else v.copy()
    if totals:
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(list(totals), pa.int64()), "vector": [v.tobytes() for v in totals.values()]})


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, pairs, counts in zip(*[batch.column(c) for c in ("block", "pairs", "counts")], strict=True):
            p, n = np.frombuffer(pairs.as_buffer(), "<i8"), np.frombuffer(counts.as_buffer(), "<i8")
            yield pa.RecordBatch.from_pydict({"block": np.full(len(p), block.as_py()), "pair": p, "n": n})


def _looked_up(identity: np.ndarray, best: np.ndarray, same: np.ndarray):
    """A block's documents with n_best and count_sum."""

    def run(key: tuple, docs: pa.Table, sums: pa.Table) -> pa.Table:
        order = np.argsort(sums.column("pair").to_numpy(), kind="stable")
        pairs, counts = sums.column("pair").to_numpy()[order], sums.column("n").to_numpy()[order]
        n_best, count_sum = [], []
        for links, times in zip(docs.column("links"), docs.column("times"), strict=True):
            v = np.frombuffer(links.as_buffer(), "<i8")
            times = np.frombuffer(times.as_buffer(), "<u4").astype(np.int64)
            a = v >> 32
            n = np.where(same[a] == (v & 0xFFFFFFFF), identity[a], 0)
            other = np.flatnonzero(same[a] != (v & 0xFFFFFFFF))
            n[other] = counts[np.searchsorted(pairs, v[other])]
            n_best.append(int(times[n == best[a]].sum()))
            count_sum.append(int((n * times).sum()))
        return pa.table({
            **{c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
            "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()),
            "groups": docs.column("groups")})

    return lambda key, docs, sums: run(key, docs, sums)


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text",
          whole_groups: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``groups`` are the groups as text, or without ``whole_groups`` their SHA-256 (empty if there are none).
    """
    spark = on_workers(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    aligned = stored(docs.mapInArrow(_align(path_a, path_b, whole_groups), _ALIGNED_SQL), "aligned")
    blocks = aligned.where("vector IS NOT NULL")
    same = _aligner(path_a, path_b).same

    # vectors of A's vocabulary: how many documents hold the identity of each id
    vectors = blocks.select("vector").mapInArrow(_vectors, "part long, vector binary")
    vectors = vectors.repartition(PARTS, "part").mapInArrow(_added, "part long, vector binary")
    parts = sorted((r["part"], bytes(r["vector"])) for r in vectors.collect())
    identity = np.concatenate([np.frombuffer(v, "<i8") for _, v in parts]) if parts else np.zeros(len(same), np.int64)

    # all other pairs: shuffled, a row per pair and block
    pairs = stored(blocks.select("block", "pairs", "counts").mapInArrow(_pair_rows, "block long, pair long, n long"), "pairs")
    sums = stored(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "pair-sums")
    highest = sums.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("n")).collect()
    best = identity.copy()
    for r in highest:
        best[r["a"]] = max(best[r["a"]], r["n"])

    answers = pairs.select("block", "pair").join(sums, "pair")
    figures = aligned.where("links IS NOT NULL").drop("vector", "pairs", "counts")
    return figures.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _looked_up(identity, best, same),
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
