"""Repeated passages by a run-length index over anchored text.

A byte goes if some string of ``size`` bytes that covers it also starts elsewhere. The index is a positional
Burrows-Wheeler transform, kept as runs, and built where repeats can be:

1. Every window of ``size`` bytes has an anchor, the leftmost of its k-grams with the smallest hash. Equal
   windows have equal anchors at equal places, so windows whose anchor occurs once in the corpus are done. So are
   those of a run of windows around an anchor that comes with equal runs only, as inside copies: all occur twice.
2. The other windows are cut, by their distance to the anchor, into chunks of CHUNK neighbours. Those share
   a core of ``size - CHUNK + 1`` bytes and differ by less than CHUNK bytes on either side, so a chunk travels as
   the core's hash and its two sides. Equal chunks of a block of documents travel once, with their number.
3. Chunks of one core are aligned. Column by column their order by reversed prefix (the transform) is updated:
   the column's characters in that order form runs, whole runs are moved by stable counting, and only at run
   ends the sampled match starts have to be looked up. Streaming the columns gives each chunk's matching
   statistics, the start of its longest match with a neighbour in the order; a window whose match reaches
   back to its first byte occurs twice.
4. Marks go back to the places of equal chunks by an equi-join, which Spark can split for passages that very
   many documents have.

The core stands for one column, as all rows agree on it: that is where a repetitive corpus compresses.

Passages are found on the way: windows of ``words`` words (between white space, as written) that another row has too,
however few bytes they are. Nothing is removed for them. They have anchors as well, among word k-grams, and what is not
known by equal runs travels as hashes of windows, in chunks whose core is the words they share; a row counts once.

Defined cases: a null text is empty; texts shorter than ``size`` lose nothing; a row without id is a text
like any other; repeated rows are texts that repeat each other; an empty table gives an empty result. Columns
other than id and text are not read. Memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm import wordhash
from codewarden.llm.common import left_join, on_workers, saved

SIZE = 400
#: Bytes of the k-grams among which anchors are chosen.
GRAM = 32
CHUNK = 32
#: Words of a passage, of the k-grams among which its anchors are chosen, and windows of a chunk.
WORDS = 51
WORD_GRAM = 8
WORD_CHUNK = 11
#: Bytes of text whose windows are held at once, and slices whose chunks are counted together.
SLICE_BYTES = 1_000_000
SLICES = 4
_SIDE = CHUNK - 1
_U = np.uint64
_PLACE = _U((1 << 28) - 1)
_BYTE = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_COLUMN = np.random.default_rng(11).integers(0, 2**63, 2 * CHUNK, dtype=np.uint64) * _U(2) + _U(1)
#: What a place tells of: a chunk of windows, or known windows up to the one at ``side``; of bytes or of words.
_CHUNK, _KNOWN, _WORD_CHUNK, _WORD_KNOWN = range(4)


class _Anchors:
    """The windows of a slice of texts, as runs (anchor, first start, last start)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int):
        n = len(data)
        self.data, self.offsets, self.size = data, offsets, size
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * wordhash._power(wordhash._BASE, n)[:n], out=sums[1:])
        self.sums = sums
        self.text, self.anchor, self.low, self.high = _runs(self.grams(), offsets, size, GRAM)
        self.hash = self.span(self.anchor, GRAM)

    def grams(self) -> np.ndarray:
        """Hashes of the k-grams at all places."""
        n = max(len(self.data) - GRAM + 1, 0)
        return wordhash.mix((self.sums[GRAM:] - self.sums[:n]) * wordhash._power(wordhash._INVERSE, len(self.data))[:n])

    def span(self, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """Hashes of the strings of ``length`` bytes at ``starts``."""
        power = wordhash._power(wordhash._INVERSE, len(self.data))
        return wordhash.mix((self.sums[starts + length] - self.sums[starts]) * power[starts])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, anchor and hash of all bytes of every run."""
        return self.text, self.hash, self.span(self.low, self.high - self.low + self.size)

    def chunks(self, mixed: np.ndarray):
        """Chunks of the runs whose anchor is mixed: text, start of the first window, core hash, sides.

        A side is the number of left and right bytes needed, and the bytes, aligned to the core.
        """
        some = np.flatnonzero(np.isin(self.hash, mixed))
        p, low, high = self.anchor[some], self.low[some], self.high[some]
        first, last = (p - high) // CHUNK, (p - low) // CHUNK
        many = last - first + 1
        run = np.repeat(np.arange(len(some)), many)
        q = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
        start = p[run] - q * CHUNK - _SIDE
        lo, hi = np.maximum(low[run] - start, 0), np.minimum(high[run] - start, _SIDE)
        core = wordhash.mix(self.span(start + _SIDE, self.size - _SIDE) + q.astype(np.uint64))
        sides = np.zeros((len(run), 2 * CHUNK), dtype=np.uint8)
        sides[:, 0], sides[:, 1] = _SIDE - lo, hi
        for c in range(_SIDE):
            need = c >= lo
            sides[need, 2 + c] = self.data[start[need] + c]
            need = c < hi
            sides[need, 2 + _SIDE + c] = self.data[start[need] + self.size + c]
        return self.text[some][run], start, core, sides


class _Words:
    """The windows of words of a slice of texts, as runs (anchor, first start, last start) of word numbers."""

    def __init__(self, found: _Anchors, words: int):
        data, offsets = found.data, found.offsets
        self.words = words
        white = wordhash._WHITE[data]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offsets] = True
        begins, ends = ~white, ~white
        begins[1:] &= white[:-1] | first[1:-1]
        ends[:-1] &= white[1:] | first[1:-1]
        starts = np.flatnonzero(begins)
        hashes = found.span(starts, np.flatnonzero(ends) + 1 - starts)
        self.offsets = np.searchsorted(starts, offsets)
        n = len(starts)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * wordhash._power(wordhash._BASE, n)[:n], out=self.sums[1:])
        self.inverse = wordhash._power(wordhash._INVERSE, n)
        k = max(n - WORD_GRAM + 1, 0)
        grams = wordhash.mix((self.sums[WORD_GRAM:] - self.sums[:k]) * self.inverse[:k] + _U(1))
        self.text, self.anchor, self.low, self.high = _runs(grams, self.offsets, words, WORD_GRAM)
        self.hash = grams[self.anchor]

    def span(self, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """Hashes of the sequences of ``length`` words at ``starts``."""
        return wordhash.mix((self.sums[starts + length] - self.sums[starts]) * self.inverse[starts])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, anchor and hash of all words of every run, once per text."""
        run = self.span(self.low, self.high - self.low + self.words)
        order = np.lexsort((run, self.hash, self.text))
        text, anchor, run = self.text[order], self.hash[order], run[order]
        new = np.r_[True, (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1])][:len(run)]
        return text[new], anchor[new], run[new]

    def chunks(self, mixed: np.ndarray):
        """Chunks of the runs whose anchor is mixed: text, start of the first window, core hash, hashes of the windows."""
        some = np.flatnonzero(np.isin(self.hash, mixed))
        p, low, high = self.anchor[some], self.low[some], self.high[some]
        first, last = (p - high) // WORD_CHUNK, (p - low) // WORD_CHUNK
        many = last - first + 1
        run = np.repeat(np.arange(len(some)), many)
        q = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
        core = wordhash.mix(self.span(p[run] - q * WORD_CHUNK, self.words - WORD_CHUNK + 1) + q.astype(np.uint64))
        start = np.maximum(low[run], p[run] - q * WORD_CHUNK - WORD_CHUNK + 1)
        stop = np.minimum(high[run], p[run] - q * WORD_CHUNK)
        windows = np.zeros((len(run), WORD_CHUNK), dtype=np.uint64)
        for j in range(WORD_CHUNK):
            some_j = np.flatnonzero(start + j <= stop)
            windows[some_j, j] = self.span(start[some_j] + j, self.words)
        return self.text[some][run], start, core, windows


def _known(found: _Anchors | _Words, shared: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last start of the windows whose anchor is shared by equal runs, neighbours put together."""
    some = np.flatnonzero(np.isin(found.hash, shared) & ~np.isin(found.hash, mixed))
    text, low, high = found.text[some], found.low[some], found.high[some]
    if not len(some):
        return text, low, high
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (low[1:] != high[:-1] + 1)])
    return text[first], low[first], high[np.r_[first[1:], len(some)] - 1]


def _runs(grams: np.ndarray, offsets: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """The windows of ``size`` places of each text as runs of one anchor: text, anchor, first and last start."""
    windows = np.maximum(np.diff(offsets) - size + 1, 0)
    if not windows.any():
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    least = _sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), size - gram + 1)
    head = np.empty(len(least) + 1, dtype=bool)
    head[0] = True
    np.not_equal(least[1:], least[:-1], out=head[1:-1])
    # windows start at all places of a text but its last size - 1
    some = np.flatnonzero(windows)
    head[offsets[some]] = head[offsets[some] + windows[some]] = True
    first = np.flatnonzero(head[:-1])
    last = np.r_[first[1:], len(least)] - 1
    text = np.searchsorted(offsets, first, "right") - 1
    good = first - offsets[text] < windows[text]
    first = first[good]
    return text[good], (least[first] & _PLACE).astype(np.int64), first, last[good]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours (blocks of running minima from both ends)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    full = -(-len(values) // width) * width
    padded = np.full(full, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1:width - 1 + n])


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, _Anchors]]:
    for a, b in wordhash.slices(batch, "text", SLICE_BYTES):
        part = batch.slice(a, b - a)
        yield part, _Anchors(*wordhash.text_bytes(part.column("text")), size)
        pa.default_memory_pool().release_unused()


def _once_per_text(text: np.ndarray, core: np.ndarray, windows: np.ndarray):
    """Counted chunks: core, side, number, windows. Windows a text has in several chunks count once, by rows of -1."""
    side = _side_hash(windows)
    key = wordhash.mix(core + side * _COLUMN[0]) + text.astype(np.uint64) * _COLUMN[1]
    first = np.unique(key, return_index=True)[1]
    text, core, side, windows = text[first], core[first], side[first], windows[first]
    flat = wordhash.mix(windows + text.astype(np.uint64)[:, None] * _COLUMN[2]).ravel()
    again = np.ones(flat.shape, dtype=bool)
    again[np.unique(flat, return_index=True)[1]] = False
    less = np.where(again.reshape(windows.shape), windows, _U(0))
    some = less.any(axis=1)
    less = less[some]
    n = np.repeat(np.array([1, -1]), [len(core), len(less)])
    return (np.concatenate((core, core[some])), np.concatenate((side, wordhash.mix(_side_hash(less) + _U(1)))), n,
            np.concatenate((windows, less)))


def _side_hash(sides: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sides), dtype=np.uint64)
    for c in range(sides.shape[1]):
        out = wordhash.mix(out + (sides[:, c] + _U(1)) * _COLUMN[c])
    return out


def _distinct(core: np.ndarray, side: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of every distinct chunk, in their order, and the sums of ``n``."""
    order = np.lexsort((side, core))
    ranked = core[order], side[order]
    first = np.flatnonzero(np.r_[True, (ranked[0][1:] != ranked[0][:-1]) | (ranked[1][1:] != ranked[1][:-1])][:len(core)])
    return order[first], np.add.reduceat(n[order], first) if len(first) else n


def anchors(docs: DataFrame, size: int, words: int) -> DataFrame:
    """doc_id, tag, anchor and hash of every run of windows; of words, each run of a text once."""

    def run(batches):
        for batch in batches:
            for part, found in _slices(batch, size):
                text, anchor, whole = (np.concatenate(x) for x in zip(found.runs(), _Words(found, words).runs(), strict=True))
                which = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(which), part.column("tag").take(which), pa.array(anchor.view(np.int64)),
                     pa.array(whole.view(np.int64))], names=["doc_id", "tag", "anchor", "run"])

    return docs.mapInArrow(run, "doc_id long, tag long, anchor long, run long")


def _listed(part: pa.RecordBatch, name: str) -> np.ndarray:
    held = part.column(name).flatten().to_numpy(zero_copy_only=False)
    return np.unique(np.concatenate([np.zeros(0, np.int64), held]).astype(np.int64)).view(np.uint64)


def _chunk_rows(rows: DataFrame, size: int, words: int, places: bool) -> DataFrame:
    """Windows with a shared anchor: their places, or what their chunks hold (once per some slices, counted)."""

    def counted(slices):
        core, side, n, sides = (np.concatenate(x) for x in zip(*slices, strict=True))
        first, n = _distinct(core, side, n)
        held = np.ascontiguousarray(sides[first])
        width = held.itemsize * held.shape[1]
        return pa.RecordBatch.from_arrays(
            [pa.array(core[first].view(np.int64)), pa.array(side[first].view(np.int64)), pa.array(n, pa.int64()),
             pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(
                 np.arange(len(first) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(held)])],
            names=["core", "side", "n", "held"])

    def placed(part, kind, text, at, core, side):
        which = pa.array(text)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(which), part.column("tag").take(which), pa.array(at, pa.int64()),
             pa.array(core.view(np.int64)), pa.array(side.view(np.int64)), pa.array(np.full(len(text), kind, np.int8))],
            names=["doc_id", "tag", "at", "core", "side", "kind"])

    def run(batches):
        slices, passages = [], []
        for batch in batches:
            for part, found in _slices(batch, size):
                shared, mixed = _listed(part, "anchors"), _listed(part, "mixed")
                text, start, core, sides = found.chunks(mixed)
                side = _side_hash(sides)
                in_words = _Words(found, words)
                word_chunks = in_words.chunks(mixed)
                if places:
                    yield placed(part, _CHUNK, text, start - found.offsets[text], core, side)
                    text, start, core, windows = word_chunks
                    yield placed(part, _WORD_CHUNK, text, start - in_words.offsets[text], core, _side_hash(windows))
                    for kind, each in ((_KNOWN, found), (_WORD_KNOWN, in_words)):
                        text, low, high = _known(each, shared, mixed)
                        before = each.offsets[text]
                        # matched with nothing: keys that spread
                        yield placed(part, kind, text, low - before, each.span(low, WORD_GRAM), high - before)
                    continue
                first, n = _distinct(core, side, np.ones(len(core), dtype=np.int64))
                slices.append((core[first], side[first], n, sides[first]))
                passages.append(_once_per_text(word_chunks[0], *word_chunks[2:]))
                if len(slices) == SLICES:
                    yield counted(slices)
                    yield counted(passages)
                    slices, passages = [], []
        if slices:
            yield counted(slices)
            yield counted(passages)

    schema = ("doc_id long, tag long, at long, core long, side long, kind byte" if places
              else "core long, side long, n long, held binary")
    return rows.mapInArrow(run, schema)


class RunLengthTransform:
    """Positional Burrows-Wheeler transform of aligned rows in groups, updated column by column as runs.

    ``order`` lists the rows of each group by reversed prefix; ``since`` has, for each row of the order, the
    column from which on it agrees with the row before.
    """

    def __init__(self, group: np.ndarray):
        self.group = group
        self.order = np.arange(len(group))
        self.since = np.where(np.r_[True, group[1:] != group[:-1]], np.iinfo(np.int64).max, 0)
        self.column = 0

    def push(self, characters: np.ndarray) -> None:
        """Take the next character of every row; ``group`` is sorted, so groups stay where they are."""
        key = self.group * 512 + characters[self.order]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        lengths = np.diff(np.r_[heads, len(key)])
        runs = np.argsort(key[heads], kind="stable")
        # the sample at a run's end: the latest mismatch among the rows passed over since the run before
        before = np.full(len(heads), -1)
        same = key[heads][runs][1:] == key[heads][runs][:-1]
        before[runs[1:][same]] = runs[:-1][same]
        latest = np.maximum.reduceat(self.since, heads)
        since = self.since.copy()
        joined = np.flatnonzero(before >= 0)
        far = joined[joined - before[joined] > 1]
        since[heads[before < 0]] = self.column + 1
        if len(far):
            bounds = np.column_stack((before[far] + 1, far)).ravel()
            between = np.maximum.reduceat(np.append(latest, 0), bounds)[::2]
            since[heads[far]] = np.maximum(since[heads[far]], between)
        at = np.repeat(heads[runs] - (np.cumsum(lengths[runs]) - lengths[runs]), lengths[runs]) + np.arange(len(key))
        self.order, self.since = self.order[at], since[at]
        self.column += 1
        group = self.group
        self.since[np.r_[True, group[1:] != group[:-1]]] = np.iinfo(np.int64).max

    def match_starts(self) -> np.ndarray:
        """For each row the first column of its longest match, up to here, with another row of its group."""
        after = np.append(self.since[1:], np.iinfo(np.int64).max)
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = np.minimum(self.since, after)
        return out


def _marks(core: np.ndarray, sides: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bit j of a chunk: its j-th window occurs elsewhere. ``core`` is sorted, equal chunks are one row."""
    marks = np.zeros(len(core), dtype=np.int64)
    if not len(core):
        return marks
    lo, hi = _SIDE - sides[:, 0].astype(np.int64), sides[:, 1].astype(np.int64)
    alone = np.r_[True, core[1:] != core[:-1]] & np.r_[core[1:] != core[:-1], True]
    some = np.flatnonzero(~alone)
    if len(some):
        group = np.cumsum(np.r_[0, core[some][1:] != core[some][:-1]])
        index = RunLengthTransform(group)
        for c in range(2 * _SIDE + 1):
            if c >= _SIDE:
                # window j covers the columns from j on, up to the j-th right one
                j = c - _SIDE
                good = (index.match_starts() <= j) & (lo[some] <= j) & (j <= hi[some])
                marks[some[good]] |= 1 << j
            if c < 2 * _SIDE:
                # a byte that a row has no use for agrees with no other row's byte that has one
                used = (c >= lo[some]) if c < _SIDE else (c - _SIDE < hi[some])
                index.push(np.where(used, sides[some, 2 + c].astype(np.int64), 256))
    j = np.arange(CHUNK)
    every = np.where((j >= lo[:, None]) & (j <= hi[:, None]), 1 << j, 0).sum(axis=1)
    return np.where(n > 1, every, marks)


def _mark_words(core: np.ndarray, windows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bit j of a chunk: more than one row has its j-th window. Equal windows have equal cores."""
    held = windows != 0
    row = np.repeat(np.arange(len(core)), held.sum(axis=1))
    _, which = np.unique(windows[held], return_inverse=True)
    many = np.bincount(which, weights=n[row]) > 1
    marks = np.zeros(windows.shape, dtype=np.int64)
    marks[held] = many[which]
    return (marks << np.arange(WORD_CHUNK)).sum(axis=1)


def _mark_rows(batches):
    """Chunks sorted by core, as they come; a core's chunks are handled together, those of bytes and of words apart."""
    kept = {}

    def flush(core, side, n, held):
        order = np.lexsort((side, core))
        core, side, n, held = core[order], side[order], n[order], held[order]
        first = np.flatnonzero(np.r_[True, (core[1:] != core[:-1]) | (side[1:] != side[:-1])])
        core, side, n, held = core[first], side[first], np.add.reduceat(n, first), held[first]
        marks = _marks(core, held, n) if held.shape[1] == 2 * CHUNK else _mark_words(core, held.view(np.uint64), n)
        some = (marks != 0) & (n > 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(core[some]), pa.array(side[some]), pa.array(marks[some])], names=["core", "side", "marks"])

    for every in batches:
        width = pc.binary_length(every.column("held"))
        for size in (2 * CHUNK, 8 * WORD_CHUNK):
            batch = every.filter(pc.equal(width, size))
            if not len(batch):
                continue
            core, side, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("core", "side", "n"))
            held = np.frombuffer(b"".join(batch.column("held").to_pylist()), dtype=np.uint8).reshape(-1, size)
            new = (core, side, n, held)
            if size in kept:
                new = tuple(np.concatenate(x) for x in zip(kept[size], new, strict=True))
            # the last core may go on in the next batch
            done = int(np.searchsorted(new[0], new[0][-1]))
            if done:
                yield flush(*[x[:done] for x in new])
            kept[size] = tuple(x[done:] for x in new)
    for rows in kept.values():
        yield flush(*rows)


def _covered(found: pa.StructArray, chunk: int, known: int, size: int, length: int) -> np.ndarray:
    """Which of ``length`` places the windows of ``size`` places cover that a text's places tell of."""
    at, marks, kind = (found.field(c).to_numpy(zero_copy_only=False) for c in ("at", "marks", "kind"))
    row, j = np.nonzero((marks[kind == chunk][:, None] >> np.arange(CHUNK)) & 1)
    starts = at[kind == chunk][row] + j
    first = np.concatenate((starts, at[kind == known]))
    last = np.concatenate((starts, marks[kind == known]))
    change = np.bincount(first, minlength=length + 1) - np.bincount(last + size, minlength=length + 1)
    return np.cumsum(change)[:-1] > 0


def _spans(covered: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _cut(size: int, words: int):
    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            out = {"n_bytes": [], "spans": [], "kept": [], "passages": []}
            for row in range(len(batch)):
                data = kept = (texts[row].as_py() or "").encode()
                found = batch.column("found")[row].values
                spans, passages = [], []
                if found is not None:
                    gone = _covered(found, _CHUNK, _KNOWN, size, len(data))
                    spans, kept = _spans(gone), np.frombuffer(data, np.uint8)[~gone].tobytes()
                    passages = _spans(_covered(found, _WORD_CHUNK, _WORD_KNOWN, words, len(data)))
                out["n_bytes"].append(len(data))
                out["spans"].append(spans)
                out["kept"].append(kept)
                out["passages"].append(passages)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(out["n_bytes"], pa.int64()), pa.array(out["spans"], kind), pa.array(out["kept"], pa.binary()),
                 pa.array(out["passages"], kind)], names=["doc_id", "n_bytes", "spans", "kept", "passages"])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE,
                   words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (removed, start and end), kept (bytes) and passages (word
    numbers, start and end, in windows of ``words`` words that another row has too)."""
    if size < GRAM + CHUNK:
        raise ValueError(f"size must be at least {GRAM + CHUNK}")
    if words < WORD_GRAM + WORD_CHUNK:
        raise ValueError(f"words must be at least {WORD_GRAM + WORD_CHUNK}")
    spark = on_workers(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("tag"))
    every = anchors(rows, size, words)
    # saved, so that the join below deals out both sides and Spark can split a very common anchor
    shared = saved(every.groupBy("anchor").agg(F.count("*").alias("n"), F.min("run").alias("a"), F.max("run").alias("b"))
                   .where("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("unlike")))
    lists = every.drop("run").join(shared, "anchor").groupBy("doc_id", "tag").agg(
        F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("unlike"), F.col("anchor"))).alias("mixed"))
    able = left_join(rows, lists, ["doc_id", "tag"]).where(F.col("anchors").isNotNull())
    contents = _chunk_rows(able, size, words, places=False).repartition(parts, "core").sortWithinPartitions("core")
    marks = contents.mapInArrow(_mark_rows, "core long, side long, marks long")
    found = _chunk_rows(able, size, words, places=True).join(marks, ["core", "side"], "left").withColumn(
        "marks", F.when(F.col("kind").isin(_KNOWN, _WORD_KNOWN), F.col("side")).otherwise(F.col("marks"))).where("marks is not null").groupBy(
        "doc_id", "tag").agg(F.collect_list(F.struct("at", "marks", "kind")).alias("found"))
    return left_join(rows, found, ["doc_id", "tag"]).select("doc_id", "text", "found").mapInArrow(
        _cut(size, words), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, "
        "passages array<struct<start:long,end:long>>")
