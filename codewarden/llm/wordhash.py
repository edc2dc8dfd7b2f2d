"""Words and word n-grams of Arrow text columns as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_rng = np.random.default_rng(20240229)
#: A random value per byte, A-Z like a-z; the words' white space.
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 2**64))
#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 4_000_000
#: Bytes hashed at once inside a slice; a longer text is cut at white space.
HASHED_BYTES = 1_000_000
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        p = np.full(max(n, HASHED_BYTES + 1), base, dtype=np.uint64)
        p[0] = 1
        np.cumprod(p, out=p)
        if len(p) > 4 * SLICE_BYTES:
            return p
        _powers[key] = p
    return _powers[key]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``limit`` bytes of text each."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    row, n = 0, len(lengths)
    while row < n:
        before = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield row, stop
        row = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and each text's beginning (plus the end of the last)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each text's first word (plus the number of words)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    white = _WHITE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = white[:-1]
    begins = ~white & (before | first[:-1])
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = white[1:]
    ends = ~white & (after | first[1:])
    values = _BYTE[data]
    values *= _power(_BASE, n)[:n]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    del values, white, before, after, first
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = (sums[stops] - sums[starts]) * _power(_INVERSE, n)[starts]
    hashes = mix(hashes + (stops - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def _cuts(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a text of about HASHED_BYTES, each but the last ending in white space."""
    while len(data) > HASHED_BYTES:
        stop = HASHED_BYTES
        while stop < len(data) and not (white := _WHITE[data[stop:stop + HASHED_BYTES]]).any():
            stop += HASHED_BYTES
        if stop >= len(data):
            break
        stop += int(white.argmax()) + 1
        yield data[:stop]
        data = data[stop:]
    yield data


def column_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """:func:`words` of all texts of a column, a part after the other."""
    hashes, firsts, n = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    batch = pa.RecordBatch.from_arrays([column], names=["text"])
    for a, b in slices(batch, "text", HASHED_BYTES):
        data, offsets = text_bytes(column.slice(a, b - a))
        if b == a + 1:
            found = [words(part, np.array([0, len(part)]))[0] for part in _cuts(data)]
            ends = [sum(map(len, found))]
            hashes.extend(found)
        else:
            h, f = words(data, offsets)
            hashes.append(h)
            ends = f[1:]
        firsts.append(np.asarray(ends, dtype=np.int64) + n)
        n += int(ends[-1])
    return np.concatenate(hashes), np.concatenate(firsts)


def ngrams(hashes: np.ndarray, firsts: np.ndarray, n: int) -> list[np.ndarray]:
    """Per text the distinct word n-grams, sorted; a text of fewer words is one n-gram of its own length."""
    total = len(hashes)
    if total >= n:
        grams = hashes[:total - n + 1].copy()
        for k in range(1, n):
            grams = grams * _U(0xD1342543DE82EF95) + hashes[k:total - n + 1 + k]
        grams = mix(grams + _U(n))
    else:
        grams = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a:b - n + 1]))
        elif b > a:
            short = hashes[a:a + 1].copy()
            for k in range(a + 1, b):
                short = short * _U(0xD1342543DE82EF95) + hashes[k:k + 1]
            out.append(mix(short + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
