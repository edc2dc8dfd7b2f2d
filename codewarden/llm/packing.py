"""Best-fit packing by exact complements.

Documents are tokenised and cut into pieces of at most the capacity. How many pieces of each length there
are is a table of at most ``capacity`` rows; on it the packing is planned: for the longest lengths first,
the gap to the capacity is looked up among single lengths, sums of two and sums of three that are still
available, and exact fills are taken as often as the counts allow; what is left is placed best-fit, longest
first. The plan lists patterns (lengths, repetitions), so its size depends on the capacity, not on the corpus.

Every piece gets a number among the pieces of its length: counted per (bucket, length), with the buckets'
counts added up, so a length that very many pieces have is spread over all buckets. The number leads to a
pattern, a repetition and a place.

Defined cases: a null text is empty and is one piece of the closing id alone; rows without id are packed like
any other; repeated rows are packed each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codewarden.llm.common import on_workers, stored
from codewarden.llm.wordhash import slices

CAPACITY = 2048
CLOSING = 0
#: Words whose ids a worker remembers.
REMEMBERED = 200_000
#: Bytes of text whose chunks are told apart at once.
SLICE_BYTES = 8_000_000
_state: dict = {}


#: Lower-case letters of Latin-1, which no normalisation changes, and the two characters that stand for
#: the bytes of each that is not ASCII: bytes that cannot be printed are moved up, in order.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_BYTES = {c: "".join(chr(b if b in _SHOWN else 256 + _HIDDEN.index(b)) for b in chr(c).encode())
          for c in range(0xDF, 0x100)}


class _Words:
    """Ids of blank-separated chunks, each tokenised once.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its chunks.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, np.ndarray] = {"": np.zeros(0, np.uint32)}
        self.mark = "|"
        self.mark_id = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        assert len(self.mark_id) == 1

    def ids(self, chunks: list[str]) -> list[np.ndarray]:
        out = [self.known.get(c) for c in chunks]
        new = [k for k, x in enumerate(out) if x is None]
        for k in new:
            if _LETTERS.fullmatch(chunks[k]):
                # one piece for the model, whatever the normaliser and the splitter do
                out[k] = np.array([x.id for x in self.model.tokenize(chunks[k].translate(_BYTES))], dtype=np.uint32)
        others = [k for k in new if out[k] is None]
        plain = [k for k in others if self.mark not in chunks[k]]
        for a in range(0, len(plain), 4096):
            some = plain[a:a + 4096]
            # many chunks in one call, told apart by the id of a mark that none of them holds
            joined = f" {self.mark} ".join(chunks[k] for k in some)
            ids = np.array(self.tokenizer.encode(joined, add_special_tokens=False).ids, dtype=np.uint32)
            parts = np.split(ids, np.flatnonzero(ids == self.mark_id[0]))
            for j, (k, x) in enumerate(zip(some, parts, strict=True)):
                out[k] = x[1:] if j else x
        for k in set(others) - set(plain):
            out[k] = np.array(self.tokenizer.encode(chunks[k], add_special_tokens=False).ids, dtype=np.uint32)
        for k in new[:max(0, REMEMBERED - len(self.known))]:
            self.known[chunks[k]] = out[k]
        return out


def _words(path: str) -> _Words:
    if path not in _state:
        _state[path] = _Words(path)
    return _state[path]


def _plain(texts: pa.Array) -> pa.Array:
    """Texts of the same ids with fewer different chunks.

    The tokenizer lower-cases anyway and always parts a letter or digit from the full stop or comma behind
    it. Texts that could hold one of its special strings, which are matched before that, keep their case.
    """
    texts = pc.replace_substring(texts, "\n", " ")
    if pc.any(pc.match_substring(texts, "<|")).as_py():
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
    else:
        texts = pc.ascii_lower(texts)
    return pc.replace_substring_regex(texts, r"([a-z0-9])([.,])", r"\1 \2")


def document_ids(column: pa.Array, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row, each text closed by CLOSING, and each text's beginning."""
    lists = pc.split_pattern(_plain(pc.fill_null(column, "")), " ")
    chunks = lists.flatten().dictionary_encode()
    ids = words.ids(chunks.dictionary.to_pylist())
    ids.append(np.array([CLOSING], np.uint32))
    sizes = np.array([len(x) for x in ids])
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(ids)
    offsets = np.asarray(lists.offsets)
    # the closing id is one more chunk behind each text
    index = np.insert(chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets[1:] - offsets[0], len(ids) - 1)
    n = sizes[index]
    ends = np.cumsum(n)
    at = np.repeat(starts[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    last = offsets[1:] - offsets[0] + np.arange(1, len(offsets))
    return flat[at], np.r_[0, ends[last - 1]] if len(last) else np.zeros(1, np.int64)


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32 (and ids)."""

    def run(batches):
        words = _words(tokenizer)
        for batch in batches:
            for a, b in slices(batch, "text", SLICE_BYTES):
                part = batch.slice(a, b - a)
                ids, firsts = document_ids(part.column("text"), words)
                ids = ids.astype("<u4")
                n = np.diff(firsts)
                pieces = np.maximum(1, -(-n // capacity))
                row = np.repeat(np.arange(len(n)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(capacity, n[row] - start)
                begin = firsts[row] + start
                crc = [zlib.crc32(ids[x:x + y].tobytes()) for x, y in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = {
                    "doc_id": part.column("doc_id").take(pa.array(row)), "piece": pa.array(number, pa.int32()),
                    "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(
                        pa.array(np.r_[begin, firsts[-1]], pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, repetitions) that use up ``counts`` and fill at most ``capacity`` each."""
    c = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        c[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths):
        used: dict[int, int] = {}
        for x in lengths:
            used[x] = used.get(x, 0) + 1
        n = min(int(c[x]) // k for x, k in used.items())
        if n:
            out.append((tuple(lengths), n))
            for x, k in used.items():
                c[x] -= k * n
        return n

    def pair(gap, least=1):
        """The two available lengths that sum up to ``gap``, the larger one as large as possible."""
        half = (gap + 1) // 2
        high = np.arange(half, gap - least + 1)
        good = np.flatnonzero((c[high] > 0) & (c[gap - high] > 0) & ((high * 2 != gap) | (c[high] > 1)))
        return (int(high[good[-1]]), int(gap - high[good[-1]])) if len(good) else None

    for length in range(capacity, 0, -1):
        while c[length]:
            gap = capacity - length
            if not gap:
                take([length])
                continue
            if gap <= capacity and c[gap] and take([length, gap]):
                continue
            two = pair(gap)
            if two and take([length, *two]):
                continue
            found = False
            for third in range(gap - 2, gap // 3 - 1, -1):
                if third > 0 and c[third]:
                    two = pair(gap - third)
                    if two and take([length, third, *two]):
                        found = True
                        break
            if not found:
                break
    # best fit, longest first, over open patterns by their gap
    gaps: dict[int, list[list]] = {}
    for length in range(capacity, 0, -1):
        while c[length]:
            fit = next((g for g in range(length, capacity + 1) if gaps.get(g)), None)
            if fit is None:
                # as many of the same length as fit together
                k = min(capacity // length, int(c[length]))
                n = int(c[length]) // k
                c[length] -= k * n
                gaps.setdefault(capacity - k * length, []).append([(length,) * k, n])
                continue
            lengths, n = gaps[fit].pop()
            m = min(n, int(c[length]))
            c[length] -= m
            gaps.setdefault(fit - length, []).append([(*lengths, length), m])
            if n > m:
                gaps.setdefault(fit, []).append([lengths, n - m])
    out += [(tuple(x), n) for xs in gaps.values() for x, n in xs]
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the k-th piece of a length goes: runs of numbers, by (length, number)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + n
            offset += x
        sequence += n
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"key": table[:, 0] * 2**45 + table[:, 1], "first": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
         capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their sequence_id and offset."""
    spark = on_workers(docs.sparkSession)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = stored(cut(docs, tokenizer, capacity), "pieces")
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = stored(pieces.groupBy("bucket", "length").agg(F.count("*").alias("n")), "lengths")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = slots(plan(total, capacity))
    before = counts.select("bucket", "length", (F.sum("n").over(
        Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = pieces.withColumn("k", number - 1).join(before, ["bucket", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("k") + F.col("before")).alias("k"))

    def place(batches):
        for batch in batches:
            k = batch.column("k").to_numpy(zero_copy_only=False)
            length = batch.column("length").to_numpy(zero_copy_only=False)
            run = np.searchsorted(where["key"], length * 2**45 + k, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
                 pa.array(where["sequence"][run] + k - where["first"][run]), pa.array(where["offset"][run])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
