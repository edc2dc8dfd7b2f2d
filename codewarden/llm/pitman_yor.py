"""Language-model scoring with a hierarchical Pitman-Yor model of words.

Every context (the word before, or the beginning of a text) is a restaurant; all share one parent
restaurant of single words, whose base is uniform over the training words and one unknown word. Customers
are training tokens, dishes are words. Seatings are drawn by sweeps of Chinese-restaurant
draws, several samples are kept, and a token's probability is the mean of the samples' predictive
probabilities; a text's score is the sum of their logarithms.

How it is spread: tokens go once to fragments by their own word, as packed blocks of (word, context,
document). A fragment holds all customers of its words. It opens its blocks twice: to count its pairs (word, context),
which the sweeps work on, and to score. Before the first sweep and after every sweep it sends each
context's partial tables to the fragment of that context, which adds them up and sends the sums back, with
the parent restaurant's totals; the next sweep seats with them. With the sums of the kept sweeps the fragment
scores its tokens and sends partial sums per document. All sums are exact and all draws are functions of
(word, context, sweep), so a recomputed task draws the same, and so does any number of fragments.
Fragments are as many as ``spark.sql.shuffle.partitions``. A frequent word's tokens are summed per
block before they travel, as one count per context and document.

What travels is small numbers, compressed by byte planes. A fragment knows a document by its block and its place
there only; the block's ids go to one of its fragments, and the fragments' sums of a block meet
in one task. A block goes by its partition and a digest of its rows, so ``docs`` must give its rows in the same order
when a task is repeated, as the scan of a table does; sums that do not belong together are told by the counts of
end tokens and raise an error.

Defined cases: a null or empty text is one end token; a row without id is held out; repeated rows are
trained on as often as they come, and scored each; an empty table gives an empty result. Other columns
than id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm import wordhash
from codewarden.llm.common import on_workers

FOLDS = 10
#: Discount and strength of the context restaurants and of their parent.
DISCOUNT, STRENGTH = 0.75, 2.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.6, 10.0
SWEEPS = 4
#: The last sweeps, whose seatings are kept.
SAMPLES = 2
#: Customers of a dish that are seated one by one; more come in blocks that double.
SINGLY = 32
BLOCK_BYTES = 4_000_000
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_U = np.uint64
_BLOBS = ["words", "word_pairs", "contexts", "pair_context", "pair_entries", "entry_row", "entry_count", "training"]
#: A block: its partition, digest and number of rows; and, in one of its rows only, the ids and which are missing.
_BLOCK = "part int, block long, n int, ids binary, unnamed binary"
_CONTEXT_BITS = 40


def _part(hashes: np.ndarray, fragments: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(fragments) >> _U(32)).astype(np.int64)


def _shrink(values: np.ndarray) -> bytes:
    """Numbers, compressed by byte planes: small ones in wide types take little."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _grown(packed: bytes | pa.Buffer, kind: str) -> np.ndarray:
    if not len(packed):
        return np.zeros(0, dtype=kind)
    packed = pa.py_buffer(packed) if isinstance(packed, bytes) else packed
    size = int(np.frombuffer(packed, "<u8", 1)[0])
    planes = np.frombuffer(pa.decompress(packed.slice(8), size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack(contexts: np.ndarray) -> bytes:
    """40-bit values as steps from each to the next."""
    return _shrink(np.diff(contexts, prepend=_U(0)) & _U((1 << _CONTEXT_BITS) - 1))


def _unpack(packed: bytes | pa.Buffer) -> np.ndarray:
    return np.cumsum(_grown(packed, "<u8"), dtype=np.uint64) & _U((1 << _CONTEXT_BITS) - 1)


def is_training(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS != 0


def _blocks(docs: DataFrame, fragments: int) -> DataFrame:
    """Packed tokens by fragment of their word; see _BLOBS for the arrays of a row."""
    schema = pa.schema([
        ("fragment", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()),
        ("unnamed", pa.binary()), *[(c, pa.binary()) for c in _BLOBS]])

    def block(part):
        # a function of its own, so that a block's arrays go before the next one is made
        hashes, firsts = wordhash.column_words(part.column("text"))
        n = len(part)
        # an end behind each text's words; before a text's first word stands the beginning
        tokens = np.insert(hashes, firsts[1:], END)
        starts = firsts[:-1] + np.arange(n)
        sizes = np.diff(firsts) + 1
        row = np.repeat(np.arange(n), sizes)
        vocabulary, word = np.unique(tokens, return_inverse=True)
        context = np.empty(len(tokens), dtype=np.int64)
        context[1:] = word[:-1]
        context[starts] = len(vocabulary)
        # contexts go by 40 bits; a clash lets two contexts share a restaurant
        known = np.append(vocabulary, BEGIN) >> _U(24)
        # equal (word, context, row) become one entry with a count
        key = word * (len(vocabulary) + 1) + context
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])])
        count = np.diff(np.r_[new, len(key)])
        key, row = key[new], row[new]
        pair = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        entries = np.diff(np.r_[pair, len(key)])
        pair_word, pair_context = np.divmod(key[pair], len(vocabulary) + 1)
        ids = part.column("doc_id").to_pylist()
        unnamed = np.packbits([i is None for i in ids])
        training = np.packbits([is_training(i) for i in ids])
        numbers = np.array([0 if i is None else i for i in ids], dtype="<i8")
        digest = hashlib.blake2b(digest_size=8)
        for values in (tokens, starts, numbers, unnamed):
            digest.update(np.ascontiguousarray(values).data)
        me = (TaskContext.get().partitionId(), int.from_bytes(digest.digest(), "little", signed=True), n)
        edge = np.searchsorted(_part(vocabulary[pair_word], fragments), np.arange(fragments + 1))
        first = np.r_[pair, len(key)]
        rows = []
        for f in range(fragments):
            x, y = edge[f], edge[f + 1]
            if x == y:
                continue
            ws, per_word = np.unique(pair_word[x:y], return_counts=True)
            cs, at = np.unique(pair_context[x:y], return_inverse=True)
            mine = slice(first[x], first[y])
            places, entered, rows_of, counts = (
                _shrink(v.astype("<u4")) for v in (at, entries[x:y], row[mine], count[mine]))
            blobs = [_shrink(vocabulary[ws].astype("<u8")), _shrink(per_word.astype("<u4")), _pack(known[cs]),
                     places, entered, rows_of, counts, training.tobytes()]
            rows.append([f, *me, b"", b"", *blobs])
        # every block has end tokens, so it has rows
        rows[me[1] % len(rows)][4:6] = _shrink(numbers), unnamed.tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches):
        for batch in batches:
            for a, b in wordhash.slices(batch, "text", BLOCK_BYTES):
                yield block(batch.slice(a, b - a))
                pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(
        run, f"fragment long, {_BLOCK}, " + ", ".join(f"{c} binary" for c in _BLOBS))


def _uniform(words: np.ndarray, contexts: np.ndarray, sweep: int, step: int) -> np.ndarray:
    x = wordhash.mix(words ^ wordhash.mix(contexts + _U((sweep * 1_000_003 + step) & 0xFFFFFFFF)))
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def seat(counts: np.ndarray, mass: np.ndarray, discount: float, words: np.ndarray, contexts: np.ndarray,
         sweep: int) -> np.ndarray:
    """Tables of dishes with more than one customer, who sat down one after the other.

    A customer opens a table with chance mass / (mass + customers - discount * tables); ``mass`` is the
    parent's part of the predictive weight. Beyond SINGLY customers, blocks sit down at once.
    """
    tables = np.ones(len(counts), dtype=np.int32)
    open_ = np.arange(len(counts))
    k = 1
    while len(open_):
        size = 1 if k < SINGLY else k
        many = np.minimum(size, counts[open_] - k)
        new = mass[open_] / (mass[open_] + k + (many - 1) / 2 - discount * tables[open_])
        u = _uniform(words[open_], contexts[open_], sweep, k)
        tables[open_] += np.minimum(many, np.floor(many * new + u)).astype(np.int32)
        k += size
        open_ = open_[counts[open_] > k]
    return tables


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    # the parts are sorted, which a stable sort makes use of; numpy's unique would hash them
    out = np.concatenate(parts)
    out.sort(kind="stable")
    return out[np.flatnonzero(np.r_[True, out[1:] != out[:-1]])] if len(out) else out


def _union(parts) -> np.ndarray:
    """The distinct values of many sorted arrays, sorted; a few of them are held at a time."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size > max(2 * len(held[0]), 500_000):
            held = [_distinct(held)]
            size = len(held[0])
    return _distinct(held)


class _Fragment:
    """The customers of a fragment's words by pair (word, context), pairs in the order of word and context."""

    def __init__(self, words: np.ndarray, contexts: np.ndarray, pairs: np.ndarray, customers: np.ndarray):
        self.words, self.contexts = words, contexts
        self.word, self.context = (x.astype(np.int32) for x in np.divmod(pairs, max(1, len(contexts))))
        self.customers = customers.astype(np.int64)
        self.word_count = np.bincount(self.word, self.customers, len(words)).astype(np.int64)
        self.context_count = np.bincount(self.context, self.customers, len(contexts)).astype(np.int64)
        self.n, self.known = int(self.word_count.sum()), int((self.word_count > 0).sum())

    def packed(self) -> list[bytes]:
        per_word = np.bincount(self.word, minlength=len(self.words))
        return [_shrink(self.words), _shrink(per_word.astype("<u4")), _pack(self.contexts),
                _shrink(self.context.astype("<u4")), _shrink(self.customers.astype("<u8"))]

    @classmethod
    def unpacked(cls, rows: pa.Table) -> _Fragment:
        words, per_word, contexts, context, customers = (rows.column(c)[0].as_buffer() for c in _PAIR_BLOBS)
        words, contexts = _grown(words, "<u8"), _unpack(contexts)
        pairs = np.repeat(np.arange(len(words)), _grown(per_word, "<u4")) * len(contexts) + _grown(context, "<u4")
        return cls(words, contexts, pairs, _grown(customers, "<u8"))

    def unseated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What stands before the first sweep, one table for every dish; as :meth:`sweep` returns it."""
        tables = (self.customers > 0).astype(np.int32)
        return tables, np.bincount(self.word, tables, len(self.words)).astype(np.int64), (self.word_count > 0).astype(np.int32)

    def sweep(self, number: int, before: _Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A sweep given the sums of the one before: tables of each pair, and each word's customers and
        tables in the parent restaurant."""
        if number == 0:
            parent = (self.word_count + 0.1) / (before.n + 0.1 * (before.known + 1))
        else:
            parent = before.parent(*before.own)
        several = np.flatnonzero(self.customers > 1)
        word, context = self.word[several], self.context[several]
        mass = (STRENGTH + DISCOUNT * before.tables)[context] * parent[word]
        tables = (self.customers > 0).astype(np.int32)
        tables[several] = seat(self.customers[several], mass, DISCOUNT, self.words[word], self.contexts[context], number)
        sent = np.bincount(self.word, tables, len(self.words)).astype(np.int64)
        above = (sent > 0).astype(np.int32)
        some = np.flatnonzero(sent > 1)
        above[some] = seat(sent[some], np.full(len(some), before.base), PARENT_DISCOUNT, self.words[some], self.words[some], number)
        return tables, sent, above


class _Opened(_Fragment):
    """A fragment with the blocks that its tokens came in.

    Entries (pair, row) stay in their blocks; only pairs are put together, so a word that most documents have takes
    the room of its contexts.
    """

    def __init__(self, rows: pa.Table):
        pa.default_memory_pool().release_unused()
        # views of Arrow's own memory, opened one block at a time
        columns = [[x.as_buffer() for x in rows.column(c)] for c in _BLOBS]
        self.blocks = [dict(zip([*_BLOBS, "n"], r, strict=True)) for r in zip(*columns, rows.column("n").to_pylist(), strict=True)]
        words = _union(_grown(b["words"], "<u8") for b in self.blocks)
        contexts = _union(_unpack(b["contexts"]) for b in self.blocks)
        pairs = _union(self._keys(b, words, contexts) for b in self.blocks)
        self.pairs = [np.searchsorted(pairs, self._keys(b, words, contexts)).astype(np.int32) for b in self.blocks]
        customers = np.zeros(len(pairs), dtype=np.int64)
        for block, at in zip(self.blocks, self.pairs, strict=True):
            entries, row, count = self.entries(block)
            seated = np.unpackbits(np.frombuffer(block["training"], np.uint8))[row] * count
            # a pair stands once in a block, with at least one entry
            customers[at] += np.add.reduceat(seated, np.cumsum(entries) - entries)
        super().__init__(words, contexts, pairs, customers)

    @staticmethod
    def _keys(block: dict, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """A block's pairs as numbers: place of the word, then of the context."""
        word = np.searchsorted(words, _grown(block["words"], "<u8"))
        context = np.searchsorted(contexts, _unpack(block["contexts"]))
        at = _grown(block["pair_context"], "<u4")
        return np.repeat(word, _grown(block["word_pairs"], "<u4")) * len(contexts) + context[at]

    @staticmethod
    def entries(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A block's entries per pair, and each entry's row in the block and count."""
        return (_grown(block["pair_entries"], "<u4").astype(np.int64), _grown(block["entry_row"], "<u4"),
                _grown(block["entry_count"], "<u4").astype(np.int64))

    def per_row(self, *of_pair: np.ndarray):
        """For each block the rows of it that are here, their tokens, and their sums of every given value of the pairs."""
        for block, at in zip(self.blocks, self.pairs, strict=True):
            entries, row, count = self.entries(block)
            tokens = np.bincount(row, count, block["n"])
            here = np.flatnonzero(tokens)
            yield [here, tokens[here], *[np.bincount(row, np.repeat(v[at], entries) * count, block["n"])[here] for v in of_pair]]


#: A fragment's pairs without their documents: all that the sweeps need.
_PAIR_BLOBS = ["words", "word_pairs", "contexts", "pair_context", "customers"]


def _pairs_of(key: tuple, rows: pa.Table) -> pa.Table:
    return pa.table({"fragment": pa.array([key[0].as_py()], pa.int64()),
                     **{c: pa.array([x], pa.binary()) for c, x in zip(_PAIR_BLOBS, _Opened(rows).packed(), strict=True)}})


class _Sums:
    """Sums over all fragments, in the order of a fragment's contexts, and the fragment's own words."""

    def __init__(self, rows: pd.DataFrame):
        # each row has the contexts of one receiver, in their order
        rows = rows.sort_values("to")
        self.customers, self.tables = (np.concatenate([_grown(x, "<u8") for x in rows[c]]) for c in ("customers", "tables"))
        #: Customers and tables of the words in the parent restaurant.
        self.own = np.concatenate([_grown(x, "<i8") for x in rows["own"]]).reshape(2, -1)
        self.n, self.known, self.sent, self.above = (int(rows[c].iloc[0]) for c in _TOTALS)
        #: The parent's weight of any word, from the base.
        self.base = (PARENT_STRENGTH + PARENT_DISCOUNT * self.above) / (self.known + 1)

    def parent(self, sent: np.ndarray, above: np.ndarray) -> np.ndarray:
        return (sent - PARENT_DISCOUNT * above + self.base) / (PARENT_STRENGTH + self.sent)


#: Training tokens, words among them, customers and tables of the parent restaurant.
_TOTALS = ["n", "known", "sent", "above"]
_PARTS = "step long, fragment long, to long, contexts binary, customers binary, tables binary, own binary, n long, known long, sent long, above long"
_SUMS = _PARTS.replace("contexts binary, ", "")


def _send(step: int, fragments: int):
    """A fragment's part of every context's tables, after a sweep or (step 0) before the first; with the fragment's totals."""

    def run(key: tuple, rows: pa.Table, received: pa.Table | None = None) -> pa.Table:
        fragment = _Fragment.unpacked(rows)
        if step == 0:
            tables, sent, above = fragment.unseated()
        else:
            tables, sent, above = fragment.sweep(step - 1, _Sums(received.to_pandas()))
        me = key[0].as_py()
        own = _shrink(np.concatenate([sent, above]).astype("<i8"))
        sizes = np.bincount(fragment.context, tables, len(fragment.contexts)).astype("<u8")
        customers = fragment.context_count.astype("<u8")
        edge = np.searchsorted(_part(fragment.contexts << _U(24), fragments), np.arange(fragments + 1))
        out = []
        for g in range(fragments):
            mine = slice(edge[g], edge[g + 1])
            out.append((step, me, g, _pack(fragment.contexts[mine]), _shrink(customers[mine]) if step == 0 else b"",
                        _shrink(sizes[mine]), own if g == me else b"", fragment.n, fragment.known, int(sent.sum()), int(above.sum())))
        names = [c.split()[0] for c in _PARTS.split(", ")]
        return pa.Table.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)

    # Spark tells by the arguments whether the key is asked for
    return (lambda key, rows: run(key, rows)) if step == 0 else (lambda key, rows, received: run(key, rows, received))


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums per context over all fragments, sent back to each in its own order; totals over fragments."""
    contexts = [_unpack(x) for x in rows["contexts"]]
    known, at = np.unique(np.concatenate(contexts), return_inverse=True)
    ends = np.cumsum([0, *map(len, contexts)])
    out = rows[["step", "fragment", "to", "own"]].copy()
    for c in ("customers", "tables"):
        parts = np.concatenate([_grown(x, "<u8") for x in rows[c]])
        if len(parts):
            sums = np.bincount(at, parts, len(known)).astype("<u8")
            out[c] = [_shrink(sums[at[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        else:
            out[c] = [b""] * len(rows)
    for c in _TOTALS:
        out[c] = int(rows[c].sum())
    return out


#: A fragment's sums for the rows of a block that are there.
_SCORED = {"rows": "<u4", "counted": "<u4", "known": "<u4", "ends": "<u4", "base": "<f8", "score": "<f8"}
_SCORES = f"fragment long, {_BLOCK}, total long, " + ", ".join(f"{c} binary" for c in _SCORED)
_RESULT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(key: tuple, rows: pa.Table, received: pa.Table) -> pa.Table:
    fragment = _Opened(rows)
    sums = {step: _Sums(part) for step, part in received.to_pandas().groupby("step")}
    total = sums[0]
    chance = np.zeros(len(fragment.word))
    for sweep in range(SWEEPS - SAMPLES, SWEEPS):
        after = sums[sweep + 1]
        seated, sent, above = fragment.sweep(sweep, sums[sweep])
        parent = after.parent(sent, above)
        back = STRENGTH + DISCOUNT * after.tables.astype(np.float64)
        chance += (fragment.customers - DISCOUNT * seated + back[fragment.context] * parent[fragment.word]) / (
            STRENGTH + total.customers.astype(np.float64)[fragment.context])
    score = np.log10(chance / SAMPLES)
    base = np.log10((fragment.word_count + 0.1) / (total.n + 0.1 * (total.known + 1)))
    known, ends = (fragment.word_count > 0), fragment.words == END

    sent = [[_shrink(v.astype(kind)) for v, kind in zip(values, _SCORED.values(), strict=True)]
            for values in fragment.per_row(known[fragment.word], ends[fragment.word], base[fragment.word], score)]
    return pa.table({
        "fragment": pa.array([key[0].as_py()] * len(sent), pa.int64()),
        **{c: rows.column(c) for c in ("part", "block", "n", "ids", "unnamed")},
        "total": pa.array([total.n] * len(sent), pa.int64()),
        **{c: pa.array([x[i] for x in sent], pa.binary()) for i, c in enumerate(_SCORED)}})


def _put_together(parts: pa.Table) -> pa.Table:
    """The rows of a block from its fragments' sums; equal blocks of a partition have been added up."""
    parts = parts.sort_by("fragment")
    n = parts.column("n")[0].as_py()
    sums = {c: np.zeros(n) for c in list(_SCORED)[1:]}
    for part in parts.select(list(_SCORED)).to_pylist():
        at = _grown(part["rows"], "<u4")
        for c, values in sums.items():
            values[at] += _grown(part[c], _SCORED[c])
    named = [x for x in zip(parts.column("ids").to_pylist(), parts.column("unnamed").to_pylist(), strict=True) if x[0]]
    copies = len(named)
    if not copies or (sums["ends"] != copies).any():
        raise ValueError("a repeated task got other rows, or got them in another order: write docs to a table first")
    ids, unnamed = _grown(named[0][0], "<i8"), np.unpackbits(np.frombuffer(named[0][1], np.uint8), count=n).astype(bool)
    whole = {c: np.tile(np.rint(sums[c] / copies).astype(np.int64), copies) for c in ("counted", "known")}
    return pa.table({
        "doc_id": pa.array(np.tile(ids, copies), mask=np.tile(unnamed, copies)),
        "n_tokens": whole["counted"], "n_known": whole["known"],
        "train_tokens": np.full(n * copies, parts.column("total")[0].as_py(), dtype=np.int64),
        "base_score": np.tile(sums["base"] / copies, copies), "score": np.tile(sums["score"] / copies, copies)})


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = on_workers(docs.sparkSession)
    fragments = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # read for the pairs and for the scores, and the pairs by every step below: two shuffles, which Spark uses again
    tokens = _blocks(docs, fragments).repartition(fragments, "fragment")
    pairs = tokens.groupBy("fragment").applyInArrow(
        _pairs_of, "fragment long, " + ", ".join(f"{c} binary" for c in _PAIR_BLOBS)).repartition(fragments, "fragment")
    steps = []
    for step in range(SWEEPS + 1):
        rows = pairs.groupBy("fragment")
        if step:
            rows = rows.cogroup(steps[-1].groupBy("fragment"))
        sums = rows.applyInArrow(_send(step, fragments), _PARTS).groupBy("to").applyInPandas(_add, _SUMS)
        # a shuffle of its own, so that the next sweep and the scores read the same sums
        steps.append(sums.repartition(fragments, "fragment"))
    needed = steps[0]
    for step in range(max(1, SWEEPS - SAMPLES), SWEEPS + 1):
        needed = needed.unionByName(steps[step])
    parts = tokens.groupBy("fragment").cogroup(needed.groupBy("fragment")).applyInArrow(_score, _SCORES)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))
    return parts.groupBy("part", "block").applyInArrow(_put_together, _RESULT).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
