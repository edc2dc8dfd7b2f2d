"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is cut into fragments, and each fragment is handled apart:

1. Texts of equal n-gram sets form a class, represented by its smallest id.
2. For each fragment a task sees which of a class's n-grams other classes hold too, and counts them; the
   partial counts are summed per class. A class with too few shared n-grams can link with nothing, and
   most of a corpus ends here. Blocks of documents send an n-gram that they hold twice only once.
3. The remaining classes order their shared n-grams by frequency. Two classes can only link if they have an
   n-gram in common in their rare prefixes, at places that leave enough room (prefix, length and positional
   filter). First every class is compared with the most central member of each n-gram's group, which joins
   large groups of near copies without forming their pairs; then pairs are formed only between
   different components. A pair's overlap is counted by fragments and summed, on 64-bit hashes of whole n-grams.
4. Links are counted within components, which hold them all. Their sets are dealt into tiles, and a task gets two
   tiles, cuts their n-grams into the fragments of the order, counts each fragment's overlaps of all pairs as a product
   of two matrices, adds the products up, and returns a number of links per set. Pairs are no rows: what is moved grows with
   sets times tiles.

Sets, links and components stay distributed. Fragments are as many as ``spark.sql.shuffle.partitions``,
so they grow in number with the corpus, not in size.

Defined cases: a text without words has an empty set and links with nothing; a row without id links with
nothing and has no component; repeated rows are copies of one another; an empty table gives an empty
result. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm import wordhash
from codewarden.llm.common import on_workers, saved, sized, stored
from codewarden.llm.components import components

#: Fragments of the n-gram order in which a pair's overlap is counted (a power of two).
PAIR_FRAGMENTS = 8
#: Sets and n-grams of a tile, and the columns of a matrix.
TILE_SETS, TILE_GRAMS, COLUMNS = 1024, 2_000_000, 4096
_U = np.uint64


def _sets(batch: pa.RecordBatch, words: int):
    """(doc ids, sets) of the slices of a batch."""
    for a, b in wordhash.slices(batch, "text"):
        part = batch.slice(a, b - a)
        hashes, firsts = wordhash.column_words(part.column("text"))
        yield part.column("doc_id"), wordhash.ngrams(hashes, firsts, words)


def _digest(grams: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def document_sets(docs: DataFrame, words: int, with_grams: bool = False) -> DataFrame:
    """doc_id, n (set size), k1 and k2 (digest of the set), and the sorted n-gram hashes if asked for."""

    def run(batches):
        for batch in batches:
            for ids, sets in _sets(batch, words):
                keys = [_digest(s) for s in sets]
                columns = {"doc_id": ids, "n": pa.array([len(s) for s in sets], pa.int64()),
                           "k1": pa.array([k[0] for k in keys], pa.int64()),
                           "k2": pa.array([k[1] for k in keys], pa.int64())}
                if with_grams:
                    ends = np.cumsum([0, *map(len, sets)])
                    values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                    columns["grams"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n long, k1 long, k2 long" + (", grams array<long>" if with_grams else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _fragment_rows(docs: DataFrame, words: int, fragments: int) -> DataFrame:
    """Blocks of documents cut into fragments: (fragment, classes, inside, counts, grams, common).

    ``grams`` has the n-grams that one class of the block holds, ``counts`` of them for each of
    ``classes``; ``inside`` tells how many more a class holds that another class of the block holds too,
    and ``common`` has those once. An n-gram is written in 32 bits besides its fragment; a clash only
    makes an n-gram look shared.
    """
    schema = pa.schema([("fragment", pa.int64()), *[(c, pa.binary()) for c in (
        "classes", "inside", "counts", "grams", "common")]])

    def parts(grams):
        return ((grams >> _U(32)) * _U(fragments) >> _U(32)).astype(np.int64), (grams & _U(0xFFFFFFFF)).astype("<u4")

    def run(batches):
        for batch in batches:
            for ids, sets in _sets(batch, words):
                own = {}
                for i, s in zip(ids.is_valid().to_pylist(), sets, strict=True):
                    if i and len(s):
                        own.setdefault(_digest(s)[0], s)
                if not own:
                    continue
                classes = np.array(list(own), dtype="<i8")
                grams = np.concatenate(list(own.values()))
                holder = np.repeat(np.arange(len(classes)), [len(s) for s in own.values()])
                order = np.argsort(grams, kind="stable")
                grams, holder = grams[order], holder[order]
                starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
                sizes = np.diff(np.r_[starts, len(grams)])
                single = np.repeat(sizes == 1, sizes)
                part, low = parts(grams)
                cells = part * len(classes) + holder
                cell, counts = np.unique(cells, return_counts=True)
                singles = np.bincount(np.searchsorted(cell, cells[single]), minlength=len(cell))
                mine = np.flatnonzero(single)[np.argsort(cells[single], kind="stable")]
                shared_part, shared_low = parts(grams[starts[sizes > 1]])
                edges = np.arange(fragments + 1)
                at = np.searchsorted(cell, edges * len(classes))
                taken = np.r_[0, np.cumsum(singles)]
                common = np.searchsorted(shared_part, edges)
                rows = []
                for f in range(fragments):
                    x, y = at[f], at[f + 1]
                    if x < y:
                        rows.append((f, classes[cell[x:y] % len(classes)].tobytes(),
                                     (counts - singles)[x:y].astype("<u4").tobytes(),
                                     singles[x:y].astype("<u4").tobytes(),
                                     low[mine[taken[x]:taken[y]]].tobytes(),
                                     shared_low[common[f]:common[f + 1]].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        run, "fragment long, classes binary, inside binary, counts binary, grams binary, common binary")


def _packed(classes: np.ndarray, shared: np.ndarray, buckets: int) -> pd.DataFrame:
    """Partial counts by class, one row for each bucket of classes."""
    bucket = classes.view(np.uint64) % _U(buckets)
    order = np.argsort(bucket, kind="stable")
    classes, shared, edge = classes[order], shared[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(edge))
    return pd.DataFrame({
        "bucket": some, "classes": [classes[edge[b]:edge[b + 1]].tobytes() for b in some],
        "shared": [shared[edge[b]:edge[b + 1]].astype("<u4").tobytes() for b in some]})


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """The partial counts of a bucket's classes, summed over the fragments."""
    classes = np.concatenate([np.frombuffer(x, "<i8") for x in rows["classes"]])
    shared = np.concatenate([np.frombuffer(x, "<u4") for x in rows["shared"]])
    classes, at = np.unique(classes, return_inverse=True)
    return pd.DataFrame({"k1": classes, "shared": np.bincount(at, shared).astype(np.int64)})


def _shared_in_fragment(rows: pd.DataFrame, buckets: int, half: bool) -> pd.DataFrame:
    """How many n-grams of a class other classes hold too; with ``half`` for classes that share at least half of theirs."""
    def whole(column, kind):
        return np.concatenate([np.frombuffer(x, kind) for x in rows[column]])

    classes, inside, counts = whole("classes", "<i8"), whole("inside", "<u4"), whole("counts", "<u4")
    common = whole("common", "<u4")
    record = np.r_[np.repeat(np.arange(len(classes)), counts), np.full(len(common), -1)]
    grams = np.r_[whole("grams", "<u4"), common]
    order = np.argsort(grams, kind="stable")
    grams, record = grams[order], record[order]
    holder = np.where(record >= 0, classes[record], 0)
    starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    shared = np.minimum.reduceat(holder, starts) != np.maximum.reduceat(holder, starts)
    shared |= np.minimum.reduceat(record, starts) < 0
    shared = np.repeat(shared, np.diff(np.r_[starts, len(grams)]))
    found = np.bincount(record[shared & (record >= 0)], minlength=len(classes)) + inside
    some = 2 * found >= counts + inside if half else found > 0
    # copies of a class in several blocks count once
    out = pd.Series(found[some]).groupby(classes[some]).max()
    return _packed(out.index.to_numpy(np.int64), out.to_numpy(np.int64), buckets)


def _linked(a, b, both, percent: int):
    return 100 * both >= percent * (a + b - both)


def similar_links(docs: DataFrame, sets: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between class representatives that connect all classes that any links connect.

    Also the sets (doc_id, n, parts) of all that may have links, cut into fragments of the n-gram order.
    ``sets`` is the saved result of :func:`document_sets`, without rows that have no id or no n-gram.
    """
    spark = docs.sparkSession
    fragments = int(spark.conf.get("spark.sql.shuffle.partitions"))
    classes = saved(sets.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")))
    shared = (
        _fragment_rows(docs, words, fragments).repartition(fragments, "fragment")
        .groupBy("fragment").applyInPandas(
            lambda rows: _shared_in_fragment(rows, fragments, percent >= 50), "bucket long, classes binary, shared binary")
        .groupBy("bucket").applyInPandas(_summed, "k1 long, shared long")
    )
    # from half on, a fragment of which a class shares less than half is not told; with at most (1 - t) n n-grams
    # missing in all, such fragments hide as many shared ones at the most
    least = 2 * percent - 100 if percent >= 50 else percent
    able = saved(classes.join(shared, "k1").where(100 * F.col("shared") >= least * F.col("n")).select(
        F.col("rep").alias("doc_id"), "k1", "k2"))

    # the sets of the classes that may link, cut down to the n-grams that two of them hold
    some = docs.select("doc_id", "text").join(sized(able.select("doc_id").distinct()), "doc_id", "left_semi")
    full = document_sets(some, words, with_grams=True).join(able, ["doc_id", "k1", "k2"], "left_semi")
    full = full.dropDuplicates(["doc_id", "k1", "k2"]).select("doc_id", "n", F.explode("grams").alias("gram"))
    full = stored(full, "grams")
    counts = saved(full.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"))
    held = full.join(counts, "gram").groupBy("doc_id", "n").agg(
        F.collect_list(F.struct("df", "gram")).alias("held"), (F.avg("df") * F.sum("df")).alias("central"))
    held = held.where(100 * F.size("held") >= percent * F.col("n"))
    held = held.withColumn("held", F.sort_array("held"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(PAIR_FRAGMENTS - 1)), lambda f: F.filter(
        F.transform("held", lambda x: x["gram"]), lambda g: F.shiftrightunsigned(g, 65 - PAIR_FRAGMENTS.bit_length()) == f))
    # prefix: with more than n - ceil(t n) of its rarest n-grams missing, a set cannot link
    rare = F.slice("held", F.lit(1), F.greatest(
        F.floor((100 - percent) * F.col("n") / 100) + 1 - F.col("n") + F.size("held"), F.lit(0)).cast("int"))
    held = stored(held.select("doc_id", "n", "central", (F.col("n") - F.size("held")).alias("alone"),
                              rare.alias("rare"), cut.alias("parts")), "sets")
    prefix = saved(held.select("doc_id", "n", "central", F.posexplode(F.transform("rare", lambda x: x["gram"])).alias(
        "i", "gram"), "alone").select("doc_id", "n", "central", "gram", (F.col("alone") + F.col("i") + 1).alias("at")))

    lengths = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("a") != F.col("b"))
    parts = held.select("doc_id", "parts")

    def overlaps(pairs):
        """Distinct (a, na, b, nb) with their overlap: partial overlaps by fragment, summed."""
        x = parts.select(F.col("doc_id").alias("a"), F.col("parts").alias("pa"))
        y = parts.select(F.col("doc_id").alias("b"), F.col("parts").alias("pb"))
        both = F.aggregate(F.zip_with("pa", "pb", lambda p, q: F.size(F.array_intersect(p, q))),
                           F.lit(0).cast("long"), lambda s, n: s + n)
        return pairs.join(x, "a").join(y, "b").select("a", "na", "b", "nb", both.alias("both"))

    def links(counted):
        return counted.where(_linked(F.col("na"), F.col("nb"), F.col("both"), percent)).select("a", "b")

    band = F.floor(F.log(F.col("n").cast("double")) * 8).alias("band")
    groups = prefix.select("*", band)
    centers = saved(groups.groupBy("gram", "band").agg(
        F.max_by(F.struct("doc_id", "n"), F.struct("central", -F.col("doc_id"))).alias("c"))
        .select("gram", "band", F.col("c.doc_id").alias("b"), F.col("c.n").alias("nb")))
    near = groups.join(centers, ["gram", "band"]).select(
        F.col("doc_id").alias("a"), F.col("n").alias("na"), "b", "nb").where(lengths).distinct()
    compared = saved(overlaps(near))
    first = links(compared)
    # each set's closest center and their overlap; a center has itself
    itself = compared.select(F.col("b").alias("doc_id"), F.col("b").alias("pivot"), F.col("nb").alias("with_pivot"))
    pivots = saved(compared.select(F.col("a").alias("doc_id"), F.col("b").alias("pivot"), F.col("both").alias("with_pivot"))
                   .union(itself).groupBy("doc_id").agg(F.max_by(
                       F.struct("pivot", "with_pivot"), F.struct("with_pivot", "pivot")).alias("p"))
                   .select(F.col("doc_id").alias("node"), "p.pivot", "p.with_pivot"))

    # what may still link two components
    labelled = prefix.join(components(first), F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n", "gram", "at", F.coalesce("label", "doc_id").alias("label"))
    labelled = saved(labelled.join(pivots, F.col("doc_id") == F.col("node"), "left").drop("node"))
    mixed = saved(labelled.groupBy("gram").agg(F.min("label").alias("l"), F.max("label").alias("h")).where(
        "l < h").select("gram"))
    open_rows = saved(labelled.join(mixed, "gram"))
    carried = ("doc_id", "n", "at", "label", "pivot", "with_pivot")
    a = open_rows.select("gram", *[F.col(c).alias(f"{c}_a") for c in carried])
    b = open_rows.select("gram", *[F.col(c).alias(f"{c}_b") for c in carried])
    # the smaller set's n-gram stands early enough, and both have room for the overlap a link needs
    smaller = F.struct("n_a", "doc_id_a") < F.struct("n_b", "doc_id_b")
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + 1
    # of a common pivot both hold a part: inside it they share the smaller part, outside the smaller rest, at most
    inside = F.least("with_pivot_a", "with_pivot_b")
    outside = F.least(F.col("n_a") - F.col("with_pivot_a"), F.col("n_b") - F.col("with_pivot_b"))
    room = F.when(F.col("pivot_a") == F.col("pivot_b"), F.least(room, inside + outside)).otherwise(room)
    pairs = a.join(b, "gram").where(
        smaller & (F.col("label_a") != F.col("label_b")) & (100 * F.col("n_a") >= percent * F.col("n_b"))
        & ((100 + percent) * room >= percent * (F.col("n_a") + F.col("n_b"))))
    pairs = pairs.select(F.col("doc_id_a").alias("a"), F.col("n_a").alias("na"),
                         F.col("doc_id_b").alias("b"), F.col("n_b").alias("nb")).distinct()
    return first.union(links(overlaps(pairs))), held.select("doc_id", "n", "parts")


def _overlaps(x: list[list[np.ndarray]], y: list[list[np.ndarray]]) -> np.ndarray:
    """Overlaps of all sets of ``x`` with all of ``y``, each given as its fragments: counted by fragment, and summed."""
    total = np.zeros((len(x), len(y)), dtype=np.float32)
    for f in range(PAIR_FRAGMENTS):
        sides = []
        for sets in (x, y):
            parts = [s[f] for s in sets]
            sides.append((np.concatenate([*parts, np.zeros(0, np.int64)]), np.repeat(np.arange(len(parts)), [len(p) for p in parts])))
        both = np.intersect1d(sides[0][0], sides[1][0])
        at = [np.searchsorted(both, grams) for grams, _ in sides]
        here = [np.flatnonzero(np.append(both, 0)[a] == grams) if len(both) else np.zeros(0, np.int64)
                for a, (grams, _) in zip(at, sides, strict=True)]
        for start in range(0, len(both), COLUMNS):
            product = []
            for k in range(2):
                some = here[k][(at[k][here[k]] >= start) & (at[k][here[k]] < start + COLUMNS)]
                matrix = np.zeros((total.shape[k], min(COLUMNS, len(both) - start)), dtype=np.float32)
                matrix[sides[k][1][some], at[k][some] - start] = 1
                product.append(matrix)
            total += product[0] @ product[1].T
    return total


def _tile_links(percent: int):
    """Numbers of linked rows of the sets of one pair of tiles, or of some components of one tile each."""

    def run(rows: pa.Table) -> pa.Table:
        ids, found = [], []
        rows = rows.sort_by([("component", "ascending"), ("tile", "ascending")])
        component = rows.column("component").to_numpy()
        edges = [*np.flatnonzero(np.r_[True, component[1:] != component[:-1]]).tolist(), len(component)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            part = rows.slice(low, high - low)
            sets = [[np.asarray(p, dtype=np.int64) for p in parts] for parts in part.column("parts").to_pylist()]
            tile, doc, n, times = (part.column(c).to_numpy() for c in ("tile", "doc_id", "n", "rows"))
            cut = int(np.searchsorted(tile, tile[0], "right"))
            # a pair of different tiles, or one tile with itself
            x, y = (slice(0, cut), slice(cut, None)) if part.column("other")[0].as_py() != part.column("one")[0].as_py() else (slice(None),) * 2
            both = _overlaps(sets[x], sets[y])
            linked = _linked(n[x][:, None], n[y][None, :], both, percent) & (doc[x][:, None] != doc[y][None, :])
            ids.append(doc[x])
            found.append(linked @ times[y])
            if x != y:
                ids.append(doc[y])
                found.append(linked.T @ times[x])
        return pa.table({"doc_id": np.concatenate(ids), "others": np.concatenate(found).astype(np.int64)})

    return lambda rows: run(rows)


def link_numbers(sets: DataFrame, labels: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(doc_id, others): for each set in a component how many rows of other sets it is linked with.

    ``sets``: doc_id, n, parts; ``labels``: node, label; ``sizes``: doc_id, rows.
    """
    buckets = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = sets.join(labels.select(F.col("node").alias("doc_id"), F.col("label").alias("component")), "doc_id")
    placed = stored(placed.join(sizes, "doc_id"), "placed")
    grams = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.size(p))
    tiles = placed.groupBy("component").agg(F.greatest(
        F.ceil(F.count("*") / TILE_SETS), F.ceil(F.sum(grams) / TILE_GRAMS)).cast("int").alias("tiles"))
    dealt = placed.join(saved(tiles), "component").withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
    # every tile meets every tile of its component once, itself included; small components share tasks
    dealt = dealt.withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    unit = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("component"), F.lit(buckets))).otherwise(F.col("component"))
    dealt = dealt.select(
        "component", "doc_id", "n", "rows", "parts", "tile", unit.alias("unit"), (F.col("tiles") == 1).alias("small"),
        F.least("tile", "meets").alias("one"), F.greatest("tile", "meets").alias("other"))
    counted = dealt.groupBy("small", "unit", "one", "other").applyInArrow(_tile_links(percent), "doc_id long, others long")
    return counted.groupBy("doc_id").agg(F.sum("others").alias("others"))


def join_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 words: int = 5, percent: int = 80, count_links: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, class_id (smallest id of equal sets), component_id, n_links.

    ``n_links`` is the number of other rows that the row is linked with, copies included; without ``count_links`` it
    is left out.
    """
    on_workers(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    every = saved(document_sets(docs, words))
    sets = every.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = saved(sets.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("rows")))
    found, cut = similar_links(docs, sets, words, percent)
    labels = components(saved(found))
    named = classes.join(labels, F.col("class_id") == F.col("node"), "left").select(
        "k1", "k2", "class_id", F.coalesce("label", "class_id").alias("component_id"), "rows")
    if count_links:
        sizes = classes.select(F.col("class_id").alias("doc_id"), "rows")
        others = link_numbers(cut, labels, sizes, percent).withColumnRenamed("doc_id", "one")
        named = named.join(others, F.col("class_id") == F.col("one"), "left").select(
            "k1", "k2", "class_id", "component_id", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    named = saved(named)
    linkable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    out = every.join(named, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(linkable, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
                      F.when(linkable, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      *[F.when(linkable, F.col("n_links")).otherwise(0).alias("n_links")][:count_links])


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The row with the smallest id of each component; rows without id stay, repeated rows (of equal id and text) go.

    Of several texts under one id, each is judged as a row of its own.
    """
    named = docs.where(F.col(doc_id).isNotNull()).withColumn("__node", F.xxhash64(doc_id, text))
    found = join_similar(named, "__node", text, words, percent, count_links=False)
    found = saved(found.select(F.col("doc_id").alias("__node"), "component_id").distinct())
    ids = named.select("__node", F.col(doc_id).alias("id")).distinct()
    grouped = saved(found.join(ids, "__node").select("component_id", F.struct("id", "__node").alias("row")))
    chosen = grouped.groupBy("component_id").agg(F.min("row").alias("first"))
    gone = saved(grouped.join(chosen, "component_id").where("row <> first").select("row.__node"))
    kept = named.join(gone, "__node", "left_anti").dropDuplicates([doc_id, "__node"])
    return kept.select(*docs.columns).unionByName(docs.where(F.col(doc_id).isNull()))
