"""N-gram Jaccard join in the metric space of shingle sets (dealt operator 1).

Documents are sets of word shingles under the Jaccard distance; two are linked
within distance ``1 - percent / 100``.  Unrelated texts all lie at distance 1
from each other, so whole documents alone make poor first pivots; the join
therefore has two levels of pivots.

Regions by one-element pivots.  Every shingle is a pivot, the point {s}.  A
document's pivots are its own shingles, in one order for all documents: rare
first, by a fixed-size count sketch of the whole corpus.  Write r(x, s) for
the number of x's shingles before s, which is the symmetric difference of x
and the empty set among the shingles before s.  The nearest pivot (r = 0) is
the document's Voronoi region; it is replicated over the window r(x, s) <= n -
ceil(percent * n / 100), because linked sets have at most so many shingles of
x outside the other.  If s is the first pivot that x and y share, they are
disjoint before it, so r(x, s) + r(y, s) equals their symmetric difference
there, and by the triangle inequality is at most the largest symmetric
difference of linked sets, (100 - percent) / (100 + percent) * (n(x) + n(y)).
Every linked pair shares a region; pairs that break this bound or the sizes'
are dropped unseen.

Small regions give candidate pairs.  A set's count vector (how many shingles
fall into each of about n / 4 hash cells) is a contraction of the metric: the
vectors' L1 distance never exceeds the symmetric difference.  Pairs whose
vectors are too far apart are dropped; the rest are verified on whole sets.
Large regions join recursively: documents of the region become pivots, each
document goes to the cell of the nearest by Jaccard distance and is replicated
to every pivot at most 2 * radius further away (triangle inequality), until a
cell is small enough for one exact matrix product of its incidence matrix.  A
region of more than ``CELL`` documents is dealt in pairs of blocks to several
tasks.  All steps are exact; copies of one set are one point throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from liftlake.llm.components import components, forest
from liftlake.llm.exact import _ident as ident, _with_locator as with_locator, keep_first  # noqa: F401
from liftlake.llm.membership import id_filter
from liftlake.llm.runtime import column, map_slices, slices, written
from liftlake.llm.words import SPACE_SPLIT, byte_view, mix64, shingles, words

WORDS, PERCENT = 5, 80
#: Cells of the count sketch that orders the pivots (fixed: 4 bytes each).
SKETCH_BITS = 20
#: Regions up to this many sets give candidate pairs; larger ones are joined
#: by recursion, in blocks of at most about CELL sets.
PAIR_REGION = 64
CELL = 1000
#: Sets that one matrix product takes without further pivots.
LEAF = 256
_BLOCK = 1 << 12


def _sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    h, first = words(*byte_view(texts), SPACE_SPLIT)
    s, doc, _ = shingles(h, first, k)
    return s, doc


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def count_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How many shingles of the corpus fall into each cell of a fixed-size
    table.  A task sends one table, in blocks; blocks are summed in two steps
    so that no task gets more than a share of them."""
    n_blocks = (1 << SKETCH_BITS) // _BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                s, _ = _sets(column(part, "text"), k)
                total += np.bincount(_cells(s), minlength=len(total))
        if total.any():
            task = int(mix64(total[:16].astype(np.uint64)).sum(dtype=np.uint64) % np.uint64(64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n_blocks), pa.int64()), pa.array(np.full(n_blocks, task), pa.int64()),
                 pa.array([x.tobytes() for x in total.astype(np.uint32).reshape(n_blocks, _BLOCK)], pa.binary())],
                names=["block", "salt", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_BLOCK, np.uint64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(x, np.uint32)
        return pa.table([table.column("block")[:1], table.column("salt")[:1],
                         pa.array([np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())],
                        names=["block", "salt", "counts"])
    kind = "block long, salt long, counts binary"
    some = docs.select("text").mapInArrow(count, kind).groupBy("block", "salt").applyInArrow(add, kind)
    rows = some.groupBy("block").applyInArrow(add, kind).collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in rows:
        out[r.block * _BLOCK:(r.block + 1) * _BLOCK] = np.frombuffer(r.counts, np.uint32)
    return out


def _ordered(s: np.ndarray, doc: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pivots of each document in the common order: the sketch's count
    (16 bits) above 48 bits of the shingle's hash."""
    rare = np.minimum(sketch[_cells(s)], 0xFFFF).astype(np.uint64)
    pivot = (rare << np.uint64(48)) | (s & np.uint64((1 << 48) - 1))
    order = np.lexsort((s, pivot, doc))
    s, doc, pivot = s[order], doc[order], pivot[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return pivot[new], doc[new]


def _vectors(pivot: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Count vectors of sets laid end to end: bytes, a power of two of cells
    by the set's size; neighbouring cells of one vector are halves of a cell of
    the next smaller kind."""
    bits = np.maximum(4, np.ceil(np.log2(np.maximum(n, 1) / 4)).astype(np.int64))
    width = np.where(n > 0, 1 << bits, 0)
    base = np.cumsum(width) - width
    owner = np.repeat(np.arange(len(n)), n)
    cell = (mix64(pivot) >> (64 - bits[owner]).astype(np.uint64)).astype(np.int64)
    count = np.minimum(np.bincount(base[owner] + cell, minlength=int(width.sum())), 255).astype(np.uint8)
    return [count[a:a + w].tobytes() for a, w in zip(base, width)]


def _may_link(percent: int):
    """Drops pairs whose count vectors are further apart than linked sets are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n1, n2 in zip(column(batch, "x"), column(batch, "y"), column(batch, "n1").to_pylist(), column(batch, "n2").to_pylist()):
                p, q = (np.frombuffer(z.as_buffer(), np.uint8).astype(np.int32) for z in (x, y))
                while len(p) > len(q):
                    p = p.reshape(-1, 2).sum(1)
                while len(q) > len(p):
                    q = q.reshape(-1, 2).sum(1)
                keep.append(int(np.abs(p - q).sum()) * (100 + percent) <= (100 - percent) * (n1 + n2))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _keys(pivot: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Keys of whole sets laid end to end."""
    key = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        key[some] = np.add.reduceat(mix64(pivot), start[some])
    return mix64(key + n.astype(np.uint64)).view(np.int64)


def set_table(docs: DataFrame, sketch: np.ndarray, k: int, percent: int) -> DataFrame:
    """doc_id, file and row (where the text is found), n (set size), key (of the
    whole set), pivots (the window's, packed) and vector (cell counts)."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pivot, doc = _ordered(*_sets(column(part, "text"), k), shared.value)
        n = np.bincount(doc, minlength=part.num_rows)
        start = np.cumsum(n) - n
        window = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
        packed = [pivot[a:a + w].tobytes() for a, w in zip(start, window)]
        yield pa.RecordBatch.from_arrays(
            [column(part, "doc_id"), column(part, "file"), column(part, "row"), pa.array(n, pa.int64()),
             pa.array(_keys(pivot, n, start), pa.int64()), pa.array(packed, pa.binary()), pa.array(_vectors(pivot, n), pa.binary())],
            names=["doc_id", "file", "row", "n", "key", "pivots", "vector"])
    return map_slices(docs, run, "doc_id long, file string, row long, n long, key long, pivots binary, vector binary")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each set and pivot of its window; a task's copies of a set
    count once."""
    seen: set = set()
    for batch in batches:
        keys = column(batch, "key").to_numpy()
        sizes = column(batch, "n").to_numpy()
        packed = column(batch, "pivots")
        fresh = []
        for i, key in enumerate(keys.tolist()):
            if key not in seen and sizes[i]:
                seen.add(key)
                fresh.append(i)
        for a in range(0, len(fresh), 2000):
            some = fresh[a:a + 2000]
            each = [np.frombuffer(packed[i].as_buffer(), np.int64) for i in some]
            count = np.array([len(x) for x in each])
            rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(each)), pa.array(np.repeat(keys[some], count)),
                 pa.array((np.repeat(sizes[some], count) << 32) | rank)], names=["pivot", "key", "size_rank"])


def _regions(percent: int):
    """Groups of a sorted partition: candidate pairs of small regions, and the
    members of large ones (region, a = key, b = size of the region)."""
    def close(n1, r1, n2, r2):
        return ((100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))
                & ((r1 + r2) * (100 + percent) <= (100 - percent) * (n1 + n2)))

    def groups(pivot, key, size_rank):
        order = np.lexsort((key, pivot))
        pivot, key, size_rank = pivot[order], key[order], size_rank[order]
        new = np.ones(len(key), bool)
        new[1:] = (pivot[1:] != pivot[:-1]) | (key[1:] != key[:-1])
        pivot, key, size_rank = pivot[new], key[new], size_rank[new]
        edge = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1], True])
        size = np.diff(edge)
        a, b, region = [], [], []
        # pairs at distance 1, 2, ... within their region, all regions together
        left = np.repeat(edge[1:], size) - np.arange(len(pivot)) - 1
        left[np.repeat(size, size) > PAIR_REGION] = 0
        at = np.flatnonzero(left > 0)
        step = 1
        while len(at):
            x, y = size_rank[at], size_rank[at + step]
            ok = close(x >> 32, x & 0xFFFFFFFF, y >> 32, y & 0xFFFFFFFF)
            a.append(key[at][ok])
            b.append(key[at + step][ok])
            step += 1
            at = at[left[at] >= step]
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1) if a else np.zeros((2, 0), np.int64)
        big = np.repeat(size, size) > PAIR_REGION
        region = np.concatenate([np.zeros(pairs.shape[1], np.int64), pivot[big]])
        flag = np.r_[np.zeros(pairs.shape[1], bool), np.ones(int(big.sum()), bool)]
        return pa.RecordBatch.from_arrays(
            [pa.array(flag), pa.array(region), pa.array(np.concatenate([pairs[0], key[big]])),
             pa.array(np.concatenate([pairs[1], np.repeat(size, size)[big]]))], names=["large", "region", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        rows = 0
        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows < 1_000_000:
                continue
            cols = [np.concatenate([b.column(i).to_numpy() for b in kept]) for i in range(3)]
            stop = int(np.searchsorted(cols[0], cols[0][-1], "left"))   # the last group may go on
            if stop:
                yield groups(*(c[:stop] for c in cols))
            kept = [pa.RecordBatch.from_arrays([pa.array(c[stop:]) for c in cols], names=["pivot", "key", "size_rank"])]
            rows = len(cols[0]) - stop
        if rows:
            yield groups(*(np.concatenate([b.column(i).to_numpy() for b in kept]) for i in range(3)))
    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices; only shingles
    of two sets or more have a column, some thousand at a time."""
    both = left + (right or [])
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    names, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    col = np.cumsum(count > 1) - 1
    keep = count[at] > 1
    col, owner = col[at[keep]], owner[keep]
    m = len(left)
    out = np.zeros((m, len(right) if right is not None else m), np.float32)
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    for base in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        lo, hi = np.searchsorted(col, [base, base + 4096])
        x = np.zeros((len(both), 4096), np.float32)
        x[owner[lo:hi], col[lo:hi] - base] = 1
        out += x[:m] @ (x[m:] if right is not None else x).T
    return out


def _linked(inter: np.ndarray, n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (n1[:, None] + n2[None] - inter)


def join_cell(sets: list[np.ndarray], home: np.ndarray, percent: int, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links (as indices) between the home sets of a cell and all its sets."""
    n = np.array([len(x) for x in sets], float)
    m = len(sets)
    if m > LEAF and depth < 12 and home.any():
        radius = 1 - percent / 100
        # pivots: home sets spread over the cell by their size and place
        own = np.flatnonzero(home)
        pick = own[np.linspace(0, len(own) - 1, min(8, len(own))).astype(int)]
        pivots = [sets[i] for i in np.unique(pick)]
        inter = _overlaps(sets, pivots)
        far = 1 - inter / (n[:, None] + np.array([len(x) for x in pivots])[None] - inter)
        near, cell = far.min(1), far.argmin(1)
        parts = []
        for c in range(len(pivots)):
            inside = far[:, c] - near <= 2 * radius + 1e-6
            if inside.any():
                parts.append((np.flatnonzero(inside), home & (cell == c)))
        if max(len(p) for p, _ in parts) <= 0.8 * m:
            found = [(rows[a], rows[b]) for rows, own in parts if own.any()
                     for a, b in [join_cell([sets[i] for i in rows], own[rows], percent, depth + 1)]]
            return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
    rows = np.flatnonzero(home)
    link = _linked(_overlaps([sets[i] for i in rows], sets), n[rows], n, percent)
    a, b = np.nonzero(link)
    a = rows[a]
    return a[a != b], b[a != b]


def _join_region(percent: int):
    def run(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in table.column("items")]
        order = np.lexsort((keys, [len(x) for x in sets]))
        keys, sets = keys[order], [sets[i] for i in order]
        a, b = join_cell(sets, np.ones(len(sets), bool), percent)
        u, v = forest(keys[a], keys[b]) if len(a) else (np.zeros(0, np.int64),) * 2
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(column(batch, "x"), column(batch, "y")):
                p, q = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                inter = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * inter >= percent * (len(p) + len(q) - inter))
            kept = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, names=["u", "v"])
    return run


def jaccard_links(docs: DataFrame, table: DataFrame, sketch: np.ndarray, k: int, percent: int) -> DataFrame:
    """(u, v): keys of sets; every linked pair of different sets is connected
    by these links (a cell gives a spanning forest of its links)."""
    spark = docs.sparkSession
    # the key of a pivot's region is uniform, so plain hash partitions are even
    members = table.where("n > 0").select("n", "key", "pivots").mapInArrow(_members, "pivot long, key long, size_rank long")
    found = written(members.repartition("pivot").sortWithinPartitions("pivot")
                    .mapInArrow(_regions(percent), "large boolean, region long, a long, b long"), "jaccard-regions")
    pairs = found.where("not large").select("a", "b").distinct()
    paired = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    vectors = table.where("n > 0").join(paired, "key", "left_semi").dropDuplicates(["key"]).select("key", "n", "vector")
    pairs = written(pairs.join(vectors.select(F.col("key").alias("a"), F.col("n").alias("n1"), F.col("vector").alias("x")), "a")
                    .join(vectors.select(F.col("key").alias("b"), F.col("n").alias("n2"), F.col("vector").alias("y")), "b")
                    .select("a", "b", "n1", "n2", "x", "y").mapInArrow(_may_link(percent), "a long, b long"), "jaccard-near")
    large = found.where("large").select("region", F.col("a").alias("key"), F.col("b").alias("m"))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(large.select("key")).distinct()
    # whole sets, once each, of the sets that have a region with others; the
    # ids only spare other rows the work, the set's key decides
    reps = table.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    reps = written(reps.join(needed, "key", "left_semi"), "jaccard-needed")
    shared = spark.sparkContext.broadcast(sketch)

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for part in slices(batch, "text"):
                pivot, doc = _ordered(*_sets(column(part, "text"), k), shared.value)
                n = np.bincount(doc, minlength=part.num_rows)
                start = np.cumsum(n) - n
                keys, fresh = _keys(pivot, n, start), []
                for i in np.flatnonzero(n).tolist():
                    if keys[i] not in seen:
                        seen.add(keys[i])
                        fresh.append(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[fresh], pa.int64()),
                     pa.array([np.sort(pivot[start[i]:start[i] + n[i]].view(np.int64)).tobytes() for i in fresh], pa.binary())],
                    names=["key", "items"])
    some = id_filter(docs.select("doc_id", "text"), reps.select("doc_id"))
    sets = written(some.mapInArrow(items, "key long, items binary").dropDuplicates(["key"])
                   .join(reps.select("key"), "key", "left_semi"), "jaccard-sets")
    checked = (pairs.join(sets.select(F.col("key").alias("a"), F.col("items").alias("x")), "a")
               .join(sets.select(F.col("key").alias("b"), F.col("items").alias("y")), "b")
               .select("a", "b", "x", "y").mapInArrow(_verify(percent), "u long, v long"))
    # a region of many sets is dealt in pairs of blocks
    blocks = F.ceil(F.col("m") / CELL).cast("int")
    dealt = (large.withColumn("block", F.pmod(F.xxhash64("key"), blocks.cast("long")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("region", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    joined = (dealt.join(sets, "key").select("region", "i", "j", "key", "items")
              .groupBy("region", "i", "j").applyInArrow(_join_region(percent), "u long, v long"))
    return checked.unionByName(joined)


def jaccard_classes(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, set_key, kept,
    and the row's locator (file, row).

    component_id is the smallest doc_id that links reach, the document itself
    included.  Texts without words, null and empty ones, have no shingle and
    are linked with nothing; a text of fewer than k words has one shingle, its
    whole sequence.  Repeated rows and equal sets are linked.  A row without
    an id takes its class's id, or null if nothing in the class has an id.
    Empty tables give an empty result; only doc_id and text are read.  Sets
    are known by 64-bit hashes of their shingles.

    One row of each class is kept, the first by id (null last) and then by file
    and row; a text without words is a class of its own.  A frame that is not
    read from files has no locators, as in ``exact_dedup``.
    """
    docs = with_locator(docs)
    sketch = count_sketch(docs, k)
    table = written(set_table(docs, sketch, k, percent), "jaccard-table")
    links = jaccard_links(docs, table, sketch, k, percent)
    roots = components(links)
    keys = table.where("n > 0").groupBy("key").agg(F.min(ident()).alias("first"))
    classed = keys.join(roots, keys["key"] == roots["node"], "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    lowest = classed.groupBy("root").agg(F.min("first").alias("keeper"))
    ids = classed.join(lowest, "root").select("key", "keeper")
    return (table.select("doc_id", "file", "row", "n", "key").join(ids, "key", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("component_id"),
                    F.col("key").alias("set_key"),
                    ((F.col("n") == 0) | ident().eqNullSafe(F.col("keeper"))).alias("kept"), "file", "row"))
