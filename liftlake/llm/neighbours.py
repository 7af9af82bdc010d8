"""Embedding near-duplicates by a forest of random-projection trees (dealt operator 13).

Every tree splits the unit vectors at the median of a random projection, again
and again, with spill: vectors near a cut go to both sides.  Two vectors that
are close meet in a leaf of nearly every tree; leaves compare their vectors by
a matrix product in double precision, and all links are united.  A pair that
meets in several leaves counts in the first of them alone, which both rows know
from their lists of leaves, so links are counted and united without a row for
each pair.

Hot groups never reach the leaves whole.  Equal vectors are one row with a
weight.  Dense balls of near copies are cores: all members lie within half the
linking angle of a centre, so the triangle inequality links them without a
comparison; only rows just outside a core are compared with it, exactly.  Any
leaf or core with more rows than a block is compared block by block.

Cuts and centres come from a bounded sample (documented parameters); every row
is indexed and every accepted pair is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from liftlake.llm.components import components, forest as stars
from liftlake.llm.runtime import column, written

#: Least cosine of a link.
LINK = 0.95
TREES = 4
#: Values (rows x dimensions) of the sample that cuts and centres come from.
SAMPLE_VALUES = 1 << 22
#: Rows that a leaf should have, most levels of a tree, least sample rows of a cut.
LEAF_ROWS, DEEPEST, LEAST_SAMPLE = 1500, 14, 32
#: Rows of a block: a cell compares a block with itself or with another one.
BLOCK = 2048
#: Half the spill, in standard deviations of the projected difference of a pair at the threshold.
SPILL = 0.75
#: A core holds this share of the sample or more, and so many of its rows.
CORE_SHARE, CORE_ROWS, CORE_TRIED = 1 / 256, 64, 1024
#: Room for the rounding of angles.
EASE = 1e-6


def usable(vector: Column) -> Column:
    """Vectors that can link: not null or empty, every component finite, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a list array, a row each, in double precision."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x     # squares stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Forest:
    """Cuts of the trees (heap order: the children of i are 2i + 1 and 2i + 2),
    their leaves' numbers, and the centres of the cores."""
    link: float
    directions: np.ndarray
    spill: float
    cuts: list[np.ndarray] = field(default_factory=list)
    numbers: list[np.ndarray] = field(default_factory=list)
    leaves: int = 0
    centres: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @property
    def angle(self) -> float:
        return float(np.arccos(self.link))

    def drop(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf of every row, by row and ascending leaf."""
        rows, found = [], []
        for tree, (cut, number) in enumerate(zip(self.cuts, self.numbers)):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(DEEPEST + 1):
                done = number[node] >= 0
                rows.append(row[done])
                found.append(number[node[done]])
                row, node = row[~done], node[~done]
                if not len(row):
                    break
                p = x @ self.directions[:, tree * DEEPEST + level]
                left, right = p[row] < cut[node] + self.spill, p[row] >= cut[node] - self.spill
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        rows, found = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((found, rows))
        return rows[order], found[order]


def find_centres(x: np.ndarray, angle: float) -> np.ndarray:
    """Centres of dense balls of half the linking angle in a sample, densest
    first: each holds sample rows that no centre before it holds, one in 256
    or more of all, so there are at most 256."""
    left, found = np.ones(len(x), bool), []
    least, radius = max(CORE_ROWS, len(x) * CORE_SHARE), np.cos(angle / 2 - EASE)
    tried = x[:CORE_TRIED]
    near = tried @ x.T >= radius
    while len(found) < 1 / CORE_SHARE:
        held = near[:, left].sum(axis=1) if len(tried) else np.zeros(0)
        if not len(held) or held.max() < least:
            break
        centre = x[left & near[int(held.argmax())]].mean(axis=0)
        centre /= np.linalg.norm(centre)
        ball = left & (x @ centre >= radius)
        if ball.sum() < held.max():                       # the mean may lie worse
            centre, ball = tried[int(held.argmax())], left & near[int(held.argmax())]
        found.append(centre)
        left &= ~ball
    return np.array(found).reshape(-1, x.shape[1])


def fit(x: np.ndarray, rows: int, link: float = LINK, trees: int = TREES, seed: int = 13) -> Forest:
    """Trees and centres from a sample ``x`` of unit vectors out of ``rows``."""
    rng, dim = np.random.default_rng(seed), x.shape[1]
    way = rng.standard_normal((dim, trees * DEEPEST))
    way /= np.linalg.norm(way, axis=0)
    out = Forest(link, way, SPILL * np.sqrt((2 - 2 * link) / dim))
    out.centres = find_centres(x, out.angle)
    if len(out.centres):
        free = (x @ out.centres.T).max(axis=1) < np.cos(out.angle / 2 - EASE)
        rows, x = int(rows * free.mean()), x[free]
    for tree in range(trees):
        cut, number, todo, deep = {}, {}, [(0, np.arange(len(x)), 0)], 0
        p = x @ way[:, tree * DEEPEST:(tree + 1) * DEEPEST]
        while todo:
            node, own, level = todo.pop()
            split = None
            if len(own) >= LEAST_SAMPLE and len(own) / max(len(x), 1) * rows > LEAF_ROWS and level < DEEPEST:
                values = p[own, level]
                at = float(np.median(values))
                sides = own[values < at + out.spill], own[values >= at - out.spill]
                if max(map(len, sides)) <= 0.85 * len(own):
                    split = at, sides
            if split is None:
                number[node] = out.leaves
                out.leaves += 1
            else:
                cut[node] = split[0]
                todo += [(2 * node + 1, split[1][0], level + 1), (2 * node + 2, split[1][1], level + 1)]
            deep = max(deep, node)
        cuts, numbers = np.zeros(deep + 1), np.full(deep + 1, -1, np.int32)
        cuts[list(cut)] = list(cut.values())
        numbers[list(number)] = list(number.values())
        out.cuts.append(cuts)
        out.numbers.append(numbers)
        if len(number) == 1:
            break                                         # one leaf has all pairs
    return out


def _lists(values: np.ndarray, row: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def index(reps: DataFrame, model: Forest, dim: int, kind: str) -> DataFrame:
    """node, w, v with their place: core and r (angle to its centre; null
    outside cores), halo (cores that may hold a partner, with the angle) and
    leaves (of rows outside cores)."""
    shared = reps.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = matrix(column(batch, "v"), dim)
            n, core, r = len(x), np.full(len(x), -1), np.zeros(len(x))
            row, of, angle = (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
            if len(model.centres) and n:
                far = np.arccos(np.clip(x @ model.centres.T, -1, 1))
                best = far.argmin(axis=1)
                r = far[np.arange(n), best]
                core = np.where(r <= model.angle / 2 - EASE, best, -1)
                # a pair of two cores is looked for around the first of them
                near = (far <= 1.5 * model.angle + EASE) & ((core < 0)[:, None] | (np.arange(far.shape[1]) < core[:, None]))
                row, of = np.nonzero(near)
                angle = far[row, of]
            free = np.flatnonzero(core < 0)
            leaf_row, leaf = model.drop(x[free])
            halo = _lists(of, row, n, pa.int32())
            angles = _lists(angle, row, n, pa.float64())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "node"), column(batch, "w"), column(batch, "v"),
                 pa.array(core, pa.int32(), mask=core < 0), pa.array(r, mask=core < 0), halo, angles,
                 _lists(leaf, free[leaf_row], n, pa.int32())], names=["node", "w", "v", "core", "r", "halo", "angles", "leaves"])
    return reps.select("node", "w", "v").mapInArrow(
        run, f"node long, w long, v {kind}, core int, r double, halo array<int>, angles array<double>, leaves array<int>")


def _shared_before(mine: list, yours: list, leaf: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the pairs (mine[a], yours[b]) have a leaf before ``leaf`` in common."""
    def table(lists: list) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        value = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)
        return row[value < leaf], value[value < leaf]
    (row_a, leaf_a), (row_b, leaf_b) = table(mine), table(yours)
    names = np.intersect1d(leaf_a, leaf_b)
    if not len(names):
        return np.zeros(len(a), bool)
    have_a, have_b = np.zeros((len(mine), len(names)), np.float32), np.zeros((len(yours), len(names)), np.float32)
    for have, row, value in ((have_a, row_a, leaf_a), (have_b, row_b, leaf_b)):
        known = np.isin(value, names)
        have[row[known], np.searchsorted(names, value[known])] = 1
    if len(a) * len(names) < len(mine) * len(yours):
        return (have_a[a] * have_b[b]).any(axis=1)
    return (have_a @ have_b.T)[a, b] > 0


def compare(cell: pa.Table, dim: int, link: float) -> pa.Table:
    """Links of a cell: (0, node, number of rows linked) and (1, node, node) of
    a forest that unites what the links unite."""
    side = column_of(cell, "side").to_numpy()
    node, w = column_of(cell, "node").to_numpy(), column_of(cell, "w").to_numpy()
    leaves = column_of(cell, "leaves").to_pylist()
    leaf = column_of(cell, "g")[0].as_py()
    x = matrix(column_of(cell, "v"), dim)
    if side[0] == 2:
        left = right = np.arange(len(x))
        a, b = np.nonzero(np.triu(x @ x.T >= link, 1))
    else:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = np.nonzero(x[left] @ x[right].T >= link)
    if len(a) and leaf >= 0:
        ua, a = np.unique(a, return_inverse=True)
        ub, b = np.unique(b, return_inverse=True)
        left, right = left[ua], right[ub]
        new = ~_shared_before([leaves[i] for i in left], [leaves[i] for i in right], leaf, a, b)
        a, b = a[new], b[new]
    a, b = left[a], right[b]
    found = np.bincount(a, weights=w[b], minlength=len(x)) + np.bincount(b, weights=w[a], minlength=len(x))
    have = np.flatnonzero(found)
    child, root = stars(node[a], node[b]) if len(a) else (node[:0], node[:0])
    return pa.table({"kind": pa.array(np.repeat([0, 1], [len(have), len(child)]), pa.int8()),
                     "a": pa.array(np.concatenate([node[have], child]), pa.int64()),
                     "b": pa.array(np.concatenate([found[have].astype(np.int64), root]), pa.int64())})


def column_of(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks() if table.column(name).num_chunks != 1 else table.column(name).chunk(0)


def _blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def _leaf_cells(rows: DataFrame) -> DataFrame:
    """Rows of the cells of all leaves: (g, i, j) names a cell, side 2 a block
    that is compared with itself, 0 and 1 the two of others."""
    each = rows.select("node", F.explode("leaves").alias("g"))
    # leaves of more than one block; there are at most trees x 2 ** DEEPEST leaves
    large = each.groupBy("g").agg(_blocks(F.count(F.lit(1))).alias("blocks")).where("blocks > 1")
    cells = (rows.withColumn("g", F.explode("leaves")).join(F.broadcast(large), "g", "left")
             .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return cells.select(
        "g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 2).otherwise(F.when(F.col("own") < F.col("other"), 0).otherwise(1)).alias("side"),
        "node", "w", "leaves", "v")


def _core_cells(rows: DataFrame, angle: float) -> DataFrame:
    """Rows of the cells of all cores and what lies around them, for pairs of a
    member and a row outside; g is -1 - core.  Members that are too near the
    centre to reach any such row are left out."""
    around = (rows.where(F.size("halo") > 0)
              .select("node", "w", "v", F.explode(F.arrays_zip("halo", "angles")).alias("h"))
              .select("node", "w", "v", F.col("h.halo").alias("k"), F.col("h.angles").alias("angle")))
    near = around.groupBy("k").agg(F.min("angle").alias("nearest"), _blocks(F.count(F.lit(1))).alias("outer"))
    # at most 256 cores, so their figures may be broadcast
    member = rows.where("core is not null").select("node", "w", "v", F.col("core").alias("k"), "r").join(F.broadcast(near), "k").where(
        F.col("r") >= F.col("nearest") - angle - EASE)
    inner = member.groupBy("k").agg(_blocks(F.count(F.lit(1))).alias("inner"))
    figures = F.broadcast(near.join(inner, "k").select("k", "inner", F.col("outer").alias("outside")))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    one = member.drop("outer").join(figures, "k").select(
        (-1 - F.col("k")).alias("g"), block("inner").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("outside") - 1)).alias("j"), F.lit(0).alias("side"), "node", "w", "v")
    two = around.join(figures, "k").select(
        (-1 - F.col("k")).alias("g"), F.explode(F.sequence(F.lit(0), F.col("inner") - 1)).alias("i"),
        block("outside").alias("j"), F.lit(1).alias("side"), "node", "w", "v")
    return one.unionByName(two).withColumn("leaves", F.expr("cast(array() as array<int>)"))


def _link_rows(reps: DataFrame, dim: int, kind: str, link: float, trees: int) -> tuple[DataFrame, DataFrame]:
    """(node, links) and (u, v) over the distinct vectors of one length."""
    total = reps.count()
    wanted = max(LEAST_SAMPLE, SAMPLE_VALUES // dim)
    share = max(1, min(1 << 30, int((1 << 30) * wanted / max(total, 1))))
    # a share by hash: about ``wanted`` rows, whatever the size of the table
    chosen = reps.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < share).select("v").toArrow()
    model = fit(matrix(chosen.column("v"), dim), total, link, trees)
    rows = written(index(reps, model, dim, kind), "vectors-index")
    cells = _leaf_cells(rows)
    edges = counts = None
    if len(model.centres):
        cells = cells.unionByName(_core_cells(rows, model.angle))
        # a core: every member is linked with all others
        core = rows.where("core is not null").select("node", "w", "core")
        figures = F.broadcast(core.groupBy("core").agg(F.sum("w").alias("all"), F.min("node").alias("first")))   # at most 256
        core = core.join(figures, "core")
        counts = core.select("node", (F.col("all") - F.col("w")).alias("links"))
        edges = core.where("node != first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    found = written(cells.groupBy("g", "i", "j").applyInArrow(
        lambda cell: compare(cell, dim, link), "kind byte, a long, b long"), "vectors-links")
    own_counts = found.where("kind = 0").select(F.col("a").alias("node"), F.col("b").alias("links"))
    own_edges = found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))
    counts = own_counts if counts is None else counts.unionByName(own_counts)
    return counts, own_edges if edges is None else edges.unionByName(own_edges)


def near_duplicates(vectors: DataFrame, link: float = LINK, trees: int = TREES,
                    ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, nor do vectors of different lengths.  Rows are vectors:
    equal ones (repeated rows and ids included) link with each other.  A null id
    is no component's smallest id unless it has no other; a row without an id
    is kept if its component id is null too.  An empty table gives an empty
    result; other columns do not matter.

    All links between equal vectors, inside cores and around them are found; of
    the others, those whose pair meets in a leaf.  A pair at the threshold
    misses a tree with a probability of a few hundredths, and is lost only if
    it misses all of them.
    """
    kind = vectors.schema[vector].dataType.simpleString()
    if kind not in ("array<float>", "array<double>"):
        kind = "array<double>"
    docs = vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v"))
    docs = docs.withColumn("usable", usable(F.col("v")))
    good = docs.where("usable").select("vec_id", "v")
    # nodes follow the smallest ids, so a component's smallest node has its smallest id
    reps = good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("w"))
    reps = written(reps.repartitionByRange(F.asc_nulls_last("least"), F.xxhash64("v")).sortWithinPartitions(F.asc_nulls_last("least"))
                   .withColumn("node", F.monotonically_increasing_id()), "vectors")
    counts = edges = None
    for dim in sorted(r.dim for r in reps.select(F.size("v").alias("dim")).distinct().collect()):
        c, e = _link_rows(reps.where(F.size("v") == dim), dim, kind, link, trees)
        counts, edges = (c, e) if counts is None else (counts.unionByName(c), edges.unionByName(e))
    alone = docs.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if counts is None:
        return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    root = components(edges)
    named = reps.select(F.col("node").alias("root"), F.col("least").alias("component_id"))
    nodes = (reps.join(counts.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
             .join(root.join(named, "root").select("node", "component_id"), "node", "left")
             .select("v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"),
                     F.coalesce("component_id", "least").alias("component_id")))
    found = good.join(nodes, "v").select("vec_id", "n_links", "component_id").unionByName(alone)
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
