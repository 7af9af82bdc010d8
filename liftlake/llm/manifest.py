"""Merkle dataset manifest by sibling-shift self-joins (dealt operator 12).

Every row is a leaf; the leaves of a source form a 16-ary tree, the subroots
of all sources form the tree above.  Nodes of a level know their position, so
the positions of a node's siblings are computed (slot offsets within the run
of 16) and every level is an equijoin of its nodes with themselves; slot-zero
rows emit the parents.  Going down again, the same join gives each node its
siblings, and a document's proof is its own siblings and its parent's path.

Texts are read once and never shuffled: a leaf is 32 bytes.  A run is the unit
of every shuffle, so a source of any size spreads over all tasks, and a level
is a written table, so a lost executor repeats one level at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from liftlake.llm.labelled import fold
from liftlake.llm.runtime import written

#: Children of a node.
ARITY = 16
#: The fields of a leaf, in the contract's order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A tampered copy is checked where this divides crc32 of the id.
TAMPER = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(body: Column) -> Column:
    return F.unhex(F.sha2(body.cast("binary"), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _field(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*values: Column) -> Column:
    """Digest of a row: its values as text, length-prefixed, ``-`` for null."""
    return _digest(F.concat(*[_field(v.cast("string")) for v in values]))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx`` (place within the group by ``order``, from 0) and
    ``n`` (rows of the group).

    Rows are dealt by ranges of (group, order), so a group of any size lies in
    many tasks; a row's place is its place in the task plus what the tasks
    before hold of its group (one count for each task and group).
    """
    low = (1 << 33) - 1
    placed = written(
        rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (group, *order)])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (group, *order)])
        .withColumn("at", F.monotonically_increasing_id())
        .withColumns({"part": F.shiftright("at", 33).cast("int"), "at": F.col("at").bitwiseAND(F.lit(low))}), "manifest-order")
    counts = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m"))
    # a row for each group and task that holds some of it
    parts = Window.partitionBy(group).orderBy("part")
    offsets = counts.select(
        group, "part", F.sum("m").over(Window.partitionBy(group)).alias("n"),
        (F.coalesce(F.sum("m").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("base"))
    return (placed.join(offsets, [group, "part"])
            .withColumn("idx", F.col("at") + F.col("base")).drop("at", "part", "base"))


@contextmanager
def _partitioned_by_run(spark: SparkSession) -> Iterator[None]:
    """Joins inside may use the partitioning by run that both sides have, though
    their keys name the slot as well: a level is then dealt out once."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def with_siblings(nodes: DataFrame, wanted: Column | None = None) -> DataFrame:
    """The nodes of a level (tree, idx, n, digest, ...; ``wanted`` of them) with
    ``run``, ``slot`` and their run's other digests in hex: ``before`` and
    ``after`` the node.

    A node's sibling positions are computed, slot + 1, slot + 2, ... modulo the
    arity within the run, as far as the level has such nodes; each is looked up
    by an equijoin on (tree, run, slot).
    """
    runs = nodes.withColumns({"run": F.floor(F.col("idx") / ARITY).cast("long"), "slot": (F.col("idx") % ARITY).cast("int")}).repartition("tree", "run")
    others = runs.select("tree", "run", F.col("slot").alias("sibling"), F.col("digest").alias("sibling_digest"))
    shifted = F.filter(
        F.transform(F.sequence(F.lit(1), F.lit(ARITY - 1)), lambda o: (F.col("slot") + o) % ARITY),
        lambda s: F.col("run") * ARITY + s < F.col("n"))
    own = [c for c in runs.columns if c not in ("tree", "run", "slot")]
    asked = (runs if wanted is None else runs.where(wanted)).withColumn("sibling", F.explode_outer(shifted))
    # repeated leaves have places of their own, so (tree, run, slot) is a key
    found = asked.join(others, ["tree", "run", "sibling"], "left").groupBy("tree", "run", "slot").agg(
        *[F.first(c).alias(c) for c in own],
        F.array_sort(F.collect_list(F.when(F.col("sibling_digest").isNotNull(), F.struct("sibling", "sibling_digest")))).alias("siblings"))
    side = lambda keep: F.concat_ws("", F.transform(F.filter("siblings", keep), lambda s: _hex(s["sibling_digest"])))
    return found.select("tree", "run", "slot", *own,
                        side(lambda s: s["sibling"] < F.col("slot")).alias("before"),
                        side(lambda s: s["sibling"] > F.col("slot")).alias("after"))


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees (tree, idx, n, digest), each a written table that
    holds the trees that still have several nodes there, and (tree, digest) of
    what remains of every tree."""
    spark, levels, tops = nodes.sparkSession, [], []
    with _partitioned_by_run(spark):
        level = nodes
        while True:
            tops.append(level.where("n = 1").select("tree", "digest"))
            level = level.where("n > 1")
            if level.isEmpty():
                break
            levels.append(level)
            slot_zero = with_siblings(level, F.col("slot") == 0)
            level = written(slot_zero.select(
                "tree", F.col("run").alias("idx"), F.ceil(F.col("n") / ARITY).cast("long").alias("n"),
                _digest(F.concat(_hex(F.col("digest")), F.col("after"))).alias("digest")), "manifest-level")
    found = tops[0]
    for more in tops[1:]:
        found = found.unionByName(more)
    return levels, written(found, "manifest-tops")


_PATH = "array<struct<before:string,after:string>>"


def _no_path() -> Column:
    return F.expr(f"cast(array() as {_PATH})")


def descend(levels: list[DataFrame], start: DataFrame) -> DataFrame:
    """(tree, run, path, subroot) for the runs of the lowest level: the siblings
    of the run's parent and of the nodes above it, lowest first, then the path
    of the whole tree.

    ``start`` has (tree, path, subroot) of every tree.  It enters where its tree
    ends, in one run of its topmost level, and goes down from run to run, so no
    tree's rows meet on the tree alone.
    """
    paths = None
    with _partitioned_by_run(start.sparkSession):
        for level in reversed(levels):
            ends = (level.where((F.col("idx") == 0) & (F.col("n") <= ARITY)).select("tree").join(start, "tree")
                    .select("tree", F.lit(0).cast("long").alias("run"), "path", "subroot"))
            paths = ends if paths is None else paths.unionByName(ends)
            if level is not levels[0]:
                paths = written(with_siblings(level).join(paths, ["tree", "run"]).select(
                    "tree", F.col("idx").alias("run"),
                    F.concat(F.array(F.struct("before", "after")), "path").alias("path"), "subroot"), "manifest-path")
    return paths


def leaves(docs: DataFrame, tamper: int = TAMPER) -> DataFrame:
    """doc_id, tree, digest and tampered (null where the row is not tampered)."""
    docs = docs.select(*[F.col(c).cast("long" if c == "doc_id" else "string").alias(c) for c in FIELDS])
    values = [F.col(c) for c in FIELDS]
    altered = [*values[:-1], F.translate("text", _UPPER, _LOWER)]
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return docs.select("doc_id", tree.alias("tree"), leaf(*values).alias("digest"),
                       F.when(fold(F.col("doc_id"), tamper) == 0, leaf(*altered)).alias("tampered"))


def manifest(docs: DataFrame, tamper: int = TAMPER) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256,
    folded_root and verified.

    Null fields count as ``-``; a null source is a source of its own and comes
    first, a null id comes first in its source and is never tampered.  Rows of
    one id in one source are ordered by their leaf, so equal rows have equal
    leaves and places of their own.  An empty table gives an empty result;
    other columns do not matter.  A lone row of a lone source has no sibling:
    its leaf is the root and its proof the digest of nothing.
    """
    spark = docs.sparkSession
    # the texts are read here, once: dealing by ranges would read its input twice
    hashed = written(leaves(docs, tamper), "manifest-digests")
    rows = written(numbered(hashed, "tree", ["doc_id", "digest"]), "manifest-leaves")
    levels, subroots = climb(rows.select("tree", "idx", "n", "digest"))
    # the tree above: the subroots in the order of their sources
    forest = subroots.withColumnRenamed("tree", "source_tree").withColumn("tree", F.lit("all"))
    top = written(numbered(forest, "tree", ["source_tree"]), "manifest-sources")
    top_levels, root = climb(top.select("tree", "idx", "n", "digest"))
    own = F.array(F.struct("before", "after"))
    with _partitioned_by_run(spark):
        if top_levels:
            up = descend(top_levels, root.select("tree", _no_path().alias("path"), F.col("digest").alias("subroot")))
            above = with_siblings(top).join(up.drop("subroot"), ["tree", "run"]).select(
                F.col("source_tree").alias("tree"), F.concat(own, "path").alias("path"), F.col("digest").alias("subroot"))
        else:
            above = top.select(F.col("source_tree").alias("tree"), _no_path().alias("path"), F.col("digest").alias("subroot"))
        above = written(above, "manifest-above")
        # rows of trees with levels get their run's path, lone leaves their tree's
        out = rows.where("n = 1").join(above, "tree").select("doc_id", "digest", "tampered", "subroot", "path")
        if levels:
            several = with_siblings(rows.where("n > 1")).join(descend(levels, above), ["tree", "run"])
            out = several.select("doc_id", "digest", "tampered", "subroot", F.concat(own, "path").alias("path")).unionByName(out)
        proof = F.sha2(F.concat_ws("", F.flatten(F.transform("path", lambda s: F.array(s["before"], s["after"])))).cast("binary"), 256)
        folded = F.aggregate("path", _hex(F.coalesce("tampered", "digest")),
                             lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]).cast("binary"), 256))
        out = written(out.select("doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"),
                                 proof.alias("proof_sha256"), folded.alias("folded_root")), "manifest-out")
    # the one root of the table
    top_row = root.select(_hex(F.col("digest")).alias("root")).first()
    out = out.withColumn("root", F.lit(top_row.root if top_row else None).cast("string"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
