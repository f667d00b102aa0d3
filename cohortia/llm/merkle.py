"""Merkle manifest of a table: one hash tree per group of rows, and one tree
over the groups' roots.

Leaves are digests of rows, numbered per group in the order of a column. At
every level a node meets its siblings by an equijoin of the level with itself
on the sibling index (index XOR 1 for binary trees, the other slots of its run
otherwise); the rows of slot zero then emit the parents. A second walk, from
the roots down, appends every node's siblings to those of its parent, so each
leaf ends with its inclusion proof.

A level is written before the next one reads it: a lost executor costs running
tasks only. No group meets in one task: rows are numbered by their place in a
range-partitioned sort plus prefix sums over (group, task), and the joins are
on (group, index). Only the size of the largest group reaches the driver.

Digests are lower-case hex SHA-256 of concatenated parts; a value of a row is
``-`` if null, else its UTF-8 byte count, ``:`` and the value. The last run of
a level may be shorter; a run of one becomes the digest of its only node.

Edge cases: rows without a group come first among the groups, rows without an
order value first in their group; ties in the order column are ordered by the
digest, and equal rows are interchangeable leaves of their own; an empty text
is ``0:``; very long texts are hashed whole; a group of one row is its own
subroot, and a table of one row its own root, with no sibling; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, written

FANOUT = 2
_STEPS = "array<struct<before:binary,after:binary>>"


def row_digest(columns: Sequence[Column]) -> Column:
    """Digest of a row's values."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), "-").otherwise(
            F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``idx``, the place of a row within its ``tree`` by ``order``, and
    ``size``, the rows of its tree. ``order`` must tell all rows apart."""
    keys = ["tree", *order]
    place = F.monotonically_increasing_id()
    ordered = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "*", F.shiftright(place, 33).alias("__part"),
        place.bitwiseAND(F.lit((1 << 33) - 1)).alias("__row")), "ordered")
    runs = ordered.groupBy("tree", "__part").agg(
        F.count(F.lit(1)).alias("n"), F.min("__row").alias("first"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(runs.select(
        F.col("tree").alias("__tree"), F.col("__part").alias("__at"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("__base"),
        F.sum("n").over(tree).alias("size")), "bases")
    return ordered.join(bases, (F.col("tree") == F.col("__tree")) & (
        F.col("__part") == F.col("__at"))).withColumn(
            "idx", F.col("__row") + F.col("__base")).drop(
            "__part", "__row", "__tree", "__at", "__base")


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes with ``before`` and ``after``: the digests of the other nodes of
    their run, left and right of them."""
    slot = F.col("idx") % fanout
    out, found = nodes, []
    for k in range(1, fanout):
        # the k-th other slot of the run; for pairs that is the index with its last bit turned
        at = F.col("idx").bitwiseXOR(F.lit(1)) if fanout == 2 else (
            F.col("idx") - slot + (slot + k) % fanout)
        other = nodes.select(F.col("tree").alias("s_tree"), F.col("idx").alias("s_idx"),
                             F.col("digest").alias(f"s_{k}"))
        out = out.join(other, (F.col("tree") == F.col("s_tree")) & (at == F.col("s_idx")),
                       "left").drop("s_tree", "s_idx")
        found.append(F.struct(((slot + k) % fanout).alias("slot"), F.col(f"s_{k}").alias("digest")))
    run = F.array_sort(F.filter(F.array(*found), lambda s: s["digest"].isNotNull()))

    def side(keep) -> Column:
        return F.aggregate(F.filter(run, keep), F.lit(b""), lambda a, s: F.concat(a, s["digest"]))
    return out.select("tree", "idx", "size", "digest",
                      side(lambda s: s["slot"] < slot).alias("before"),
                      side(lambda s: s["slot"] > slot).alias("after"))


def grow(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels of the trees (``tree, idx, size, digest`` of the leaves),
    with siblings, and their roots ``tree, digest, level``, both written."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    levels, roots, depth = [], None, 0
    while True:
        done = nodes.filter("size = 1").select("tree", "digest", F.lit(depth).alias("level"))
        roots = done if roots is None else roots.unionByName(done)
        if largest <= 1:
            return levels, written(roots, "roots")
        level = written(with_siblings(nodes.filter("size > 1"), fanout), "level")
        levels.append(level)
        # slot zero speaks for its run
        nodes = level.filter(F.col("idx") % fanout == 0).select(
            "tree", F.floor(F.col("idx") / fanout).cast("long").alias("idx"),
            F.ceil(F.col("size") / fanout).cast("long").alias("size"),
            F.unhex(F.sha2(F.concat(_hex(F.col("digest")), _hex(F.col("after"))), 256)).alias("digest"))
        largest, depth = -(-largest // fanout), depth + 1


def descend(levels: list[DataFrame], roots: DataFrame, fanout: int) -> DataFrame:
    """``tree, idx, steps`` of all leaves: siblings level by level, those of
    the tree first, then the ``steps`` that ``roots`` (``tree, level, steps``)
    bring along."""
    below = None
    for depth in range(len(levels), -1, -1):
        ends = roots.filter(F.col("level") == depth).select(
            "tree", F.lit(0).cast("long").alias("idx"), "steps")
        if depth < len(levels):
            up = below.select(F.col("tree").alias("u_tree"), F.col("idx").alias("u_idx"), "steps")
            own = F.array(F.struct("before", "after"))
            inner = levels[depth].join(up, (F.col("tree") == F.col("u_tree")) & (
                F.floor(F.col("idx") / fanout).cast("long") == F.col("u_idx"))).select(
                "tree", "idx", F.concat(own, "steps").alias("steps"))
            ends = inner.unionByName(ends)
        if depth:
            ends, used = written(ends, "proofs"), below
            if used is not None:
                discard(used), discard(levels[depth])
        below = ends
    return below


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda d, s: F.sha2(
        F.concat(_hex(s["before"]), d, _hex(s["after"])), 256))


def siblings(steps: Column) -> Column:
    """All digests of a proof, as text, from the leaf's level to the root."""
    return F.array_join(F.transform(steps, lambda s: _hex(F.concat(s["before"], s["after"]))), "")


def manifest(docs: DataFrame, columns: Sequence[str], group_col: str = "lang",
             id_col: str = "doc_id", fanout: int = FANOUT,
             suspect: Mapping[str, Column] | None = None) -> DataFrame:
    """Leaf, proof and check of every row: ``id, leaf, subroot, root, steps,
    folded_root, verified``.

    ``columns`` are hashed, in that order. ``suspect`` gives other values for
    some of them: the row that is checked against the manifest; ``folded_root``
    is the root that this row and the manifest's siblings give.
    """
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    own = [F.col(c) for c in columns]
    seen = [(suspect or {}).get(c, F.col(c)) for c in columns]
    changed = F.lit(False)
    for a, b in zip(own, seen, strict=True):
        changed = changed | ~a.eqNullSafe(b) if a is not b else changed
    # "" sorts before all groups that have a name
    group = F.col(group_col).cast("string")
    leaves = written(docs.select(
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("tree"),
        F.col(id_col).alias("id"), F.unhex(row_digest(own)).alias("digest"),
        F.when(changed, F.unhex(row_digest(seen))).alias("suspect"),
        F.monotonically_increasing_id().alias("tie")), "leaves")
    rows = written(numbered(leaves, ["id", "digest", "tie"]).drop("tie"), "numbered")
    levels, subroots = grow(rows.select("tree", "idx", "size", "digest"), fanout)

    tops = written(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"),
                                            "digest", "level"), ["name"]), "tops")
    top_levels, root = grow(tops.select("tree", "idx", "size", "digest"), fanout)
    above = descend(top_levels, root.withColumn("steps", F.array().cast(_STEPS)), fanout)
    trees = written(tops.join(above, ["tree", "idx"]).join(
        root.select("tree", F.col("digest").alias("root")), "tree").select(
        F.col("name").alias("tree"), "level", "steps", F.col("digest").alias("subroot"), "root"),
        "trees")

    proofs = descend(levels, trees, fanout)
    found = rows.join(proofs, ["tree", "idx"]).join(trees.select("tree", "subroot", "root"), "tree")
    leaf = _hex(F.col("digest"))
    return found.select(
        "id", leaf.alias("leaf"), _hex(F.col("subroot")).alias("subroot"),
        _hex(F.col("root")).alias("root"), "steps",
        fold(F.coalesce(_hex(F.col("suspect")), leaf), F.col("steps")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
