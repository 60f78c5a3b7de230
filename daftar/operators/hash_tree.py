"""Reconciliation of two key sets by hash trees: ranges of keys by their hash, with a digest each, are compared from the root down; only keys of ranges that differ are joined.

A digest is the number of a range's keys, the xor of one hash and the sum of another, 128 bits in all that don't depend on order. Leaves are 2**BITS
ranges, inner nodes ranges of FAN of the level below. A tree is a small table (at most 16/15 of 2**BITS rows, whatever the number of keys) that can be kept beside
its table; making it moves one row a leaf and task, no keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.sources.store import shared_path

BITS, FAN_BITS = 16, 4
LEVELS = BITS // FAN_BITS
COUNTERS = ("n_a", "n_b", "n_both", "n_a_only", "n_b_only")


def leaf(key: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - BITS)


def tree(rows: DataFrame, key: str, unique: bool = False) -> DataFrame:
    """level (0: the root), node, n, x, s: digests of all ranges that hold keys. unique: keys don't repeat, so they needn't be made distinct, which would move them. Null keys are keys.

    The tree is written to the shared folder, so that comparisons read it and not the keys; kept elsewhere, it serves later ones.
    """
    keys = rows.select(key) if unique else rows.select(key).distinct()
    other = F.xxhash64(F.col(key), F.lit("other"))
    leaves = keys.groupBy(leaf(key).alias("leaf")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.col(key))).alias("x"), F.sum(other.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"))
    levels = leaves.withColumn("level", F.explode(F.array(*(F.lit(i) for i in range(LEVELS + 1)))))
    node = F.expr(f"leaf >> ({FAN_BITS} * ({LEVELS} - level))")
    nodes = levels.groupBy("level", node.alias("node")).agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))
    path = shared_path(rows.sparkSession, "tree")
    nodes.write.parquet(path)
    return rows.sparkSession.read.schema(nodes.schema).parquet(path)


def unequal_leaves(a: DataFrame, b: DataFrame) -> list[int]:
    """Of two trees the leaves whose digests differ, at most 2**BITS numbers, from the root down: below equal nodes nothing is read."""
    open_ = [0]
    for level in range(LEVELS + 1):
        if level:
            inside = F.shiftright("node", FAN_BITS).isin(open_) if len(open_) <= 1000 else F.lit(True)
            x, y = (t.where((F.col("level") == level) & inside) for t in (a, b))
        else:
            x, y = (t.where("level = 0") for t in (a, b))
        x, y = (t.select("node", F.struct("n", "x", "s").alias(d)) for t, d in ((x, "dx"), (y, "dy")))
        differ = x.join(y, "node", "full_outer").where(~F.col("dx").eqNullSafe(F.col("dy"))).select("node")
        open_ = sorted(r.node for r in differ.collect())
        if not open_:
            break
    return open_


def _of_leaves(rows: DataFrame, key: str, leaves: list[int]) -> DataFrame:
    """Distinct keys of some leaves; the leaves are at most 2**BITS numbers."""
    wanted = rows.sparkSession.createDataFrame([(n,) for n in leaves], "leaf long")
    keyed = rows.select(key, leaf(key).alias("_leaf"))
    return keyed.join(F.broadcast(wanted), F.col("_leaf") == F.col("leaf"), "left_semi").select(key).distinct()


def _differing(a: DataFrame, b: DataFrame, key: str, unique: bool, trees: tuple[DataFrame, DataFrame] | None) -> tuple[DataFrame, list[int], DataFrame | None]:
    """The tree of a, the leaves that differ, and their keys with sides; None without such leaves."""
    trees = trees or (tree(a, key, unique), tree(b, key, unique))
    leaves = unequal_leaves(*trees)
    if not leaves:
        return trees[0], leaves, None
    x = _of_leaves(a, key, leaves).select(F.col(key).alias("key"), F.lit(True).alias("in_a"))
    y = _of_leaves(b, key, leaves).select(F.col(key).alias("key2"), F.lit(True).alias("in_b"))
    joined = x.join(y, F.col("key").eqNullSafe(F.col("key2")), "full_outer")
    has_a, has_b = F.coalesce("in_a", F.lit(False)), F.coalesce("in_b", F.lit(False))
    return trees[0], leaves, joined.select(F.when(has_a, F.col("key")).otherwise(F.col("key2")).alias(key), has_a.alias("in_a"), has_b.alias("in_b"))


def reconciliation(a: DataFrame, b: DataFrame, key: str, unique: bool = False, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row: how many keys are in a, in b, in both, in a only and in b only. trees: those that are kept; without them both are made. Equal tables move no key."""
    tree_a, leaves, joined = _differing(a, b, key, unique, trees)
    equal = tree_a.where(F.col("level") == LEVELS).join(F.broadcast(a.sparkSession.createDataFrame([(n,) for n in leaves], "leaf long")), F.col("node") == F.col("leaf"), "left_anti")
    n = F.coalesce(F.sum("n"), F.lit(0))
    none = F.lit(0).cast("long")
    out = equal.agg(n.alias("n_a"), n.alias("n_b"), n.alias("n_both"), none.alias("n_a_only"), none.alias("n_b_only"))
    if joined is not None:
        x, y = F.col("in_a"), F.col("in_b")
        counted = joined.agg(F.count_if(x).alias("n_a"), F.count_if(y).alias("n_b"), F.count_if(x & y).alias("n_both"), F.count_if(x & ~y).alias("n_a_only"), F.count_if(~x & y).alias("n_b_only"))
        out = out.unionByName(counted).agg(*(F.sum(c).alias(c) for c in COUNTERS))
    return out


def differences(a: DataFrame, b: DataFrame, key: str, unique: bool = False, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """key, side (a or b): keys that one side alone has."""
    _, _, joined = _differing(a, b, key, unique, trees)
    if joined is None:
        return a.select(key).where("false").withColumn("side", F.lit("a"))
    return joined.where("in_a <> in_b").select(key, F.when(F.col("in_a"), "a").otherwise("b").alias("side"))
