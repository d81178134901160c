"""Connected components by repeated contraction, as joins and aggregations only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round maps every node to the least of itself and its neighbours and rewrites the edges under that map, which
    keeps components apart and at least halves the nodes of each; what is left of the edges is written to the shared
    folder. Minima are aggregated before they are shuffled, so a node with very many neighbours is no hot spot.
    """
    edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        parents = staged(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("parent")), "parents")
        levels.append(parents)
        pa_, pb = parents.toDF("a", "pa"), parents.toDF("b", "pb")
        moved = edges.join(pa_, "a").join(pb, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = staged(moved.where("a < b").distinct(), "edges")
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = levels[0].toDF("node", "component")
    for parents in levels[1:]:
        out = out.join(parents.toDF("component", "next"), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return staged(out, "components")


#: Rows of a block of a bucket.
BUCKET_ROWS = 1000


def spread(tagged: DataFrame, rows: int) -> DataFrame:
    """Buckets (key, node, comp, ...) that hold several components, as pairs of blocks (x, y) of at most about ``rows`` rows.

    ``side`` is 0 for rows of the first block of two, 1 for the second's, 2 where both are one block.
    """
    split = tagged.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows")).where("lo <> hi")
    mixed = tagged.join(split.select("key", F.ceil(F.col("rows") / rows).cast("int").alias("blocks")), "key")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    each = mixed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return each.select(*tagged.columns, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), side.alias("side"))


def pairs_across(tagged: DataFrame, fits: Callable[[Column, Column], Column], value: str, rows: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of one bucket and different components whose ``value`` columns fit: a row for each
    common bucket, with n = 1 and the greater value.

    Rows of buckets with one ``pivot`` meet in one task (block by block), where an aggregation by pair takes most of its
    rows together before anything is shuffled; that takes ``partitioned_by_some_keys``.
    """
    blocks = spread(tagged, rows or BUCKET_ROWS)
    near = ["pivot", "x", "y"]
    placed = blocks.select(*near, "key", "node", "comp", value, "side").repartition(*near)  # one exchange for both sides of the join
    left, right = (placed.toDF(*near, "key", f"n{i}", f"c{i}", f"v{i}", f"s{i}") for i in (0, 1))
    both = left.join(right, [*near, "key"]).where((F.col("s0") * 3 + F.col("s1")).isin(1, 8))  # first and second block, or one block
    both = both.where((F.col("c0") != F.col("c1")) & ((F.col("s0") < F.col("s1")) | (F.col("n0") < F.col("n1"))) & fits(F.col("v0"), F.col("v1")))
    return both.select(F.least("n0", "n1").alias("a"), F.greatest("n0", "n1").alias("b"), F.lit(1).cast("long").alias("n"), F.greatest("v0", "v1").alias(value))


@contextmanager
def partitioned_by_some_keys(spark: SparkSession) -> Iterator[None]:
    """Let joins keep a partitioning by some of their keys, while a table is written."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
