"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.session import materialize


def _star(arcs: DataFrame) -> DataFrame:
    """(u, v, least) for each arc u -> v with the least of u and all its v. Grouping aggregates per task first."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("__u"), F.least("u", "m").alias("least"))
    return arcs.join(least, F.col("u") == F.col("__u")).drop("__u")


def _settled(edges: DataFrame) -> bool:
    """True when the edges are stars: no node points to two others, and none that is pointed to points on."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    )
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return nodes.where((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("in") == 1))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v); the label is the least node of the component.

    Every round is stored in the shared folder, so lineage stays short. The number of rounds grows with the logarithm
    of the largest component; edges that are stars already need none.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        small = _star(large)
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v")))
        now = materialize(small.where("u <> v").distinct(), "stars")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
