"""Connected components by alternating large-star and small-star steps.

Each step is an aggregate and a join; edges are cut to the shared folder after
each, so neither edges nor components are ever gathered in one place, and the
joins see plain exchanges that adaptive execution can split at a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _directed(pairs: DataFrame) -> DataFrame:
    """Distinct edges hi > lo."""
    return pairs.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())


def connected_components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the pairs (a, b), root being the component's smallest node.

    a and b are of one orderable type.  Loops and repeated pairs are ignored; no
    pairs give no rows.
    """
    edges = cut(_directed(pairs), "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
        large = cut(_directed(both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))), "edges")
        least = cut(large.groupBy("hi").agg(F.min("lo").alias("m")), "star")
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("m").alias("b")), F.struct(F.col("hi").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = cut(_directed(small), "edges")
    roots = edges.select(F.col("lo").alias("node")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
