"""Connected components over a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import kept_table


def _towards_least(edges: DataFrame, both_ways: DataFrame) -> DataFrame:
    """(node, neighbour, least of the node and its neighbours); hubs are combined on the map side."""
    least = both_ways.groupBy("u").agg(F.min("v").alias("least"))
    return both_ways.join(least, "u").withColumn("least", F.least("u", "least"))


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the least node that each node of an edge reaches.

    Nodes may be of any ordered type. Loops and repeated edges do no harm; edges with a null end
    are ignored; an empty edge table gives an empty result. Every round is written to the shared
    folder; the number of rounds grows with the logarithm of the longest path.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null")
    current = kept_table(
        pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_towards_least(current, both).where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("least").alias("v")).distinct())
        small = _towards_least(large, large)
        current = kept_table(
            small.select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct(), "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == before:
            break
        before = state
    return nodes.join(current.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component"))
