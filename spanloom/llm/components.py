"""Connected components of an edge table, all in DataFrames.

Alternating large-star and small-star rounds: each node points its larger
(then smaller) neighbours to the smallest node it knows.  A round is two
aggregations with map-side combine and two equi-joins, so a hub of any degree is
never gathered in one task; rounds are written to the shared folder and the loop
ends when the edges no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.storage import discard, written


def _star(nb: DataFrame) -> DataFrame:
    least = nb.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return nb.join(least, "u")


def _sum(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of long ids -> (node, component) for every node of an edge;
    component is the smallest node that can be reached.  Loops, repeated and null
    ends are ignored."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = written(e, "edges")
    before = _sum(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "largestar")
        s = _star(large)
        small = s.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(s.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, "smallstar")
        discard(e, large)
        e, after = new, _sum(new)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
