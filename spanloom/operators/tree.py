"""Module trees: nesting, paths, ancestor closure, type graph, signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.intervals import enclosing

MAX_DEPTH = 200


def nest(spans: DataFrame, keys: list[str], node: str = "node_id") -> DataFrame:
    """Adds parent_id: the last span before it, by (ts, longer first, seq), that ends after its start.

    spans: keys, node, ts, end, seq.  Overlapping spans nest too."""
    order = lambda p: F.struct(F.col(f"{p}ts").alias("a"), (-F.col(f"{p}end")).alias("b"), F.col(f"{p}seq").alias("c"))
    inner = spans.select(*keys, F.col(node).alias("i_node"), F.col("ts").alias("i_ts"), F.col("end").alias("i_end"), F.col("seq").alias("i_seq"))
    outer = spans.select(*keys, F.col(node).alias("o_node"), F.col("ts").alias("o_ts"), F.col("end").alias("o_end"), F.col("seq").alias("o_seq"))
    pairs = enclosing(inner, outer, keys, "i_ts", "o_ts", "o_end", half_open=True).where(order("o_") < order("i_"))
    best = pairs.groupBy("i_node").agg(F.max_by("o_node", order("o_")).alias("parent_id"))
    return spans.join(best, F.col(node) == F.col("i_node"), "left").drop("i_node")


def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor, node, dist) of every node and itself; one join per level of depth."""
    up = nodes.select(F.col("node_id").alias("child"), F.col("parent_id").alias("parent")).where("parent is not null")
    level = nodes.select(F.col("node_id").alias("ancestor"), F.col("node_id").alias("node"), F.lit(0).alias("dist"))
    out = level
    for d in range(1, MAX_DEPTH):
        level = level.join(up, F.col("ancestor") == F.col("child")).select(F.col("parent").alias("ancestor"), "node", F.lit(d).alias("dist"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"a tree is deeper than {MAX_DEPTH} levels or has a cycle")


def paths(nodes: DataFrame, ancestors: DataFrame, name: str = "name") -> DataFrame:
    """(node_id, depth, path): names from the root, joined by slashes."""
    named = ancestors.join(nodes.select(F.col("node_id").alias("ancestor"), F.col(name).alias("_n")), "ancestor")
    steps = F.transform(F.sort_array(F.collect_list(F.struct(F.col("dist"), F.col("_n"))), False), lambda s: s["_n"])
    return named.groupBy(F.col("node").alias("node_id")).agg(F.max("dist").alias("depth"), F.array_join(steps, "/").alias("path"))


def parents_by_depth(rows: DataFrame, order: str = "row", depth: str = "depth", keys: list[str] | None = None) -> DataFrame:
    """Adds parent_row: the last row before with a smaller depth (report rows to a tree).
    Reports have bounded depth: one running maximum per smaller depth."""
    deepest = rows.agg(F.max(depth)).first()[0] or 0
    w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    best = None
    for d in range(int(deepest)):
        last = F.max(F.when(F.col(depth) == d, F.col(order))).over(w)
        last = F.when(F.col(depth) > d, last)
        best = last if best is None else F.greatest(best, last)
    return rows.withColumn("parent_row", F.lit(None).cast("long") if best is None else best)


def type_graph(nodes: DataFrame) -> DataFrame:
    """Distinct (parent_type, child_type)."""
    parent = nodes.select(F.col("node_id").alias("parent_id"), F.col("module_type").alias("parent_type"))
    return nodes.where("parent_id is not null").join(parent, "parent_id").select("parent_type", F.col("module_type").alias("child_type")).distinct()


def type_descendants(graph: DataFrame) -> DataFrame:
    """(parent_type, child_type) over any number of steps; cycles end when nothing is new."""
    found = step = graph
    for _ in range(MAX_DEPTH):
        step = step.alias("a").join(graph.alias("b"), F.col("a.child_type") == F.col("b.parent_type")).select(F.col("a.parent_type"), F.col("b.child_type")).distinct().join(found, ["parent_type", "child_type"], "left_anti")
        if step.isEmpty():
            return found
        found = found.union(step)
    return found


def signatures(nodes: DataFrame, depth: int = 2) -> DataFrame:
    """(node_id, signature): multiset of child types and their signatures down to a depth."""
    ids = nodes.select("node_id")
    below = None
    for _ in range(depth):
        kids = nodes.where("parent_id is not null").select("node_id", "parent_id", "module_type")
        if below is None:
            kids = kids.withColumn("part", F.col("module_type"))
        else:
            kids = kids.join(below, "node_id").withColumn("part", F.concat("module_type", F.lit("("), "signature", F.lit(")")))
        counted = kids.groupBy("parent_id", "part").agg(F.count("*").alias("n"))
        made = counted.groupBy(F.col("parent_id").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("part", F.lit("x"), F.col("n").cast("string")))), ";").alias("signature"))
        below = ids.join(made, "node_id", "left").withColumn("signature", F.coalesce("signature", F.lit("")))
    return below


def variants(nodes: DataFrame, signed: DataFrame, share: int = 10) -> DataFrame:
    """Per (module_type, signature): instances and letter; signatures under a tenth of the
    type's instances are left out unless none is left."""
    n = nodes.join(signed, "node_id").groupBy("module_type", "signature").agg(F.count("*").alias("instances"))
    w = W.partitionBy("module_type")
    n = n.withColumn("least", F.greatest(F.lit(1), F.floor(F.sum("instances").over(w) / share)))
    n = n.withColumn("big", F.col("instances") >= F.col("least")).withColumn("any", F.max("big").over(w)).where("big or not any")
    rank = F.row_number().over(w.orderBy(F.col("instances").desc(), "signature"))
    return n.withColumn("rank", rank).select("module_type", "signature", "instances", F.when(F.col("rank") <= 26, F.char(64 + F.col("rank"))).otherwise(F.col("rank").cast("string")).alias("variant"))


def wrapper_types(nodes: DataFrame, times: DataFrame, threshold: float = 0.8, few: int = 2) -> DataFrame:
    """Types whose first instance hands its time to one child type (more than the
    threshold), or that occur few times with a child type that occurs more often, the
    children together above the threshold.  nodes: preorder; times: node_id, total."""
    t = nodes.join(times, "node_id")
    first = t.groupBy("module_type").agg(F.min_by(F.struct("node_id", "total"), "preorder").alias("f"), F.count("*").alias("instances")).select("module_type", "f.*", "instances").where("total > 0")
    counts = nodes.groupBy(F.col("module_type").alias("child_type")).agg(F.count("*").alias("child_instances"))
    kids = t.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id"), F.col("module_type").alias("child_type")).agg(F.sum("total").alias("child_total")).join(counts, "child_type")
    both = first.join(kids, "node_id").groupBy("module_type", "total", "instances").agg(F.max("child_total").alias("most"), F.sum("child_total").alias("all"), F.max("child_instances").alias("often"))
    one = F.col("most") > threshold * F.col("total")
    many = (F.col("instances") <= few) & (F.col("all") > threshold * F.col("total")) & (F.col("often") > few)
    return both.where(one | many).select("module_type")
