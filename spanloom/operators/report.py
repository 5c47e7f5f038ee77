"""Report tables: overview, module tree, detail selection, details with FLOPs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import flops
from spanloom.operators import rollup
from spanloom.operators.kept import keep

TAB_ROWS, TREE_ROWS, TREE_DEPTH, OVERVIEW_DEPTH, SELF_SHARE = 1000, 5000, 3, 5, 0.5


def module_tree(nodes: DataFrame, depths: DataFrame, totals: DataFrame, breakdown: DataFrame, phases: DataFrame, limit: int = TREE_ROWS) -> DataFrame:
    """Rows in preorder down to TREE_DEPTH; of roots with one type and instance the first."""
    n = nodes.join(depths, "node_id").where(F.col("depth") <= TREE_DEPTH)
    w = W.partitionBy("module_type", "instance_id").orderBy("preorder")
    roots = n.where("parent_id is null").withColumn("_r", F.row_number().over(w))
    twice = roots.where("_r > 1").select(F.col("path").alias("_gone"), F.col("node_id").alias("_root"))
    n = n.join(twice.select(F.col("_root").alias("root_id")), "root_id", "left_anti")
    out = n.join(totals, "node_id").join(breakdown, "node_id", "left").join(phases, "node_id", "left")
    return out.select("preorder", "node_id", "depth", "name", "total_us", "total_count", F.coalesce("breakdown", F.lit("")).alias("breakdown"), F.coalesce("phase", F.lit("")).alias("phase")).orderBy("preorder").limit(limit)


def overview(nodes: DataFrame, ancestors: DataFrame, totals: DataFrame, selfs: DataFrame, reps: DataFrame | None = None) -> DataFrame:
    """Hierarchy of types by root type: statistics over all instances of a type below the
    root type, percent from the representative (the instance 1, else the first).  path, module_type, depth,
    count, mean/std/min/max/total, pct, top_kernel (where the representatives' kernels are given)."""
    t = nodes.join(totals, "node_id").join(selfs, "node_id", "left").fillna({"self_us": 0})
    root_of = ancestors.join(nodes.where("parent_id is null").select(F.col("node_id").alias("ancestor"), F.col("module_type").alias("root_type")), "ancestor").select(F.col("node").alias("node_id"), "root_type")
    t = keep(t.join(root_of, "node_id"))
    stats = t.groupBy("root_type", "module_type").agg(F.count("*").alias("count"), F.avg("total_us").alias("mean_us"), F.coalesce(F.stddev_samp("total_us"), F.lit(0.0)).alias("std_us"), F.min("total_us").alias("min_us"), F.max("total_us").alias("max_us"), F.sum("total_us").alias("sum_us"))
    first = F.min_by(F.struct("node_id", "total_us", "self_us"), F.struct((F.col("instance_id") != 1).alias("a"), F.col("preorder").alias("b")))
    roots = t.where("parent_id is null")
    grand = roots.agg(F.sum("total_us").alias("g"))
    level = roots.groupBy("root_type", "module_type").agg(first.alias("f"), F.sum("total_us").alias("all_us")).crossJoin(F.broadcast(grand)).select("root_type", "module_type", F.col("module_type").alias("path"), "f.*", (F.col("all_us") / F.col("g") * 100).alias("pct"))  # one row: the grand total
    level = keep(level)  # levels have a row per path
    out = level.select("root_type", "module_type", "path", F.lit(0).alias("depth"), "node_id", "pct")
    kids = t.where("parent_id is not null").select("parent_id", F.col("module_type").alias("kid_type"), "instance_id", "preorder", F.col("node_id").alias("kid"), F.col("total_us").alias("kid_total"), F.col("self_us").alias("kid_self"))
    pick = F.min_by(F.struct(F.col("kid").alias("node_id"), F.col("kid_total").alias("total_us"), F.col("kid_self").alias("self_us")), F.struct((F.col("instance_id") != 1).alias("a"), F.col("preorder").alias("b")))
    for d in range(1, OVERVIEW_DEPTH + 1):
        at = F.broadcast(level.select("root_type", "path", F.col("node_id").alias("parent_id"), F.col("total_us").alias("up")))
        j = kids.join(at, "parent_id")
        parents = keep(j.select(F.col("parent_id").alias("node_id")).distinct())
        own = level.where((F.col("total_us") > 0) & (F.col("self_us") / F.col("total_us") * 100 >= SELF_SHARE)).join(parents, "node_id", "left_semi")
        out = out.unionByName(own.select("root_type", F.lit("(self)").alias("module_type"), F.concat("path", F.lit("/(self)")).alias("path"), F.lit(d).alias("depth"), "node_id", (F.col("self_us") / F.col("total_us") * 100).alias("pct")))
        level = j.groupBy("root_type", "path", "kid_type", "up").agg(pick.alias("f"), F.sum("kid_total").alias("us"))
        level = level.select("root_type", F.col("kid_type").alias("module_type"), F.concat("path", F.lit("/"), "kid_type").alias("path"), "f.*", F.when(F.col("up") > 0, F.col("us") / F.col("up") * 100).otherwise(0.0).alias("pct"))
        level = keep(level)
        if level.isEmpty():
            break
        out = out.unionByName(level.select("root_type", "module_type", "path", F.lit(d).alias("depth"), "node_id", "pct"))
    out = out.join(stats, ["root_type", "module_type"], "left")
    if reps is not None:
        out = out.join(reps.withColumnRenamed("rep_kernel", "top_kernel"), "node_id", "left")
    return out.drop("node_id")


def detail_representatives(nodes: DataFrame, phases: DataFrame, signed: DataFrame) -> DataFrame:
    """Median instance per (type, phase, signature) of nodes with kernels."""
    n = nodes.join(phases, "node_id", "left").join(signed, "node_id").where("kernel_count > 0").fillna({"phase": ""})
    keys = ["module_type", "phase", "signature"]
    one = W.partitionBy(*keys, "instance_id").orderBy(F.col("kernel_count").desc(), "preorder")
    d = n.withColumn("_r", F.row_number().over(one)).where("_r = 1")
    w = W.partitionBy(*keys)
    d = d.withColumn("_k", F.row_number().over(w.orderBy("instance_id")) - 1).withColumn("_n", F.count("*").over(w))
    return d.where("_k = floor(_n / 2)").select(*keys, "node_id")


def details_of(subtree: DataFrame, details: DataFrame, limit: int = TAB_ROWS) -> DataFrame:
    """Kernels of the subtrees of (tab, node_id) in time order with FLOPs, the first
    ``limit`` of each tab; truncated tells that there are more."""
    d = subtree.join(details, "node_id")
    w = W.partitionBy("tab")
    wall = F.max(F.col("ts") + F.col("dur")).over(w) - F.min("ts").over(w)
    d = d.withColumn("position", F.row_number().over(w.orderBy("ts", "seq"))).withColumn("truncated", F.count("*").over(w) > limit).withColumn("wall_us", wall).where(F.col("position") <= limit)
    value = flops.flops(flops.shaped(flops.parsed_dims(F.col("dims"))), F.col("category"), F.col("name"))
    return d.select("tab", "position", "node_id", "name", "dur", (F.col("dur") / F.col("wall_us") * 100).alias("pct_of_wall"), "category", "dims", flops.formula(value, F.col("category")).alias("formula"), flops.tflop(value).alias("tflop"), flops.tflop_rate(value, F.col("dur")).alias("tflops"), "truncated")


def wrapper_chain(root: str, wrappers: set[str], kids: dict[str, list[tuple[str, float, float]]], share: float = 0.1) -> list[str]:
    """Leaves under a chain of wrapper types.  kids: type -> (child type, child time, own time)."""
    at, seen = root, set()
    while at in wrappers and at not in seen:
        seen.add(at)
        big = sorted(((t, us) for t, us, total in kids.get(at, []) if us > share * total), key=lambda x: (x[1], x[0]), reverse=True)
        if len(big) != 1:
            return [t for t, _ in big] or [at]
        at = big[0][0]
    return [at]


def select_details(types: list[tuple[str, float]], roots: list[str], wrappers: set[str], kids: dict, descendants: dict[str, set[str]], most: int) -> list[str]:
    """Types that get a detail tab: all chain leaves, then by time without wrappers and
    descendants of those chosen.  Types are few: a driver loop."""
    most = most or 999
    chosen: list[str] = []
    for r in roots:
        chosen += [t for t in wrapper_chain(r, wrappers, kids) if t not in chosen]
    for t, _ in sorted(types, key=lambda x: -x[1]):
        if len(chosen) >= most:
            break
        if t not in chosen and t not in wrappers and not any(t in descendants.get(c, ()) for c in chosen):
            chosen.append(t)
    return chosen


def summary(totals: DataFrame, nodes: DataFrame) -> DataFrame:
    """Root types by time with percent of the grand total."""
    roots = nodes.where("parent_id is null").join(totals, "node_id").groupBy("module_type").agg(F.sum("total_us").alias("total_us"))
    return roots.withColumn("pct", rollup.share_of_all("total_us")).orderBy(F.col("total_us").desc(), "module_type")


def layer_detail(nodes: DataFrame, ancestors: DataFrame, details: DataFrame, module_type: str, instance_id: int | None = None) -> DataFrame:
    """Kernels of one instance of a type (the median one where none is named) in time order with
    their percent of its wall time.  nodes: module_type, instance_id, kernel_count, preorder"""
    own = nodes.where(F.col("module_type") == module_type)
    one = rollup.median_instance(own) if instance_id is None else rollup.deduped_instances(own.where(F.col("instance_id") == instance_id))
    below = one.select(F.col("node_id").alias("ancestor")).join(ancestors, "ancestor").select(F.col("node").alias("node_id"))
    d = details.join(below, "node_id", "left_semi")
    wall = d.agg((F.max(F.col("ts") + F.col("dur")) - F.min("ts")).alias("wall_us"))
    j = d.crossJoin(F.broadcast(wall))  # one row
    return j.select("ts", "seq", "name", "category", "dur", F.when(F.col("wall_us") > 0, F.col("dur") / F.col("wall_us") * 100).alias("pct_of_wall")).orderBy("ts", "seq")


def instances_of(nodes: DataFrame, module_type: str, with_kernels: bool = False) -> DataFrame:
    """All instances of a type in preorder, or those that have kernels."""
    own = nodes.where(F.col("module_type") == module_type)
    return (own.where("kernel_count > 0") if with_kernels else own).orderBy("preorder")
