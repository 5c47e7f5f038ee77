"""Self and inclusive time, breakdowns and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.numbers import rounded


def self_stats(details: DataFrame) -> DataFrame:
    """(node_id, self_us, self_count); details: node_id, dur, category, name, ts, seq."""
    return details.groupBy("node_id").agg(F.sum("dur").alias("self_us"), F.count("*").alias("self_count"))


def self_breakdown(details: DataFrame) -> DataFrame:
    return details.groupBy("node_id", "category").agg(F.sum("dur").alias("us"), F.count("*").alias("cnt"))


def inclusive(per_node: DataFrame, ancestors: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, total_us, total_count) over whole subtrees; nodes without kernels have 0.
    per_node is pre-aggregated, so each node goes up once per ancestor."""
    up = ancestors.join(per_node, ancestors.node == per_node.node_id).groupBy("ancestor").agg(F.sum("self_us").alias("us"), F.sum("self_count").alias("n"))
    return nodes.select("node_id").join(up, F.col("node_id") == F.col("ancestor"), "left").select("node_id", F.coalesce("us", F.lit(0)).alias("total_us"), F.coalesce("n", F.lit(0)).alias("total_count"))


def inclusive_breakdown(per_category: DataFrame, ancestors: DataFrame) -> DataFrame:
    return ancestors.join(per_category, ancestors.node == per_category.node_id).groupBy(F.col("ancestor").alias("node_id"), "category").agg(F.sum("us").alias("us"), F.sum("cnt").alias("cnt"))


def grand_total(totals: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: total_us and total_count over roots."""
    return totals.join(nodes.where("parent_id is null").select("node_id"), "node_id", "left_semi").agg(F.coalesce(F.sum("total_us"), F.lit(0)).alias("total_us"), F.coalesce(F.sum("total_count"), F.lit(0)).alias("total_count"))


def share_of_all(value: str) -> Column:
    """Percent of the sum over all rows of an aggregated table."""
    all_ = F.sum(value).over(W.partitionBy(F.lit(0)))
    return F.when(all_ > 0, F.col(value) / all_ * 100).otherwise(0.0)


def category_breakdown(details: DataFrame) -> DataFrame:
    """category, count, total_us, avg_us, pct"""
    g = details.groupBy("category").agg(F.count("*").alias("count"), F.sum("dur").alias("total_us"))
    return g.select("category", "count", "total_us", (F.col("total_us") / F.col("count")).alias("avg_us"), share_of_all("total_us").alias("pct"))


def kernel_names(details: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, category (first seen), total_us, count, avg_us, pct, module_types"""
    d = details.join(nodes.select("node_id", "module_type"), "node_id")
    pre = d.groupBy("name", "module_type").agg(F.min_by("category", "seq").alias("category"), F.min("seq").alias("seq"), F.sum("dur").alias("us"), F.count("*").alias("n"))
    g = pre.groupBy("name").agg(F.min_by("category", "seq").alias("category"), F.sum("us").alias("total_us"), F.sum("n").alias("count"), F.array_join(F.array_sort(F.collect_set("module_type")), ", ").alias("module_types"))
    return g.select("name", "category", "total_us", "count", (F.col("total_us") / F.col("count")).alias("avg_us"), share_of_all("total_us").alias("pct"), "module_types")


def time_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """count, mean, sample deviation (0 for one), least, most and sum"""
    return df.groupBy(by).agg(F.count("*").alias("count"), F.avg(value).alias("mean_us"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_us"), F.min(value).alias("min_us"), F.max(value).alias("max_us"), F.sum(value).alias("total_us"))


def top_kernel(details: DataFrame) -> DataFrame:
    """(node_id, top_kernel) by summed time of own kernels; ties: first in time"""
    g = details.groupBy("node_id", "name").agg(F.sum("dur").alias("us"), F.min(F.struct("ts", "seq")).alias("f"))
    return g.groupBy("node_id").agg(F.max_by("name", F.struct(F.col("us"), (-F.col("f.ts")).alias("t"), (-F.col("f.seq")).alias("s"))).alias("top_kernel"))


def wall_overlap(details: DataFrame, by: str) -> DataFrame:
    """kernel_sum_us, wall_us and overlap_us (their difference)"""
    g = details.groupBy(by).agg(F.sum("dur").alias("kernel_sum_us"), (F.max(F.col("ts") + F.col("dur")) - F.min("ts")).alias("wall_us"))
    return g.withColumn("overlap_us", F.col("kernel_sum_us") - F.col("wall_us"))


def deduped_instances(nodes: DataFrame) -> DataFrame:
    """Of nodes of a type with one instance id, that with the most kernels (ties: first).
    nodes: module_type, instance_id, kernel_count, preorder."""
    w = W.partitionBy("module_type", "instance_id").orderBy(F.col("kernel_count").desc(), "preorder")
    return nodes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def median_instance(nodes: DataFrame) -> DataFrame:
    """The upper middle instance of each type, by instance id."""
    w = W.partitionBy("module_type")
    d = deduped_instances(nodes).withColumn("_r", F.row_number().over(w.orderBy("instance_id")) - 1)
    return d.withColumn("_n", F.count("*").over(w)).where("_r = floor(_n / 2)").drop("_r", "_n")


def breakdown_text(per_category: DataFrame) -> DataFrame:
    """(node_id, breakdown): categories by time with their share, as one text"""
    w = W.partitionBy("node_id")
    p = per_category.where("us > 0").withColumn("_all", F.sum("us").over(w))
    part = F.concat("category", F.lit(": "), F.format_number(F.col("us").cast("double"), 0), F.lit(" us ("), F.format_string("%.1f", rounded(F.col("us") / F.col("_all") * 100, 1)), F.lit("%)"))
    items = F.sort_array(F.collect_list(F.struct((-F.col("us")).alias("a"), F.col("category").alias("b"), part.alias("c"))))
    return p.groupBy("node_id").agg(F.array_join(F.transform(items, lambda x: x["c"]), ", ").alias("breakdown"))


def representative_kernel(nodes: DataFrame, totals: DataFrame, selfs: DataFrame, tops: DataFrame, steps: int = 50) -> DataFrame:
    """(node_id, rep_kernel): down the heaviest child type's first child until own time is more, then the top own kernel."""
    t = nodes.join(totals, "node_id").join(selfs, "node_id", "left").select("node_id", "parent_id", "module_type", "preorder", "total_us", F.coalesce("self_us", F.lit(0)).alias("self_us"))
    by_type = t.where("parent_id is not null").groupBy("parent_id", "module_type").agg(F.sum("total_us").alias("us"), F.min_by("node_id", "preorder").alias("kid"), F.min("preorder").alias("p"))
    best = by_type.groupBy("parent_id").agg(F.max_by(F.struct("kid", "us"), F.struct("us", (-F.col("p")).alias("q"))).alias("b")).select(F.col("parent_id").alias("at"), "b.kid", "b.us")
    go = t.select(F.col("node_id").alias("at"), "self_us").join(best, "at").where("us >= self_us").select("at", "kid")
    where = nodes.select("node_id", F.col("node_id").alias("at"))
    for _ in range(steps):
        moved = where.join(go, "at", "left")
        if moved.where("kid is not null").isEmpty():
            break
        where = moved.select("node_id", F.coalesce("kid", "at").alias("at"))
    return where.join(tops.select(F.col("node_id").alias("at"), F.col("top_kernel").alias("rep_kernel")), "at", "left").select("node_id", "rep_kernel")
