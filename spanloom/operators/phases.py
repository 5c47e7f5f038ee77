"""Prefill and decode phases of module nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.intervals import as_of


def markers(frames: DataFrame) -> DataFrame:
    """(s, e, phase, seq) of model-runner frames; frames: name, ts, dur, seq."""
    phase = F.when(F.col("name").contains(": forward_extend"), "prefill").when(F.col("name").contains(": forward_decode"), "decode")
    return frames.where(F.col("name").contains("model_runner") & F.col("dur").isNotNull()).withColumn("phase", phase).where("phase is not null").select(F.col("ts").alias("s"), (F.col("ts") + F.col("dur")).alias("e"), "phase", "seq")


def start_phase(nodes: DataFrame, marks: DataFrame) -> DataFrame:
    """(node_id, phase) by the last marker that starts at or before the node."""
    return as_of(nodes, marks, "node_id", ["phase"], order="seq")


def tagged(nodes: DataFrame, ancestors: DataFrame, marks: DataFrame) -> DataFrame:
    """Phase by marker: the shallowest node below a root that lies in a marker decides for its subtree."""
    own = start_phase(nodes.where("parent_id is not null"), marks).where("phase is not null")
    up = ancestors.join(own.select(F.col("node_id").alias("ancestor"), "phase"), "ancestor")
    return up.groupBy(F.col("node").alias("node_id")).agg(F.max_by("phase", "dist").alias("phase"))


def filled(tags: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Nodes without a phase take that of their shallowest tagged ancestor."""
    up = ancestors.join(tags.select(F.col("node_id").alias("ancestor"), "phase"), "ancestor")
    own = F.max(F.when(F.col("dist") == 0, F.col("phase")))
    return up.groupBy(F.col("node").alias("node_id")).agg(F.coalesce(own, F.max_by("phase", "dist")).alias("phase"))


def majority(ops: DataFrame) -> DataFrame:
    """(node_id, phase) by the names of a node's own operators; ties give none."""
    low = F.lower("name")
    n = ops.groupBy("node_id").agg(F.sum((low.contains("prefill") | low.contains("extend")).cast("long")).alias("p"), F.sum(low.contains("decode").cast("long")).alias("d"))
    return n.where("p <> d").select("node_id", F.when(F.col("p") > F.col("d"), "prefill").otherwise("decode").alias("phase"))


def root_phase(nodes: DataFrame, phases: DataFrame) -> DataFrame:
    """(module_type, phase) of root types: the first root's that has one, else that of most
    direct children (ties: first seen).  nodes: preorder."""
    p = nodes.join(phases, "node_id", "left")
    roots = p.where("parent_id is null").select("node_id", "module_type", "preorder", "phase")
    first = roots.where("phase is not null").groupBy("module_type").agg(F.min_by("phase", "preorder").alias("own"))
    kids = p.where("parent_id is not null and phase is not null").join(roots.select(F.col("node_id").alias("parent_id"), F.col("module_type").alias("root_type")), "parent_id")
    votes = kids.groupBy("root_type", "phase").agg(F.count("*").alias("n"), F.min("preorder").alias("seen"))
    most = votes.groupBy(F.col("root_type").alias("module_type")).agg(F.max_by("phase", F.struct("n", (-F.col("seen")).alias("s"))).alias("kids"))
    return roots.select("module_type").distinct().join(first, "module_type", "left").join(most, "module_type", "left").select("module_type", F.coalesce("own", "kids", F.lit("")).alias("phase"))
