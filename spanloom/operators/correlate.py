"""Kernels to launches, launches to modules, shapes and source lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.names import source_label, source_tier
from spanloom.operators.intervals import deepest, enclosing


def thread_key(pid: str = "pid", tid: str = "tid"):
    return F.coalesce(F.col(pid), F.col(tid))


def deduped_launches(launches: DataFrame) -> DataFrame:
    """One launch per correlation: the last runtime one, else the first driver one.
    launches: correlation, kind (runtime, driver), seq and others."""
    rest = [c for c in launches.columns if c != "correlation"]
    pick = F.struct((F.col("kind") == "runtime").alias("r"), F.when(F.col("kind") == "runtime", F.col("seq")).otherwise(-F.col("seq")).alias("s"))
    return launches.where("correlation is not null").groupBy("correlation").agg(F.max_by(F.struct(*rest), pick).alias("l")).select("correlation", "l.*")


def attributed(kernels: DataFrame, launches: DataFrame, spans: DataFrame, keys: list[str], window: int | None = None) -> DataFrame:
    """Kernels with the node whose span most narrowly encloses their launch; others are left out.
    kernels: event_id, correlation; launches: correlation, keys, ts; spans: keys, node_id, s, e."""
    at = deepest(launches.select("correlation", *keys, "ts"), spans, keys, "correlation", ["node_id"], order="node_id", window=window)
    return kernels.where("correlation is not null").join(at, "correlation")


def unmatched(kernels: DataFrame, matched: DataFrame) -> DataFrame:
    return kernels.join(matched.select("event_id"), "event_id", "left_anti")


def shapes(launches: DataFrame, ops: DataFrame, keys: list[str]) -> DataFrame:
    """Per correlation the shape of the narrowest shaped operator around a launch; of
    several launches, the first (seq) that has one.  ops: keys, op_id, s, e, dims."""
    pairs = enclosing(launches.select("correlation", "seq", *keys, "ts"), ops.where("dims is not null and dims <> ''"), keys)
    narrow = F.min_by("dims", F.struct((F.col("e") - F.col("s")).alias("a"), F.col("s").alias("b"), (-F.col("e")).alias("c"), F.col("op_id").alias("d")))
    each = pairs.groupBy("correlation", "seq").agg(narrow.alias("dims"))
    return each.groupBy("correlation").agg(F.min_by("dims", "seq").alias("dims"))


def sources(launches: DataFrame, frames: DataFrame, keys: list[str], shortest: float = 1.0) -> DataFrame:
    """Per correlation the best frame around a launch: by tier, then narrowest, then earliest.
    frames: keys, frame_id, frame, s, e."""
    pairs = enclosing(launches.select("correlation", "seq", *keys, "ts"), frames.where(F.col("e") - F.col("s") >= shortest), keys)
    best = F.min_by("frame", F.struct(source_tier(F.col("frame")).alias("t"), (F.col("e") - F.col("s")).alias("a"), F.col("s").alias("b"), (-F.col("e")).alias("c"), F.col("frame_id").alias("d")))
    each = pairs.groupBy("correlation", "seq").agg(best.alias("frame"))
    first = each.groupBy("correlation").agg(F.min_by("frame", "seq").alias("frame"))
    return first.select("correlation", source_label(F.col("frame")).alias("source"))


def cpu_ops(ops: DataFrame, spans: DataFrame, keys: list[str], shortest: float = 1.0) -> DataFrame:
    """(op_id, node_id) of operators of at least the shortest duration."""
    return deepest(ops.where(F.col("dur") >= shortest), spans, keys, "op_id", ["node_id"], order="node_id")


def graph_launches(runtime: DataFrame) -> DataFrame:
    """Correlations of graph launches among runtime events."""
    return runtime.where(F.col("name").rlike("hipGraphLaunch|cudaGraphLaunch") & F.col("correlation").isNotNull()).select("correlation").distinct()


def missing_flow_starts(events: DataFrame) -> DataFrame:
    """Flow-start events that graph launches lack.  events: ph, cat, name, id, pid, tid, ts, correlation."""
    launch = events.where((F.col("cat") == "cuda_runtime") & F.col("name").startswith("hipGraphLaunch") & F.col("correlation").isNotNull())
    have = events.where((F.col("ph") == "s") & (F.col("cat") == "ac2g")).select(F.col("id").alias("correlation")).distinct()
    lack = launch.join(have, "correlation", "left_anti")
    return lack.select(F.lit("s").alias("ph"), F.lit("ac2g").alias("cat"), F.lit("ac2g").alias("name"), F.col("correlation").alias("id"), "pid", "tid", "ts")


def repair_summary(events: DataFrame) -> DataFrame:
    """launches, present, injected"""
    n = events.where((F.col("cat") == "cuda_runtime") & F.col("name").startswith("hipGraphLaunch")).agg(F.count("*").alias("launches"))
    m = events.where((F.col("ph") == "s") & (F.col("cat") == "ac2g")).agg(F.countDistinct("id").alias("present"))
    k = missing_flow_starts(events).agg(F.count("*").alias("injected"))
    return n.crossJoin(m).crossJoin(k)  # one row each
