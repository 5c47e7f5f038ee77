"""Layers of graph replays: segmentation, half-layer merging, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.classify import graph_kind
from spanloom.operators.kept import keep


def segments(kernels: DataFrame, keys: list[str], order: str = "pos", kind: str = "kind") -> DataFrame:
    """Runs of kernels that end with a communication kernel: keys, seg, first, n, attn, moe;
    under two communication kernels there is one run of no kind."""
    w = W.partitionBy(*keys).orderBy(order)
    comm = (F.col(kind) == "COMM").cast("long")
    k = kernels.withColumn("_seg", F.coalesce(F.sum(comm).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_comms", F.sum(comm).over(W.partitionBy(*keys)))
    k = k.withColumn("seg", F.when(F.col("_comms") < 2, 0).otherwise(F.col("_seg")))
    known = F.col("_comms") >= 2
    return k.groupBy(*keys, "seg").agg(F.min(order).alias("first"), F.count("*").alias("n"), F.max((F.col(kind) == "ATTN") & known).alias("attn"), F.max((F.col(kind) == "MOE") & known).alias("moe"), F.max(known).alias("known"))


def merged(segs: DataFrame, keys: list[str]) -> DataFrame:
    """Half layers: a run with attention and no experts takes in the next one, from left to
    right.  keys, layer, first, n, attn, moe, halves."""
    w = W.partitionBy(*keys).orderBy("seg")
    last = F.lead("seg").over(w).isNull()
    s = segs.withColumn("_half", F.col("attn") & ~F.col("moe") & ~last & F.col("known"))
    s = s.withColumn("_brk", F.sum((~F.col("_half")).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    s = s.withColumn("_off", F.sum(F.col("_half").cast("long")).over(W.partitionBy(*keys, "_brk").orderBy("seg").rowsBetween(W.unboundedPreceding, 0)))
    # In a run of half layers each second one has been taken in already.
    s = s.withColumn("_start", F.col("_half") & (F.col("_off") % 2 == 1))
    s = s.withColumn("_taken", F.coalesce(F.lag("_start").over(w), F.lit(False)))
    s = s.withColumn("layer", F.sum((~F.col("_taken")).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    return s.groupBy(*keys, "layer").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.max("attn").alias("attn"), F.max("moe").alias("moe"), F.count("*").alias("halves"))


def half_layers(segs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, halved: whether attention-only runs are at least as many as full ones."""
    only = F.sum((F.col("attn") & ~F.col("moe")).cast("long"))
    full = F.sum((F.col("attn") & F.col("moe")).cast("long"))
    return segs.groupBy(*keys).agg((only >= full).alias("halved"))


def templates(kernels: DataFrame, distinct_halves: bool = False) -> DataFrame:
    """Layer boundaries per kernel count, from the first replay seen with that count.
    kernels: correlation, seq, name, ts.  size, layer, first, n, attn, moe, halves."""
    sizes = kernels.groupBy("correlation").agg(F.count("*").alias("size"), F.min("seq").alias("seen"))
    chosen = sizes.groupBy("size").agg(F.min_by("correlation", "seen").alias("correlation"))
    k = kernels.join(chosen, "correlation")
    k = k.withColumn("pos", F.row_number().over(W.partitionBy("size").orderBy("ts", "seq")) - 1).withColumn("kind", graph_kind(F.col("name")))
    segs = segments(k, ["size"])
    plain = segs.select("size", F.col("seg").alias("layer"), "first", "n", "attn", "moe", F.lit(1).cast("long").alias("halves"))
    if distinct_halves:
        return plain
    halved = half_layers(segs, ["size"])
    return merged(segs, ["size"]).join(halved.where("halved"), "size", "left_semi").unionByName(plain.join(halved.where("halved"), "size", "left_anti"))


def layers(kernels: DataFrame, shape: DataFrame) -> DataFrame:
    """Kernels with their replay's size and layer."""
    size = kernels.groupBy("correlation").agg(F.count("*").alias("size"))
    k = kernels.join(size, "correlation").withColumn("pos", F.row_number().over(W.partitionBy("correlation").orderBy("ts", "seq")) - 1)
    t = shape.select("size", "layer", F.col("first").alias("lo"), (F.col("first") + F.col("n")).alias("hi"))
    return k.join(t, "size").where("pos >= lo and pos < hi").drop("lo", "hi")


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ordinal: the place from 0 among the rows of a key.  Rows are sorted in ranges; a
    range's first place comes from the sizes of those before it, so no task sorts a whole key."""
    r = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    r = keep(r.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)  # the number of the range
    sizes = r.groupBy(F.col(key).alias("_key"), part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_key", "_part", (before - F.col("_first")).alias("_shift"))  # a row per key and range
    j = r.join(F.broadcast(sizes), F.col("_key").eqNullSafe(F.col(key)) & (part == F.col("_part")))
    return j.select(*rows.columns, (F.col("_id") + F.col("_shift")).alias("ordinal"))


def replays(kernels: DataFrame, shape: DataFrame) -> DataFrame:
    """Per replay: size, layers, kind (target, draft), name and ordinal among its kind.
    A target has at least half of the most layers, and two."""
    n = shape.groupBy("size").agg(F.count("*").alias("layers"))
    r = kernels.groupBy("correlation").agg(F.count("*").alias("size"), F.min("ts").alias("ts"), F.max(F.col("ts") + F.col("dur")).alias("end"))
    # A row per kernel count, of which N kernels have at most the root of 2N.
    s = r.select("size").distinct().join(n, "size")
    one = W.partitionBy(F.lit(0))
    least = F.greatest(F.floor(F.max("layers").over(one) / 2), F.lit(2))
    s = s.withColumn("target", F.col("layers") >= least)
    both = F.max("target").over(one) & ~F.min("target").over(one)
    s = s.withColumn("kind", F.when(both, F.when(F.col("target"), "target").otherwise("draft")).otherwise("all"))
    r = numbered(r.join(F.broadcast(s), "size"), "kind", ["ts", "correlation"]).withColumn("ordinal", F.col("ordinal").cast("int"))
    stem = F.when(F.col("kind") == "target", "CudaGraphReplay_target_").when(F.col("kind") == "draft", "CudaGraphReplay_draft_").otherwise("CudaGraphReplay_")
    return r.select("correlation", "size", "layers", "target", "kind", "ordinal", F.concat(stem, F.col("ordinal").cast("string")).alias("name"), "ts", "end")


def layer_names(nodes: DataFrame) -> DataFrame:
    """(layer, name) of captured decoder layers: direct children of roots, in preorder."""
    roots = nodes.where("parent_id is null").select(F.col("node_id").alias("parent_id"))
    kids = nodes.join(roots, "parent_id", "left_semi").where(F.col("module_type").rlike("DecoderLayer|TransformerBlock"))
    return kids.select((F.row_number().over(W.orderBy("preorder")) - 1).alias("layer"), "name")


def distinct_halves(names: DataFrame) -> bool:
    return names.select(F.regexp_replace("name", r"_\d+$", "").alias("t")).distinct().count() > 1
