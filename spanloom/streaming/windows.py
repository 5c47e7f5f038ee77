"""Kernel time by category in event-time windows, with late data up to a watermark.

The batch engine needs no stream; this is an extension for traces that arrive in
parts.  The same function runs on a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.classify import kernel_category


def windowed_categories(kernels: DataFrame, length: str = "5 minutes", late: str = "10 minutes", rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """kernels: time timestamp, name, dur -> window start, category, n, us"""
    k = kernels.withColumn("category", kernel_category(F.col("name"), rules))
    if kernels.isStreaming:
        k = k.withWatermark("time", late)
    g = k.groupBy(F.window("time", length).alias("w"), "category").agg(F.count("*").alias("n"), F.sum("dur").alias("us"))
    return g.select(F.col("w.start").alias("start"), "category", "n", "us")
