"""Profiler traces: JSON documents (gzip by suffix) to typed events."""

from __future__ import annotations

import gzip
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.names import SPAN_PREFIX, instance_id, module_type

EVENT = "struct<ph:string,cat:string,name:string,id:bigint,pid:string,tid:string,ts:double,dur:double,args:struct<correlation:bigint,`Input Dims`:string>>"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events with seq, their place in the file.  The document is an object with
    traceEvents or a bare list; without the key there are no events."""
    text = spark.read.text(path, wholetext=True).select("value")
    whole = F.from_json("value", f"struct<traceEvents:array<{EVENT}>>")["traceEvents"]
    bare = F.from_json("value", f"array<{EVENT}>")
    doc = text.select(F.when(F.ltrim("value").startswith("["), bare).otherwise(whole).alias("e"))
    return doc.select(F.posexplode("e").alias("seq", "e")).select(
        F.col("seq").cast("long").alias("seq"), "e.ph", "e.cat", "e.name", "e.id", "e.pid", "e.tid", "e.ts", "e.dur", F.col("e.args.correlation").alias("correlation"), F.col("e.args.`Input Dims`").alias("input_dims")
    )


def dispatch(events: DataFrame) -> dict[str, DataFrame]:
    """Views by kind; thread falls back to tid where there is no pid."""
    e = events.withColumn("thread", F.concat_ws("/", F.coalesce("pid", "tid"), "tid")).withColumn("end", F.col("ts") + F.col("dur"))
    py = e.where((F.col("cat") == "python_function") & F.col("dur").isNotNull())
    is_span = F.col("name").startswith(SPAN_PREFIX)
    rest = F.substring(F.col("name"), F.lit(len(SPAN_PREFIX) + 1), F.length("name"))
    gpu = F.when(F.col("cat") == "kernel", 0).when(F.col("cat") == "gpu_memcpy", 1).otherwise(2)
    return {
        "spans": py.where(is_span).withColumn("label", rest).select("seq", "thread", "label", module_type(F.col("label")).alias("module_type"), instance_id(F.col("label")).alias("instance_id"), "ts", "end"),
        "frames": py.where(~is_span),
        "kernels": e.where(F.col("cat").isin("kernel", "gpu_memcpy", "gpu_memset")).withColumn("src_rank", gpu),
        "launches": e.where(F.col("cat").isin("cuda_runtime", "cuda_driver")).withColumn("kind", F.when(F.col("cat") == "cuda_runtime", "runtime").otherwise("driver")),
        "ops": e.where(F.col("cat") == "cpu_op"),
    }


def mode(events: DataFrame) -> str:
    """full if there is a kernel event, else cpu_only."""
    return "cpu_only" if events.where("cat = 'kernel'").isEmpty() else "full"


def fixed_name(path: str) -> str:
    """Default name of a repaired trace."""
    for suffix in (".json.gz", ".json", ".gz"):
        if path.endswith(suffix):
            return path[: -len(suffix)] + "_fixed" + suffix
    return path + "_fixed"


def write_repaired(path: str, injected: DataFrame, target: str | None = None, in_place: bool = False) -> str | None:
    """A copy of one document with the injected events; nothing is written where there are
    none.  A document is one file, so this is driver code."""
    rows = [r.asDict() for r in injected.collect()]
    if not rows:
        return None
    target = path if in_place else target or fixed_name(path)
    opener = gzip.open if path.endswith(".gz") else open
    with opener(path, "rt") as f:
        doc = json.load(f)
    (doc if isinstance(doc, list) else doc.setdefault("traceEvents", [])).extend(rows)
    with (gzip.open if target.endswith(".gz") else open)(target + ".part", "wt") as f:
        json.dump(doc, f)
    os.replace(target + ".part", target)
    return target


def read_rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(category, pattern) in file order; a missing file gives no rules."""
    try:
        lines = [r[0] for r in spark.read.text(path).coalesce(1).collect()]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    import csv

    rows = list(csv.DictReader(lines))
    return [(r["category"].strip(), r["pattern"].strip()) for r in rows if r.get("pattern", "").strip()]
