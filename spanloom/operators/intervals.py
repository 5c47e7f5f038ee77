"""Interval joins: containment with the best match, and as-of.

Intervals are put into buckets of a width that suits their own length (powers
of FACTOR), so an interval lies in at most FACTOR + 1 buckets and a point probes one
bucket per width in use.  The join is an equi-join on (keys, width, bucket)
with a residual range check; hot keys are parted by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FACTOR = 4
#: Widths run from BASE to BASE * FACTOR ** (LEVELS - 1); longer intervals share the last.
BASE, LEVELS = 64.0, 24


def _level(length: Column) -> Column:
    raw = F.ceil(F.log(F.greatest(length, F.lit(BASE)) / BASE) / F.log(F.lit(float(FACTOR))))
    return F.least(F.greatest(raw, F.lit(0)), F.lit(LEVELS - 1)).cast("int")


def _bucket(at: Column, level: Column) -> Column:
    return F.floor(at / (F.lit(BASE) * F.pow(F.lit(float(FACTOR)), level))).cast("long")


def enclosing(points: DataFrame, intervals: DataFrame, keys: list[str], at: str = "ts", start: str = "s", end: str = "e", half_open: bool = False) -> DataFrame:
    """All (point, interval) pairs with equal keys and start <= at <= end (< end if half
    open).  Other columns of both sides are kept and must differ in name."""
    spans = intervals.withColumn("_level", _level(F.col(end) - F.col(start)))
    spans = spans.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(start), F.col("_level")), _bucket(F.col(end), F.col("_level")))))
    used = [r[0] for r in spans.select("_level").distinct().collect()]  # at most LEVELS rows
    probe = points.withColumn("_level", F.explode(F.array(*[F.lit(x).cast("int") for x in used]) if used else F.array().cast("array<int>")))
    probe = probe.withColumn("_bucket", _bucket(F.col(at), F.col("_level")))
    inside = (F.col(start) <= F.col(at)) & ((F.col(at) < F.col(end)) if half_open else (F.col(at) <= F.col(end)))
    return probe.join(spans, [*keys, "_level", "_bucket"]).where(inside).drop("_level", "_bucket")


def deepest(points: DataFrame, intervals: DataFrame, keys: list[str], point_id: str, take: list[str], at: str = "ts", start: str = "s", end: str = "e", order: str | None = None, window: int | None = None) -> DataFrame:
    """Per point the narrowest enclosing interval's columns (ties: earlier start, later
    end, then ``order``); points outside all intervals are left out.

    With ``window``, only the last ``window`` intervals that start at or before
    the point, in (start, -end, order) order, are looked at."""
    tie = [F.col(order)] if order else []
    spans, pts = intervals, points
    if window is not None:
        w = W.partitionBy(*keys).orderBy(F.col(start), F.col(end).desc(), *tie)
        spans = intervals.withColumn("_rn", F.row_number().over(w))
        # Points and starts of a key meet in one sort; each point takes the number of the last start with it.
        row = F.struct(*points.columns)
        starts = spans.select(*keys, F.col(start).alias("_t"), F.lit(None).cast(points.select(row.alias("p")).schema["p"].dataType).alias("_p"), F.col("_rn"))
        marks = points.where(F.col(point_id).isNotNull()).select(*keys, F.col(at).alias("_t"), row.alias("_p"), F.lit(None).cast("int").alias("_rn"))
        upto = W.partitionBy(*keys).orderBy("_t", F.col("_p").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
        pts = starts.union(marks).withColumn("_last", F.max("_rn").over(upto)).where("_p is not null").select("_p.*", "_last")
    pairs = enclosing(pts, spans, keys, at, start, end)
    if window is not None:
        pairs = pairs.where(f"_rn > _last - {window} and _rn <= _last")
    best = F.min_by(F.struct(*take), F.struct((F.col(end) - F.col(start)).alias("a"), F.col(start).alias("b"), (-F.col(end)).alias("c"), *[t.alias("d") for t in tie]))
    return pairs.groupBy(point_id).agg(best.alias("_b")).select(point_id, "_b.*")


def as_of(points: DataFrame, markers: DataFrame, point_id: str, take: list[str], at: str = "ts", start: str = "s", end: str = "e", order: str | None = None) -> DataFrame:
    """Per point the columns of the last marker that starts at or before it (ties: last in
    ``order``), null unless the point is within that marker.  The distinct times of points and
    markers meet in one sort per time slice, so rows of one time or slice are not gathered in a task."""
    fields = F.struct(F.col(start).alias("_s"), (F.col(order) if order else F.lit(0)).alias("_o"), F.col(end).alias("_e"), *take)
    width = 1 << 20
    m = markers.where(F.col(start).isNotNull()).groupBy(F.col(start).alias("_t")).agg(F.max(fields).alias("_m")).withColumn("_k", F.lit(0)).withColumn("_at", F.lit(None).cast(dict(points.dtypes)[at]))
    p = points.select(F.col(at).alias("_at")).where("_at is not null").distinct().select(F.col("_at").alias("_t"), F.lit(None).cast(m.schema["_m"].dataType).alias("_m"), F.lit(1).alias("_k"), "_at")
    every = m.select("_t", "_m", "_k", "_at").union(p).withColumn("_w", F.floor(F.col("_t") / width))
    # The last marker of each time slice, carried to later slices: one row per slice.
    slices = every.groupBy("_w").agg(F.max("_m").alias("_top"))
    carried = slices.select("_w", F.max("_top").over(W.orderBy("_w").rowsBetween(W.unboundedPreceding, -1)).alias("_carry"))
    own = F.max("_m").over(W.partitionBy("_w").orderBy("_t", "_k").rowsBetween(W.unboundedPreceding, 0))
    found = every.withColumn("_own", own).where("_k = 1").join(carried, "_w", "left").select("_at", "_t", F.coalesce("_own", "_carry").alias("_f"))
    ok = F.col("_t") <= F.col("_f._e")
    hits = found.where(ok).select("_at", *[F.col(f"_f.{c}").alias(f"_m_{c}") for c in take])
    return points.select(point_id, F.col(at).alias("_at")).join(hits, "_at", "left").select(point_id, *[F.col(f"_m_{c}").alias(c) for c in take])
