"""Numbers of reports: changes, grades, tolerant parsing and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, k: int = 4) -> Column:
    """Halves away from zero after scaling, as SQL rounds doubles: 143 of 2000 is 7.2 %, whatever the last bit of 7.15."""
    scale, d = 10.0**k, c.cast("double")
    y = F.abs(d) * scale
    whole = F.rint(y) + F.when(y - F.rint(y) == 0.5, 1.0).otherwise(0.0)
    return F.when(y < float("inf"), F.signum(d) * whole / scale).otherwise(d)


def pct_change(base: Column, target: Column) -> Column:
    """Change in percent; null where there is no base but a target."""
    return F.when(base > 0, (target - base) / base * 100).when(base == target, 0.0)


def status(base: Column, target: Column) -> Column:
    return F.when(base == 0, "NEW").when(target == 0, "GONE").otherwise("changed")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def severity(delta: Column, base: Column) -> Column:
    """minor below 1 % and 100 us, else slower or faster."""
    share = F.when(base > 0, F.abs(delta) / base * 100).otherwise(100.0)
    return F.when((share < 1) & (F.abs(delta) < 100), "minor").when(delta > 0, "slower").otherwise("faster")


def tolerant_double(text: Column) -> Column:
    """Number of a cell with separators or a percent sign; 0 where there is none."""
    return F.coalesce(F.regexp_replace(text, "[,%]", "").try_cast("double"), F.lit(0.0))


def human_us(us: Column) -> Column:
    size = F.abs(us)
    return F.when(size >= 1e6, F.format_string("%.2f s", us / 1e6)).when(size >= 1e3, F.format_string("%.2f ms", us / 1e3)).otherwise(F.format_string("%.1f us", us))


def breakdown_parts(text: Column) -> Column:
    """Array of (category, us, percent) of a breakdown text."""
    hits = F.regexp_extract_all(text, F.lit(r"(\w+: [\d,.]+ us \([\d.]+%\))"), 1)
    return F.transform(hits, lambda h: F.struct(F.regexp_extract(h, r"^(\w+):", 1).alias("category"), F.regexp_replace(F.regexp_extract(h, r": ([\d,.]+) us", 1), ",", "").cast("double").alias("us"), F.regexp_extract(h, r"\(([\d.]+)%", 1).cast("double").alias("pct")))
