"""Differences of two reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.names import short_kernel, tab_parts
from spanloom.functions.numbers import pct_change, status

# Significance in microseconds.
BLOCK_US, BLOCK_CATEGORY_US, TAB_CATEGORY_US, TAB_KERNEL_US, CHANGE_US, REPLACED_US, CATEGORY_US, RATIO = 50, 20, 10, 20, 50, 100, 100, 5


def aggregated(kernels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, short, category (of the first row), us, n.  kernels: name, category, us, n, seq."""
    keys = keys or []
    return kernels.withColumn("short", short_kernel(F.col("name"))).groupBy(*keys, "short").agg(F.min_by("category", "seq").alias("category"), F.sum("us").alias("us"), F.sum("n").alias("n"))


def executive(a: DataFrame, b: DataFrame) -> DataFrame:
    """base_us, target_us, delta_us, pct, verdict; a, b: us per kernel"""
    s = a.agg(F.sum("us").alias("base_us")).crossJoin(b.agg(F.sum("us").alias("target_us")))  # one row each
    d = F.col("target_us") - F.col("base_us")
    return s.select("base_us", "target_us", d.alias("delta_us"), pct_change(F.col("base_us"), F.col("target_us")).alias("pct"), F.when(d > 0, "SLOWER").otherwise("FASTER").alias("verdict"))


def kernel_delta(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Full outer join of two aggregates by short name."""
    on = [*(keys or []), "short"]
    x = a.select(*on, F.col("category").alias("_ca"), F.col("us").alias("_ua"), F.col("n").alias("_na"))
    y = b.select(*on, F.col("category").alias("_cb"), F.col("us").alias("_ub"), F.col("n").alias("_nb"))
    z = F.lit(0)
    j = x.join(y, on, "full")
    return j.select(*on, F.coalesce("_ca", "_cb").alias("category"), F.coalesce("_ua", z).alias("base_us"), F.coalesce("_ub", z).alias("target_us"), (F.coalesce("_ub", z) - F.coalesce("_ua", z)).alias("delta_us"), F.coalesce("_na", z).alias("base_n"), F.coalesce("_nb", z).alias("target_n"))


def category_delta(deltas: DataFrame) -> DataFrame:
    """By category: sums, percent, share of all absolute change."""
    g = deltas.groupBy("category").agg(F.sum("base_us").alias("base_us"), F.sum("target_us").alias("target_us"))
    g = g.withColumn("delta_us", F.col("target_us") - F.col("base_us"))
    all_ = F.sum(F.abs("delta_us")).over(W.partitionBy(F.lit(0)))
    return g.select("category", "base_us", "target_us", "delta_us", pct_change(F.col("base_us"), F.col("target_us")).alias("pct"), F.when(all_ > 0, F.abs("delta_us") / all_ * 100).otherwise(0.0).alias("share"))


def attribution(deltas: DataFrame) -> DataFrame:
    """Kernels by absolute change with running change, its percent and status.  Running sums
    come from sums per slice of the order, not from one window over all rows."""
    d = deltas.where("delta_us <> 0")
    all_ = d.agg(F.sum("delta_us").alias("_all"))
    d = d.withColumn("_slice", F.floor(F.log2(F.abs("delta_us").cast("double"))))
    slices = d.groupBy("_slice").agg(F.sum("delta_us").alias("_s"), F.count("*").alias("_c"))
    w = W.orderBy(F.col("_slice").desc()).rowsBetween(W.unboundedPreceding, -1)  # a row per power of two
    slices = slices.select("_slice", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"), F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_rows"))
    own = W.partitionBy("_slice").orderBy(F.abs("delta_us").desc(), "short").rowsBetween(W.unboundedPreceding, 0)
    j = d.withColumn("_run", F.sum("delta_us").over(own)).withColumn("_k", F.count("*").over(own)).join(slices, "_slice").crossJoin(F.broadcast(all_))  # one row
    run = F.col("_before") + F.col("_run")
    return j.select((F.col("_rows") + F.col("_k")).alias("rank"), "short", "category", "base_us", "target_us", "delta_us", run.alias("cumulative_us"), F.when(F.col("_all") != 0, run / F.col("_all") * 100).otherwise(0.0).alias("cumulative_pct"), status(F.col("base_us"), F.col("target_us")).alias("status"))


def same_kernel_changes(deltas: DataFrame, top: int = 20) -> DataFrame:
    return deltas.where(f"base_us > 0 and target_us > 0 and abs(delta_us) >= {CHANGE_US}").orderBy(F.abs("delta_us").desc(), "short").limit(top).select("short", "category", "base_us", "target_us", "delta_us", pct_change(F.col("base_us"), F.col("target_us")).alias("pct"))


def gone_new(a: DataFrame, b: DataFrame) -> DataFrame:
    gone = a.join(b.select("short"), "short", "left_anti").select("short", "category", "us", F.lit("GONE").alias("side"))
    return gone.unionByName(b.join(a.select("short"), "short", "left_anti").select("short", "category", "us", F.lit("NEW").alias("side")))


def replacements(sides: DataFrame) -> list[dict]:
    """Categories whose kernels went, came or were replaced; a missing side is None.  sides:
    category, side, us - one row per category and side, so the greedy pairing of categories with
    one side only is a driver loop.  Gone categories go by time, then name."""
    gone, new = ({r["category"]: float(r["us"]) for r in sides.where(F.col("side") == s).groupBy("category").agg(F.sum("us").alias("us")).collect()} for s in ("GONE", "NEW"))
    big = {c for c in {*gone, *new} if max(gone.get(c, 0.0), new.get(c, 0.0)) >= REPLACED_US}
    pairs: list[tuple[str | None, str | None]] = [(c, c) for c in big if c in gone and c in new]
    free = {c for c in big if c not in gone}
    for c in sorted((c for c in big if c not in new), key=lambda c: (-gone[c], c)):
        ratio = {x: max(gone[c], new[x]) / max(min(gone[c], new[x]), 1) for x in free}
        best = min(ratio, key=lambda x: (ratio[x], x), default=None)
        if best is not None and ratio[best] < RATIO:
            free.discard(best)
            pairs.append((c, best))
        else:
            pairs.append((c, None))
    pairs += [(None, c) for c in free]
    out = []
    for x, y in pairs:
        label = x if y in (None, x) else y if x is None else f"{x} → {y}"
        left, right = None if x is None else gone[x], None if y is None else new[y]
        out.append({"label": label, "gone_us": left, "new_us": right, "net_us": (right or 0.0) - (left or 0.0)})
    return sorted(out, key=lambda r: (-abs(r["net_us"]), r["label"]))


def drill_down(deltas: DataFrame, top: int = 5) -> DataFrame:
    """Categories in reading order (faster ones first, then slower ones, each by change, then the
    negligible) with their kernels that changed most and their share of the category's change."""
    g = deltas.groupBy("category").agg(F.sum("delta_us").alias("category_us"))
    way = F.when(F.col("category_us") < -CATEGORY_US, "faster").when(F.col("category_us") > CATEGORY_US, "slower").otherwise("negligible")
    g = g.withColumn("direction", way)
    # A row per category.
    order = W.partitionBy(F.lit(0)).orderBy(F.when(F.col("direction") == "faster", 0).when(F.col("direction") == "slower", 1).otherwise(2), F.when(F.col("direction") == "negligible", 0).otherwise(-F.abs("category_us")), "category")
    g = g.withColumn("position", F.row_number().over(order))
    k = deltas.where(F.abs("delta_us") >= CHANGE_US).withColumn("rank", F.row_number().over(W.partitionBy("category").orderBy(F.abs("delta_us").desc(), "short"))).where(F.col("rank") <= top)
    j = g.join(k.select("category", "rank", "short", "delta_us"), "category", "left")
    return j.select("position", "category", "direction", "category_us", "rank", "short", "delta_us", F.when(F.col("category_us") != 0, F.col("delta_us") / F.col("category_us") * 100).alias("share"))


def phase_breakdown(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per phase, tab of both sides and category: times of both and change, of tabs and
    categories that changed enough.  a, b: phase, tab, category, us"""
    keys = ["phase", "tab"]
    both = a.groupBy(*keys).agg(F.sum("us").alias("_x")).join(b.groupBy(*keys).agg(F.sum("us").alias("_y")), keys)
    both = both.where(F.abs(F.col("_y") - F.col("_x")) >= BLOCK_US).select(*keys, (F.col("_y") - F.col("_x")).alias("tab_delta_us"))
    x = a.groupBy(*keys, "category").agg(F.sum("us").alias("base_us"))
    y = b.groupBy(*keys, "category").agg(F.sum("us").alias("target_us"))
    j = x.join(y, [*keys, "category"], "full").join(both, keys)
    z = F.lit(0)
    j = j.select(*keys, "category", "tab_delta_us", F.coalesce("base_us", z).alias("base_us"), F.coalesce("target_us", z).alias("target_us"))
    return j.withColumn("delta_us", F.col("target_us") - F.col("base_us")).where(F.abs("delta_us") >= BLOCK_CATEGORY_US)


def tab_comparison(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Per matched tab its categories and kernels that changed enough, and unmatched tabs with
    their signed time.  pairs: base_tab, target_tab; a, b: tab, category, short, us"""
    pairs = pairs.select("base_tab", "target_tab")
    x = a.join(pairs, F.col("tab") == F.col("base_tab")).select("base_tab", "target_tab", "category", "short", F.col("us").alias("base_us"), F.lit(0).alias("target_us"))
    y = b.join(pairs, F.col("tab") == F.col("target_tab")).select("base_tab", "target_tab", "category", "short", F.lit(0).alias("base_us"), F.col("us").alias("target_us"))
    rows = x.unionByName(y)

    def by(name, kind: str, least: int) -> DataFrame:
        g = rows.groupBy("base_tab", "target_tab", F.lit(kind).alias("kind"), name.alias("name")).agg(F.sum("base_us").alias("base_us"), F.sum("target_us").alias("target_us"))
        return g.withColumn("delta_us", F.col("target_us") - F.col("base_us")).where(F.abs("delta_us") >= least)

    matched = F.col("base_tab").isNotNull() & F.col("target_tab").isNotNull()
    tabs = by(F.lit("").cast("string"), "tab", 0)
    return tabs.unionByName(by(F.col("category"), "category", TAB_CATEGORY_US).where(matched)).unionByName(by(F.col("short"), "kernel", TAB_KERNEL_US).where(matched))


def actionable(deltas: DataFrame, top: int = 3) -> DataFrame:
    """The kernels of both sides whose time changed most."""
    return deltas.where("base_us > 0 and target_us > 0").orderBy(F.abs("delta_us").desc(), "short").limit(top).select("short", "category", "base_us", "target_us", "delta_us")


def base_modules(a: DataFrame, b: DataFrame) -> DataFrame:
    """One tab's modules without their numbers, by signed change: times of both sides, the
    category with most time and the first place.  a, b: module, category, us, seq"""
    base = F.regexp_replace("module", r"_\d+$", "")
    x = a.select(base.alias("module"), "category", "seq", F.col("us").alias("base_us"), F.lit(0).alias("target_us"), F.col("us"))
    y = b.select(base.alias("module"), "category", "seq", F.lit(0).alias("base_us"), F.col("us").alias("target_us"), F.col("us"))
    g = x.unionByName(y).groupBy("module", "category").agg(F.sum("base_us").alias("base_us"), F.sum("target_us").alias("target_us"), F.sum("us").alias("us"), F.min("seq").alias("seq"))
    m = g.groupBy("module").agg(F.sum("base_us").alias("base_us"), F.sum("target_us").alias("target_us"), F.max_by("category", F.struct(F.col("us"), (-F.col("seq")).alias("s"))).alias("category"), F.min("seq").alias("first"))
    return m.withColumn("delta_us", F.col("target_us") - F.col("base_us")).orderBy("delta_us", "module")


def module_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Modules that both sides have; a, b: module_type, us"""
    j = a.select("module_type", F.col("us").alias("base_us")).join(b.select("module_type", F.col("us").alias("target_us")), "module_type")
    return j.withColumn("delta_us", F.col("target_us") - F.col("base_us")).withColumn("pct", pct_change(F.col("base_us"), F.col("target_us")))


def matched_tabs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(base_tab, target_tab, step): equal names; then type and variant, whatever the phase; then
    the type alone if one tab is left on each side.  Unmatched tabs have one null."""
    x = a.select(F.col("tab").alias("base_tab"), *[c.alias(f"b_{k}") for k, c in tab_parts(F.col("tab")).items()])
    y = b.select(F.col("tab").alias("target_tab"), *[c.alias(f"t_{k}") for k, c in tab_parts(F.col("tab")).items()])
    one = x.join(y, F.col("base_tab") == F.col("target_tab")).select("base_tab", "target_tab", F.lit(1).alias("step"))
    x2, y2 = x.join(one, "base_tab", "left_anti"), y.join(one, "target_tab", "left_anti")
    xr = x2.withColumn("k", F.row_number().over(W.partitionBy("b_base", "b_variant").orderBy("base_tab")))
    yr = y2.withColumn("k", F.row_number().over(W.partitionBy("t_base", "t_variant").orderBy("target_tab")))
    two = xr.join(yr, (F.col("b_base") == F.col("t_base")) & (F.col("b_variant") == F.col("t_variant")) & (xr.k == yr.k)).select("base_tab", "target_tab", F.lit(2).alias("step"))
    x3, y3 = x2.join(two, "base_tab", "left_anti"), y2.join(two, "target_tab", "left_anti")
    xs = x3.groupBy("b_base").agg(F.min("base_tab").alias("base_tab"), F.count("*").alias("n")).where("n = 1")
    ys = y3.groupBy("t_base").agg(F.min("target_tab").alias("target_tab"), F.count("*").alias("n")).where("n = 1")
    three = xs.join(ys, F.col("b_base") == F.col("t_base")).select("base_tab", "target_tab", F.lit(3).alias("step"))
    found = one.union(two).union(three)
    only_a = x3.join(three, "base_tab", "left_anti").select("base_tab", F.lit(None).cast("string").alias("target_tab"), F.lit(None).cast("int").alias("step"))
    only_b = y3.join(three, "target_tab", "left_anti").select(F.lit(None).cast("string").alias("base_tab"), "target_tab", F.lit(None).cast("int").alias("step"))
    return found.union(only_a).union(only_b)


def side_by_side(a: DataFrame, b: DataFrame, key: str = "module_type") -> DataFrame:
    """Kernels of each module ranked by time on both sides.  a, b: key, name, us"""
    def ranked(x: DataFrame, p: str) -> DataFrame:
        w = W.partitionBy(key).orderBy(F.col("us").desc(), "name")
        return x.select(key, F.row_number().over(w).alias("rank"), F.col("name").alias(f"{p}_name"), F.col("us").alias(f"{p}_us"))

    return ranked(a, "base").join(ranked(b, "target"), [key, "rank"], "full")
