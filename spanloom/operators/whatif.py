"""What-if projection of kernel speed-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project(details: DataFrame, changes: DataFrame) -> DataFrame:
    """By (module_type, phase): sums and wall times before and after; the overlap ratio stays.
    details: module_type, phase, name, dur, wall_us; changes: name, pct, seq (the first of a name counts)."""
    first = changes.groupBy("name").agg(F.min_by("pct", "seq").alias("pct"))
    d = details.join(first, "name", "left").withColumn("new", F.col("dur") * (1 - F.coalesce("pct", F.lit(0)) / 100))
    g = d.groupBy("module_type", "phase").agg(F.sum("dur").cast("double").alias("sum_us"), F.sum("new").alias("new_sum_us"), F.max("wall_us").cast("double").alias("wall_us"))
    g = g.withColumn("new_wall_us", F.when(F.col("sum_us") > 0, F.col("new_sum_us") * F.col("wall_us") / F.col("sum_us")).otherwise(F.col("wall_us")))
    return g.withColumn("delta_pct", F.when(F.col("sum_us") > 0, (F.col("new_sum_us") - F.col("sum_us")) / F.col("sum_us") * 100).otherwise(0.0))


def top_kernels(details: DataFrame, top: int = 10) -> DataFrame:
    """Most expensive kernels with where they occur."""
    best = details.groupBy("name").agg(F.sum("dur").alias("total_us")).orderBy(F.col("total_us").desc(), "name").limit(top)
    g = details.join(F.broadcast(best), "name").groupBy("name", "total_us", "module_type", "phase").agg(F.count("*").alias("n"), F.sum("dur").alias("us"))  # top rows
    return g


def root_modules(tabs: DataFrame, type_descendants: DataFrame) -> DataFrame:
    """Detail tabs none of whose ancestor types is a tab of the same phase."""
    up = tabs.select(F.col("module_type").alias("parent_type"), "phase").join(type_descendants, "parent_type").select(F.col("child_type").alias("module_type"), "phase").distinct()
    return tabs.join(up, ["module_type", "phase"], "left_anti")


def phase_steps(projected: DataFrame) -> DataFrame:
    """Step time by phase before and after."""
    return projected.groupBy("phase").agg(F.sum("wall_us").alias("step_us"), F.sum("new_wall_us").alias("new_step_us"))


def propagated(roots: DataFrame, shares: DataFrame, projected: DataFrame) -> DataFrame:
    """Root steps whose change comes from descendants: percent of parent by change.
    roots: module_type, step_us; shares: root_type, module_type, pct."""
    own = projected.select("module_type", F.col("delta_pct").alias("own"))
    below = shares.join(projected, "module_type").groupBy(F.col("root_type").alias("module_type")).agg(F.sum(F.col("pct") / 100 * F.col("delta_pct")).alias("below"))
    r = roots.join(own, "module_type", "left").join(below, "module_type", "left")
    return r.withColumn("delta_pct", F.coalesce("own", "below", F.lit(0.0))).withColumn("new_step_us", F.col("step_us") * (1 + F.col("delta_pct") / 100)).drop("own", "below")


def end_to_end(steps: DataFrame, output_tokens: int) -> DataFrame:
    """Time to first token, between tokens, and for a whole answer; one row.  Without
    phases the step itself."""
    def of(phase: str, col: str):
        return F.sum(F.when(F.col("phase") == phase, F.col(col)))

    s = steps.agg(of("prefill", "step_us").alias("ttft_us"), of("prefill", "new_step_us").alias("new_ttft_us"), of("decode", "step_us").alias("itl_us"), of("decode", "new_step_us").alias("new_itl_us"), F.sum("step_us").alias("_s"), F.sum("new_step_us").alias("_n"))
    llm = F.col("ttft_us").isNotNull() | F.col("itl_us").isNotNull()
    z = F.lit(0.0)
    e2e = F.when(llm, F.coalesce("ttft_us", z) + (output_tokens - 1) * F.coalesce("itl_us", z)).otherwise(F.col("_s"))
    new = F.when(llm, F.coalesce("new_ttft_us", z) + (output_tokens - 1) * F.coalesce("new_itl_us", z)).otherwise(F.col("_n"))
    return s.select("ttft_us", "new_ttft_us", "itl_us", "new_itl_us", e2e.alias("e2e_us"), new.alias("new_e2e_us"), F.when(new > 0, (e2e / new - 1) * 100).alias("throughput_pct"))


def model_kind(tabs: DataFrame) -> DataFrame:
    """One row: llm where a detail tab has a phase, else single."""
    return tabs.agg(F.when(F.coalesce(F.max(F.col("phase").isin("prefill", "decode", "pre", "dec")), F.lit(False)), "llm").otherwise("single").alias("kind"))


def ranked_kernels(details: DataFrame, top: int = 10) -> DataFrame:
    """Kernels by time from detail tabs, where there is no table of all kernels: sum, count and percent."""
    g = details.groupBy("name").agg(F.sum("dur").alias("total_us"), F.count("*").alias("n"))
    all_ = details.agg(F.sum("dur").alias("_all"))
    g = g.orderBy(F.col("total_us").desc(), "name").limit(top).crossJoin(F.broadcast(all_))  # top rows, one row
    return g.select("name", "total_us", "n", F.when(F.col("_all") > 0, F.col("total_us") / F.col("_all") * 100).otherwise(0.0).alias("pct"))


def accumulated(history: DataFrame, upto: int | None = None) -> DataFrame:
    """The changes in force after a session of them: of a kernel its first since the last reset.
    history: seq, name (null: reset), pct; upto: the last seq to count"""
    h = history if upto is None else history.where(F.col("seq") <= upto)
    last = h.where("name is null").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_reset"))
    h = h.where("name is not null").crossJoin(F.broadcast(last)).where(F.col("seq") > F.col("_reset"))  # one row
    return h.groupBy("name").agg(F.min_by("pct", "seq").alias("pct"), F.min("seq").alias("seq"))


def root_phases(tree: DataFrame) -> DataFrame:
    """(module_type, phase): the first phase that a root of the type has.
    tree: module_type, depth, phase, row"""
    return tree.where("depth = 0 and phase in ('prefill', 'decode')").groupBy("module_type").agg(F.min_by("phase", "row").alias("phase"))


def phase_models(roots: DataFrame, tabs: DataFrame, tree_phases: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Modules that make up a step of each phase with their percent of it.  Root types count with
    their mean time under the phase of the tree, else of their own tab, else of a tab below
    them (of several, the first by name); then come tabs that are no such root and have no tab of their
    phase above.  Without phases in the tabs all belong to the phase '', otherwise roots
    of unknown phase are left out.
    roots: module_type, mean_us; tabs: module_type, phase, wall_us; ancestors: module_type, ancestor"""
    kind = model_kind(tabs).select((F.col("kind") == "llm").alias("_llm"))
    named = tabs.where("phase <> ''")
    own = named.groupBy("module_type").agg(F.min("phase").alias("_own"))
    below = named.join(ancestors, "module_type").groupBy(F.col("ancestor").alias("module_type")).agg(F.min("phase").alias("_below"))
    tree = tree_phases.select("module_type", F.col("phase").alias("_tree"))
    r = roots.join(tree, "module_type", "left").join(own, "module_type", "left").join(below, "module_type", "left").crossJoin(F.broadcast(kind))  # one row
    r = r.withColumn("phase", F.when(F.col("_llm"), F.coalesce("_tree", "_own", "_below")).otherwise(F.lit(""))).where("phase is not null")
    r = r.select("module_type", "phase", F.col("mean_us").cast("double").alias("step_us")).join(tabs.select("module_type", "phase", F.lit(True).alias("has_tab")), ["module_type", "phase"], "left").fillna({"has_tab": False})
    above = ancestors.where("ancestor <> module_type").join(tabs.select(F.col("module_type").alias("ancestor"), "phase"), "ancestor").select("module_type", "phase").distinct()
    rest = tabs.join(r.select("module_type", "phase"), ["module_type", "phase"], "left_anti").join(above, ["module_type", "phase"], "left_anti")
    every = r.unionByName(rest.select("module_type", "phase", F.col("wall_us").cast("double").alias("step_us"), F.lit(True).alias("has_tab")))
    step = every.groupBy("phase").agg(F.sum("step_us").alias("_step"))
    return every.join(step, "phase").select("phase", "module_type", "step_us", "has_tab", F.when(F.col("_step") > 0, F.col("step_us") / F.col("_step") * 100).otherwise(0.0).alias("pct_of_phase"))
