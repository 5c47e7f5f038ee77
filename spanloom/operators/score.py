"""Quality scores of a parsed report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.numbers import grade

# Weights of the four rules and of the diagnostics.
WEIGHTS = {"S1": 25, "S2": 25, "S3": 25, "S4": 25}
TIME_WEIGHT, PATTERN_WEIGHT = 0.7, 0.3


def phase_coverage(tree: DataFrame, llm: DataFrame) -> DataFrame:
    """S1; tree: depth, phase; llm: one row is_llm"""
    t = tree.agg(F.max((F.col("depth") == 0)).alias("roots"), F.max(F.col("phase").isin("prefill", "pre")).alias("p"), F.max(F.col("phase").isin("decode", "dec")).alias("d"), F.max(F.col("phase") != "").alias("any")).crossJoin(llm)  # one row each
    t = t.select(*[F.coalesce(c, F.lit(False)).alias(c) for c in ("roots", "p", "d", "any")], "is_llm")
    tagged = F.when(F.col("roots"), 50).otherwise(0) + F.when(F.col("p"), 25).otherwise(0) + F.when(F.col("d"), 25).otherwise(0)
    return t.select(F.when(~F.col("roots") & ~F.col("any"), 0).when(~F.col("any"), F.when(F.col("is_llm"), 25).otherwise(100)).otherwise(tagged).cast("double").alias("score"))


def architecture(overview: DataFrame) -> DataFrame:
    """S2; overview: depth"""
    t = overview.agg(F.sum((F.col("depth") == 0).cast("long")).alias("roots"), F.max(F.col("depth") == 1).alias("kids"))
    base = F.when(F.col("roots") <= 3, 100).when(F.col("roots") <= 5, 90).when(F.col("roots") <= 10, 80).otherwise(60)
    return t.select(F.when(F.coalesce("roots", F.lit(0)) == 0, 0).otherwise(F.least(F.lit(100), base + F.when(F.col("kids"), 5).otherwise(0))).cast("double").alias("score"))


def instance_consistency(overview: DataFrame) -> DataFrame:
    """S3; overview: depth, count.  A row fits if its count and some different count, or the most, divide."""
    rows = overview.where("depth = 1 and count > 0").groupBy("count").agg(F.count("*").alias("n"))
    arr = F.collect_list(F.struct("count", "n"))  # distinct counts of one report
    fits = lambda x, all_: F.exists(all_, lambda y: ((y["count"] != x["count"]) | (y["count"] == F.array_max(F.transform(all_, lambda z: z["count"])))) & ((x["count"] % y["count"] == 0) | (y["count"] % x["count"] == 0)))
    t = rows.agg(arr.alias("a")).select("a", F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n"))
    good = F.aggregate(F.filter("a", lambda x: fits(x, F.col("a"))), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return t.select(F.when(F.col("n") < 2, 100.0).otherwise(good / F.col("n") * 100).alias("score"))


def cv_score(cv: Column, llm: Column) -> Column:
    steps = lambda a, b, c, d: F.when(cv <= a, 100).when(cv <= b, 80).when(cv <= c, 60).when(cv <= d, 40).otherwise(20)
    return F.when(llm, steps(0.05, 0.10, 0.20, 0.50)).otherwise(steps(0.10, 0.30, 0.50, 1.0))


def time_consistency(overview: DataFrame, llm: DataFrame) -> DataFrame:
    """S4; overview: module_type, depth, count, mean_us, std_us, total_us"""
    r = overview.where("count >= 3").crossJoin(F.broadcast(llm))  # one row
    twice = overview.groupBy("module_type").agg(F.count("*").alias("k")).where("k > 1").select("module_type")
    deep = r.where("depth >= 1")
    deep = deep.where("is_llm").unionByName(deep.where("not is_llm").join(twice, "module_type", "left_anti").select(deep.columns))
    has = deep.limit(1).select(F.lit(True).alias("has"))
    rows = r.where("depth = 0").join(F.broadcast(has), F.lit(True), "left_anti").select(deep.columns).unionByName(deep)
    rows = rows.dropDuplicates(["module_type", "count", "mean_us", "std_us"])
    cv = F.when(F.col("mean_us") > 0, F.col("std_us") / F.col("mean_us")).otherwise(0.0)
    s = rows.withColumn("s", cv_score(cv, F.col("is_llm")))
    w = F.sum("total_us")
    return s.agg(F.when(w > 0, F.sum(F.col("s") * F.col("total_us")) / w).otherwise(F.lit(100.0)).alias("score")).select(F.coalesce("score", F.lit(100.0)).alias("score"))


def composite(scores: DataFrame) -> DataFrame:
    """scores: rule, score -> composite and grade"""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    c = F.sum(F.round("score") * F.element_at(weight, F.col("rule")) / 100)
    return scores.agg(c.alias("composite")).withColumn("grade", grade(F.col("composite")))


def diagnostics(overview: DataFrame, sequences: DataFrame) -> DataFrame:
    """Score per group of 70 % time and 30 % kernel sequence.  sequences: module_type, instance, seq_hash, first"""
    share = sequences.join(sequences.where("first").select("module_type", F.col("seq_hash").alias("_h")), "module_type")
    match = share.groupBy("module_type").agg(F.count("*").alias("_n"), F.avg((F.col("seq_hash") == F.col("_h")).cast("double") * 100).alias("pattern")).where("_n >= 2").select("module_type", "pattern")
    cv = F.when(F.col("mean_us") > 0, F.col("std_us") / F.col("mean_us")).otherwise(0.0)
    time = F.when(cv <= 0.05, 100.0).when(cv <= 0.1, 80.0).when(cv <= 0.2, 60.0).otherwise(F.greatest(F.lit(0.0), 100 - 200 * cv))
    out = overview.join(match, "module_type", "left").fillna({"pattern": 100.0}).withColumn("time_score", time)
    return out.withColumn("score", TIME_WEIGHT * F.col("time_score") + PATTERN_WEIGHT * F.col("pattern"))


def ordered_diagnostics(overview: DataFrame, scored: DataFrame) -> DataFrame:
    """Diagnostics in the overview's order, each (type, count) once, with its root and grade.
    overview: row, depth, module_type, count; scored: module_type, count, score"""
    first = overview.groupBy("module_type", "count").agg(F.min_by(F.struct("row", "depth", "root"), "row").alias("f"))
    j = first.join(scored, ["module_type", "count"])
    return j.select("f.row", "f.root", "f.depth", "module_type", "count", "score", grade(F.col("score")).alias("grade")).orderBy("row")


def quality_rows(scores: DataFrame, total: DataFrame, groups: DataFrame) -> DataFrame:
    """section, metric, score, grade, detail: the rules, the composite, then the groups.
    scores: rule, score; total: composite; groups: module_type, count, score"""
    rules = scores.select(F.lit("rule").alias("section"), F.col("rule").alias("metric"), "score", grade(F.col("score")).alias("grade"), F.lit("").alias("detail"))
    one = total.select(F.lit("composite"), F.lit("composite"), "composite", grade(F.col("composite")), F.lit(""))
    per = groups.select(F.lit("group"), "module_type", "score", grade(F.col("score")), F.concat(F.lit("count="), F.col("count").cast("string")))
    return rules.union(one).union(per)


def passes(total: DataFrame, threshold: float) -> bool:
    """Whether the composite (one row) reaches the threshold."""
    return (total.first()["composite"] or 0.0) >= threshold
