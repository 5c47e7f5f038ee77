"""From a trace to report tables, and the command line."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import classify, text
from spanloom.operators import correlate, diff, phases, replay, report, rollup, score, tree, viewer, whatif
from spanloom.operators.kept import keep
from spanloom.sources import sinks, trace


def in_preorder(nodes: DataFrame) -> DataFrame:
    """Adds preorder: threads as first seen, then time; graph replays and their layers last.
    Numbers grow along the order and have gaps."""
    first = nodes.groupBy("thread").agg(F.min("seq").alias("_thread"))
    longer = F.when(F.col("synthetic"), 0.0).otherwise(-F.col("end"))
    n = nodes.join(first, "thread").repartitionByRange("synthetic", "_thread", "thread", "ts").sortWithinPartitions("synthetic", "_thread", "thread", "ts", longer, "seq")
    return keep(n.withColumn("preorder", F.monotonically_increasing_id()).drop("_thread"))


def analyze(events: DataFrame, rules: list[tuple[str, str]] | None = None, window: int | None = None) -> dict[str, DataFrame]:
    """Report tables of a trace.  Without module spans only the category table is made."""
    events = keep(events)
    d = trace.dispatch(events)
    full = trace.mode(events) == "full"
    kernels = d["kernels"].where(F.col("dur").isNotNull())
    if d["spans"].isEmpty():
        k = classify.classified(kernels, rules=rules)
        return {"categories": rollup.category_breakdown(k)}
    spans = d["spans"].select("thread", F.col("seq").alias("node_id"), F.col("label").alias("name"), "module_type", "instance_id", "ts", "end", "seq")
    nodes = in_preorder(tree.nest(spans, ["thread"]).withColumn("synthetic", F.lit(False)))
    at = spans.select("thread", "node_id", F.col("ts").alias("s"), F.col("end").alias("e"))
    if full:
        launches = correlate.deduped_launches(d["launches"].select("correlation", "kind", "seq", "thread", "ts"))
        k = kernels.select(F.col("seq").alias("event_id"), "correlation", "name", "ts", "dur", "src_rank", "seq")
        hit = keep(correlate.attributed(k, launches, at, ["thread"], window))
        miss = correlate.unmatched(k, hit)
        graph = keep(miss.join(correlate.graph_launches(d["launches"].where("kind = 'runtime'")), "correlation", "left_semi"))
        own, more = _replayed(graph, nodes)
        nodes = in_preorder(nodes.drop("preorder").unionByName(more))
        ops = d["ops"].where("input_dims is not null").select("thread", F.col("seq").alias("op_id"), F.col("ts").alias("s"), F.col("end").alias("e"), F.col("input_dims").alias("dims"))
        every = d["launches"].select("correlation", "seq", "thread", "ts").where("correlation is not null")
        shaped = correlate.shapes(every, ops, ["thread"])
        frames = d["frames"].select("thread", F.col("seq").alias("frame_id"), F.col("name").alias("frame"), F.col("ts").alias("s"), F.col("end").alias("e"))
        source = correlate.sources(every, frames, ["thread"])
        pick = ["event_id", "node_id", "correlation", "name", "ts", "dur", "seq"]
        details = hit.select(*pick).unionByName(own.select(*pick)).join(shaped, "correlation", "left").join(source, "correlation", "left")
    else:
        o = d["ops"].select(F.col("seq").alias("op_id"), "thread", "name", "ts", "dur", "seq")
        details = correlate.cpu_ops(o, at, ["thread"]).join(o, "op_id").select(F.col("op_id").alias("event_id"), "node_id", F.lit(None).cast("long").alias("correlation"), "name", "ts", "dur", "seq", F.lit(None).cast("string").alias("dims"), F.lit(None).cast("string").alias("source"))
    details = keep(classify.classified(details, rules=rules))
    up = keep(tree.closure(nodes))
    marks = phases.markers(d["frames"].select("name", "ts", "dur", "seq"))
    # Without markers the names of a node's own operators decide, which only nodes of cpu traces have.
    tagged = phases.majority(details.select("node_id", "name")) if not full and marks.isEmpty() else phases.tagged(nodes, up, marks)
    tags = keep(phases.filled(tagged.unionByName(nodes.where("synthetic").select("node_id", F.lit("decode").alias("phase"))).groupBy("node_id").agg(F.min("phase").alias("phase")), up))
    selfs, per = rollup.self_stats(details), rollup.self_breakdown(details)
    totals = keep(rollup.inclusive(selfs, up, nodes))
    roots = nodes.where("parent_id is null").select(F.col("node_id").alias("ancestor"))
    depths = tree.paths(nodes, up).join(up.join(roots, "ancestor", "left_semi").select(F.col("node").alias("node_id"), F.col("ancestor").alias("root_id")), "node_id")
    reps = keep(rollup.representative_kernel(nodes, totals, selfs, rollup.top_kernel(details)))
    counted = nodes.join(totals.select("node_id", F.col("total_count").alias("kernel_count")), "node_id")
    signed = tree.signatures(nodes)
    chosen = report.detail_representatives(counted, tags, signed) if full else None
    out = {
        "summary": report.summary(totals, nodes),
        "categories": rollup.category_breakdown(details),
        "overview": report.overview(nodes, up, totals, selfs, reps),
        "module_tree": report.module_tree(nodes, depths, totals, rollup.breakdown_text(rollup.inclusive_breakdown(per, up)), tags),
        "gpu_kernels": rollup.kernel_names(details, nodes),
        "node_stats": nodes.join(totals, "node_id").join(tags, "node_id", "left"),
    }
    if chosen is not None:
        sub = chosen.select(F.concat_ws(" ", "module_type", "phase", F.substring(F.sha2("signature", 256), 1, 6)).alias("tab"), F.col("node_id").alias("ancestor"))
        out["details"] = report.details_of(sub.join(up, "ancestor").select("tab", F.col("node").alias("node_id")), details)
    return out


#: More than a replay has layers; parts the numbers of synthetic nodes.
LAYERS = 1 << 20


def _replayed(graph: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kernels of graph replays under synthetic roots and layers, and those nodes."""
    names = replay.layer_names(nodes)
    k = graph.withColumn("seq", F.col("src_rank") * (1 << 50) + F.col("seq"))
    shape = keep(replay.templates(k, replay.distinct_halves(names)))
    runs = keep(replay.replays(k, shape).withColumn("root", -(F.col("correlation") * LAYERS + 1)))
    layered = keep(replay.layers(k, shape).join(runs.select("correlation", "root", "target"), "correlation").withColumn("node_id", F.col("root") - 1 - F.col("layer")))
    layers = layered.groupBy("node_id", "root", "layer", "target").agg(F.min("ts").alias("ts"), F.max(F.col("ts") + F.col("dur")).alias("end"), F.min("seq").alias("seq")).join(names, "layer", "left")
    label = F.when(F.col("target") & F.col("name").isNotNull(), F.col("name")).otherwise(F.concat(F.lit("Layer_"), F.col("layer").cast("string")))

    def node(df: DataFrame, **cols) -> DataFrame:
        df = df.select(*[c.alias(n) for n, c in cols.items()])
        return df.select(F.concat(F.lit("graph "), F.coalesce("parent_id", "node_id").cast("string")).alias("thread"), "node_id", "name", F.regexp_replace("name", r"_\d+$", "").alias("module_type"), F.coalesce(F.regexp_extract("name", r"_(\d+)$", 1).try_cast("long"), F.lit(0)).alias("instance_id"), "ts", "end", "seq", "parent_id", F.lit(True).alias("synthetic"))

    # A replay is a thread of its own, so its layers follow it; threads go by their root's start.
    top = node(runs, node_id=F.col("root"), name=F.col("name"), ts=F.col("ts"), end=F.col("end"), seq=F.lit(1 << 58) + (F.col("ts") * 1000).cast("long"), parent_id=F.lit(None).cast("long"))
    kids = node(layers.withColumn("label", label), node_id=F.col("node_id"), name=F.col("label"), ts=F.col("ts"), end=F.col("end"), seq=F.lit(1 << 59) + F.col("layer"), parent_id=F.col("root"))
    return layered.withColumn("seq", F.col("event_id")), top.unionByName(kids)


def compare(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """Difference tables of two gpu_kernels tables."""
    # The tables' rows go by time, then name, so the first row of a short name is the longest.
    row = F.struct((-F.col("total_us")).alias("t"), "name")
    x, y = (keep(diff.aggregated(t.select("name", "category", F.col("total_us").alias("us"), F.col("count").alias("n"), row.alias("seq")))) for t in (a, b))
    deltas, sides = keep(diff.kernel_delta(x, y)), diff.gone_new(x, y)
    found = [(r["label"], r["gone_us"], r["new_us"], r["net_us"]) for r in diff.replacements(sides)]
    return {
        "executive": diff.executive(x, y),
        "kernels": deltas,
        "categories": diff.category_delta(deltas),
        "drill_down": diff.drill_down(deltas),
        "attribution": diff.attribution(deltas),
        "changes": diff.same_kernel_changes(deltas),
        "gone_new": sides,
        "replacements": a.sparkSession.createDataFrame(found, "label string, gone_us double, new_us double, net_us double"),
        "actionable": diff.actionable(deltas),
    }


def quality(overview: DataFrame, nodes: DataFrame, details: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the quality scores (section, metric, score, grade, detail) and the composite (one row) of a
    report.  nodes: its node_stats; details: its details, for the kernel sequences."""
    spark = overview.sparkSession
    rows = keep(overview.where("module_type <> '(self)'").withColumn("total_us", F.col("sum_us").cast("double")))
    llm = keep(classify.is_llm(nodes))
    levels = nodes.select(F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"), F.coalesce("phase", F.lit("")).alias("phase"))
    rules = {"S1": score.phase_coverage(levels, llm), "S2": score.architecture(rows), "S3": score.instance_consistency(rows), "S4": score.time_consistency(rows, llm)}
    scores = keep(spark.createDataFrame([(k, df.first()["score"]) for k, df in rules.items()], "rule string, score double"))
    total = keep(score.composite(scores))
    if details is None:
        sequences = spark.createDataFrame([], "module_type string, node_id long, seq_hash string, first boolean")
    else:
        d = details.groupBy("tab", "node_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]), "\n"), 256).alias("seq_hash"))  # a tab holds 1000 rows at most
        d = d.dropDuplicates(["node_id"]).join(nodes.select("node_id", "module_type", "preorder"), "node_id")
        first = d.groupBy("module_type").agg(F.min("preorder").alias("_f"))
        sequences = d.join(first, "module_type").select("module_type", "node_id", "seq_hash", (F.col("preorder") == F.col("_f")).alias("first"))
    groups = score.diagnostics(rows.dropDuplicates(["module_type", "count"]), sequences)
    return score.quality_rows(scores, total, groups), total


def projection(overview: DataFrame, nodes: DataFrame, details: DataFrame, changes: DataFrame, output_tokens: int) -> dict[str, DataFrame]:
    """What changes of kernels (name, pct, seq) do to the modules, to the steps of each phase and to an
    answer of so many tokens.  overview, nodes (node_stats), details: tables of a report.  Tabs of a type and
    phase that differ in structure count as one module, by time."""
    part = lambda k: F.regexp_extract("tab", r"^(.*) (\S*) (\S+)$", k)
    wall = F.when(F.col("pct_of_wall") > 0, F.col("dur") / F.col("pct_of_wall") * 100).otherwise(0.0)
    d = keep(details.select(part(1).alias("module_type"), part(2).alias("phase"), "name", "dur", wall.alias("wall_us")))
    modules = keep(whatif.project(d, changes))
    o = overview.where("module_type <> '(self)'")
    above = o.select("module_type", F.explode(F.split("path", "/")).alias("ancestor")).where("ancestor <> module_type").distinct()
    roots = o.where("depth = 0").select("module_type", "mean_us")
    tree_ = nodes.select("module_type", F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"), "phase", F.col("preorder").alias("row"))
    model = keep(whatif.phase_models(roots, modules.select("module_type", "phase", "wall_us"), whatif.root_phases(tree_), above))
    shares = o.where("depth > 0").groupBy("root_type", "module_type").agg(F.sum("pct").alias("pct"))
    steps = None
    for p in sorted(r["phase"] for r in model.select("phase").distinct().collect()):  # prefill, decode or none
        own = whatif.propagated(model.where(F.col("phase") == p).select("module_type", "step_us", "pct_of_phase"), shares, modules.where(F.col("phase") == p)).withColumn("phase", F.lit(p))
        steps = own if steps is None else steps.unionByName(own)
    out = {"modules": modules, "kernels": whatif.ranked_kernels(d)}
    if steps is None:
        return out
    sums = steps.groupBy("phase").agg(F.sum("step_us").alias("step_us"), F.sum("new_step_us").alias("new_step_us"))
    return out | {"steps": steps, "phases": sums, "answer": whatif.end_to_end(sums, output_tokens)}


def label_of(folder: str) -> str:
    """The name of a report in a difference: the folder that holds it."""
    return os.path.basename(os.path.dirname(os.path.abspath(folder).rstrip("/"))) or folder


def show(title: str, df: DataFrame, most: int = 20) -> None:
    """The first rows of a report table on the console."""
    print(f"\n== {title} ==\n{text.table(df.columns, [tuple(r) for r in df.limit(most).collect()])}")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="spanloom")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("analyze", help="report tables of a trace")
    one.add_argument("trace")
    one.add_argument("-o", "--output", required=True, help="folder of the tables")
    one.add_argument("--workbook", help="also write an .xlsx file")
    one.add_argument("--html", help="also write a viewer page")
    one.add_argument("--rules", help="CSV of category,pattern")
    one.add_argument("--probe-window", type=int, help="look only at so many spans before a launch")
    two = sub.add_parser("compare", help="differences of two report folders")
    two.add_argument("base")
    two.add_argument("target")
    two.add_argument("-o", "--output", required=True)
    two.add_argument("--base-label")
    two.add_argument("--target-label")
    three = sub.add_parser("quality", help="scores of a report folder")
    three.add_argument("report")
    three.add_argument("--csv", help="file of the scores (default: quality.csv in the report folder)")
    three.add_argument("--json", action="store_true", help="print the scores as JSON")
    three.add_argument("--threshold", type=float, help="end with status 1 below this composite")
    four = sub.add_parser("project", help="what faster kernels do to a report")
    four.add_argument("report")
    four.add_argument("-c", "--change", action="append", default=[], metavar="NAME=PERCENT", required=True)
    four.add_argument("--output-tokens", type=int, default=1024)
    fix = sub.add_parser("repair", help="inject missing flow starts")
    fix.add_argument("trace")
    fix.add_argument("-o", "--output")
    fix.add_argument("--in-place", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("spanloom").getOrCreate()
    if a.command == "analyze":
        rules = trace.read_rules(spark, a.rules) if a.rules else None
        tables = analyze(trace.read_events(spark, a.trace), rules, a.probe_window)
        sinks.write_tables(tables, a.output)
        for name in ("summary", "categories"):
            if name in tables:
                show(name, tables[name])
        if a.workbook:
            sinks.write_workbook(tables, a.workbook)
        if a.html and "node_stats" in tables:
            n = tables["node_stats"]
            v = viewer.viewer_nodes(n.select("node_id", "parent_id", "module_type", "preorder", "name"), n.select("node_id", "total_us")).join(n.select("node_id", "name", "preorder"), "node_id").orderBy("preorder").limit(report.TREE_ROWS)
            sinks.write_html(viewer.nested_json([r.asDict() for r in v.collect()]), a.html)
    elif a.command == "compare":
        x, y = (spark.read.parquet(f"{f}/gpu_kernels") for f in (a.base, a.target))
        tables = compare(x, y)
        sinks.write_tables(tables, a.output)
        print(f"{a.base_label or label_of(a.base)} -> {a.target_label or label_of(a.target)}")
        for name in ("executive", "categories", "replacements", "actionable"):
            show(name, tables[name])
    elif a.command == "quality":
        read = lambda n: spark.read.parquet(f"{a.report}/{n}")
        try:
            details = read("details")
        except AnalysisException:  # reports of cpu traces have none
            details = None
        rows, total = quality(read("overview"), read("node_stats"), details)
        rows = keep(rows)
        sinks.write_scores(rows, a.csv or f"{a.report}/quality.csv")
        if a.json:
            print("[" + ",\n ".join(rows.toJSON().collect()) + "]")  # a row per rule and group
        else:
            show("quality", rows, 1000)
        return 0 if a.threshold is None or score.passes(total, a.threshold) else 1
    elif a.command == "project":
        pairs = [c.rpartition("=") for c in a.change]
        changes = spark.createDataFrame([(n, float(p), i) for i, (n, _, p) in enumerate(pairs)], "name string, pct double, seq long")
        overview, nodes, details = (spark.read.parquet(f"{a.report}/{n}") for n in ("overview", "node_stats", "details"))
        for name, df in projection(overview, nodes, details, changes, a.output_tokens).items():
            show(name, df)
    else:
        events = trace.read_events(spark, a.trace)
        r = correlate.repair_summary(events).first()
        print(f"{r['launches']} graph launches, {r['present']} flow starts present, {r['injected']} injected")
        trace.write_repaired(a.trace, correlate.missing_flow_starts(events), a.output, a.in_place)
    return 0


if __name__ == "__main__":
    sys.exit(main())
