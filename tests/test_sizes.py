"""Findings on larger tables: rounding, skew, plans that must not gather or repeat work."""

from pyspark.sql import functions as F

from spanloom.functions import flops
from spanloom.operators import phases, viewer

DIR = "/root/testdata/sf0.001"


def test_percent_rounds_halves_as_sql(spark):
    nodes = spark.createDataFrame([(1, None, "M"), (2, 1, "L")], "node_id long, parent_id long, module_type string")
    totals = spark.createDataFrame([(1, 2000, 1), (2, 143, 1)], "node_id long, total_us long, total_count long")
    got = {r["node_id"]: r["pct_of_parent"] for r in viewer.viewer_nodes(nodes, totals).collect()}
    assert got == {1: 100.0, 2: 7.2}  # 7.15, a hair less as a double


def test_rounded(spark):
    from spanloom.functions.numbers import rounded

    df = spark.createDataFrame([(7.1499999999999995,), (-7.1499999999999995,), (2.25,), (0.0,), (1e308,), (float("inf"),), (float("nan"),), (None,)], "x double")
    got = [r[0] for r in df.select(rounded(F.col("x"), 1)).collect()]
    assert got[:6] == [7.2, -7.2, 2.3, 0.0, 1e308, float("inf")] and got[6] != got[6] and got[7] is None


def test_shapes_are_parsed_once(spark):
    df = spark.createDataFrame([("[[4,8,64],[100,8,64]]", "decode")], "dims string, name string")
    for v in (flops.attention_flops(flops.parsed_dims(F.col("dims")), F.col("name")), flops.gemm_flops(flops.shaped(flops.parsed_dims(F.col("dims"))))):
        plan = df.select(v.alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1, plan.count("from_json")


def below(plan, stop):
    """Whether a leaf is reached from a plan's node on a way without a node of that name."""
    kids = [plan.children().apply(i) for i in range(plan.children().size())]
    return plan.nodeName() != stop and (not kids or any(below(k, stop) for k in kids))


def nodes_of(plan, name):
    kids = [plan.children().apply(i) for i in range(plan.children().size())]
    return [*([plan] if plan.nodeName() == name else []), *(n for k in kids for n in nodes_of(k, name))]


def test_as_of_sorts_times_and_not_points(spark):
    marks = spark.createDataFrame([(10, 20, "prefill", 0), (12, 14, "decode", 1)], "s long, e long, phase string, seq long")
    pts = spark.range(4000).select(F.col("id").alias("node_id"), (F.col("id") % 4 * 5 + 5.5).alias("ts"))
    df = phases.start_phase(pts, marks)
    got = {(r["node_id"] % 4, r["phase"]) for r in df.collect()}
    # 20.5 lies after the end, though its whole part doesn't.
    assert got == {(0, None), (1, "prefill"), (2, None), (3, None)} and df.count() == 4000
    windows = nodes_of(df._jdf.queryExecution().optimizedPlan(), "Window")
    assert windows and not any(below(w, "Aggregate") for w in windows)


def test_rows_are_dealt_to_more_parts_with_the_size(spark, tmp_path, monkeypatch):
    from spanloom import derive

    t = derive.Trace(spark, DIR)
    monkeypatch.setattr(derive, "PART_BYTES", 10_000)
    assert t.details().rdd.getNumPartitions() >= 10  # the file of lineitem has over 100 kB


def test_names_are_made_without_the_kernels(spark):
    from spanloom import derive
    from spanloom.functions.classify import classified

    t = derive.Trace(spark, DIR)
    got = {(r["name"], r["category"]) for r in t.details().select("name", "category").distinct().collect()}
    assert got == {(r["name"], r["category"]) for r in classified(t.kernels().select("name").distinct()).collect()}
    scans = nodes_of(t.details()._jdf.queryExecution().optimizedPlan(), "Window")
    assert len(scans) == 2  # places of lines and of orders, once each


def scans(df, column):
    """How often the plan reads a table with that column."""
    return sum(column in n.toString() for n in nodes_of(df._jdf.queryExecution().optimizedPlan(), "LogicalRelation"))


def test_windowed_points_are_not_joined_by_their_id(spark):
    from spanloom.operators import intervals

    pts = spark.createDataFrame([("t", i, 10 * i + 5) for i in range(20)] + [("t", None, 7)], "thread string, p long, ts long")
    iv = spark.createDataFrame([("t", i, 10 * i, 10 * i + 30) for i in range(20)], "thread string, node_id long, s long, e long")
    df = intervals.deepest(pts, iv, ["thread"], "p", ["node_id"], order="node_id", window=2)
    assert {r["p"]: r["node_id"] for r in df.collect()} == {i: max(i - 1, 0) for i in range(20)}
    assert len(nodes_of(df._jdf.queryExecution().optimizedPlan(), "Join")) == 1


def test_replays_are_numbered_without_one_window(spark):
    from spanloom.operators import replay

    rows = [(i, "ab"[i % 3 == 0], i * 7 % 5) for i in range(500)]
    got = {r["i"]: r["ordinal"] for r in replay.numbered(spark.createDataFrame(rows, "i long, kind string, ts long").repartition(7), "kind", ["ts", "i"]).collect()}
    want = {i: k for kind in "ab" for k, (_, i) in enumerate(sorted((t, i) for i, x, t in rows if x == kind))}
    assert got == want


def test_kernels_are_made_once(spark):
    from spanloom import catalog, derive

    t = derive.Trace(spark, DIR)
    assert scans(t.launches(), "l_quantity") == scans(t.kernels(), "l_quantity") == 1
    for df in (catalog._deltas(t), *(catalog.QUERIES[q](spark, DIR) for q in ("tab_comparison", "module_category_time"))):
        assert scans(df, "l_quantity") == 0  # sums of one pass are kept


def test_overview_without_top_kernels(spark):
    from spanloom.operators import report, rollup, tree

    nodes = spark.createDataFrame([(1, None, "M", 1, 0), (2, 1, "L", 1, 1)], "node_id long, parent_id long, module_type string, instance_id long, preorder long")
    selfs = spark.createDataFrame([(2, 5, 1)], "node_id long, self_us long, self_count long")
    up = tree.closure(nodes)
    o = report.overview(nodes, up, rollup.inclusive(selfs, up, nodes), selfs)
    assert "top_kernel" not in o.columns and {r["path"]: r["pct"] for r in o.collect()} == {"M": 100.0, "M/L": 100.0}
