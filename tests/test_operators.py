"""Operators on hand-derived micro fixtures and against small reference loops."""

import gzip
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import classify, flops, names, numbers
from spanloom.operators import correlate, diff, intervals, phases, replay, report, rollup, score, tree, viewer, whatif
from spanloom.plans import analyze
from spanloom.sources import sinks, trace
from spanloom.streaming.windows import windowed_categories

# name, ts, dur
NESTED = [("Model_0", 0, 100), ("LayerA_1", 0, 40), ("Attn_1", 5, 10), ("Attn_2", 30, 20), ("Norm_3", 45, 2), ("LayerB_2", 50, 30)]


def spans(spark, rows=NESTED):
    return spark.createDataFrame([("t", i, n, float(s), float(s + d), i) for i, (n, s, d) in enumerate(rows)], "thread string, node_id long, name string, ts double, end double, seq long")


def test_nesting(spark):
    got = {r["name"]: r["parent_id"] for r in tree.nest(spans(spark), ["thread"]).collect()}
    assert got == {"Model_0": None, "LayerA_1": 0, "Attn_1": 1, "Attn_2": 1, "Norm_3": 3, "LayerB_2": 0}


def stack_parents(rows):
    """rows sorted by (ts, -end, seq): parent by a stack."""
    out, stack = {}, []
    for node, ts, end in rows:
        while stack and stack[-1][1] <= ts:
            stack.pop()
        out[node] = stack[-1][0] if stack else None
        stack.append((node, end))
    return out


def test_nesting_equals_a_stack(spark):
    rng = random.Random(1)
    rows = [(str(k % 4), k, "x", float(ts := rng.randint(0, 3000)), float(ts + rng.choice([1, 5, 40, 300, 2500])), k) for k in range(400)]
    df = spark.createDataFrame(rows, "thread string, node_id long, name string, ts double, end double, seq long")
    want = {}
    for t in "0123":
        own = sorted((r for r in rows if r[0] == t), key=lambda r: (r[3], -r[4], r[5]))
        want |= stack_parents([(r[1], r[3], r[4]) for r in own])
    assert {r["node_id"]: r["parent_id"] for r in tree.nest(df, ["thread"]).collect()} == want


def test_deepest(spark):
    iv = spans(spark).select("thread", "name", F.col("ts").alias("s"), F.col("end").alias("e"), "node_id")
    pts = spark.createDataFrame([("t", i, float(x)) for i, x in enumerate([7, 15, 45, 48, 90, 100, 101])], "thread string, p long, ts double")
    got = {r["p"]: r["name"] for r in intervals.deepest(pts, iv, ["thread"], "p", ["name"], order="node_id").collect()}
    assert [got.get(i) for i in range(7)] == ["Attn_1", "Attn_1", "Norm_3", "Attn_2", "Model_0", "Model_0", None]


def test_deepest_with_a_window(spark):
    rows = [("P_0", 0, 1000)] + [(f"C_{i}", 2 * i + 1, 1) for i in range(25)]
    iv = spans(spark, rows).select("thread", "name", F.col("ts").alias("s"), F.col("end").alias("e"), "node_id")
    pts = spark.createDataFrame([("t", 1, 500.0)], "thread string, p long, ts double")
    assert [r["name"] for r in intervals.deepest(pts, iv, ["thread"], "p", ["name"], order="node_id").collect()] == ["P_0"]
    assert intervals.deepest(pts, iv, ["thread"], "p", ["name"], order="node_id", window=21).count() == 0


def test_deepest_equals_brute_force(spark):
    rng = random.Random(2)
    iv = [(str(k % 3), k, float(s := rng.randint(0, 10**5)), float(s + rng.choice([3, 90, 2000, 70000]))) for k in range(300)]
    pts = [(str(k % 3), k, float(rng.randint(0, 10**5))) for k in range(300)]
    got = {r["p"]: r["node_id"] for r in intervals.deepest(spark.createDataFrame(pts, "thread string, p long, ts double"), spark.createDataFrame(iv, "thread string, node_id long, s double, e double"), ["thread"], "p", ["node_id"], order="node_id").collect()}
    for t, p, x in pts:
        best = min(((e - s, s, -e, n) for th, n, s, e in iv if th == t and s <= x <= e), default=None)
        assert got.get(p) == (best[3] if best else None)


def test_as_of(spark):
    marks = spark.createDataFrame([(10.0, 20.0, "prefill", 0), (12.0, 14.0, "decode", 1), (3e7, 4e7, "prefill", 2)], "s double, e double, phase string, seq long")
    pts = spark.createDataFrame([(i, x) for i, x in enumerate([11.0, 13.0, 16.0, 5.0, 1e7, 3.5e7])], "node_id long, ts double")
    got = {r["node_id"]: r["phase"] for r in phases.start_phase(pts, marks).collect()}
    assert [got[i] for i in range(6)] == ["prefill", "decode", None, None, None, "prefill"]


def test_categories(spark):
    want = {"ncclDevKernel_AllReduce": "communication", "rotary_embedding_kernel": "embedding", "moeSoftmax": "attention", "fused_moe_kernel": "moe", "fp8_gemm_x": "quantization", "Cijk_Alik_Bljk_MT64": "gemm", "rmsnorm_kernel": "normalization", "im2col": "conv", "silu_and_mul": "elementwise", "foo": "other"}
    df = spark.createDataFrame([(k,) for k in want], "name string")
    assert {r["name"]: r["category"] for r in classify.classified(df).collect()} == want
    own = {r["name"]: r["category"] for r in classify.classified(df, rules=[("mine", "fo+")]).collect()}
    assert own["foo"] == "mine" and own["im2col"] == "other"
    types = spark.createDataFrame([("MoEGate",), ("GateProj",), ("FusedMoE",), ("QKVParallelLinear",), ("XDecoderLayer",), ("FooForCausalLM",), ("Bar",)], "module_type string")
    got = {r["module_type"]: r["c"] for r in types.select("module_type", classify.module_class(F.col("module_type")).alias("c")).collect()}
    assert got == {"MoEGate": "moe_router", "GateProj": "projection", "FusedMoE": "expert", "QKVParallelLinear": "projection", "XDecoderLayer": "decoder_layer", "FooForCausalLM": "model_root", "Bar": "default"}
    assert classify.is_llm(types).first()[0] and not classify.is_llm(types.limit(0)).first()[0]


def test_flops(spark):
    rows = [("[[2,3],[3,4]]", "gemm", "g", 48.0), ("[[2,3],[4,3]]", "gemm", "g", 48.0), ("[[5,2,3],[5,3,4]]", "moe", "g", 240.0), ("[[2,3],[5,7]]", "gemm", "g", None), ("[[4,8,64],[100,8,64]]", "attention", "decode", 819200.0), ("[[7],[2,3],[], [3,4]]", "gemm", "g", 48.0), ("nothing", "gemm", "g", None), (None, "gemm", "g", None), ("[[2,3],[3,4]]", "other", "g", None)]
    s = 75600
    rows += [(f"[[{s},40,192],[{s},40,192],[{s},40,128]]", "attention", "aiter::mla_pfl_qh192_vh128_x", 146.313e12), (f"[[{s},40,192],[512,40,192],[512,40,128]]", "attention", "aiter::mla_pfl_qh192_vh128_x", 0.991e12), ("[[4096,32,128],[4096,32,128],[4096,32,128]]", "attention", "flash_attn_hd128", 0.275e12), ("[[2048,16,64],[2048,16,64],[2048,16,64]]", "attention", "attn", 0.017e12), ("[[4,8,64],[100,8,64]]", "attention", "kn_mla_reduce_v1", None)]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, dims string, category string, name string")
    v = flops.flops(flops.shaped(flops.parsed_dims(F.col("dims"))), F.col("category"), F.col("name"))
    got = {r["i"]: r["v"] for r in df.select("i", v.alias("v")).collect()}
    for i, r in enumerate(rows):
        assert got[i] is None if r[3] is None else math.isclose(got[i], r[3], rel_tol=0.02 if r[3] > 1e9 else 1e-12), r


CATS = {"X": "foo", "A": "flash_attn", "C": "nccl", "M": "fused_moe"}


def test_segments_and_halves(spark):
    k = spark.createDataFrame([(1, i, CATS[c]) for i, c in enumerate("XACXMCACXMCX")] + [(2, i, CATS[c]) for i, c in enumerate("XAC")], "g long, pos long, name string").withColumn("kind", classify.graph_kind(F.col("name")))
    segs = replay.segments(k, ["g"])
    got = [(r["first"], r["first"] + r["n"], r["attn"], r["moe"]) for r in segs.where("g = 1").orderBy("seg").collect()]
    assert got == [(0, 3, True, False), (3, 6, False, True), (6, 8, True, False), (8, 11, False, True), (11, 12, False, False)]
    assert [(r["n"], r["attn"], r["known"]) for r in segs.where("g = 2").collect()] == [(3, False, False)]
    joined = [(r["first"], r["first"] + r["n"], r["moe"]) for r in replay.merged(segs, ["g"]).where("g = 1").orderBy("layer").collect()]
    assert joined == [(0, 6, True), (6, 11, True), (11, 12, False)]


def test_merging_equals_greedy(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(120):
        kinds = [(rng.random() < 0.6, rng.random() < 0.4) for _ in range(rng.randint(1, 9))]
        rows += [(g, i, i, 1, a, m, True) for i, (a, m) in enumerate(kinds)]
        i, out = 0, []
        while i < len(kinds):
            two = kinds[i][0] and not kinds[i][1] and i + 1 < len(kinds)
            out.append((i, 2 if two else 1))
            i += 2 if two else 1
        want[g] = out
    df = spark.createDataFrame(rows, "g long, seg long, first long, n long, attn boolean, moe boolean, known boolean")
    got = {}
    for r in replay.merged(df, ["g"]).orderBy("g", "layer").collect():
        got.setdefault(r["g"], []).append((r["first"], r["n"]))
    assert got == want


def test_statistics(spark):
    df = spark.createDataFrame([("a", 10), ("a", 20), ("a", 30), ("b", 5)], "k string, v long")
    got = {r["k"]: tuple(r)[1:] for r in rollup.time_stats(df, "k", "v").collect()}
    assert got == {"a": (3, 20.0, 10.0, 10, 30, 60), "b": (1, 5.0, 0.0, 5, 5, 5)}
    n = spark.createDataFrame([(i, "L", inst, k, i) for i, (inst, k) in enumerate([(1, 5), (1, 7), (2, 3), (4, 9)])], "node_id long, module_type string, instance_id long, kernel_count long, preorder long")
    assert {r["node_id"] for r in rollup.deduped_instances(n).collect()} == {1, 2, 3}
    assert [r["node_id"] for r in rollup.median_instance(n).collect()] == [2]
    w = spark.createDataFrame([(1, 0, 10), (1, 5, 10), (1, 30, 5)], "g int, ts long, dur long")
    assert tuple(rollup.wall_overlap(w, "g").first())[1:] == (25, 35, -10)


def test_replacements(spark):
    sides = spark.createDataFrame([("GONE", "gemm", 500.0), ("GONE", "attention", 300.0), ("NEW", "gemm", 450.0), ("NEW", "other", 400.0), ("GONE", "conv", 5.0)], "side string, category string, us double")
    assert [(r["label"], r["net_us"]) for r in diff.replacements(sides)] == [("attention → other", 100.0), ("gemm", -50.0)]
    alone = spark.createDataFrame([("GONE", "conv", 900.0), ("NEW", "moe", 150.0), ("NEW", "tiny", 20.0)], "side string, category string, us double")
    assert [(r["label"], r["gone_us"], r["new_us"], r["net_us"]) for r in diff.replacements(alone)] == [("conv", 900.0, None, -900.0), ("moe", None, 150.0, 150.0)]


def test_deltas_add_up(spark):
    rng = random.Random(4)
    a, b = (spark.createDataFrame([(f"k{rng.randint(0, 60)}", "gemm", rng.randint(1, 900), 1, i) for i in range(200)], "name string, category string, us long, n long, seq long") for _ in range(2))
    d = diff.kernel_delta(diff.aggregated(a), diff.aggregated(b))
    total = b.agg(F.sum("us")).first()[0] - a.agg(F.sum("us")).first()[0]
    assert d.agg(F.sum("delta_us")).first()[0] == total
    rows = diff.attribution(d).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows[-1]["cumulative_us"] == total
    run = 0
    for r in rows:
        run += r["delta_us"]
        assert r["cumulative_us"] == run
    assert [abs(r["delta_us"]) for r in rows] == sorted((abs(r["delta_us"]) for r in rows), reverse=True)


def test_tabs(spark):
    want = {"L (dec,A)": ("L", "dec", "A"), "L (A)": ("L", "", "A"), "Layer (dec)": ("Layer", "dec", ""), "Sampler": ("Sampler", "", "")}
    df = spark.createDataFrame([(k,) for k in want], "tab string")
    p = names.tab_parts(F.col("tab"))
    assert {r["tab"]: (r["base"], r["phase"], r["variant"]) for r in df.select("tab", *[c.alias(k) for k, c in p.items()]).collect()} == want
    a = spark.createDataFrame([("S",), ("L (dec,A)",), ("M (pre)",), ("N (A)",), ("Q",)], "tab string")
    b = spark.createDataFrame([("S",), ("L (A)",), ("M (dec)",), ("N (B)",), ("R",)], "tab string")
    got = {(r["base_tab"], r["target_tab"], r["step"]) for r in diff.matched_tabs(a, b).collect()}
    assert got == {("S", "S", 1), ("L (dec,A)", "L (A)", 2), ("M (pre)", "M (dec)", 2), ("N (A)", "N (B)", 3), ("Q", None, None), (None, "R", None)}
    long = spark.range(1).select(names.tab_name(F.lit("A" * 40), F.lit("prefill"), F.lit("B")).alias("t"), names.tab_name(F.lit("X"), F.lit(""), F.lit("")).alias("u")).first()
    assert long["t"] == "A" * 20 + " (pre,B)" and long["u"] == "X"


def test_names(spark):
    want = {"Custom_Cijk_X_MT128x64x32_Y": "hipblaslt GEMM (128x64x32)", "triton_poi_fused_add_mul_3": "triton::fused_add_mul", "attn_fwd": "attn_fwd (dist)", "x" * 70: "x" * 57 + "...", "Cijk_Ailk_z": "hipblaslt GEMM (small)", "ok": "ok"}
    df = spark.createDataFrame([(k,) for k in want], "name string")
    assert {r["name"]: r["s"] for r in df.select("name", names.short_kernel(F.col("name")).alias("s")).collect()} == want
    n = spark.createDataFrame([("Foo_12",), ("Foo",), ("A_b_3",)], "name string")
    assert {(r[0], r[1]) for r in n.select(names.module_type(F.col("name")), names.instance_id(F.col("name"))).collect()} == {("Foo", 12), ("Foo", 0), ("A_b", 3)}


def test_sources(spark):
    frames = [("app/m.py(3): f", 0, 100), ("app/m.py(9): wrapper", 10, 20), ("torch/x.py(1): g", 12, 5), ("<built-in method mm of type>", 13, 2)]
    f = spark.createDataFrame([("t", i, n, float(s), float(s + d)) for i, (n, s, d) in enumerate(frames)], "thread string, frame_id long, frame string, s double, e double")
    l = spark.createDataFrame([(1, 0, "t", 14.0), (2, 0, "u", 14.0)], "correlation long, seq long, thread string, ts double")
    assert [(r[0], r[1]) for r in correlate.sources(l, f, ["thread"]).collect()] == [(1, "app/m.py(3): f")]
    assert correlate.sources(l, f.where("frame_id = 3"), ["thread"]).first()["source"] == "<built-in mm>"


def test_scores(spark):
    llm = lambda x: spark.createDataFrame([(x,)], "is_llm boolean")
    t = spark.createDataFrame([(0, "")], "depth int, phase string")
    assert score.phase_coverage(t, llm(False)).first()[0] == 100 and score.phase_coverage(t, llm(True)).first()[0] == 25
    assert score.phase_coverage(spark.createDataFrame([(0, "prefill"), (1, "decode")], t.schema), llm(True)).first()[0] == 100
    assert score.phase_coverage(t.limit(0), llm(True)).first()[0] == 0
    o = spark.createDataFrame([(0,)] * 4 + [(1,)], "depth int")
    assert score.architecture(o).first()[0] == 95
    c = lambda xs: spark.createDataFrame([(1, x) for x in xs], "depth int, count long")
    assert score.instance_consistency(c([61, 61, 122])).first()[0] == 100 and score.instance_consistency(c([3, 5])).first()[0] == 50
    s = spark.createDataFrame([("A", 1, 61, 100.0, 4.0, 6100.0)], "module_type string, depth int, count long, mean_us double, std_us double, total_us double")
    assert score.time_consistency(s, llm(True)).first()[0] == 100
    r = score.composite(spark.createDataFrame([("S1", 100.0), ("S2", 95.0), ("S3", 50.0), ("S4", 100.0)], "rule string, score double")).first()
    assert r["composite"] == pytest.approx(86.25) and r["grade"] == "B"


def test_whatif(spark):
    d = spark.createDataFrame([("L", "pre", "k", 40.0, 80.0), ("L", "pre", "x", 60.0, 80.0)], "module_type string, phase string, name string, dur double, wall_us double")
    ch = spark.createDataFrame([("k", 50.0, 0), ("k", 10.0, 1)], "name string, pct double, seq long")
    r = whatif.project(d, ch).first()
    assert (r["new_sum_us"], r["new_wall_us"], r["delta_pct"]) == (80.0, 64.0, -20.0)
    s = spark.createDataFrame([("prefill", 1000.0, 1000.0), ("decode", 100.0, 80.0)], "phase string, step_us double, new_step_us double")
    e = whatif.end_to_end(s, 11).first()
    assert (e["e2e_us"], e["new_e2e_us"]) == (2000.0, 1800.0) and e["throughput_pct"] == pytest.approx(11.11, abs=0.01)


def test_patterns():
    assert viewer.repeating(list("ELALAN")) == (["L", "A"], 2, 1, 5)
    assert viewer.repeating(list("AA")) is None and viewer.repeating([]) is None
    assert viewer.repeating(list("AAAAAAAA"))[:2] == (["A"], 8)
    assert viewer.pattern_label(list("LLLA")) == "3×L + A"
    folded = viewer.fold({"type": "R", "children": [{"type": t, "children": []} for t in "ELALAN"]})
    assert [i.get("repeats") for i in folded["items"]] == [None, 2, None]


def event(**k):
    return {"ph": "X", **k}


def trace_doc():
    ev = [event(cat="python_function", name=f"nn.Module: {n}", ts=float(s), dur=float(d), pid=1, tid=2) for n, s, d in NESTED]
    ev += [event(cat="python_function", name="sgl/model_runner.py(1): forward_decode", ts=0.0, dur=90.0, pid=1, tid=2), event(cat="python_function", name="app/m.py(5): f", ts=4.0, dur=20.0, pid=1, tid=2)]
    ev += [event(cat="cpu_op", name="aten::mm", ts=6.0, dur=3.0, pid=1, tid=2, args={"Input Dims": [[2, 3], [3, 4], []]})]
    for c, ts in ((1, 7.0), (2, 35.0), (3, 46.0), (4, 60.0)):
        ev.append(event(cat="cuda_runtime", name="launch", ts=ts, dur=1.0, pid=1, tid=2, args={"correlation": c}))
        ev.append(event(cat="kernel", name="Cijk_Alik_Bljk_x" if c == 1 else "rmsnorm", ts=100.0 + 10 * c, dur=5.0, pid="gpu", tid=7, args={"correlation": c}))
    ev.append(event(cat="cuda_runtime", name="hipGraphLaunch", ts=500.0, dur=1.0, pid=1, tid=2, args={"correlation": 9}))
    ev += [event(cat="kernel", name=CATS[c], ts=600.0 + i, dur=1.0, pid="gpu", tid=7, args={"correlation": 9}) for i, c in enumerate("XACXMCACXMC")]
    ev += [{"ph": "s", "cat": "ac2g", "id": 7, "name": "ac2g", "pid": 1, "tid": 2, "ts": 1.0}, event(cat="cuda_runtime", name="hipGraphLaunch", ts=501.0, pid=1, tid=2, args={"correlation": 7}), event(cat="cuda_runtime", name="hipGraphLaunch", ts=502.0, pid=1, tid=2)]
    return {"traceEvents": ev}


def test_trace_to_report(spark, tmp_path):
    path = f"{tmp_path}/t.json.gz"
    with gzip.open(path, "wt") as f:
        json.dump(trace_doc(), f)
    events = trace.read_events(spark, path)
    assert events.count() == len(trace_doc()["traceEvents"]) and trace.mode(events) == "full"
    t = analyze.analyze(events)
    stats = {r["name"]: r for r in t["node_stats"].collect()}
    assert stats["Model_0"]["total_us"] == 20.0 and stats["LayerA_1"]["total_us"] == 15.0 and stats["Norm_3"]["total_count"] == 1
    assert stats["CudaGraphReplay_0"]["total_us"] == 11.0 and stats["Layer_0"]["total_us"] == 6.0
    assert stats["LayerA_1"]["phase"] == "decode" and stats["Model_0"]["phase"] is None
    d = {(r["name"], r["tab"][:4]): r for r in t["details"].collect()}
    g = next(r for (n, _), r in d.items() if n.startswith("Cijk"))
    assert g["tflop"] == pytest.approx(48e-12) and g["formula"] == "2*M*K*N"
    assert t["categories"].agg(F.sum("total_us")).first()[0] == 31.0
    assert t["overview"].where("module_type = 'Model'").first()["sum_us"] == 20.0
    sinks.write_workbook({"Summary": t["summary"], "Overview": t["overview"]}, f"{tmp_path}/r.xlsx")
    back = sinks.read_workbook(spark, f"{tmp_path}/r.xlsx")
    assert back["Summary"].count() == t["summary"].count() and set(back) == {"Summary", "Overview"}
    r = correlate.repair_summary(events).first()
    assert tuple(r) == (3, 1, 1)
    out = trace.write_repaired(path, correlate.missing_flow_starts(events))
    assert out == f"{tmp_path}/t_fixed.json.gz"
    fixed = trace.read_events(spark, out)
    assert fixed.count() == events.count() + 1 and trace.write_repaired(out, correlate.missing_flow_starts(fixed)) is None


def test_trace_variants(spark, tmp_path):
    bare = f"{tmp_path}/bare.json"
    with open(bare, "w") as f:
        json.dump(trace_doc()["traceEvents"], f)
    assert trace.read_events(spark, bare).count() > 10
    with open(f"{tmp_path}/none.json", "w") as f:
        f.write("{}")
    assert trace.read_events(spark, f"{tmp_path}/none.json").count() == 0
    ev = [e for e in trace_doc()["traceEvents"] if e.get("cat") not in ("kernel", "cuda_runtime")]
    with open(f"{tmp_path}/cpu.json", "w") as f:
        json.dump({"traceEvents": ev}, f)
    t = analyze.analyze(trace.read_events(spark, f"{tmp_path}/cpu.json"))
    assert "details" not in t and {r["name"]: r["total_us"] for r in t["node_stats"].collect()}["Attn_1"] == 3.0
    with open(f"{tmp_path}/bare_kernels.json", "w") as f:
        json.dump({"traceEvents": [e for e in trace_doc()["traceEvents"] if e.get("cat") == "kernel"]}, f)
    assert list(analyze.analyze(trace.read_events(spark, f"{tmp_path}/bare_kernels.json"))) == ["categories"]
    with open(f"{tmp_path}/rules.csv", "w") as f:
        f.write('category,pattern\nmine,"foo|bar"\n')
    assert trace.read_rules(spark, f"{tmp_path}/rules.csv") == [("mine", "foo|bar")] and trace.read_rules(spark, f"{tmp_path}/no.csv") == []


def test_wrapper_chain_and_selection():
    kids = {"W": [("A", 60.0, 100.0), ("B", 35.0, 100.0), ("C", 5.0, 100.0)], "V": [("W", 99.0, 100.0)]}
    assert report.wrapper_chain("V", {"V", "W"}, kids) == ["A", "B"]
    assert report.select_details([("V", 100), ("A", 60), ("B", 35), ("D", 30), ("C", 5)], ["V"], {"V", "W"}, kids, {"A": {"D"}}, 3) == ["A", "B", "C"]


def test_numbers(spark):
    r = spark.range(1).select(numbers.pct_change(F.lit(10), F.lit(15)).alias("a"), numbers.pct_change(F.lit(0), F.lit(5)).alias("b"), numbers.status(F.lit(0), F.lit(5)).alias("c"), numbers.tolerant_double(F.lit("1,234.5%")).alias("d"), numbers.tolerant_double(F.lit("x")).alias("e"), numbers.human_us(F.lit(1500.0)).alias("f"), numbers.breakdown_parts(F.lit("gemm: 1,234 us (5.6%), moe: 2 us (1.0%)")).alias("g")).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"]) == (50.0, None, "NEW", 1234.5, 0.0, "1.50 ms")
    assert [tuple(x) for x in r["g"]] == [("gemm", 1234.0, 5.6), ("moe", 2.0, 1.0)]


def test_depths_to_parents(spark):
    rows = spark.createDataFrame([(i, d) for i, d in enumerate([0, 1, 2, 2, 1, 0, 1])], "row long, depth int")
    assert [r["parent_row"] for r in tree.parents_by_depth(rows).orderBy("row").collect()] == [None, 0, 1, 1, 0, None, 5]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", "nccl" if m % 2 else "foo", float(m)) for m in range(30)], "time string, name string, dur double").withColumn("time", F.to_timestamp("time"))
    rows.write.parquet(f"{tmp_path}/in")
    q = windowed_categories(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("w")) == key(windowed_categories(rows))


def test_report_text(spark):
    from spanloom.functions import text

    rows = [(0, "A"), (1, "B"), (2, "C"), (2, "D"), (1, "E"), (2, "F"), (0, "G"), (1, "H")]
    assert text.tree_lines(rows) == ["A", "├── B", "│   ├── C", "│   └── D", "└── E", "    └── F", "G", "└── H"]
    assert text.tree_lines([]) == []
    df = spark.createDataFrame([(12, 100), (-1500, 3000), (2_345_678, 0)], "d long, b long")
    got = [r[0] for r in df.select(text.change_text(F.col("d"), F.col("b"))).collect()]
    assert got == ["+12us (+12.0%)", "-1.5ms (-50.0%)", "+2.35s"]
    assert [r[0] for r in df.where("d > 0").select(text.tab_us(F.col("d"))).collect()] == ["12.0us", "2345.7ms"]
    assert text.table(["name", "us"], [("k", 1.0), (None, 1234.5)]).splitlines()[2:] == ["k         1.0", "      1,234.5"]
    assert text.cut("abcdef", 4) == "ab.."


def test_phase_models(spark):
    roots = spark.createDataFrame([("Model", 100.0), ("Odd", 7.0)], "module_type string, mean_us double")
    above = spark.createDataFrame([("Layer", "Model")], "module_type string, ancestor string")
    tree = spark.createDataFrame([("Model", 0, "decode", 2), ("Model", 0, "prefill", 5), ("Layer", 1, "prefill", 1)], "module_type string, depth int, phase string, row long")
    tabs = spark.createDataFrame([("Model", "decode", 90.0), ("Layer", "decode", 9.0), ("Sampler", "decode", 25.0)], "module_type string, phase string, wall_us double")
    got = {(r["phase"], r["module_type"]): (r["step_us"], r["has_tab"], r["pct_of_phase"]) for r in whatif.phase_models(roots, tabs, whatif.root_phases(tree), above).collect()}
    assert got == {("decode", "Model"): (100.0, True, 80.0), ("decode", "Sampler"): (25.0, True, 20.0)}
    single = tabs.withColumn("phase", F.lit(""))
    got = {(r["phase"], r["module_type"]) for r in whatif.phase_models(roots, single, whatif.root_phases(tree), above).collect()}
    assert got == {("", "Model"), ("", "Odd"), ("", "Sampler")}


def test_commands(spark, tmp_path, capsys):
    with open(f"{tmp_path}/t.json", "w") as f:
        json.dump(trace_doc(), f)
    report_ = f"{tmp_path}/run/report"
    assert analyze.main(["analyze", f"{tmp_path}/t.json", "-o", report_]) == 0
    assert "== summary ==" in capsys.readouterr().out
    assert analyze.main(["quality", report_, "--csv", f"{tmp_path}/q.csv", "--json", "--threshold", "101"]) == 1
    got = {r["metric"]: r for r in json.loads(capsys.readouterr().out)}
    assert {"S1", "S2", "S3", "S4", "composite", "Model"} <= set(got)
    want = sum(score.WEIGHTS[k] * round(got[k]["score"]) / 100 for k in score.WEIGHTS)
    assert got["composite"]["score"] == pytest.approx(want)
    with open(f"{tmp_path}/q.csv") as f:
        assert f.readline().strip() == "section,metric,score,grade,detail" and len(f.readlines()) == len(got)
    assert analyze.main(["quality", report_, "--csv", f"{tmp_path}/q.csv", "--threshold", "0"]) == 0
    assert analyze.main(["compare", report_, report_, "-o", f"{tmp_path}/d"]) == 0
    assert "run -> run" in capsys.readouterr().out
    tables = [spark.read.parquet(f"{report_}/{n}") for n in ("overview", "node_stats", "details")]
    same = analyze.projection(*tables, spark.createDataFrame([("no such", 50.0, 0)], "name string, pct double, seq long"), 10)
    assert same["answer"].first()["throughput_pct"] == pytest.approx(0)
    names_ = [r[0] for r in tables[2].select("name").distinct().collect()]
    half = analyze.projection(*tables, spark.createDataFrame([(n, 50.0, 0) for n in names_], "name string, pct double, seq long"), 10)
    assert all(r["delta_pct"] == pytest.approx(-50) for r in half["modules"].collect())
    assert half["answer"].first()["new_e2e_us"] < half["answer"].first()["e2e_us"]
    assert analyze.main(["project", report_, "-c", f"{names_[0]}=50"]) == 0
    assert "== answer ==" in capsys.readouterr().out
