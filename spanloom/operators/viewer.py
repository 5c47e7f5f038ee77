"""Data of the tree viewer: metrics, search, runs, repeating patterns, folding."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.classify import module_class
from spanloom.functions.numbers import rounded


def viewer_nodes(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """node_id, parent_id, class, total_us, pct_of_parent (1 decimal, roots 100), bar (share of the most)"""
    t = nodes.join(totals, "node_id")
    up = totals.select(F.col("node_id").alias("parent_id"), F.col("total_us").alias("_up"))
    most = t.agg(F.max("total_us").alias("_most"))
    j = t.join(up, "parent_id", "left").crossJoin(F.broadcast(most))  # one row
    pct = F.when(F.col("parent_id").isNull(), 100.0).when(F.col("_up") > 0, rounded(F.col("total_us") / F.col("_up") * 100, 1)).otherwise(0.0)
    return j.select("node_id", "parent_id", "module_type", module_class(F.col("module_type")).alias("class"), "total_us", pct.alias("pct_of_parent"), F.when(F.col("_most") > 0, F.col("total_us") / F.col("_most")).otherwise(0.0).alias("bar"))


def search(nodes: DataFrame, ancestors: DataFrame, text: str, column: str = "name") -> DataFrame:
    """Nodes whose name has the text, whatever the case, and all their ancestors."""
    hits = nodes.where(F.lower(column).contains(text.lower())).select(F.col("node_id").alias("node"))
    return ancestors.join(hits, "node", "left_semi").select(F.col("ancestor").alias("node_id")).distinct()


def of_phase(nodes: DataFrame, ancestors: DataFrame, phase: str) -> DataFrame:
    """Nodes of a phase and all their ancestors.  nodes: node_id, phase"""
    hits = nodes.where(F.col("phase") == phase).select(F.col("node_id").alias("node"))
    return ancestors.join(hits, "node", "left_semi").select(F.col("ancestor").alias("node_id")).distinct()


def expanded(ancestors: DataFrame, depth: int) -> DataFrame:
    """Nodes that show when the tree is open down to a depth: those with at most so many ancestors."""
    return ancestors.groupBy(F.col("node").alias("node_id")).agg(F.max("dist").alias("depth")).where(F.col("depth") <= depth)


def visible(ancestors: DataFrame, opened: DataFrame) -> DataFrame:
    """Nodes all of whose ancestors are open.  opened: node_id"""
    shut = ancestors.where("dist > 0").join(opened.select(F.col("node_id").alias("ancestor")), "ancestor", "left_anti").select("node").distinct()
    return ancestors.where("dist = 0").join(shut, "node", "left_anti").select(F.col("node").alias("node_id"))


def ordered_siblings(nodes: DataFrame, by: str = "original") -> DataFrame:
    """Place of each node among its siblings: original, time_up, time_down or kernels_down.
    nodes: node_id, parent_id, preorder, total_us, total_count"""
    first = {"original": [], "time_up": [F.col("total_us")], "time_down": [F.col("total_us").desc()], "kernels_down": [F.col("total_count").desc()]}[by]
    return nodes.withColumn("place", F.row_number().over(W.partitionBy("parent_id").orderBy(*first, "preorder"))).select("node_id", "parent_id", "place")


def architecture(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """Blocks of the main root (the model root with most children): embeddings are its header,
    the others its body, other roots the footer; each with its type's count and mean time."""
    t = nodes.join(totals, "node_id").withColumn("class", module_class(F.col("module_type")))
    kids = t.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("_kids"))
    roots = t.where("parent_id is null").join(kids, "node_id", "left").fillna({"_kids": 0})
    main = roots.agg(F.min_by("node_id", F.struct((F.col("class") != "model_root").alias("a"), (-F.col("_kids")).alias("b"), F.col("preorder").alias("c"))).alias("main"))
    stats = t.groupBy("module_type").agg(F.count("*").alias("count"), F.avg("total_us").alias("mean_us"))
    j = t.crossJoin(F.broadcast(main)).where((F.col("parent_id") == F.col("main")) | F.col("parent_id").isNull() & (F.col("node_id") != F.col("main")))  # one row
    part = F.when(F.col("parent_id").isNull(), "footer").when(F.col("class") == "embedding", "header").otherwise("body")
    g = j.groupBy(part.alias("part"), "module_type", "class").agg(F.count("*").alias("blocks"), F.min("preorder").alias("first"))
    return g.join(stats, "module_type")


def runs(nodes: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values: keys, run, value, n, first"""
    w = W.partitionBy(*keys).orderBy(order)
    new = (~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1)).cast("long")
    r = nodes.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return r.groupBy(*keys, "run").agg(F.min(value).alias(value), F.count("*").alias("n"), F.min(order).alias("first"))


def repeating(types: list[str], offsets: int = 5) -> tuple[list[str], int, int, int] | None:
    """(pattern, repeats, start, end) of the pattern that covers most; ties: earliest, shortest.

    Equal-run lengths of each period are found by one backward pass per period."""
    n = len(types)
    best = None
    for period in range(1, n // 2 + 1):
        same = 0  # how far types[i:] agrees with itself one period on
        reach = {}
        for i in range(n - period - 1, -1, -1):
            same = same + 1 if types[i] == types[i + period] else 0
            if i < offsets:
                reach[i] = same
        for start in range(min(n // 2, offsets)):
            if period > (n - start) // 2:
                continue
            repeats = reach.get(start, 0) // period + 1
            key = (-repeats * period, start, period)
            if repeats >= 2 and (best is None or key < best):
                best = key
    if best is None:
        return None
    cover, start, period = -best[0], best[1], best[2]
    pattern = types[start : start + period]
    if len(set(pattern)) == 1 and (cover <= 3 or n <= 6) or 2 * cover < n and cover <= 3:
        return None
    return pattern, cover // period, start, start + cover


def pattern_label(types: list[str]) -> str:
    """Runs like 3xL + A"""
    return " + ".join(f"{n}×{t}" if n > 1 else t for t, n in ((t, len(list(g))) for t, g in groupby(types)))


def patterns(nodes: DataFrame) -> DataFrame:
    """Repeating pattern of each parent's children; nodes: parent_id, preorder, module_type.
    A parent's child list is bounded by the viewer's row limit."""
    kids = nodes.where("parent_id is not null").groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("preorder", "module_type"))), lambda x: x["module_type"]).alias("types"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [repeating(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([pattern_label(f[0]) if f else None for f in found], pa.string()), *(pa.array([f[k] if f else None for f in found], pa.int64()) for k in (1, 2, 3))],
                names=["parent_id", "pattern", "repeats", "start", "end"],
            )

    return kids.mapInArrow(run, f"parent_id {dict(nodes.dtypes)['parent_id']}, pattern string, repeats long, start long, `end` long")


def fold(tree: dict) -> dict:
    """A collected tree with repeated children folded into groups, else runs."""
    kids = [fold(k) for k in tree.get("children", [])]
    found = repeating([k["type"] for k in kids])
    if not kids:
        return {"type": tree["type"], "items": []}
    if found is None:
        items = [{"type": t, "count": len(list(g))} for t, g in groupby(k["type"] for k in kids)]
        return {"type": tree["type"], "items": items}
    _, repeats, start, end = found
    unit = kids[start : start + (end - start) // repeats]
    return {"type": tree["type"], "items": [*kids[:start], {"repeats": repeats, "unit": unit}, *kids[end:]]}


def nested_json(rows: list[dict]) -> list[dict]:
    """Rows (node_id, parent_id, ...) in preorder to nested children."""
    at = {r["node_id"]: {**r, "children": []} for r in rows}
    top = []
    for r in rows:
        (at[r["parent_id"]]["children"] if r["parent_id"] in at else top).append(at[r["node_id"]])
    return top
