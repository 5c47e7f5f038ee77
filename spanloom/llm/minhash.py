"""Near-duplicate groups of documents by DartMinHash signatures.

A document is the weighted set of its five-word shingles (weight: occurrences).
Darts are thrown at the plane of weight by time in every element's region: the
plane is parted into dyadic cells (weight [0,1), [1,2), [2,4), ...; time [0,e),
[e,2e), [2e,4e), ...), the number and places of a cell's darts follow from a hash
of element and cell alone, and only the cells below the element's weight and
the document's time horizon are visited.  Each dart has a coordinate; the
earliest of each coordinate is the signature, so two documents agree in a
coordinate with the probability of their weighted Jaccard similarity.

BANDS bands of ROWS coordinates give bucket keys.  Documents with equal sets
are one class and take part once.  In a bucket, members are compared with hubs
rather than with one another: first the most central one, the node whose buckets
hold most members (of a group of edited copies, the text they come from or the
nearest to it), then HUBS more where several components still share a bucket;
every comparison computes the exact similarity from the sets.  Texts of a bucket that
are still apart are then decided by how they differ from their hub, which gives what any
two of them have in common; of the links found so, a spanning forest is enough.  Connected
components of the links are the groups; the row with the smallest doc_id stays.  Texts are
never shuffled: tasks that read them look up which are needed by row number.

Defined cases: words are lower-cased runs as in ``words``; a text of one to
four words is one shingle; texts without words (null or empty too) link with
nothing; rows that repeat are duplicates of one another; null doc_ids come after
all others when the one that stays is chosen; very long texts are hashed in pieces and
compared whole; an empty table gives an empty one; columns other than those named pass unused,
and a column may be named like one of the results unless it is carried.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.components import connected_components
from spanloom.llm.storage import Beside, beside, discard, ship, shuffle_parts, written
from spanloom.llm.words import batch_word_hashes, mix, shingle_hashes

COORDINATES = 100
BANDS = 20
ROWS = 5
THRESHOLD = 0.8
#: Further hubs of a bucket that more than one component shares.
HUBS = 4
#: End of the first time cell; it holds a fraction of a dart per unit of weight.
_FIRST = 2.0**-3
_U = np.uint64
_ONE_BIT = _U(1)
_ONE = 1.0 / (1 << 53)


def weighted_shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and how often each occurs."""
    return np.unique(shingle_hashes(words), return_counts=True)


@lru_cache(maxsize=4096)
def _poisson(area: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts in a cell."""
    most = int(area + 12 * math.sqrt(area) + 16)
    k = np.arange(most)
    logs = -area + k * math.log(area) - np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, most)))))
    return np.cumsum(np.exp(logs))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * _ONE


def _seed(*parts: int) -> np.uint64:
    h = 0x243F6A8885A308D3
    for p in parts:
        h = ((h ^ p) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return _U(h)


_COUNT, _NAME = _seed(1), _seed(2)


def signature(elements: np.ndarray, weights: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each coordinate."""
    best_time = np.full(k, np.inf)
    best = np.zeros(k, _U)
    total = float(weights.sum())
    needed = (k * math.log(k) + 2 * k) / total
    low, high, cell = 0.0, _FIRST, 0
    top = int(weights.max() - 1).bit_length()
    groups = []  # of elements that reach into a weight cell
    for nu in range(top + 1):
        start = 0.0 if nu == 0 else float(1 << (nu - 1))
        reach = weights > start
        groups.append((nu, start, 1.0 if nu == 0 else start, elements[reach], weights[reach].astype(np.float64)))
    while True:
        for nu, start, width, own, weight in groups:
            if not len(own):
                continue
            u = _unit(mix(own ^ _seed(3, nu, cell)))
            n = np.searchsorted(_poisson(width * (high - low)), u, "right")
            some = np.flatnonzero(n)
            if not len(some):
                continue
            n = n[some]
            who = np.repeat(some, n)
            j = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            dart = mix((own[who] ^ _seed(4, nu, cell)) + (j.astype(_U) + _U(1)) * _NAME)
            keep = start + width * _unit(mix(dart ^ _COUNT)) < weight[who]
            dart = dart[keep]
            time = low + (high - low) * _unit(mix(dart + _NAME))
            at = (dart % _U(k)).astype(np.int64)
            order = np.argsort(-time, kind="stable")
            t, a, d = time[order], at[order], dart[order]
            first = np.full(k, np.inf)
            name = np.zeros(k, _U)
            first[a], name[a] = t, d  # the last written, the earliest, stays
            better = first < best_time
            best_time[better], best[better] = first[better], name[better]
        low, high, cell = high, 2 * high, cell + 1
        if low >= needed and not np.isinf(best_time).any():
            return best


def bands_of(sig: np.ndarray) -> np.ndarray:
    """Bucket keys as signed 64-bit numbers."""
    acc = np.arange(1, BANDS + 1, dtype=_U) * _NAME
    for j in range(ROWS):
        acc = mix(acc + sig[j::ROWS][:BANDS])
    return acc.view(np.int64)


def _set_key(elements: np.ndarray, weights: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(elements.tobytes() + weights.astype("<u4").tobytes(), digest_size=16).digest()


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted elements, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both) / float(a[1].sum() + b[1].sum() - both)


def _signatures(docs: DataFrame) -> DataFrame:
    """docs needs doc_id, text first; adds rid, set key and bucket keys, null without words."""
    own = [f"`{c}`" for c in docs.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            keys, bands = [], []
            for words in batch_word_hashes(texts):
                if not len(words):
                    keys.append(None)
                    bands.append(None)
                    continue
                e, w = weighted_shingles(words)
                keys.append(_set_key(e, w))
                bands.append(bands_of(signature(e, w)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=[*b.schema.names, "_set", "_bands"])

    numbered = docs.select(*own, F.monotonically_increasing_id().alias("_rid"))
    return written(numbered.mapInArrow(run, f"{schema}, _rid long, _set binary, _bands array<long>"), "signatures")


def _sets(rows: DataFrame, nodes: Beside) -> DataFrame:
    """(node, packed set) of the (rid, text) rows that are nodes."""

    def run(batches):
        for b in batches:
            rids = b.column(0).to_numpy(zero_copy_only=False)
            own = nodes.of(rids)
            at = pa.array([i for i, r in enumerate(rids.tolist()) if r in own], pa.int64())
            packed = []
            for words in batch_word_hashes(b.column(1).take(at).to_pylist()):
                e, w = weighted_shingles(words)
                packed.append(e.tobytes() + w.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(packed, pa.binary())], names=["node", "packed"])

    return rows.mapInArrow(run, "node long, packed binary")


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    return np.frombuffer(raw, _U, n), np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64)


def _levels(elements: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """63-bit names of the elements' occurrences low .. high - 1."""
    n = np.maximum(high - low, 0)
    who = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + low[who]
    return np.sort(mix(elements[who] + nth.astype(_U) * _NAME) >> _ONE_BIT)


def _difference(hub: tuple[np.ndarray, np.ndarray], own: tuple[np.ndarray, np.ndarray]) -> tuple[int, np.ndarray]:
    """(common weight, what own adds to hub and then, with the top bit, what it lacks)"""
    _, i, j = np.intersect1d(hub[0], own[0], assume_unique=True, return_indices=True)
    least = np.minimum(hub[1][i], own[1][j])
    in_own, in_hub = np.zeros(len(own[0]), np.int64), np.zeros(len(hub[0]), np.int64)
    in_own[j], in_hub[i] = least, least
    return int(least.sum()), np.concatenate((_levels(own[0], in_own, own[1]), _levels(hub[0], in_hub, hub[1]) | _U(1 << 63)))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, similarity, weights of both and of their overlap, how v differs from u)"""
    kind = "u long, v long, sim double, a long, b long, both long, delta binary"

    def run(batches):
        name, held = None, None
        for batch in batches:
            out = []
            for u, v, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if u != name:
                    name, held = u, _unpacked(x)
                own = _unpacked(y)
                both, delta = _difference(held, own)
                a, b = int(held[1].sum()), int(own[1].sum())
                out.append((u, v, both / (a + b - both), a, b, both, delta.tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in kind.split(", ")])

    first = sets.select(F.col("node").alias("v"), F.col("packed").alias("y"))
    second = sets.select(F.col("node").alias("u"), F.col("packed").alias("x"))
    both = pairs.join(first, "v").join(second, "u").select("u", "v", "x", "y")
    return both.mapInArrow(run, kind)


def _forest(node: np.ndarray, comp: np.ndarray, x: np.ndarray, size: np.ndarray, index: np.ndarray, lots: list[np.ndarray], full: list[np.ndarray] | None):
    """Links (node, node) that join the components of rows which are alike, one for each two
    components that meet; lots are a part's names.  Without full lists the lots are all of a
    row's names and the number in common counts, otherwise a pair meets by a name in the
    lesser's prefix and the full lists are intersected."""
    top = np.unique(comp, return_inverse=True)[1].astype(np.int64)  # the local component of each row
    rank = np.empty(len(node), np.int64)
    by_x = np.lexsort((node, x))
    rank[by_x] = np.arange(len(node))
    owner = np.repeat(np.arange(len(node)), [len(t) for t in lots])
    names = np.concatenate(lots)
    order = np.argsort(names, kind="stable")
    names, owner = names[order], owner[order]
    out = []
    for i in by_x.tolist():
        own = lots[i] if full is None else lots[i][: index[i]]
        lo, hi = np.searchsorted(names, own, "left"), np.searchsorted(names, own, "right")
        n = hi - lo
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        times = np.bincount(owner[at], minlength=len(node))
        j = np.flatnonzero(times)
        most = times[j] if full is None else np.minimum(size[i], size[j])
        for k in j[(top[j] != top[i]) & (rank[j] > rank[i]) & (most >= x[i] + x[j] - 1e-6)].tolist():
            if top[k] == top[i]:
                continue
            if full is None or len(np.intersect1d(full[i], full[k], assume_unique=True)) >= x[i] + x[k] - 1e-6:
                out.append((min(int(node[i]), int(node[k])), max(int(node[i]), int(node[k]))))
                top[top == top[k]] = top[i]
    return out


#: Rows that meet in one part of a hub, about.
PART = 4096


def _sharing(rows: DataFrame) -> DataFrame:
    """(hub, node, component, delta, parts, a, b, both) -> (u, v): links between nodes of
    different components, so many that all components that are alike are joined.

    Texts of weights b and c that have i and j in common with a hub of weight a have
    i + j - a + d in common, d the number of names that their differences from the hub
    share; alike, they have need (b + c) at least.  So they are alike exactly if d reaches the
    sum of both texts' x = need b - i + a / 2, which is above 0 if the hub links to one of them
    at most, and of two texts, the one of lesser x has a shared name among its first
    size - 2 x + 1 (what texts add, which is rarer, comes before what they lack).  Those names of
    a large hub are dealt over a number of parts that grows with them, each with the row's whole
    list; a part decides its pairs and returns a spanning forest of the links, not the pairs."""
    spark = rows.sparkSession
    need = THRESHOLD / (1 + THRESHOLD)
    kinds = [("hub", pa.int64()), ("part", pa.int64()), ("node", pa.int64()), ("component", pa.int64()), ("x", pa.float64()), ("size", pa.int64()), ("n_index", pa.int64()), ("names", pa.binary()), ("full", pa.binary())]

    def deal(batches):
        for b in batches:
            out = []
            for hub, node, comp, delta, parts, a, weight, both in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = np.frombuffer(delta, _U)
                x = need * weight - both + a / 2
                index = min(len(h), len(h) - math.ceil(2 * x - 1e-6) + 1)
                if parts == 1:
                    out.append((hub, 0, node, comp, x, len(h), index, delta, None))
                    continue
                # No partner has a lesser x than the hub would.
                least = max(1, math.ceil(x + (need - 0.5) * a - 1e-6))
                asked = h[: max(0, len(h) - least + 1)]
                to = (asked % _U(parts)).astype(np.int64)
                for part in np.unique(to).tolist():
                    own = to == part
                    out.append((hub, part, node, comp, x, len(h), int(own[: max(0, index)].sum()), asked[own].tobytes(), delta))
                if len(out) > 2048:
                    yield batch(out)
                    out = []
            yield batch(out)

    def batch(out):
        cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])

    def meet(batches):
        held: list[tuple] = []

        def solve():
            cols = list(zip(*held, strict=True))
            node, comp, x, size, index = (np.array(c) for c in cols[2:7])
            full = None if cols[8][0] is None else [np.frombuffer(t, _U) for t in cols[8]]
            found = np.array(_forest(node, comp, x, size, index, [np.frombuffer(t, _U) for t in cols[7]], full), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[-1][:2] != r[:2]:
                    yield solve()
                    held = []
                held.append(r)
        if held:
            yield solve()

    dealt = rows.mapInArrow(deal, "hub long, part long, node long, component long, x double, size long, n_index long, names binary, full binary")
    return dealt.repartition(shuffle_parts(spark), "hub", "part").sortWithinPartitions("hub", "part", "node").mapInArrow(meet, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its group), n_class
    and kept; with carry, the named columns of docs too."""
    ship(docs.sparkSession)
    carry = carry or []
    cols = [F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("_text"), *(F.col(c) for c in carry if c not in ("doc_id", "text"))]
    rows = _signatures(docs.select(*cols))
    best = F.min(F.struct(F.col("_doc").isNull().alias("z"), F.col("_doc").alias("d"), F.col("_rid").alias("r")))
    classes = written(rows.where("_set is not null").groupBy("_set").agg(best.alias("b"), F.count("*").alias("n")).select("_set", F.col("b.r").alias("node"), F.col("b.d").alias("doc"), "n"), "classes")
    reps = rows.join(classes.select(F.col("node").alias("_rid")), "_rid", "left_semi")
    bands = reps.select(F.col("_rid").alias("node"), F.explode("_bands").alias("band"))
    sizes = bands.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    shared = written(bands.join(sizes, "band"), "bands")
    # A node that shares much with its buckets is central; the most central one is the hub.
    central = shared.groupBy("node").agg(F.sum("m").alias("weight"))
    buckets = shared.drop("m").join(central, "node").withColumn("order", F.struct((-F.col("weight")).alias("w"), F.xxhash64("node").alias("x"))).drop("weight")
    buckets = written(buckets, "buckets")
    hubs = buckets.groupBy("band").agg(F.min(F.struct("order", "node")).alias("h")).select("band", F.col("h.node").alias("hub"))
    members = written(buckets.join(hubs, "band"), "buckets")
    pairs = members.where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    nodes = beside(members.select(F.col("node").alias("rid")).distinct(), "nodes")
    sets = written(_sets(rows.select("_rid", "_text"), nodes), "sets")
    first = written(_compared(pairs, sets), "compared")
    comp = _merged(_alike(first), None)
    # Buckets that components still share: the next hubs meet the members of other components.
    left = written(_mixed(members.where("node <> hub").select("band", "node", "order"), comp, "band"), "open")
    rank = F.row_number().over(W.partitionBy("band").orderBy("order"))
    h = left.withColumn("rank", rank).where(F.col("rank") <= HUBS).select("band", F.col("node").alias("hub"), F.col("component").alias("hc"))
    pairs = left.join(h, "band").where("component <> hc").select(F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v")).distinct()
    second = written(_compared(pairs, sets), "compared")
    comp = _merged(_alike(second), comp)
    # What is left is decided by how texts differ from their common hub.
    kin = written(_mixed(first.select(F.col("u").alias("hub"), F.col("v").alias("node"), "a", "b", "both", "delta"), comp, "hub"), "kin")
    room = kin.groupBy("hub").agg(F.count("*").alias("_n"), F.sum(F.length("delta")).alias("_b"))
    parts = F.when((F.col("_n") <= PART) & (F.col("_b") <= 1 << 24), 1).otherwise(F.ceil(F.col("_b") / (8 * PART)) + 1)
    kin = kin.join(room, "hub").withColumn("parts", parts.cast("long"))
    comp = _merged(_sharing(kin.select("hub", "node", "component", "delta", "parts", "a", "b", "both")), comp)
    ends = comp.select("node", "component").join(classes.select("node", "doc", "n"), "node", "right").withColumn("component", F.coalesce("component", "node"))
    named = ends.groupBy("component").agg(F.min(F.struct(F.col("doc").isNull().alias("z"), F.col("doc").alias("d"), F.col("node").alias("r"))).alias("b"), F.sum("n").alias("n_class"))
    table = ends.join(named, "component").select("node", F.col("b.d").alias("class_id"), F.col("b.r").alias("stays"), "n_class")
    table = classes.select("_set", "node").join(table, "node").drop("node")
    out = rows.select("_rid", "_doc", "_set").join(table, "_set", "left").select(
        F.col("_rid").alias("rid"),
        F.col("_doc").alias("doc_id"),
        F.when(F.col("stays").isNull(), F.col("_doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"),
        (F.col("stays").isNull() | (F.col("stays") == F.col("_rid"))).alias("kept"),
    )
    spent = (classes, shared, buckets, members, nodes, sets, first, left, second)
    if not carry:
        out = written(out.drop("rid"), "groups")
        discard(rows, *spent)
        return out
    groups = beside(out.select("rid", "class_id", "n_class", "kept"), "groups")
    discard(*spent)
    return _attached(rows, groups, carry)


def _attached(rows: DataFrame, groups: Beside, carry: list[str]) -> DataFrame:
    """The carried columns of the rows with their groups, by row number."""
    cols = list(dict.fromkeys(["doc_id", *carry]))
    source = rows.select("_rid", *[F.col({"doc_id": "_doc", "text": "_text"}.get(c, f"`{c}`")).alias(c) for c in cols])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])

    def run(batches):
        for b in batches:
            rids = b.column(0).to_numpy(zero_copy_only=False)
            found = groups.of(rids)
            own = [found[r][0] for r in rids.tolist()]
            more = [pa.array([x[k] for x in own], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *more], names=[*cols, "class_id", "n_class", "kept"])

    return source.mapInArrow(run, f"{schema}, class_id long, n_class long, kept boolean")


def _alike(tested: DataFrame) -> DataFrame:
    return tested.where(F.col("sim") >= THRESHOLD - 1e-12).select("u", "v")


def _merged(links: DataFrame, comp: DataFrame | None) -> DataFrame:
    """(node, component) after new links; components that no new link touches stay as they are."""
    if comp is None:
        return written(connected_components(links), "components")
    for c in ("u", "v"):
        links = links.join(comp.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
    links = written(links.where("u <> v").distinct(), "links")
    if links.isEmpty():
        return comp
    step = connected_components(links)
    old = comp.join(step.select(F.col("node").alias("component"), F.col("component").alias("_new")), "component", "left").select("node", F.coalesce("_new", "component").alias("component"))
    out = written(old.union(step.join(comp, "node", "left_anti")), "components")
    discard(links)
    return out


def _mixed(left: DataFrame, comp: DataFrame, key: str) -> DataFrame:
    """Rows, with their components, of keys that more than one component shares."""
    full = left.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = full.groupBy(key).agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select(key)
    return full.join(mixed, key, "left_semi")
