"""Cosine links between vectors by an epsilon grid order join.

Vectors are normalised in double precision; a cosine of at least t is a distance
of at most e = sqrt(2 - 2t).  Leading principal directions come from the
covariance, summed over all vectors.  Vectors are sorted by the cells of an
e-grid on these directions (first direction first), and the sorted sequence is
cut into blocks.  Interval pairs are joined recursively: both intervals are cut into
FAN parts, and pairs of parts whose boxes on the leading directions are farther
apart than e are skipped; projections shrink distances, so no link is lost.
The recursion ends inside the blocks: a pair of blocks that remains is cut into runs of RUN
vectors, pairs of runs are skipped by their boxes and by the distance of their centres less
their radii, and only the others are compared by matrix products.  Block bodies are not
shuffled: tasks get tiles of TILE by TILE block numbers and read the bodies by number.

Equal vectors are one class that is compared once and counts with its number.
A block pair returns the number of links per class and a spanning forest of them, not
the links, so results grow with the blocks and not with the links.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers link
with nothing; vectors of different length never link; rows that repeat a
vec_id are vectors of their own, and so are null ids (which no component takes its name
from unless all its ids are null); an empty table gives an empty one; extra columns pass unused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.components import connected_components
from spanloom.llm.storage import Beside, beside, discard, ship, shuffle_parts, written

THRESHOLD = 0.9
BLOCK = 512
RUN = 32
TILE = 16
FAN = 16
LEADING = 16
_SLACK = 1e-9


def _usable(rows: DataFrame) -> DataFrame:
    """(rid, id, raw) with the vector's doubles; null raw where it links with nothing."""

    def run(batches):
        for b in batches:
            v = b.column(2)
            sizes = pc.list_value_length(v).to_pylist()
            flat = v.flatten()
            numbers = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null elements become nan
            out, at = [], 0
            for n in sizes:
                if n is None:
                    out.append(None)
                    continue
                x = numbers[at : at + n]
                at += n
                norm = np.sqrt((x * x).sum()) if n and np.isfinite(x).all() else 0.0
                out.append((x + 0.0).astype("<f8").tobytes() if norm > 0 and np.isfinite(norm) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["rid", "id", "raw"])

    return rows.mapInArrow(run, "rid long, id long, raw binary")


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _by_size(raw: list[bytes]):
    """Positions of vectors of equal length."""
    sizes: dict[int, list[int]] = {}
    for i, r in enumerate(raw):
        sizes.setdefault(len(r), []).append(i)
    return sizes.items()


def leading_directions(classes: DataFrame) -> dict[int, np.ndarray]:
    """By vector length in bytes: mean and leading principal directions, over all vectors."""

    def run(batches):
        sums: dict[int, list] = {}
        for b in batches:
            raw = b.column(0).to_pylist()
            for size, own in _by_size(raw):
                u = _unit([raw[i] for i in own])
                s = sums.setdefault(size, [0, 0.0, 0.0])
                s[0] += len(u)
                s[1] = s[1] + u.sum(axis=0)
                s[2] = s[2] + u.T @ u
        for size, (n, first, second) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([n], pa.int64()), pa.array([first.tobytes()], pa.binary()), pa.array([second.tobytes()], pa.binary())], names=["size", "n", "first", "second"])

    def add(batches):
        total: dict[int, list] = {}
        for b in batches:
            for size, n, first, second in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = total.setdefault(size, [0, 0.0, 0.0])
                s[0] += n
                s[1] = s[1] + np.frombuffer(first)
                s[2] = s[2] + np.frombuffer(second)
        for size, (n, first, second) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([n], pa.int64()), pa.array([first.tobytes()], pa.binary()), pa.array([second.tobytes()], pa.binary())], names=["size", "n", "first", "second"])

    kind = "size long, n long, first binary, second binary"
    parts = classes.select("raw").mapInArrow(run, kind)
    width = max(1, int(shuffle_parts(classes.sparkSession) ** 0.5))
    rows = parts.repartition(width).mapInArrow(add, kind).repartition(1).mapInArrow(add, kind).collect()  # a row per vector length
    out = {}
    for size, n, first, second in rows:
        mean = np.frombuffer(first) / n
        cov = np.frombuffer(second).reshape(len(mean), -1) / n - np.outer(mean, mean)
        out[size] = np.linalg.eigh(cov)[1][:, ::-1][:, :LEADING]
    return out


def _keyed(classes: DataFrame, eps: float, dirs: dict[int, np.ndarray]) -> DataFrame:
    """Adds the grid order's key: cells of leading directions as sortable bytes."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(dirs)  # a few directions

    def run(batches):
        dirs = shared.value
        for b in batches:
            raw = b.column(1).to_pylist()
            keys: list[bytes | None] = [None] * len(raw)
            for size, own in _by_size(raw):
                cells = np.floor(_unit([raw[i] for i in own]) @ dirs[size] / eps).astype(np.int64) + (1 << 15)
                packed = cells.astype(">u2")
                head = size.to_bytes(4, "big")
                for i, c in zip(own, packed, strict=True):
                    keys[i] = head + c.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(keys, pa.binary())], names=["node", "raw", "n", "key"])

    return classes.mapInArrow(run, "node long, raw binary, n long, key binary")


def _blocks(keyed: DataFrame, block: int, dirs: dict[int, np.ndarray]) -> DataFrame:
    """Consecutive blocks of the grid order with their boxes on the leading directions."""
    spark = keyed.sparkSession
    shared = spark.sparkContext.broadcast(dirs)
    kind = "block long, nodes binary, counts binary, raw binary, size long, low array<double>, high array<double>"

    def run(batches):
        from pyspark import TaskContext

        dirs = shared.value
        at = TaskContext.get().partitionId() << 33
        held: list[tuple] = []

        def flush():
            nonlocal at
            u = _unit([r[1] for r in held])
            p = u @ dirs[len(held[0][1])]
            at += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([at - 1], pa.int64()),
                    pa.array([np.array([r[0] for r in held], "<i8").tobytes()], pa.binary()),
                    pa.array([np.array([r[2] for r in held], "<i8").tobytes()], pa.binary()),
                    pa.array([u.astype("<f8").tobytes()], pa.binary()),
                    pa.array([len(held[0][1])], pa.int64()),
                    pa.array([p.min(axis=0).tolist()], pa.list_(pa.float64())),
                    pa.array([p.max(axis=0).tolist()], pa.list_(pa.float64())),
                ],
                names=[x.split()[0] for x in kind.split(", ")],
            )

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (len(held) >= block or len(held[0][1]) != len(r[1])):
                    yield flush()
                    held = []
                held.append(r)
        if held:
            yield flush()

    ordered = keyed.repartitionByRange(shuffle_parts(spark), "key", "node").sortWithinPartitions("key", "node")
    return ordered.select("node", "raw", "n").mapInArrow(run, kind)


def _far(eps: float):
    """Square of the distance of two boxes, as a column over low/high of a and b."""
    gaps = F.zip_with(F.zip_with("a_low", "b_high", lambda x, y: x - y), F.zip_with("b_low", "a_high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) > (eps + _SLACK) ** 2


def _boxes(child: DataFrame) -> DataFrame:
    """Boxes of intervals from those of their parts."""

    def least(c, f):
        dims = [f(F.coalesce(F.get(c, k), F.lit(0.0))) for k in range(LEADING)]
        return F.array(*dims)

    return child.groupBy("up", "size").agg(least("low", F.min).alias("low"), least("high", F.max).alias("high"))


def candidate_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(a, b, ta, tb): block pairs in order that recursion does not prove to be apart, and their tile."""
    spark = blocks.sparkSession
    level = blocks.select(F.col("block").alias("k"), "size", "low", "high")
    pad = [F.array(*[F.coalesce(F.get(c, i), F.lit(0.0)) for i in range(LEADING)]).alias(c) for c in ("low", "high")]
    # Intervals nest by their number in the order; a level's interval has FAN parts.
    from pyspark.sql import Window as W

    level = level.select("k", "size", *pad)
    rank = written(level.select("k", "size", "low", "high", (F.row_number().over(W.partitionBy(F.floor(F.col("k") / (1 << 33))).orderBy("k")) - 1).alias("seq"), F.floor(F.col("k") / (1 << 33)).alias("part")), "boxes")
    counts = rank.groupBy("part").agg(F.count("*").alias("c"))
    base = counts.withColumn("base", F.sum("c").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))  # a row per partition
    leaves = rank.join(base, "part").select("k", "size", "low", "high", (F.coalesce("base", F.lit(0)) + F.col("seq")).alias("no"))
    leaves = written(leaves, "boxes")
    total = leaves.count()
    levels = [leaves.select(F.col("no").alias("id"), "size", "low", "high")]
    width = 1
    while width < total:
        width *= FAN
        below = levels[-1].withColumn("up", F.floor(F.col("id") / FAN))
        levels.append(written(_boxes(below).select(F.col("up").alias("id"), "size", "low", "high"), "boxes"))
    top = levels[-1].select("id", "size")
    pairs = top.select(F.col("id").alias("a"), F.col("id").alias("b"), "size")
    for below in levels[-2::-1]:
        up = below.withColumn("up", F.floor(F.col("id") / FAN))
        left = up.select(F.col("up").alias("a"), "size", F.col("id").alias("na"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
        right = up.select(F.col("up").alias("b"), "size", F.col("id").alias("nb"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
        pairs = written(pairs.join(left, ["a", "size"]).join(right, ["b", "size"]).where("na <= nb").where(~_far(eps)).select(F.col("na").alias("a"), F.col("nb").alias("b"), "size"), "pairs")
    names = leaves.select("k", F.col("no"))
    out = pairs.join(names.select(F.col("no").alias("a"), F.col("k").alias("ka")), "a").join(names.select(F.col("no").alias("b"), F.col("k").alias("kb")), "b")
    return out.select(F.col("ka").alias("a"), F.col("kb").alias("b"), F.floor(F.col("a") / TILE).alias("ta"), F.floor(F.col("b") / TILE).alias("tb"))


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges (smaller root, node) of a spanning forest of links between n places."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        live = a != b
        if not live.any():
            break
        np.minimum.at(root, np.maximum(a, b)[live], np.minimum(a, b)[live])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = np.flatnonzero(root != np.arange(n))
    return list(zip(root[moved].tolist(), moved.tolist(), strict=True))


def near_runs(x: np.ndarray, y: np.ndarray, dirs: np.ndarray, eps: float, run: int = RUN) -> np.ndarray:
    """Which runs of x and y their boxes and balls do not prove to be farther apart than eps."""

    def bounds(u):
        at = np.arange(0, len(u), run)
        p = u @ dirs
        low, high = np.minimum.reduceat(p, at), np.maximum.reduceat(p, at)
        n = np.diff(np.append(at, len(u)))
        mid = np.add.reduceat(u, at) / n[:, None]
        radius = np.sqrt(np.maximum.reduceat(((u - np.repeat(mid, n, axis=0)) ** 2).sum(axis=1), at))
        return low, high, mid, radius

    (a, b, m, r), (c, d, k, q) = bounds(x), bounds(y)
    gap = np.maximum(np.maximum(a[:, None] - d[None], c[None] - b[:, None]), 0.0)
    apart = np.sqrt(np.maximum((m * m).sum(axis=1)[:, None] + (k * k).sum(axis=1)[None] - 2 * m @ k.T, 0.0)) - r[:, None] - q[None]
    return ((gap * gap).sum(axis=2) <= (eps + _SLACK) ** 2) & (apart <= eps + 1e-6)


def _hits(x: np.ndarray, y: np.ndarray, dirs: np.ndarray, threshold: float, eps: float) -> np.ndarray:
    """Which vectors of x and y link."""
    near = near_runs(x, y, dirs, eps)
    if near.mean() > 0.5:
        return x @ y.T >= threshold
    hit = np.zeros((len(x), len(y)), bool)
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        cols = np.flatnonzero(np.repeat(near[i], RUN)[: len(y)])
        hit[i * RUN : (i + 1) * RUN, cols] = x[i * RUN : (i + 1) * RUN] @ y[cols].T >= threshold
    return hit


def _compared(pairs: DataFrame, bodies: Beside, dirs: dict[int, np.ndarray], threshold: float, eps: float) -> DataFrame:
    """(a, b, ta, tb), tile by tile -> per block pair: (node, links) and forest edges (node, other)."""
    kind = "u long, v long, n long"
    shared = pairs.sparkSession.sparkContext.broadcast(dirs)

    def links(left, right, same):
        hit = _hits(left[2], right[2], shared.value[8 * left[2].shape[1]], threshold, eps)
        if same:
            np.fill_diagonal(hit, False)
        rows = hit.any(axis=1)
        if not rows.any():
            return None
        out = [(left[0][rows], (hit @ right[1])[rows])]
        if not same:
            other = left[1] @ hit
            out.append((right[0][other > 0], other[other > 0]))
        i, j = np.nonzero(hit)
        m = len(left[0])
        edges = _forest(i, j if same else j + m, m if same else m + len(right[0]))
        nodes = left[0] if same else np.concatenate((left[0], right[0]))
        u = np.concatenate([x[0] for x in out])
        n = np.concatenate([x[1] for x in out])
        e = np.array(edges, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((u, nodes[e[:, 0]]))), pa.array([None] * len(u) + nodes[e[:, 1]].tolist(), pa.int64()), pa.array(np.concatenate((n, np.zeros(len(e), np.int64))))],
            names=["u", "v", "n"],
        )

    def run(batches):
        tile, held = None, {}
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            for at, (ka, kb, ta, tb) in enumerate(rows):
                if (ta, tb) != tile or ka not in held or kb not in held:
                    tile, held = (ta, tb), {}
                    own = {k for r in rows[at:] if r[2:] == tile for k in r[:2]}
                    for k, found in bodies.of(np.array(sorted(own))).items():
                        nodes, counts, raw = found[0]
                        ids = np.frombuffer(nodes, "<i8")
                        held[k] = (ids, np.frombuffer(counts, "<i8"), np.frombuffer(raw, "<f8").reshape(len(ids), -1))
                found = links(held[ka], held[kb], ka == kb)
                if found is not None:
                    yield found

    return pairs.mapInArrow(run, kind)


def epsilon_links(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    spark = ship(vectors.sparkSession)
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = written(_usable(rows), "vectors")
    classes = written(rows.where("raw is not null").groupBy("raw").agg(F.min("rid").alias("node"), F.count("*").alias("n"), F.min("id").alias("least")), "vectorclasses")
    dirs = leading_directions(classes)
    keyed = written(_keyed(classes.select("node", "raw", "n"), eps, dirs), "keyed")
    blocks = written(_blocks(keyed, block, dirs), "blocks")
    bodies = beside(blocks.select(F.col("block").alias("rid"), "nodes", "counts", "raw"), "bodies")
    pairs = candidate_pairs(blocks, eps).repartition(4 * shuffle_parts(spark), "ta", "tb").sortWithinPartitions("ta", "tb", "a", "b")
    found = written(_compared(pairs, bodies, dirs, threshold, eps), "links")
    discard(keyed, blocks, bodies)
    links = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n_links"))
    comp = connected_components(found.where("v is not null").select("u", "v"))
    info = classes.join(links, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = info.groupBy("component").agg(F.min("least").alias("component_id"))
    per_class = written(info.join(least, "component").select(F.col("raw"), (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "components")
    out = rows.join(per_class, "raw", "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
