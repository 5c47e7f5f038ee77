"""Best-fit packing of token pieces into sequences of fixed capacity.

Large items (over a third of the capacity) are matched greedily, so that a
sequence holds at most two of them; smaller ones go, longest first, into the
smallest gap that holds them.  Both steps run on the histogram of lengths: equal
lengths and equal gaps are handled as groups with a count, so the plan has a
bound that depends on the capacity alone, whatever the number of pieces.  Pieces
are numbered within their length (count per written file part and length, then
a running sum over parts) and look their place up in the plan.

Defined cases: null or empty texts are the end id alone; repeated rows and ids
are packed as rows of their own; an empty table gives an empty result; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.storage import ship, written
from spanloom.llm.tokens import encoder, slices

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, count, first sequence, items per sequence, offset), and
    the number of sequences.  Items of a length take sequences in order, so many each."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    left = {n: c for n, c in histogram.items() if c > 0}
    taken: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, sequences)
    opened = 0

    def put(n: int, count: int, first: int, per: int, offset: int) -> None:
        rows.append((n, taken[n], count, first, per, offset))
        taken[n] += count
        left[n] -= count

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for i, n in enumerate(large):
        while left[n]:
            mate = next((m for m in large[i:] if m <= capacity - n and left[m] - (m == n) > 0), None)
            if mate is None:
                k = left[n]
                put(n, k, opened, 1, 0)
                gaps[capacity - n].append((opened, k))
            else:
                k = left[n] // 2 if mate == n else min(left[n], left[mate])
                put(n, k, opened, 1, 0)
                put(mate, k, opened, 1, n)
                gaps[capacity - n - mate].append((opened, k))
            opened += k
    gaps.pop(0, None)
    for n in sorted((n for n in left if 3 * n <= capacity and n > 0), reverse=True):
        while left[n]:
            gap = min((g for g in gaps if g >= n), default=None)
            if gap is None:
                per = capacity // n
                k = -(-left[n] // per)
                gaps[capacity].append((opened, k))
                opened += k
                gap = capacity
            first, k = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            per = gap // n
            full = min(k, left[n] // per)
            if full:
                put(n, full * per, first, per, capacity - gap)
                if gap - per * n:
                    gaps[gap - per * n].append((first, full))
            if full < k:
                if some := min(left[n], per - 1) if left[n] < per else 0:
                    put(n, some, first + full, some, capacity - gap)
                    gaps[gap - some * n].append((first + full, 1))
                    full += 1
                if full < k:
                    gaps[gap].append((first + full, k - full))
    return np.array(rows, np.int64).reshape(-1, 6), opened


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first can be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces with their rank among the equally long ones of the same task."""

    def run(batches):
        part = TaskContext.get().partitionId()
        enc, seen, tail = encoder(tokenizer), defaultdict(int), np.array([end_id], "<u4")
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for lo, hi in slices(texts):
                out = []
                for doc, tok in zip(ids[lo:hi], enc.batch(texts[lo:hi]), strict=True):
                    tok = np.concatenate((tok, tail))
                    for k, (s, n) in enumerate(cut(len(tok), capacity)):
                        out.append((doc, k, s, n, zlib.crc32(tok[s : s + n].tobytes()), part, seen[n]))
                        seen[n] += 1
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES)


def best_fit_pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """One row per piece with the sequence and offset it is packed at."""
    spark = ship(docs.sparkSession)
    cuts = written(pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = cuts.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    rows, _ = plan(histogram, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    base = counts.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    shared = spark.sparkContext.broadcast(rows)  # bounded by the capacity, see plan()

    def place(batches):
        rows = shared.value
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for b in batches:
            n, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            at = rows[np.searchsorted(keys, (n << 44) + rank, "right") - 1]
            k = rank - at[:, 1]
            seq, off = at[:, 3] + k // at[:, 4], at[:, 5] + k % at[:, 4] * n
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cuts.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(place, _PLACED)
