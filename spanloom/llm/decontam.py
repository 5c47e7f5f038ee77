"""Benchmark leaks found through templates.

Words are canonicalised: numbers, units and names (capitalised words inside a
sentence) become typed placeholders, so a question keeps its template when it
is given new values.  Windows of five template words, of which two at least are
literal, are hash-joined with those of the benchmark.  A document leaks an item
if it has 80 % of the item's windows or more, in one stretch of twice the item's
length, and the slots agree: the values that stand for one value of the item
are the same at 80 % of its slots' places or more.

The benchmark's windows are held in a broadcast array up to MOST of them; a
larger benchmark is joined by shuffle on the rarest fifth (and one more) of each item's windows,
one of which any leak has, and only documents that have one are looked at again.  Defined cases: null texts are empty; an item of
fewer than five words matches only documents of just those words; items without
words or windows match nothing; items with equal texts all match; repeated rows are decided each;
null item_ids are left out; very long texts are read whole, in pieces; an empty table or benchmark
gives no leak; ``leak_report`` leaves extra columns unused, ``decontaminated`` returns all columns
of docs, which must not be named like its results or ``_rid``.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.storage import Beside, beside, ship, written
from spanloom.llm.words import PIECE, SHINGLE, lowered, mix, prefix_hash, shingle_hashes, span_hash, word_spans

THRESHOLD = 0.8
#: Windows that are broadcast at most (16 bytes each).
MOST = 2_000_000
_U = np.uint64
NUMBER, UNIT, NAME = (_U(x) for x in (0xA1A1A1A1A1A1A1A1, 0xB2B2B2B2B2B2B2B2, 0xC3C3C3C3C3C3C3C3))
# Unit words.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t gram grams kilogram kilograms ton tons oz ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw kwh j kj v a k b kb mb gb tb dollar dollars euro euros cent cents percent degree degrees meter meters metre metres kilometer kilometers"
).split()


def _hash_words(words: list[str]) -> np.ndarray:
    b, s, e = word_spans(" ".join(words).encode())
    return mix(span_hash(prefix_hash(b), s, e) ^ (e - s).astype(_U))


_UNIT_HASHES = np.unique(_hash_words(UNITS))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n:\"|#*"]] = True
_SPACE = re.compile(r"\s")


def _parts(text: str):
    """Pieces that end before white space, and whether one starts a sentence."""
    at, n = 0, len(text)
    while at < n:
        cut = n
        if n - at > PIECE:
            m = _SPACE.search(text, at + PIECE)
            cut = m.start() if m else n
        yield text[at:cut], at == 0 or text[:at].rstrip()[-1:] in ".!?\n" if at < 4096 or cut == n else text[max(0, at - 64) : at].rstrip()[-1:] in ".!?\n"
        at = cut


def template(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(template hash, literal hash) of each word."""
    temps, lits = [], []
    for part, opens in _parts(text or ""):
        low = lowered(part)
        b, s, e = word_spans(low.encode("utf-8", "replace"))
        if not len(s):
            continue
        lit = mix(span_hash(prefix_hash(b), s, e) ^ (e - s).astype(_U))
        temp = lit.copy()
        digits = np.concatenate(([0], np.cumsum(_DIGIT[b])))
        temp[np.isin(lit, _UNIT_HASHES)] = UNIT
        temp[digits[e] > digits[s]] = NUMBER
        raw = part.encode("utf-8", "replace")
        if len(raw) == len(b) or len(raw := _same_length(part)) == len(b):
            r = np.frombuffer(raw, np.uint8)
            capital = (r[s] != b[s]) | ((b[s] >= 0xC3) & (s + 1 < len(b)) & (r[np.minimum(s + 1, len(b) - 1)] != b[np.minimum(s + 1, len(b) - 1)]))
            stops = np.concatenate(([0], np.cumsum(_STOP[r])))
            before = np.concatenate(([0], e[:-1]))
            first = stops[s] > stops[before]
            first[0] |= opens
            # Shouted text has no names.
            if capital.mean() < 0.5:
                temp[capital & ~first & (temp == lit)] = NAME
        temps.append(temp)
        lits.append(lit)
    if not temps:
        return np.zeros(0, _U), np.zeros(0, _U)
    return np.concatenate(temps), np.concatenate(lits)


def _same_length(text: str) -> bytes:
    """Bytes that keep their places when letters are lowered; others give nothing."""
    return b"".join(c.encode("utf-8", "replace") if len(lowered(c).encode("utf-8", "replace")) == len(c.encode("utf-8", "replace")) else lowered(c).encode("utf-8", "replace") for c in text)


def windows(temp: np.ndarray) -> np.ndarray:
    """Hashes of template windows; 0 for one with fewer than two literal words."""
    h = shingle_hashes(temp)
    if len(temp) < SHINGLE:
        return h
    literal = ~np.isin(temp, np.array([NUMBER, UNIT, NAME]))
    n = np.concatenate(([0], np.cumsum(literal)))
    h[n[SHINGLE:] - n[:-SHINGLE] < 2] = 0
    return h


class _Slots:
    """Which values of the text stand in an item's slots, as matching windows come and go in order."""

    def __init__(self, item: tuple[np.ndarray, np.ndarray], doc: tuple[np.ndarray, np.ndarray]):
        self.whole = len(item[0]) < SHINGLE
        self.slot = (item[0] != item[1]).tolist()
        self.item, self.doc = item[1], doc[1]
        #: The places of the text that windows give to each slot; the latest counts.
        self.at: dict[int, deque[int]] = defaultdict(deque)
        self.seen: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        self.most: dict[int, int] = {}
        self.n = self.agreed = 0

    def _count(self, place: int, at: int, by: int) -> None:
        value = int(self.item[place])
        self.seen[value][int(self.doc[at])] += by
        most = max(self.seen[value].values())
        self.agreed += most - self.most.get(value, 0)
        self.most[value] = most
        self.n += by

    def move(self, pair: tuple[int, int], comes: bool) -> None:
        d, i = pair
        for k in range(0 if self.whole else SHINGLE):
            if not self.slot[i + k]:
                continue
            held = self.at[i + k]
            before = held[-1] if held else None
            held.append(d + k) if comes else held.popleft()
            after = held[-1] if held else None
            if before != after:
                if before is not None:
                    self._count(i + k, before, -1)
                if after is not None:
                    self._count(i + k, after, 1)

    def share(self) -> float:
        """Share of slot places whose value is the commonest for its item value."""
        return self.agreed / self.n if self.n else 1.0


def _aligned(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """One of the item's places for each place of the text: where windows of the item repeat, the
    one that goes on from the place before."""
    out: list[tuple[int, int]] = []
    shift = 0
    for d, i in pairs:
        if out and out[-1][0] == d:
            if abs(d - i - shift) < abs(d - out[-1][1] - shift):
                out[-1] = (d, i)
            continue
        if out:
            shift = out[-1][0] - out[-1][1]
        out.append((d, i))
    return out


class Bank:
    """Templates and windows of the benchmark's items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item = {}
        hashes, owner, place = [], [], []
        for key, text in items:
            t = template(text)
            w = windows(t[0])
            own = np.flatnonzero(w)
            if len(own):
                self.item[key] = (t, len(np.unique(w[own])))
                hashes.append(w[own])
                owner += [key] * len(own)
                place.append(own)
        h = np.concatenate(hashes) if hashes else np.zeros(0, _U)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.owner = np.array(owner, np.int64)[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]

    def leaks(self, doc: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, float]]:
        """(item, share of its windows) for the items that the document leaks."""
        w = windows(doc[0])
        if not len(w) or not len(self.hash):
            return []
        at = np.searchsorted(self.hash, w)
        found = np.flatnonzero((at < len(self.hash)) & (self.hash[np.minimum(at, len(self.hash) - 1)] == w) & (w != 0))
        by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for d in found.tolist():
            k = int(at[d])
            while k < len(self.hash) and self.hash[k] == w[d]:
                by[int(self.owner[k])].append((d, int(self.place[k])))
                k += 1
        out = []
        for key, pairs in by.items():
            t, n = self.item[key]
            if len({int(w[d]) for d, _ in pairs}) < THRESHOLD * n:
                continue
            if len(t[0]) < SHINGLE and len(doc[0]) != len(t[0]):
                continue
            best = self._stretch(pairs, w, t, doc, n)
            if best >= THRESHOLD:
                out.append((key, best))
        return sorted(out)

    @staticmethod
    def _stretch(pairs, w, t, doc, n) -> float:
        """The largest share of windows in a stretch of the text whose slots agree."""
        pairs = _aligned(sorted(pairs))
        span = 2 * max(len(t[0]), SHINGLE)
        best, lo, inside, distinct = 0.0, 0, defaultdict(int), 0
        slots = _Slots(t, doc)
        for pair in pairs:
            d = pair[0]
            x = int(w[d])
            slots.move(pair, True)
            inside[x] += 1
            distinct += inside[x] == 1
            while pairs[lo][0] <= d - span:
                y = int(w[pairs[lo][0]])
                slots.move(pairs[lo], False)
                inside[y] -= 1
                distinct -= inside[y] == 0
                lo += 1
            share = distinct / n
            if share >= THRESHOLD and share > best and slots.share() >= THRESHOLD:
                best = share
        return best


_FOUND = "contaminated boolean, n_items int, item_ids array<long>, overlap double"


def _decided(docs: DataFrame, bank_of, asked: Beside | None = None) -> DataFrame:
    """The columns of docs with the decision; with asked, the first is the row number that
    names the items to look for and is not returned."""
    at = docs.columns.index("text")
    skip = 0 if asked is None else 1
    kept = docs.schema.fields[skip:]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            if asked is None:
                rows = [bank_of(b, i).leaks(template(t)) if t else [] for i, t in enumerate(texts)]
            else:
                rids = b.column(0).to_numpy(zero_copy_only=False)
                named = asked.of(rids)
                rows = [bank_of(b, i, named[r]).leaks(template(t)) if t and r in named else [] for i, (r, t) in enumerate(zip(rids.tolist(), texts, strict=True))]
            ids = [[k for k, _ in r] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[skip:], pa.array([bool(r) for r in rows], pa.bool_()), pa.array([len(r) for r in rows], pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array([max((s for _, s in r), default=0.0) for r in rows], pa.float64())],
                names=[*b.schema.names[skip:], "contaminated", "n_items", "item_ids", "overlap"],
            )

    return docs.mapInArrow(run, f"{schema}, {_FOUND}")


def decontaminated(docs: DataFrame, benchmark: DataFrame, most: int = MOST) -> DataFrame:
    """The columns of docs with contaminated, n_items, item_ids and overlap."""
    spark = ship(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item_text")).where("item_id is not null and item_text is not null").distinct()

    def sized(batches):
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(t.split()) + 1 for b in batches for t in b.column(1).to_pylist())], pa.int64())], names=["n"])

    size = items.mapInArrow(sized, "n long").agg(F.sum("n")).first()[0] or 0
    if size <= most:
        bank = spark.sparkContext.broadcast([(r[0], r[1]) for r in items.collect()])  # at most ``most`` windows
        held: list[Bank] = []

        def whole(b, i):
            if not held:
                held.append(Bank(bank.value))
            return held[0]

        return _decided(docs, whole)

    # Larger benchmarks: windows meet by shuffle, whole items only where enough of them do.
    def item_windows(batches):
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = np.unique(windows(template(text)[0]))
                w = w[w != 0]
                if len(w):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(w), pa.int64()), pa.array(w.view(np.int64)), pa.array([len(w)] * len(w), pa.int64())], names=["item_id", "w", "size"])

    def doc_windows(batches):
        for b in batches:
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = np.unique(windows(template(text)[0]))
                w = w[w != 0]
                if len(w):
                    yield pa.RecordBatch.from_arrays([pa.array([rid] * len(w), pa.int64()), pa.array(w.view(np.int64))], names=["_rid", "w"])

    rows = written(docs.withColumn("_rid", F.monotonically_increasing_id()), "decontam")
    listed = items.mapInArrow(item_windows, "item_id long, w long, size long")
    # A leak misses a fifth of an item's windows at most, so it has one of a fifth and one more: the
    # rarest of the item, so that windows of many items bring no pairs.
    common = listed.groupBy("w").agg(F.count("*").alias("_items"))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy("_items", "w"))  # as many as an item has windows
    telling = listed.join(common, "w").withColumn("_rank", rank).where(F.col("_rank") <= F.floor(F.col("size") * (1 - THRESHOLD) + 1e-9) + 1).select("item_id", "w")
    found = rows.select("_rid", F.col("text").cast("string")).mapInArrow(doc_windows, "_rid long, w long").join(telling, "w")
    pairs = found.select("_rid", "item_id").distinct().join(items, "item_id")
    asked = beside(pairs.select(F.col("_rid").alias("rid"), "item_id", "item_text"), "asked")
    return _decided(rows.select("_rid", *[F.col(f"`{c}`") for c in docs.columns]), lambda b, i, found: Bank(found), asked)


def leak_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids and overlap of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return decontaminated(rows, benchmark, **options).drop("text")
