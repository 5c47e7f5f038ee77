"""Quality scores by weak labels: heuristic labellers, EM, hashed linear scorer.

Eight heuristics vote clean, junk or nothing on each text.  Their votes over the
whole corpus are counted by pattern (at most 3**8 counts); expectation
maximisation on the counts estimates how often each says what about clean and
about junk texts, no labels being used.  The posterior of a text's pattern is
its soft label.  A logistic scorer over hashed grams of byte classes and two shares of repeats is fitted
on a bounded sample of texts and their soft labels and applied to all.

Defined cases: null texts are empty; texts without words score 0; an empty
table gives an empty result; repeated rows are scored each; extra columns pass
unused.  Long texts are read in pieces.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.storage import ship
from spanloom.llm.words import pieces

#: About so many texts are fitted on, at most; chosen by hash of doc_id and text.
SAMPLE = 10_000
BINS = 1 << 13
GRAM = 4
LABELLERS = 8

_CLASS = np.zeros(256, np.int64)  # control characters
for _first, _last, _kind in ((97, 122, 1), (65, 90, 2), (48, 57, 3), (192, 255, 4), (128, 159, 5), (160, 191, 6), (32, 32, 7), (9, 13, 8)):
    _CLASS[_first : _last + 1] = _kind
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = np.arange(9, 9 + 32)
KINDS = 41
_END = re.compile(r"[.!?…]+[\"'”»)]*(?:\s|$)")
_PLAIN = re.compile(r"[\"'(«“¿¡]*[^\W\d_]+(?:['’-][^\W\d_]+)*[\"')»”]*[.,;:!?…]?[\"')»”]*")
_RUN = re.compile(r"[!#$%&*@~^=|?]{2,}")
#: Share of the corpus that the prior of the labellers' behaviour weighs.
TRUST = 0.05


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def repeats(text: str) -> tuple[float, float]:
    """Shares of words that equal the word before and of characters in lines that came before."""
    words = text.lower().split()
    again = sum(map(eq, words, words[1:]))
    lines = Counter(x for x in text.split("\n") if x.strip())
    return _share(again, len(words)), _share(sum(len(x) * (c - 1) for x, c in lines.items()), len(text))


def votes(text: str | None) -> tuple[int, ...]:
    """1 clean, 2 junk, 0 nothing, by each heuristic."""
    words = (text or "").split()
    if not words:
        return (0,) * (LABELLERS - 1) + (2,)
    kinds = np.zeros(KINDS, np.int64)
    for part in pieces(text):
        kinds += np.bincount(_CLASS[np.frombuffer(part.encode("utf-8", "replace"), np.uint8)], minlength=KINDS)
    n = len(words)
    upper, letters = kinds[2] + kinds[5], kinds[1] + kinds[2] + kinds[5] + kinds[6]
    plain = sum(kinds[_CLASS[ord(c)]] for c in ".,;:!?'\"()-")
    symbols = kinds[9:].sum() - plain
    total = kinds.sum()
    ends = sum(1 for _ in _END.finditer(text))

    prose = _share(sum(1 for w in words if _PLAIN.fullmatch(w)), n)
    again, twice = repeats(text)
    runs = _share(sum(1 for w in words if _RUN.search(w)), n)
    return (
        2 if letters > 20 and upper > 0.4 * letters else 0,  # capitals
        2 if _share(symbols, total) > 0.03 else 0,  # symbols
        2 if runs > 0.1 else 0,  # words with runs of marks
        2 if _share(kinds[_CLASS[ord("|")]], n) > 0.15 else 0,  # table or menu bars
        2 if prose < 0.6 else 1 if prose >= 0.85 and again < 0.1 and twice < 0.2 else 0,  # plain words
        1 if 0.02 <= ends / n <= 0.4 and again < 0.1 else 2 if n > 20 else 0,  # sentences
        2 if max(again, twice) > 0.3 else 0,  # lines, or words one after another, that repeat
        2 if 50 <= n < 2000 and len(set(words)) < 0.25 * n else 0,  # variety
    )


def _pattern(v: tuple[int, ...]) -> int:
    return int("".join(map(str, v)), 3)


def label_model(counts: dict[int, int], steps: int = 200) -> dict[int, float]:
    """Probability of clean by vote pattern, by expectation maximisation."""
    if not counts:
        return {}
    pats = sorted(counts)
    v = np.array([[int(c) for c in np.base_repr(p, 3).zfill(LABELLERS)] for p in pats])
    c = np.array([counts[p] for p in pats], float)
    says = np.empty((LABELLERS, 2, 3))  # labeller, junk or clean, vote
    says[:, 0], says[:, 1] = usual = np.array([(0.5, 0.1, 0.4), (0.5, 0.49, 0.01)])
    prior = 0.8
    post = np.zeros(len(pats))
    for _ in range(steps):
        like = [np.log(says[np.arange(LABELLERS), k, v]).sum(axis=1) + np.log(p) for k, p in ((0, 1 - prior), (1, prior))]
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
        prior = float(np.clip((c * post).sum() / c.sum(), 0.02, 0.98))
        for k, q in ((0, 1 - post), (1, post)):
            for x in range(3):
                # The prior keeps the votes' sense: clean votes favour clean.
                says[:, k, x] = (c * q) @ (v == x) + TRUST * c.sum() * usual[k, x]
            says[:, k] /= says[:, k].sum(axis=1, keepdims=True)
    return dict(zip(pats, post.tolist(), strict=True))


def grams(text: str | None) -> np.ndarray:
    """Root of the share of each hashed gram of byte classes."""
    out = np.zeros(BINS)
    for part in pieces(text or ""):
        c = _CLASS[np.frombuffer(part.encode("utf-8", "replace"), np.uint8)]
        if len(c) < GRAM:
            c = np.concatenate((c, np.zeros(GRAM - len(c), np.int64)))
        code = np.zeros(len(c) - GRAM + 1, np.int64)
        for k in range(GRAM):
            code = code * KINDS + c[k : len(c) - GRAM + 1 + k]
        out += np.bincount((code * 0x9E3779B1 >> 15) % (BINS - 2), minlength=BINS)
    out = np.sqrt(out / max(1.0, out.sum()))
    if text:
        out[-2:] = repeats(text)  # the last two bins are kept for these
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic weights for sparse rows (bins, values, soft label), by accelerated gradient steps."""
    w, b = np.zeros(BINS), 0.0
    if not rows:
        return w, b
    who = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    idx = np.concatenate([r[0] for r in rows]).astype(np.int64)
    val = np.concatenate([r[1] for r in rows]).astype(float)
    y = np.array([r[2] for r in rows])
    rate, decay = 8.0, 1e-5
    vw, vb = np.zeros(BINS), 0.0
    for _ in range(steps):
        w1, b1 = w + 0.9 * vw, b + 0.9 * vb
        p = 1 / (1 + np.exp(-np.clip(np.bincount(who, val * w1[idx], len(rows)) + b1, -30, 30)))
        g = p - y
        gw = np.bincount(idx, val * g[who], BINS) / len(rows) + decay * w1
        vw, vb = 0.9 * vw - rate * gw, 0.9 * vb - rate * 0.1 * g.mean()
        w, b = w + vw, b + vb
    return w, b


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior by pattern, weights and constant."""
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text"))

    def count(batches):
        found: Counter = Counter()
        for b in batches:
            found.update(_pattern(votes(t)) for t in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["pattern", "n"])

    rows = texts.mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n")).collect()  # at most 3**8 rows
    counts = {r[0]: r[1] for r in rows}
    posterior = label_model(counts)
    total = sum(counts.values())
    chosen = texts
    if total > sample:
        share = int(sample / total * (1 << 40))
        chosen = docs.where(F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(1 << 40)) < share).select(F.col("text").cast("string").alias("text"))

    def features(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            found = [grams(t) for t in texts]
            idx = [np.flatnonzero(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i.astype("<u2").tobytes() for i in idx], pa.binary()), pa.array([x[i].astype("<f4").tobytes() for x, i in zip(found, idx, strict=True)], pa.binary()), pa.array([_pattern(votes(t)) for t in texts], pa.int64())],
                names=["bins", "shares", "pattern"],
            )

    fitted_on = chosen.mapInArrow(features, "bins binary, shares binary, pattern long").collect()  # the bounded sample
    w, b = fit([(np.frombuffer(r[0], "<u2"), np.frombuffer(r[1], "<f4"), posterior.get(r[2], 0.5)) for r in fitted_on])
    return posterior, w, b


_SCORE = "quality_score double, weak_label double, kept boolean"


def scored(docs: DataFrame, model: tuple[dict[int, float], np.ndarray, float]) -> DataFrame:
    """The columns of docs (text among them) with score, weak label and decision."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # BINS weights and 3**8 posteriors at most
    at = docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        posterior, w, c = shared.value
        for b in batches:
            texts = b.column(at).to_pylist()
            score = np.array([1 / (1 + np.exp(-np.clip(grams(t) @ w + c, -30, 30))) if t and t.strip() else 0.0 for t in texts])
            weak = [posterior.get(_pattern(votes(t)), 0.5) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64()), pa.array(weak, pa.float64()), pa.array(score >= 0.5)], names=[*b.schema.names, "quality_score", "weak_label", "kept"])

    return docs.mapInArrow(run, f"{schema}, {_SCORE}")


def quality_scores(docs: DataFrame) -> DataFrame:
    """doc_id, quality_score, weak_label and kept of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(rows, train(rows)).drop("text")
