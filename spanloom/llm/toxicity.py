"""Toxicity scores from a learned lexicon, matched through Levenshtein automata.

Lexicon.  From a bounded sample of labelled training rows, words and word
beginnings (stems) whose documents are toxic almost without exception are kept
with the logarithm of their odds; stems of which that holds only where two words of a text
start so (pairs) count from the second such word on.  They form a trie.

Matching.  The union of the terms' Levenshtein automata is intersected with the
trie: a state is a set of (trie node, edits so far), determinised as words are
read, so a word of ordinary text is left after a few letters.  Terms of FUZZY
letters and more may have one edit (insertion, deletion, substitution or
transposition of neighbours), of FUZZIER and more two; shorter terms and stems
match exactly.  Near forms that clean training documents use are exempt.

Context.  Each match counts with its odds; inside quotation marks, or after a
verb of saying within WINDOW words, it is quoted, otherwise abuse, more so next
to an address.  A logistic model with a prior over the two sums is fitted on the sample.

Labels are learned only from rows whose crc32 of the doc_id's text modulo 5 is
not 0; doc_id, lang, source and labels never enter a score.  Defined cases: null
or empty texts get the score of a text without matches; without training labels of
both kinds the lexicon is empty and all scores are one low constant; labels that
repeat count once (toxic if any is), rows that repeat are scored each; null doc_ids are
scored and not held out; very long texts are scored whole; an empty table gives an empty one;
columns other than doc_id, text and toxic pass unused.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.storage import ship

#: At most so many toxic and clean training rows are fitted on.
SAMPLE_TOXIC = 6_000
SAMPLE_CLEAN = 14_000
FUZZY, FUZZIER = 5, 9
STEM_LETTERS = (4, 5, 6, 7)
WINDOW = 6
STRIP = " .,;:!?\"'()[]{}…“”„«»‘’¡¿*#|-–—"
# Verbs of saying and words of address, in four languages.
SAYING = frozenset("said says say called calls wrote writes quoted quote quotes word words term sagte nannte schrieb zitiert dit disait appelé écrit mot dijo llamó escribió palabra".split())
ADDRESS = frozenset("you your you're u ya du dich dir ihr tu toi vous te tú usted ustedes".split())
_QUOTES = '"“”„«»'


class Matcher:
    """The determinised product of trie and edit automata; word -> weight, 0 without match,
    below 0 for a stem that needs a second word."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], pairs: dict[str, float] | None = None, exempt: frozenset[str] = frozenset()):
        self.exempt = exempt
        self.kids: list[dict[str, int]] = [{}]
        self.word: list[tuple[float, int] | None] = [None]
        self.stem: list[float] = [0.0]
        self.most: list[int] = [0]
        self.pair: list[float] = [0.0]
        for terms, is_stem in ((words, False), (stems, True), (pairs or {}, None)):
            for term, weight in terms.items():
                edits = 0 if is_stem is not False else 2 if len(term) >= FUZZIER else 1 if len(term) >= FUZZY else 0
                at = 0
                self.most[0] = max(self.most[0], edits)
                for c in term:
                    if c not in self.kids[at]:
                        self.kids[at][c] = len(self.kids)
                        self.kids.append({})
                        self.word.append(None)
                        self.stem.append(0.0)
                        self.pair.append(0.0)
                        self.most.append(0)
                    at = self.kids[at][c]
                    self.most[at] = max(self.most[at], edits)
                if is_stem:
                    self.stem[at] = weight
                elif is_stem is None:
                    self.pair[at] = weight
                else:
                    self.word[at] = (weight, edits)
        start = self._closed({(0, 0, "")})
        self.states = {start: 0}
        self.sets = [start]
        self.step: list[dict[str, int]] = [{}]
        self.value: list[tuple[float, float, float]] = [self._value(start)]

    def _closed(self, items: set) -> frozenset:
        """Adds skipped trie letters; drops what has more edits than any term below allows."""
        todo, seen = list(items), {}
        while todo:
            node, e, wait = todo.pop()
            if e > self.most[node] or seen.get((node, wait), 99) <= e:
                continue
            seen[node, wait] = e
            if not wait:
                todo += [(k, e + 1, "") for k in self.kids[node].values()]
        return frozenset((n, e, w) for (n, w), e in seen.items())

    def _value(self, items: frozenset) -> tuple[float, float, float]:
        """(weight of a word that ends here, of a stem and of a pair's stem reached here)"""
        word = max((self.word[n][0] * (1 if not e else 0.9**e) for n, e, w in items if not w and self.word[n] and e <= self.word[n][1]), default=0.0)
        exact = [n for n, e, w in items if not w and not e]
        return word, max((self.stem[n] for n in exact), default=0.0), max((self.pair[n] for n in exact), default=0.0)

    def _next(self, at: int, c: str) -> int:
        out = set()
        for node, e, wait in self.sets[at]:
            if wait:
                if c == wait:
                    out.add((node, e, ""))
                continue
            out.add((node, e + 1, ""))
            for letter, k in self.kids[node].items():
                if letter == c:
                    out.add((k, e, ""))
                else:
                    out.add((k, e + 1, ""))
                    if c in self.kids[k]:
                        out.add((self.kids[k][c], e + 1, letter))
        new = self._closed(out)
        if new not in self.states:
            self.states[new] = len(self.sets)
            self.sets.append(new)
            self.step.append({})
            self.value.append(self._value(new))
        self.step[at][c] = self.states[new]
        return self.states[new]

    def weight(self, word: str) -> float:
        at, best, pair = 0, 0.0, 0.0
        for c in word:
            at = self.step[at].get(c, -1) if c in self.step[at] else self._next(at, c)
            if not self.sets[at]:
                return best or -pair
            best, pair = max(best, self.value[at][1]), max(pair, self.value[at][2])
        found = self.value[at][0]
        return (max(best, found) if found and word not in self.exempt else best) or -pair


def matches(texts: list[str | None], matcher: Matcher) -> dict[int, list[tuple[int, float]]]:
    """Text -> (word number, weight) of its matches; distinct words are matched once."""
    low = pc.utf8_lower(pa.array(texts, pa.large_string()))
    lists = pc.utf8_split_whitespace(low)
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    weight = matcher.weight
    values = np.array([weight(w.strip(STRIP)) for w in coded.dictionary.to_pylist()], float)
    if not len(values) or not values.any():
        return {}
    each = values[coded.indices.to_numpy(zero_copy_only=False)]
    at = np.flatnonzero(each)
    ends = np.cumsum(n)
    text = np.searchsorted(ends, at, "right")
    out: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for t, k in zip(text.tolist(), at.tolist(), strict=True):
        out[t].append((k - int(ends[t] - n[t]), float(each[k])))
    return out


def context_sums(text: str, hits: list[tuple[int, float]]) -> tuple[float, float]:
    """Weights of (abuse, quotation)."""
    words = text.lower().split()
    marks = np.cumsum([sum(w.count(q) for q in _QUOTES) for w in words])
    total = int(marks[-1]) if words else 0
    abuse = quoted = 0.0
    several = sum(weight < 0 for _, weight in hits) > 1
    for k, weight in hits:
        if weight < 0:
            if not several:
                continue
            weight = -weight
        if k >= len(words):  # odd white space parts words otherwise in Arrow
            abuse += weight
            continue
        before = int(marks[k - 1]) if k else 0
        inside = before % 2 == 1 and total > before or (words[k][:1] in _QUOTES and total > before)
        near = {w.strip(STRIP) for w in words[max(0, k - WINDOW) : k]}
        if inside or near & SAYING and any(q in words[k] for q in _QUOTES):
            quoted += weight
        else:
            address = ADDRESS & {w.strip(STRIP) for w in words[max(0, k - 3) : k + 4]}
            abuse += weight * (1.25 if address else 1)
    return abuse, quoted


def _sums(texts: list[str | None], matcher: Matcher) -> np.ndarray:
    out = np.zeros((len(texts), 2))
    for t, hits in matches(texts, matcher).items():
        out[t] = context_sums(texts[t], hits)
    return out


def _shaped(sums: np.ndarray) -> np.ndarray:
    """Features of the logistic model: constant, abuse, quotation (sums saturate)."""
    return np.column_stack((np.ones(len(sums)), np.log1p(sums[:, 0]), np.log1p(sums[:, 1])))


#: Prior of the model: no match is clean, one match of usual odds is abuse, a quoted one is not.
PRIOR = np.array([-4.0, 6.0, 1.0])


def fitted(x: np.ndarray, y: np.ndarray, strength: float = 2.0) -> np.ndarray:
    """Logistic weights with a Gaussian prior around PRIOR, by Newton steps that are halved
    until they are better."""

    def loss(w):
        z = x @ w
        return (np.logaddexp(0, z) - y * z).sum() + strength / 2 * ((w - PRIOR) ** 2).sum()

    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + strength * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(3), grad)
        now = loss(w)
        while np.abs(step).max() >= 1e-8 and loss(w - step) > now:
            step /= 2
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def lexicon(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """(words, stems, pairs) with log odds, from the numbers of documents that have each; in
    the counters a stem ends in an asterisk, a stem of two words or more in two."""
    least = max(4, math.ceil(0.03 * n_toxic))

    def odds(t: str) -> float:
        return math.log((toxic[t] + 0.5) / (n_toxic + 1)) - math.log((clean[t] + 0.5) / (n_clean + 1))

    pure = {t: odds(t) for t, n in toxic.items() if n >= least and odds(t) > math.log(30) and clean[t] <= (0.12 * n if t[-2:] == "**" else 0.02 * n)}
    twice = {t: w for t, w in pure.items() if t[-2:] == "**"}
    pure = {t: w for t, w in pure.items() if t not in twice}
    words = {t: w for t, w in pure.items() if t[-1] != "*" and len(t) >= 3}
    stems: dict[str, float] = {}
    for t in sorted((t for t in pure if t[-1] == "*"), key=lambda t: (len(t), t)):
        s = t[:-1]
        own = [w for w in words if w.startswith(s)]
        # A stem needs documents that its commonest word alone does not explain.
        if any(s.startswith(x) for x in stems) or own and max(toxic[w] for w in own) > 0.8 * toxic[t]:
            continue
        # The longest beginning that the same documents have.
        while longer := next((x for x in pure if x[-1] == "*" and x[:-2] == s and toxic[x] >= 0.98 * toxic[t]), None):
            s = longer[:-1]
        stems[s] = min(6.0, pure[t])
    words = {w: min(6.0, x) for w, x in words.items() if not any(w.startswith(s) for s in stems)}
    pairs: dict[str, float] = {}
    for t in sorted(twice, key=lambda t: (-len(t), t)):
        # The longest beginning whose texts are nearly all of a shorter one's speaks for both,
        # and so does a word that most of a beginning's texts have.
        if any(w.startswith(t[:-2]) and toxic[w] > 0.8 * toxic[t] for w in words):
            continue
        if not any(t[:-2].startswith(x) for x in stems) and not any(x.startswith(t[:-2]) and toxic[x + "**"] >= 0.9 * toxic[t] for x in pairs):
            pairs[t[:-2]] = min(6.0, twice[t])
    return words, stems, pairs


def _terms(text: str) -> set[str]:
    words = [w.strip(STRIP) for w in text.lower().split()]
    out = {w for w in words if w.isalpha()}
    for n in STEM_LETTERS:
        found = Counter(w[:n] for w in words if len(w) > n and w[:n].isalpha())
        out |= {s + "*" for s in found}
        out |= {s + "**" for s, k in found.items() if k > 1}
    return out


def train(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> tuple[Matcher, np.ndarray]:
    """Matcher and model from a bounded sample of training rows (in hash order of doc_id)."""
    l = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    l = l.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(held_out_remainder("doc_id") != 0).orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = l.where("toxic = 1").limit(sample_toxic).union(l.where("toxic = 0").limit(sample_clean))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))  # bounded by the sample

    def count(batches):
        n = [0, 0]
        found: list[Counter] = [Counter(), Counter()]
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[toxic] += 1
                found[toxic].update(_terms(text or ""))
        # Terms that no toxic document of the part has matter only if another part has one.
        terms = [*found[1], *(t for t in found[0] if t not in found[1])]
        yield pa.RecordBatch.from_arrays([pa.array(["", *terms]), pa.array([n[1], *(found[1][t] for t in terms)], pa.int64()), pa.array([n[0], *(found[0][t] for t in terms)], pa.int64())], names=["term", "toxic", "clean"])

    terms = texts.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rows = terms.where("term = '' or toxic >= 4 and clean <= 0.12 * toxic").collect()  # terms of a bounded sample
    head = next((r for r in rows if r[0] == ""), ("", 0, 0))
    n_toxic, n_clean = int(head[1] or 0), int(head[2] or 0)
    if not n_toxic or not n_clean:
        return Matcher({}, {}), PRIOR
    words, stems, pairs = lexicon(Counter({r[0]: r[1] for r in rows if r[0]}), Counter({r[0]: r[2] for r in rows if r[0]}), n_toxic, n_clean)
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast((words, stems, pairs))

    def measure(batches):
        m = Matcher(*shared.value)
        for b in batches:
            texts, toxic = b.column(0).to_pylist(), b.column(1).to_pylist()
            sums = _sums(texts, m)
            near = [sorted({x for x in (w.strip(STRIP) for w in t.lower().split()) if x not in words and m.weight(x) > 0}) if t and not y and sums[i].any() else [] for i, (t, y) in enumerate(zip(texts, toxic, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(sums[:, 0]), pa.array(sums[:, 1]), b.column(1), pa.array(near, pa.list_(pa.string()))], names=["abuse", "quoted", "toxic", "near"])

    seen = texts.mapInArrow(measure, "abuse double, quoted double, toxic int, near array<string>").collect()  # a row per sampled document
    exempt = frozenset(w for r in seen for w in r[3])
    x = np.array([(r[0], r[1]) for r in seen])
    y = np.array([r[2] for r in seen], float)
    for i, r in enumerate(seen):
        if r[3]:
            x[i] = 0  # near forms that clean documents use are exempt
    return Matcher(words, stems, pairs, exempt), fitted(_shaped(x), y)


def held_out_remainder(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted and the context sums of every document."""
    spark = ship(docs.sparkSession)
    matcher, model = train(docs, labels, **options)
    shared = spark.sparkContext.broadcast((matcher, model))  # a lexicon of a bounded sample

    def run(batches):
        from spanloom.llm.tokens import slices

        m, w = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            parts = [_sums(texts[lo:hi], m) for lo, hi in slices(texts)]
            if not parts:
                continue
            sums = np.concatenate(parts)
            score = 1 / (1 + np.exp(-np.clip(_shaped(sums) @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["doc_id", "score", "predicted", "abuse", "quoted"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int, abuse double, quoted double")
    return rows.select("doc_id", F.coalesce(held_out_remainder("doc_id") == 0, F.lit(False)).alias("held_out"), "score", "predicted", "abuse", "quoted")
