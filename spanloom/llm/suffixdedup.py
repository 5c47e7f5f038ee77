"""Repeated byte strings across documents, by suffix order and previous factors.

A string of LENGTH bytes that starts at two places is a repeat; bytes that a
repeat covers are removed.  ``keep="none"`` removes every copy, ``keep="first"``
leaves the first one (by doc_id, nulls last, then row).

Suffixes are dealt into bins that hold all equal strings: a window of LENGTH
bytes goes to the bin of its anchor, the GRAM-byte string with the smallest hash
in it (leftmost on ties), so equal windows meet with the anchor at the same
offset.  Windows next to one another that share an anchor are one context.
Contexts with equal bytes are one class and take part once, with their number.
Bins of one context class need no text.  In the others, the bytes of a class's
first context are fetched and the suffixes of a bin are ordered by induction: the
rank of the suffix at offset t+1 before the anchor is that of (byte, rank at t).
In suffix order, the previous and next smaller positions give the longest
previous factor (``first``), the neighbours the longest common factor
(``none``); a window repeats where it is LENGTH bytes or more.

A bin of more than HOT classes is not gathered in one task: its contexts are cut by the
offset of their windows' anchor, into WAYS ranges each time, and dealt again by the
bytes that all windows of the range cover.  Equal windows stay together, contexts that
have become equal are one class again, and at one offset all windows of a bin are equal,
so every bin gets small enough to be ordered.

Texts are never shuffled: contexts and hits are written by row number and looked up by
the tasks that read the texts.

Passages of words (``without_repeats`` with words=N) are found the same way in texts whose
words are replaced by WIDTH bytes of their hashes, so N words have one length whatever their
letters, and case (of ASCII letters), white space and punctuation between words do not matter.

Defined cases: null texts are empty; matches never cross documents; texts under
LENGTH bytes lose nothing; rows that repeat are documents of their own (with
keep="first" the one of smaller row number is the first); null doc_ids come last; long texts
are read in overlapping segments; an empty table gives an empty one; columns other than those
named pass unused.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.storage import Beside, beside, discard, ship, shuffle_parts, written
from spanloom.llm.words import _ODD_PUNCT, mix, powers, prefix_hash, span_hash, word_spans

LENGTH = 400
GRAM = 40
#: Context classes of a bin that is ordered as it is.
HOT = 512
#: Ranges of offsets that a larger bin's contexts are cut into, again and again.
WAYS = 4
#: Keys that are broadcast at most because many rows, more than LIGHT, have them.
HEAVY = 1000
LIGHT = 1000
#: Bits of a sieve for each key, and at most.
SIEVE = 16
SIEVE_MOST = 1 << 26
#: Contexts that are ordered at once.
BATCH = 16_384
#: Words of a passage that the registered queries look for beside byte strings.
PASSAGE = 51
#: Bytes that stand for a word, and words of an anchor.
WIDTH = 5
WORD_GRAM = 6
_SEGMENT = 1 << 20
_BITS = 21
_U = np.uint64
_I = np.int64


def _bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _spans_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and where words start and end; places are those of the text's own bytes."""
    text = text or ""
    if not text.isascii():
        text = _ODD_PUNCT.sub(lambda m: " " * len(m[0].encode()), text)
    return word_spans(_bytes_of(text).lower())


def _word_bytes(text: str | None) -> bytes:
    """WIDTH bytes of each word's hash."""
    b, s, e = _spans_of(text)
    out = []
    for k in range(0, len(s), BATCH):
        start, end = s[k : k + BATCH], e[k : k + BATCH]
        lo = int(start[0])
        h = mix(span_hash(prefix_hash(b[lo : int(end[-1])]), start - lo, end - lo) ^ (end - start).astype(_U))
        out.append(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes())
    return b"".join(out)


def _word_ranges(hits: list[tuple], words: int, text: str | None) -> list[tuple[int, int]]:
    """Byte ranges of the text that hits on its word bytes cover; windows within a word do not count."""
    _, s, e = _spans_of(text)
    out = []
    for at, runs in hits:
        for lo, hi in zip(runs[::2], runs[1::2], strict=True):
            first, last = -(-(at + lo) // WIDTH), (at + hi - 1) // WIDTH
            if first <= last:
                out.append((int(s[first]), int(e[last + words - 1])))
    return out


def _joined(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges, in order."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by minima from both ends of blocks of w."""
    n = len(x)
    pad = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, _U)
    pad[:n] = x
    blocks = pad.reshape(-1, w)
    fore = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], fore[w - 1 : n])


def anchors(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Contexts of texts that lie in b, one after another: (text, first window's place in
    b, windows, anchor's offset, anchor hash, context hash)."""
    none = tuple(np.zeros(0, t) for t in (_I, _I, _I, _I, _U, _U))
    if len(b) < length:
        return none
    prefix = prefix_hash(b)
    inverse = powers(len(b) + 1)[1]
    grams = mix((prefix[gram:] - prefix[:-gram]) * inverse[: len(b) - gram + 1])
    low = _U((1 << _BITS) - 1)
    least = _sliding_min(grams & ~low | np.arange(len(grams), dtype=_U), length - gram + 1)
    size = np.maximum(ends - starts - length + 1, 0)
    total = np.cumsum(size)
    if not total[-1]:
        return none
    text = np.repeat(np.arange(len(starts)), size)
    place = np.arange(total[-1]) - np.repeat(total - size, size) + np.repeat(starts, size)
    at = (least[place] & low).astype(_I)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]))))
    n = np.diff(np.concatenate((new, [len(at)])))
    first, a = place[new], at[new]
    last = first + n + length - 1
    ctx = mix((prefix[last] - prefix[first]) * inverse[first] + mix((n * 4096 + a - first).astype(_U)))
    return text[new], first, n, a - first, grams[a], ctx


def _anchor_rows(rows: DataFrame, length: int, gram: int, encode=_bytes_of) -> DataFrame:
    """(rid, doc, text) -> one row per context."""
    schema = "rid long, doc long, first long, n int, off int, h long, ctx long"

    def run(batches):
        def out(rids, docs, shift, found):
            text, first, n, off, h, ctx = found
            return pa.RecordBatch.from_arrays(
                [pa.array(rids[text]), docs.take(pa.array(text)), pa.array(first + shift[text]), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(h.view(_I)), pa.array(ctx.view(_I))],
                names=[x.split()[0] for x in schema.split(", ")],
            )

        for b in batches:
            rids = b.column(0).to_numpy(zero_copy_only=False)
            held: list[tuple[int, int, bytes]] = []
            size = 0

            def flush():
                raw = [x[2] for x in held]
                ends = np.cumsum([len(x) for x in raw])
                starts = ends - np.array([len(x) for x in raw])
                which = np.array([x[0] for x in held])
                found = anchors(np.frombuffer(b"".join(raw), np.uint8), starts, ends, length, gram)
                return out(rids[which], b.column(1).take(pa.array(which)), np.array([x[1] for x in held]) - starts, found)

            for i, t in enumerate(b.column(2).to_pylist()):
                raw = encode(t)
                step = _SEGMENT - length + 1
                for at in range(0, max(1, len(raw) - length + 1), step):
                    part = raw[at : at + _SEGMENT]
                    if len(part) < length:
                        continue
                    if held and size + len(part) > _SEGMENT:
                        yield flush()
                        held, size = [], 0
                    held.append((i, at, part))
                    size += len(part)
            if held:
                yield flush()

    return rows.mapInArrow(run, schema)


def _smaller_before(rank: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1; by pointer jumping."""
    to = np.arange(-1, len(rank) - 1)
    while True:
        far = np.flatnonzero((to >= 0) & (rank[to] > rank))
        if not len(far):
            return to
        to[far] = to[to[far]]


def matched_windows(group: np.ndarray, off: np.ndarray, n: np.ndarray, raw: list[bytes], position: np.ndarray, length: int, first: bool) -> np.ndarray:
    """Which windows of contexts repeat within their bins: a matrix context by offset t
    before the anchor.  position orders the contexts' places (for ``first``)."""
    m = len(raw)
    left = int(off.max()) if m else 0
    size = np.array([len(x) for x in raw], _I)
    right = int((size - off).max()) if m else 0
    grid = np.zeros((m, left + right), np.uint8)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    row = np.repeat(np.arange(m), size)
    grid[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + left - off[row]] = flat
    key = np.ascontiguousarray(np.concatenate((group.astype(">u4").view(np.uint8).reshape(m, 4), grid[:, left:]), axis=1)).view(f"S{4 + right}").reshape(m)
    rank = np.unique(key, return_inverse=True)[1].astype(_I)
    del key
    lo, hi = off - n + 1, off
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    for t in range(left + 1):
        live = np.flatnonzero(off >= t)
        if t:
            code = (group[live] * 256 + grid[live, left - t]) * m + rank[live]
            order = np.argsort(code, kind="stable")
            rank[live[order]] = np.concatenate(([0], np.cumsum(np.diff(code[order]) != 0)))
            order = live[order]
        else:
            order = np.argsort(rank, kind="stable")
        order = order[(lo[order] <= t) & (t <= hi[order])]
        if len(order) < 2:
            continue
        if first:
            for way in (order, order[::-1]):
                to = _smaller_before(position[way])
                ok = to >= 0
                found.append((t, way[ok], way[to[ok]]))
        else:
            found.append((t, order[1:], order[:-1]))
    out = np.zeros((m, left + 1), bool)
    if not found:
        return out
    who = np.concatenate([x[1] for x in found])
    mate = np.concatenate([x[2] for x in found])
    t = np.repeat([x[0] for x in found], [len(x[1]) for x in found])
    same = group[who] == group[mate]
    who, mate, t = who[same], mate[same], t[same]
    pairs, which = np.unique(who * m + mate, return_inverse=True)
    back, ahead = np.zeros(len(pairs), _I), np.zeros(len(pairs), _I)
    for k in range(0, len(pairs), BATCH):
        i, j = np.divmod(pairs[k : k + BATCH], m)
        differ = grid[i] != grid[j]
        some = np.minimum(size[i] - off[i], size[j] - off[j])
        d = differ[:, left:]
        ahead[k : k + BATCH] = np.minimum(np.where(d.any(axis=1), d.argmax(axis=1), right), some)
        d = differ[:, :left][:, ::-1]
        back[k : k + BATCH] = np.minimum(np.where(d.any(axis=1), d.argmax(axis=1), left) if left else 0, np.minimum(off[i], off[j]))
    ok = (back[which] >= t) & (ahead[which] >= length - t)
    out[who[ok], t[ok]] = True
    if not first:
        out[mate[ok], t[ok]] = True
    return out


def _runs(hit: np.ndarray) -> list[int]:
    """Starts and ends of true runs, in turn."""
    edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), axis=1).reshape(-1).tolist()


_CONTEXT = "h long, ctx long, n int, off int, doc long, rid long, first long, k long, lo int, hi int, raw binary"
_HITS = "rid long, first long, runs array<int>"


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def _batch_of(kind: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch of a schema of the types above."""
    names, types = zip(*(x.split() for x in kind.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(cols, types, strict=True)], names=list(names))


def _ordered_bins(contexts: DataFrame, length: int, first: bool) -> DataFrame:
    """Repeated window runs of contexts by suffix order; a bin is never parted."""

    def solve(rows: list[tuple]):
        h = np.array([r[0] for r in rows], _I)
        group = np.unique(h, return_inverse=True)[1]
        n, off = (np.array([r[k] for r in rows], _I) for k in (2, 3))
        place = np.lexsort(([r[6] + r[3] for r in rows], [r[5] for r in rows], [r[4] or 0 for r in rows], [r[4] is None for r in rows]))
        position = np.empty(len(rows), _I)
        position[place] = np.arange(len(rows))
        hit = matched_windows(group, off, n, [r[10] for r in rows], position, length, first)
        out = []
        for i in np.flatnonzero(hit.any(axis=1)):
            out.append((rows[i][5], rows[i][6], _runs(np.ascontiguousarray(hit[i, off[i] - n[i] + 1 : off[i] + 1][::-1]))))
        return _batch_of(_HITS, out)

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(held) >= BATCH and held[-1][0] != r[0]:
                    yield solve(held)
                    held = []
                held.append(r)
        if held:
            yield solve(held)

    return contexts.repartition(shuffle_parts(contexts.sparkSession), "h").sortWithinPartitions("h").mapInArrow(run, _HITS)


def _name(*parts: bytes | int) -> int:
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(p if isinstance(p, bytes) else p.to_bytes(8, "little", signed=True))
    return int.from_bytes(h.digest(), "little", signed=True)


def parted(context: tuple, length: int) -> list[tuple]:
    """A context cut by the offset of its windows' anchor, lo .. hi in WAYS ranges.  The windows
    of a range share the bytes that all its offsets cover, which name its bin."""
    _, _, n, off, doc, rid, first, _, lo, hi, raw = context
    edges = sorted({lo + (hi - lo + 1) * k // WAYS for k in range(WAYS)}) + [hi + 1]
    out = []
    for a, b in zip(edges, [e - 1 for e in edges[1:]], strict=False):
        least, most = max(a, off - n + 1), min(b, off)
        if least > most:
            continue
        skip, m = off - most, most - least + 1
        own = raw[skip : skip + m + length - 1]
        out.append((_name(raw[off - a : off - b + length], a, b), _name(own, most), m, most, doc, rid, first + skip, 0, a, b, own))
    return out


def _parted(contexts: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for b in batches:
            yield _batch_of(_CONTEXT, [x for r in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in parted(r, length)])

    return contexts.mapInArrow(run, _CONTEXT)


def _classes(members: DataFrame) -> DataFrame:
    """Contexts of equal bytes as one row: their number c, the bin's number of classes k and the
    first one's place; classes that are alone in every way are left out."""
    place = F.struct(F.col("doc").isNull().alias("z"), "doc", "rid", "first", "n", "off")
    classes = members.groupBy("h", "ctx").agg(F.count("*").alias("c"), F.min(place).alias("p"))
    bins = classes.groupBy("h").agg(F.count("*").alias("k"), F.sum("c").alias("_all")).where("_all > 1").drop("_all")
    return written(classes.join(bins, "h").select("h", "ctx", "c", "k", "p.doc", "p.rid", "p.first", "p.n", "p.off"), "classes")


def _sieved(rows: DataFrame, named: DataFrame, on: list[str], keys: int) -> DataFrame:
    """rows without most of those whose key is none of named's, by a broadcast table of bits, SIEVE
    for each of so many keys and SIEVE_MOST at most.  It drops no row that named has, and few
    others pass, so a join that follows need not shuffle the rest."""
    bits = min(SIEVE_MOST, 1 << max(6, (SIEVE * keys).bit_length()))
    at = F.pmod(F.xxhash64(*on), F.lit(bits))
    words = named.select(at.alias("_bit")).groupBy(F.expr("shiftright(_bit, 6)").alias("_word"))
    words = words.agg(F.expr("bit_or(shiftleft(1L, CAST(_bit & 63 AS INT)))").alias("_set"))
    hit = F.expr("shiftright(_at, 6) = _word AND shiftright(_set, CAST(_at & 63 AS INT)) & 1 = 1")
    # A semi join, since Spark pushes other semi joins below an inner one; SIEVE_MOST / 64 rows at most.
    return rows.withColumn("_at", at).join(F.broadcast(words), hit, "left_semi").drop("_at")


def _met(rows: DataFrame, named: DataFrame, on: list[str], how: str) -> DataFrame:
    """rows joined with a written table of keys that knows the number of rows of each, c.  Keys with
    more than one in HEAVY of these rows, which are HEAVY at most, are broadcast, so no key
    brings its rows into one task.  Of the others, rows that a sieve keeps are shuffled."""
    total, keys = named.agg(F.sum("c"), F.count("*")).first()
    heavy = F.col("c") > max(LIGHT, (total or 0) // HEAVY)
    few = F.broadcast(named.where(heavy).drop("c"))  # HEAVY rows at most
    light = named.where(~heavy).drop("c")
    rest = _sieved(rows, light, on, keys).join(F.broadcast(named.where(heavy).select(*on)), on, "left_anti")  # the same
    return rows.join(few, on, how).unionByName(rest.join(light, on, how))


def _whole(members: DataFrame, classes: DataFrame, first: bool) -> DataFrame:
    """All windows of contexts that have equals; the first of them is left where first copies stay."""
    several = classes.where("c > 1").select("h", "ctx", "c", F.col("rid").alias("_rep"), F.col("first").alias("_at"))
    found = _met(members, several, ["h", "ctx"], "inner")
    if first:
        found = found.where((F.col("rid") != F.col("_rep")) | (F.col("first") != F.col("_at")))
    return found.select("rid", "first", F.array(F.lit(0), F.col("n")).alias("runs"))


def _fetched(rows: DataFrame, wanted: Beside, length: int, top: int, encode) -> DataFrame:
    """(rid, doc, text) -> the wanted contexts with their bytes."""

    def run(batches):
        for b in batches:
            rids = b.column(0).to_numpy(zero_copy_only=False)
            lists = wanted.of(rids)
            out = []
            for i in [i for i, r in enumerate(rids.tolist()) if r in lists]:
                doc, rid, raw = b.column(1)[i].as_py(), int(rids[i]), encode(b.column(2)[i].as_py())
                for h, ctx, n, off, first, k in lists[rid]:
                    out.append((h, ctx, n, off, doc, rid, first, k, 0, top, raw[first : first + n + length - 1]))
                    if len(out) >= 4096:
                        yield _batch_of(_CONTEXT, out)
                        out = []
            if out:
                yield _batch_of(_CONTEXT, out)

    return rows.select("_rid", "_doc", "_text").mapInArrow(run, _CONTEXT)


def repeated_runs(rows: DataFrame, length: int = LENGTH, keep: str = "none", gram: int = GRAM, hot: int = HOT, encode=_bytes_of) -> Beside:
    """(_rid, _doc, _text) -> by row, (first, runs) of the windows to remove."""
    first = keep == "first"
    found = written(_anchor_rows(rows.select("_rid", "_doc", "_text"), length, gram, encode), "anchors")
    shared = written(found.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    members = written(_met(found, shared, ["h"], "left_semi"), "members")
    discard(found, shared)
    classes = _classes(members)
    spent: list = [members, classes]
    hits = _whole(members, classes, first)
    wanted = beside(classes.where("k > 1").select("rid", "h", "ctx", "n", "off", "first", "k"), "wanted")
    spent.append(wanted)
    contexts = _fetched(rows, wanted, length, length - gram, encode)
    ordinary = (F.col("k") <= hot) | (F.col("lo") == F.col("hi"))
    small = None
    hottest = classes.agg(F.max("k")).first()[0] or 0
    while hottest > hot:
        # Bins of many classes are parted by further bytes, so each stays small enough to be ordered.
        contexts = written(contexts, "contexts")
        spent.append(contexts)
        done = contexts.where(ordinary)
        small = done if small is None else small.union(done)
        parts = written(_parted(contexts.where(~ordinary), length), "parts")
        classes = _classes(parts)
        spent += [parts, classes]
        hits = hits.union(_whole(parts, classes, first))
        several = classes.where("k > 1").select("h", "ctx", "rid", "first", F.col("k").alias("_k"))
        key = ["h", "ctx", "rid", "first"]
        contexts = _sieved(parts.drop("k"), several, key, several.count()).join(several, key).withColumnRenamed("_k", "k")
        contexts = contexts.select("h", "ctx", "n", "off", "doc", "rid", "first", "k", "lo", "hi", "raw")
        hottest = classes.where("k > 1").join(parts.where("lo < hi").select("h").distinct(), "h", "left_semi").agg(F.max("k")).first()[0] or 0
    small = contexts if small is None else small.union(contexts)
    out = beside(hits.union(_ordered_bins(small, length, first)), "hits")
    discard(*spent)
    return out


def byte_ranges(hits: list[tuple], length: int) -> list[tuple[int, int]]:
    """Disjoint, maximal (start, end) of the bytes that windows cover."""
    return _joined([(first + s, first + e + length - 1) for first, runs in hits for s, e in zip(runs[::2], runs[1::2], strict=True)])


def numbered(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The rows to work on, written once so that their numbers hold."""
    cols = [F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("_text"), *(F.col(c) for c in carry)]
    return written(docs.select(F.monotonically_increasing_id().alias("_rid"), *cols), "rows")


def _searched(rows: DataFrame, length: int, keep: str, words: int, options: dict) -> tuple[Beside, Beside | None]:
    """Hits of byte strings and, where words is given, of passages of so many words."""
    found = repeated_runs(rows, length, keep, **options)
    if not words:
        return found, None
    return found, repeated_runs(rows, words * WIDTH, keep, **(options | {"gram": min(WORD_GRAM, words) * WIDTH, "encode": _word_bytes}))


def repeat_report(docs: DataFrame, length: int = LENGTH, keep: str = "none", words: int = 0, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the checksum of what is kept, of strings of length
    bytes; with words, n_passage_bytes too: the bytes in passages of so many words that occur again."""
    ship(docs.sparkSession)
    rows = numbered(docs, [])
    hits, more = _searched(rows, length, keep, words, options)
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", n_passage_bytes long" if words else "")

    def run(batches):
        for b in batches:
            rids = b.column(0).to_numpy(zero_copy_only=False)
            found, passages = hits.of(rids), more.of(rids) if words else {}
            out = []
            for rid, doc, text in zip(rids.tolist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = _bytes_of(text)
                pairs = byte_ranges(found.get(rid, []), length)
                sha, at = hashlib.sha256(), 0
                for a, z in [*pairs, (len(raw), len(raw))]:
                    sha.update(raw[at:a])
                    at = z
                row = (doc, len(raw), sum(z - a for a, z in pairs), len(pairs), sha.hexdigest())
                if words:
                    row += (sum(z - a for a, z in _joined(_word_ranges(passages[rid], words, text))) if rid in passages else 0,)
                out.append(row)
            yield _batch_of(kind, out)

    return rows.select("_rid", "_doc", "_text").mapInArrow(run, kind)


def without_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "first", words: int = 0, **options) -> DataFrame:
    """doc_id, text, lang, source and n_chars with later copies cut out of the texts, of
    strings of length bytes and, where words is given, of passages of so many words too.  A
    removed range that would part a character leaves that character's bytes in place."""
    ship(docs.sparkSession)
    rows = numbered(docs, ["lang", "source"])
    hits, more = _searched(rows, length, keep, words, options)

    def cut(text, found, passages):
        raw = _bytes_of(text)
        pairs = byte_ranges(found, length)
        if passages:
            pairs = _joined(pairs + _word_ranges(passages, words, text))
        out, at = [], 0
        for a, z in pairs:
            while a < z and raw[a] & 0xC0 == 0x80:
                a += 1
            while z < len(raw) and z > a and raw[z] & 0xC0 == 0x80:
                z -= 1
            out.append(raw[at:a])
            at = z
        return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")

    def run(batches):
        for b in batches:
            rids = b.column(0).to_numpy(zero_copy_only=False)
            found, passages = hits.of(rids), more.of(rids) if words else {}
            texts = b.column(2)
            if found or passages:
                texts = texts.to_pylist()
                for i, rid in enumerate(rids.tolist()):
                    if rid in found or rid in passages:
                        texts[i] = cut(texts[i], found.get(rid, []), passages.get(rid))
                texts = pa.array(texts, pa.string())
            size = pa.compute.utf8_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(1), texts, b.column(3), b.column(4), size], names=["doc_id", "text", "lang", "source", "n_chars"])

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    return rows.select("_rid", "_doc", "_text", F.col("lang").cast("string"), F.col("source").cast("string")).mapInArrow(run, kind)
