"""Token files coded by a static range asymmetric numeral system.

One frequency table over the whole corpus is quantised to 2**PRECISION and
shared by all files.  A file is a run of independent blocks; a block holds whole
documents in ascending order and codes them in interleaved lanes: 64-bit lane
states with 32-bit renormalisation words, all lanes stepped together.

File layout (little-endian): 8 bytes magic ``SLRANS01``, u32 checksum of the
frequency table, then blocks.  Block: header of 6 u32 (tokens, documents, lanes,
words, checksum of the ids, checksum of the body), then the body: i64 ids and u32
lengths of the documents, u8 flags of null ids, u64 lane states (the checkpoints a reader starts at),
u32 words.  The manifest gives path, offset, size and first token of each block,
so blocks are decoded in any order and in parallel.

Defined cases: null or empty texts are the end id alone; null doc_ids come
first; equal doc_ids follow one another; an empty table writes no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.storage import discard, fresh_path, fs_of, make_dir, normal_uri, ship, shuffle_parts, written
from spanloom.llm.tokens import encoder, slices

PRECISION = 18
LANES = 2048
BLOCK = 1 << 19
MAGIC = b"SLRANS01"
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<6I")
_U = np.uint64


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**PRECISION, at least 1 where counted."""
    total, size = int(counts.sum()), 1 << PRECISION
    if not total:
        out = np.zeros(len(counts), np.int64)
        out[:1] = size
        return out
    out = np.where(counts > 0, np.maximum(1, counts * (size / total)).astype(np.int64), 0)
    order = np.argsort(-counts, kind="stable")
    excess = int(out.sum()) - size
    if excess < 0:
        out[order[0]] -= excess
    for i in order:
        if excess <= 0:
            break
        cut = min(excess, int(out[i]) - 1) if excess < out[i] // 2 else int(out[i]) // 2
        out[i] -= cut
        excess -= cut
    if excess > 0:
        raise ValueError("more symbols than the table's precision holds")
    return out


class Coder:
    """Encoder and decoder of one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(_U)
        self.start = (np.cumsum(freq) - freq).astype(_U)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.pad = int(np.argmax(freq))

    def encode(self, ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """(lanes, states, words)"""
        lanes = max(1, min(LANES, len(ids) // 64))
        steps = -(-len(ids) // lanes)
        padded = np.full(steps * lanes, self.pad, np.int64)
        padded[: len(ids)] = ids
        grid = padded.reshape(steps, lanes)
        x = np.full(lanes, _LOW, _U)
        words: list[np.ndarray] = []
        shift, top = _U(PRECISION), _U(63 - PRECISION)
        for k in range(steps - 1, -1, -1):
            f, c = self.freq[grid[k]], self.start[grid[k]]
            over = x >= f << top
            if over.any():
                words.append((x[over] & _U(0xFFFFFFFF)).astype("<u4"))
                x[over] >>= _U(32)
            q = x // f
            x = (q << shift) + (x - q * f) + c
        return lanes, x, np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")

    def decode(self, n: int, lanes: int, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        steps = -(-n // lanes)
        out = np.empty((steps, lanes), np.uint32)
        x, at, mask, shift = states.astype(_U), 0, _U((1 << PRECISION) - 1), _U(PRECISION)
        for k in range(steps):
            slot = x & mask
            s = self.symbol[slot]
            out[k] = s
            x = self.freq[s] * (x >> shift) + slot - self.start[s]
            low = x < _LOW
            m = int(np.count_nonzero(low))
            if m:
                x[low] = (x[low] << _U(32)) | words[at : at + m]
                at += m
        return out.reshape(-1)[:n]

    def block(self, docs: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
        lanes, states, words = self.encode(ids)
        body = b"".join((np.array([d or 0 for d in docs], "<i8").tobytes(), np.array(lengths, "<u4").tobytes(), bytes(d is None for d in docs), states.astype("<u8").tobytes(), words.tobytes()))
        return _HEAD.pack(len(ids), len(docs), lanes, len(words), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body

    def unblock(self, raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """(doc ids, lengths, token ids); raises ValueError where a checksum fails."""
        n, docs, lanes, n_words, crc, body_crc = _HEAD.unpack_from(raw)
        body = raw[_HEAD.size :]
        if zlib.crc32(body) != body_crc or len(body) != 13 * docs + 8 * lanes + 4 * n_words:
            raise ValueError("a block is damaged")
        names = np.frombuffer(body, "<i8", docs)
        lengths = np.frombuffer(body, "<u4", docs, 8 * docs)
        null = body[12 * docs : 13 * docs]
        states = np.frombuffer(body, "<u8", lanes, 13 * docs)
        words = np.frombuffer(body, "<u4", n_words, 13 * docs + 8 * lanes)
        ids = self.decode(n, lanes, states, words)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("decoded ids do not match their checksum")
        return [None if z else int(d) for d, z in zip(names, null, strict=True)], lengths, ids


def _tokenised(docs: DataFrame, tokenizer: str, end_id: int, parts: int) -> DataFrame:
    """Ids by document in ascending order; the last row of a part has its counts instead."""

    def run(batches):
        part = TaskContext.get().partitionId()
        enc, tail, total, seq, first = encoder(tokenizer), np.array([end_id], "<u4"), np.zeros(0, np.int64), 0, 0

        def rows(doc, ids, n, counts=None):
            k = len(doc)
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * k, pa.int32()), pa.array(range(seq, seq + k), pa.int64()), pa.array(doc, pa.int64()), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(counts or [None] * k, pa.binary())],
                names=["part", "seq", "doc_id", "ids", "first", "counts"],
            )

        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1)
            for lo, hi in slices(texts):
                some = [np.concatenate((t, tail)) for t in enc.batch(texts[lo:hi])]
                c = np.bincount(np.concatenate(some))
                if len(c) > len(total):
                    total = np.concatenate((total, np.zeros(len(c) - len(total), np.int64)))
                total[: len(c)] += c
                firsts = []
                for t in some:
                    firsts.append(first)
                    first += len(t)
                yield rows(names[lo:hi], [t.astype("<u2" if t.max() < 65536 else "<u4").tobytes() + (b"" if t.max() < 65536 else b"\0") for t in some], firsts)
                seq += hi - lo
        if first:
            yield rows([None], [None], [first], [total.astype("<i8").tobytes()])

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(parts, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, "part int, seq long, doc_id long, ids binary, first long, counts binary")


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2").astype(np.uint32) if len(raw) % 2 == 0 else np.frombuffer(raw[:-1], "<u4")


def _summed(batches):
    total = np.zeros(0, np.int64)
    for b in batches:
        for raw in b.column(0).to_pylist():
            c = np.frombuffer(raw, "<i8")
            if len(c) > len(total):
                c, total = total, c.copy()
            total[: len(c)] += c
    yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["counts"])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> tuple[DataFrame, np.ndarray]:
    """Write the corpus as token files; the manifest of their blocks and the frequency table."""
    spark = ship(docs.sparkSession)
    parts = shuffle_parts(spark)
    table = written(_tokenised(docs, tokenizer, end_id, parts), "tokens")
    spark.sparkContext._jvm.System.gc()  # lets the range shuffle of the texts go
    ends = table.where("counts is not null")
    # Tables of counts are added up in two streaming steps; the driver gets one.
    some = ends.select("counts").repartition(max(1, int(parts**0.5))).mapInArrow(_summed, "counts binary").repartition(1).mapInArrow(_summed, "counts binary")
    raw = [np.frombuffer(r[0], "<i8") for r in some.collect()]
    counts = max(raw, key=len, default=np.zeros(0, np.int64))
    freq = quantised(counts if len(counts) else np.ones(1, np.int64))
    bases, at = {}, 0
    for part, n in sorted((r[0], r[1]) for r in ends.select("part", "first").collect()):  # a row per file part
        bases[part] = at
        at += n
    make_dir(folder)
    shared = spark.sparkContext.broadcast((freq, bases))

    def run(batches):
        freq, bases = shared.value
        coder = Coder(freq)
        fs, root = fs_of(folder)
        path, out, at, found = f"{root}/tokens-{uuid.uuid4().hex}.slt", None, 0, []
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal out, at, held, size
            if not held:
                return
            if out is None:
                out = fs.open_output_stream(path, compression=None)
                out.write(MAGIC + struct.pack("<I", coder.crc))
                at = len(MAGIC) + 4
            raw = coder.block([h[1] for h in held], [len(h[2]) for h in held], np.concatenate([h[2] for h in held]))
            out.write(raw)
            found.append((path.rpartition("/")[2], at, len(raw), held[0][0], size, len(held)))
            at += len(raw)
            held, size = [], 0

        for b in batches:
            for part, doc, raw, first in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                start = bases[part] + first
                ids = _ids(raw)
                if held and (size + len(ids) > BLOCK or held[0][0] + size != start):
                    flush()
                held.append((start, doc, ids))
                size += len(ids)
        flush()
        if out is not None:
            out.close()
            cols = list(zip(*found, strict=True))
            kinds = (pa.string(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["file", "offset", "size", "start", "n_tokens", "n_docs"])

    manifest = written(table.where("counts is null").select("part", "doc_id", "ids", "first").mapInArrow(run, "file string, offset long, size long, start long, n_tokens long, n_docs long"), "manifest")
    discard(table)
    return manifest, freq


def read_tokens(manifest: DataFrame, freq: np.ndarray, folder: str) -> DataFrame:
    """Decode every block: one row per document with the place, number and checksum of its ids."""
    spark = ship(manifest.sparkSession)
    shared = spark.sparkContext.broadcast(freq)

    def run(batches):
        coder = Coder(shared.value)
        fs, root = fs_of(folder)
        name, src = None, None
        for b in batches:
            for file, at, size, start in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if file != name:
                    name, src = file, fs.open_input_file(f"{root}/{file}")
                    if src.read_at(12, 0) != MAGIC + struct.pack("<I", coder.crc):
                        raise ValueError(f"{file} does not belong to this frequency table")
                docs, lengths, ids = coder.unblock(src.read_at(size, at))
                ends = np.cumsum(lengths.astype(np.int64))
                raw = ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(raw[4 * (z - n) : 4 * z]) for z, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = manifest.select("file", "offset", "size", "start").repartition(shuffle_parts(spark), "file", F.floor(F.col("offset") / (4 * BLOCK)))
    return blocks.sortWithinPartitions("file", "offset").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    folder = normal_uri(fresh_path(docs.sparkSession, "tokenfiles"))
    manifest, freq = write_tokens(docs, tokenizer, end_id, folder)
    return read_tokens(manifest, freq, folder)
