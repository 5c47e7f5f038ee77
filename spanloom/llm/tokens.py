"""Token ids of whole texts by a tokenizer file, each distinct chunk encoded once.

In the byte-level vocabularies used here a single space between two other
characters always starts a new pre-token, a single line feed between two others
is one, and so is a full stop or comma after a letter at a chunk's end.  A batch
is cut there and dictionary-encoded by Arrow.  Distinct chunks that the worker
does not remember are encoded by the tokenizers library: words of letters alone
are one pre-token and go to its model directly, others many at a time, parted
by a carriage return, which is a token of its own there.  Texts with
runs of white space, or with white space of another kind, go to the library whole.
"""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that one worker remembers: twice this at most, the older half goes first.
MEMO = 150_000

_ODD = "[\\x{0}\\x{1}\t\r\v\f\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|  | \n|\n |\n\n|^[ \n]|[ \n]$"
_PACK = [struct.Struct(f"<{n}I") for n in range(32)]
_LOADED: dict[str, "Encoder"] = {}


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + sizes[i]] of all i, one after another."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    at = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
    return flat[at]


def _expand(flat: np.ndarray, sizes: np.ndarray, indices: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace entries by their flat values and sum sizes over consecutive runs of n entries."""
    which = indices.to_numpy(zero_copy_only=False).astype(np.int64)
    each = sizes[which]
    sums = np.concatenate(([0], np.cumsum(each)))
    ends = np.cumsum(n)
    return ragged(flat, (np.cumsum(sizes) - sizes)[which], each), sums[ends] - sums[ends - n]


class Encoder:
    """Ids of texts as unsigned 32-bit arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        mark = self.tok.encode("a\r b", add_special_tokens=False).ids
        alone = self.tok.encode("\r", add_special_tokens=False).ids
        parts = [self.tok.encode(x, add_special_tokens=False).ids for x in ("a", " b")]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}
        probe = [" " + x for x in ("word", "Élève", "ñandú", "straße", "слово", "字")] + ["Word", "é"]
        try:
            self.direct = [self._model(x) for x in probe] == [x.tobytes() for x in self.whole(probe)]
        except Exception:  # noqa: BLE001  another kind of model: everything is encoded in lots
            self.direct = False
        self.mark = alone[0] if len(alone) == 1 and mark == parts[0] + alone + parts[1] else None

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, word: str) -> bytes:
        """Ids of one pre-token."""
        shown = "\u0120" + word[1:] if word.isascii() and word[:1] == " " else word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.tok.model.tokenize(shown)], "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """No chunk starts with white space before other than one space, so marks stay apart."""
        if self.direct:
            tokenize, letters, now, pack = self.tok.model.tokenize, self.letters, self.now, _PACK
            rest = []
            for w in new:
                if w.isalpha() or w[:1] == " " and w[1:].isalpha():
                    shown = "\u0120" + w[1:] if w.isascii() and w[0] == " " else w.encode().decode("latin-1").translate(letters)
                    ids = [t.id for t in tokenize(shown)]
                    now[w] = pack[len(ids)].pack(*ids) if len(ids) < 32 else np.array(ids, "<u4").tobytes()
                else:
                    rest.append(w)
            new = rest
        step = 256
        lots = [new[k : k + step] for k in range(0, len(new), step)]
        for k in range(0, len(lots), 64):
            some = lots[k : k + 64]
            for lot, e in zip(some, self.tok.encode_batch_fast(["\r".join(x) for x in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                cut = np.flatnonzero(ids == self.mark)
                raw, at = ids.tobytes(), 0
                for c, z in zip(lot, [*cut.tolist(), len(ids)], strict=True):
                    self.now[c] = raw[4 * at : 4 * z]
                    at = z + 1

    def _chunks(self, words: list[str]) -> list[bytes]:
        if len(self.now) > MEMO:
            self.now, self.old = {}, self.now
        now, old = self.now, self.old
        unknown = [w for w in words if w not in now]
        now.update((w, old[w]) for w in unknown if w in old)
        new = [w for w in unknown if w not in now] if old else unknown
        if new:
            self._learn(new)
        return [now[w] for w in words]

    def batch(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null counts as the empty text."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        odd = pc.fill_null(pc.match_substring_regex(texts, _ODD), False).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero((size > 0) & ~odd) if self.mark is not None else np.zeros(0, np.int64)
        rest = np.flatnonzero((size > 0) & odd) if self.mark is not None else np.flatnonzero(size > 0)
        if len(rest):
            for i, ids in zip(rest.tolist(), self.whole(texts.take(pa.array(rest)).to_pylist()), strict=True):
                out[i] = ids
        if not len(plain):
            return out
        one = lambda x: pa.scalar(x, pa.large_string())
        # A first chunk has no space before it: it is marked.
        marked = pc.binary_join_element_wise(one("\x01"), texts if len(plain) == len(texts) else texts.take(pa.array(plain)), one(""))
        lists = pc.split_pattern(marked, " ")
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(lists.flatten())
        del lists, marked
        spaced = pc.binary_join_element_wise(one(" "), coded.dictionary, one(""))
        spaced = pc.replace_substring(spaced, " \x01", "")
        cut = pc.replace_substring_regex(spaced, r"(\pL)([.,]?)\n", "\\1\x00\\2\x00\n\x00")
        cut = pc.replace_substring_regex(cut, r"(\pL)([.,])$", "\\1\x00\\2")
        parts = pc.split_pattern(cut, "\x00")
        n_parts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded_parts = pc.dictionary_encode(parts.flatten())
        raws = self._chunks(coded_parts.dictionary.to_pylist())
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        flat = np.frombuffer(b"".join(raws), "<u4")
        del raws, parts, cut, spaced
        # Ids of the distinct chunks, then of all chunks in order.
        flat, sizes = _expand(flat, sizes, coded_parts.indices, n_parts)
        flat, sizes = _expand(flat, sizes, coded.indices, n)
        ends = np.cumsum(sizes)
        for i, a, z in zip(plain.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
            out[i] = flat[a:z]
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file; loaded once."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def slices(texts: pa.Array | list[str | None], most: int = 1 << 23):
    """Index ranges of at most so many bytes or characters (or one text) each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist() if isinstance(texts, pa.Array) else [len(t or "") for t in texts]
    at = size = 0
    for i, n in enumerate(sizes):
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(sizes):
        yield at, len(sizes)
