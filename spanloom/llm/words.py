"""Vectorised word and shingle hashes over batches of texts.

A word is a maximal run of ASCII letters or digits and of non-ASCII characters
other than Latin-1, general and CJK punctuation, in lower case.  Hashes are 64
bits: a polynomial over randomised byte values, then a finaliser.  Texts are
handled in pieces of about PIECE characters that end between words, so memory
does not grow with a text's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

PIECE = 1 << 18
SHINGLE = 5

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_ODD_PUNCT = re.compile("[\\u0080-\\u00a9\\u00ab-\\u00b4\\u00b6-\\u00b9\\u00bb-\\u00bf\\u2000-\\u206f\\u3000-\\u303f\\ufeff]")
_SPACE = re.compile(r"\s")

_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _r in (b"09", b"AZ", b"az"):
    _WORD[_r[0] : _r[1] + 1] = True


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_MULT))
_POW: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_MULT, -1, 1 << 64)
        _POW[:] = [np.cumprod(np.concatenate((np.ones(1, _U), np.full(size - 1, b, _U))), dtype=_U) for b in (_MULT, inverse)]
    return _POW[0][:n], _POW[1][:n]


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash gets the hash of any span of b."""
    out = np.zeros(len(b) + 1, _U)
    np.cumsum(_BYTE[b] * powers(len(b))[0], dtype=_U, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def lowered(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = _ODD_PUNCT.sub(" ", text)
    return text


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and where words start and end in them."""
    b = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate(([0], _WORD[b].view(np.int8), [0])))
    return b, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def pieces(text: str) -> Iterator[str]:
    """Pieces of a text that end before white space."""
    at, n = 0, len(text)
    while n - at > PIECE:
        m = _SPACE.search(text, at + PIECE)
        cut = m.start() if m else n
        yield text[at:cut]
        at = cut
    yield text[at:]


def hashes_of(low: str) -> np.ndarray:
    """Word hashes of one lowered text."""
    out = []
    for part in pieces(low):
        b, s, e = word_spans(part.encode("utf-8", "replace"))
        if len(s):
            out.append(mix(span_hash(prefix_hash(b), s, e) ^ (e - s).astype(_U)))
    return np.concatenate(out) if out else np.zeros(0, _U)


def batch_word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of each text; null gives none.  Short texts share one pass."""
    out: list[np.ndarray] = [np.zeros(0, _U)] * len(texts)
    group: list[int] = []
    lows: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not group:
            return
        raws = [x.encode("utf-8", "replace") for x in lows]
        b, s, e = word_spans(b"\n".join(raws))
        h = mix(span_hash(prefix_hash(b), s, e) ^ (e - s).astype(_U)) if len(s) else np.zeros(0, _U)
        ends = np.cumsum([len(r) + 1 for r in raws])
        cut = np.searchsorted(s, ends)
        for i, a, z in zip(group, np.concatenate(([0], cut[:-1])), cut, strict=True):
            out[i] = h[a:z]
        group.clear()
        lows.clear()
        size = 0

    for i, t in enumerate(texts):
        if not t:
            continue
        low = lowered(t)
        if len(low) > PIECE // 2:
            out[i] = hashes_of(low)
            continue
        group.append(i)
        lows.append(low)
        size += len(low)
        if size > PIECE:
            flush()
    flush()
    return out


def shingle_hashes(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of n words; a text of 1 to n-1 words is one run."""
    if not len(words):
        return words
    n = min(n, len(words))
    m = len(words) - n + 1
    acc = np.full(m, n, _U)
    for j in range(n):
        acc = acc * _U(0x9FB21C651E98DF25) + words[j : j + m]
    return mix(acc)
