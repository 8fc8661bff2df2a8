"""Words of many texts as arrays of 64-bit hashes, without a loop over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes that are hashed at once; longer texts are cut at white space, a longer word is hashed alone.
CHUNK = 1 << 19
#: Bytes of a word that are mixed eight at a time; longer words get a digest.
LANES = 64
#: Powers that a Python worker keeps for each base.
_KEPT = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLANKS = [b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"]
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_CODE = mixed(np.arange(1, 257, dtype=np.uint64)) | _U(1)


def _made_powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * _U(pow(base, done, 1 << 64))
        done += more
    return out


_kept_powers = lru_cache(maxsize=4)(_made_powers)


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers; a worker keeps at most ``_KEPT`` of a base."""
    if n > _KEPT:
        return _made_powers(base, n)
    return _kept_powers(base, 1 << max(16, int(n).bit_length()))[:n] if n < _KEPT else _kept_powers(base, _KEPT)


def _cuts(text: bytes) -> Iterator[bytes]:
    """A text in pieces of CHUNK bytes at most, cut at white space; a longer word is a piece."""
    at = 0
    while len(text) - at > CHUNK:
        end = max(text.rfind(b, at, at + CHUNK) for b in _BLANKS)
        if end <= at:
            after = [e for b in _BLANKS if (e := text.find(b, at + 1)) > 0]
            end = min(after, default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]


def hashed_words(texts: list[bytes], lower: bool = False, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes that are no ASCII white space) of all texts, and where each text's begin.

    ``lower`` lower-cases A-Z first; ``first`` takes only so many bytes of each word. A word's hash depends on nothing around it: eight bytes
    after eight are mixed into its length, and words of over LANES bytes are a BLAKE2b digest. (Polynomials modulo 2**64
    won't do: they don't tell the patterns of Thue and Morse from their complements.)
    """
    parts, counts = [], np.zeros(len(texts), np.int64)
    group, owners, size = [], [], 0

    def flush():
        nonlocal group, owners, size
        if group:
            words, n = _hashed(group, lower, first)
            parts.append(words)
            np.add.at(counts, owners, n)
        group, owners, size = [], [], 0

    for i, t in enumerate(texts):
        for piece in _cuts(t) if len(t) > CHUNK else (t,):
            if size + len(piece) > CHUNK:
                flush()
            group.append(piece)
            owners.append(i)
            size += len(piece) + 1
    flush()
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=starts[1:])
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), starts


def _hashed(texts: list[bytes], lower: bool, first: int | None) -> tuple[np.ndarray, np.ndarray]:
    joined = b" ".join(texts) + b" " * 9
    joined = joined.translate(_LOWER) if lower else joined
    raw = np.frombuffer(joined, np.uint8)
    start, end = word_edges(raw[:-8])
    ends = np.cumsum([len(t) + 1 for t in texts])
    if first is not None:
        end = np.minimum(end, start + first)
    eights = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    size = end - start
    words = mixed(size.astype(np.uint64) * np.uint64(_BASE))
    at = np.flatnonzero(size <= LANES)
    done = 0
    while len(at):
        lane = eights[start[at] + done] & _MASK[np.minimum(size[at] - done, 8)]
        words[at] = mixed((words[at] ^ lane) * np.uint64(_BASE))
        done += 8
        at = at[size[at] > done]
    for k in np.flatnonzero(size > LANES):
        words[k] = int.from_bytes(hashlib.blake2b(joined[start[k] : end[k]], digest_size=8).digest(), "little")
    return words, np.diff(np.searchsorted(start, ends), prepend=0)


def word_edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text that ends with white space begin and end."""
    edge = np.diff(_SPACE[raw].view(np.int8), prepend=np.int8(1))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
