"""Hashes of words over whole Arrow batches: A-Z lower-cased, words are runs of ``[^\\x20\\x09-\\x0D]``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        grown = np.full(max(64, 1 << (n - 1).bit_length()), _BASE, np.uint64)
        grown[0] = 1
        _POWERS = np.cumprod(grown)
    return _POWERS


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, where each text's words begin, with the end). Nulls have no words."""
    n = len(texts)
    if n == 0 or texts.nbytes == 0:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.zeros(0, np.uint8)
    off = off - off[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = ~_BLANK[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = off[:-1][off[:-1] < off[1:]]
    begins[edges] = word[edges]
    at = np.flatnonzero(word)
    starts = np.flatnonzero(begins[at])
    counts = np.concatenate([[0], np.cumsum(begins)])
    where = counts[off]
    if not len(starts):
        return np.zeros(0, np.uint64), where
    lengths = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    value = (_FOLD[raw[at]].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(value, starts) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), where


def words(text: str) -> list[bytes]:
    """The words themselves; bytes.split takes the same blanks."""
    return text.encode().translate(_FOLD.tobytes()).split()
