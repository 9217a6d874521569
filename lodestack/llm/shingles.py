"""Sets of hashed word shingles for a whole Arrow batch at a time, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lodestack.llm.common import flat_text, mix64

LOWER = np.arange(256, dtype="uint8")
LOWER[ord("A") : ord("Z") + 1] += 32
BREAK = np.zeros(256, bool)
BREAK[[9, 10, 11, 12, 13, 32]] = True
STEP = 0x9E3779B97F4A7C15
#: A random value for each byte, and an odd factor for each place in a shingle, from one rule.
BYTES = mix64(np.arange(1, 257, dtype="uint64") * np.uint64(STEP))
PLACES = mix64(np.arange(1001, 1101, dtype="uint64") * np.uint64(STEP)) | np.uint64(1)


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (bytes but white space, A-Z lower-cased) of all texts, and the offsets of each text."""
    data, bounds = flat_text(text)
    n = len(data)
    if not n:
        return np.zeros(0, "uint64"), np.zeros(len(bounds), "int64")
    data = LOWER[data]
    solid = ~BREAK[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    first[inner], last[inner - 1] = solid[inner], solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    # A word's hash is its part of a running polynomial over the bytes, shifted back to the word's start.
    powers = np.full(n, STEP | 1, "uint64")
    powers[0] = 1
    powers = np.cumprod(powers, dtype="uint64")
    upto = np.zeros(n + 1, "uint64")
    np.cumsum(BYTES[data] * powers, out=upto[1:])
    back = np.full(n, pow(STEP | 1, -1, 1 << 64), "uint64")
    back[0] = 1
    back = np.cumprod(back, dtype="uint64")
    value = (upto[end] - upto[start]) * back[start]
    return mix64(value + (end - start).astype("uint64") * np.uint64(STEP)), np.searchsorted(start, bounds)


def shingle_sets(text: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text as uint64, and their offsets. Fewer words than that make one shingle, none an empty set."""
    hashes, bounds = word_hashes(text)
    counts = np.diff(bounds)
    total = len(hashes)
    value, owner = np.zeros(0, "uint64"), np.zeros(0, "int64")
    row = np.repeat(np.arange(len(counts)), counts)
    if total >= words:
        m = total - words + 1
        value = np.zeros(m, "uint64")
        for k in range(words):
            value += hashes[k : k + m] * PLACES[k]
        same = row[:m] == row[words - 1 :]
        value, owner = mix64(value[same]), row[:m][same]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        extra = np.array([sum(int(hashes[bounds[i] + k]) * int(PLACES[k]) for k in range(counts[i])) + int(counts[i]) * STEP & (1 << 64) - 1 for i in short], "uint64")
        value, owner = np.concatenate([value, mix64(extra)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    at = np.searchsorted(owner, np.arange(len(counts) + 1))
    sort_rows(value, at)
    if len(value):
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[fresh], owner[fresh]
        at = np.searchsorted(owner, np.arange(len(counts) + 1))
    return value, at


def sort_rows(value: np.ndarray, at: np.ndarray) -> None:
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        value[a:b].sort()


def fingerprints(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash of each set (int64), from its size and two sums of its mixed elements; 0 for the empty set."""
    n = np.diff(at)
    out = n.astype("uint64") * np.uint64(STEP)
    for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        sums = np.zeros(len(value) + 1, "uint64")
        np.cumsum(mix64(value ^ np.uint64(salt)), out=sums[1:])
        out = mix64(out + (sums[at[1:]] - sums[at[:-1]]) * PLACES[k])
    return np.where(n > 0, out, np.uint64(0)).view("int64")
