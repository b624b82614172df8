"""Word spans and 64-bit hashes of many texts at once, on their UTF-8 bytes.

Byte classes are exact for word patterns that treat all non-ASCII code points alike, as UTF-8 gives those
only bytes from 0x80 on.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
NONE = U(0xFFFFFFFFFFFFFFFF)

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and whatever is not ASCII.
LOWER_ALNUM = np.zeros(256, bool)
LOWER_ALNUM[0x30:0x3A] = LOWER_ALNUM[0x61:0x7B] = LOWER_ALNUM[0x80:] = True
#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[0x20] = NOT_SPACE[0x09:0x0E] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes that are hashed at once, so that the wide numbers take a bounded place beside a long text.
PIECE = 1 << 20


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    made = []
    for b in (BASE, INVERSE):
        x = np.full(n, b, U)
        x[0] = 1
        made.append(np.cumprod(x, dtype=U))
    return made[0], made[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def joined(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the place where each text begins (one more for the end)."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return (LOWER[data] if lower else data), offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; words end where a text does."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = kind[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    fresh[n] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | fresh[:n]))
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, "right")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word, the same wherever it stands; pieces of the bytes one after the other."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        if ends[to - 1] - base > PIECE:
            out[at] = long_hash(data[base : ends[at]])
        else:
            up, down = powers(PIECE + 1)
            part = data[base : ends[to - 1]]
            sums = np.zeros(len(part) + 1, U)
            np.cumsum((part.astype(U) + U(1)) * up[: len(part)], out=sums[1:])
            a, b = starts[at:to] - base, ends[at:to] - base
            out[at:to] = mix((sums[b] - sums[a]) * down[a] ^ (b - a).astype(U))
        at = to
    return out


def long_hash(word: np.ndarray) -> np.uint64:
    """The hash of one word of any length."""
    total, factor = 0, 1
    up = powers(PIECE + 1)[0]
    for a in range(0, len(word), PIECE):
        part = word[a : a + PIECE]
        total += int(((part.astype(U) + U(1)) * up[: len(part)]).sum(dtype=U)) * factor
        factor = factor * int(up[PIECE]) & ((1 << 64) - 1)
    return mix(np.array([(total & ((1 << 64) - 1)) ^ len(word)], U))[0]


def gram_hashes(words: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; NONE where they don't lie in one text."""
    out = np.full(len(words), NONE, U)
    n = len(words) - k + 1
    if n <= 0:
        return out
    total = np.zeros(n, U)
    for j in range(k):
        total = total * U(BASE) + words[j : j + n]
    total = mix(total)
    total[total == NONE] = 0
    out[:n] = np.where(text[:n] == text[k - 1 :], total, NONE)
    return out
