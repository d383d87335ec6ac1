"""Texts as arrays: word boundaries and 64-bit word hashes of a batch, computed on bytes without a loop over words."""

from __future__ import annotations

import functools

import numpy as np

SPACES = (0x20, 9, 10, 11, 12, 13)
#: Bytes hashed at once; a longer word is a block of its own.
BLOCK = 1 << 19


@functools.cache
def word_table() -> np.ndarray:
    """Bytes by class: 0 white space, 1 everything else."""
    table = np.ones(256, np.uint8)
    table[list(SPACES)] = 0
    return table


@functools.cache
def punct_table() -> np.ndarray:
    """Bytes by class: 0 white space and controls, 1 letters, digits, underscore and all of non-ASCII, 2 other ASCII."""
    table = np.full(256, 2, np.uint8)
    table[:33] = 0
    for b in range(256):
        if b >= 128 or chr(b).isalnum() or b == 95:
            table[b] = 1
    return table


@functools.cache
def _fold() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


@functools.cache
def _random_bytes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 2**64)
    up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lay_out(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, A-Z in lower case, a newline after each; the offset of each text and of the end."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    parts.append(b"")
    return _fold()[np.frombuffer(b"\n".join(parts), np.uint8)], offsets


def spans(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one class other than 0."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = table[data]
    bounds = np.concatenate(([0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, [len(data)]))
    keep = kinds[bounds[:-1]] != 0
    return bounds[:-1][keep], bounds[1:][keep]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 7) -> np.ndarray:
    """64-bit hashes of data[start:end] for ascending, disjoint spans."""
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    random = _random_bytes(seed)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        first, last = int(starts[i]), int(ends[j - 1])
        size = last - first
        up, down = _powers(BLOCK if size <= BLOCK else 1 << (size - 1).bit_length())
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(random[data[first:last]] * up[:size], out=sums[1:])
        a, b = starts[i:j] - first, ends[i:j] - first
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of the text that each span lies in."""
    return np.searchsorted(offsets, starts, "right") - 1
