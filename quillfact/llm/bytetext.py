"""Numpy helpers over a batch of texts held as one byte buffer; they run inside tasks only."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240607))
#: One random 64-bit value for each byte, and an odd base with its inverse modulo 2**64.
BYTE_KEYS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Multipliers by which the words of a shingle are added up.
SHINGLE_KEYS = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Powers that a worker keeps between tasks; a very long text makes more for itself.
KEPT_POWERS = 1 << 20
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_powers = np.ones(1, np.uint64)
_unpowers = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _unpowers
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        steps = np.full(size, BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
        steps[1:] = UNBASE
        _unpowers = np.multiply.accumulate(steps)
    return _powers[:n], _unpowers[:n]


def release() -> None:
    """Give freed memory back to the system: a worker lives on between tasks, beside those of other stages."""
    global _powers, _unpowers
    if len(_powers) > KEPT_POWERS:
        _powers, _unpowers = np.ones(1, np.uint64), np.ones(1, np.uint64)
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * MIX
    x ^= x >> np.uint64(29)
    x *= BASE
    return x ^ (x >> np.uint64(32))


def running(buf: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] the polynomial sum of bytes i..j-1, scaled by BASE**i."""
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_KEYS[buf] * powers(len(buf))[0], out=out[1:])
    return out


def hashes(run: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each buffer[start:end]; equal bytes give equal hashes wherever they lie."""
    return mixed((run[ends] - run[starts]) * powers(len(run))[1][starts] + (ends - starts).astype(np.uint64))


def joined(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bodies joined by line feeds, lower-cased in A-Z, and where each begins (one more entry for the end)."""
    buf = np.frombuffer(b"\n".join(bodies).lower() + b"\n", np.uint8)
    begins = np.zeros(len(bodies) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in bodies], out=begins[1:])
    return buf, begins


def words(buf: np.ndarray, begins: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that is_word marks), and the first word of each body."""
    edge = np.flatnonzero(np.diff(is_word[buf].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    return starts, ends, np.searchsorted(starts, begins)


def word_bytes(outside) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(outside)] = False
    return out


#: Words between white space, and words of letters, digits and all non-ASCII characters.
SPACED = word_bytes([0x20, *range(0x09, 0x0E)])
ALNUM = word_bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def chunks(batches, columns: int, most_bytes: int = 4_000_000):
    """Lists of the columns (the last one the text as bytes) of up to about most_bytes of text at a time."""
    held, size = [[] for _ in range(columns)], 0
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(columns)]
        for row in zip(*cols, strict=True):
            for out, value in zip(held, row, strict=True):
                out.append(value)
            size += len(row[-1])
            if size >= most_bytes:
                yield held
                held, size = [[] for _ in range(columns)], 0
    if held[0]:
        yield held
    held = None
    release()
