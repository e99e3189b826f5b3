"""SipHash-c-d of strings, a batch at a time: the 64-bit keyed hash of add, rotate and xor rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The initial state, and the rotations of a round.
START = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _rounds(v: list[np.ndarray], times: int) -> list[np.ndarray]:
    a, b, c, d = v
    for _ in range(times):
        a, c = a + b, c + d
        b, d = _rotated(b, 13) ^ a, _rotated(d, 16) ^ c
        a = _rotated(a, 32)
        c, a = c + b, a + d
        b, d = _rotated(b, 17) ^ c, _rotated(d, 21) ^ a
        c = _rotated(c, 32)
    return [a, b, c, d]


def siphash(values: pa.Array, first: int | None = None, keys: tuple[int, int] = (0, 0), c: int = 1, d: int = 3) -> np.ndarray:
    """Unsigned hashes of byte strings; with ``first``, of that number's eight little-endian bytes and the string behind them.

    All strings advance together, eight bytes a step; those that have ended drop out, so memory follows the bytes of the batch.
    """
    values = values.cast(pa.large_binary())
    n = len(values)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer((values.buffers()[2] or b"") if n else b"", np.uint8)[: offsets[-1]]
    data = np.concatenate((data, np.zeros(8, np.uint8)))
    start, size = offsets[:-1], np.diff(offsets)
    state = np.empty((4, n), np.uint64)
    for i in range(4):
        state[i] = START[i] ^ keys[i % 2]

    def absorb(rows: np.ndarray, words: np.ndarray) -> None:
        v = [state[i, rows] for i in range(4)]
        v[3] = v[3] ^ words
        v = _rounds(v, c)
        v[0] = v[0] ^ words
        for i in range(4):
            state[i, rows] = v[i]

    def word(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(data[at[:, None] + np.arange(8)]).view(np.uint64).ravel()

    every = np.arange(n)
    if first is not None:
        absorb(every, np.full(n, first, np.uint64))
    rows, step = every[size >= 8], 0
    while len(rows):
        absorb(rows, word(rows, start[rows] + 8 * step))
        step += 1
        rows = rows[size[rows] >= 8 * (step + 1)]
    left = (size % 8).astype(np.uint64)
    tail = word(every, np.minimum(start + size - size % 8, len(data) - 8)) & ((np.uint64(1) << (left * np.uint64(8))) - np.uint64(1))
    total = (size + (0 if first is None else 8)).astype(np.uint64)
    absorb(every, tail | (total << np.uint64(56)))
    state[2] ^= np.uint64(0xFF)
    v = _rounds(list(state), d)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def siphash13_hex(seed: int, key: Column) -> Column:
    """SipHash-1-3 under a zero key of the seed as a 64-bit number and the key's bytes, as 16 hex digits: text order is unsigned order."""

    def spelled(keys: pa.Array) -> pa.Array:
        hashes = siphash(keys.cast(pa.large_binary()), seed & ((1 << 64) - 1))
        digits = hashes.astype(">u8").tobytes().hex()
        known = keys.is_valid().to_pylist()
        return pa.array([digits[16 * i : 16 * i + 16] if ok else None for i, ok in enumerate(known)], pa.string())

    return F.arrow_udf(spelled, T.StringType())(key)
