"""Column functions over nucleotide strings.

Single symbols are counted by string arithmetic (replace and length), base pairs by batches. Values used more than once are
bound by a one-element ``transform``, so each string operation runs once per read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASES = "ACGT"


def _bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``."""
    return F.transform(F.array(value), use)[0]


def _without(seq: Column, token: str) -> Column:
    return F.replace(seq, F.lit(token), F.lit(""))


def n_count(seq: Column) -> Column:
    return F.length(seq) - F.length(_without(_without(seq, "N"), "n"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


# Bytes as 0 to 3 for the bases of either case, 4 for all others.
_CODES = np.full(256, 4, np.uint8)
for _i, _base in enumerate(BASES):
    _CODES[[ord(_base), ord(_base.lower())]] = _i


def dimer_entropies(sequences: pa.Array) -> pa.Array:
    """Bits of each string's overlapping base pairs, all strings of a batch counted at once."""
    sequences = sequences.cast(pa.large_binary())
    offsets = np.frombuffer(sequences.buffers()[1], np.int64)[sequences.offset : sequences.offset + len(sequences) + 1]
    data = np.frombuffer(sequences.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    codes, sizes = _CODES[data], np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    pairs = (codes[:-1] < 4) & (codes[1:] < 4) & (row[:-1] == row[1:])
    place = row[:-1][pairs] * 16 + codes[:-1][pairs] * 4 + codes[1:][pairs]
    counts = np.bincount(place, minlength=16 * len(sizes)).reshape(-1, 16)
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    bits = -(share * np.log2(np.where(counts > 0, share, 1.0))).sum(axis=1)
    return pa.array(bits + 0.0, mask=sequences.is_null().to_numpy(zero_copy_only=False))


_entropy_udf = F.arrow_udf(dimer_entropies, T.DoubleType())


def entropy_2mer(seq: Column) -> Column:
    """Shannon entropy in bits of the base pairs; windows with other symbols are ignored.

    An Arrow batch is counted by numpy: the same count by string functions, some 25 of them a read, takes several times as long.
    """
    return _entropy_udf(seq)


def _entropy_term(count: Column, total: Column) -> Column:
    share = count / total
    return F.when(count > 0, -share * F.log2(share)).otherwise(0.0)


def fast_low_complexity(seq: Column) -> Column:
    """Entropy of homopolymers and strict two-base alternations; null when undecided."""
    return _bind(F.upper(seq), _fast_low_complexity)


def _fast_low_complexity(bases: Column) -> Column:
    size = F.length(bases)
    first, second = F.substring(bases, 1, 1), F.substring(bases, 2, 1)
    known = list(BASES)
    homopolymer = first.isin(known) & (bases == F.repeat(first, size))
    period = F.repeat(F.concat(first, second), F.ceil(size / 2).cast("int"))
    alternating = (
        first.isin(known)
        & second.isin(known)
        & (first != second)
        & (bases == F.substring(period, F.lit(1), size))
    )
    pairs = (size - 1).cast("double")
    left, right = F.ceil(pairs / 2).cast("double"), F.floor(pairs / 2).cast("double")
    return F.when(homopolymer, 0.0).when(
        alternating, _entropy_term(left, pairs) + _entropy_term(right, pairs)
    )


# K-mers that fit a long at two bits a base.
LONGEST_CODE = 31


def _kmer_codes(sequences: pa.Array, k: int, reverse: bool) -> pa.Array:
    sequences = sequences.cast(pa.large_binary())
    offsets = np.frombuffer(sequences.buffers()[1], np.int64)[sequences.offset : sequences.offset + len(sequences) + 1]
    data = np.frombuffer(sequences.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    # Places are counted in characters: of a character of several bytes, only the first stays.
    heads = (data & 0xC0) != 0x80
    ends = np.concatenate(([0], np.cumsum(heads)))[offsets - offsets[0]]
    bases = _CODES[data[heads]]
    counts = np.maximum(np.diff(ends) - k + 1, 0)
    starts = np.concatenate(([0], np.cumsum(counts)))
    place = np.arange(starts[-1]) + np.repeat(ends[:-1] - starts[:-1], counts)
    odd = np.concatenate(([0], np.cumsum(bases > 3)))
    code = base = (bases & 3).astype(np.int64) ^ (3 if reverse else 0)
    size = 1
    joined = lambda a, b, n, m: a | b << 2 * n if reverse else a << 2 * m | b
    for bit in bin(k)[3:]:
        code, size = joined(code[:-size], code[size:], size, size), 2 * size
        if bit == "1":
            code, size = joined(code[:-1], base[size:], size, 1), size + 1
    codes = pa.array(code[place] if len(place) else np.zeros(0, np.int64), mask=odd[place + k] != odd[place])
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), codes)


def kmer_codes(seq: Column, k: int, reverse: bool = False) -> Column:
    """The k-mers of a string by place, or their reverse complements, as longs of two bits a base; null where one has another symbol.

    Both cases of a base are one. Strings shorter than k, and null, have none.
    """
    if not 1 <= k <= LONGEST_CODE:
        raise ValueError(f"k-mers of 1 to {LONGEST_CODE} bases have codes")
    return F.arrow_udf(lambda sequences: _kmer_codes(sequences, k, reverse), T.ArrayType(T.LongType()))(seq)
