"""Periodic runs of words, by recursive frequency splitting.

A run is a stretch of words with smallest period q that spans at least ``repeats`` periods and ``least`` words and that
no neighbouring word extends. Each of its words occurs in it ``repeats`` times or more. So a word that occurs less often
in its segment, at first the whole text, is in no run and splits the segment; pieces under ``least`` words go, and the
rest are looked at again until nothing splits. When a segment splits, only its smaller pieces and the occurrences next
to theirs are looked at again, so the work stays near n log n words at any depth.

Segments that survive are scanned by lag, all of a block together. A run of lag q holds ``repeats`` multiples of q in a
row with the same word, so a lag looks at every q-th word only; places that pass are extended word by word. Short lags,
whose runs need ``least`` words anyway, are compared in full. Lags go up, and a place inside a run of a shorter
period is left out: by the theorem of Fine and Wilf its lag is a multiple of that period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siftline.llm.shared import ragged, slices, strings

LEAST, REPEATS = 24, 3
# Bytes of text whose words are held at once; a longer text is held alone.
BLOCK_BYTES = 4 << 20

RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def surviving(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments in which every word occurs ``repeats`` times. Equal codes are equal words."""
    n, starts, ends = len(codes), starts.copy(), ends.copy()
    order = np.argsort(codes, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    # The k-th stretch of ``repeats`` occurrences of one word, from first to last; -1 where there is none.
    first = np.full(n + 2 * repeats, -1)
    last = np.full(n + 2 * repeats, n)
    if n >= repeats:
        tail = order[repeats - 1 :]
        first[repeats : repeats + len(tail)] = np.where(codes[tail] == codes[order[: len(tail)]], order[: len(tail)], -1)
        last[repeats : repeats + len(tail)] = tail
    segment = np.repeat(np.where(ends - starts >= least, np.arange(len(starts)), -1), ends - starts)
    ends[ends - starts < least] = starts[ends - starts < least]
    check = np.flatnonzero(segment >= 0)
    while len(check):
        low, high, at = starts[segment[check]], ends[segment[check]], rank[check] + repeats
        often = np.zeros(len(check), bool)
        for t in range(repeats):
            often |= (first[at - t] >= low) & (last[at - t] < high)
        rare = check[~often]
        if not len(rare):
            break
        groups = np.flatnonzero(np.diff(segment[rare], prepend=-1))
        split, pieces = segment[rare[groups]], np.diff(np.append(groups, len(rare))) + 1
        owner = np.repeat(np.arange(len(split)), pieces)
        begin, end = np.sort(np.concatenate((starts[split], rare + 1))), np.sort(np.concatenate((rare, ends[split])))
        size = end - begin
        widest = np.flatnonzero(size == np.maximum.reduceat(size, np.cumsum(pieces) - pieces)[owner])
        widest = widest[np.unique(owner[widest], return_index=True)[1]]
        stays = size[widest] >= least
        starts[split], ends[split] = begin[widest], np.where(stays, end[widest], begin[widest])
        small = np.ones(len(size), bool)
        small[widest[stays]] = False
        small = np.flatnonzero(small)
        fresh = size[small] >= least
        names = np.where(fresh, len(starts) + np.cumsum(fresh) - 1, -1)
        starts = np.concatenate((starts, begin[small[fresh]]))
        ends = np.concatenate((ends, end[small[fresh]]))
        piece, place = ragged(size[small])
        moved = begin[small][piece] + place
        segment[moved], segment[rare] = names[piece], -1
        cut = rank[np.concatenate((moved, rare))]
        near = [order[np.clip(cut + t, 0, n - 1)] for t in range(1 - repeats, repeats) if t]
        check = np.unique(np.concatenate((moved, *near)))
        check = check[segment[check] >= 0]
    found = ends - starts >= least
    by = np.argsort(starts[found])
    return starts[found][by], ends[found][by]


def _same(words: np.ndarray, x: int, q: int, stop: int) -> int:
    """Number of words from ``x`` on that equal those ``q`` later, before ``stop``."""
    done, step = 0, 64
    while (size := min(step, stop - x - q - done)) > 0:
        a = x + done
        other = words[a : a + size] != words[a + q : a + q + size]
        if other.any():
            return done + int(other.argmax())
        done, step = done + size, 2 * step
    return done


def _same_before(words: np.ndarray, x: int, q: int, start: int) -> int:
    """Number of words right before ``x`` that equal those ``q`` later, from ``start`` on."""
    done, step = 0, 64
    while (size := min(step, x - start - done)) > 0:
        b = x - done
        other = words[b - size : b] != words[b - size + q : b + q]
        if other.any():
            return done + int(other[::-1].argmax())
        done, step = done + size, 2 * step
    return done


def lag_scan(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, repeats: int) -> np.ndarray:
    """Rows (start, length, period) of the runs inside the segments, by start and period."""
    by = np.argsort(starts - ends, kind="stable")
    starts, sizes = starts[by], (ends - starts)[by]
    segment, place = ragged(sizes)
    words, origin = codes[starts[segment] + place], np.cumsum(sizes) - sizes
    # For each word, the furthest end of the runs found so far that hold it.
    reach = np.zeros(len(words), np.int64)
    found = []

    def keep(start: int, stop: int, q: int) -> None:
        np.maximum(reach[start:stop], stop, out=reach[start:stop])
        g = segment[start]
        found.append((int(starts[g] + start - origin[g]), stop - start, q))

    q, many = 1, len(sizes)
    while True:
        need = max(least, repeats * q)
        while many and sizes[many - 1] < need:
            many -= 1
        if not many:
            break
        m = int(origin[many - 1] + sizes[many - 1])
        if repeats * q < least:
            same = (words[: m - q] == words[q:m]) & (segment[: m - q] == segment[q:m])
            edges = np.flatnonzero(np.diff(same.astype(np.int8), prepend=0, append=0))
            long = edges[1::2] - edges[::2] >= need - q
            for a, b in zip(edges[::2][long].tolist(), edges[1::2][long].tolist()):
                if reach[a] < b + q:
                    keep(a, b + q, q)
        else:
            marks = words[:m:q]
            equal = marks[1:] == marks[:-1]
            every = equal[: len(equal) - repeats + 2]
            for t in range(1, repeats - 1):
                every = every & equal[t : len(equal) - repeats + 2 + t]
            x = np.flatnonzero(every) * q
            if len(x):
                span = (repeats - 1) * q
                x = x[(segment[x] == segment[x + span]) & (reach[x] <= x + span)]
                for t in {min(1, q), q // 2, q - 1, min(2, q), q // 3, min(3, q)}:
                    x = x[words[x + t] == words[x + t + q]]
            for a in x.tolist():
                if reach[a] > a + span:
                    continue
                g = segment[a]
                stop = int(origin[g] + sizes[g])
                start = a - _same_before(words, a, q, int(origin[g]))
                end = a + _same(words, a, q, stop) + q
                if end > a + span and end - start >= need:
                    keep(start, end, q)
        q += 1
    rows = np.array(found, np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(texts: list[list[bytes]], least: int = LEAST, repeats: int = REPEATS) -> list[np.ndarray]:
    """For each list of words, its runs as rows (start, length, period)."""
    counts = np.array([len(words) for words in texts], np.int64)
    ends = np.cumsum(counts)
    starts = ends - counts
    codes = np.empty(int(counts.sum()), np.int64)
    for words, a, b in zip(texts, starts.tolist(), ends.tolist()):
        # A word's code is the place of its first occurrence, so words of two texts are never equal.
        codes[a:b] = list(map({}.setdefault, words, range(a, b)))
    rows = lag_scan(codes, *surviving(codes, starts, ends, least, repeats), least, repeats)
    text = np.searchsorted(ends, rows[:, 0], side="right")
    rows[:, 0] -= starts[text] if len(rows) else 0
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that stand in a run after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def with_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """Replace the text by ``runs`` (start, length, period in words, by start and period) and ``collapsed``: its words,
    joined by one blank, without those that a run repeats.

    A map over rows: nothing is shuffled, repeated rows and null ids are rows like others. Null and empty texts
    have no runs and an empty ``collapsed``; columns of these two names are replaced.
    """
    if repeats < 3:
        raise ValueError("repeats must be 3 or more")
    kept = [c for c in docs.columns if c not in (text_col, "runs", "collapsed")]
    schema = T.StructType([*docs.select(*kept).schema, T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    run = pa.struct([(name, pa.int64()) for name in RUN.names])

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for batch in slices(table, text_col, BLOCK_BYTES):
                texts = [text.split() for text in strings(batch.column(text_col))]
                found = runs_of(texts, least, repeats)
                rows = np.concatenate(found)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum([len(r) for r in found]))), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], fields=list(run)),
                )
                short = pa.array([b" ".join(collapsed(w, r)) for w, r in zip(texts, found)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists, short], names=[*kept, "runs", "collapsed"])

    return docs.select(*kept, text_col).mapInArrow(batches, schema)
