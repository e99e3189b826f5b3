"""Benchmark decontamination with a generalised suffix automaton over words.

The normalised test items make one automaton, whose letters are words. Documents stream through it; at each word the
walk holds the longest run of words, ending there, that some item contains. Where that run has ``window`` words or
more, its words are hit, and the state that stands for its last ``window`` words names the items that hold that
window. Items shorter than a window count only whole: their end states lie on the suffix path.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.shared import new_folder, strings, written

WINDOW = 10
# Words and bytes of items in one automaton; more items make more automata, and documents meet each in turn.
AUTOMATON_WORDS, AUTOMATON_BYTES = 200_000, 8 << 20
# Bytes of documents that meet several automata in turn; each automaton is built once for so many.
BLOCK_BYTES = 32 << 20
# A document whose words are hit in at least this share goes; else its hit spans go.
COVERAGE = 0.5

_KEPT = [chr(b).lower().encode("latin-1")[0] if 65 <= b <= 90 else b for b in range(256)]
_WORDS = bytes(k if b >= 128 or chr(k).isalnum() else 32 for b, k in enumerate(_KEPT))


def words_of(text: bytes) -> list[bytes]:
    """ASCII letters in lower case, digits and all that is not ASCII, in runs."""
    return text.translate(_WORDS).split()


class Automaton:
    """Generalised suffix automaton of items, each a list of words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.names = [name for name, _words in items]
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        ends: list[set[int]] = [set()]
        self._ends = ends
        whole: dict[int, set[int]] = {}
        self.shortest = window
        for number, (_name, words) in enumerate(items):
            if not words:
                continue
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            self.shortest = min(self.shortest, len(codes))
            last = 0
            for code in codes:
                last = self._extend(last, code)
                ends[last].add(number)
            if len(codes) < window:
                whole.setdefault(last, set()).add(number)
        order = sorted(range(1, len(self.next)), key=self.longest.__getitem__, reverse=True)
        for state in order:
            if self.longest[state] >= window and self.link[state] > 0:
                ends[self.link[state]] |= ends[state]
        # Of each state: the state of its last ``window`` words (or -1), and the short items that end there, by length.
        self.window_state = [-1] * len(self.next)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        sizes = {n: len(w) for n, (_x, w) in enumerate(items)}
        for state in reversed(order):
            up = self.link[state]
            if self.longest[state] >= window:
                self.window_state[state] = state if self.longest[up] < window else self.window_state[up]
            own = tuple((sizes[n], n) for n in sorted(whole.get(state, ())))
            self.short[state] = self.short[up] + own
        self.items_at = [frozenset(x) for x in ends]
        del self._ends

    def _extend(self, last: int, code: int) -> int:
        nexts, link, longest = self.next, self.link, self.longest
        if code in nexts[last]:
            there = nexts[last][code]
            return there if longest[there] == longest[last] + 1 else self._split(last, code, there)
        state = self._state({}, longest[last] + 1)
        at = last
        while at != -1 and code not in nexts[at]:
            nexts[at][code] = state
            at = link[at]
        if at == -1:
            link[state] = 0
        else:
            there = nexts[at][code]
            link[state] = there if longest[there] == longest[at] + 1 else self._split(at, code, there)
        return state

    def _state(self, nexts: dict[int, int], longest: int) -> int:
        self.next.append(nexts)
        self.longest.append(longest)
        self.link.append(0)
        self._ends.append(set())
        return len(self.next) - 1

    def _split(self, at: int, code: int, there: int) -> int:
        copy = self._state(dict(self.next[there]), self.longest[at] + 1)
        self.link[copy] = self.link[there]
        self.link[there] = copy
        while at != -1 and self.next[at].get(code) == there:
            self.next[at][code] = copy
            at = self.link[at]
        return copy

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the numbers of the items with an occurring window."""
        hit = np.zeros(len(words) + 1, np.int64)
        found: set[int] = set()
        get = self.vocabulary.get
        codes = np.array([get(w, 0) for w in words], np.int64)
        # Only runs of known words that are long enough for a window or a whole short item can match.
        known = np.concatenate(([0], (codes > 0).view(np.int8), [0]))
        edges = np.flatnonzero(np.diff(known))
        window = self.window
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if stop - start < self.shortest:
                continue
            state = length = 0
            seen = -1
            for i, code in enumerate(codes[start:stop].tolist(), start):
                there = self.next[state].get(code)
                while there is None:
                    state = self.link[state]
                    if state < 0:
                        break
                    length = self.longest[state]
                    there = self.next[state].get(code)
                if there is None:
                    state = length = 0
                    continue
                state, length = there, length + 1
                if length >= window:
                    hit[i + 1 - length] += 1
                    hit[i + 1] -= 1
                    at = self.window_state[state]
                    if at != seen:
                        found |= self.items_at[at]
                        seen = at
                for size, number in self.short[state]:
                    if size <= length:
                        hit[i + 1 - size] += 1
                        hit[i + 1] -= 1
                        found.add(number)
        return np.cumsum(hit[:-1]) > 0, found


@dataclass(frozen=True)
class Items:
    """Files of test items in the shared folder, each of which fits one automaton."""

    files: tuple[str, ...]


def bounded_items(
    items: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = AUTOMATON_WORDS, most_bytes: int = AUTOMATON_BYTES
) -> Items:
    """The items' words in files of at most ``most`` words and ``most_bytes`` bytes (or one item), dealt by hash.

    Only the files' names reach the driver. Null texts and texts without words go unread; null ids read as the word null;
    repeated items count once.
    """

    def worded(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            words = [words_of(t) for t in strings(batch.column(1))]
            columns = [batch.column(0), pa.array([b" ".join(w) for w in words], pa.binary()), pa.array([len(w) for w in words], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "words", "n"]).filter(pa.array([bool(w) for w in words]))

    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).cast("binary").alias("text"))
    known = written(named.filter("text IS NOT NULL").mapInArrow(worded, "id string, words binary, n long").distinct(), "item-words")
    n_words, n_bytes = known.agg(F.sum("n"), F.sum(F.length("words"))).first()
    groups = max(-(-(n_words or 0) // most), -(-(n_bytes or 0) // most_bytes), 1)
    folder = new_folder(items.sparkSession, "items")

    def files(table: pa.Table) -> pa.Table:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        cuts, held, size = [0], 0, 0
        for i, (words, n) in enumerate(zip(table.column("words").to_pylist(), table.column("n").to_pylist())):
            if i > cuts[-1] and (held + n > most or size + len(words) > most_bytes):
                cuts.append(i)
                held = size = 0
            held, size = held + n, size + len(words)
        names = [uuid.uuid4().hex for _ in cuts]
        for name, start, stop in zip(names, cuts, [*cuts[1:], len(table)]):
            pq.write_table(table.slice(start, stop - start).select(["id", "words"]), f"{path}/{name}.parquet", filesystem=store)
        return pa.table({"file": pa.array([f"{folder}/{name}.parquet" for name in names])})

    dealt = known.withColumn("_group", F.pmod(F.xxhash64("id", "words"), F.lit(groups)))
    return Items(tuple(sorted(r["file"] for r in dealt.groupBy("_group").applyInArrow(files, "file string").collect())))


_built: dict[tuple, Automaton] = {}


def automaton(file: str, window: int) -> Automaton:
    """Built once in each worker process, which holds one."""
    key = (file, window)
    if key not in _built:
        _built.clear()
        store, path = fs.FileSystem.from_uri(file)
        table = pq.read_table(path, filesystem=store)
        _built[key] = Automaton([(name, words.split(b" ")) for name, words in zip(table.column("id").to_pylist(), table.column("words").to_pylist())], window)
    return _built[key]


def blocks(tables: Iterator[pa.RecordBatch], groups: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches that meet the automata together; with one automaton, each batch alone."""
    held: list[pa.RecordBatch] = []
    for batch in tables:
        held.append(batch)
        if groups < 2 or sum(b.nbytes for b in held) >= BLOCK_BYTES:
            yield held
            held = []
    if held:
        yield held


def found_in(texts: list[bytes], files: tuple[str, ...], window: int) -> tuple[list[np.ndarray], list[set[str]]]:
    """Hit words and found items of each text, over the items of all files; one automaton is held at a time."""
    hits: list[np.ndarray] = [] if files else [np.zeros(len(words_of(t)), bool) for t in texts]
    names: list[set[str]] = [set() for _ in texts]
    for turn, file in enumerate(files):
        machine = automaton(file, window)
        for i, text in enumerate(texts):
            hit, numbers = machine.match(words_of(text))
            if turn:
                hits[i] |= hit
            else:
                hits.append(hit)
            names[i].update(machine.names[n] for n in numbers)
        # The next one is built after this one has gone.
        machine = None
    return hits, names


def matches(docs: DataFrame, items: Items, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, n_items, items array) of each row; null and empty texts have no words.

    One pass over the texts: each block of them meets the automata of all groups in turn.
    """
    files = items.files

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(tables, len(files)):
            old = [t for batch in block for t in strings(batch.column(1))]
            hits, names = found_in(old, files, window)
            at = 0
            for batch in block:
                own = slice(at, at + len(batch))
                at += len(batch)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array([len(h) for h in hits[own]], pa.int64()), pa.array([int(h.sum()) for h in hits[own]], pa.int64()),
                        pa.array([len(n) for n in names[own]], pa.int64()), pa.array([sorted(n) for n in names[own]], pa.list_(pa.string())),
                    ],
                    names=[id_col, "n_words", "n_hit", "n_items", "items"],
                )

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, n_hit long, n_items long, items array<string>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(batches, schema)


def cut(text: bytes, hit: np.ndarray) -> bytes:
    """``text`` without its hit words, each run of them replaced by a line end."""
    # Byte spans of the words, from the edges of runs that are not blank.
    solid = np.concatenate(([0], (np.frombuffer(text.translate(_WORDS), np.uint8) != 32).view(np.int8), [0]))
    edges = np.flatnonzero(np.diff(solid))
    starts, stops = edges[::2], edges[1::2]
    turns = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    parts, at = [], 0
    for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
        parts += (text[at : starts[a]], b"\n")
        at = int(stops[b - 1])
    return b"".join([*parts, text[at:]])


def cleaned(texts: list[bytes], files: tuple[str, ...], window: int, coverage: float) -> list[bytes | None]:
    """Each text without what items of any group hit; None where the share of all hit words reaches ``coverage``.

    What stands left and right of a gap may match across it, with items of any group, so the scan of all groups
    repeats until nothing is hit.
    """
    out: list[bytes | None] = list(texts)
    left, first = list(range(len(texts))), True
    while left:
        hits, _names = found_in([out[i] for i in left], files, window)
        again = []
        for i, hit in zip(left, hits):
            if not hit.any():
                continue
            if first and hit.mean() >= coverage:
                out[i] = None
            else:
                out[i] = cut(out[i], hit)
                again.append(i)
        left, first = again, False
    return out


def decontaminate(
    docs: DataFrame, items: Items, text_col: str = "text", chars_col: str | None = "n_chars", window: int = WINDOW,
    coverage: float = COVERAGE,
) -> DataFrame:
    """``docs`` with the words of every occurring window cut out; documents that are hit in ``coverage`` of their words go.

    Null and empty texts stay as they are. ``chars_col``, where there is one, becomes the length of the new text. How
    the items are grouped has no part in the result.
    """
    files = items.files

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(tables, len(files)):
            cleaned_texts = cleaned([t for batch in block for t in strings(batch.column(text_col))], files, window, coverage)
            at = 0
            for batch in block:
                new = cleaned_texts[at : at + len(batch)]
                at += len(batch)
                texts = batch.column(text_col)
                known, old = texts.is_valid().to_pylist(), strings(texts)
                columns = {name: batch.column(name) for name in batch.schema.names}
                as_text = [t.decode("utf-8", "replace") if t is not None and k else None for t, k in zip(new, known)]
                columns[text_col] = pa.array(as_text, pa.string())
                if chars_col in columns:
                    lengths = zip(columns[chars_col].to_pylist(), as_text, old, new)
                    columns[chars_col] = pa.array(
                        [v if t is None or a == b else len(t) for v, t, a, b in lengths], columns[chars_col].type
                    )
                kept = pa.array([t is not None for t in new])
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).filter(kept)

    return docs.mapInArrow(batches, docs.schema)
