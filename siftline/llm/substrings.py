"""Substring dedup: passages of ``length`` words or more that an earlier document has, by prefix-partitioned suffix trees.

The trees hold the suffixes that begin at anchors: a window of ``length`` words has its anchor at its leftmost word
sequence of ``seed`` words of smallest hash, so equal windows have theirs at the same place, and no repeat is lost while
one word in twenty begins a suffix. Suffixes are partitioned by their first ``seed`` words. A prefix that only one
document has is dropped. Suffixes with the same words all around, as far as a window reaches (``length`` to the right,
``length - seed`` to the left), are one: the smallest id stands for them, and the others are repeats throughout. These
counts are combined before they move, so groups of copies and passages of any size come to one suffix.

What is left of a prefix, up to ``GROUP`` suffixes, fits a task, which sorts the suffixes to the right of their anchors
and the texts to the left of them. Neighbours' common lengths give the internal nodes of both trees: a window is a node of
the right tree, as deep as the window reaches beyond the anchor, with a node of the left tree. Where such a pair holds
a smaller id, the window is a repeat. Larger groups get longer prefixes: whole windows, each a deep node by itself, for
which only the smallest id counts, and that is an aggregate.

Words are compared by 64 bits of XXH64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.shared import matched, ragged, slices, strings, written

LENGTH, SEED = 50, 16
# Suffixes of one prefix that a task holds.
GROUP = 50_000
BLOCK_BYTES, ROWS_AT_ONCE = 4 << 20, 20_000
# Hashes of words kept by a task: so many, of words of so many bytes at most.
WORDS_KEPT, BYTES_KEPT = 200_000, 64

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Hashes(dict):
    """Word to hash, filled as words come."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word) - (1 << 63)
        if len(word) <= BYTES_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.array(list(map(self.__getitem__, words)), np.int64).view(np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


class Windows:
    """Hashes of any stretches of a sequence of word hashes."""

    def __init__(self, words: np.ndarray, factor: int):
        power = lambda f: np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(words), f, np.uint64))))
        self.back = power(pow(factor, -1, 1 << 64))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power(factor)[:-1])))

    def __call__(self, start: np.ndarray, size) -> np.ndarray:
        return _mixed((self.sums[start + size] - self.sums[start]) * self.back[start])


def anchors(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Text, place, prefix hash and hash of all that windows reach, for each anchor of the texts at ``starts``."""
    wide = length - seed + 1
    text, place = ragged(np.maximum(ends - starts - length + 1, 0))
    if not len(text):
        return (np.zeros(0, np.int64),) * 4
    prefix = Windows(words, _FACTORS[0])(np.arange(len(words) - seed + 1), seed)
    least, size = np.arange(len(prefix)), 1

    def smaller(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(prefix[a] <= prefix[b], a, b)

    while 2 * size <= wide:
        least, size = smaller(least[:-size], least[size:]), 2 * size
    first = starts[text] + place
    found = np.unique(smaller(least[first], least[first + wide - size]))
    text = np.searchsorted(ends, found, side="right")
    left = np.minimum(found - starts[text], length - seed)
    right = np.minimum(ends[text] - found, length)
    around = Windows(words, _FACTORS[1])(found - left, left + right) ^ _mixed((left * (length + 1) + right).astype(np.uint64))
    return text, found - starts[text], prefix[found].view(np.int64), around.view(np.int64)


def _nodes(rows: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of words below their prefix: the order, and the words that each shares with the row before (-1: no prefix)."""
    keys = np.ascontiguousarray(np.column_stack((prefix, rows)))
    order = np.argsort(keys.view(f"S{keys.shape[1] * 8}").ravel(), kind="stable")
    keys = keys[order]
    other = keys[1:] != keys[:-1]
    shared = np.where(other.any(axis=1), other.argmax(axis=1), keys.shape[1]) - 1
    return order, np.concatenate(([-1], shared))


def repeated_windows(prefix: np.ndarray, left: np.ndarray, right: np.ndarray, reach: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For suffixes of any prefixes, the windows that a smaller id has too, as bits: bit o is the window that begins o words before.

    ``left`` has the words before the anchor, nearest first, ``right`` those from it on, ``reach`` how many of both are there.
    """
    length, n = right.shape[1], len(prefix)
    down, up = _nodes(right, prefix), _nodes(left, prefix)
    node = np.empty((2, n), np.int64)
    found = np.zeros(n, np.int64)
    for o in range(left.shape[1] + 1):
        held = np.flatnonzero((reach[:, 0] >= o) & (reach[:, 1] >= length - o))
        for side, ((order, shared), depth) in enumerate(((down, length - o), (up, o))):
            node[side, order] = np.cumsum(shared < depth)
        code = node[0, held] * (n + 1) + node[1, held]
        by = np.argsort(code, kind="stable")
        if len(by):
            cuts = np.flatnonzero(np.diff(code[by], prepend=-1))
            least = np.minimum.reduceat(ids[held][by], cuts)
            sizes = np.diff(np.append(cuts, len(by)))
            found[held[by]] |= (ids[held][by] > np.repeat(least, sizes)).astype(np.int64) << o
    return found


def _each_text(tables: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for table in tables:
        for batch in slices(table, "content", BLOCK_BYTES):
            yield batch, [t.split() for t in strings(batch.column("content"))]


def _joined(hashes: Hashes, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(words) for words in texts])
    return np.concatenate([hashes.of(words) for words in texts]), ends - [len(words) for words in texts], ends


def anchor_table(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(id, key, place, prefix, around) of every anchor of ``docs`` (id, key, content)."""

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch, texts in _each_text(tables):
            text, *found = anchors(*_joined(hashes, texts), length, seed)
            text = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(text), batch.column("key").take(text), *map(pa.array, found)],
                names=["id", "key", "place", "prefix", "around"],
            )

    schema = T.StructType([*docs.select("id", "key").schema, *(T.StructField(c, T.LongType()) for c in ("place", "prefix", "around"))])
    return docs.select("id", "key", "content").mapInArrow(batches, schema)


def suffixes(texts: DataFrame, length: int, seed: int, crowded: bool) -> DataFrame:
    """Of ``texts`` (id, content, wanted: list of place, prefix, around, crowded) what their wanted suffixes need.

    Not crowded: (prefix, around, id, left, right, reach), the words' hashes around the anchor. Crowded: (prefix, around,
    id, o, one, two), two hashes of each window.
    """
    behind = length - seed

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch, texts in _each_text(tables):
            words, starts, ends = _joined(hashes, texts)
            lists = batch.column("wanted")
            wanted = lists.flatten()
            text, _place = ragged(np.diff(lists.offsets.to_numpy()))
            take = np.flatnonzero(wanted.field("crowded").to_numpy(zero_copy_only=False) == crowded)
            text, wanted = text[take], wanted.take(pa.array(take))
            at = starts[text] + wanted.field("place").to_numpy()
            left, right = np.minimum(at - starts[text], behind), np.minimum(ends[text] - at, length)
            if crowded:
                windows = [Windows(words, f) for f in _FACTORS]
                row, o = ragged(np.full(len(at), behind + 1))
                kept = (o <= left[row]) & (length - o <= right[row])
                row, o = row[kept], o[kept]
                own = [pa.array(o), *(pa.array(w(at[row] - o, length).view(np.int64)) for w in windows)]
                names = ["o", "one", "two"]
            else:
                row = np.arange(len(at))
                padded = np.concatenate((words, np.zeros(1, np.uint64)))
                offsets = np.arange(length)
                after = padded[np.where(offsets < right[:, None], at[:, None] + offsets, len(words))]
                offsets = np.arange(behind)
                before = padded[np.where(offsets < left[:, None], at[:, None] - 1 - offsets, len(words))]
                own = [pa.array([r.tobytes() for r in before], pa.binary()), pa.array([r.tobytes() for r in after], pa.binary()), pa.array(left << 32 | right)]
                names = ["left", "right", "reach"]
            taken = wanted.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [taken.field("prefix"), taken.field("around"), batch.column("id").take(pa.array(text[row])), *own], names=["prefix", "around", "id", *names]
            )

    kinds = {"o": "long", "one": "long", "two": "long"} if crowded else {"left": "binary", "right": "binary", "reach": "long"}
    given = f"prefix long, around long, id {texts.schema['id'].dataType.simpleString()}, "
    return texts.mapInArrow(batches, given + ", ".join(f"{n} {kind}" for n, kind in kinds.items()))


def in_trees(rows: DataFrame) -> DataFrame:
    """(prefix, around, windows) of suffixes that have a window in common with a smaller id; all of a prefix meet in a task."""

    def judged(table: pa.Table) -> pa.RecordBatch:
        words = lambda name: np.frombuffer(b"".join(table[name].to_pylist()), np.uint64).reshape(len(table), -1)
        reach = table["reach"].to_numpy()
        # Ids of any kind, by rank.
        ids = np.unique(table["id"].to_numpy(), return_inverse=True)[1]
        prefix, around = (table[name].to_numpy() for name in ("prefix", "around"))
        windows = repeated_windows(prefix.view(np.uint64), words("left"), words("right"), np.column_stack((reach >> 32, reach & 0xFFFF)), ids)
        hit = windows != 0
        return pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (prefix, around, windows)], names=["prefix", "around", "windows"])

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in tables:
            held.append(batch)
            many += batch.num_rows
            if many >= ROWS_AT_ONCE:
                table = pa.Table.from_batches(held)
                prefix = table["prefix"].to_numpy()
                # The last prefix may go on.
                whole = int(np.searchsorted(prefix, prefix[-1]))
                if whole:
                    yield judged(table.slice(0, whole))
                    held, many = table.slice(whole).combine_chunks().to_batches(), many - whole
        if many:
            yield judged(pa.Table.from_batches(held))

    return rows.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(batches, "prefix long, around long, windows long")


def by_windows(rows: DataFrame) -> DataFrame:
    """As ``in_trees``, for prefixes of many suffixes: each window is a prefix by itself, of which the smallest id counts."""
    rows = written(rows, "substring-windows")
    least = rows.groupBy("one", "two").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("many"))
    least = written(least.filter("least < most").drop("most"), "substring-windows")
    again = matched(rows, least, ["one", "two"], rows.count()).filter("id > least")
    return again.groupBy("prefix", "around").agg(F.bit_or(F.expr("shiftleft(1L, cast(o as int))")).alias("windows"))


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """(id, key, places) of ``docs`` (id, key, content): anchors of the windows of ``length`` words that a smaller id has
    too, with those windows as bits. ``key`` tells texts of one id apart."""
    if length - seed > 62:
        raise ValueError("a window may begin 62 words before its anchor at most")
    found = written(anchor_table(docs, length, seed), "substring-anchors")
    alike = found.groupBy("prefix", "around").agg(
        F.min(F.struct("id", "key", "place")).alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("copies")
    )
    alike = written(alike, "substring-alike")
    prefixes = alike.groupBy("prefix").agg(F.count(F.lit(1)).alias("many"), F.min("first.id").alias("least"), F.max("last").alias("most"))
    prefixes = written(prefixes.filter("least < most").select("prefix", "many"), "substring-prefixes")
    alike = written(matched(alike.drop("last"), prefixes, ["prefix"], alike.count()), "substring-alike")
    wanted = F.collect_list(F.struct("first.place", "prefix", "around", (F.col("many") > group).alias("crowded"))).alias("wanted")
    # A prefix with one surrounding has nothing left to compare.
    wanted = alike.filter("many > 1").groupBy("first.id", "first.key").agg(wanted)
    texts = docs
    if docs.groupBy("id", "key").count().filter("count > 1").limit(1).count():
        # Repeated rows are looked at once. Else the texts move as they do for the caller's join, and so once for both.
        texts = docs.groupBy("id", "key").agg(F.first("content").alias("content"))
    texts = texts.join(wanted, ["id", "key"]).select("id", "content", "wanted")
    judged = in_trees(suffixes(texts, length, seed, False))
    if alike.filter(F.col("many") > group).limit(1).count():
        judged = judged.unionByName(by_windows(suffixes(texts, length, seed, True)))
    # A surrounding's first id has the windows judged, at every place; later ids have each window again.
    places = matched(found, alike.filter("copies > 1").select("prefix", "around", "first", F.col("copies").alias("many")), ["prefix", "around"], found.count())
    places = places.filter("(id, key, place) != (first.id, first.key, first.place)").select("prefix", "around", "id", "key", "place", (F.col("id") > F.col("first.id")).alias("later"))
    places = written(places, "substring-places")
    firsts = alike.filter("many > 1").select("prefix", "around", "first.*").unionByName(places.filter("NOT later").drop("later"))
    hits = firsts.join(judged, ["prefix", "around"]).select("id", "key", "place", "windows")
    hits = hits.unionByName(places.filter("later").select("id", "key", "place", F.lit(-1).cast("long").alias("windows")))
    hits = hits.groupBy("id", "key", "place").agg(F.bit_or("windows").alias("windows"))
    return hits.groupBy("id", "key").agg(F.collect_list(F.struct("place", "windows")).alias("places"))


def covered(n: int, places: np.ndarray, windows: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Which of ``n`` words the windows cover."""
    behind = np.arange(length - seed + 1)
    start = np.unique((places[:, None] - behind)[(windows[:, None] >> behind) & 1 == 1])
    start = start[(start >= 0) & (start + length <= n)]
    change = np.zeros(n + 1, np.int64)
    change[start] += 1
    change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (start and end, in words, of what goes) and ``kept``: the other words, joined by one blank.

    A word goes if a window of ``length`` words that covers it also stands in a row of smaller id. Windows are judged
    on the input. Rows of one id are one document that never repeats itself; rows of null id are left whole, and nothing goes on
    their account. Null texts have no words, an empty ``kept`` and no spans. Columns of the names of results are replaced.
    """
    results = ("n_words", "spans", "kept")
    extra = [c for c in docs.columns if c not in (id_col, text_col, *results)]
    others = [F.struct(*extra).alias("row")] if extra else []
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("content"), *others)
    whole = rows.filter("id is not null and content is not null")
    marked = repeats(whole.select("id", "key", "content"), length, seed, group)
    found = whole.join(marked, ["id", "key"], "left").drop("key")
    found = found.unionByName(rows.filter("id is null or content is null").drop("key"), allowMissingColumns=True)

    passed = [c for c in found.columns if c != "places"]

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _each_text(tables):
            spans, kept = [], []
            for words, places in zip(texts, batch.column("places")):
                if not places.is_valid:
                    spans.append([])
                    kept.append(b" ".join(words))
                    continue
                values = places.values
                gone = covered(len(words), *(values.field(c).to_numpy() for c in ("place", "windows")), length, seed)
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                spans.append([{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())])
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in passed), pa.array([len(w) for w in texts], pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=[*passed, *results],
            )

    kinds = (T.LongType(), T.ArrayType(SPAN), T.StringType())
    schema = T.StructType([*found.select(*passed).schema, *map(T.StructField, results, kinds)])
    return found.mapInArrow(batches, schema).select(F.col("id").alias(id_col), F.col("content").alias(text_col), *(F.col("row")[c].alias(c) for c in extra), *results)
