"""Near-duplicates by SimHash, linked through the anchor points of a covering code.

Fingerprints that differ in at most ``threshold`` of 64 bits are linked. The bits are cut into ``parts``
blocks; two linked fingerprints differ by at most ``threshold // parts`` bits in one of them. Each block
has a covering code: the perfect Hamming code on its first 2^r - 1 bits, with every setting of the rest,
so each value lies within one bit (the covering radius) of exactly one anchor, its home. A fingerprint
goes home, and visits every anchor within radius plus block threshold; by the triangle inequality two
linked fingerprints meet at the home of either. Only homes are compared with visitors.

Copies share a fingerprint and count once. Anchors with many guests are dealt out as a grid of tiles, so no
task holds more than a tile, and a task reports a spanning forest of its links, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.shared import matched, ragged, strings, written

SEED = 42
BITS = 64
SHINGLE_WORDS = 4
THRESHOLD = 4
PARTS = 3
TILE_HOMES, TILE_VISITORS = 4_096, 16_384
# Pairs compared at once, and rows gathered before a comparison.
PAIRS_AT_ONCE, ROWS_AT_ONCE = 500_000, 100_000

_SPACES = bytes(b" \t\n\x0b\x0c\r")
_LOWER = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else 32 if b in _SPACES else b for b in range(256))


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Bitwise majority of the shingles' XXH64; zero without words."""
    words = [w for w in text.translate(_LOWER).split(b" ") if w]
    if not words:
        return 0
    joined = b" ".join(words)
    count = max(1, len(words) - shingle_words + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:count].tolist()
    stops = ends[min(shingle_words, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for at in range(0, count, 8_192):
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 8_192], stops[at : at + 8_192])], np.uint64
        )
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > count, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """The fingerprint (signed long) of every whole text beside its ``docs`` columns; null texts count as empty."""
    kept = [c for c in docs.columns if c != text_col]

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            marks = np.array([fingerprint(t) for t in strings(batch.column(text_col))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(marks)], names=[*kept, name]
            )

    return docs.mapInArrow(batches, docs.select(*kept).withColumn(name, F.lit(0).cast("long")).schema)


class Block:
    """One block of bits and its covering code."""

    def __init__(self, shift: int, bits: int, threshold: int):
        self.shift, self.bits = shift, bits
        order = 2
        while 2 ** (order + 1) - 1 <= bits:
            order += 1
        self.coded = 2**order - 1
        self.syndromes = 2**order
        # Error patterns up to radius + threshold, by the syndrome they cancel.
        by: list[list[int]] = [[] for _ in range(self.syndromes)]
        self.correct = [0] * self.syndromes
        masks = [(0, 0, -1)]
        for _ in range(1 + threshold + 1):
            for mask, syndrome, _last in masks:
                by[syndrome].append(mask)
            masks = [
                (mask | 1 << i, syndrome ^ (i + 1 if i < self.coded else 0), i)
                for mask, syndrome, last in masks
                for i in range(last + 1, bits)
            ]
        for i in range(self.coded):
            self.correct[i + 1] = 1 << i
        self.visits = [np.array(p, np.int64) for p in by]

    def value(self, marks: np.ndarray) -> np.ndarray:
        return (marks >> np.uint64(self.shift)).astype(np.int64) & ((1 << self.bits) - 1)

    def syndrome(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.int64)
        for i in range(self.coded):
            out ^= ((values >> i) & 1) * (i + 1)
        return out

    def home(self, values: np.ndarray) -> np.ndarray:
        """The one anchor within the covering radius."""
        return values ^ np.array(self.correct, np.int64)[self.syndrome(values)]

    def guests(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor) of every anchor within radius plus threshold."""
        syndrome = self.syndrome(values)
        rows, anchors = [], []
        for s, patterns in enumerate(self.visits):
            at = np.flatnonzero(syndrome == s)
            rows.append(np.repeat(at, len(patterns)))
            anchors.append((values[at][:, None] ^ patterns[None, :]).ravel())
        return np.concatenate(rows), np.concatenate(anchors)


def blocks(threshold: int = THRESHOLD, parts: int = PARTS) -> list[Block]:
    edges = [BITS * i // parts for i in range(parts + 1)]
    return [Block(a, b - a, threshold // parts) for a, b in zip(edges, edges[1:])]


def anchored(marks: DataFrame, code: list[Block]) -> DataFrame:
    """(place, role, mark): role 0 at home, 1 as a visitor. ``place`` holds block and anchor."""

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            unsigned = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(unsigned), 4_096):
                part = unsigned[at : at + 4_096]
                for number, block in enumerate(code):
                    values = block.value(part)
                    row, anchor = block.guests(values)
                    places = np.concatenate((block.home(values), anchor)) + (number << 40)
                    role = np.repeat(np.array([0, 1], np.int8), [len(part), len(row)])
                    mark = np.concatenate((part, part[row])).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(places), pa.array(role), pa.array(mark)], names=["place", "role", "mark"]
                    )

    return marks.mapInArrow(batches, "place long, role byte, mark long")


def tiled(guests: DataFrame, homes_most: int = TILE_HOMES, visitors_most: int = TILE_VISITORS) -> DataFrame:
    """Adds ``tile``: crowded places become a grid of home by visitor slices, and each row goes to its line of the grid.

    The crowded places are at most rows / ``homes_most``; they are joined, and broadcast only if Spark finds them small.
    """
    crowd = (
        guests.groupBy("place")
        .agg(F.sum(1 - F.col("role")).alias("homes"), F.sum("role").alias("visitors"))
        .filter((F.col("homes") > homes_most) | (F.col("visitors") > visitors_most))
        .select(
            "place",
            F.ceil(F.greatest("homes", F.lit(1)) / homes_most).cast("int").alias("home_slices"),
            F.ceil(F.greatest("visitors", F.lit(1)) / visitors_most).cast("int").alias("visitor_slices"),
        )
    )
    own = F.when(F.col("role") == 0, F.col("home_slices")).otherwise(F.col("visitor_slices"))
    other = F.when(F.col("role") == 0, F.col("visitor_slices")).otherwise(F.col("home_slices"))
    slice_no = F.pmod(F.xxhash64("mark"), own).cast("int")
    lines = F.transform(
        F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1),
        lambda i: F.when(F.col("role") == 0, slice_no * F.col("visitor_slices") + i).otherwise(
            i * F.col("visitor_slices") + slice_no
        ),
    )
    return guests.join(crowd, "place", "left").select(
        "place", "role", "mark", F.explode(F.when(F.col("home_slices").isNull(), F.array(F.lit(0))).otherwise(lines)).alias("tile")
    )


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b as links of each member with the smallest of its component."""
    if not len(a):
        return a, b
    names, codes = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = codes[: len(a)], codes[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(names)))
    return names[own], names[label[own]]


def compared(tile_rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) links found in the tiles, a spanning forest of each stretch of them.

    A stretch holds whole tiles, so at most ROWS_AT_ONCE rows plus one tile.
    """

    def links(key: np.ndarray, role: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.concatenate(([True], np.any(key[1:] != key[:-1], axis=1))))
        size = np.diff(np.concatenate((edges, [len(key)])))
        homes = np.add.reduceat((role == 0).astype(np.int64), edges)
        home_rows = np.flatnonzero(role == 0)
        tile_of = np.repeat(np.arange(len(edges)), homes)
        guests = (size - homes)[tile_of]
        first = (edges + homes)[tile_of]
        found_a, found_b, at = [], [], 0
        total = np.cumsum(guests)
        while at < len(home_rows):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            home, place = ragged(guests[at:stop])
            x = mark[home_rows[at:stop]][home]
            y = mark[first[at:stop][home] + place]
            near = (np.bitwise_count(x ^ y) <= threshold) & (x != y)
            a, b = forest(x[near], y[near])
            found_a.append(a)
            found_b.append(b)
            at = stop
        a, b = forest(np.concatenate(found_a or [mark[:0]]), np.concatenate(found_b or [mark[:0]]))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in tables:
            if not batch.num_rows:
                continue
            whole = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held.append((np.stack((whole[0], whole[1].astype(np.int64)), axis=1), whole[2], whole[3].view(np.uint64)))
            rows += batch.num_rows
            if rows >= ROWS_AT_ONCE:
                key, role, mark = (np.concatenate(x) for x in zip(*held))
                cut = int(np.flatnonzero(np.any(key != key[-1], axis=1))[-1]) + 1 if np.any(key != key[-1]) else 0
                if cut:
                    yield links(key[:cut], role[:cut], mark[:cut])
                held, rows = [(key[cut:], role[cut:], mark[cut:])], len(key) - cut
        if rows:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    return (
        tile_rows.select("place", "tile", "role", "mark")
        .repartition("place", "tile")
        .sortWithinPartitions("place", "tile", "role")
        .mapInArrow(batches, "a long, b long")
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, by large-star and small-star turns.

    A turn replaces links by links to smaller nodes, keeps what is connected and ends when nothing changes; the
    turns number about the logarithm of the longest chain. Links are only grouped with combinable minima and
    joined, never gathered by node; the minima of nodes with very many links are broadcast, so these links stay where they are.
    """
    pairs = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    summed = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    links = written(pairs(links), "links")
    before = None
    while True:
        both = links.union(links.select("b", "a"))
        many = F.count(F.lit(1)).alias("many")
        lowest = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"), many), "lowest")
        # Large star: larger neighbours move to the smallest one.
        large = written(pairs(matched(both, lowest, ["a"], 2 * links.count()).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))), "links")
        # Small star: smaller neighbours, and the node itself, move to the smallest one.
        lowest = written(large.groupBy("a").agg(F.min("b").alias("low"), many), "lowest")
        own = lowest.select("a", F.col("low").alias("b"))
        small = written(pairs(matched(large, lowest, ["a"], large.count()).select(F.col("b").alias("a"), F.col("low").alias("b")).union(own)), "links")
        links, now = small, summed(small)
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def clusters(docs: DataFrame, id_col: str, text_col: str, threshold: int = THRESHOLD, parts: int = PARTS) -> DataFrame:
    """(id_col, fingerprint long, component_id), one row for each row of ``docs``.

    component_id is the smallest id that a chain of links reaches, the row's own included; null ids are passed over,
    so it is null only where a whole component has none. Null and empty texts have fingerprint zero and are linked
    like any other. Repeated rows give repeated rows.
    """
    prints = written(with_fingerprint(docs.select(id_col, text_col), text_col), "prints")
    distinct = written(prints.groupBy("fingerprint").agg(F.min(id_col).alias("low")), "marks")
    guests = written(anchored(distinct.select("fingerprint"), blocks(threshold, parts)), "guests")
    linked = components(compared(tiled(guests), threshold))
    classes = distinct.join(linked, distinct["fingerprint"] == linked["node"], "left").select(
        "fingerprint", "low", F.coalesce("root", "fingerprint").alias("root")
    )
    lowest = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classes.join(lowest, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select(id_col, "fingerprint", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each component: the row of the smallest id, of rows with one id the one of smaller text hash.

    Repeated rows (same id and text) count as one. The name ``_simhash_row`` is the operator's own.
    """
    own = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("hash"))
    keyed = docs.withColumn("_simhash_row", own)
    found = clusters(keyed.select("_simhash_row", text_col), "_simhash_row", text_col, threshold)
    best = found.select(F.col("component_id").alias("_simhash_row")).distinct()
    return keyed.join(best, "_simhash_row", "left_semi").dropDuplicates(["_simhash_row"]).drop("_simhash_row")
