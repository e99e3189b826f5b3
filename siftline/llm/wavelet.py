"""Token ids in files of one wavelet matrix each.

A file holds whole documents in order. Bit-plane l has bit (levels - 1 - l) of every id, in the order that stable
sorting by the planes before it leaves; ones counted up to each block of a plane give rank and, by bisection, select.
Planes are cut into blocks that are compressed alone, so a lookup opens one block of each plane.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.shared import strings, written
from siftline.llm.tokens import encoder as shared_encoder

MAGIC = b"SIFTWM01"
ENDING = ".wvm"
BLOCK_BYTES = 1 << 15
SHARD_TOKENS = 1 << 22


def encode_file(ids: np.ndarray, levels: int, doc_ids: list[int | None], counts: list[int], order: tuple[int, int] = (0, 0)) -> bytes:
    """The file of ``ids`` (unsigned), which belong to ``doc_ids`` in turn, ``counts`` each."""
    pack = zstandard.ZstdCompressor(level=1).compress
    values, zeros, ones, sizes, bodies = ids, [], [], [], []
    for level in range(levels):
        bits = (values >> (levels - 1 - level)) & 1 == 1
        plane = np.packbits(bits, bitorder="little")
        rest = values[~bits]
        zeros.append(len(rest))
        values = np.concatenate((rest, values[bits]))
        parts = [plane[i : i + BLOCK_BYTES] for i in range(0, len(plane), BLOCK_BYTES)]
        ones.append([int(np.bitwise_count(p).sum(dtype=np.int64)) for p in parts])
        packed = [pack(p.tobytes()) for p in parts]
        sizes.append([len(p) for p in packed])
        bodies += packed
    head = json.dumps({"n": len(ids), "levels": levels, "order": order, "zeros": zeros, "ones": ones, "sizes": sizes}).encode()
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + np.array(counts, "<i8").tobytes()
    head, table = pack(head), pack(docs)
    return b"".join([MAGIC, struct.pack("<III", len(head), len(table), len(doc_ids)), head, table, *bodies])


class WaveletFile:
    """Lookups in one file: tokens, counts and places of an id, and documents."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        head_size, table_size, docs = struct.unpack_from("<III", data, 8)
        self._unpack = zstandard.ZstdDecompressor().decompress
        head = json.loads(self._unpack(data[20 : 20 + head_size]))
        self.n, self.levels, self.order = head["n"], head["levels"], tuple(head["order"])
        self._zeros = head["zeros"]
        self._before = [np.concatenate(([0], np.cumsum(x, dtype=np.int64))) for x in head["ones"]]
        raw = self._unpack(data[20 + head_size : 20 + head_size + table_size])
        ids, known = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, np.uint8, docs, 8 * docs)
        self.doc_ids = [i if k else None for i, k in zip(ids.tolist(), known.tolist())]
        self.starts = np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<i8", docs, 9 * docs), dtype=np.int64)))
        at = 20 + head_size + table_size
        self._spans: list[list[tuple[int, int]]] = []
        for sizes in head["sizes"]:
            ends = at + np.cumsum([0, *sizes], dtype=np.int64)
            self._spans.append(list(zip(ends[:-1].tolist(), ends[1:].tolist())))
            at = int(ends[-1])
        self._data = data
        self._block = lru_cache(maxsize=4 * self.levels)(self._read_block)

    def _read_block(self, level: int, block: int) -> np.ndarray:
        a, b = self._spans[level][block]
        return np.frombuffer(self._unpack(self._data[a:b]), np.uint8)

    def _bit(self, level: int, i: int) -> int:
        block, rest = divmod(i, 8 * BLOCK_BYTES)
        return int(self._block(level, block)[rest >> 3] >> (rest & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, rest = divmod(i, 8 * BLOCK_BYTES)
        if not rest:
            return int(self._before[level][block])
        part = self._block(level, block)
        whole = int(np.bitwise_count(part[: rest >> 3]).sum(dtype=np.int64))
        tail = int(part[rest >> 3] & ((1 << (rest & 7)) - 1)).bit_count() if rest & 7 else 0
        return int(self._before[level][block]) + whole + tail

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) one or zero of a plane."""
        before = self._before[level]
        if not bit:
            before = np.minimum(np.arange(len(before)) * 8 * BLOCK_BYTES, self.n) - before
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self._block(level, block), bitorder="little")
        return block * 8 * BLOCK_BYTES + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def _down(self, level: int, bit: int, i: int) -> int:
        ones = self._rank1(level, i)
        return self._zeros[level] + ones if bit else i - ones

    def token(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit = self._bit(level, i)
            value = value << 1 | bit
            i = self._down(level, bit, i)
        return value

    def _range(self, symbol: int, start: int, stop: int) -> tuple[int, int]:
        for level in range(self.levels):
            bit = symbol >> (self.levels - 1 - level) & 1
            start, stop = self._down(level, bit, start), self._down(level, bit, stop)
        return start, stop

    def count(self, symbol: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of an id in [start, stop)."""
        if not 0 <= symbol < 1 << self.levels:
            return 0
        a, b = self._range(symbol, start, self.n if stop is None else stop)
        return b - a

    def occurrence(self, symbol: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(symbol):
            raise IndexError(k)
        i = self._range(symbol, 0, self.n)[0] + k
        for level in reversed(range(self.levels)):
            bit = symbol >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self._zeros[level] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids, by undoing the planes' sorts from the last to the first."""
        values = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels)):
            plane = np.concatenate([np.zeros(0, np.uint8), *(self._read_block(level, b) for b in range(len(self._spans[level])))])
            bits = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            back = np.empty_like(values)
            back[~bits] = values[: self._zeros[level]]
            back[bits] = values[self._zeros[level] :] | (1 << (self.levels - 1 - level))
            values = back
        return values


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Write the ids of ``docs`` by ascending id (null first; ties by text) and return (part, seq, file, n_docs, n_tokens).

    A range shuffle orders the documents; a task writes its range to files of about ``shard_tokens`` ids, each moved
    into place when whole, so a task that runs again leaves the same files. Null and empty texts have only the end id.
    ``folder`` must be one that all executors share.
    """

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        store, path = fs.FileSystem.from_uri(folder)
        encoder = shared_encoder(tokenizer)
        levels = max(encoder.largest, end_id).bit_length()
        end = np.array([end_id], encoder.kind).tobytes()
        ids, chunks, counts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, chunks, counts, held, seq
            name = f"{part:06d}-{seq:06d}{ENDING}"
            data = encode_file(np.frombuffer(b"".join(chunks), encoder.kind), levels, ids, counts, (part, seq))
            fresh = f"{path}/_{uuid.uuid4().hex}"
            with store.open_output_stream(fresh) as out:
                out.write(data)
            store.move(fresh, f"{path}/{name}")
            made = pa.RecordBatch.from_pylist(
                [{"part": part, "seq": seq, "file": name, "n_docs": len(ids), "n_tokens": held}], schema=made_schema
            )
            ids, chunks, counts, held, seq = [], [], [], 0, seq + 1
            return made

        made_schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
        for batch in tables:
            for doc, coded in zip(batch.column(0).to_pylist(), encoder.encode(strings(batch.column(1)))):
                ids.append(doc)
                chunks += (coded, end)
                counts.append(len(coded) // encoder.kind.itemsize + 1)
                held += counts[-1]
                if held >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange("id", F.xxhash64("text"))
        .sortWithinPartitions("id", "text")
    )
    return written(ordered.mapInArrow(batches, "part int, seq int, file string, n_docs long, n_tokens long"), "token-index")


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the files alone."""

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            for data in batch.column("content"):
                file = WaveletFile(data.as_py())
                ids = file.tokens().astype("<u4").tobytes()
                spans = list(zip((4 * file.starts[:-1]).tolist(), (4 * file.starts[1:]).tolist()))
                rows = len(spans)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows, file.order[0], np.int32)),
                        pa.array(np.full(rows, file.order[1], np.int32)),
                        pa.array(file.doc_ids, pa.int64()),
                        pa.array(file.starts[:-1]),
                        pa.array(np.diff(file.starts)),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in spans], pa.int64()),
                    ],
                    names=["part", "seq", "id", "place", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ENDING}").load(folder).select("content")
    rows = written(files.mapInArrow(batches, "part int, seq int, id long, place long, n_tokens long, ids_crc32 long"), "token-rows")
    # One row for each file: the only rows that meet in one task.
    before = (
        rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("held"))
        .withColumn("before", F.sum("held").over(Window.orderBy("part", "seq")) - F.col("held"))
    )
    return rows.join(before, ["part", "seq"]).select(
        F.col("id").alias(id_col), (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )
