"""Tables in the shared folder, and text helpers that several operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# White space as the contracts count it: blank, tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
# Keys that a join broadcasts, at most, because they have many rows.
CROWDS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local master may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written in the shared folder: lineage ends there, and lost executors take nothing along."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def matched(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row for each key and ``many``, the rows it meets, ``total`` at most.

    Keys that meet more than one row in ``CROWDS`` are at most ``CROWDS`` in number: these are broadcast, and their rows stay where
    they are.
    """
    crowd = F.col("many") > total / CROWDS
    heavy = keyed.filter(crowd)
    if not heavy.limit(1).count():
        return rows.join(keyed, keys)
    light = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(keyed.filter(~crowd), keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(light)


def strings(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``batch`` in order, in slices of about ``most_bytes`` of a text column, and one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    place = (np.cumsum(sizes) - sizes) // most_bytes
    cuts = np.flatnonzero(np.diff(place, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def crc32_of_id(column: str):
    """crc32 of an id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For group sizes: each member's group, and its place inside the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
