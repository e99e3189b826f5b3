"""Join-size checks, and the shared folder."""

import tempfile
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
TASK_ROWS = 500_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether rows and bytes, spelled out as text, are within bounds; the count stops at ``max_rows + 1``."""
    width = sum((F.coalesce(F.octet_length(df[c].cast("string")), F.lit(0)) + 8 for c in df.columns), F.lit(0))
    rows, size = df.select(width.alias("width")).limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum("width")).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after counting the rows of ``df`` and their bytes.

    A larger side keeps a shuffle join, which adaptive execution splits where a key is skewed.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def dealt(df: DataFrame, *keys: str, rows: int = TASK_ROWS, others=()) -> DataFrame | list[DataFrame]:
    """Deal out by key, to so many tasks that one gets about ``rows``.

    Adaptive execution sizes tasks by compressed bytes, of which narrow rows have few: its tasks grow with the input, and so
    does what they sort and count. Small inputs stay with it. Counts ``df``: for tables and selections of them. With
    ``others``, that meet ``df`` by the keys, a list: all are dealt to the same tasks.
    """
    tasks = ceil(df.count() / rows)
    number = (tasks,) if tasks > df.sparkSession.sparkContext.defaultParallelism else ()
    moved = [x.repartition(*number, *keys) for x in (df, *others)]
    return moved if others else moved[0]


def shared_folder(spark) -> str:
    """The shared folder that spark.checkpoint.dir names. Without one, only a local master gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
