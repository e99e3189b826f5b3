"""Line-numbered text without a global sort.

Spark splits a text file into blocks. Each block numbers its own lines, and a small
table with one row per block gives the lines (and any running count) before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.tuning import is_small, settle


def numbered_lines(spark: SparkSession, paths, flag=None) -> DataFrame:
    """Columns: path, line (text), line_no (0-based per file), and, with ``flag``,
    ``flags_through``: how many lines up to and including this one satisfy it.

    Without ``flag``, the lines of a split come in order and in one partition."""
    mark = F.lit(0) if flag is None else flag(F.col("line")).cast("int")
    lines = spark.read.text(paths).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    blocks = lines.groupBy("path", "block").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines"), F.sum(mark).alias("_flags")
    )
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    offsets = blocks.select(
        "path", "block", "_first", before("_lines").alias("_start"), before("_flags").alias("_flagged")
    )
    # One row per block: settled so that its size can be checked without another scan.
    offsets = settle(offsets)
    if is_small(offsets):
        joined = lines.join(F.broadcast(offsets), ["path", "block"])
    else:
        joined = lines.join(offsets, ["path", "block"]).sortWithinPartitions("path", "block", "_id")
    out = joined.withColumn("line_no", F.col("_start") + F.col("_id") - F.col("_first"))
    columns = ["path", "line", "line_no"]
    if flag is not None:
        within = Window.partitionBy("path", "block").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("flags_through", F.col("_flagged") + F.sum(mark).over(within))
        columns.append("flags_through")
    return out.select(*columns)


def file_stem(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
