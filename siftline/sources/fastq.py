"""Paired FASTQ files and name-sorted mate records to fragments, with rejects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import normalize_qname, sample_name
from siftline.sources.lines import numbered_lines
from siftline.tuning import broadcast_if_small, is_small

# Accepted file endings by input kind.
FASTQ_ENDINGS = (".fastq", ".fq", ".fastq.gz", ".fq.gz")
RECORD_ENDINGS = (".bam", ".ubam", ".cram")


def input_kind(paths) -> str:
    """``fastq_pair`` or ``records``; anything else is an error."""
    names = [str(p).lower() for p in paths]
    if len(names) == 2 and all(n.endswith(FASTQ_ENDINGS) for n in names):
        return "fastq_pair"
    if len(names) == 1 and names[0].endswith(RECORD_ENDINGS):
        return "records"
    raise ValueError("give two paired FASTQ files or one record file")


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files that a path, pattern or folder names, in order, as Spark reports them."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    where = hadoop.Path(path)
    store = where.getFileSystem(conf)
    found = []
    for status in store.globStatus(where) or ():
        listed = store.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [x.getPath().toUri().toString() for x in listed if not x.isDirectory() and x.getPath().getName()[0] not in "_."]
    if not found:
        raise ValueError(f"no files at {path}")
    return sorted(found)


def paired_files(spark: SparkSession, r1, r2) -> list[tuple[str, int, int, str]]:
    """(path, mate, pair, r1_path): files paired by their place in the two lists."""
    listed = [[f for p in ([paths] if isinstance(paths, str) else paths) for f in _files(spark, str(p))] for paths in (r1, r2)]
    if len(listed[0]) != len(listed[1]):
        raise ValueError(f"{len(listed[0])} R1 files and {len(listed[1])} R2 files do not pair")
    return [(f, mate, pair, listed[0][pair]) for mate, files in ((1, listed[0]), (2, listed[1])) for pair, f in enumerate(files)]


PARTS = ("head", "seq", "plus", "qual")


def mate_records(lines: DataFrame) -> DataFrame:
    """(pair, mate, ordinal, head, seq, plus, qual) of lines (pair, mate, line_no, line) that come in the order of their files.

    Four lines in a row that begin at a multiple of four are a record and make one row. Other lines, cut off from their
    record by the end of a split or of a batch of lines, are rows of their own with the other parts null.
    """

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            pair, mate, number = (batch.column(i).to_numpy() for i in range(3))
            breaks = (pair[1:] != pair[:-1]) | (mate[1:] != mate[:-1]) | (number[1:] != number[:-1] + 1)
            stretch = np.concatenate(([0], np.cumsum(breaks)))
            first = np.flatnonzero(number[:-3] % 4 == 0) if len(number) > 3 else np.zeros(0, np.int64)
            first = first[stretch[first] == stretch[first + 3]]
            whole = np.zeros(len(number), bool)
            for i in range(4):
                whole[first + i] = True
            loose = np.flatnonzero(~whole)
            rows, none = np.concatenate((first, loose)), np.zeros(len(first), bool)
            cells = [
                batch.column(3).take(pa.array(np.concatenate((first + i, loose)), mask=np.concatenate((none, number[loose] % 4 != i))))
                for i in range(4)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(pair[rows]), pa.array(mate[rows]), pa.array(number[rows] // 4), *cells], names=["pair", "mate", "ordinal", *PARTS])

    text = ", ".join(f"{part} string" for part in PARTS)
    return lines.select("pair", "mate", "line_no", "line").mapInArrow(batches, f"pair long, mate int, ordinal long, {text}")


def _bare(path):
    """A path whose scheme is spelled the same by all who report it."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def read_fastq_pairs(spark: SparkSession, r1, r2, sample=sample_name) -> tuple[DataFrame, DataFrame]:
    """(fragments, rejects) of R1 and R2 files, one path each or lists of equal length, paired by place.

    ``sample`` turns the R1 path of a pair into the sample id; the default uses the file name. Several
    pairs may share a sample: ``record_number`` goes by pair, then by place in the file. A record without any text at the end of
    its files is no record; anywhere else it is a reject. Lines become
    records where they are read; records move once, to their mates. Gzip files are read as one task each, as the format cannot be split.
    """
    listed = paired_files(spark, r1, r2)
    files = spark.createDataFrame(listed, "path string, mate int, pair long, r1_path string").withColumn("path", _bare(F.col("path")))
    samples = files.filter("mate = 1").select("pair", sample(F.col("r1_path")).alias("sample_id"))
    lines = numbered_lines(spark, [row[0] for row in listed]).withColumn("path", _bare(F.col("path")))
    if is_small(files):
        lines = lines.join(F.broadcast(files), "path")
    else:
        # A shuffle join puts lines of a file together, not in order.
        lines = lines.join(files, "path").sortWithinPartitions("pair", "mate", "line_no")
    cell = lambda mate, part: F.max(F.when(F.col("mate") == mate, F.col(part))).alias(f"r{mate}_{part}")
    # A record is a row, or a few where a split or a batch cuts it.
    records = mate_records(lines).repartition("pair", "ordinal").groupBy("pair", "ordinal").agg(*(cell(m, part) for m in (1, 2) for part in PARTS))
    records = records.join(broadcast_if_small(samples), "pair")
    names = [f"r{mate}_{part}" for mate in (1, 2) for part in PARTS]
    key = lambda m: normalize_qname(F.substr(f"r{m}_head", F.lit(2)))
    malformed = F.lit(False)
    for m in (1, 2):
        malformed = malformed | ~F.coalesce(
            F.startswith(f"r{m}_head", F.lit("@"))
            & F.startswith(f"r{m}_plus", F.lit("+"))
            & (F.length(f"r{m}_seq") == F.length(f"r{m}_qual")),
            F.lit(False),
        )
    empty = lambda columns: F.trim(F.concat_ws("", *columns)) == ""
    blank = lambda m: empty(n for n in names if n.startswith(f"r{m}"))
    verdict = (
        F.when(empty(names), "blank")
        .when(blank(1), "orphan_r2")
        .when(blank(2), "orphan_r1")
        .when(malformed, "malformed")
        .when(key(1) != key(2), "key_mismatch")
    )
    judged = records.withColumn("problem", verdict)
    fragments = judged.filter("problem IS NULL").select(
        "sample_id",
        key(1).alias("fragment_key"),
        "r1_seq",
        "r1_qual",
        "r2_seq",
        "r2_qual",
        (F.shiftleft("pair", 40) + F.col("ordinal")).alias("record_number"),
    )
    ends = judged.filter("problem IS NULL OR problem <> 'blank'").groupBy("pair").agg(F.max("ordinal").alias("last"))
    rejects = (
        judged.filter("problem IS NOT NULL")
        .join(ends, "pair", "left")
        .filter("problem <> 'blank' OR ordinal < last")
        .select("sample_id", "pair", "ordinal", (F.col("ordinal") * 4 + 1).alias("line"), "problem", "r1_head", "r2_head")
    )
    return fragments, rejects


def mate_slot(flags) -> "F.Column":
    """1 or 2 from the first/last segment bits; null when they do not decide."""
    first, last = flags.bitwiseAND(64) != 0, flags.bitwiseAND(128) != 0
    return F.when(first & ~last, 1).when(last & ~first, 2)


def pair_mates(records: DataFrame, sort_order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(fragments, rejects) from name-sorted records: record 2i pairs with 2i + 1.

    Flags decide which mate is R1 when they agree to differ, else adjacency does.
    """
    if sort_order == "coordinate":
        raise ValueError("records are coordinate-sorted; give name-sorted records")
    mate = F.struct(
        "record_number",
        "qname",
        normalize_qname(F.col("qname")).alias("key"),
        mate_slot(F.col("flags")).alias("slot"),
        "seq",
        "qual",
    )
    # Each record moves once, to its pair.
    keyed = records.withColumn("pair", F.floor((F.col("record_number") - 1) / 2)).repartition("sample_id", "pair")
    gathered = keyed.groupBy("sample_id", "pair").agg(F.array_sort(F.collect_list(mate)).alias("all"))
    pairs = gathered.select(
        "sample_id", "pair", F.size("all").alias("mates"), F.col("all")[0].alias("a"), F.element_at("all", -1).alias("b")
    )
    problem = (
        F.when(F.col("mates") < 2, "orphan").when(F.col("mates") > 2, "repeated_record").when(
            F.col("a.key") != F.col("b.key"), "key_mismatch"
        )
    )
    swapped = F.coalesce((F.col("a.slot") == 2) & (F.col("b.slot") == 1), F.lit(False))
    r1 = F.when(swapped, F.col("b")).otherwise(F.col("a"))
    r2 = F.when(swapped, F.col("a")).otherwise(F.col("b"))
    judged = pairs.withColumn("problem", problem)
    fragments = judged.filter("problem IS NULL").select(
        "sample_id",
        F.col("a.key").alias("fragment_key"),
        r1["seq"].alias("r1_seq"),
        r1["qual"].alias("r1_qual"),
        r2["seq"].alias("r2_seq"),
        r2["qual"].alias("r2_qual"),
        F.col("pair").alias("record_number"),
    )
    rejects = judged.filter("problem IS NOT NULL").select(
        "sample_id", F.col("a.record_number").alias("record_number"), "problem", F.col("a.qname").alias("qname")
    )
    return fragments, rejects
