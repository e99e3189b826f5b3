"""FASTA files as contig catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.sources.lines import numbered_lines


def fasta_lines(spark: SparkSession, paths) -> DataFrame:
    """Non-blank lines with their record ordinal; ordinal 0 precedes any header."""
    lines = numbered_lines(spark, paths, flag=lambda line: F.trim(line).startswith(">"))
    return lines.select("path", "line_no", F.trim("line").alias("text"), F.col("flags_through").alias("ordinal")).filter(
        "text <> ''"
    )


def read_fasta(spark: SparkSession, paths, layer: str, with_sequence: bool = False) -> tuple[DataFrame, DataFrame]:
    """(contigs, rejects). Contigs: layer, ordinal, header, genome_length.

    Lengths are summed from the lines. ``with_sequence`` also concatenates each
    record, which needs a contig to fit in one row.
    """
    lines = fasta_lines(spark, paths)
    is_header = F.col("text").startswith(">")
    aggregates = [
        F.max(F.when(is_header, F.trim(F.substr("text", F.lit(2))))).alias("header"),
        F.coalesce(F.sum(F.when(~is_header, F.length("text"))), F.lit(0)).cast("bigint").alias("genome_length"),
        F.min("line_no").alias("line_no"),
    ]
    if with_sequence:
        ordered = F.sort_array(F.collect_list(F.when(~is_header, F.struct("line_no", "text"))))
        aggregates.append(F.array_join(F.transform(ordered, lambda s: s["text"]), "").alias("sequence"))
    records = lines.groupBy("path", "ordinal").agg(*aggregates)
    problem = (
        F.when(F.col("ordinal") == 0, "leading_sequence")
        .when(F.coalesce("header", F.lit("")) == "", "empty_header")
        .when(F.col("genome_length") == 0, "empty_sequence")
    )
    judged = records.withColumn("layer", F.lit(layer)).withColumn("problem", problem)
    columns = ["layer", "ordinal", "header", "genome_length"] + (["sequence"] if with_sequence else [])
    contigs = judged.filter("problem IS NULL").select(*columns)
    rejects = judged.filter("problem IS NOT NULL").select("path", "line_no", "problem", "header")
    return contigs, rejects
