"""JSON inputs with their validation rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.schema import BENCHMARK_MANIFEST, MANIFEST, NEGATIVE_CONTROL


def read_manifest(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """Contig manifest: a JSON array, or JSON lines with ``multi_line=False``."""
    return spark.read.schema(MANIFEST).json(path, multiLine=multi_line)


def _blank(column) -> "F.Column":
    return F.trim(F.coalesce(column, F.lit(""))) == ""


def check_negative_controls(controls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(control candidates as rows, rejects). Controls without candidates give no row."""
    rows = controls.select("control_id", "control_status", F.explode_outer("candidates").alias("c")).select(
        "control_id", "control_status", "c.*"
    )
    value = F.col("unique_fraction")
    listed = F.col("accession_or_group").isNotNull() | value.isNotNull()
    problem = (
        F.when(_blank(F.col("control_id")), "empty_control_id")
        .when(_blank(F.col("control_status")), "empty_control_status")
        .when(listed & _blank(F.col("accession_or_group")), "empty_candidate")
        .when(
            listed & (value.isNull() | F.isnan(value) | (value < 0) | (value == float("inf"))), "invalid_fraction"
        )
    )
    judged = rows.withColumn("problem", problem)
    return (
        judged.filter(problem.isNull() & listed).drop("problem"),
        judged.filter("problem IS NOT NULL"),
    )


def read_negative_controls(spark: SparkSession, path) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(controls, control candidates, rejects)."""
    controls = spark.read.schema(NEGATIVE_CONTROL).json(path, multiLine=True)
    candidates, rejects = check_negative_controls(controls)
    return controls.select("control_id", "control_status"), candidates, rejects


def check_benchmark_datasets(datasets: DataFrame) -> DataFrame:
    """Add ``problem`` to dataset rows (dataset_id, input, expected_outcome, expected_target)."""
    copies = datasets.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_copies"))
    return (
        datasets.join(copies, "dataset_id", "left")
        .withColumn(
            "problem",
            F.when(_blank(F.col("dataset_id")), "empty_dataset_id")
            .when(F.col("_copies") > 1, "duplicate_dataset_id")
            .when(F.coalesce(F.size("input"), F.lit(0)) <= 0, "no_input")
            .when(~F.coalesce(F.col("expected_outcome").isin("negative", "spike_in"), F.lit(False)), "unknown_outcome"),
        )
        .drop("_copies")
    )


def read_benchmark_manifest(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(datasets, rejects); a manifest without datasets gives one reject."""
    documents = spark.read.schema(BENCHMARK_MANIFEST).json(path, multiLine=True)
    empty = documents.filter(F.coalesce(F.size("datasets"), F.lit(0)) <= 0).select(
        F.lit("").alias("dataset_id"), F.lit("no_datasets").alias("problem")
    )
    judged = check_benchmark_datasets(documents.select(F.explode("datasets").alias("d")).select("d.*"))
    rejects = judged.filter("problem IS NOT NULL").select("dataset_id", "problem").unionByName(empty)
    return judged.filter("problem IS NULL").drop("problem"), rejects
