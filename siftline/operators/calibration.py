"""Calibration verdicts, gates and confusion metrics over benchmark datasets.

``runs``: dataset_id, expected_outcome, expected_target, decision_status,
release_status, sampled_fragments, qc_passing_fragments. ``calls``: final accession
calls with ``dataset_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: status of a profile whose gates did not all pass.
FAILED_PROFILE = "benchmark_failed"
BACKEND_DETAILS = "single-backend mode: no baseline comparison required"


def dataset_verdicts(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Whether each dataset behaved as expected.

    The top candidate has the most accepted fragments; among ties it is the one
    ranked last by the candidate order.
    """
    by_target = runs.select("dataset_id", "expected_target")
    evidence = (
        calls.join(by_target, "dataset_id")
        .groupBy("dataset_id")
        .agg(
            F.bool_or(
                (F.col("accepted_fragments") > 0)
                & (
                    (F.col("accession_or_group") == F.col("expected_target"))
                    | (F.col("virus_name") == F.col("expected_target"))
                )
            ).alias("_target_seen"),
            F.max(
                F.struct(
                    F.col("accepted_fragments"),
                    -F.col("nonoverlap_fragments"),
                    -F.col("breadth"),
                    F.col("accession_or_group"),
                )
            )["accession_or_group"].alias("top_candidate"),
        )
    )
    positive = F.col("decision_status") == "positive"
    signal = F.col("decision_status").isin("positive", "weak_positive")
    detected = F.when(F.col("expected_target").isNull(), positive).otherwise(
        F.coalesce("_target_seen", F.lit(False))
    )
    return (
        runs.join(evidence, "dataset_id", "left")
        .withColumn("detected_expected_target", detected)
        .withColumn(
            "matched_expectation",
            F.when(F.col("expected_outcome") == "negative", ~positive).otherwise(
                signal & F.col("detected_expected_target")
            ),
        )
        .drop("_target_seen")
    )


def _counts(verdicts: DataFrame) -> DataFrame:
    negative = F.col("expected_outcome") == "negative"
    spike = F.col("expected_outcome") == "spike_in"
    return verdicts.agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(negative).alias("negative_samples"),
        F.count_if(negative & (F.col("decision_status") == "positive")).alias("false_positives"),
        F.count_if(spike).alias("spike_in_total"),
        F.count_if(spike & F.col("matched_expectation")).alias("spike_in_detected"),
        F.count_if(F.col("release_status").isin("blocked", "provisional")).alias("non_final_runs"),
    )


def _specificity() -> Column:
    n, fp = F.col("negative_samples"), F.col("false_positives")
    status = F.when((n > 0) & (fp == 0), "pass").otherwise("fail")
    details = (
        F.when(n == 0, "No negative benchmark datasets were provided for specificity evaluation")
        .when(fp == 0, F.format_string("All %d negative benchmark datasets remained non-positive", n))
        .otherwise(
            F.format_string("Observed %d false-positive calls across %d negative benchmark datasets", fp, n)
        )
    )
    return F.struct(status.alias("status"), details.alias("details"), n.alias("negative_samples"), fp.alias("false_positives"))


def _sensitivity() -> Column:
    total, found = F.col("spike_in_total"), F.col("spike_in_detected")
    status = F.when((total > 0) & (found == total), "pass").otherwise("fail")
    details = (
        F.when(total == 0, "No spike-in benchmark datasets were provided for sensitivity evaluation")
        .when(found == total, F.format_string("Detected all %d/%d spike-in benchmark datasets", found, total))
        .otherwise(F.format_string("Detected %d/%d spike-in benchmark datasets", found, total))
    )
    return F.struct(
        status.alias("status"), details.alias("details"), found.alias("spike_in_detected"), total.alias("spike_in_total")
    )


def specificity_gate(verdicts: DataFrame) -> DataFrame:
    return _counts(verdicts).select(_specificity().alias("g")).select("g.*")


def sensitivity_gate(verdicts: DataFrame) -> DataFrame:
    return _counts(verdicts).select(_sensitivity().alias("g")).select("g.*")


def profile_gate(verdicts: DataFrame, bundle_version: str, profile_status: str = "release_candidate") -> DataFrame:
    """All four gates as structs, and the resulting profile status."""
    runs, held = F.col("runs"), F.col("non_final_runs")
    bundle = F.lit(bundle_version)
    reference = F.when(
        held == 0,
        F.format_string("All %d benchmark runs were executed against reference bundle `%s`", runs, bundle),
    ).otherwise(
        F.format_string(
            "All %d benchmark runs were bound to reference bundle `%s`; %d run(s) remained non-final "
            "(`provisional` or `blocked`) as expected because calibration benchmark executions do not "
            "provide qualified negative-control release evidence",
            runs,
            bundle,
            held,
        )
    )
    passed = lambda details: F.struct(F.lit("pass").alias("status"), details.alias("details"))
    gates = _counts(verdicts).select(
        passed(F.lit(BACKEND_DETAILS)).alias("backend_gate"),
        passed(reference).alias("reference_gate"),
        _specificity().alias("specificity_gate"),
        _sensitivity().alias("sensitivity_gate"),
    )
    all_pass = (F.col("specificity_gate.status") == "pass") & (F.col("sensitivity_gate.status") == "pass")
    return gates.withColumn("profile_status", F.when(all_pass, profile_status).otherwise(FAILED_PROFILE))


def benchmark_summary(verdicts: DataFrame) -> DataFrame:
    """The ten summary columns in order."""
    return verdicts.select(
        "dataset_id",
        "expected_outcome",
        F.coalesce("expected_target", F.lit("")).alias("expected_target"),
        "decision_status",
        "release_status",
        "matched_expectation",
        "detected_expected_target",
        "sampled_fragments",
        "qc_passing_fragments",
        F.coalesce("top_candidate", F.lit("")).alias("top_candidate"),
    )


def confusion_metrics(calls: DataFrame) -> DataFrame:
    """Confusion counts overall (null virus) and per virus.

    Input: virus_name, truth, decision, release_status. A weak positive counts as
    detected for true positives; only ``positive`` is a false positive.
    """
    truth, status = F.col("truth"), F.col("decision")
    positive, negative = truth == "positive", truth == "negative"
    detected = status.isin("positive", "weak_positive")
    share = lambda misses, total: F.when(total > 0, 1.0 - misses / total)
    counted = calls.groupingSets([[], [F.col("virus_name")]], F.col("virus_name")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(negative).alias("negatives"),
        F.count_if(positive).alias("positives"),
        F.count_if(positive & detected).alias("true_positives"),
        F.count_if(negative & (status == "positive")).alias("false_positives"),
        F.count_if(negative & (status != "positive")).alias("true_negatives"),
        F.count_if(positive & ~detected).alias("false_negatives"),
        F.count_if(status == "weak_positive").alias("weak_positive_count"),
        F.count_if(status == "indeterminate").alias("indeterminate_count"),
        F.count_if(F.col("release_status") == "final").alias("final_count"),
        F.count_if(F.col("release_status") == "provisional").alias("provisional_count"),
        F.count_if(F.col("release_status") == "blocked").alias("blocked_count"),
    )
    return counted.withColumns(
        {
            "specificity": share(F.col("false_positives"), F.col("negatives")),
            "sensitivity": share(F.col("false_negatives"), F.col("positives")),
        }
    )
