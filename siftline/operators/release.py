"""Release gate: blockers and status per run.

Input columns: ``profile_status``, ``negative_control_status``, ``gates`` (nullable
struct of the four calibration gates), ``sampling_mode``, ``decision_status``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: profile status that blocks release.
FAILED_PROFILE = "benchmark_failed"


def release_blockers(rejects: bool = False) -> tuple[Column, Column]:
    """(primary, secondary) blocker arrays; with ``rejects``, runs whose ``rejected_hits`` is positive are blocked."""
    gates = F.col("gates")
    failed = lambda name: F.coalesce(gates[f"{name}_gate"]["status"] == "fail", F.lit(False))
    primary = F.array_compact(
        F.array(
            F.when(F.lower(F.trim("profile_status")) == FAILED_PROFILE, "benchmark_failed_profile"),
            F.when(F.col("negative_control_status") == "fail", "failed_negative_control"),
            F.when(gates.isNull(), "missing_calibration_release_gate"),
            *([F.when(F.col("rejected_hits") > 0, "rejected_hits")] if rejects else []),
            *[
                F.when(failed(name), f"{name}_gate_failed")
                for name in ("backend", "reference", "specificity", "sensitivity")
            ],
        )
    )
    secondary = F.array_compact(
        F.array(F.when(F.col("sampling_mode") != "representative", "non_representative_sampling_mode"))
    )
    return primary, secondary


def release_status(runs: DataFrame) -> DataFrame:
    """Add ``release_status`` and both blocker arrays.

    A weak positive may not be released as final.
    """
    primary, secondary = release_blockers("rejected_hits" in runs.columns)
    marked = runs.withColumns({"release_primary_blockers": primary, "release_secondary_blockers": secondary})
    status = (
        F.when(F.size("release_primary_blockers") > 0, "blocked")
        .when(F.size("release_secondary_blockers") > 0, "provisional")
        .otherwise("final")
    )
    held = (F.col("release_status") == "final") & F.coalesce(F.col("decision_status") == "weak_positive", F.lit(False))
    return (
        marked.withColumn("release_status", status)
        .withColumn("_held", held)
        .withColumn("release_status", F.when(F.col("_held"), "provisional").otherwise(F.col("release_status")))
        .withColumn(
            "release_secondary_blockers",
            F.when(
                F.col("_held"),
                F.concat("release_secondary_blockers", F.array(F.lit("weak_positive_requires_provisional_release"))),
            ).otherwise(F.col("release_secondary_blockers")),
        )
        .drop("_held")
    )
