"""Negative-control comparison; metadata only, it never changes a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import labels as L
from siftline.tuning import broadcast_if_small


def background(control_candidates: DataFrame) -> DataFrame:
    """Largest control fraction per (control_id, accession_or_group)."""
    return control_candidates.groupBy("control_id", "accession_or_group").agg(
        F.max("unique_fraction").alias("background_fraction")
    )


def ratio_to_background(fraction: Column, base: Column) -> Column:
    """Fraction over background; infinite for a signal without background."""
    return F.when(base > 0, fraction / base).when(fraction > 0, F.lit(float("inf"))).otherwise(0.0)


def control_status(samples: DataFrame, controls: DataFrame, required: bool = False) -> DataFrame:
    """Per sample: missing, pass or fail. ``samples`` carries a nullable ``control_id``."""
    known = broadcast_if_small(controls.select("control_id", "control_status"))
    return samples.join(known, "control_id", "left").withColumns(
        {
            "negative_control_status": F.when(F.col("control_status").isNull(), "missing")
            .when(F.col("control_status") == "pass", "pass")
            .otherwise("fail"),
            "negative_control_required": F.lit(required),
        }
    )


def _without(reasons: Column, prefixes) -> Column:
    return F.filter(reasons, lambda r: ~_starts_with_any(r, prefixes))


def _starts_with_any(text: Column, prefixes) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | text.startswith(prefix)
    return hit


def background_ratio(calls: DataFrame, sample_controls: DataFrame | None = None, control_background: DataFrame | None = None) -> DataFrame:
    """Fill ``background_ratio`` and its reasons.

    ``sample_controls`` comes from :func:`control_status`; without it every control
    counts as missing. Only a passing control yields a ratio.
    """
    if sample_controls is None:
        status = calls.withColumns(
            {
                "control_id": F.lit(None).cast("string"),
                "control_status": F.lit(None).cast("string"),
                "negative_control_status": F.lit("missing"),
                "background_fraction": F.lit(None).cast("double"),
            }
        )
    else:
        keyed = sample_controls.select("sample_id", "control_id", "control_status", "negative_control_status")
        status = calls.join(broadcast_if_small(keyed), "sample_id", "left").withColumn(
            "negative_control_status", F.coalesce("negative_control_status", F.lit("missing"))
        )
        status = status.join(
            broadcast_if_small(control_background), ["control_id", "accession_or_group"], "left"
        )
    state = F.col("negative_control_status")
    ratio = F.when(
        state == "pass", ratio_to_background(F.col("unique_fraction"), F.col("background_fraction"))
    ).otherwise(0.0)
    notes = F.array_compact(
        F.array(
            F.lit(L.CONTROL_POLICY),
            F.when(state != "missing", F.concat(F.lit("negative_control_id="), F.col("control_id"))),
            F.when(state == "missing", "negative_control_status=missing_metadata_only")
            .when(state == "pass", "negative_control_status=pass_metadata_only")
            .otherwise(F.concat(F.lit("negative_control_status="), F.col("control_status"))),
            F.when(
                state == "pass",
                F.concat(
                    F.lit("background_ratio_metadata_only="),
                    F.when(F.col("background_ratio") == float("inf"), "inf").otherwise(
                        F.format_string("%.6f", "background_ratio")
                    ),
                ),
            ),
        )
    )
    return (
        status.withColumn("background_ratio", ratio)
        .withColumn(
            "decision_reasons", F.concat(_without(F.col("decision_reasons"), L.REPLACED_CONTROL_REASONS), notes)
        )
        .drop("control_id", "control_status", "negative_control_status", "background_fraction")
    )
