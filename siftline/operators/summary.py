"""Report summaries over evaluated calls (accession and group rows together)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.ranking import decision_rank, evidence_rank
from siftline.functions.text import sample_name


def _last_value(key: str, allow_empty: bool = False) -> Column:
    """Value of the last ``key=value`` reason; empty values do not count unless allowed."""
    prefix = key + "="
    keep = (lambda r: r.startswith(prefix)) if allow_empty else (lambda r: r.startswith(prefix) & (r != prefix))
    found = F.filter("decision_reasons", keep)
    last = F.try_element_at(found, F.lit(-1))
    return F.substring(last, F.lit(len(prefix) + 1), F.length(last))


def reason_metadata(calls: DataFrame) -> DataFrame:
    """Add the level and supporting accession that the reasons declare."""
    level = F.when(_last_value("aggregation_level", allow_empty=True) == "group", "group").otherwise("accession")
    return calls.withColumns(
        {
            "summary_level": level,
            "supporting_accession": _last_value("supporting_accession"),
            "supporting_accession_name": _last_value("supporting_accession_name"),
        }
    )


def _weakness() -> Column:
    """Strength order as a struct: the smallest is the strongest call."""
    return F.struct(
        (-decision_rank(F.col("decision"))).alias("w1"),
        (-evidence_rank(F.col("evidence_strength"))).alias("w2"),
        (-F.col("unique_fraction")).alias("w3"),
        (-F.col("breadth")).alias("w4"),
        (-F.col("accepted_fragments")).alias("w5"),
        F.col("accession_or_group").alias("w6"),
    )


def strength_rank(rows: DataFrame, entity: str = "accession_or_group", by=("sample_id",), name: str = "rank") -> DataFrame:
    """Dense 1..n, strongest first."""
    order = Window.partitionBy(*by).orderBy(
        decision_rank(F.col("decision")).desc(),
        evidence_rank(F.col("evidence_strength")).desc(),
        F.desc("unique_fraction"),
        F.desc("breadth"),
        F.desc("accepted_fragments"),
        F.asc(entity),
    )
    return rows.withColumn(name, F.row_number().over(order))


_SUMMED = (
    "accepted_fragments",
    "nonoverlap_fragments",
    "coverage_interval_blocks",
    "ambiguous_fragments",
    "raw_fraction",
    "unique_fraction",
)
_REPRESENTATIVE = (
    "virus_name",
    "taxid",
    "decision",
    "evidence_strength",
    "nonoverlap_fragments_algorithm",
    "accepted_fraction_label",
    "unique_fraction_label",
    "fraction_denominator_source",
    "multiplicity_family",
)


def virus_summary(calls: DataFrame) -> DataFrame:
    """One ranked row per (sample, level, entity).

    The strongest row per support key contributes the numbers; reasons and the
    supporting-accession count come from every row.
    """
    rows = reason_metadata(calls).withColumn("_weakness", _weakness())
    entity = ["sample_id", "summary_level", "accession_or_group"]
    support_key = F.when(
        F.col("summary_level") == "group", F.coalesce("supporting_accession", "accession_or_group")
    ).otherwise(F.col("accession_or_group"))
    payload = F.struct(
        F.col("_weakness"),
        *[F.col(c) for c in _SUMMED],
        *[F.col(c) for c in _REPRESENTATIVE],
        F.col("fraction_ci_95_low"),
        F.col("fraction_ci_95_high"),
        F.col("clopper_pearson_upper"),
        F.col("total_sampled_fragments"),
        F.col("breadth"),
        F.col("supporting_accession"),
        F.col("supporting_accession_name"),
    )
    per_support = (
        rows.withColumn("_support", support_key)
        .groupBy(*entity, "_support")
        .agg(
            F.min(payload).alias("s"),
            F.max("supporting_accession").alias("_accession"),
            F.array_distinct(F.flatten(F.collect_list("decision_reasons"))).alias("_reasons"),
        )
    )
    s = F.col("s")
    # Equally strong support keys: the last key by name represents the entity.
    strength = F.struct(*[(-s["_weakness"][f"w{i}"]).alias(f"s{i}") for i in range(1, 6)])
    ranked = F.struct(strength.alias("strength"), F.col("_support"), s.alias("s"))
    merged = per_support.groupBy(*entity).agg(
        F.max(ranked)["s"].alias("rep"),
        F.max(F.when(s["supporting_accession"].isNotNull(), ranked))["s"].alias("top"),
        *[F.sum(s[c]).alias(c) for c in _SUMMED],
        F.min(s["fraction_ci_95_low"]).alias("fraction_ci_95_low"),
        F.max(s["fraction_ci_95_high"]).alias("fraction_ci_95_high"),
        F.greatest(F.max(s["clopper_pearson_upper"]), F.lit(0.0)).alias("clopper_pearson_upper"),
        F.max(s["total_sampled_fragments"]).alias("total_sampled_fragments"),
        F.greatest(F.max(s["breadth"]), F.lit(0.0)).alias("breadth"),
        # A support key is its accession, so keys with one count accessions.
        F.count("_accession").alias("_accession_count"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("_reasons")))).alias("decision_reasons"),
    )
    rep, top, is_group = F.col("rep"), F.col("top"), F.col("summary_level") == "group"
    shaped = merged.select(
        "sample_id",
        F.col("accession_or_group").alias("entity_id"),
        rep["virus_name"].alias("entity_name"),
        F.col("summary_level").alias("entity_type"),
        rep["taxid"].alias("taxid"),
        F.col("summary_level").alias("aggregation_level"),
        rep["decision"].alias("decision"),
        rep["evidence_strength"].alias("evidence_strength"),
        "accepted_fragments",
        "nonoverlap_fragments",
        "coverage_interval_blocks",
        rep["nonoverlap_fragments_algorithm"].alias("nonoverlap_fragments_algorithm"),
        "ambiguous_fragments",
        "raw_fraction",
        "unique_fraction",
        rep["accepted_fraction_label"].alias("accepted_fraction_label"),
        rep["unique_fraction_label"].alias("unique_fraction_label"),
        "fraction_ci_95_low",
        "fraction_ci_95_high",
        "clopper_pearson_upper",
        "total_sampled_fragments",
        rep["fraction_denominator_source"].alias("fraction_denominator_source"),
        "breadth",
        rep["multiplicity_family"].alias("multiplicity_family"),
        F.when(is_group, F.coalesce(top["supporting_accession"], F.lit(""))).otherwise(F.col("accession_or_group")).alias("top_accession"),
        F.when(is_group, F.coalesce(top["supporting_accession_name"], F.lit(""))).otherwise(rep["virus_name"]).alias("top_accession_name"),
        F.when(is_group, F.col("_accession_count")).otherwise(1).cast("bigint").alias("supporting_accession_count"),
        "decision_reasons",
    )
    return strength_rank(shaped, entity="entity_id")


def _primary_level() -> Column:
    """Group rows where a sample has any, else its accession rows."""
    return F.max(F.col("aggregation_level") == "group").over(Window.partitionBy("sample_id"))


def primary_detection_rows(calls: DataFrame) -> DataFrame:
    return (
        calls.withColumn("_grouped", _primary_level())
        .filter((F.col("aggregation_level") == "group") == F.col("_grouped"))
        .drop("_grouped")
    )


def top_results(calls: DataFrame) -> DataFrame:
    """Ranked detections and accession evidence as one long table (column ``list``)."""
    detections = primary_detection_rows(calls).withColumn("list", F.lit("top_detections"))
    accessions = calls.filter("aggregation_level = 'accession'").withColumn("list", F.lit("top_accession_evidence"))
    return strength_rank(detections.unionByName(accessions), by=("sample_id", "list")).select(
        "sample_id",
        "list",
        "rank",
        F.col("accession_or_group").alias("entity_id"),
        F.col("virus_name").alias("entity_name"),
        "aggregation_level",
        "decision",
        "evidence_strength",
        "accepted_fragments",
        "unique_fraction",
        "breadth",
    )


def entity_counts(calls: DataFrame) -> DataFrame:
    """Entities per decision and sample, on the primary level.

    Both levels are counted in one pass and the level chosen afterwards.
    """
    level, status = F.col("aggregation_level"), F.col("decision")
    names = ("positive", "indeterminate", "negative", "weak_positive")
    counted = calls.groupBy("sample_id").agg(
        F.count_if(level == "group").alias("_groups"),
        *[F.count_if((level == lv) & (status == s)).alias(f"_{lv}_{s}") for lv in ("group", "accession") for s in names],
    )
    pick = lambda s: F.when(F.col("_groups") > 0, F.col(f"_group_{s}")).otherwise(F.col(f"_accession_{s}"))
    return counted.select("sample_id", *[pick(s).alias(f"{s}_entity_count") for s in names])


def sample_run_summary(summary: DataFrame, calls: DataFrame) -> DataFrame:
    """Run facts joined with entity counts; samples without calls count zero."""
    counts = entity_counts(calls)
    joined = summary.join(counts, "sample_id", "left")
    names = [c for c in counts.columns if c != "sample_id"]
    return joined.select(*summary.columns, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names])


def run_summary(decisions: DataFrame, qc: DataFrame, run, plan, input_path: Column | None = None) -> DataFrame:
    """One row per sample with versions, counts and the decision."""
    joined = decisions.join(
        qc.select(
            "sample_id",
            F.col("total_fragments").alias("input_fragments"),
            F.col("passed_fragments").alias("qc_passing_fragments"),
        ),
        "sample_id",
        "left",
    )
    if input_path is not None:
        joined = joined.withColumn("sample_id", sample_name(input_path))
    return joined.select(
        "sample_id",
        F.lit(run.reference_bundle_version).alias("reference_bundle_version"),
        F.lit(run.calibration_profile_version).alias("calibration_profile_version"),
        F.lit(run.backend).alias("backend"),
        F.lit(plan.seed).cast("bigint").alias("seed"),
        F.lit(plan.mode).alias("sampling_mode"),
        F.lit(run.profile_status).alias("profile_status"),
        F.coalesce("input_fragments", F.lit(0)).alias("input_fragments"),
        F.coalesce("qc_passing_fragments", F.lit(0)).alias("qc_passing_fragments"),
        "sampled_fragments",
        F.col("rounds_run").cast("bigint").alias("rounds_run"),
        "stop_reason",
        "decision_status",
    )
