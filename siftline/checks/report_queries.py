"""Registered queries for controls, release, calibration, summaries, audit, panel and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline import adapters as A
from siftline import labels as L
from siftline.checks import oracle as O
from siftline.checks.queries import (
    _KEY,
    _KEY_COLUMNS,
    _R,
    calls,
    evaluated,
    look_calls,
    looks,
    query,
    r9,
    table,
)
from siftline.checks.settings import CANDIDATE, DECISION, PLAN, PROFILE, QC
from siftline.functions.text import normalize_qname
from siftline.operators import audit, calibration, control, decision, hits, minimizers, panel, qc, release, sampling, summary
from siftline.plans import screen
from siftline.sources import documents, fasta, fastq, sinks
from siftline.tuning import settle, shared_folder


def final_calls(spark, sf, reasons=False) -> DataFrame:
    rows = settle(evaluated(spark, sf, reasons))
    return decision.final_calls(rows, decision.decide(rows, PLAN.look_count, DECISION))


# ---- decisions: reason trail and input-order looks ---------------------------------


def _reason_sql() -> str:
    gate = lambda label, test: f"'{label}' || CASE WHEN {test} THEN '_pass' ELSE '_fail' END"
    sci = lambda v: f"regexp_replace(format('{{:.12e}}', {v}), 'e([-]?)[+]?0*([0-9])', 'e\\1\\2')"
    return f"""concat_ws('|', 'fraction_ci_95_label={L.CI_LABEL}', 'negative_control_status=missing_metadata_only',
      {gate('unique_fraction_above_theta_pos', 'g_abundance')}, {gate('accepted_fragments_meet_theta_pos_absolute', 'g_absolute')},
      {gate('nonoverlap_fragments_meet_minimum', 'g_nonoverlap')}, {gate('breadth_meets_minimum', 'g_breadth')},
      'negative_control_policy=not_used_for_default_background_assessment', {gate('ambiguity_fraction_below_positive_limit', 'g_ambiguity')},
      CASE WHEN g_ambiguity THEN 'no_strong_host_explanation' ELSE 'strong_host_explanation_present' END,
      {gate('evidence_strength_meets_positive_minimum', 'g_evidence')}, {gate('positive_enrichment_p_value', 'g_enrichment')},
      'positive_statistic_method=exact_binomial_survival_bonferroni', 'positive_corrected_alpha=' || {sci('alpha')},
      'total_sampled_fragments=' || total, 'candidate_family_size=' || family, 'multiplicity_family=' || level, 'aggregation_level=' || level,
      'nonoverlap_fragments_algorithm=max_nonoverlapping_intervals_v1', 'coverage_interval_blocks=' || blocks,
      'accepted_fraction_label=accepted_fragments_per_sampled_fragment', 'unique_fraction_label=legacy_alias_not_molecule_unique',
      'fraction_denominator_source=sampled_fragments', 'planned_round_look_count={PLAN.look_count}', 'current_look_index=' || round,
      'sequential_look_correction=bonferroni', 'theta_neg_operational=' || {sci(f'{DECISION.theta_neg_operational!r}::DOUBLE')},
      CASE WHEN fraction <= {DECISION.theta_neg_operational!r} THEN 'unique_fraction_below_theta_neg'
           WHEN fraction > {DECISION.theta_pos!r} THEN 'unique_fraction_above_theta_pos' ELSE 'unique_fraction_between_boundaries' END,
      CASE WHEN NOT g_ambiguity THEN 'high_candidate_ambiguity_present' END, 'accession_resolution=' || resolution,
      CASE WHEN level = 'group' THEN 'positive_boundary_level=group' END,
      CASE WHEN level = 'group' AND NOT g_ambiguity THEN 'ambiguity_not_used_as_group_detection_veto' END,
      CASE WHEN level = 'group' THEN CASE WHEN can_stop THEN 'group_positive_identity_continuity_pass' ELSE 'group_positive_identity_continuity_pending' END END)"""


@query("decision_reason_trail", O.sampled(f"SELECT {_KEY}, {_reason_sql()} AS decision_reasons FROM continued"))
def decision_reason_trail(spark, sf):
    # The p-value's twelfth decimal depends on summation order; its own query compares it.
    kept = F.filter("decision_reasons", lambda r: ~r.startswith("positive_p_value="))
    rows = evaluated(spark, sf, reasons=True).filter("aggregation_level IS NOT NULL")
    return rows.select(*_KEY_COLUMNS, F.array_join(kept, "|").alias("decision_reasons"))


@query(
    "input_order_decisions",
    O.in_input_order(
        """SELECT sample_id, rounds_run::INT AS rounds_run, sampled AS sampled_fragments, accepted AS accepted_virus, status AS decision_status, stop AS stop_reason FROM decisions"""
    ),
)
def input_order_decisions(spark, sf):
    entered = sampling.prefix_entry_round(table(spark, sf, A.HIT_FRAGMENTS), "record_number", PLAN.rounds)
    rows = screen.look_calls(table(spark, sf, A.HITS), table(spark, sf, A.MANIFEST), entered, PROFILE)
    ready = screen.evaluated_looks(rows, PROFILE, reasons=False)
    return decision.sample_decisions(decision.decide(ready, PLAN.look_count, DECISION))


# ---- negative controls -------------------------------------------------------------

_BACKGROUND = f"""SELECT control_id, accession_or_group, max(unique_fraction) AS background_fraction FROM ({A.plain_sql(A.CONTROL_CANDIDATES)}) c GROUP BY 1, 2"""
_STATUS = f"""SELECT s.sample_id, s.control_id, c.control_status, CASE WHEN c.control_status IS NULL THEN 'missing' WHEN c.control_status = 'pass' THEN 'pass' ELSE 'fail' END AS status
    FROM ({A.plain_sql(A.SAMPLE_CONTROLS)}) s LEFT JOIN ({A.plain_sql(A.CONTROLS)}) c USING (control_id)"""


@query("control_background", _BACKGROUND)
def control_background(spark, sf):
    return control.background(table(spark, sf, A.CONTROL_CANDIDATES))


def _controls(spark, sf):
    return control.control_status(table(spark, sf, A.SAMPLE_CONTROLS), table(spark, sf, A.CONTROLS))


@query(
    "background_ratios",
    O.whole(
        f"""SELECT c.sample_id, c.level AS aggregation_level, c.id AS accession_or_group,
        round(CASE WHEN s.status <> 'pass' THEN 0 WHEN b.background_fraction > 0 THEN c.fraction / b.background_fraction WHEN c.fraction > 0 THEN -1 ELSE 0 END, 9) AS background_ratio
        FROM calls c LEFT JOIN ({_STATUS}) s ON s.sample_id = c.sample_id
        LEFT JOIN ({_BACKGROUND}) b ON b.control_id = s.control_id AND b.accession_or_group = c.id"""
    ),
)
def background_ratios(spark, sf):
    rows = control.background_ratio(calls(spark, sf), _controls(spark, sf), control_background(spark, sf))
    ratio = F.col("background_ratio")
    shown = F.when(ratio == float("inf"), -1.0).otherwise(ratio)
    return rows.select("sample_id", "aggregation_level", "accession_or_group", r9(shown, "background_ratio"))


@query(
    "control_statuses",
    f"SELECT sample_id, control_id, coalesce(control_status, '') AS control_status, status AS negative_control_status FROM ({_STATUS}) s",
)
def control_statuses(spark, sf):
    return _controls(spark, sf).select(
        "sample_id", "control_id", F.coalesce("control_status", F.lit("")).alias("control_status"), "negative_control_status"
    )


@query(
    "control_source_checks",
    """SELECT control_id, CASE WHEN trim(control_id) = '' THEN 'empty_control_id' WHEN trim(control_status) = '' THEN 'empty_control_status'
        WHEN trim(name) = '' THEN 'empty_candidate' WHEN value < 0 THEN 'invalid_fraction' ELSE '' END AS problem
       FROM (SELECT CASE WHEN event_id % 50 = 0 THEN ' ' ELSE 'c-' || event_id END AS control_id,
                    CASE WHEN user_id % 20 = 0 THEN '' ELSE 'pass' END AS control_status,
                    CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END AS name,
                    value - 5 AS value FROM events) e""",
)
def control_source_checks(spark, sf):
    event = F.col("event_id")
    rows = A.read_table(spark, sf, "events").select(
        F.when(event % 50 == 0, " ").otherwise(F.concat(F.lit("c-"), event.cast("string"))).alias("control_id"),
        F.when(F.col("user_id") % 20 == 0, "").otherwise("pass").alias("control_status"),
        F.array(
            F.struct(
                F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("accession_or_group"),
                (F.col("value") - 5).alias("unique_fraction"),
            )
        ).alias("candidates"),
    )
    good, bad = documents.check_negative_controls(rows)
    return good.select("control_id", F.lit("").alias("problem")).unionByName(bad.select("control_id", "problem"))


# ---- release -----------------------------------------------------------------------

_BLOCKERS = """concat_ws(',', CASE WHEN lower(trim(profile_status)) = 'benchmark_failed' THEN 'benchmark_failed_profile' END,
    CASE WHEN negative_control_status = 'fail' THEN 'failed_negative_control' END,
    CASE WHEN gates_missing THEN 'missing_calibration_release_gate' END,
    CASE WHEN NOT gates_missing AND backend_status = 'fail' THEN 'backend_gate_failed' END,
    CASE WHEN NOT gates_missing AND reference_status = 'fail' THEN 'reference_gate_failed' END,
    CASE WHEN NOT gates_missing AND specificity_status = 'fail' THEN 'specificity_gate_failed' END,
    CASE WHEN NOT gates_missing AND sensitivity_status = 'fail' THEN 'sensitivity_gate_failed' END)"""
_RELEASED = f"""SELECT *, CASE WHEN primary_blockers <> '' THEN 'blocked' WHEN mode_blocker <> '' THEN 'provisional'
      WHEN decision_status = 'weak_positive' THEN 'provisional' ELSE 'final' END AS release_status,
    CASE WHEN primary_blockers = '' AND mode_blocker = '' AND decision_status = 'weak_positive' THEN 'weak_positive_requires_provisional_release' ELSE mode_blocker END AS secondary_blockers
    FROM (SELECT *, {_BLOCKERS} AS primary_blockers,
            CASE WHEN sampling_mode <> 'representative' THEN 'non_representative_sampling_mode' ELSE '' END AS mode_blocker
          FROM ({A.plain_sql(A.RUNS)}) r) b"""


def _runs(spark, sf) -> DataFrame:
    gate = lambda name: F.struct(F.col(f"{name}_status").alias("status")).alias(f"{name}_gate")
    gates = F.struct(*[gate(n) for n in ("backend", "reference", "specificity", "sensitivity")])
    return table(spark, sf, A.RUNS).withColumn("gates", F.when(~F.col("gates_missing"), gates))


@query(
    "release_blockers",
    f"SELECT sample_id, primary_blockers, mode_blocker AS secondary_blockers FROM ({_RELEASED}) r",
)
def release_blockers(spark, sf):
    primary, secondary = release.release_blockers()
    return _runs(spark, sf).select(
        "sample_id", F.array_join(primary, ",").alias("primary_blockers"), F.array_join(secondary, ",").alias("secondary_blockers")
    )


@query("release_statuses", f"SELECT sample_id, release_status, primary_blockers, secondary_blockers FROM ({_RELEASED}) r")
def release_statuses(spark, sf):
    return release.release_status(_runs(spark, sf)).select(
        "sample_id",
        "release_status",
        F.array_join("release_primary_blockers", ",").alias("primary_blockers"),
        F.array_join("release_secondary_blockers", ",").alias("secondary_blockers"),
    )


# ---- calibration -------------------------------------------------------------------

_VERDICTS = f"""SELECT *, CASE WHEN expected_outcome = 'negative' THEN decision_status <> 'positive'
      ELSE decision_status IN ('positive', 'weak_positive') AND detected_expected_target END AS matched_expectation
    FROM (SELECT d.*, CASE WHEN d.expected_target IS NULL THEN d.decision_status = 'positive' ELSE coalesce(e.seen, false) END AS detected_expected_target,
            coalesce(t.accession_or_group, '') AS top_candidate
          FROM ({A.plain_sql(A.DATASETS)}) d
          LEFT JOIN (SELECT c.dataset_id, bool_or(c.accepted_fragments > 0 AND (c.accession_or_group = x.expected_target OR c.virus_name = x.expected_target)) AS seen
                     FROM ({A.plain_sql(A.DATASET_CALLS)}) c JOIN ({A.plain_sql(A.DATASETS)}) x USING (dataset_id) GROUP BY 1) e USING (dataset_id)
          LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY accepted_fragments DESC, nonoverlap_fragments, breadth, accession_or_group DESC) AS rn
                     FROM ({A.plain_sql(A.DATASET_CALLS)}) c) r WHERE rn = 1) t USING (dataset_id)) v"""
_GATE_COUNTS = f"""SELECT count(*) AS runs, count(*) FILTER (expected_outcome = 'negative') AS negatives,
    count(*) FILTER (expected_outcome = 'negative' AND decision_status = 'positive') AS fp,
    count(*) FILTER (expected_outcome = 'spike_in') AS spikes, count(*) FILTER (expected_outcome = 'spike_in' AND matched_expectation) AS found,
    count(*) FILTER (release_status IN ('blocked', 'provisional')) AS held FROM ({_VERDICTS}) v"""


def _dataset_verdicts(spark, sf):
    return calibration.dataset_verdicts(table(spark, sf, A.DATASETS), table(spark, sf, A.DATASET_CALLS))


@query(
    "dataset_verdicts",
    f"SELECT dataset_id, matched_expectation, detected_expected_target, top_candidate FROM ({_VERDICTS}) v",
)
def dataset_verdicts(spark, sf):
    return _dataset_verdicts(spark, sf).select(
        "dataset_id", "matched_expectation", "detected_expected_target", F.coalesce("top_candidate", F.lit("")).alias("top_candidate")
    )


@query(
    "specificity_gate",
    f"""SELECT CASE WHEN negatives > 0 AND fp = 0 THEN 'pass' ELSE 'fail' END AS status,
        CASE WHEN negatives = 0 THEN 'No negative benchmark datasets were provided for specificity evaluation'
             WHEN fp = 0 THEN 'All ' || negatives || ' negative benchmark datasets remained non-positive'
             ELSE 'Observed ' || fp || ' false-positive calls across ' || negatives || ' negative benchmark datasets' END AS details,
        negatives AS negative_samples, fp AS false_positives FROM ({_GATE_COUNTS}) g""",
)
def specificity_gate(spark, sf):
    return calibration.specificity_gate(_dataset_verdicts(spark, sf))


@query(
    "sensitivity_gate",
    f"""SELECT CASE WHEN spikes > 0 AND found = spikes THEN 'pass' ELSE 'fail' END AS status,
        CASE WHEN spikes = 0 THEN 'No spike-in benchmark datasets were provided for sensitivity evaluation'
             WHEN found = spikes THEN 'Detected all ' || found || '/' || spikes || ' spike-in benchmark datasets'
             ELSE 'Detected ' || found || '/' || spikes || ' spike-in benchmark datasets' END AS details,
        found AS spike_in_detected, spikes AS spike_in_total FROM ({_GATE_COUNTS}) g""",
)
def sensitivity_gate(spark, sf):
    return calibration.sensitivity_gate(_dataset_verdicts(spark, sf))


@query(
    "profile_gate",
    f"""SELECT 'pass' AS backend_status, 'pass' AS reference_status,
        CASE WHEN held = 0 THEN 'All ' || runs || ' benchmark runs were executed against reference bundle `bundle-1`'
          ELSE 'All ' || runs || ' benchmark runs were bound to reference bundle `bundle-1`; ' || held || ' run(s) remained non-final (`provisional` or `blocked`) as expected because calibration benchmark executions do not provide qualified negative-control release evidence' END AS reference_details,
        CASE WHEN negatives > 0 AND fp = 0 AND spikes > 0 AND found = spikes THEN 'release_candidate' ELSE 'benchmark_failed' END AS profile_status
        FROM ({_GATE_COUNTS}) g""",
)
def profile_gate(spark, sf):
    return calibration.profile_gate(_dataset_verdicts(spark, sf), "bundle-1").select(
        F.col("backend_gate.status").alias("backend_status"),
        F.col("reference_gate.status").alias("reference_status"),
        F.col("reference_gate.details").alias("reference_details"),
        "profile_status",
    )


@query(
    "benchmark_summary",
    f"""SELECT dataset_id, expected_outcome, coalesce(expected_target, '') AS expected_target, decision_status, release_status,
        matched_expectation, detected_expected_target, sampled_fragments, qc_passing_fragments, top_candidate FROM ({_VERDICTS}) v""",
)
def benchmark_summary(spark, sf):
    return calibration.benchmark_summary(_dataset_verdicts(spark, sf))


@query(
    "confusion_metrics",
    f"""SELECT coalesce(virus_name, '*') AS virus_name, count(*) AS total, count(*) FILTER (truth = 'negative') AS negatives, count(*) FILTER (truth = 'positive') AS positives,
        count(*) FILTER (truth = 'positive' AND decision IN ('positive', 'weak_positive')) AS true_positives,
        count(*) FILTER (truth = 'negative' AND decision = 'positive') AS false_positives,
        count(*) FILTER (truth = 'negative' AND decision <> 'positive') AS true_negatives,
        count(*) FILTER (truth = 'positive' AND decision IN ('negative', 'indeterminate')) AS false_negatives,
        count(*) FILTER (decision = 'weak_positive') AS weak_positive_count, count(*) FILTER (decision = 'indeterminate') AS indeterminate_count,
        count(*) FILTER (release_status = 'final') AS final_count, count(*) FILTER (release_status = 'provisional') AS provisional_count,
        count(*) FILTER (release_status = 'blocked') AS blocked_count,
        coalesce(round(1 - count(*) FILTER (truth = 'negative' AND decision = 'positive') / nullif(count(*) FILTER (truth = 'negative'), 0), 9), -1) AS specificity,
        coalesce(round(1 - count(*) FILTER (truth = 'positive' AND decision IN ('negative', 'indeterminate')) / nullif(count(*) FILTER (truth = 'positive'), 0), 9), -1) AS sensitivity
        FROM ({A.plain_sql(A.LABELLED)}) l GROUP BY GROUPING SETS ((), (virus_name))""",
)
def confusion_metrics(spark, sf):
    rows = calibration.confusion_metrics(table(spark, sf, A.LABELLED))
    shown = lambda c: F.coalesce(F.round(F.col(c), 9), F.lit(-1.0))
    return rows.withColumns(
        {
            "virus_name": F.coalesce("virus_name", F.lit("*")),
            "specificity": shown("specificity"),
            "sensitivity": shown("sensitivity"),
        }
    )


# ---- summaries ---------------------------------------------------------------------

_DR = "CASE decision WHEN 'positive' THEN 4 WHEN 'weak_positive' THEN 3 WHEN 'indeterminate' THEN 2 ELSE 1 END"
_ER = "CASE strength WHEN 'high' THEN 4 WHEN 'medium' THEN 3 ELSE 2 END"
_STRENGTH = f"{_DR} DESC, {_ER} DESC, fraction DESC, breadth DESC, accepted DESC, id"
_SUPPORTED = """SELECT *, CASE WHEN level = 'group' THEN 'S' || (round % 2) END AS support, CASE WHEN level = 'group' THEN 'N' || round END AS support_name FROM continued"""


def _supported(spark, sf) -> DataFrame:
    """All looks' calls; group rows name a supporting accession."""
    rows = evaluated(spark, sf, reasons=True).filter("aggregation_level IS NOT NULL")
    extra = F.array(
        F.concat(F.lit("supporting_accession=S"), (F.col("round") % 2).cast("string")),
        F.concat(F.lit("supporting_accession_name=N"), F.col("round").cast("string")),
    )
    return rows.withColumn(
        "decision_reasons",
        F.when(F.col("aggregation_level") == "group", F.concat("decision_reasons", extra)).otherwise(F.col("decision_reasons")),
    )


@query(
    "virus_summaries",
    O.sampled(
        f"""SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY {_DR} DESC, {_ER} DESC, fraction DESC, breadth DESC, accepted DESC, id)::INT AS rank,
        id AS entity_id, virus_name AS entity_name, level AS entity_type, taxid, decision, strength AS evidence_strength, accepted AS accepted_fragments,
        nonoverlap AS nonoverlap_fragments, blocks AS coverage_interval_blocks, ambiguous AS ambiguous_fragments, round(fraction, 9) AS unique_fraction,
        total AS total_sampled_fragments, round(breadth, 9) AS breadth, round(cp, 9) AS clopper_pearson_upper, top_accession, top_accession_name, supporting_accession_count
        FROM (SELECT sample_id, level, id, max(virus_name) FILTER (rn2 = 1) AS virus_name, max(taxid) FILTER (rn2 = 1) AS taxid, max(decision) FILTER (rn2 = 1) AS decision,
                max(strength) FILTER (rn2 = 1) AS strength, sum(accepted)::BIGINT AS accepted, sum(nonoverlap)::BIGINT AS nonoverlap, sum(blocks)::BIGINT AS blocks,
                sum(ambiguous)::BIGINT AS ambiguous, sum(fraction) AS fraction, max(total) AS total, max(breadth) AS breadth, max(cp_upper) AS cp,
                CASE WHEN level = 'group' THEN coalesce(max(support) FILTER (rn2 = 1), '') ELSE id END AS top_accession,
                CASE WHEN level = 'group' THEN coalesce(max(support_name) FILTER (rn2 = 1), '') ELSE max(virus_name) FILTER (rn2 = 1) END AS top_accession_name,
                CASE WHEN level = 'group' THEN count(DISTINCT support) ELSE 1 END AS supporting_accession_count
              FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, level, id ORDER BY {_STRENGTH}, coalesce(support, id) DESC) AS rn2
                    FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, level, id, coalesce(support, id) ORDER BY {_STRENGTH}, support_name) AS rn FROM ({_SUPPORTED}) s) a WHERE rn = 1) b
              GROUP BY sample_id, level, id) g"""
    ),
)
def virus_summaries(spark, sf):
    return summary.virus_summary(_supported(spark, sf)).select(
        "sample_id", "rank", "entity_id", "entity_name", "entity_type", "taxid", "decision", "evidence_strength",
        "accepted_fragments", "nonoverlap_fragments", "coverage_interval_blocks", "ambiguous_fragments",
        r9("unique_fraction", "unique_fraction"), "total_sampled_fragments", r9("breadth", "breadth"),
        r9("clopper_pearson_upper", "clopper_pearson_upper"), "top_accession", "top_accession_name", "supporting_accession_count",
    )


@query(
    "strength_ranks",
    O.sampled(f"SELECT {_KEY}, row_number() OVER (PARTITION BY sample_id, round, level ORDER BY {_STRENGTH})::INT AS rank FROM continued"),
)
def strength_ranks(spark, sf):
    rows = evaluated(spark, sf).filter("aggregation_level IS NOT NULL")
    return summary.strength_rank(rows, by=("sample_id", "round", "aggregation_level")).select(*_KEY_COLUMNS, "rank")


@query(
    "top_results",
    O.sampled(
        f"""SELECT sample_id, list, row_number() OVER (PARTITION BY sample_id, list ORDER BY {_STRENGTH})::INT AS rank, id AS entity_id, virus_name AS entity_name, decision,
        strength AS evidence_strength, accepted AS accepted_fragments, round(fraction, 9) AS unique_fraction, round(breadth, 9) AS breadth
        FROM (SELECT *, CASE level WHEN 'group' THEN 'top_detections' ELSE 'top_accession_evidence' END AS list FROM final_calls) f"""
    ),
)
def top_results(spark, sf):
    return summary.top_results(final_calls(spark, sf)).select(
        "sample_id", "list", "rank", "entity_id", "entity_name", "decision", "evidence_strength", "accepted_fragments",
        r9("unique_fraction", "unique_fraction"), r9("breadth", "breadth"),
    )


@query(
    "entity_counts",
    O.sampled(
        """SELECT sample_id, count(*) FILTER (decision = 'positive') AS positive_entity_count, count(*) FILTER (decision = 'indeterminate') AS indeterminate_entity_count,
        count(*) FILTER (decision = 'negative') AS negative_entity_count, count(*) FILTER (decision = 'weak_positive') AS weak_positive_entity_count
        FROM final_calls WHERE level = 'group' GROUP BY sample_id"""
    ),
)
def entity_counts(spark, sf):
    return summary.entity_counts(final_calls(spark, sf))


@query(
    "reason_metadata",
    O.sampled(
        f"""SELECT {_KEY}, level AS summary_level, coalesce(support, '') AS supporting_accession, coalesce(support_name, '') AS supporting_accession_name FROM ({_SUPPORTED}) s"""
    ),
)
def reason_metadata(spark, sf):
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return summary.reason_metadata(_supported(spark, sf)).select(
        *_KEY_COLUMNS, "summary_level", blank("supporting_accession"), blank("supporting_accession_name")
    )


def _hit_counts(spark, sf) -> DataFrame:
    return table(spark, sf, A.HIT_FRAGMENTS).groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("total_fragments"), F.count_if(F.col("record_number") % 10 != 0).alias("passed_fragments")
    )


_RUN_SUMMARY = f"""SELECT d.sample_id, 'bundle-1' AS reference_bundle_version, 'profile-1' AS calibration_profile_version, 'seed-vote' AS backend,
    {PLAN.seed}::BIGINT AS seed, 'representative' AS sampling_mode, 'release_candidate' AS profile_status, q.total AS input_fragments, q.passed AS qc_passing_fragments,
    d.sampled AS sampled_fragments, d.rounds_run::BIGINT AS rounds_run, d.stop AS stop_reason, d.status AS decision_status
    FROM decisions d LEFT JOIN (SELECT sample_id, count(*) AS total, count(*) FILTER (record_number % 10 <> 0) AS passed FROM ({A.plain_sql(A.HIT_FRAGMENTS)}) f GROUP BY 1) q ON q.sample_id = d.sample_id"""


@query("run_summaries", O.sampled(_RUN_SUMMARY))
def run_summaries(spark, sf):
    decided = decision.sample_decisions(looks(spark, sf))
    return summary.run_summary(decided, _hit_counts(spark, sf), PROFILE.run, PLAN)


# ---- sinks -------------------------------------------------------------------------


# Wilson bounds, written out from the counts.
_Z = "1.96"
_WILSON = f"""(accepted + {_Z} * {_Z} / 2) / (total + {_Z} * {_Z}) {{sign}} {_Z} / (total + {_Z} * {_Z})
    * sqrt(accepted * (total - accepted)::DOUBLE / total + {_Z} * {_Z} / 4)"""
_CI_LOW = f"round(greatest({_WILSON.format(sign='-')}, 0), 9) AS fraction_ci_95_low"
_CI_HIGH = f"round(least({_WILSON.format(sign='+')}, 1), 9) AS fraction_ci_95_high"
_CONSTANT_SQL = f"""'{L.NONOVERLAP_ALGORITHM}' AS nonoverlap_fragments_algorithm, '{L.ACCEPTED_FRACTION_LABEL}' AS accepted_fraction_label,
    '{L.UNIQUE_FRACTION_LABEL}' AS unique_fraction_label, '{L.DENOMINATOR_SOURCE}' AS fraction_denominator_source, level AS multiplicity_family"""
_SHARES = ("raw_fraction", "unique_fraction", "clopper_pearson_upper", "breadth")
_SHARES_SQL = "round(fraction, 9) AS raw_fraction, round(fraction, 9) AS unique_fraction, round(cp_upper, 9) AS clopper_pearson_upper, round(breadth, 9) AS breadth"


def _reasons_read(sort: bool = False):
    """Reasons read back from JSON, without the p-value (its twelfth decimal depends on summation order)."""
    read = F.filter(F.from_json("decision_reasons", "array<string>"), lambda r: ~r.startswith("positive_p_value="))
    return F.array_join(F.sort_array(read) if sort else read, "|")


@query(
    "candidate_call_table",
    O.sampled(
        f"""SELECT sample_id, virus_name, taxid, id AS accession_or_group, accepted AS accepted_fragments, nonoverlap AS nonoverlap_fragments, blocks AS coverage_interval_blocks,
        total AS total_sampled_fragments, ambiguous AS ambiguous_fragments, level AS aggregation_level, resolution AS accession_resolution, decision, strength AS evidence_strength,
        {_CI_LOW}, {_CI_HIGH}, {_CONSTANT_SQL}, {_SHARES_SQL}, {_reason_sql()} AS decision_reasons FROM final_calls"""
    ),
)
def candidate_call_table(spark, sf):
    """All columns of the table, its JSON read back."""
    rows = sinks.calls_table(final_calls(spark, sf, reasons=True))
    interval = F.from_json("fraction_ci_95", "array<double>")
    return rows.withColumns(
        {"fraction_ci_95_low": r9(interval[0]), "fraction_ci_95_high": r9(interval[1]), "decision_reasons": _reasons_read(), **{c: r9(c) for c in _SHARES}}
    ).drop("fraction_ci_95")


@query(
    "round_table",
    O.sampled(
        "SELECT sample_id, round::INT AS round, sampled AS sampled_fragments, accepted AS accepted_virus, status AS decision_status FROM kept_looks"
    ),
)
def round_table(spark, sf):
    return sinks.rounds_table(decision.round_records(looks(spark, sf)))


@query(
    "virus_summary_table",
    O.sampled(
        f"""SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY {_STRENGTH})::INT AS rank, id AS entity_id, virus_name AS entity_name, level AS entity_type, taxid,
        level AS aggregation_level, decision, strength AS evidence_strength, accepted AS accepted_fragments, nonoverlap AS nonoverlap_fragments, blocks AS coverage_interval_blocks,
        ambiguous AS ambiguous_fragments, {_CI_LOW}, {_CI_HIGH}, {_CONSTANT_SQL}, {_SHARES_SQL}, total AS total_sampled_fragments,
        CASE WHEN level = 'group' THEN '' ELSE id END AS top_accession, CASE WHEN level = 'group' THEN '' ELSE virus_name END AS top_accession_name,
        CASE WHEN level = 'group' THEN 0 ELSE 1 END::BIGINT AS supporting_accession_count,
        array_to_string(list_sort(list_distinct(string_split({_reason_sql()}, '|'))), '|') AS decision_reasons FROM final_calls"""
    ),
)
def virus_summary_table(spark, sf):
    """All 28 columns of the table, its JSON read back."""
    rows = sinks.virus_summary_table(summary.virus_summary(final_calls(spark, sf, reasons=True)))
    rounded = {c: r9(c) for c in (*_SHARES, "fraction_ci_95_low", "fraction_ci_95_high")}
    return rows.withColumns({**rounded, "decision_reasons": _reasons_read(sort=True)})


@query(
    "coverage_evidence",
    O.sampled(
        """SELECT sample_id, id AS accession_or_group, level || '.' || id || '.coverage.tsv' AS file_name FROM final_calls WHERE decision = 'positive'"""
    ),
)
def coverage_evidence(spark, sf):
    rows, _duplicates = sinks.coverage_index(final_calls(spark, sf, reasons=True))
    return rows.select("sample_id", "accession_or_group", "file_name")


def rejected_counts(spark, sf) -> DataFrame:
    """Hits of sample R that a panel with conflicting contigs does not take."""
    mapped = table(spark, sf, A.HITS).filter("sample_id = 'R'")
    rejected = hits.rejected_hits(mapped, hits.classify_contigs(table(spark, sf, A.CONFLICTED_MANIFEST)))
    return rejected.groupBy("sample_id").agg(F.sum("hits").alias("rejected_hits"))


def passing_gates(spark) -> DataFrame:
    gate = lambda name: F.struct(F.lit("pass").alias("status")).alias(f"{name}_gate")
    return spark.range(1).select(*[gate(n) for n in ("backend", "reference", "specificity", "sensitivity")])


def bundles(spark, sf, released: bool = False) -> DataFrame:
    """Report artifacts of the whole cohort; ``released``: under passing gates, with the rejected hits of one sample, the
    sampling accounting and the input files."""
    rows = settle(evaluated(spark, sf, reasons=True))
    outcome = settle(decision.decide(rows, PLAN.look_count, DECISION))
    calls_ = settle(decision.final_calls(rows, outcome))
    runs = summary.run_summary(decision.sample_decisions(outcome), _hit_counts(spark, sf), PROFILE.run, PLAN)
    accounting = ()
    if released:
        runs = runs.join(rejected_counts(spark, sf), "sample_id", "left").withColumn("rejected_hits", F.coalesce("rejected_hits", F.lit(0)))
        totals = _hit_counts(spark, sf).select("sample_id", F.col("passed_fragments").alias("qc_passing_fragments"))
        files = runs.select("sample_id", F.array(F.concat("sample_id", F.lit("_R1.fastq")), F.concat("sample_id", F.lit("_R2.fastq"))).alias("input_files"))
        accounting = (sampling.plan_report(totals, PLAN), files)
    gates = passing_gates(spark) if released else None
    runs = settle(release.release_status(screen.attach_release_inputs(runs, PROFILE, _controls(spark, sf), gates)))
    return sinks.bundle_files(
        runs,
        calls_,
        decision.round_records(outcome),
        summary.virus_summary(calls_),
        summary.sample_run_summary(runs, calls_),
        summary.top_results(calls_),
        *accounting,
    )


@query(
    "run_documents",
    O.sampled(
        f"""SELECT r.sample_id, 'sample_summary.json' AS path, r.decision_status AS decision_status, r.stop_reason AS stop_reason, r.rounds_run::VARCHAR AS rounds_run,
        r.sampled_fragments::VARCHAR AS sampled_fragments FROM ({_RUN_SUMMARY}) r
        UNION ALL SELECT r.sample_id, 'summary/sample_run_summary.json', r.decision_status, r.stop_reason, r.rounds_run::VARCHAR, r.sampled_fragments::VARCHAR FROM ({_RUN_SUMMARY}) r"""
    ),
)
def run_documents(spark, sf):
    field = lambda name: F.get_json_object("content", f"$.{name}").alias(name)
    return (
        bundles(spark, sf)
        .filter(F.col("path").isin("sample_summary.json", "summary/sample_run_summary.json"))
        .select("sample_id", "path", field("decision_status"), field("stop_reason"), field("rounds_run"), field("sampled_fragments"))
    )


@query(
    "artifact_checksums",
    f"""SELECT sample_id, path, sha256(content) AS sha256 FROM ({A.plain_sql(A.BUNDLE_FILES)}) f WHERE path NOT IN ('checksum.sha256', 'audit/checksum.sha256')""",
)
def artifact_checksums(spark, sf):
    return sinks.checksum_table(table(spark, sf, A.BUNDLE_FILES))


# ---- audit -------------------------------------------------------------------------

_FILES = A.plain_sql(A.BUNDLE_FILES)
_CANONICAL = [p for _k, p, _a, _t in L.ARTIFACT_CONTRACT]
_ENTRIES = f"""SELECT DISTINCT sample_id, CASE WHEN path LIKE 'evidence/positive_candidate_coverage/%' THEN 'evidence/positive_candidate_coverage' ELSE path END AS entry FROM ({_FILES}) f"""


def _missing_sql(names) -> str:
    return f"""SELECT s.sample_id, coalesce(string_agg(n.name, ', ' ORDER BY n.i) FILTER (e.entry IS NULL), '') AS missing, count(e.entry) AS present
        FROM (SELECT DISTINCT sample_id FROM ({_FILES}) f) s CROSS JOIN (SELECT unnest({list(names)!r}) AS name, unnest(range({len(names)})) AS i) n
        LEFT JOIN ({_ENTRIES}) e ON e.sample_id = s.sample_id AND e.entry = n.name GROUP BY 1"""


@query(
    "audit_completeness",
    f"""SELECT sample_id, 'report bundle completeness' AS "check", CASE WHEN missing = '' THEN 'pass' ELSE 'fail' END AS status,
        CASE WHEN missing = '' THEN 'all of the required files are there' ELSE 'not there, of the required files: ' || missing END AS detail FROM ({_missing_sql(L.LEGACY_REQUIRED)}) a
        UNION ALL SELECT sample_id, 'canonical report bundle completeness', CASE WHEN present = 0 THEN 'skip' WHEN missing = '' THEN 'pass' ELSE 'fail' END,
        CASE WHEN present = 0 THEN 'no file of that layout' WHEN missing = '' THEN 'all of the canonical artifacts are there' ELSE 'not there, of the canonical artifacts: ' || missing END FROM ({_missing_sql(_CANONICAL)}) b""",
)
def audit_completeness(spark, sf):
    return audit.audit_completeness(table(spark, sf, A.BUNDLE_FILES))


@query(
    "audit_schema",
    """SELECT 'p-' || p_partkey AS sample_id, 'schema metadata contract' AS "check",
        CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 OR p_size % 11 = 0 THEN 'fail' ELSE 'pass' END AS status FROM part
       UNION ALL SELECT 'p-' || p_partkey, 'table headers', CASE WHEN p_size % 3 = 0 OR p_partkey % 4 = 3 THEN 'fail' ELSE 'pass' END FROM part""",
)
def audit_schema(spark, sf):
    canonical, legacy = audit.expected_outputs()
    literal = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    short = dict(list(canonical.items())[:-1])
    size, key = F.col("p_size"), F.col("p_partkey")
    sample = F.concat(F.lit("p-"), key.cast("string")).alias("sample_id")
    parts = A.read_table(spark, sf, "part")
    schemas = parts.select(
        sample,
        F.when(size % 5 == 0, "old.v3").otherwise(L.BUNDLE_SCHEMA).alias("report_bundle_schema"),
        F.when(size % 7 == 0, literal(short)).otherwise(literal(canonical)).alias("canonical_outputs"),
        F.when(size % 11 == 0, literal({**legacy, "run_log": "x"})).otherwise(literal(legacy)).alias("legacy_outputs"),
    )
    rounds = "\t".join(L.ROUNDS_HEADER)
    headers = parts.select(
        sample,
        F.when(key % 4 == 3, "unknown.tsv").otherwise("sampling_rounds.tsv").alias("artifact"),
        F.when(size % 3 == 0, rounds + "\tx").otherwise(rounds).alias("header"),
    )
    checks = audit.audit_schema(schemas).unionByName(audit.audit_headers(headers))
    return checks.select("sample_id", "check", "status")


_PAIRS = [(label, a, b, kind) for label, a, b, kind in audit._ALIAS_PAIRS]
# The two JSON spellings are equal as values; as bytes and checksum lines they differ.
_ALIAS_SQL = " UNION ALL ".join(
    f"""SELECT s.sample_id, '{label}' AS "check", CASE WHEN a.content IS NULL OR b.content IS NULL THEN 'skip' WHEN a.content = b.content OR {'true' if kind == 'json' else 'false'} THEN 'pass' ELSE 'fail' END AS status
    FROM (SELECT DISTINCT sample_id FROM f WHERE path IN ({", ".join(repr(x) for p in _PAIRS for x in p[1:3])})) s
    LEFT JOIN f a ON a.sample_id = s.sample_id AND a.path = '{legacy}' LEFT JOIN f b ON b.sample_id = s.sample_id AND b.path = '{path}'"""
    for label, legacy, path, kind in _PAIRS
)


@query("audit_aliases", f"WITH f AS ({_FILES}) {_ALIAS_SQL}")
def audit_aliases(spark, sf):
    return audit.audit_aliases(table(spark, sf, A.BUNDLE_FILES)).select("sample_id", "check", "status")


_LISTED = """SELECT concat('cust-', CAST(o_custkey AS STRING)) AS sample_id, 'checksum.sha256' AS inventory,
    CASE WHEN o_orderkey % 89 = 0 THEN 'zz' WHEN o_orderkey % 97 = 0 THEN {sha}('tampered') ELSE {sha}(o_orderpriority) END AS digest,
    CASE WHEN o_orderkey % 101 = 0 THEN concat('../', CAST(o_orderkey AS STRING)) ELSE concat('f/', CAST(o_orderkey AS STRING)) END AS path FROM {orders}"""


@query(
    "audit_checksums",
    f"""SELECT sample_id, 'checksum.sha256' AS "check", CASE WHEN count(bad) = 0 THEN 'pass' ELSE 'fail' END AS status,
        CASE WHEN count(bad) = 0 THEN 'verified ' || count(*) || ' checksum entries' ELSE count(bad) || ' of ' || count(*) || ' entries failed, first: ' || min(bad) END AS detail
        FROM (SELECT sample_id, CASE WHEN NOT regexp_full_match(digest, '[0-9a-f]{{64}}') THEN 'invalid SHA-256 digest' WHEN path LIKE '../%' THEN 'path leaves the bundle'
                WHEN digest <> sha256(o_orderpriority) THEN 'checksum mismatch' END || ' for `' || path || '`' AS bad
              FROM (SELECT l.*, o.o_orderpriority FROM ({A.plain_sql(_LISTED).replace('{sha}', 'sha256')}) l
                    JOIN orders o ON regexp_extract(l.path, '[0-9]+$') = CAST(o.o_orderkey AS VARCHAR)) j) k GROUP BY 1""",
)
def audit_checksums(spark, sf):
    orders = A.read_table(spark, sf, "orders")
    actual = orders.select(
        F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("sample_id"),
        F.concat(F.lit("f/"), F.col("o_orderkey").cast("string")).alias("path"),
        F.sha2("o_orderpriority", 256).alias("sha256"),
    )
    text = _LISTED.replace("{sha}('tampered')", "sha2('tampered', 256)").replace("{sha}(o_orderpriority)", "sha2(o_orderpriority, 256)")
    listed = table(spark, sf, text).withColumn("problem", audit.checksum_problem())
    return audit.audit_checksums(listed, actual)


_FIELDS = ("reference_bundle_version", "calibration_profile_version", "backend", "seed")


@query(
    "audit_bindings",
    f"""WITH r AS ({A.plain_sql(A.RUNS)})
        SELECT sample_id, 'report bundle bindings' AS "check", CASE WHEN {" OR ".join(f"{f} <> m_{f}" for f in _FIELDS)} THEN 'fail' ELSE 'pass' END AS status FROM r
        UNION ALL SELECT sample_id, 'reference bundle binding', CASE WHEN reference_bundle_version <> 'bundle-1' OR m_reference_bundle_version <> 'bundle-1' THEN 'fail' ELSE 'pass' END FROM r
        UNION ALL SELECT sample_id, 'calibration profile binding', CASE WHEN calibration_profile_version <> profile_id OR m_calibration_profile_version <> profile_id
          OR reference_bundle_version <> 'bundle-1' OR m_reference_bundle_version <> 'bundle-1' OR backend <> 'seed-vote' THEN 'fail' ELSE 'pass' END FROM r""",
)
def audit_bindings(spark, sf):
    runs = table(spark, sf, A.RUNS)
    manifest = runs.select("sample_id", *[F.col(f"m_{f}").alias(f) for f in _FIELDS])
    profiles = runs.select(
        "sample_id", "profile_id", F.lit("bundle-1").alias("reference_bundle"), F.lit("seed-vote").alias("profile_backend")
    )
    return audit.audit_bindings(runs, manifest, "bundle-1", profiles).select("sample_id", "check", "status")


def _tampered(spark, sf) -> DataFrame:
    """Call rows of all looks with some labels broken."""
    rows = look_calls(spark, sf).filter("aggregation_level IS NOT NULL")
    accepted, ambiguous = F.col("accepted_fragments"), F.col("ambiguous_fragments")
    label = F.lit(L.CI_REASON_PREFIX + L.CI_LABEL)
    return rows.withColumns(
        {
            "artifact_level": F.when(accepted % 17 == 5, "group").otherwise(F.col("aggregation_level")),
            "accession_resolution": F.when(accepted % 11 == 3, "").when(ambiguous % 13 == 4, "bogus").otherwise(F.col("accession_resolution")),
            "fraction_ci_95_low": F.when(accepted % 19 == 2, 1.0).otherwise(F.col("fraction_ci_95_low")),
            "decision_reasons": F.when(accepted % 7 == 3, F.concat("decision_reasons", F.array(label)))
            .when(ambiguous % 23 == 5, F.array(F.lit("x")))
            .otherwise(F.col("decision_reasons")),
        }
    )


def _offender_sql(problem: str, check: str, rows: str) -> str:
    return f"""SELECT sample_id, {check} AS "check", CASE WHEN count(p) = 0 THEN 'pass' ELSE 'fail' END AS status,
        CASE WHEN count(p) = 0 THEN count(*) || ' rows are valid' ELSE (SELECT string_agg(v, '; ' ORDER BY v) FROM (SELECT unnest(list_distinct(list(p))) AS v)) END AS detail
        FROM (SELECT *, 'candidate `' || id || '` ' || {problem} AS p FROM ({rows}) t) o GROUP BY 1, 2"""


@query(
    "audit_ci_labels",
    O.sampled(
        _offender_sql(
            "CASE WHEN accepted % 19 = 2 THEN 'has invalid fraction_ci_95 bounds' WHEN accepted % 7 = 3 THEN 'must carry exactly one interval label' WHEN ambiguous % 23 = 5 THEN 'is missing the sampling-only label' END",
            "'candidate CI labeling'",
            "SELECT * FROM calls",
        )
    ),
)
def audit_ci_labels(spark, sf):
    return audit.audit_ci_labels(_tampered(spark, sf))


@query(
    "audit_resolution",
    O.sampled(
        _offender_sql(
            """CASE WHEN level <> artifact THEN 'has another aggregation_level' WHEN accepted % 11 = 3 THEN 'is missing accession_resolution'
            WHEN ambiguous % 13 = 4 THEN 'has an illegal accession_resolution' END""",
            "CASE artifact WHEN 'group' THEN 'detection_calls.group.tsv' ELSE 'candidate_calls.accession.tsv' END",
            "SELECT *, CASE WHEN accepted % 17 = 5 THEN 'group' ELSE level END AS artifact FROM calls",
        )
    ),
)
def audit_resolution(spark, sf):
    return audit.audit_resolution(_tampered(spark, sf))


@query(
    "audit_facts",
    f"""WITH r AS ({A.plain_sql(A.RUNS)}), n AS (SELECT 'run-' || l_orderkey AS sample_id, count(*) AS k FROM lineitem GROUP BY 1)
        SELECT r.sample_id, 'rounds.tsv' AS "check", CASE WHEN r.rounds_run <> coalesce(n.k, 0) THEN 'fail' ELSE 'pass' END AS status FROM r LEFT JOIN n USING (sample_id)
        UNION ALL SELECT r.sample_id, 'canonical sample summary facts', CASE WHEN r.claimed_status <> coalesce(r.gate_status, r.claimed_status) OR r.rounds_run <> coalesce(n.k, 0) THEN 'fail' ELSE 'pass' END FROM r LEFT JOIN n USING (sample_id)
        UNION ALL SELECT sample_id, 'canonical result overview facts', CASE WHEN m_backend <> backend OR sampling_mode <> profile_sampling_mode THEN 'fail' ELSE 'pass' END FROM r""",
)
def audit_facts(spark, sf):
    runs = table(spark, sf, A.RUNS).withColumns(
        {
            "release_status": F.col("claimed_status"),
            "stop_reason": F.lit("max_rounds_reached"),
            "qc_passing_fragments": F.col("input_fragments"),
            "sampled_fragments": F.col("input_fragments"),
        }
    )
    manifest = runs.withColumn("backend", F.col("m_backend"))
    rounds = A.read_table(spark, sf, "lineitem").select(F.concat(F.lit("run-"), F.col("l_orderkey").cast("string")).alias("sample_id"))
    sample_run = runs.withColumn("release_status", F.coalesce("gate_status", "claimed_status"))
    overview = runs.withColumn("sampling_mode", F.col("profile_sampling_mode"))
    return audit.audit_facts(runs, manifest, rounds, sample_run, overview).select("sample_id", "check", "status")


@query(
    "audit_release",
    f"""WITH named AS (SELECT *, CAST(substr(sample_id, 5) AS BIGINT) AS k FROM ({_RELEASED}) s),
        r AS (SELECT * REPLACE (CASE WHEN k % 21 = 0 THEN 'blocked' ELSE release_status END AS release_status,
          CASE WHEN k % 21 = 0 THEN mode_blocker ELSE secondary_blockers END AS secondary_blockers) FROM named),
        ok AS (SELECT *, sampling_mode = profile_sampling_mode AS mode_ok, negative_control_required = profile_control_required AS required_ok,
          sampling_mode IN ('representative', 'streaming') AS known FROM r)
        SELECT sample_id, 'release_status compliance' AS "check", CASE WHEN mode_ok AND required_ok AND known AND claimed_status = release_status THEN 'pass' ELSE 'fail' END AS status,
          CASE WHEN NOT mode_ok THEN 'sampling_mode does not match the profile' WHEN NOT required_ok THEN 'negative_control.required does not match the profile'
            WHEN NOT known THEN 'unknown sampling_mode' WHEN claimed_status = release_status THEN 'status as recomputed'
            ELSE 'release_status mismatch: sample_summary=`' || claimed_status || '` recomputed=`' || release_status || '`' END AS detail FROM ok
        UNION ALL SELECT sample_id, 'release_gate artifact blockers', CASE WHEN gate_status IS NULL THEN 'skip' WHEN same THEN 'pass' ELSE 'fail' END,
          CASE WHEN gate_status IS NULL THEN 'no gate document' WHEN same THEN 'gate as recomputed' ELSE 'gate is not as recomputed' END
          FROM (SELECT *, gate_status = release_status AND k % 9 <> 0 AND (k % 10 <> 0 OR secondary_blockers = '') AS same FROM ok WHERE mode_ok AND required_ok AND known) c""",
)
def audit_release(spark, sf):
    """Gates persisted with the blockers that hold, but for some runs; some runs are blocked by rejected hits alone."""
    key = F.substring("sample_id", 5, 20).cast("bigint")
    runs = _runs(spark, sf).withColumn("rejected_hits", F.when(key % 21 == 0, 3).otherwise(0))
    held = release.release_status(runs).withColumns(
        {
            "gate_primary": F.when(key % 9 == 0, F.array(F.lit("other"))).otherwise(F.col("release_primary_blockers")),
            "gate_secondary": F.when(key % 10 == 0, F.array().cast("array<string>")).otherwise(F.col("release_secondary_blockers")),
        }
    )
    return audit.audit_release(held.select(*runs.columns, "gate_primary", "gate_secondary"))


_CHECKS = """SELECT concat('part-', CAST(l_partkey AS STRING)) AS sample_id, concat('check-', CAST(l_linenumber AS STRING)) AS "check",
    CASE WHEN l_discount > 0.09 AND l_tax > 0.07 THEN 'fail' WHEN l_tax < 0.01 THEN 'skip' ELSE 'pass' END AS status, CAST(l_orderkey AS STRING) AS detail FROM {lineitem}"""


@query(
    "audit_verdicts",
    f"""SELECT sample_id, CASE WHEN count(*) FILTER (status = 'fail') = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) AS checks,
        count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'skip') AS skipped,
        string_agg('[' || upper(status) || '] ' || "check" || ': ' || detail, chr(10) ORDER BY '[' || upper(status) || '] ' || "check" || ': ' || detail) AS report
        FROM ({A.plain_sql(_CHECKS)}) c GROUP BY 1""",
)
def audit_verdicts(spark, sf):
    return audit.audit_verdict(table(spark, sf, _CHECKS.replace('"check"', "`check`")))


_WRITTEN_CHECKS = (
    "report bundle completeness", "canonical report bundle completeness", "readable documents", "schema metadata contract",
    "table headers", "dual-layout candidate TSV", "dual-layout rounds TSV", "dual-layout run manifest",
    "dual-layout checksum inventory", "checksum.sha256", "audit/checksum.sha256", "report bundle bindings", "reference bundle binding",
    "calibration profile binding", "rounds.tsv", "canonical sample summary facts", "canonical result overview facts", "candidate CI labeling",
    "candidate_calls.accession.tsv", "detection_calls.group.tsv", "release_status compliance", "release_gate artifact blockers",
)
# What a bundle without its run manifest makes of these checks.
_WITHOUT_MANIFEST = {
    "canonical report bundle completeness": "fail", "checksum.sha256": "fail", "audit/checksum.sha256": "fail",
    **dict.fromkeys(
        ("dual-layout run manifest", "report bundle bindings", "reference bundle binding", "calibration profile binding",
         "canonical result overview facts", "release_status compliance", "release_gate artifact blockers"), "skip",
    ),
}


@query(
    "audit_of_written_bundles",
    f"""SELECT DISTINCT l_returnflag AS sample_id, c.name AS "check", CASE WHEN l_returnflag = 'N' THEN c.without ELSE 'pass' END AS status
    FROM lineitem, (SELECT unnest([{", ".join(f"{{'name': '{c}', 'without': '{_WITHOUT_MANIFEST.get(c, 'pass')}'}}" for c in _WRITTEN_CHECKS)}], recursive := true)) c""",
)
def audit_of_written_bundles(spark, sf):
    """Bundles written as folders of files, read back and audited, with profiles: one is blocked by rejected hits alone and
    passes, one has lost its run manifest."""
    from siftline.plans.audit import audit_bundles

    folder = _scratch(spark, "bundles")
    sinks.write_bundles(bundles(spark, sf, released=True), folder)
    found = settle(sinks.read_bundles(spark, folder).filter("NOT (sample_id = 'N' AND path = 'provenance/run_manifest.json')"))
    return audit_bundles(found, "bundle-1", written_profiles(found)).select("sample_id", "check", "status")


def written_profiles(files: DataFrame) -> DataFrame:
    gates = ", ".join(f"'{n}_gate', named_struct('status', 'pass')" for n in ("backend", "reference", "specificity", "sensitivity"))
    return files.select("sample_id").distinct().selectExpr(
        "sample_id", "'profile-1' AS profile_id", "'bundle-1' AS reference_bundle", "'seed-vote' AS profile_backend", "'release_candidate' AS profile_status",
        "'representative' AS profile_sampling_mode", "false AS profile_control_required", f"named_struct({gates}) AS gates",
    )


# ---- panel -------------------------------------------------------------------------

_MANIFEST_NAMES = """SELECT CASE WHEN item_id % 7 = 0 THEN concat('x-', CAST(item_id AS STRING)) WHEN item_id % 11 = 0 THEN 'bench-1' ELSE concat('bench-', CAST(item_id AS STRING)) END AS contig FROM {benchmark}"""
_FASTA_NAMES = """SELECT CASE WHEN item_id % 9 = 0 THEN 'bench-2' ELSE concat('bench-', CAST(item_id AS STRING)) END AS contig FROM {benchmark}"""


@query(
    "manifest_reconciliation",
    f"""WITH m AS (SELECT contig, count(*) AS m FROM ({A.plain_sql(_MANIFEST_NAMES)}) a GROUP BY 1), f AS (SELECT contig, count(*) AS f FROM ({A.plain_sql(_FASTA_NAMES)}) b GROUP BY 1),
        j AS (SELECT coalesce(m.contig, f.contig) AS contig, coalesce(m, 0) AS m, coalesce(f, 0) AS f FROM m FULL JOIN f ON m.contig = f.contig)
        SELECT contig, 'manifest_only' AS problem FROM j WHERE f = 0 UNION ALL SELECT contig, 'fasta_only' FROM j WHERE m = 0
        UNION ALL SELECT contig, 'duplicate_in_manifest' FROM j WHERE m > 1 UNION ALL SELECT contig, 'duplicate_in_fasta' FROM j WHERE f > 1""",
)
def manifest_reconciliation(spark, sf):
    return panel.reconcile_manifest(table(spark, sf, _MANIFEST_NAMES), table(spark, sf, _FASTA_NAMES))


@query(
    "first_contig_per_layer",
    """SELECT source AS layer, lang AS contig, doc_id AS ordinal, n_chars AS genome_length FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents) d WHERE rn = 1""",
)
def first_contig_per_layer(spark, sf):
    rows = A.read_table(spark, sf, "documents").select(
        F.col("source").alias("layer"), F.col("lang").alias("contig"), F.col("doc_id").alias("ordinal"), F.col("n_chars").alias("genome_length")
    )
    return panel.dedupe_contigs(rows)


@query("layer_exclusion", "SELECT CAST(o_orderkey AS VARCHAR) AS contig, o_orderpriority AS header FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def layer_exclusion(spark, sf):
    rows = A.read_table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("contig"), F.col("o_orderpriority").alias("header"))
    owner = A.read_table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("contig"))
    return panel.exclude_layer(rows, owner)


_LAYERS = (
    ("host", "SELECT concat('k', CAST(r_regionkey AS STRING)) AS contig, 'host' AS layer FROM {region}"),
    ("virus", "SELECT concat('k', CAST(n_nationkey AS STRING)) AS contig, 'virus' AS layer FROM {nation}"),
    ("decoy", "SELECT concat('k', CAST(s_suppkey AS STRING)) AS contig, 'decoy' AS layer FROM {supplier}"),
)
_LAYER_SQL = " UNION ALL ".join(A.plain_sql(text) for _n, text in _LAYERS)


@query("layer_union", f"SELECT contig, layer, CASE layer WHEN 'host' THEN 0 WHEN 'virus' THEN 1 ELSE 2 END AS layer_priority FROM ({_LAYER_SQL}) u")
def layer_union(spark, sf):
    return panel.union_layers(*[table(spark, sf, text) for _n, text in _LAYERS])[0]


@query(
    "layer_duplicates",
    f"SELECT contig, count(*) AS copies, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers FROM ({_LAYER_SQL}) u GROUP BY 1 HAVING count(*) > 1",
)
def layer_duplicates(spark, sf):
    repeated = panel.union_layers(*[table(spark, sf, text) for _n, text in _LAYERS])[1]
    return repeated.withColumn("layers", F.array_join("layers", ","))


@query("taxonomy", f"SELECT DISTINCT taxid, virus_name AS name FROM ({A.plain_sql(A.MANIFEST)}) m")
def taxonomy(spark, sf):
    return panel.taxonomy(table(spark, sf, A.MANIFEST))


def _manifest_row_sql(layer: panel.Layer) -> str:
    token = "regexp_extract(header, '^(\\S*)', 1)"
    tagged = f"coalesce(nullif(regexp_extract(header, 'AC:(\\S+)', 1), ''), {token})" if layer.accession_tag else token
    name = f"'{layer.virus_name}'" if layer.virus_name else f"coalesce(nullif(regexp_replace(header, '^\\S+\\s*', ''), ''), {token})"
    group = f"'{layer.group}'" if layer.group else tagged
    return f"""SELECT {token} AS contig, {tagged} AS accession, {layer.taxid}::BIGINT AS taxid, {name} AS virus_name, {group} AS group_name,
        length(sequence) AS genome_length, '{layer.source_type}' AS source_type FROM ({A.plain_sql(A.PANEL)}) p"""


@query("manifest_rows", " UNION ALL ".join(_manifest_row_sql(x) for x in (panel.HOST, panel.VIRUS, panel.DECOY)))
def manifest_rows(spark, sf):
    contigs = table(spark, sf, A.PANEL).withColumn("genome_length", F.length("sequence").cast("bigint"))
    rows = [panel.manifest_rows(contigs, layer) for layer in (panel.HOST, panel.VIRUS, panel.DECOY)]
    merged = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return merged.select(
        "contig", "accession", "taxid", "virus_name", F.col("group").alias("group_name"), "genome_length", "source_type"
    )


# ---- sources -----------------------------------------------------------------------

_PAIRED = f"""SELECT sample_id, (record_number - 1) // 2 AS pair, count(*) AS mates, min(record_number) AS first,
    arg_min(key, record_number) AS k1, arg_max(key, record_number) AS k2, arg_min(seq, record_number) AS s1, arg_max(seq, record_number) AS s2,
    arg_min(flags, record_number) AS f1, arg_max(flags, record_number) AS f2
    FROM (SELECT *, regexp_replace(regexp_extract(qname, '([^ ]+)', 1), '/[12]$', '') AS key FROM ({A.plain_sql(A.MATES)}) m) q GROUP BY 1, 2"""


@query(
    "mate_pairs",
    f"""SELECT sample_id, k1 AS fragment_key, CASE WHEN f1 = 128 AND f2 = 64 THEN s2 ELSE s1 END AS r1_seq, CASE WHEN f1 = 128 AND f2 = 64 THEN s1 ELSE s2 END AS r2_seq
        FROM ({_PAIRED}) p WHERE mates = 2 AND k1 = k2""",
)
def mate_pairs(spark, sf):
    return fastq.pair_mates(table(spark, sf, A.MATES))[0].select("sample_id", "fragment_key", "r1_seq", "r2_seq")


@query(
    "mate_rejects",
    f"""SELECT sample_id, first AS record_number, CASE WHEN mates < 2 THEN 'orphan' WHEN mates > 2 THEN 'repeated_record' ELSE 'key_mismatch' END AS problem
        FROM ({_PAIRED}) p WHERE mates <> 2 OR k1 <> k2""",
)
def mate_rejects(spark, sf):
    return fastq.pair_mates(table(spark, sf, A.MATES))[1].select("sample_id", "record_number", "problem")


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_READ_TEXT = lambda c: f"regexp_replace({c}, '[^ACGTacgtN]', 'N', 'g') AS {c}"
_QUAL_TEXT = lambda c: f"regexp_replace({c}, '[\\x00-\\x20]', '~', 'g') AS {c}"


@query(
    "fastq_round_trip",
    f"""SELECT sample_id, fragment_key, {", ".join(_READ_TEXT(c) for c in ("r1_seq", "r2_seq"))}, {", ".join(_QUAL_TEXT(c) for c in ("r1_qual", "r2_qual"))}
    FROM ({O.FRAGMENTS}) f""",
)
def fastq_round_trip(spark, sf):
    """Write every fragment to paired FASTQ files, several for each sample, then read the files."""
    folder = fastq_files(spark, sf)
    part = lambda path: F.regexp_extract(path, r"sample_id=([^/]+)/", 1)
    fragments, _rejects = fastq.read_fastq_pairs(spark, f"{folder}/mate=1/*", f"{folder}/mate=2/*", sample=part)
    return fragments.select("sample_id", "fragment_key", "r1_seq", "r2_seq", "r1_qual", "r2_qual")


def fastq_files(spark, sf) -> str:
    """A folder with mate=1/sample_id=<sample>/ and mate=2/sample_id=<sample>/, each with the same parts of a sample.

    A task writes both mates of its fragments, in one order, so fragments stay where their document was cut and are kept nowhere else.
    """
    read = lambda c: F.regexp_replace(c, "[^ACGTacgtN]", "N")
    qual = lambda c: F.regexp_replace(c, r"[\x00-\x20]", "~")
    rows = table(spark, sf, A.FRAGMENTS).select("sample_id", "fragment_key", "r1_seq", "r2_seq", "r1_qual", "r2_qual")
    record = lambda mate: F.concat_ws("\n", F.concat(F.lit("@"), "fragment_key", F.lit(f"/{mate} extra")), read(f"r{mate}_seq"), F.lit("+"), qual(f"r{mate}_qual"))
    mates = F.explode(F.array(*(F.struct(F.lit(mate).alias("mate"), record(mate).alias("record")) for mate in (1, 2)))).alias("m")
    folder = _scratch(spark, "fastq")
    placed = rows.select("sample_id", "fragment_key", mates).select("m.mate", "sample_id", "fragment_key", "m.record")
    ordered = placed.sortWithinPartitions("mate", "sample_id", "fragment_key").select("mate", "sample_id", "record")
    ordered.write.partitionBy("mate", "sample_id").text(folder)
    return folder


_PANEL_CLEAN = "regexp_replace(sequence, '[^ACGTacgtN]', 'N', 'g')"


@query(
    "fasta_round_trip",
    f"""SELECT trim(regexp_replace(header, '\\s+', ' ', 'g')) AS header, length(sequence) AS genome_length, {_PANEL_CLEAN} AS sequence FROM ({A.plain_sql(A.PANEL)}) p""",
)
def fasta_round_trip(spark, sf):
    """Write the panel as FASTA with wrapped lines, then read it."""
    seq = F.regexp_replace("sequence", "[^ACGTacgtN]", "N")
    wrapped = F.regexp_replace(seq, "(.{60})", "$1\n")
    record = F.concat_ws("\n", F.concat(F.lit(">"), F.trim(F.regexp_replace("header", r"\s+", " "))), wrapped)
    folder = _scratch(spark, "fasta")
    table(spark, sf, A.PANEL).select(record).write.text(folder)
    contigs, _rejects = fasta.read_fasta(spark, folder, "virus", with_sequence=True)
    return contigs.select("header", "genome_length", "sequence")


@query(
    "manifest_round_trip",
    f"""SELECT contig, accession, taxid, virus_name, "group" AS group_name, genome_length, source_type FROM ({A.plain_sql(A.MANIFEST)}) m""",
)
def manifest_round_trip(spark, sf):
    folder = _scratch(spark, "manifest")
    table(spark, sf, A.MANIFEST).write.json(folder)
    return documents.read_manifest(spark, folder, multi_line=False).select(
        "contig", "accession", "taxid", "virus_name", F.col("group").alias("group_name"), "genome_length", "source_type"
    )


@query(
    "benchmark_dataset_checks",
    """SELECT dataset_id, turn, CASE WHEN trim(dataset_id) = '' THEN 'empty_dataset_id' WHEN copies > 1 THEN 'duplicate_dataset_id' WHEN no_input THEN 'no_input' ELSE '' END AS problem
       FROM (SELECT *, count(*) OVER (PARTITION BY dataset_id) AS copies FROM (SELECT CASE WHEN role = 'system' THEN ' ' WHEN conv_id % 3 = 0 THEN 'd-' || conv_id ELSE 'd-' || conv_id || '-' || turn END AS dataset_id,
             turn, conv_id % 5 = 0 AS no_input FROM conversations) c) d""",
)
def benchmark_dataset_checks(spark, sf):
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    rows = A.read_table(spark, sf, "conversations").select(
        F.when(F.col("role") == "system", " ")
        .when(F.col("conv_id") % 3 == 0, F.concat(F.lit("d-"), conv))
        .otherwise(F.concat(F.lit("d-"), conv, F.lit("-"), turn))
        .alias("dataset_id"),
        "turn",
        F.when(F.col("conv_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("role")).alias("input"),
        F.lit("negative").alias("expected_outcome"),
    )
    judged = documents.check_benchmark_datasets(rows)
    return judged.select("dataset_id", "turn", F.coalesce("problem", F.lit("")).alias("problem"))


# ---- seed votes --------------------------------------------------------------------

_K, _BIN = 16, 16
_MERS = lambda seq, name: f"unnest(list_transform(range(0, greatest(length({seq}) - {_K} + 1, 0)), lambda p: {{'pos': p, 'kmer': substr({seq}, p + 1, {_K})}})) AS {name}"
_SEED_READS = A.plain_sql(A.SEED_FRAGMENTS)
_SEED_SQL = f"""WITH mates AS (SELECT sample_id, fragment_key, 1 AS mate, translate(r1_seq, 'acgtn', 'ACGTN') AS seq FROM ({_SEED_READS}) f
      UNION ALL SELECT sample_id, fragment_key, 2, translate(r2_seq, 'acgtn', 'ACGTN') FROM ({_SEED_READS}) f),
    oriented AS (SELECT *, '+' AS strand FROM mates UNION ALL SELECT sample_id, fragment_key, mate, reverse(translate(seq, 'ACGT', 'TGCA')), '-' FROM mates),
    reads AS (SELECT sample_id, fragment_key, mate, strand, s.pos AS read_pos, s.kmer FROM (SELECT *, {_MERS('seq', 's')} FROM oriented) o WHERE regexp_full_match(s.kmer, '[ACGT]+')),
    panel AS (SELECT contig, s.pos AS contig_pos, s.kmer FROM (SELECT contig, {_MERS('seq', 's')} FROM (SELECT contig, translate(sequence, 'acgtn', 'ACGTN') AS seq FROM ({A.plain_sql(A.SEED_PANEL)}) p) q) r WHERE regexp_full_match(s.kmer, '[ACGT]+')),
    votes AS (SELECT sample_id, fragment_key, mate, contig, strand, floor((contig_pos - read_pos) / {_BIN}.0)::BIGINT AS diagonal, count(*)::INT AS votes, min(contig_pos)::BIGINT AS target_start, (max(contig_pos) + {_K})::BIGINT AS target_end
      FROM reads JOIN panel USING (kmer) GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) >= 2)
    SELECT sample_id, fragment_key, mate, contig, strand, votes AS as_score, target_start, target_end,
      (60 // count(*) OVER (PARTITION BY sample_id, fragment_key, mate))::INT AS mapq,
      row_number() OVER (PARTITION BY sample_id, fragment_key, mate ORDER BY votes DESC, contig, strand, diagonal) = 1 AS is_primary FROM votes"""


@query("seed_vote_hits", _SEED_SQL)
def seed_vote_hits(spark, sf):
    found = hits.seed_vote_hits(table(spark, sf, A.SEED_FRAGMENTS), table(spark, sf, A.SEED_PANEL), _K, 2, _BIN)
    return found.select(
        "sample_id", "fragment_key", "mate", "contig", "strand", "as_score", "target_start", "target_end", "mapq", "is_primary"
    )


@query("minimizer_hits", None)
def minimizer_hits(spark, sf):
    """Placement by minimizers and chains; tests hold it against brute force and measure its recall."""
    found = minimizers.minimizer_hits(table(spark, sf, A.SEED_FRAGMENTS), table(spark, sf, A.SEED_PANEL))
    return found.select("sample_id", "fragment_key", "mate", "contig", "strand", "as_score", "target_start", "target_end", "mapq", "is_primary")
