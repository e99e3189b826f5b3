"""Gates, candidate statuses and sequential decisions.

Rounds are a column: every look is decided in one job and early stopping is a
filter. Tables here have one row per (sample, round, candidate), so a window over
one sample is bounded by panel size times 64 looks, not by reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline import labels as L
from siftline.config import CandidateRules, DecisionRules
from siftline.functions import stats
from siftline.functions.ranking import EVIDENCE_RANKS, evidence_rank

MIN_CONFIRMING_ROUNDS = 2


def is_group() -> Column:
    return (F.col("aggregation_level") == "group") | (F.col("multiplicity_family") == "group")


def look_context(calls: DataFrame, planned_looks: int) -> DataFrame:
    """Add family size, planned looks and look index; each is at least 1."""
    family = Window.partitionBy("sample_id", "round", "aggregation_level")
    return calls.withColumns(
        {
            "candidate_family_size": F.greatest(F.count(F.lit(1)).over(family), F.lit(1)),
            "planned_round_look_count": F.lit(max(planned_looks, 1)).cast("bigint"),
            "current_look_index": F.greatest(F.col("round"), F.lit(1)).cast("bigint"),
        }
    )


def gates(calls: DataFrame, rules: CandidateRules = CandidateRules(), decision: DecisionRules = DecisionRules()) -> DataFrame:
    """Add the boolean gates, the p-value and the corrected alpha."""
    accepted = F.col("accepted_fragments")
    ambiguity = F.coalesce(
        F.when(accepted > 0, F.col("ambiguous_fragments") / accepted <= rules.max_ambiguous_fraction_for_positive),
        F.lit(False),
    )
    return calls.withColumns(
        {
            "abundance_pass": F.col("unique_fraction") > decision.theta_pos,
            "absolute_pass": accepted >= rules.theta_pos_absolute,
            "nonoverlap_pass": F.col("nonoverlap_fragments") >= rules.min_nonoverlap_fragments,
            "breadth_pass": F.col("breadth") >= rules.min_breadth,
            "background_pass": F.lit(True),
            "ambiguity_pass": ambiguity,
            "evidence_pass": evidence_rank(F.col("evidence_strength"))
            >= EVIDENCE_RANKS[rules.min_positive_evidence_strength],
            "positive_p_value": stats.binomial_survival(
                "accepted_fragments", "total_sampled_fragments", decision.null_probability
            ),
            "positive_corrected_alpha": stats.bonferroni(
                decision.positive_alpha_global, "candidate_family_size", "planned_round_look_count"
            ),
        }
    ).withColumn("enrichment_pass", F.col("positive_p_value") <= F.col("positive_corrected_alpha"))


def _core() -> Column:
    names = ("abundance", "absolute", "nonoverlap", "breadth", "background", "evidence", "enrichment")
    core = F.lit(True)
    for name in names:
        core = core & F.col(f"{name}_pass")
    return core


def below_detection(decision: DecisionRules) -> Column:
    return (F.col("unique_fraction") <= decision.theta_neg_operational) & (
        F.col("clopper_pearson_upper") <= decision.negative_cp_lod_max
    )


def candidate_status(rules: CandidateRules = CandidateRules(), decision: DecisionRules = DecisionRules()) -> Column:
    """Status from the gate columns; ambiguity vetoes accessions, never groups."""
    trace = F.lit(rules.weak_positive_enabled)
    for name in ("abundance", "absolute", "enrichment", "ambiguity"):
        trace = trace & F.col(f"{name}_pass")
    return (
        F.when(_core() & (is_group() | F.col("ambiguity_pass")), "positive")
        .when(trace, "weak_positive")
        .when(below_detection(decision), "negative")
        .otherwise("indeterminate")
    )


def accession_resolution() -> Column:
    ambiguous = ~F.col("ambiguity_pass")
    return (
        F.when(is_group(), "not_applicable")
        .when(_core() & ambiguous, "low_resolution")
        .when(~_core() & ambiguous, "unresolved")
        .otherwise("high")
    )


def scientific(value: str) -> str:
    """Twelve decimals with a minimal exponent, e.g. ``1.000000000000e-5``, as SQL."""
    return f"regexp_replace(regexp_replace(format_string('%.12e', {value}), 'e[+]', 'e'), 'e(-?)0+([0-9])', 'e$1$2')"


def decision_reasons(decision: DecisionRules = DecisionRules()) -> Column:
    """Earlier reasons that still hold, then the ordered gate trail."""
    group = "(aggregation_level = 'group' OR multiplicity_family = 'group')"
    gate = lambda label, name: f"concat('{label}', IF({name}_pass, '_pass', '_fail'))"
    pair = lambda name, value: f"concat('{name}=', CAST({value} AS STRING))"
    same = lambda name: pair(name, name)
    low, high = f"{decision.theta_neg_operational!r}D", f"{decision.theta_pos!r}D"
    # The labels of the trail and their order.
    trail = (
        gate("unique_fraction_above_theta_pos", "abundance"),
        gate("accepted_fragments_meet_theta_pos_absolute", "absolute"),
        gate("nonoverlap_fragments_meet_minimum", "nonoverlap"),
        gate("breadth_meets_minimum", "breadth"),
        f"'{L.CONTROL_POLICY}'",
        gate("ambiguity_fraction_below_positive_limit", "ambiguity"),
        "IF(ambiguity_pass, 'no_strong_host_explanation', 'strong_host_explanation_present')",
        gate("evidence_strength_meets_positive_minimum", "evidence"),
        gate("positive_enrichment_p_value", "enrichment"),
        f"'positive_statistic_method={decision.positive_statistic_method}'",
        pair("positive_p_value", scientific("positive_p_value")),
        pair("positive_corrected_alpha", scientific("positive_corrected_alpha")),
        same("total_sampled_fragments"),
        same("candidate_family_size"),
        same("multiplicity_family"),
        same("aggregation_level"),
        same("nonoverlap_fragments_algorithm"),
        same("coverage_interval_blocks"),
        same("accepted_fraction_label"),
        same("unique_fraction_label"),
        same("fraction_denominator_source"),
        same("planned_round_look_count"),
        same("current_look_index"),
        "'sequential_look_correction=bonferroni'",
        pair("theta_neg_operational", scientific(low)),
        f"CASE WHEN unique_fraction <= {low} THEN 'unique_fraction_below_theta_neg' "
        f"WHEN unique_fraction > {high} THEN 'unique_fraction_above_theta_pos' "
        "ELSE 'unique_fraction_between_boundaries' END",
        "IF(ambiguity_pass, NULL, 'high_candidate_ambiguity_present')",
        same("accession_resolution"),
        f"IF({group}, 'positive_boundary_level=group', NULL)",
        f"IF({group} AND NOT ambiguity_pass, 'ambiguity_not_used_as_group_detection_veto', NULL)",
        f"IF({group}, IF(group_can_stop, 'group_positive_identity_continuity_pass', "
        "'group_positive_identity_continuity_pending'), NULL)",
    )
    stale = " OR ".join(
        [f"r = '{L.PENDING_DECISION}'"] + [f"startswith(r, '{p}')" for p in L.REPLACED_REASON_PREFIXES]
    )
    return F.expr(
        f"concat(filter(decision_reasons, r -> NOT ({stale})), array_compact(array({', '.join(trail)})))"
    )


def group_continuity(evaluated: DataFrame, max_rounds: int) -> DataFrame:
    """Add ``group_can_stop``: the same group was positive in the immediately preceding look.

    Single-look plans waive the test. Expects ``decision``.
    """
    if max_rounds <= 1:
        return evaluated.withColumn("group_can_stop", F.lit(True))
    history = Window.partitionBy("sample_id", "aggregation_level", "accession_or_group").orderBy("round")
    consecutive = F.lag("round").over(history) == F.col("round") - 1
    was_positive = F.lag("decision").over(history) == "positive"
    confirmed = (F.col("round") >= MIN_CONFIRMING_ROUNDS) & consecutive & was_positive & is_group()
    return evaluated.withColumn("group_can_stop", F.coalesce(confirmed, F.lit(False)))


def evaluate_calls(
    calls: DataFrame,
    planned_looks: int,
    rules: CandidateRules = CandidateRules(),
    decision: DecisionRules = DecisionRules(),
    reasons: bool = True,
    context: bool = True,
) -> DataFrame:
    """Gate every call of every look. Look markers (null level) get no decision."""
    gated = gates(look_context(calls, planned_looks) if context else calls, rules, decision)
    status = F.when(F.col("aggregation_level").isNotNull(), candidate_status(rules, decision))
    evaluated = group_continuity(gated.withColumn("decision", status), planned_looks).withColumn(
        "accession_resolution", accession_resolution()
    )
    return evaluated.withColumn("decision_reasons", decision_reasons(decision)) if reasons else evaluated


def confirm_negative(evaluated: DataFrame, decision: DecisionRules = DecisionRules(), level: str = "group") -> DataFrame:
    """Per look: round >= 2 and every candidate below detection; true without candidates."""
    return evaluated.groupBy("sample_id", "round").agg(_confirms(level, decision).alias("negative_confirmed"))


def _confirms(level: str, decision: DecisionRules) -> Column:
    at_level = F.col("aggregation_level") == level
    every = F.coalesce(F.bool_and(F.when(at_level, below_detection(decision))), F.lit(True))
    return (F.col("round") >= MIN_CONFIRMING_ROUNDS) & every


def decide(evaluated: DataFrame, max_rounds: int, decision: DecisionRules = DecisionRules()) -> DataFrame:
    """One row per (sample, round): both levels' outcomes, merged status and stop reason.

    Aggregating over the look markers too keeps looks without any candidate.
    """
    level, status = F.col("aggregation_level"), F.col("decision")
    some = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    out = evaluated.groupBy("sample_id", "round").agg(
        F.max("total_sampled_fragments").alias("sampled_fragments"),
        F.coalesce(F.sum(F.when(level == "accession", F.col("accepted_fragments"))), F.lit(0)).alias("accepted_virus"),
        some((level == "accession") & (status == "positive")).alias("_accession_positive"),
        some((level == "accession") & (status == "weak_positive")).alias("_accession_weak"),
        some((level == "group") & (status == "positive")).alias("_group_positive"),
        some((level == "group") & (status == "positive") & F.col("group_can_stop")).alias("_group_stop"),
        some((level == "group") & (status == "weak_positive")).alias("_group_weak"),
        _confirms("accession", decision).alias("_accession_negative"),
        _confirms("group", decision).alias("_group_negative"),
    )
    last = F.col("round") >= max_rounds

    def outcome(name: str, positive_stops: Column) -> tuple[Column, Column]:
        positive, weak, negative = (F.col(f"_{name}_{s}") for s in ("positive", "weak", "negative"))
        result = (
            F.when(positive, "positive")
            .when(weak, "weak_positive")
            .when(negative, "negative")
            .otherwise("indeterminate")
        )
        reason = (
            F.when(positive, F.when(positive_stops, "positive_boundary_crossed"))
            .when(~weak & negative, "negative_boundary_confirmed")
            .when(last, "max_rounds_reached")
        )
        return result, reason

    accession_status, accession_stop = outcome("accession", F.lit(True))
    group_status, group_stop = outcome("group", F.col("_group_stop"))
    return out.select(
        "sample_id",
        "round",
        "sampled_fragments",
        "accepted_virus",
        accession_status.alias("accession_status"),
        accession_stop.alias("accession_stop"),
        group_status.alias("group_status"),
        group_stop.alias("group_stop"),
    ).withColumns(merge_level_outcomes())


def merge_level_outcomes() -> dict[str, Column]:
    """A stopping positive accession outcome wins, else the group outcome."""
    accession_wins = (F.col("accession_status") == "positive") & F.col("accession_stop").isNotNull()
    return {
        "decision_status": F.when(accession_wins, F.col("accession_status")).otherwise(F.col("group_status")),
        "stop_reason": F.when(accession_wins, F.col("accession_stop")).otherwise(F.col("group_stop")),
    }


def sequential_decision(looks: DataFrame) -> DataFrame:
    """Looks up to each sample's first stop; ``is_final`` marks the deciding one."""
    sample = Window.partitionBy("sample_id")
    stop = F.min(F.when(F.col("stop_reason").isNotNull(), F.col("round"))).over(sample)
    final = F.coalesce(stop, F.max("round").over(sample))
    return (
        looks.withColumn("final_round", final)
        .filter(F.col("round") <= F.col("final_round"))
        .withColumn("is_final", F.col("round") == F.col("final_round"))
    )


def sample_decisions(looks: DataFrame) -> DataFrame:
    """One row per sample; an unstopped plan ends with ``max_rounds_reached``."""
    return (
        sequential_decision(looks)
        .filter("is_final")
        .select(
            "sample_id",
            F.col("round").alias("rounds_run"),
            "sampled_fragments",
            "accepted_virus",
            "decision_status",
            F.coalesce("stop_reason", F.lit("max_rounds_reached")).alias("stop_reason"),
        )
    )


def round_records(looks: DataFrame) -> DataFrame:
    """The look history as reported: sampled, accepted, status."""
    return sequential_decision(looks).select(
        "sample_id", "round", "sampled_fragments", "accepted_virus", "decision_status"
    )


def final_calls(evaluated: DataFrame, looks: DataFrame) -> DataFrame:
    """Calls of each sample's deciding look."""
    final = sequential_decision(looks).filter("is_final").select("sample_id", "round")
    return evaluated.filter("aggregation_level IS NOT NULL").join(final, ["sample_id", "round"])
