"""The screening plan: hits of a whole cohort to decisions, in one pass.

Samples are a column and rounds are a column, so a cohort is one job. With a
sampling plan the hits are shuffled once, to meet their sampled fragments; the
per-contig and per-fragment aggregates reuse that partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.config import FragmentRules, Profile
from siftline.operators import adjudicate, aggregate, control, decision, hits, qc, release, sampling, summary
from siftline.tuning import settle


def fragment_table(
    mappings: DataFrame, classified: DataFrame, rules: FragmentRules, sampled: DataFrame | None = None
) -> DataFrame:
    """Adjudicated fragments. ``sampled`` (sample_id, fragment_key, entry_round) drives, when given:
    sampled fragments without a mapping stay, as unmapped."""
    carry = ()
    if sampled is not None:
        carry = ("entry_round",)
        keys = ["sample_id", "fragment_key"]
        mappings = sampled.select(*keys, *carry).join(mappings, keys, "left")
    contigs = hits.attach_manifest(hits.aggregate_hits(mappings, carry), classified)
    return adjudicate.adjudicate(hits.best_hits(contigs, carry), rules)


def single_look_calls(mappings: DataFrame, manifest: DataFrame, profile: Profile) -> DataFrame:
    """Candidate calls over all fragments, both levels, without sampling."""
    classified = hits.usable_contigs(manifest)
    return aggregate.candidate_calls(fragment_table(mappings, classified, profile.fragment), classified)


def of_sample(mappings: DataFrame, sampled: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """The mappings that sampled fragments may have, and the sampled fragments, evaluated once."""
    if "rank_hex" not in sampled.columns:
        return mappings, sampled
    sampled = settle(sampled.select("sample_id", "fragment_key", "entry_round", "rank_hex"))
    return sampling.within_sample(mappings, sampled, profile.sampling.seed, profile.sampling.hash), sampled


def look_calls(
    mappings: DataFrame,
    manifest: DataFrame,
    sampled: DataFrame,
    profile: Profile,
    samples: DataFrame | None = None,
) -> DataFrame:
    """Candidate calls of every look, with look markers.

    With seeded ranks (``rank_hex``), mappings of fragments beyond their sample's largest rank go before they move.
    """
    classified = hits.usable_contigs(manifest)
    mappings, sampled = of_sample(mappings, sampled, profile)
    fragments = fragment_table(mappings, classified, profile.fragment, sampled)
    return aggregate.candidate_calls(
        fragments, classified, profile.sampling.look_count, "entry_round", samples
    )


def evaluated_looks(calls: DataFrame, profile: Profile, sample_controls=None, background=None, reasons=True) -> DataFrame:
    """Control annotation, gates and statuses for every look."""
    annotated = control.background_ratio(calls, sample_controls, background) if reasons else calls
    return decision.evaluate_calls(
        annotated, profile.sampling.look_count, profile.candidate, profile.decision, reasons
    )


@dataclass(frozen=True)
class Screening:
    """``contig_violations`` and ``rejected_hits`` are what the panel could not take, ``round_plan`` the sampling accounting."""

    evaluated: DataFrame
    looks: DataFrame
    final_calls: DataFrame
    decisions: DataFrame
    rounds: DataFrame
    runs: DataFrame
    contig_violations: DataFrame
    rejected_hits: DataFrame
    round_plan: DataFrame


def sample_fragments(fragments: DataFrame, profile: Profile, order_col: str = "record_number") -> DataFrame:
    """Sampled fragments with their entry round, by seeded rank or by input order."""
    plan = profile.sampling
    if plan.mode == "streaming":
        return sampling.prefix_entry_round(fragments, order_col, plan.rounds)
    return sampling.entry_round(fragments, plan)


def screen(
    fragments: DataFrame,
    mappings: DataFrame,
    manifest: DataFrame,
    profile: Profile,
    sample_controls: DataFrame | None = None,
    background: DataFrame | None = None,
    gates: DataFrame | None = None,
    bundle_version: str | None = None,
    backend: str | None = None,
    input_kind: str | None = None,
) -> Screening:
    """Reads and hits of a cohort to decisions and release statuses.

    ``sample_controls`` and ``background`` come from the control operators; ``gates`` has
    the calibration gates of the profile, in one row, or one row for each ``profile_id``.
    Reads are read and judged once; what follows works on their keys and verdicts. A sample
    with hits that no usable contig takes is blocked from release. A profile that is not for the given ``bundle_version``,
    ``backend`` or ``input_kind`` (see :func:`siftline.sources.fastq.input_kind`) is an error, before anything is read.
    """
    if problems := profile.problems(bundle_version, backend, input_kind):
        raise ValueError("; ".join(problems))
    judged = settle(
        qc.qc_verdict(fragments, profile.qc).select("sample_id", "fragment_key", "record_number", F.struct("qc.reason").alias("qc"))
    )
    stats = settle(qc.qc_stats(judged))
    passing = judged.filter("qc.reason = 'pass'").drop("qc")
    sampled = sample_fragments(passing, profile)
    calls = look_calls(mappings, manifest, sampled, profile, samples=stats.select("sample_id"))
    # A few rows per sample, candidate and look; several outputs read it.
    evaluated = settle(evaluated_looks(calls, profile, sample_controls, background))
    looks = decision.decide(evaluated, profile.sampling.look_count, profile.decision)
    decisions = decision.sample_decisions(looks)
    runs = summary.run_summary(decisions, stats, profile.run, profile.sampling)
    contigs = hits.classify_contigs(manifest)
    rejected = settle(hits.rejected_hits(mappings, contigs))
    counts = rejected.groupBy("sample_id").agg(F.sum("hits").alias("rejected_hits"))
    runs = runs.join(counts, "sample_id", "left").withColumn("rejected_hits", F.coalesce("rejected_hits", F.lit(0)))
    runs = attach_release_inputs(runs, profile, sample_controls, gates)
    totals = stats.select("sample_id", F.col("passed_fragments").alias("qc_passing_fragments"))
    return Screening(
        evaluated=evaluated,
        looks=looks,
        final_calls=decision.final_calls(evaluated, looks),
        decisions=decisions,
        rounds=decision.round_records(looks),
        runs=release.release_status(runs),
        contig_violations=contigs.filter("violation IS NOT NULL"),
        rejected_hits=rejected,
        round_plan=sampling.plan_report(totals, profile.sampling),
    )


def attach_release_inputs(runs: DataFrame, profile: Profile, sample_controls=None, gates=None) -> DataFrame:
    """Add control status and calibration gates to run rows.

    ``gates`` describes calibration profiles, not samples; the profile of the run must have one row there.
    """
    if sample_controls is None:
        runs = runs.withColumns(
            {
                "control_id": F.lit(None).cast("string"),
                "control_status": F.lit(None).cast("string"),
                "negative_control_status": F.lit("missing"),
                "negative_control_required": F.lit(profile.run.negative_control_required),
            }
        )
    else:
        columns = ("control_id", "control_status", "negative_control_status", "negative_control_required")
        runs = runs.join(sample_controls.select("sample_id", *columns), "sample_id", "left").withColumn(
            "negative_control_status", F.coalesce("negative_control_status", F.lit("missing"))
        )
    if gates is None:
        from siftline.schema import GATES

        return runs.withColumn("gates", F.lit(None).cast(f"struct<{GATES}>"))
    if "profile_id" in gates.columns:
        gates = gates.filter(F.col("profile_id") == profile.run.calibration_profile_version)
    one = gates.select(F.struct("backend_gate", "reference_gate", "specificity_gate", "sensitivity_gate").alias("gates"))
    texts = one.select(F.to_json("gates")).take(2)
    if len(texts) != 1:
        raise ValueError(f"calibration profile {profile.run.calibration_profile_version} has {'several rows' if texts else 'no row'} of gates")
    return runs.withColumn("gates", F.from_json(F.lit(texts[0][0]), one.schema["gates"].dataType))
