"""Hits, adjudication, aggregation, decisions."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from siftline.config import CandidateRules, DecisionRules, FragmentRules, Profile, SamplingPlan
from siftline import adapters as A
from siftline.checks import queries as Q
from siftline.checks.settings import PLAN, PROFILE
from siftline.operators import adjudicate, aggregate, calibration, decision, hits, sampling
from siftline.plans import screen, sequential
from siftline.tuning import settle
from siftline.schema import HITS, MANIFEST

PANEL = [
    ("chr1", "CHM1", 9606, "human", None, "human", 1024, "r", "host-genome", []),
    ("va", "NC1.1", 11, "alpha", None, "orga", 500, "r", "refseq-virus", []),
    ("vb", "NC1.1", 11, "alpha", None, "orga", 700, "r", "refseq-virus", []),
    ("vc", "NC2.1", 12, "gamma", None, "orga", 300, "r", "spike_in virus", []),
    ("ad", "D1", 32630, "adapter", None, "decoy", 224, "r", "adapter-decoy", []),
]


def panel(spark):
    return spark.createDataFrame(PANEL, MANIFEST)


def mapping(fragment, contig, mate=1, mapq=60, score=100, nm=1, primary=True, supplementary=False, start=0, end=90, sample="s"):
    return (sample, fragment, mate, contig, mapq, score, nm, primary, supplementary, 0, start, end)


def pair(fragment, contig, **kw):
    return [mapping(fragment, contig, mate=m, **kw) for m in (1, 2)]


def table(spark, rows):
    return spark.createDataFrame(rows, HITS)


def classes(spark, rows, rules=FragmentRules()):
    out = screen.fragment_table(table(spark, rows), hits.usable_contigs(panel(spark)), rules)
    return {r.fragment_key: r.fragment_class for r in out.collect()}


def test_fragment_classes(spark):
    rows = (
        pair("virus", "va")
        + pair("host", "chr1")
        + pair("tie", "va", score=80) + pair("tie", "chr1", score=80)
        + pair("close", "va", score=90) + pair("close", "chr1", score=85)
        + pair("low_mapq", "va", mapq=5)
        + pair("no_nm", "va", nm=None)
        + [mapping("single", "va")]
        + pair("decoy", "ad")
        + pair("secondary_decoy", "ad", primary=False)
        + pair("no_host_score", "va", score=90) + pair("no_host_score", "chr1", score=None)
    )
    assert classes(spark, rows) == {
        "virus": "virus",
        "host": "host",
        "tie": "host",
        "close": "ambiguous",
        "low_mapq": "ambiguous",
        "no_nm": "ambiguous",
        "single": "ambiguous",
        "decoy": "unmapped",
        "secondary_decoy": "ambiguous",
        "no_host_score": "ambiguous",
    }
    assert classes(spark, [mapping("single", "va")], FragmentRules(require_pair_consistency=False)) == {"single": "virus"}


def test_best_hit_order(spark):
    # A consistent pair beats a better score; names break exact ties.
    rows = pair("f", "vb", score=50) + [mapping("f", "va", score=100)] + pair("g", "vb") + pair("g", "va")
    out = screen.fragment_table(table(spark, rows), hits.usable_contigs(panel(spark)), FragmentRules())
    assert {r.fragment_key: r.virus.contig for r in out.collect()} == {"f": "vb", "g": "va"}


def test_unknown_contigs_are_reported(spark):
    rows = table(spark, pair("f", "va") + pair("f", "nope"))
    assert hits.unknown_contig_hits(rows, hits.usable_contigs(panel(spark))).count() == 2


def test_classification_conflicts(spark):
    rows = spark.createDataFrame([("a", "virus", "host"), ("b", "x", "y"), ("c", "Viral Panel", "z"), ("d", "x", "virus"), ("d", "x", "virus")], "contig STRING, `group` STRING, source_type STRING")
    got = sorted((r.contig, r["class"], r.violation) for r in hits.classify_contigs(rows).collect())
    assert got[0] == ("a", None, "conflicting_class")
    assert got[1] == ("b", None, "unclassified")
    assert got[2] == ("c", "virus", None)
    assert got[3][2] == "duplicate_contig"


def brute_schedule(spans):
    count, last = 0, -1
    for end, start in sorted((e, s) for s, e in spans if e > s):
        if start >= last:
            count, last = count + 1, end
    return count


def brute_union(spans):
    blocks = []
    for start, end in sorted(s for s in spans if s[1] > s[0]):
        if blocks and start < blocks[-1][1]:
            blocks[-1][1] = max(blocks[-1][1], end)
        else:
            blocks.append([start, end])
    return len(blocks), sum(e - s for s, e in blocks)


def per_contig(spark, spans, entry=None):
    rows = []
    for i, (start, end) in enumerate(spans):
        r = entry[i] if entry else 1
        rows += [("s", r, "s", None, None, None), ("s", r, "v", "va", None, None)]
        if end > start:
            rows += [("s", r, "u", "va", start, end), ("s", r, "g", "va", end, start)]
    evidence = spark.createDataFrame(rows, "sample_id STRING, entry_round INT, kind STRING, contig STRING, pos BIGINT, val BIGINT")
    return aggregate.cumulative_rounds(aggregate.reduce_evidence(evidence), max(entry or [1]))


def test_interval_goldens(spark):
    greedy = [(0, 10), (1, 2), (2, 3), (3, 3), (3, 4), (3, 9), (9, 10)]
    row = per_contig(spark, greedy).filter("contig = 'va'").first()
    assert row.nonoverlap == 4 and row.accepted == 7
    row = per_contig(spark, [(0, 100), (50, 150), (150, 200), (180, 240)]).filter("contig = 'va'").first()
    assert (row.blocks, row.covered) == (2, 240)


@pytest.mark.parametrize("seed", range(4))
def test_intervals_match_brute_force(spark, seed):
    rng = random.Random(seed)
    spans = [(s, s + rng.randint(0, 25)) for s in (rng.randint(0, 150) for _ in range(60))]
    entry = [rng.randint(1, 3) for _ in spans]
    for row in per_contig(spark, spans, entry).filter("contig = 'va'").collect():
        upto = [s for s, r in zip(spans, entry) if r <= row["round"]]
        assert row.nonoverlap == brute_schedule(upto)
        assert (row.blocks, row.covered) == brute_union(upto)
    frame = spark.createDataFrame([("s", *s) for s in spans], "k STRING, start BIGINT, end BIGINT")
    blocks = aggregate.merged_blocks(frame, ["k"]).collect()
    assert (len(blocks), sum(b.block_end - b.block_start for b in blocks)) == brute_union(spans)


def test_two_levels_and_identity(spark):
    rows = (
        pair("a", "va", start=0, end=90)
        + pair("b", "va", start=200, end=290)
        + pair("c", "vc", start=10, end=100)
        + pair("amb", "vb", score=90, mapq=1)
    )
    calls = screen.single_look_calls(table(spark, rows), panel(spark), Profile())
    got = {(r.aggregation_level, r.accession_or_group): r for r in calls.filter("aggregation_level IS NOT NULL").collect()}
    first = got[("accession", "NC1.1")]
    assert (first.accepted_fragments, first.nonoverlap_fragments, first.ambiguous_fragments) == (2, 2, 1)
    # Breadth counts every contig seen, ambiguous-only ones included.
    assert first.breadth == pytest.approx(180 / 1200)
    group = got[("group", "orga")]
    assert (group.virus_name, group.taxid, group.accepted_fragments) == ("orga", 0, 3)
    assert first.fraction_ci_95_low == pytest.approx(0.15003570882017148)
    assert first.total_sampled_fragments == 4


# The decision replay table (accepted, sampled, breadth, strength, look, truth, expected).
REPLAY = [
    ("single_fragment_5k", 1, 5_000, 1e-4, "high", 1, "negative", "indeterminate"),
    ("single_fragment_20k", 1, 20_000, 1e-4, "high", 2, "negative", "indeterminate"),
    ("low_evidence_signal", 10, 10_000, 0.01, "low", 4, "negative", "weak_positive"),
    ("nonzero_low_noise_negative", 1, 400_000, 1e-4, "insufficient", 4, "negative", "negative"),
    ("unknown_background_signal", 10, 10_000, 0.01, "high", 4, "positive", "positive"),
    ("hpv18_like_stable_low_signal", 8, 10_000, 0.008, "moderate", 4, "positive", "weak_positive"),
]


def replay_calls(spark):
    rows = [
        (i, 3, "group", "group", i, k, k, n, k / n, b, 0, s, 2e-6 if i == "nonzero_low_noise_negative" else k / n, 44, 4, look, t, e)
        for i, k, n, b, s, look, t, e in REPLAY
    ]
    return spark.createDataFrame(
        rows,
        "sample_id STRING, round INT, aggregation_level STRING, multiplicity_family STRING, accession_or_group STRING, accepted_fragments BIGINT, "
        "nonoverlap_fragments BIGINT, total_sampled_fragments BIGINT, unique_fraction DOUBLE, breadth DOUBLE, ambiguous_fragments BIGINT, "
        "evidence_strength STRING, clopper_pearson_upper DOUBLE, candidate_family_size BIGINT, planned_round_look_count BIGINT, "
        "current_look_index BIGINT, truth STRING, expected STRING",
    )


def test_replay_table(spark):
    rules = CandidateRules(theta_pos_absolute=3, min_positive_evidence_strength="high")
    rows = decision.evaluate_calls(replay_calls(spark), 4, rules, DecisionRules(), reasons=False, context=False)
    assert {r.sample_id: r.decision for r in rows.collect()} == {r[0]: r[-1] for r in REPLAY}
    labelled = rows.withColumn("virus_name", F.col("sample_id")).withColumn("release_status", F.lit("final"))
    total = calibration.confusion_metrics(labelled).filter("virus_name IS NULL").first()
    assert (total.false_positives, total.false_negatives, total.weak_positive_count) == (0, 0, 2)
    assert (total.specificity, total.sensitivity) == (1.0, 1.0)


def looks_from(spark, rows, rounds):
    """rows: (round, level, id, accepted, nonoverlap, ambiguous, total); a marker row per look is added."""
    columns = (
        "sample_id STRING, round INT, aggregation_level STRING, multiplicity_family STRING, accession_or_group STRING, accepted_fragments BIGINT, "
        "nonoverlap_fragments BIGINT, ambiguous_fragments BIGINT, total_sampled_fragments BIGINT, unique_fraction DOUBLE, breadth DOUBLE, "
        "evidence_strength STRING, clopper_pearson_upper DOUBLE"
    )
    data = [("s", r, lv, lv, i, k, no, a, n, k / n, 0.5, "high", 1.0 if k else 0.0) for r, lv, i, k, no, a, n in rows]
    data += [("s", r, None, None, None, 0, 0, 0, 1000, 0.0, 0.0, "low", None) for r in range(1, rounds + 1)]
    frame = spark.createDataFrame(data, columns)
    return decision.decide(decision.evaluate_calls(frame, rounds, reasons=False), rounds)


def test_group_positive_needs_the_preceding_look(spark):
    rows = [(r, "group", "g", 50, 50, 40, 1000) for r in (1, 2, 3)]
    out = decision.sample_decisions(looks_from(spark, rows, 3)).first()
    assert (out.decision_status, out.rounds_run, out.stop_reason) == ("positive", 2, "positive_boundary_crossed")
    gap = [(r, "group", "g", 50, 50, 40, 1000) for r in (1, 3)]
    out = decision.sample_decisions(looks_from(spark, gap, 3)).first()
    assert (out.decision_status, out.rounds_run) == ("negative", 2)
    other = [(1, "group", "g", 50, 50, 0, 1000), (2, "group", "h", 50, 50, 0, 1000)]
    out = decision.sample_decisions(looks_from(spark, other, 2)).first()
    assert (out.decision_status, out.stop_reason) == ("positive", "max_rounds_reached")


def test_accession_positive_stops_at_once(spark):
    rows = [(1, "accession", "a", 50, 50, 0, 1000), (1, "group", "g", 50, 50, 0, 1000)]
    out = decision.sample_decisions(looks_from(spark, rows, 3)).first()
    assert (out.decision_status, out.rounds_run, out.accepted_virus) == ("positive", 1, 50)


def test_looks_without_candidates_confirm_negative(spark):
    out = decision.sample_decisions(looks_from(spark, [], 3)).first()
    assert (out.decision_status, out.rounds_run, out.stop_reason) == ("negative", 2, "negative_boundary_confirmed")
    single = decision.sample_decisions(looks_from(spark, [], 1)).first()
    assert (single.decision_status, single.stop_reason) == ("indeterminate", "max_rounds_reached")


def test_screen_end_to_end(spark):
    good = ("ACGGTCATTGCAAGCT" * 7)[:100]
    reads = [(s, f"{s}{i}", good, "", good if i % 10 else "", "", i) for s in ("clean", "titer") for i in range(200)]
    fragments = spark.createDataFrame(
        reads, "sample_id STRING, fragment_key STRING, r1_seq STRING, r1_qual STRING, r2_seq STRING, r2_qual STRING, record_number BIGINT"
    )
    rows = [m for i in range(200) for m in pair(f"clean{i}", "chr1", sample="clean")]
    for i in range(200):
        virus = i % 3 == 0
        rows += pair(f"titer{i}", "va" if virus else "chr1", start=(i * 2) % 400, end=(i * 2) % 400 + 90, sample="titer")
    profile = Profile(sampling=SamplingPlan(seed=1, rounds=(50, 100)))
    result = screen.screen(fragments, table(spark, rows), panel(spark), profile)
    runs = {r.sample_id: r for r in result.runs.collect()}
    assert (runs["clean"].decision_status, runs["clean"].rounds_run) == ("negative", 2)
    assert (runs["titer"].decision_status, runs["titer"].rounds_run, runs["titer"].sampled_fragments) == ("positive", 1, 50)
    assert runs["clean"].input_fragments == 200 and runs["clean"].qc_passing_fragments == 180
    assert runs["clean"].release_status == "blocked"
    assert runs["clean"].release_primary_blockers == ["missing_calibration_release_gate"]
    assert {r.sample_id for r in result.final_calls.collect()} == {"titer"}
    assert result.contig_violations.count() == 0 and result.rejected_hits.count() == 0
    plan = {r.sample_id: r for r in result.round_plan.collect()}["clean"]
    assert (plan.round_mode, plan.requested_rounds, plan.effective_counts, plan.qc_passing_denominator) == ("absolute", [50, 100], [50, 100], 180)
    # Hits on a contig that stands twice, or not at all, are reported and block their sample.
    twice = panel(spark).unionByName(panel(spark).filter("contig = 'va'"))
    stray = rows + pair("clean0", "nowhere", sample="clean")
    bad = screen.screen(fragments, table(spark, stray), twice, profile)
    assert {(r.sample_id, r.contig, r.problem, r.hits) for r in bad.rejected_hits.collect()} == {("titer", "va", "duplicate_contig", 134), ("clean", "nowhere", "unknown_contig", 2)}
    assert {r.contig for r in bad.contig_violations.collect()} == {"va"}
    assert all("rejected_hits" in r.release_primary_blockers for r in bad.runs.collect())
    gates = spark.createDataFrame([("profile-1", "pass"), ("profile-2", "fail")], "profile_id STRING, status STRING").select("profile_id", *(F.struct("status").alias(f"{g}_gate") for g in ("backend", "reference", "specificity", "sensitivity")))
    passed = {r.sample_id: r for r in screen.screen(fragments, table(spark, rows), panel(spark), profile, gates=gates).runs.collect()}
    assert passed["clean"].release_status == "final"
    with pytest.raises(ValueError):
        screen.attach_release_inputs(result.runs.drop("gates", "negative_control_status", "control_id", "control_status", "negative_control_required"), profile, gates=gates.drop("profile_id"))
    streaming = Profile(sampling=SamplingPlan(mode="streaming", rounds=(50, 100)))
    live = {r.sample_id: r for r in screen.screen(fragments, table(spark, rows), panel(spark), streaming).runs.collect()}
    assert live["titer"].decision_status == "positive"
    assert "non_representative_sampling_mode" in live["titer"].release_secondary_blockers


def test_cutoff_filters_before_mappings_move(spark, sf_dir):
    sampled = settle(Q.sampled_fragments(spark, sf_dir))
    mappings = settle(Q.table(spark, sf_dir, A.HITS))
    kept = sampling.within_sample(mappings, sampled, PLAN.seed)
    keys = ["sample_id", "fragment_key"]
    assert sorted(kept.join(sampled, keys, "left_semi").collect()) == sorted(mappings.join(sampled, keys, "left_semi").collect())
    share = sampled.count() / mappings.select(keys).distinct().count()
    assert kept.count() < 1.2 * share * mappings.count()
    plan = screen.look_calls(mappings, Q.table(spark, sf_dir, A.MANIFEST), sampled, PROFILE)._jdf.queryExecution().executedPlan().toString()
    lines = plan[plan.index("Initial Plan") if "Initial Plan" in plan else 0 :].splitlines()
    filtered = next(i for i, line in enumerate(lines) if "md5" in line)
    # Below the filter, toward the mappings, nothing is shuffled but the cutoffs that are broadcast.
    assert "Exchange hashpartitioning" in "".join(lines[:filtered])
    scans = [i for i, line in enumerate(lines) if "Scan ExistingRDD" in line and i > filtered and "target_start" in line]
    assert scans and not any("Exchange hashpartitioning" in line for line in lines[filtered : scans[0]])


def test_looks_one_by_one_do_not_read_stopped_samples(spark, sf_dir, tmp_path):
    lax = dataclasses.replace(
        PROFILE.candidate, max_ambiguous_fraction_for_positive=5.0, min_nonoverlap_fragments=5, min_breadth=0.05, theta_pos_absolute=5
    )
    profile = dataclasses.replace(PROFILE, candidate=lax, sampling=dataclasses.replace(PLAN, rounds=(200, 400, 800)))
    sampled = settle(sampling.entry_round(Q.table(spark, sf_dir, A.HIT_FRAGMENTS), profile.sampling))
    mappings, manifest = Q.table(spark, sf_dir, A.HITS), Q.table(spark, sf_dir, A.MANIFEST)
    every = settle(screen.evaluated_looks(screen.look_calls(mappings, manifest, sampled, profile), profile))
    stops = {r.sample_id: r.rounds_run for r in decision.sample_decisions(decision.decide(every, PLAN.look_count, profile.decision)).collect()}
    assert min(stops.values()) < PLAN.look_count
    folder = str(tmp_path / "rounds")
    sequential.split_by_round(mappings, sampled, profile, folder)
    spoilt = 0
    for sample, stop in stops.items():
        for later in range(stop + 1, PLAN.look_count + 1):
            for file in (tmp_path / "rounds" / f"entry_round={later}" / f"place=s-{sample}").glob("*.parquet"):
                file.write_bytes(b"unreadable")
                spoilt += 1
    assert spoilt
    found = sequential.look_by_look(folder, manifest, sampled.select("sample_id"), profile)
    upto = F.element_at(F.create_map(*[F.lit(x) for pair in stops.items() for x in pair]), F.col("sample_id"))
    columns = [c for c in every.columns if c in found.evaluated.columns]
    spelled = lambda df: sorted(map(repr, df.filter(F.col("round") <= upto).select(columns).collect()))
    assert set(columns) == set(every.columns) and spelled(found.evaluated) == spelled(every)
    assert {r.sample_id: r.rounds_run for r in decision.sample_decisions(found.looks).collect()} == stops


def test_profile_must_fit_the_run(spark):
    run = dataclasses.replace(PROFILE.run, supported_input=("fastq_pair",))
    profile = dataclasses.replace(PROFILE, run=run)
    assert profile.problems("bundle-1", "seed-vote", "fastq_pair") == [] == PROFILE.problems(input_kind="records")
    assert len(profile.problems("bundle-2", "other", "records")) == 3
    with pytest.raises(ValueError, match="reference bundle `bundle-1`, not `bundle-2`"):
        screen.screen(None, None, None, profile, bundle_version="bundle-2")
