"""Rows are dealt to tasks by their number, and move once."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from siftline import tuning
from siftline.checks import report_queries
from siftline.operators import audit, hits

COLUMNS = (
    "sample_id string, fragment_key string, contig string, mate int, mapq int, as_score int, nm int, is_primary boolean, "
    "is_supplementary boolean, segment_id int, target_start long, target_end long"
)


def test_tasks_follow_the_rows(spark):
    least = spark.sparkContext.defaultParallelism
    for n, want in ((95, 10), (200, 20)):
        assert tuning.dealt(spark.range(n), "id", rows=10).rdd.getNumPartitions() == max(want, least)
    small = tuning.dealt(spark.range(5), "id", rows=10)
    assert small.count() == 5 and "REPARTITION_BY_COL" in small._jdf.queryExecution().executedPlan().toString()


def test_secondary_hits_by_hand_and_in_one_move(spark):
    rng = random.Random(8)
    rows = [
        (rng.choice(["s", "t", None]), rng.choice(["f1", "f2", "f3"]), rng.choice(["v", "h", "other", None]), rng.choice([1, 2, None]), i,
         None, 1, rng.random() < 0.5, rng.random() < 0.2, 0, rng.choice([-1, 5, 9]), 7)
        for i in range(120)
    ]
    frame = spark.createDataFrame(rows, COLUMNS)
    classified = spark.createDataFrame([("v", "virus"), ("h", "host"), ("unused", "decoy")], "contig string, class string")
    found = hits.secondary_hits(frame, classified)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Repartition") == 1
    want = []
    for s, f, c, _m, mapq, _a, _n, primary, supplementary, _g, start, end in rows:
        if s and c in ("v", "h") and (not primary or supplementary):
            mates = {r[3] for r in rows if r[:3] == (s, f, c)} - {None}
            flags = (1 in mates, 2 in mates, mates == {1, 2}) if mates else (None, None, None)
            place = (start, end) if 0 <= start <= end else (0, 0)
            want.append((s, f, c, {"v": "virus", "h": "host"}[c], mapq, None, 1, primary, supplementary, *flags, *place))
    assert want and sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    flags = found.select("sample_id", "fragment_key", "contig", "r1_mapped", "r2_mapped", "pair_consistent").distinct()
    assert flags.exceptAll(hits.aggregate_hits(frame).select(*flags.columns)).count() == 0
    assert hits.aggregate_hits(frame).agg(F.count("*")).first()[0] > 0


def test_bindings_meet_once_and_several_profiles_tell_the_others_once(spark):
    fields = "sample_id string, reference_bundle_version string, calibration_profile_version string, backend string, seed long"
    summary = spark.createDataFrame([("a", "b1", "p1", "x", 1), ("b", "b0", "p1", None, 2), ("c", "b1", "p9", "x", 3)], fields)
    manifest = spark.createDataFrame([("a", "b1", "p1", "x", 1), ("b", "b1", "p1", None, 2), ("c", "b1", "p9", "x", 4)], fields)
    profiles = spark.createDataFrame([("a", "p1", "b1", "x"), ("a", "p2", "b1", "x"), ("b", "p1", "b1", "x")], "sample_id string, profile_id string, reference_bundle string, profile_backend string")
    found = audit.audit_bindings(summary, manifest, "b1", profiles)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    got = sorted((r.sample_id, r.check.split()[0], r.status) for r in found.collect())
    assert got == [
        ("a", "calibration", "fail"), ("a", "calibration", "pass"), ("a", "reference", "pass"), ("a", "report", "pass"),
        ("b", "calibration", "fail"), ("b", "reference", "fail"), ("b", "report", "fail"),
        ("c", "calibration", "fail"), ("c", "reference", "pass"), ("c", "report", "fail"),
    ]
    details = {(r.sample_id, r.check.split()[0]): r.detail for r in found.collect()}
    assert details["c", "calibration"] == "no profile is loaded for the sample" and "backend is missing from both" in details["b", "report"]
    plain = audit.audit_bindings(summary, manifest)
    assert sorted((r.sample_id, r.status) for r in plain.collect()) == [("a", "pass"), ("b", "fail"), ("c", "fail")]


def test_fastq_files_of_both_mates_are_written_at_once(spark, sf_dir, monkeypatch):
    kept = []
    monkeypatch.setattr(report_queries, "settle", lambda df: kept.append(df) or df)
    folder = report_queries.fastq_files(spark, sf_dir)
    names = [sorted(str(p.relative_to(f"{folder}/mate={m}")) for p in Path(f"{folder}/mate={m}").glob("*/part-*")) for m in (1, 2)]
    assert names[0] and names[0] == names[1] and not kept
