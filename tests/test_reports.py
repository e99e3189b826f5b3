"""Controls, release, summaries, sinks and audit."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siftline import labels as L
from siftline.checks import report_queries as R
from siftline.operators import audit, control, release, summary
from siftline.plans.audit import audit_bundles
from siftline.sources import sinks
from siftline.tuning import settle


def call(entity, level="group", accepted=1, fraction=0.1, breadth=0.1, decision="positive", strength="high", reasons=(), name="n"):
    return ("s", level, level, entity, name, 1, accepted, accepted, 1, 0, fraction, fraction, fraction / 2, fraction * 2, fraction, 100, breadth, decision, strength, list(reasons))


CALLS = (
    "sample_id STRING, aggregation_level STRING, multiplicity_family STRING, accession_or_group STRING, virus_name STRING, taxid BIGINT, accepted_fragments BIGINT, "
    "nonoverlap_fragments BIGINT, coverage_interval_blocks BIGINT, ambiguous_fragments BIGINT, raw_fraction DOUBLE, unique_fraction DOUBLE, fraction_ci_95_low DOUBLE, "
    "fraction_ci_95_high DOUBLE, clopper_pearson_upper DOUBLE, total_sampled_fragments BIGINT, breadth DOUBLE, decision STRING, evidence_strength STRING, decision_reasons ARRAY<STRING>"
)


def calls(spark, rows):
    frame = spark.createDataFrame(rows, CALLS)
    labels = {"nonoverlap_fragments_algorithm": L.NONOVERLAP_ALGORITHM, "accepted_fraction_label": L.ACCEPTED_FRACTION_LABEL, "unique_fraction_label": L.UNIQUE_FRACTION_LABEL, "fraction_denominator_source": L.DENOMINATOR_SOURCE}
    return frame.withColumns({k: F.lit(v) for k, v in labels.items()})


def test_summary_keeps_the_strongest_row_and_all_reasons(spark):
    base = ("aggregation_level=group", "supporting_accession=A1")
    rows = [
        call("g", accepted=5, fraction=0.05, reasons=(*base, "supporting_accession_name=old", "weak")),
        call("g", accepted=9, fraction=0.09, reasons=(*base, "supporting_accession_name=new", "strong")),
        call("g", accepted=2, fraction=0.02, decision="negative", reasons=("aggregation_level=group", "supporting_accession=A2")),
    ]
    row = summary.virus_summary(calls(spark, rows)).first()
    assert (row.accepted_fragments, row.supporting_accession_count, row.top_accession, row.top_accession_name) == (11, 2, "A1", "new")
    assert row.unique_fraction == pytest.approx(0.11)
    assert {"weak", "strong"} <= set(row.decision_reasons) and row.decision_reasons == sorted(row.decision_reasons)


def test_entity_counts_fall_back_to_accessions(spark):
    rows = [call("a", "accession"), call("b", "accession", decision="negative")]
    row = summary.entity_counts(calls(spark, rows)).first()
    assert (row.positive_entity_count, row.negative_entity_count) == (1, 1)
    row = summary.entity_counts(calls(spark, rows + [call("g", decision="weak_positive")])).first()
    assert (row.positive_entity_count, row.weak_positive_entity_count) == (0, 1)
    assert summary.top_results(calls(spark, rows)).filter("list = 'top_detections'").count() == 2


def test_background_ratio(spark):
    rows = calls(spark, [call("a"), call("b"), call("c", fraction=0.0)]).withColumn("background_ratio", F.lit(0.0))
    controls = spark.createDataFrame([("n1", "pass")], "control_id STRING, control_status STRING")
    status = control.control_status(spark.createDataFrame([("s", "n1")], "sample_id STRING, control_id STRING"), controls)
    found = spark.createDataFrame([("n1", "a", 0.02), ("n1", "a", 0.05)], "control_id STRING, accession_or_group STRING, unique_fraction DOUBLE")
    out = {r.accession_or_group: r for r in control.background_ratio(rows, status, control.background(found)).collect()}
    assert out["a"].background_ratio == pytest.approx(2.0)
    assert out["b"].background_ratio == float("inf") and out["c"].background_ratio == 0.0
    assert "background_ratio_metadata_only=2.000000" in out["a"].decision_reasons


def test_weak_positive_is_never_final(spark):
    gates = "struct<" + ", ".join(f"{g}_gate: struct<status: string>" for g in ("backend", "reference", "specificity", "sensitivity")) + ">"
    rows = spark.createDataFrame([("a", "weak_positive"), ("b", "positive")], "sample_id STRING, decision_status STRING").withColumns(
        {
            "profile_status": F.lit("ok"),
            "negative_control_status": F.lit("missing"),
            "sampling_mode": F.lit("representative"),
            "gates": F.from_json(F.lit('{"backend_gate": {"status": "pass"}}'), gates),
        }
    )
    out = {r.sample_id: r for r in release.release_status(rows).collect()}
    assert out["a"].release_status == "provisional" and out["b"].release_status == "final"
    assert out["a"].release_secondary_blockers == ["weak_positive_requires_provisional_release"]


@pytest.fixture(scope="module")
def bundle(spark, sf_dir):
    return settle(R.bundles(spark, sf_dir))


def failures(files, **kw):
    return {(r.sample_id, r["check"]) for r in audit_bundles(files, "bundle-1", **kw).filter("status = 'fail'").collect()}


def test_clean_bundles_pass(spark, bundle):
    checks = settle(audit_bundles(bundle, "bundle-1"))
    assert checks.filter("status = 'fail'").count() == 0
    assert checks.filter("status = 'pass'").count() > 20
    verdicts = audit.audit_verdict(checks).collect()
    assert len(verdicts) == 3 and all(v.verdict == "PASS" for v in verdicts)


TAMPERING = [
    ("results/sampling_rounds.tsv", lambda c: F.concat(c, F.lit("1\t1\tnegative\n")), {"dual-layout rounds TSV", "rounds.tsv", "canonical sample summary facts", "checksum.sha256"}),
    ("run_manifest.json", lambda c: F.replace(c, F.lit("bundle-1"), F.lit("bundle-9")), {"dual-layout run manifest", "checksum.sha256"}),
    ("summary/result_overview.json", lambda c: F.replace(c, F.lit("seed-vote"), F.lit("other")), {"canonical result overview facts"}),
    ("audit/schema_versions.json", lambda c: F.replace(c, F.lit("v4"), F.lit("v3")), {"schema metadata contract"}),
    ("results/candidate_calls.accession.tsv", lambda c: F.replace(c, F.lit("fraction_ci_95_label="), F.lit("other=")), {"candidate CI labeling", "dual-layout candidate TSV"}),
    ("summary/virus_summary.tsv", lambda c: F.concat(F.lit("x"), c), {"table headers"}),
    ("summary/sample_run_summary.json", lambda c: F.regexp_replace(c, '"sample_id":"A"', '"sample_id":"B"'), {"canonical sample summary facts"}),
    ("summary/result_overview.json", lambda c: F.regexp_replace(c, '"sample_id":"A"', '"sample_id":"B"'), {"canonical result overview facts"}),
    ("summary/virus_summary.tsv", lambda c: F.concat(c, F.lit("1\ttwo cells\n")), {"readable documents"}),
    ("results/candidate_calls.accession.tsv", lambda c: F.concat(c, F.lit("x\ty\n")), {"readable documents", "candidate CI labeling", "candidate_calls.accession.tsv"}),
    ("results/candidate_calls.accession.tsv", lambda c: F.regexp_replace(c, "\\[[0-9.eE-]+,[0-9.eE-]+\\]", "none"), {"candidate CI labeling"}),
    ("sample_summary.json", lambda c: F.concat(F.lit("{"), c), {"readable documents"}),
    ("checksum.sha256", lambda c: F.concat(c, F.lit("zz  nowhere\n")), {"checksum.sha256", "dual-layout checksum inventory"}),
]


@pytest.mark.parametrize("path,change,expected", TAMPERING, ids=[f"{i}-{t[0]}" for i, t in enumerate(TAMPERING)])
def test_tampering_is_found(spark, bundle, path, change, expected):
    victim = (F.col("sample_id") == "A") & (F.col("path") == path)
    tampered = bundle.withColumn("content", F.when(victim, change(F.col("content"))).otherwise(F.col("content")))
    found = failures(tampered)
    assert {s for s, _ in found} == {"A"}
    assert expected <= {c for _, c in found}


def test_unreadable_documents_do_not_agree(spark, bundle):
    victims = (F.col("sample_id") == "A") & F.col("path").isin("sample_summary.json", "run_manifest.json", "provenance/run_manifest.json")
    broken = bundle.withColumn("content", F.when(victims, "not json").otherwise(F.col("content")))
    found = {(r["check"]): r.status for r in audit_bundles(broken, "bundle-1").filter("sample_id = 'A'").collect()}
    assert found["readable documents"] == "fail" and found["dual-layout run manifest"] == "fail"
    assert found["report bundle bindings"] == "skip" and found["canonical sample summary facts"] == "skip"


def test_bundle_without_files_fails(spark, bundle):
    named = bundle.select("sample_id").distinct().unionByName(spark.createDataFrame([("gone",)], "sample_id STRING"))
    rows = audit_bundles(bundle, "bundle-1", bundles=named).filter("sample_id = 'gone'").collect()
    assert {r["check"] for r in rows if r.status == "fail"} == {"report bundle completeness"}
    assert {r.status for r in rows} == {"fail", "skip"}


def test_missing_file_is_found(spark, bundle):
    found = failures(bundle.filter(~((F.col("sample_id") == "N") & (F.col("path") == "rounds.tsv"))))
    assert ("N", "report bundle completeness") in found and ("N", "checksum.sha256") in found


def test_release_recomputation(spark, bundle):
    profiles = bundle.select("sample_id").distinct().selectExpr(
        "sample_id", "'profile-1' AS profile_id", "'bundle-1' AS reference_bundle", "'seed-vote' AS profile_backend",
        "'release_candidate' AS profile_status", "'representative' AS profile_sampling_mode", "false AS profile_control_required",
        "CAST(NULL AS struct<backend_gate: struct<status: string>, reference_gate: struct<status: string>, specificity_gate: struct<status: string>, sensitivity_gate: struct<status: string>>) AS gates",
    )
    assert failures(bundle, profiles=profiles) == set()
    victim = (F.col("sample_id") == "A") & (F.col("path") == "audit/release_gate.json")
    forged = bundle.withColumn("content", F.when(victim, F.replace("content", F.lit('"blocked"'), F.lit('"final"'))).otherwise(F.col("content")))
    assert ("A", "release_gate artifact blockers") in failures(forged, profiles=profiles)


def test_every_check_of_every_bundle_has_a_row(spark, bundle, sf_dir):
    settled = settle(R.bundles(spark, sf_dir, released=True))
    document = lambda path: settled.filter((F.col("sample_id") == "R") & (F.col("path") == path)).first().content
    assert '"release_primary_blockers":["rejected_hits"]' in document("sample_summary.json")
    assert '"round_mode":"absolute"' in document("run_manifest.json") and '"input_files":["R_R1.fastq","R_R2.fastq"]' in document("run_manifest.json")
    assert failures(settled, profiles=R.written_profiles(settled)) == set()
    # A forged count no longer explains the status.
    forged = settled.withColumn("content", F.replace("content", F.lit('"rejected_hits":'), F.lit('"x":')))
    assert ("R", "release_status compliance") in failures(forged, profiles=R.written_profiles(settled))
    every = {r["check"] for r in audit_bundles(settled, "bundle-1", R.written_profiles(settled)).collect()}
    for files, profiles in (
        (settled.filter("path <> 'provenance/run_manifest.json'"), R.written_profiles(settled)),
        (settled.filter("path <> 'sample_summary.json'"), R.written_profiles(settled)),
        (settled, R.written_profiles(settled).filter("sample_id <> 'A'")),
        (settled, None),
    ):
        rows = audit_bundles(files, "bundle-1" if profiles is not None else None, profiles).collect()
        assert len(rows) == 3 * len(every) and {r["check"] for r in rows} == every
    unloaded = audit_bundles(settled, "bundle-1", R.written_profiles(settled).filter("sample_id <> 'A'"))
    assert {(r["check"], r.status) for r in unloaded.filter("sample_id = 'A' AND status <> 'pass'").collect()} == {
        ("calibration profile binding", "fail"), ("release_status compliance", "skip"), ("release_gate artifact blockers", "skip")
    }


def test_bundles_as_folders(spark, bundle, tmp_path):
    root = str(tmp_path / "bundles")
    assert sinks.write_bundles(bundle, root) == bundle.count()
    as_set = lambda df: {tuple(r) for r in df.select("sample_id", "path", "content").collect()}
    assert as_set(sinks.read_bundles(spark, root)) == as_set(bundle)
    records = sinks.commit_records(spark, root)
    assert sinks.commit_problems(sinks.read_bundles(spark, root), records).count() == 0
    (tmp_path / "bundles" / "A" / "rounds.tsv").write_text("x")
    (tmp_path / "bundles" / "N" / "more.txt").write_text("x")
    assert {tuple(r) for r in sinks.commit_problems(sinks.read_bundles(spark, root), records).collect()} == {
        ("A", "rounds.tsv", "size is not as committed"), ("N", "more.txt", "file was not committed")
    }
    twice = spark.createDataFrame([("s", n, "positive", ["aggregation_level=accession"]) for n in ("a b", "a/b")], "sample_id STRING, accession_or_group STRING, decision STRING, decision_reasons ARRAY<STRING>")
    assert sinks.coverage_index(twice)[1].first().copies == 2


def test_table_sinks_round_trip(spark, sf_dir, tmp_path):
    rows = settle(R.final_calls(spark, sf_dir, reasons=True))
    sinks.write_calls(rows, str(tmp_path / "calls"))
    back = spark.read.option("sep", "\t").option("header", True).option("escape", '"').csv(str(tmp_path / "calls"))
    assert back.count() == rows.count()
    assert set(back.columns) == {"sample_id", *L.CANDIDATE_CALLS_HEADER}
    assert back.filter("decision_reasons LIKE '[\"%'").count() == rows.count()
    files, duplicates = sinks.coverage_index(rows)
    assert duplicates.count() == 0
    sinks.write_documents(files.select("sample_id", F.col("file_name").alias("path"), "content"), str(tmp_path / "docs"))
    sinks.write_virus_summary(summary.virus_summary(rows), str(tmp_path / "summary"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "summary")).columns[:-1] == list(L.VIRUS_SUMMARY_HEADER)


def test_half_written_bundles_are_not_read(spark, tmp_path):
    root, rows = str(tmp_path / "out"), lambda texts: spark.createDataFrame([(s, p, t) for s, t in texts.items() for p in ("a.txt", "b/c.txt")], "sample_id string, path string, content string")
    contents = lambda: {(r.sample_id, r.path): r.content for r in sinks.read_bundles(spark, root).collect()}
    whole = lambda texts: {(s, p): t for s, t in texts.items() for p in ("a.txt", "b/c.txt")}
    assert sinks.write_bundles(rows({"one": "1", "two": "1"}), root) == 4
    assert contents() == whole({"one": "1", "two": "1"})
    # Tasks die in the first phase, after the other sample's files are staged: nothing changes.
    dies = rows({"one": "2"}).unionByName(rows({"two": "2"}).withColumn("content", F.raise_error(F.lit("killed")).cast("string")))
    with pytest.raises(Exception, match="killed"):
        sinks.write_bundles(dies, root)
    assert contents() == whole({"one": "1", "two": "1"})
    # The second phase stops between the move of a folder and its record; it is not read until the phase runs again.
    listing = settle(rows({"one": "3", "three": "3"}).mapInArrow(sinks.stage(f"{root}.staging/r3"), "sample_id string, path string, size long, sha256 string"))
    staged = tmp_path / "out.staging" / "r3"
    (staged / "one" / ".run").write_text("r3")
    (tmp_path / "out" / "one").rename(tmp_path / "aside")
    (staged / "one").rename(tmp_path / "out" / "one")
    assert contents() == whole({"two": "1"})
    assert sinks.publish(listing, root, "r3") == 2
    assert contents() == whole({"one": "3", "two": "1", "three": "3"})


def test_digests_of_files_beyond_two_gigabytes(spark, tmp_path):
    big, size = tmp_path / "files" / "deep" / "big.bin", (1 << 31) + 17
    big.parent.mkdir(parents=True)
    with open(big, "wb") as out:
        out.truncate(size)
        out.write(b"head")
    (tmp_path / "files" / "checksum.sha256").write_text("x")
    (tmp_path / "files" / "small.txt").write_text("y")
    digest = hashlib.sha256(b"head")
    left = size - 4
    while left:
        digest.update(bytes(min(left, 1 << 24)))
        left -= min(left, 1 << 24)
    found = {r.path: r.sha256 for r in sinks.checksum_inventory(spark, str(tmp_path / "files")).collect()}
    assert found == {"deep/big.bin": digest.hexdigest(), "small.txt": hashlib.sha256(b"y").hexdigest()}
