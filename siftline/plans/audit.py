"""Audit of many report bundles in one job: parse the files, run every check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators import audit
from siftline.sources.sinks import checksum_table

# Document schemas.
SUMMARY = (
    "sample_id STRING, reference_bundle_version STRING, calibration_profile_version STRING, backend STRING, seed BIGINT, "
    "input_fragments BIGINT, qc_passing_fragments BIGINT, sampled_fragments BIGINT, rounds_run BIGINT, stop_reason STRING, "
    "decision_status STRING, release_status STRING, release_primary_blockers ARRAY<STRING>, release_secondary_blockers ARRAY<STRING>, "
    "rejected_hits BIGINT"
)
RUN_MANIFEST = (
    "reference_bundle_version STRING, calibration_profile_version STRING, backend STRING, seed BIGINT, sampling_mode STRING, "
    "negative_control STRUCT<required: BOOLEAN, status: STRING, control_id: STRING, control_status: STRING>"
)
OVERVIEW = (
    "sample STRUCT<sample_id: STRING, decision_status: STRING, release_status: STRING>, run STRUCT<reference_bundle_version: STRING, "
    "calibration_profile_version: STRING, backend: STRING, sampling_mode: STRING, negative_control_status: STRING>"
)
SCHEMAS = "report_bundle_schema STRING, canonical_outputs MAP<STRING, STRING>, legacy_outputs MAP<STRING, STRING>"
GATE = "status STRING, primary_blockers ARRAY<STRING>, secondary_blockers ARRAY<STRING>"


def _document(files: DataFrame, path: str, schema: str) -> DataFrame:
    """The readable documents at ``path``, one row a bundle; ``own_sample_id`` is the sample that the document names."""
    rows = files.filter((F.col("path") == path) & F.try_parse_json("content").isNotNull())
    parsed = F.from_json("content", schema, {"mode": "PERMISSIVE"})
    fields = [c.split()[0] for c in _fields(schema)]
    own = [F.col("d.sample_id").alias("own_sample_id")] if "sample_id" in fields else []
    return rows.select(F.col("sample_id").alias("bundle_id"), parsed.alias("d")).filter("d IS NOT NULL").select(
        F.col("bundle_id").alias("sample_id"), *own, *[F.col(f"d.{c}") for c in fields if c != "sample_id"]
    )


def _fields(schema: str) -> list[str]:
    depth, start, out = 0, 0, []
    for i, ch in enumerate(schema + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(schema[start:i].strip())
            start = i + 1
    return out


def _table(files: DataFrame, path: str) -> DataFrame:
    """All TSV rows as arrays of cells, whatever their number; quoted cells keep their doubled quotes undone."""
    rows = files.filter(F.col("path") == path).select("sample_id", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    unquote = lambda c: F.when(
        c.startswith('"') & c.endswith('"'),
        F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')),
    ).otherwise(c)
    cells = F.transform(F.split("line", "\t"), unquote)
    return rows.filter("n > 0 AND line <> ''").select("sample_id", "n", cells.alias("cells"))


def _calls(files: DataFrame, path: str, level: str) -> DataFrame:
    """Call rows; a row that is too short has null cells, and so offends in the checks of calls."""
    from siftline.labels import CANDIDATE_CALLS_HEADER as H

    cell = lambda name: F.get("cells", F.lit(H.index(name)))
    interval = F.from_json(cell("fraction_ci_95"), "ARRAY<DOUBLE>")
    return _table(files, path).select(
        "sample_id",
        F.coalesce(cell("accession_or_group"), F.format_string("line %d", F.col("n") + 1)).alias("accession_or_group"),
        cell("aggregation_level").alias("aggregation_level"),
        cell("accession_resolution").alias("accession_resolution"),
        cell("nonoverlap_fragments_algorithm").alias("nonoverlap_fragments_algorithm"),
        interval[0].alias("fraction_ci_95_low"),
        interval[1].alias("fraction_ci_95_high"),
        F.from_json(cell("decision_reasons"), "ARRAY<STRING>").alias("decision_reasons"),
        F.lit(level).alias("artifact_level"),
    )


def _readability(files: DataFrame) -> DataFrame:
    """(sample_id, path, problem) of every document, and of every row of a table."""
    from siftline import labels as L

    widths = {
        "candidate_calls.tsv": len(L.CANDIDATE_CALLS_HEADER), "results/candidate_calls.accession.tsv": len(L.CANDIDATE_CALLS_HEADER),
        "results/detection_calls.group.tsv": len(L.CANDIDATE_CALLS_HEADER), "rounds.tsv": len(L.ROUNDS_HEADER),
        "results/sampling_rounds.tsv": len(L.ROUNDS_HEADER), "summary/virus_summary.tsv": len(L.VIRUS_SUMMARY_HEADER),
    }
    documents = files.filter(F.col("path").endswith(".json")).select(
        "sample_id", "path", F.when(F.try_parse_json("content").isNull(), "is not JSON").alias("problem")
    )
    lines = files.filter(F.col("path").isin(*widths)).select("sample_id", "path", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    wanted = F.element_at(F.create_map(*(F.lit(x) for pair in widths.items() for x in pair)), F.col("path"))
    cells = F.size(F.split("line", "\t"))
    rows = lines.filter("line <> '' OR n = 0").select(
        "sample_id", "path",
        F.when(cells != wanted, F.format_string("line %d has %d cells of %d", F.col("n") + 1, cells, wanted)).alias("problem"),
    )
    return documents.unionByName(rows)


# Checks that read documents: a bundle whose documents are missing or unreadable gets a skip.
DEPENDENT = (
    "schema metadata contract", "report bundle bindings", "rounds.tsv", "canonical sample summary facts",
    "canonical result overview facts", "candidate CI labeling", "detection_calls.group.tsv", "candidate_calls.accession.tsv",
    "dual-layout candidate TSV", "dual-layout rounds TSV", "dual-layout run manifest", "dual-layout checksum inventory",
    "checksum.sha256", "audit/checksum.sha256", "table headers", "readable documents",
)
# Checks against the loaded bundle and the loaded profiles.
OF_BUNDLE = ("reference bundle binding",)
OF_PROFILE = ("calibration profile binding", "release_status compliance", "release_gate artifact blockers")


def audit_bundles(
    files: DataFrame, bundle_version: str | None = None, profiles: DataFrame | None = None, bundles: DataFrame | None = None
) -> DataFrame:
    """Every check of every bundle, as (sample_id, check, status, detail).

    ``files``: sample_id, path, content. ``bundles`` (sample_id) names the bundles to judge, also those without
    files; it defaults to those that have some. ``profiles`` (sample_id, profile_id,
    reference_bundle, profile_backend, profile_status, profile_sampling_mode,
    profile_control_required, gates) enables the profile binding and the release
    recomputation; a sample without a row there fails the binding. Every bundle has a row of every check: what cannot be
    judged is skipped.
    """
    summary = _document(files, "sample_summary.json", SUMMARY)
    manifest = _document(files, "provenance/run_manifest.json", RUN_MANIFEST).withColumn(
        "negative_control_status", F.col("negative_control.status")
    )
    overview = _document(files, "summary/result_overview.json", OVERVIEW).select(
        "sample_id", F.col("sample.sample_id").alias("own_sample_id"), "sample.decision_status", "sample.release_status", "run.*"
    )
    sample_run = _document(files, "summary/sample_run_summary.json", SUMMARY)
    rounds = _table(files, "results/sampling_rounds.tsv")
    bundles = (files if bundles is None else bundles).select("sample_id").distinct()
    calls = _calls(files, "results/candidate_calls.accession.tsv", "accession")
    groups = _calls(files, "results/detection_calls.group.tsv", "group")
    headers = files.filter(F.col("path").rlike("^(results|summary)/.*[.]tsv$")).select(
        "sample_id",
        F.element_at(F.split("path", "/"), -1).alias("artifact"),
        F.substring_index("content", "\n", 1).alias("header"),
    )
    checks = [
        audit.audit_completeness(files, bundles),
        audit.audit_readable(_readability(files)),
        audit.audit_schema(_document(files, "audit/schema_versions.json", SCHEMAS)),
        audit.audit_headers(headers),
        audit.audit_aliases(files),
        audit.audit_checksums(audit.parse_checksums(files), checksum_table(files)),
        audit.audit_bindings(summary, manifest, bundle_version, None if profiles is None else profiles),
        audit.audit_facts(summary, manifest, rounds, sample_run, overview),
        audit.audit_ci_labels(calls),
        audit.audit_resolution(calls.unionByName(groups)),
    ]
    if profiles is not None:
        gate = _document(files, "audit/release_gate.json", GATE).select(
            "sample_id", F.col("status").alias("gate_status"), F.col("primary_blockers").alias("gate_primary"), F.col("secondary_blockers").alias("gate_secondary")
        )
        runs = (
            summary.select("sample_id", "decision_status", F.col("release_status").alias("claimed_status"), F.coalesce("rejected_hits", F.lit(0)).alias("rejected_hits"))
            .join(manifest.select("sample_id", "sampling_mode", "negative_control_status", F.col("negative_control.required").alias("negative_control_required")), "sample_id")
            .join(profiles, "sample_id")
            .join(gate, "sample_id", "left")
        )
        checks.append(audit.audit_release(runs))
    out = checks[0].select(*audit.OUTPUT)
    for check in checks[1:]:
        out = out.unionByName(check.select(*audit.OUTPUT))
    ungiven = (OF_BUNDLE if bundle_version is None else ()) + (OF_PROFILE if profiles is None else ())
    out = audit.with_skips(out, bundles, ungiven, "nothing to compare with was given") if ungiven else out
    return audit.with_skips(out, bundles, [c for c in (*DEPENDENT, *OF_BUNDLE, *OF_PROFILE) if c not in ungiven])
