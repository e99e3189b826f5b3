"""Audit constraints as batch checks over many report bundles.

Every check returns (sample_id, check, status, detail) with status pass, fail or
skip. Checks aggregate per sample with combinable aggregates; offender texts are
sorted, so the output does not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline import labels as L
from siftline.operators.release import release_status
from siftline.tuning import TASK_ROWS, dealt

OUTPUT = ("sample_id", "check", "status", "detail")


def _row(check: str, status: Column, detail: Column) -> list[Column]:
    return [F.lit(check).alias("check"), status.alias("status"), detail.alias("detail")]


def _from_problems(df: DataFrame, check: str, problems: Column, good: str) -> DataFrame:
    """Pass when the problem array is empty, else fail with the joined problems."""
    tagged = df.withColumn("_problems", F.array_compact(problems))
    ok = F.size("_problems") == 0
    return tagged.select(
        "sample_id",
        *_row(check, F.when(ok, "pass").otherwise("fail"), F.when(ok, good).otherwise(F.array_join("_problems", "; "))),
    )


def _differs(name: str, left: Column, right: Column, a: str, b: str) -> Column:
    show = lambda c: F.coalesce(c.cast("string"), F.lit("<missing>"))
    return F.when(
        ~left.eqNullSafe(right),
        F.concat(F.lit(f"{name} mismatch: {a}=`"), show(left), F.lit(f"` {b}=`"), show(right), F.lit("`")),
    )


def audit_completeness(files: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    """Required legacy files, and canonical artifacts where any canonical path exists.

    ``bundles`` (sample_id) names the bundles to judge; one without any file misses all of them.
    """
    canonical = [(path, kind) for _key, path, _alias, kind in L.ARTIFACT_CONTRACT]
    directories = [path for path, kind in canonical if kind == "directory"]
    path = F.col("path")
    entry = path
    for directory in directories:
        entry = F.when(path.startswith(directory + "/"), directory).otherwise(entry)
    known = sorted({*L.LEGACY_REQUIRED, *(p for p, _ in canonical)})
    present = files.select("sample_id", entry.alias("entry")).groupBy("sample_id").agg(
        # At most one element per contract path.
        F.collect_set(F.when(F.col("entry").isin(*known), F.col("entry"))).alias("present")
    )
    if bundles is not None:
        named = bundles.select("sample_id").distinct().join(present, "sample_id", "left")
        present = named.withColumn("present", F.coalesce("present", F.array().cast("array<string>")))
    missing = lambda names: F.array_except(F.array(*map(F.lit, names)), F.col("present"))
    names = [p for p, _ in canonical]
    has_canonical = F.arrays_overlap("present", F.array(*map(F.lit, names)))

    def check(label: str, gap: Column, noun: str, skip: Column) -> Column:
        status = F.when(skip, "skip").when(F.size(gap) == 0, "pass").otherwise("fail")
        detail = (
            F.when(skip, "no file of that layout")
            .when(F.size(gap) == 0, f"all of the {noun} are there")
            .otherwise(F.concat(F.lit(f"not there, of the {noun}: "), F.array_join(gap, ", ")))
        )
        return F.struct(*_row(label, status, detail))

    checks = F.array(
        check("report bundle completeness", missing(L.LEGACY_REQUIRED), "required files", F.lit(False)),
        check("canonical report bundle completeness", missing(names), "canonical artifacts", ~has_canonical),
    )
    return present.select("sample_id", F.explode(checks).alias("c")).select("sample_id", "c.*")


def expected_outputs() -> tuple[dict, dict]:
    canonical = {key: path for key, path, _alias, _kind in L.ARTIFACT_CONTRACT}
    legacy = {key: alias for key, _path, alias, _kind in L.ARTIFACT_CONTRACT if alias}
    return canonical, legacy


def _same_map(observed: Column, expected: dict) -> Column:
    entries = F.sort_array(F.transform(F.map_entries(observed), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    wanted = F.array(*[F.lit(f"{k}={v}") for k, v in sorted(expected.items())])
    return F.coalesce(entries == F.sort_array(wanted), F.lit(False))


def audit_schema(schemas: DataFrame) -> DataFrame:
    """Schema metadata: sample_id, report_bundle_schema, canonical_outputs and legacy_outputs maps."""
    canonical, legacy = expected_outputs()
    problems = F.array(
        F.when(
            ~F.col("report_bundle_schema").eqNullSafe(F.lit(L.BUNDLE_SCHEMA)),
            F.concat(F.lit(f"report_bundle_schema expected `{L.BUNDLE_SCHEMA}`, observed `"), F.coalesce("report_bundle_schema", F.lit("<missing>")), F.lit("`")),
        ),
        F.when(~_same_map(F.col("canonical_outputs"), canonical), "canonical_outputs does not match the contract"),
        F.when(~_same_map(F.col("legacy_outputs"), legacy), "legacy_outputs does not match the contract"),
    )
    return _from_problems(schemas, "schema metadata contract", problems, "schema metadata matches the contract")


def audit_headers(headers: DataFrame) -> DataFrame:
    """Header contract: sample_id, artifact, header (tab-joined first line)."""
    expected = {
        "candidate_calls.accession.tsv": L.CANDIDATE_CALLS_HEADER,
        "detection_calls.group.tsv": L.CANDIDATE_CALLS_HEADER,
        "sampling_rounds.tsv": L.ROUNDS_HEADER,
        "virus_summary.tsv": L.VIRUS_SUMMARY_HEADER,
    }
    wanted = F.lit(None).cast("string")
    for artifact, columns in expected.items():
        wanted = F.when(F.col("artifact") == artifact, "\t".join(columns)).otherwise(wanted)
    bad = ~F.col("header").eqNullSafe(wanted)
    return headers.groupBy("sample_id").agg(
        *_row(
            "table headers",
            F.when(F.bool_or(bad), "fail").otherwise("pass"),
            F.coalesce(F.array_join(F.sort_array(F.collect_set(F.when(bad, F.concat(F.lit("unexpected TSV header in "), "artifact")))), "; "), F.lit("")),
        )
    )


_ALIAS_PAIRS = (
    ("dual-layout candidate TSV", "candidate_calls.tsv", "results/candidate_calls.accession.tsv", "bytes"),
    ("dual-layout rounds TSV", "rounds.tsv", "results/sampling_rounds.tsv", "bytes"),
    ("dual-layout run manifest", "run_manifest.json", "provenance/run_manifest.json", "json"),
    ("dual-layout checksum inventory", "checksum.sha256", "audit/checksum.sha256", "lines"),
)


def audit_aliases(files: DataFrame) -> DataFrame:
    """Legacy and canonical copies agree: bytes, JSON values, or sorted checksum entries."""
    pick = lambda p: F.max(F.when(F.col("path") == p, F.col("content")))
    names = [c for pair in _ALIAS_PAIRS for c in pair[1:3]]
    grouped = files.filter(F.col("path").isin(*names)).groupBy("sample_id").agg(
        *[pick(c).alias(f"f{i}") for i, c in enumerate(names)]
    )

    def canonical(column: Column, kind: str) -> Column:
        if kind == "json":
            return F.to_json(F.try_parse_json(column))
        if kind == "lines":
            entries = F.transform(F.split(column, "\n"), lambda line: F.lower(F.replace(F.trim(line), F.lit("\\"), F.lit("/"))))
            return F.array_join(F.sort_array(F.filter(entries, lambda line: line != "")), "\n")
        return column

    checks = []
    for i, (label, legacy, path, kind) in enumerate(_ALIAS_PAIRS):
        a, b = F.col(f"f{2 * i}"), F.col(f"f{2 * i + 1}")
        missing = a.isNull() | b.isNull()
        # A null is a document that cannot be read: it agrees with nothing.
        same = F.coalesce(canonical(a, kind) == canonical(b, kind), F.lit(False))
        status = F.when(missing, "skip").when(same, "pass").otherwise("fail")
        detail = (
            F.when(missing, f"`{legacy}` or `{path}` is missing")
            .when(same, f"`{legacy}` matches `{path}`")
            .otherwise(f"mismatch between `{legacy}` and `{path}`")
        )
        checks.append(F.struct(*_row(label, status, detail)))
    return grouped.select("sample_id", F.explode(F.array(*checks)).alias("c")).select("sample_id", "c.*")


def parse_checksums(files: DataFrame) -> DataFrame:
    """Lines of every checksum file: sample_id, inventory, line_no, digest, path, problem."""
    listings = files.filter(F.col("path").isin(*L.CHECKSUM_PATHS))
    lines = listings.select(
        "sample_id", F.col("path").alias("inventory"), F.posexplode(F.split("content", "\n")).alias("line_no", "raw")
    ).withColumn("text", F.trim("raw")).filter("text <> ''")
    at = F.instr("text", "  ")
    digest = F.when(at > 0, F.substring("text", F.lit(1), at - 1))
    path = F.when(at > 0, F.substring("text", at + 2, F.length("text")))
    return lines.select("sample_id", "inventory", (F.col("line_no") + 1).alias("line_no"), digest.alias("digest"), path.alias("path")).withColumn(
        "problem", checksum_problem()
    )


def checksum_problem() -> Column:
    path = F.col("path")
    return (
        F.when(F.col("digest").isNull(), "malformed entry")
        .when(~F.col("digest").rlike("^[0-9A-Fa-f]{64}$"), "invalid SHA-256 digest")
        .when(path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)"), "path leaves the bundle")
    )


def audit_checksums(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """Listed digests (sample_id, inventory, digest, path, problem) against actual (sample_id, path, sha256)."""
    joined = listed.join(actual.select("sample_id", "path", "sha256"), ["sample_id", "path"], "left")
    problem = F.coalesce(
        F.col("problem"),
        F.when(F.col("sha256").isNull(), "listed file is missing").when(
            F.lower("digest") != F.col("sha256"), "checksum mismatch"
        ),
    )
    offender = F.when(problem.isNotNull(), F.concat(problem, F.lit(" for `"), F.coalesce("path", F.lit("")), F.lit("`")))
    return (
        joined.withColumn("_offender", offender)
        .groupBy("sample_id", F.col("inventory").alias("check"))
        .agg(
            F.when(F.count("_offender") == 0, "pass").otherwise("fail").alias("status"),
            F.when(F.count("_offender") == 0, F.format_string("verified %d checksum entries", F.count(F.lit(1))))
            .otherwise(F.concat(F.format_string("%d of %d entries failed, first: ", F.count("_offender"), F.count(F.lit(1))), F.min("_offender")))
            .alias("detail"),
        )
        .select(*OUTPUT)
    )


def audit_bindings(summary: DataFrame, manifest: DataFrame, bundle_version: str | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """Versions agree between summary and manifest, the loaded bundle, and the loaded profile.

    ``profiles``: sample_id, profile_id, reference_bundle, profile_backend; a sample without a row there fails.
    """
    fields = ("reference_bundle_version", "calibration_profile_version", "backend", "seed")
    s = summary.select("sample_id", *[F.col(f).alias(f"s_{f}") for f in fields])
    m = manifest.select("sample_id", *[F.col(f).alias(f"m_{f}") for f in fields])
    sides = [m]
    if profiles is not None:
        # Where a sample has several profiles, the other checks are told with the first.
        nth = F.row_number().over(Window.partitionBy("sample_id").orderBy("profile_id"))
        sides.append(profiles.select("sample_id", "profile_id", "reference_bundle", "profile_backend"))
    s, m, *loaded = dealt(s, "sample_id", rows=TASK_ROWS // 3, others=sides)
    both, once = s.join(m, "sample_id"), F.lit(True)
    absent = [F.when(F.col(f"s_{f}").isNull() & F.col(f"m_{f}").isNull(), f"{f} is missing from both") for f in fields]
    against = lambda side, name: _differs("reference_bundle_version", F.col(f"{side}_reference_bundle_version"), F.lit(bundle_version), name, "bundle")
    checks = [
        (
            "report bundle bindings",
            F.array(*[_differs(f, F.col(f"s_{f}"), F.col(f"m_{f}"), "sample_summary", "run_manifest") for f in fields], *absent),
            "sample summary and run manifest agree",
        )
    ]
    if bundle_version is not None:
        checks.append(("reference bundle binding", F.array(against("s", "sample_summary"), against("m", "run_manifest")), "report references the loaded bundle"))
    verdict = lambda check, problems, good: F.struct(F.lit(check).alias("check"), F.array_compact(problems).alias("problems"), F.lit(good).alias("good"))
    if profiles is not None:
        both = both.join(loaded[0].withColumn("_nth", nth), "sample_id", "left")
        once = F.coalesce(F.col("_nth") == 1, F.lit(True))
        pairs = (
            ("calibration_profile_version", "profile_id"),
            ("reference_bundle_version", "reference_bundle"),
            ("backend", "profile_backend"),
        )
        unloaded = F.col("_nth").isNull()
        bound = F.array(
            F.when(unloaded, "no profile is loaded for the sample"),
            *[
                F.when(~unloaded, _differs(field, F.col(f"{side}_{field}"), F.col(target), name, "profile"))
                for field, target in pairs
                for side, name in (("s", "sample_summary"), ("m", "run_manifest"))
            ],
        )
        last = [verdict("calibration profile binding", bound, "report references the loaded profile")]
    else:
        last = []
    # Sides meet once, for all checks.
    told = F.array_compact(F.array(*[F.when(once, verdict(*check)) for check in checks], *last))
    found = both.select("sample_id", F.explode(told).alias("_told"))
    fine = F.size("_told.problems") == 0
    return found.select(
        "sample_id",
        "_told.check",
        F.when(fine, "pass").otherwise("fail").alias("status"),
        F.when(fine, F.col("_told.good")).otherwise(F.array_join("_told.problems", "; ")).alias("detail"),
    )


def _offenders(rows: DataFrame, check: Column, offender: Column) -> DataFrame:
    """Fail per (sample, check) when any row offends; the first offenders by text are named."""
    return (
        rows.withColumn("check", check)
        .withColumn("_offender", offender)
        .groupBy("sample_id", "check")
        .agg(
            F.when(F.count("_offender") == 0, "pass").otherwise("fail").alias("status"),
            F.when(F.count("_offender") == 0, F.format_string("%d rows are valid", F.count(F.lit(1))))
            .otherwise(F.array_join(F.sort_array(F.collect_set("_offender")), "; "))
            .alias("detail"),
        )
        .select(*OUTPUT)
    )


def audit_ci_labels(calls: DataFrame) -> DataFrame:
    """Readable interval bounds in order, and exactly one correct sampling-only label."""
    found = F.filter("decision_reasons", lambda r: r.startswith(L.CI_REASON_PREFIX))
    problem = (
        F.when(F.col("decision_reasons").isNull(), "has unreadable decision_reasons")
        .when(F.col("fraction_ci_95_low").isNull() | F.col("fraction_ci_95_high").isNull(), "has an unreadable fraction_ci_95")
        .when(F.col("fraction_ci_95_low") > F.col("fraction_ci_95_high"), "has invalid fraction_ci_95 bounds")
        .when(F.size(found) == 0, "is missing the sampling-only label")
        .when(F.size(found) > 1, "must carry exactly one interval label")
        .when(found[0] != L.CI_REASON_PREFIX + L.CI_LABEL, "carries another interval label")
    )
    offender = F.when(problem.isNotNull(), F.concat(F.lit("candidate `"), "accession_or_group", F.lit("` "), problem))
    return _offenders(calls, F.lit("candidate CI labeling"), offender)


def audit_resolution(calls: DataFrame, artifact_level: str = "artifact_level") -> DataFrame:
    """Level, resolution and algorithm labels of each table; ``artifact_level`` is the table's level."""
    expected, level = F.col(artifact_level), F.col("aggregation_level")
    resolution, algorithm = F.col("accession_resolution"), F.col("nonoverlap_fragments_algorithm")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    legal = F.when(expected == "group", F.coalesce(resolution, F.lit("")) == "not_applicable").otherwise(
        resolution.isin("high", "low_resolution", "unresolved")
    )
    problem = (
        F.when(~empty(level) & (level != expected), "has another aggregation_level")
        .when(empty(resolution), "is missing accession_resolution")
        .when(~legal, "has an illegal accession_resolution")
        .when(~empty(algorithm) & (algorithm != L.NONOVERLAP_ALGORITHM), "declares another algorithm")
    )
    check = F.when(expected == "group", "detection_calls.group.tsv").otherwise("candidate_calls.accession.tsv")
    offender = F.when(problem.isNotNull(), F.concat(F.lit("candidate `"), "accession_or_group", F.lit("` "), problem))
    return _offenders(calls, check, offender)


def audit_facts(summary: DataFrame, manifest: DataFrame, rounds: DataFrame, sample_run: DataFrame, overview: DataFrame) -> DataFrame:
    """Round counts and the facts repeated in the summary documents.

    ``sample_run`` repeats summary columns; ``overview`` has sample and run facts as
    flat columns. Where they have ``own_sample_id``, the sample a document says it is of, it must be the bundle's.
    """
    named = lambda df: [F.col("own_sample_id").alias("o_sample_id")] if "own_sample_id" in df.columns else [F.col("sample_id").alias("o_sample_id")]
    counted = rounds.groupBy("sample_id").agg(F.count(F.lit(1)).alias("round_rows"))
    base = summary.join(counted, "sample_id", "left").withColumn("round_rows", F.coalesce("round_rows", F.lit(0)))
    facts = _from_problems(
        base,
        "rounds.tsv",
        F.array(_differs("rounds_run", F.col("rounds_run"), F.col("round_rows"), "sample_summary", "rounds.tsv")),
        "round rows match rounds_run",
    )
    repeated = ("decision_status", "release_status", "stop_reason", "input_fragments", "qc_passing_fragments", "sampled_fragments")
    run = sample_run.select("sample_id", *named(sample_run), *[F.col(c).alias(f"o_{c}") for c in (*repeated, "rounds_run")])
    pairs = [(c, F.col(c), F.col(f"o_{c}")) for c in ("sample_id", *repeated)] + [("rounds_run", F.col("round_rows"), F.col("o_rounds_run"))]
    facts = facts.unionByName(
        _from_problems(
            base.join(run, "sample_id"),
            "canonical sample summary facts",
            F.array(*[_differs(n, a, b, "sample_summary", "sample_run_summary") for n, a, b in pairs]),
            "sample run summary agrees",
        )
    )
    of_summary = ("decision_status", "release_status")
    of_manifest = ("reference_bundle_version", "calibration_profile_version", "backend", "sampling_mode", "negative_control_status")
    seen = overview.select("sample_id", *named(overview), *[F.col(c).alias(f"o_{c}") for c in (*of_summary, *of_manifest)])
    joined = summary.select("sample_id", *of_summary).join(manifest.select("sample_id", *of_manifest), "sample_id").join(seen, "sample_id")
    return facts.unionByName(
        _from_problems(
            joined,
            "canonical result overview facts",
            F.array(*[_differs(c, F.col(c), F.col(f"o_{c}"), "source", "overview") for c in ("sample_id", *of_summary, *of_manifest)]),
            "result overview agrees",
        )
    )


def audit_release(runs: DataFrame) -> DataFrame:
    """Recompute the release gate and compare status and blockers.

    ``runs``: the inputs of ``release_status`` plus profile_sampling_mode,
    profile_control_required, negative_control_required, and the persisted
    claimed_status, gate_status, gate_primary, gate_secondary.
    """
    inputs = ("sample_id", "profile_status", "negative_control_status", "gates", "sampling_mode", "decision_status")
    rest = [c for c in runs.columns if c not in inputs]
    fresh = release_status(runs.select(*inputs, *rest))
    mode_ok = F.col("sampling_mode").eqNullSafe(F.col("profile_sampling_mode"))
    required_ok = F.col("negative_control_required").eqNullSafe(F.col("profile_control_required"))
    known_mode = F.col("sampling_mode").isin("representative", "streaming")
    problems = F.array(
        F.when(~mode_ok, "sampling_mode does not match the profile"),
        F.when(mode_ok & ~required_ok, "negative_control.required does not match the profile"),
        F.when(mode_ok & required_ok & ~known_mode, "unknown sampling_mode"),
        F.when(
            mode_ok & required_ok & known_mode,
            _differs("release_status", F.col("claimed_status"), F.col("release_status"), "sample_summary", "recomputed"),
        ),
    )
    compliance = _from_problems(fresh, "release_status compliance", problems, "status as recomputed")
    same = (
        F.col("gate_status").eqNullSafe(F.col("release_status"))
        & F.col("gate_primary").eqNullSafe(F.col("release_primary_blockers"))
        & F.col("gate_secondary").eqNullSafe(F.col("release_secondary_blockers"))
    )
    comparable = fresh.filter(mode_ok & required_ok & known_mode)
    absent = F.col("gate_status").isNull()
    artifact = comparable.select(
        "sample_id",
        *_row(
            "release_gate artifact blockers",
            F.when(absent, "skip").when(same, "pass").otherwise("fail"),
            F.when(absent, "no gate document").when(same, "gate as recomputed").otherwise("gate is not as recomputed"),
        ),
    )
    return compliance.unionByName(artifact)


def audit_readable(parts: DataFrame) -> DataFrame:
    """Every document and table that is there can be read: sample_id, path, problem (null if it can)."""
    return _offenders(
        parts, F.lit("readable documents"), F.when(F.col("problem").isNotNull(), F.concat(F.lit("`"), "path", F.lit("` "), "problem"))
    )


def with_skips(checks: DataFrame, bundles: DataFrame, names, detail: str = "it depends on a document that is missing or unreadable") -> DataFrame:
    """``checks``, and a skip for each named check that a bundle has no row of."""
    every = bundles.select("sample_id", F.explode(F.array(*map(F.lit, names))).alias("check"))
    gaps = every.join(checks, ["sample_id", "check"], "left_anti")
    skipped = gaps.select("sample_id", *_row("", F.lit("skip"), F.lit(detail))[1:], "check")
    return checks.select(*OUTPUT).unionByName(skipped.select(*OUTPUT))


def audit_verdict(checks: DataFrame) -> DataFrame:
    """Pass unless a check failed; lines rendered in check order (a few dozen per sample)."""
    line = F.concat(F.lit("["), F.upper("status"), F.lit("] "), "check", F.lit(": "), "detail")
    return checks.groupBy("sample_id").agg(
        F.when(F.bool_and(F.col("status") != "fail"), "PASS").otherwise("FAIL").alias("verdict"),
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.count_if(F.col("status") == "skip").alias("skipped"),
        F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("report"),
    )
