"""Report sinks. Tables are partitioned by sample, so readers prune to one sample."""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline import labels as L
from siftline.functions.text import sanitize_component
from siftline.tuning import settle


def _tsv(df: DataFrame, path: str, columns, order=()) -> None:
    """One file a sample, its rows in order: a sample has no more rows than its panel and looks."""
    ordered = df.repartition("sample_id").sortWithinPartitions("sample_id", *order)
    ordered.select("sample_id", *columns).write.mode("overwrite").partitionBy("sample_id").option("sep", "\t").option(
        "header", True
    ).option("escape", '"').csv(path)


def calls_table(calls: DataFrame) -> DataFrame:
    """The 23 contract columns; arrays as JSON text."""
    ready = calls.withColumns(
        {
            "fraction_ci_95": F.to_json(F.array("fraction_ci_95_low", "fraction_ci_95_high")),
            "decision_reasons": F.to_json("decision_reasons"),
        }
    )
    return ready.select("sample_id", *L.CANDIDATE_CALLS_HEADER)


def write_calls(calls: DataFrame, path: str) -> None:
    _tsv(calls_table(calls), path, L.CANDIDATE_CALLS_HEADER, ("aggregation_level", "accession_or_group"))


def rounds_table(rounds: DataFrame) -> DataFrame:
    return rounds.select("sample_id", "round", *L.ROUNDS_HEADER)


def write_rounds(rounds: DataFrame, path: str) -> None:
    _tsv(rounds_table(rounds), path, L.ROUNDS_HEADER, ("round",))


def virus_summary_table(summary: DataFrame) -> DataFrame:
    """The 28 contract columns; reasons as JSON text."""
    return summary.withColumn("decision_reasons", F.to_json("decision_reasons")).select(
        "sample_id", *L.VIRUS_SUMMARY_HEADER
    )


def write_virus_summary(summary: DataFrame, path: str) -> None:
    _tsv(virus_summary_table(summary), path, L.VIRUS_SUMMARY_HEADER, ("rank",))


def coverage_index(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(artifacts, duplicates): one evidence file per positive call; bodies are header only."""
    grouped = F.exists("decision_reasons", lambda r: r == "aggregation_level=group")
    rows = calls.filter("decision = 'positive'").select(
        "sample_id",
        "accession_or_group",
        F.concat(
            F.when(grouped, "group").otherwise("accession"),
            F.lit("."),
            sanitize_component(F.col("accession_or_group")),
            F.lit(".coverage.tsv"),
        ).alias("file_name"),
        F.lit(L.COVERAGE_HEADER).alias("content"),
    )
    duplicates = (
        rows.groupBy("sample_id", "file_name")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("accession_or_group").alias("first_candidate"))
        .filter("copies > 1")
    )
    return rows, duplicates


# The fields of the run summary document.
SUMMARY_FIELDS = (
    "sample_id",
    "reference_bundle_version",
    "calibration_profile_version",
    "backend",
    "seed",
    "input_fragments",
    "qc_passing_fragments",
    "sampled_fragments",
    "rounds_run",
    "stop_reason",
    "decision_status",
    "release_status",
    "release_primary_blockers",
    "release_secondary_blockers",
)


def _json(*columns) -> "F.Column":
    return F.to_json(F.struct(*columns))


def run_documents(
    runs: DataFrame, calls: DataFrame, summaries: DataFrame, tops: DataFrame, round_plan: DataFrame | None = None, input_files: DataFrame | None = None
) -> DataFrame:
    """JSON documents per sample as rows (sample_id, path, content).

    ``runs`` carries release columns and control columns; ``summaries`` is
    sample_run_summary output over ``runs``; ``tops`` is top_results output, at most
    one panel of rows per sample. ``round_plan`` (the sampling accounting, one row a sample) and ``input_files``
    (sample_id, input_files: names in order) go to the run manifest; the count of rejected hits, where ``runs`` have it, to
    the run summary, as it blocks release.
    """
    listed = lambda name: F.sort_array(
        F.collect_list(
            F.when(
                F.col("list") == name,
                F.struct(
                    "rank", "entity_id", "entity_name", "aggregation_level", "decision", "evidence_strength",
                    "accepted_fragments", "unique_fraction", "breadth",
                ),
            )
        )
    ).alias(name)
    top = tops.groupBy("sample_id").agg(listed("top_detections"), listed("top_accession_evidence"))
    facts = calls.groupBy("sample_id").agg(
        F.count_if(F.col("aggregation_level") == "accession").alias("candidate_count"),
        F.sort_array(F.collect_list(F.when(F.col("decision") == "positive", F.col("accession_or_group")))).alias("positive_candidates"),
    )
    rows = (
        summaries.join(top, "sample_id", "left")
        .join(facts, "sample_id", "left")
        .withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))
    )
    planned, named_files = [], []
    if round_plan is not None:
        accounting = F.struct(*[c for c in round_plan.columns if c != "sample_id"]).alias("sampling_round_plan")
        rows, planned = rows.join(round_plan.select("sample_id", accounting), "sample_id", "left"), ["sampling_round_plan"]
    if input_files is not None:
        rows, named_files = rows.join(input_files.select("sample_id", "input_files"), "sample_id", "left"), ["input_files"]
    rejected = [c for c in ("rejected_hits",) if c in summaries.columns]
    control = F.struct(
        F.col("negative_control_required").alias("required"),
        F.col("negative_control_status").alias("status"),
        "control_id",
        "control_status",
    ).alias("negative_control")
    manifest = _json(
        "reference_bundle_version", "calibration_profile_version", "backend", "seed", "sampling_mode", *planned, control, *named_files
    )
    counts = [f"{s}_entity_count" for s in ("positive", "indeterminate", "negative", "weak_positive")]
    overview = _json(
        F.lit(L.RESULT_OVERVIEW_SCHEMA).alias("schema_version"),
        F.struct("sample_id", "decision_status", "release_status", "release_primary_blockers", "release_secondary_blockers").alias("sample"),
        F.struct("reference_bundle_version", "calibration_profile_version", "backend", "sampling_mode", "negative_control_status").alias("run"),
        "top_detections",
        "top_accession_evidence",
    )
    gate = _json(
        F.lit(L.RELEASE_GATE_SCHEMA).alias("schema_version"),
        "sample_id",
        "release_status",
        F.col("release_status").alias("status"),
        F.col("release_primary_blockers").alias("primary_blockers"),
        F.col("release_secondary_blockers").alias("secondary_blockers"),
        "decision_status",
        "stop_reason",
        "rounds_run",
        "reference_bundle_version",
        "calibration_profile_version",
        "backend",
        "seed",
        control,
    )
    keys = {key: (canonical, alias) for key, canonical, alias, _kind in L.ARTIFACT_CONTRACT}
    named = lambda pairs: F.struct(*[F.lit(v).alias(k) for k, v in pairs])
    schemas = _json(
        F.lit(L.BUNDLE_SCHEMA).alias("report_bundle_schema"),
        named((k, c) for k, (c, _a) in keys.items()).alias("canonical_outputs"),
        named((k, a) for k, (_c, a) in keys.items() if a).alias("legacy_outputs"),
    )
    log = F.concat_ws(
        "\n",
        _json(F.lit("info").alias("level"), F.lit("report_bundle_write_started").alias("event"), "sample_id", "candidate_count", "rounds_run"),
        _json(F.lit("info").alias("level"), F.lit("report_bundle_write_completed").alias("event"), "decision_status", "release_status", "positive_candidates"),
        F.lit(""),
    )
    sample_summary = _json(
        F.lit(L.SAMPLE_RUN_SUMMARY_SCHEMA).alias("schema_version"),
        "sample_id", "decision_status", "release_status", "release_primary_blockers", "release_secondary_blockers", "stop_reason",
        "input_fragments", "qc_passing_fragments", "sampled_fragments", "rounds_run", *counts,
    )
    documents = F.array(
        *[
            F.struct(F.lit(path).alias("path"), content.alias("content"))
            for path, content in (
                ("sample_summary.json", _json(*SUMMARY_FIELDS, *rejected)),
                ("summary/sample_run_summary.json", sample_summary),
                ("summary/result_overview.json", overview),
                ("provenance/run_manifest.json", manifest),
                ("run_manifest.json", manifest),
                ("audit/release_gate.json", gate),
                ("audit/schema_versions.json", schemas),
                ("logs/run.ndjson", log),
                ("logs/run.log", log),
            )
        ]
    )
    return rows.select("sample_id", F.explode(documents).alias("d")).select("sample_id", "d.*")


def _tsv_text(rows: DataFrame, columns, order) -> DataFrame:
    """One TSV text per sample; rows per sample are bounded by the panel or the look count."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    quoted = lambda c: F.when(
        value(c).rlike('[\t\n"]'), F.concat(F.lit('"'), F.replace(value(c), F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(value(c))
    line = F.concat_ws("\t", *[quoted(c) for c in columns])
    sorted_lines = F.transform(
        F.sort_array(F.collect_list(F.struct(*[F.col(o).alias(f"k{i}") for i, o in enumerate(order)], line.alias("line")))),
        lambda s: s["line"],
    )
    header = "\t".join(columns)
    return rows.groupBy("sample_id").agg(
        F.concat(F.lit(header + "\n"), F.array_join(sorted_lines, "\n"), F.lit("\n")).alias("content")
    )


def bundle_files(
    runs: DataFrame, calls: DataFrame, rounds: DataFrame, summary: DataFrame, summaries: DataFrame, tops: DataFrame,
    round_plan: DataFrame | None = None, input_files: DataFrame | None = None,
) -> DataFrame:
    """Every artifact of every sample as (sample_id, path, content), checksums included.

    Sample-level artifacts only; a cohort's read-level tables go through the
    partitioned sinks above.
    """
    at = lambda df, *paths: df.withColumn("path", F.explode(F.array(*map(F.lit, paths)))).select("sample_id", "path", "content")
    header_only = lambda columns: "\t".join(columns) + "\n"

    def calls_text(name: str) -> DataFrame:
        text = _tsv_text(calls_table(calls.filter(F.col("aggregation_level") == name)), L.CANDIDATE_CALLS_HEADER, ("accession_or_group",))
        return runs.select("sample_id").join(text, "sample_id", "left").withColumn(
            "content", F.coalesce("content", F.lit(header_only(L.CANDIDATE_CALLS_HEADER)))
        )

    summary_text = runs.select("sample_id").join(
        _tsv_text(virus_summary_table(summary), L.VIRUS_SUMMARY_HEADER, ("rank",)), "sample_id", "left"
    ).withColumn("content", F.coalesce("content", F.lit(header_only(L.VIRUS_SUMMARY_HEADER))))
    coverage, duplicates = coverage_index(calls)
    if clashes := duplicates.take(3):
        raise ValueError("candidates share an evidence file: " + ", ".join(f"{r.sample_id}/{r.file_name}" for r in clashes))
    evidence = coverage.select(
        "sample_id", F.concat(F.lit("evidence/positive_candidate_coverage/"), "file_name").alias("path"), "content"
    )
    marker = runs.select("sample_id", F.lit(MARKER).alias("path"), F.lit("").alias("content"))
    files = (
        run_documents(runs, calls, summaries, tops, round_plan, input_files)
        .unionByName(at(calls_text("accession"), "candidate_calls.tsv", "results/candidate_calls.accession.tsv"))
        .unionByName(at(calls_text("group"), "results/detection_calls.group.tsv"))
        .unionByName(at(_tsv_text(rounds_table(rounds), L.ROUNDS_HEADER, ("round",)), "rounds.tsv", "results/sampling_rounds.tsv"))
        .unionByName(at(summary_text, "summary/virus_summary.tsv"))
        .unionByName(evidence)
        .unionByName(marker)
    )
    listing = checksum_text(files)
    return files.unionByName(at(listing, *L.CHECKSUM_PATHS))


def checksum_table(files: DataFrame) -> DataFrame:
    """SHA-256 per file, checksum files excluded."""
    return files.filter(~F.col("path").isin(*L.CHECKSUM_PATHS)).select(
        "sample_id", "path", F.sha2("content", 256).alias("sha256")
    )


def checksum_text(files: DataFrame) -> DataFrame:
    lines = F.sort_array(F.collect_list(F.struct("path", F.concat("sha256", F.lit("  "), "path").alias("line"))))
    return checksum_table(files).groupBy("sample_id").agg(
        F.concat(F.array_join(F.transform(lines, lambda s: s["line"]), "\n"), F.lit("\n")).alias("content")
    )


def _relative(root: str):
    """The path of a file below ``root``, however its scheme is spelled."""
    bare = lambda path: F.regexp_replace(path, r"^file:/+", "/")
    base = re.sub(r"^file:/+", "/", root.rstrip("/"))
    return F.regexp_replace(bare(F.col("path")), "^.*?" + _quote(base) + "/", "")


# Bytes of a file that are held at once while it is digested.
DIGEST_BYTES = 4 << 20


def checksum_inventory(spark, root: str) -> DataFrame:
    """SHA-256 of every file under ``root``, by relative path, checksum files excluded.

    Tasks read files of any size in pieces of ``DIGEST_BYTES``; where only Spark can open the store, each file is a row, of 2 GB at most.
    """
    from pyarrow import fs

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = _relative(root).alias("path")
    try:
        fs.FileSystem.from_uri(root)
        streamed = True
    except (pa.ArrowException, OSError):
        streamed = False

    def digests(tables):
        store, base = fs.FileSystem.from_uri(root)
        for batch in tables:
            found = []
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with store.open_input_stream(f"{base}/{path}") as source:
                    while piece := source.read(DIGEST_BYTES):
                        digest.update(piece)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "sha256"])

    if streamed:
        # Only names are listed here, a few files a task.
        named = files.select(relative).repartition(spark.sparkContext.defaultParallelism)
        files = named.mapInArrow(digests, "path string, sha256 string")
    else:
        files = files.select(relative, F.sha2("content", 256).alias("sha256"))
    return files.filter(~F.element_at(F.split("path", "/"), -1).isin("checksum.sha256")).orderBy("path")


def _quote(text: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != "/" else ch for ch in text)


def write_documents(files: DataFrame, path: str) -> None:
    """Artifacts as one row per file, partitioned by sample."""
    files.write.mode("overwrite").partitionBy("sample_id").parquet(path)


# A published bundle's own file that names the run which wrote it; the bundle counts once a commit record names the same run.
RUN_FILE = ".run"


def _commits(root: str) -> str:
    return root.rstrip("/") + ".commits"


def write_bundles(files: DataFrame, root: str) -> int:
    """Write (sample_id, path, content) rows as files ``root/<sample>/<path>``, in two phases; the number of files written.

    First all files go to a staging folder of this run, beside ``root``; then each sample's whole folder is moved into place, what
    stood there aside, and a commit record (``<root>.commits/<sample>.json``: run, and path, size and SHA-256 of every file) is
    put last. A run that fails in the first phase changes nothing; in the second, a sample counts once its record is there. Tasks
    that run again leave the same. ``root`` must be a folder that all executors share, in a store that moves folders as one.
    """
    run = uuid.uuid4().hex
    staging = f"{root.rstrip('/')}.staging/{run}"
    listing = settle(files.select("sample_id", "path", "content").mapInArrow(stage(staging), "sample_id string, path string, size long, sha256 string"))
    publish(listing, root, run)
    return listing.count()


def stage(staging: str):
    """Batches of (sample_id, path, content) to files below ``staging``, and to their sizes and digests."""

    def batches(tables):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(staging)
        for batch in tables:
            sizes, digests = [], []
            samples, paths, contents = (batch.column(i).to_pylist() for i in range(3))
            for sample, path, content in zip(samples, paths, contents):
                data, place = (content or "").encode(), f"{base}/{sample}/{path}"
                store.create_dir(place.rpartition("/")[0], recursive=True)
                fresh = f"{base}/{sample}/_{uuid.uuid4().hex}"
                with store.open_output_stream(fresh) as out:
                    out.write(data)
                store.move(fresh, place)
                sizes.append(len(data))
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["sample_id", "path", "size", "sha256"]
            )

    return batches


def publish(listing: DataFrame, root: str, run: str) -> int:
    """Move the staged bundles of ``run`` into place and put their commit records; the number of bundles."""

    def batches(tables):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root.rstrip("/"))
        put = lambda place, text: _put(store, place, text.encode())
        for batch in tables:
            for sample, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                staged, place = f"{base}.staging/{run}/{sample}", f"{base}/{sample}"
                # Where it is gone, an earlier attempt has moved it.
                if store.get_file_info(staged).type == fs.FileType.Directory:
                    put(f"{staged}/{RUN_FILE}", run)
                    store.create_dir(base, recursive=True)
                    if store.get_file_info(place).type == fs.FileType.Directory:
                        store.create_dir(f"{base}.staging/replaced", recursive=True)
                        store.move(place, f"{base}.staging/replaced/{uuid.uuid4().hex}")
                    store.move(staged, place)
                store.create_dir(f"{base}.commits", recursive=True)
                put(f"{base}.commits/{sample}.json", record)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    entries = F.sort_array(F.collect_list(F.struct("path", "size", "sha256"))).alias("files")
    record = F.to_json(F.struct(F.lit(run).alias("run"), "sample_id", "files")).alias("record")
    bundles = listing.groupBy("sample_id").agg(entries).select("sample_id", record)
    return bundles.mapInArrow(batches, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _put(store, place: str, data: bytes) -> None:
    fresh = f"{place}.{uuid.uuid4().hex}"
    with store.open_output_stream(fresh) as out:
        out.write(data)
    store.move(fresh, place)


def commit_records(spark, root: str) -> DataFrame:
    """(sample_id, run, path, size, sha256) of every file of every committed bundle."""
    schema = "run string, sample_id string, files array<struct<path: string, size: long, sha256: string>>"
    records = spark.read.option("pathGlobFilter", "*.json").schema(schema).json(_commits(root))
    return records.select("sample_id", "run", F.explode("files").alias("f")).select("sample_id", "run", "f.*")


def commit_problems(found: DataFrame, records: DataFrame) -> DataFrame:
    """(sample_id, path, problem) where the files of bundles (sample_id, path, content) are not those that were committed."""
    files = found.select("sample_id", "path", F.octet_length("content").cast("long").alias("_size"), F.sha2("content", 256).alias("_sha256"), F.lit(True).alias("_there"))
    both = records.select("sample_id", "path", "size", "sha256", F.lit(True).alias("_listed")).join(files, ["sample_id", "path"], "full")
    problem = (
        F.when(F.col("_there").isNull(), "committed file is missing")
        .when(F.col("_listed").isNull(), "file was not committed")
        .when(F.col("size") != F.col("_size"), "size is not as committed")
        .when(F.col("sha256") != F.col("_sha256"), "digest is not as committed")
    )
    return both.withColumn("problem", problem).filter("problem IS NOT NULL").select("sample_id", "path", "problem")


# Fixed value: the marker that keeps an evidence folder without evidence.
MARKER = "evidence/positive_candidate_coverage/.keep"


def read_bundles(spark, root: str) -> DataFrame:
    """Committed report bundles laid out as ``root/<sample>/<path>`` files, as (sample_id, path, content).

    A bundle without a commit record of its run is not read. Spark's readers pass over names that begin with a dot; the
    marker and the run's name are looked for in each bundle.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = files.select(_relative(root).alias("p"), F.col("content").cast("string").alias("content")).select(
        F.substring_index("p", "/", 1).alias("sample_id"),
        F.regexp_replace("p", "^[^/]+/", "").alias("path"),
        "content",
    )

    def markers(tables):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)

        def text_of(place: str) -> str | None:
            if store.get_file_info(place).type != fs.FileType.File:
                return None
            with store.open_input_stream(place) as source:
                return source.read().decode("utf-8", "replace")

        for batch in tables:
            rows = [(sample, text_of(f"{base}/{sample}/{RUN_FILE}"), text_of(f"{base}/{sample}/{MARKER}")) for sample in batch.column(0).to_pylist()]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["sample_id", "run", "marker"])

    # One row a bundle.
    seen = settle(found.select("sample_id").distinct().mapInArrow(markers, "sample_id string, run string, marker string"))
    runs = commit_records(spark, root).select("sample_id", "run").distinct()
    committed = seen.join(runs, ["sample_id", "run"], "left_semi")
    marked = committed.filter("marker IS NOT NULL").select("sample_id", F.lit(MARKER).alias("path"), F.col("marker").alias("content"))
    return found.join(committed.select("sample_id"), "sample_id", "left_semi").unionByName(marked)
