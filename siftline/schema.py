"""Schemas of the domain tables, as DDL."""

FRAGMENTS = (
    "sample_id STRING, fragment_key STRING, r1_seq STRING, r1_qual STRING, r2_seq STRING, r2_qual STRING"
)
MATE_RECORDS = (
    "sample_id STRING, record_number BIGINT, qname STRING, flags INT, seq STRING, qual STRING"
)
MANIFEST = (
    "contig STRING, accession STRING, taxid BIGINT, virus_name STRING, segment STRING, `group` STRING, "
    "genome_length BIGINT, source_release STRING, source_type STRING, masked_regions ARRAY<ARRAY<BIGINT>>"
)
HITS = (
    "sample_id STRING, fragment_key STRING, mate INT, contig STRING, mapq INT, as_score INT, nm INT, "
    "is_primary BOOLEAN, is_supplementary BOOLEAN, segment_id INT, target_start BIGINT, target_end BIGINT"
)
NEGATIVE_CONTROL = (
    "control_id STRING, control_status STRING, "
    "candidates ARRAY<STRUCT<accession_or_group: STRING, unique_fraction: DOUBLE>>"
)
BENCHMARK_MANIFEST = (
    "profile STRUCT<profile_id: STRING, status: STRING, seed: BIGINT, negative_control_required: BOOLEAN>, "
    "datasets ARRAY<STRUCT<dataset_id: STRING, input: ARRAY<STRING>, expected_outcome: STRING, "
    "expected_target: STRING>>"
)
GATES = (
    "backend_gate STRUCT<status: STRING, details: STRING>, "
    "reference_gate STRUCT<status: STRING, details: STRING>, "
    "specificity_gate STRUCT<status: STRING, details: STRING, negative_samples: BIGINT, false_positives: BIGINT>, "
    "sensitivity_gate STRUCT<status: STRING, details: STRING, spike_in_detected: BIGINT, spike_in_total: BIGINT>"
)
BUNDLE_FILES = ("sample_id STRING, path STRING, content STRING")
