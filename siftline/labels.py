"""Vocabularies, labels, headers and the artifact contract."""

# Contig class vocabularies, compared after trim, lower-case, and '_'/' ' -> '-'.
HOST_GROUPS = ("human", "host", "host-backbone")
VIRUS_GROUPS = ("virus", "viral", "viral-panel")
DECOY_GROUPS = ("decoy", "background", "background-decoy")
HOST_SOURCE_TYPES = ("host", "host-genome", "host-backbone")
VIRUS_SOURCE_TYPES = ("virus", "virus-panel", "viral-panel", "refseq-virus", "spike-in-virus")
DECOY_SOURCE_TYPES = ("decoy", "decoy-panel", "adapter-decoy", "phix-decoy", "vector-decoy")

# Labels stamped on candidate calls.
NONOVERLAP_ALGORITHM = "max_nonoverlapping_intervals_v1"
ACCEPTED_FRACTION_LABEL = "accepted_fragments_per_sampled_fragment"
UNIQUE_FRACTION_LABEL = "legacy_alias_not_molecule_unique"
DENOMINATOR_SOURCE = "sampled_fragments"
CONTROL_POLICY = "negative_control_policy=not_used_for_default_background_assessment"
CI_LABEL = (
    "sampling-only CI: accepted-fragment sampling uncertainty only; not diagnostic confidence"
)
CI_REASON_PREFIX = "fraction_ci_95_label="
PENDING_DECISION = "decision_pending_task_16"

# Reasons that the gate trail replaces.
REPLACED_REASON_PREFIXES = (
    "unique_fraction_",
    "accepted_fragments_meet_theta_pos_absolute",
    "nonoverlap_fragments_meet_minimum",
    "breadth_meets_minimum",
    "background_final_positive_supported",
    "background_ratio_",
    "background_negative_safe",
    "background_not_negative_safe",
    "negative_control_policy=",
    "aggregation_level=",
    "nonoverlap_fragments_algorithm=",
    "coverage_interval_blocks=",
    "accepted_fraction_label=",
    "unique_fraction_label=",
    "fraction_denominator_source=",
    "ambiguity_fraction_below_positive_limit",
    "evidence_strength_meets_positive_minimum",
    "positive_",
    "total_sampled_fragments=",
    "candidate_family_size=",
    "multiplicity_family=",
    "planned_round_look_count=",
    "current_look_index=",
    "sequential_look_correction=",
    "theta_neg_operational=",
    "high_candidate_ambiguity_present",
    "ambiguity_not_used_as_group_detection_veto",
    "accession_resolution=",
    "positive_boundary_level=",
    "group_positive_identity_continuity_",
)

# Reasons that the control annotation replaces.
REPLACED_CONTROL_REASONS = (
    "background_ratio_",
    "background_negative_safe",
    "background_not_negative_safe",
    "negative_control_background_fraction",
)

# Table headers.
CANDIDATE_CALLS_HEADER = (
    "virus_name",
    "taxid",
    "accession_or_group",
    "accepted_fragments",
    "nonoverlap_fragments",
    "coverage_interval_blocks",
    "nonoverlap_fragments_algorithm",
    "raw_fraction",
    "unique_fraction",
    "accepted_fraction_label",
    "unique_fraction_label",
    "fraction_ci_95",
    "clopper_pearson_upper",
    "total_sampled_fragments",
    "fraction_denominator_source",
    "breadth",
    "ambiguous_fragments",
    "aggregation_level",
    "multiplicity_family",
    "accession_resolution",
    "decision",
    "decision_reasons",
    "evidence_strength",
)
ROUNDS_HEADER = ("sampled_fragments", "accepted_virus", "decision_status")
VIRUS_SUMMARY_HEADER = (
    "rank",
    "entity_id",
    "entity_name",
    "entity_type",
    "taxid",
    "aggregation_level",
    "decision",
    "evidence_strength",
    "accepted_fragments",
    "nonoverlap_fragments",
    "coverage_interval_blocks",
    "nonoverlap_fragments_algorithm",
    "ambiguous_fragments",
    "raw_fraction",
    "unique_fraction",
    "accepted_fraction_label",
    "unique_fraction_label",
    "fraction_ci_95_low",
    "fraction_ci_95_high",
    "clopper_pearson_upper",
    "total_sampled_fragments",
    "fraction_denominator_source",
    "breadth",
    "multiplicity_family",
    "top_accession",
    "top_accession_name",
    "supporting_accession_count",
    "decision_reasons",
)
COVERAGE_HEADER = "position\tdepth\n"

# Fixed values: (key, canonical path, legacy alias or None, kind).
ARTIFACT_CONTRACT = (
    ("sample_run_summary", "summary/sample_run_summary.json", "sample_summary.json", "file"),
    ("result_overview", "summary/result_overview.json", None, "file"),
    ("virus_summary", "summary/virus_summary.tsv", None, "file"),
    ("candidate_calls_accession", "results/candidate_calls.accession.tsv", "candidate_calls.tsv", "file"),
    ("detection_calls_group", "results/detection_calls.group.tsv", None, "file"),
    ("sampling_rounds", "results/sampling_rounds.tsv", "rounds.tsv", "file"),
    ("positive_candidate_coverage", "evidence/positive_candidate_coverage", "coverage", "directory"),
    ("run_manifest", "provenance/run_manifest.json", "run_manifest.json", "file"),
    ("checksum_sha256", "audit/checksum.sha256", "checksum.sha256", "file"),
    ("schema_versions", "audit/schema_versions.json", None, "file"),
    ("release_gate", "audit/release_gate.json", None, "file"),
    ("run_log", "logs/run.ndjson", "logs/run.log", "file"),
)
LEGACY_REQUIRED = (
    "sample_summary.json",
    "candidate_calls.tsv",
    "run_manifest.json",
    "rounds.tsv",
    "checksum.sha256",
)
CHECKSUM_PATHS = ("checksum.sha256", "audit/checksum.sha256")

# Schema names use this library's own namespace.
BUNDLE_SCHEMA = "siftline.report_bundle.v4"
SAMPLE_RUN_SUMMARY_SCHEMA = "siftline.sample_run_summary.v1"
RESULT_OVERVIEW_SCHEMA = "siftline.result_overview.v2"
RELEASE_GATE_SCHEMA = "siftline.release_gate.v1"
