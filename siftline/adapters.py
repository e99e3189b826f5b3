"""Driver tables seen as domain tables.

Each adapter is one SELECT that Spark and the checking engine both run;
``{name}`` stands for a table and ``{explode}``/``{upto}`` for a construct that
differs. Spark takes windows of texts from :func:`windows`, which cuts a text in one
pass. Every adapter covers its whole table and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = """
SELECT CAST(s.s_suppkey AS STRING) AS contig,
       concat('ACC', CAST(n.n_nationkey AS STRING), '.', CAST(s.s_suppkey % 3 AS STRING)) AS accession,
       CAST(n.n_nationkey * 10 + (CASE WHEN s.s_suppkey % 3 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS taxid,
       concat(n.n_name, ' strain ', CASE WHEN s.s_suppkey % 3 = 2 THEN 'B' ELSE 'A' END) AS virus_name,
       n.n_name AS "group",
       CAST(3000 + (s.s_suppkey % 7) * 100 AS BIGINT) AS genome_length,
       CASE r.r_regionkey WHEN 0 THEN 'Host_Genome' WHEN 4 THEN 'adapter decoy'
            WHEN 1 THEN 'refseq-virus' WHEN 2 THEN 'Virus_Panel' ELSE 'spike in virus' END AS source_type
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

# The same panel with accessions that cut across nations: identities conflict.
CONFLICTED_MANIFEST = """
SELECT CAST(s.s_suppkey AS STRING) AS contig,
       concat('ACC', CAST(s.s_suppkey % 40 AS STRING)) AS accession,
       CAST(n.n_nationkey AS BIGINT) AS taxid,
       n.n_name AS virus_name,
       CASE WHEN s.s_suppkey % 11 = 0 THEN ' ' WHEN s.s_suppkey % 13 = 0 THEN 'human' ELSE n.n_name END AS "group",
       CAST(3000 AS BIGINT) AS genome_length,
       CASE r.r_regionkey WHEN 0 THEN 'host' WHEN 4 THEN 'unknown source' ELSE 'virus' END AS source_type
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

HITS = """
SELECT l_returnflag AS sample_id,
       CAST(l_orderkey AS STRING) AS fragment_key,
       CAST(l_linenumber % 2 + 1 AS INT) AS mate,
       CAST(l_suppkey AS STRING) AS contig,
       CAST(l_quantity AS INT) AS mapq,
       CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(floor(l_extendedprice / 1000) AS INT) END AS as_score,
       CASE WHEN l_tax > 0.075 THEN NULL ELSE CAST(l_linenumber AS INT) END AS nm,
       l_linenumber <= 4 AS is_primary,
       l_linestatus = 'O' AND l_linenumber = 7 AS is_supplementary,
       CAST(0 AS INT) AS segment_id,
       CAST(l_partkey % 2900 AS BIGINT) AS target_start,
       CAST(l_partkey % 2900 + CAST(l_quantity AS BIGINT) AS BIGINT) AS target_end
FROM {lineitem}
"""

# Every line item's pair, whether or not it maps: the fragments to sample from.
HIT_FRAGMENTS = """
SELECT DISTINCT l_returnflag AS sample_id, CAST(l_orderkey AS STRING) AS fragment_key, l_orderkey AS record_number
FROM {lineitem}
"""

# Consecutive 300-character windows of each whole document, read as two mates. Documents are dealt out by key before they are
# multiplied.
_FROM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TO = "ACCGANTTGNNCGATCNCATANNNGN" + "acCGGNTTGNNCGATCNCATGNNNAN"
WINDOWS = """
SELECT doc_id, source, text, {explode}({upto}(0, greatest(length(text) - 1, 0) // 300)) AS w
FROM (SELECT /*+ REPARTITION(doc_id) */ doc_id, source, text FROM {documents}) dealt
"""
FRAGMENTS = f"""
SELECT source AS sample_id,
       concat('doc-', CAST(doc_id AS STRING), '-', CAST(w AS STRING)) AS fragment_key,
       translate(substr(text, CAST(w * 300 + 1 AS INT), 150), '{_FROM}', '{_TO}') AS r1_seq,
       translate(substr(text, CAST(w * 300 + 151 AS INT), 150), '{_FROM}', '{_TO}') AS r2_seq,
       substr(text, CAST(w * 300 + 1 AS INT), 150) AS r1_qual,
       substr(text, CAST(w * 300 + 151 AS INT), 150) AS r2_qual,
       CAST(doc_id * 1000 + w AS BIGINT) AS record_number
FROM ({WINDOWS}) docs
"""

MATES = """
SELECT concat('conv-', CAST(conv_id AS STRING)) AS sample_id,
       CAST(turn + 1 AS BIGINT) AS record_number,
       concat('q', CAST(conv_id AS STRING), ':', CASE WHEN role = 'system' THEN 's' ELSE CAST((turn - turn % 2) AS STRING) END,
              '/', CAST(turn % 2 + 1 AS STRING), ' ', role) AS qname,
       CASE role WHEN 'user' THEN 64 WHEN 'assistant' THEN 128 ELSE 0 END AS flags,
       text AS seq,
       role AS qual
FROM {conversations}
"""

CONTROLS = """
SELECT concat('control-', event_type) AS control_id,
       CASE event_type WHEN 'error' THEN 'contaminated' ELSE 'pass' END AS control_status
FROM {events} GROUP BY event_type
"""
CONTROL_CANDIDATES = """
SELECT concat('control-', e.event_type) AS control_id,
       n.n_name AS accession_or_group,
       CASE WHEN e.value > 30 THEN 0.0 ELSE round(e.value / 1000, 6) END AS unique_fraction
FROM {events} e JOIN {nation} n ON n.n_nationkey = e.user_id % 20
"""
# One control per sample; one sample names a control that does not exist.
SAMPLE_CONTROLS = """
SELECT DISTINCT l_returnflag AS sample_id,
       CASE l_returnflag WHEN 'A' THEN 'control-click' WHEN 'N' THEN 'control-error' ELSE 'control-none' END AS control_id
FROM {lineitem}
"""

PANEL = """
SELECT concat('bench-', CAST(item_id AS STRING)) AS contig,
       concat('bench-', CAST(item_id AS STRING), CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' AC:K' || CAST(item_id AS STRING) || '.1 chromosome' ELSE ' ' || substr(text, 1, 12) END) AS header,
       translate(text, '""" + _FROM + "', '" + _TO + """') AS sequence,
       item_id AS ordinal
FROM {benchmark}
"""

# Orders seen as runs: claimed and expected versions, modes and gates disagree for some.
RUNS = """
SELECT concat('run-', CAST(o.o_orderkey AS STRING)) AS sample_id,
       CASE WHEN o.o_orderkey % 17 = 0 THEN ' Benchmark_Failed ' ELSE 'release_candidate' END AS profile_status,
       CASE o.o_orderkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'fail' ELSE 'pass' END AS negative_control_status,
       o.o_orderkey % 7 = 0 AS gates_missing,
       CASE WHEN o.o_orderkey % 11 = 0 THEN 'fail' ELSE 'pass' END AS backend_status,
       CASE WHEN o.o_custkey % 13 = 0 THEN 'fail' ELSE 'pass' END AS reference_status,
       CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'fail' ELSE 'pass' END AS specificity_status,
       CASE WHEN o.o_orderkey % 19 = 0 THEN 'fail' ELSE 'pass' END AS sensitivity_status,
       CASE WHEN o.o_orderstatus = 'F' THEN 'streaming' WHEN o.o_orderkey % 29 = 0 THEN 'other' ELSE 'representative' END AS sampling_mode,
       CASE WHEN o.o_orderkey % 23 = 0 THEN 'representative' WHEN o.o_orderstatus = 'F' THEN 'streaming' WHEN o.o_orderkey % 29 = 0 THEN 'other' ELSE 'representative' END AS profile_sampling_mode,
       CASE o.o_custkey % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'weak_positive' WHEN 2 THEN 'negative' ELSE 'indeterminate' END AS decision_status,
       CASE o.o_orderkey % 3 WHEN 0 THEN 'final' WHEN 1 THEN 'provisional' ELSE 'blocked' END AS claimed_status,
       CASE o.o_orderkey % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN 'final' WHEN 2 THEN 'provisional' ELSE NULL END AS gate_status,
       o.o_orderkey % 2 = 0 AS negative_control_required,
       o.o_orderkey % 2 = 0 AND o.o_orderkey % 31 <> 0 AS profile_control_required,
       CASE o.o_orderkey % 6 WHEN 0 THEN 'bundle-0' ELSE 'bundle-1' END AS reference_bundle_version,
       concat('profile-', c.c_mktsegment) AS calibration_profile_version,
       CASE WHEN o.o_orderkey % 37 = 0 THEN 'old' ELSE 'seed-vote' END AS backend,
       o.o_orderkey % 41 AS seed,
       CASE WHEN o.o_orderkey % 8 = 0 THEN 'bundle-0' ELSE 'bundle-1' END AS m_reference_bundle_version,
       concat('profile-', CASE WHEN o.o_orderkey % 10 = 0 THEN 'none' ELSE c.c_mktsegment END) AS m_calibration_profile_version,
       'seed-vote' AS m_backend,
       (o.o_orderkey + CASE WHEN o.o_orderkey % 43 = 0 THEN 1 ELSE 0 END) % 41 AS m_seed,
       CASE WHEN o.o_custkey % 2 = 0 THEN 'profile-BUILDING' ELSE concat('profile-', c.c_mktsegment) END AS profile_id,
       o.o_custkey % 10 AS rounds_run,
       CAST(floor(o.o_totalprice) AS BIGINT) AS input_fragments
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

# Line items seen as bundle files: each part owns some of the contract paths.
BUNDLE_PATHS = (
    "sample_summary.json", "candidate_calls.tsv", "run_manifest.json", "rounds.tsv", "checksum.sha256",
    "summary/sample_run_summary.json", "summary/result_overview.json", "summary/virus_summary.tsv",
    "results/candidate_calls.accession.tsv", "results/detection_calls.group.tsv", "results/sampling_rounds.tsv",
    "evidence/positive_candidate_coverage/x.coverage.tsv", "provenance/run_manifest.json", "audit/checksum.sha256",
    "audit/schema_versions.json", "audit/release_gate.json", "logs/run.ndjson", "notes.txt",
)
BUNDLE_FILES = """
SELECT concat('part-', CAST(l_partkey AS STRING)) AS sample_id,
       CASE (l_orderkey + l_linenumber) % """ + str(len(BUNDLE_PATHS)) + " " + " ".join(
    f"WHEN {i} THEN '{p}'" for i, p in enumerate(BUNDLE_PATHS)
) + """ END AS path,
       min(CASE WHEN l_quantity > 30 THEN '[1, true, "x"]' ELSE '[1,true,"x"]' END) AS content
FROM {lineitem} GROUP BY 1, 2
"""

# Orders as benchmark datasets, their line items as calls.
DATASETS = """
SELECT concat('ds-', CAST(o_orderkey AS STRING)) AS dataset_id,
       CASE WHEN o_orderstatus = 'O' THEN 'negative' ELSE 'spike_in' END AS expected_outcome,
       CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'V1' ELSE concat('ACC', CAST(o_custkey % 100 AS STRING)) END AS expected_target,
       CASE o_custkey % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'weak_positive' WHEN 2 THEN 'negative' ELSE 'indeterminate' END AS decision_status,
       CASE o_orderkey % 3 WHEN 0 THEN 'final' WHEN 1 THEN 'provisional' ELSE 'blocked' END AS release_status,
       o_custkey AS sampled_fragments, o_orderkey AS qc_passing_fragments
FROM {orders}
"""
DATASET_CALLS = """
SELECT concat('ds-', CAST(l_orderkey AS STRING)) AS dataset_id, concat('ACC', CAST(l_suppkey AS STRING)) AS accession_or_group,
       concat('V', CAST(l_suppkey % 5 AS STRING)) AS virus_name, CAST(floor(l_quantity / 10) AS BIGINT) AS accepted_fragments,
       CAST(l_linenumber AS BIGINT) AS nonoverlap_fragments, l_discount AS breadth
FROM {lineitem}
"""
LABELLED = """
SELECT d.lang AS virus_name, CASE WHEN l.quality = 1 THEN 'positive' ELSE 'negative' END AS truth,
       CASE d.n_chars % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'weak_positive' WHEN 2 THEN 'negative' ELSE 'indeterminate' END AS decision,
       CASE d.doc_id % 3 WHEN 0 THEN 'final' WHEN 1 THEN 'provisional' ELSE 'blocked' END AS release_status
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
"""

# The same windows and panel in a four-letter alphabet without gaps, so that seeds span words.
_SEED_FROM = _FROM + " .,;:!?-|"
_SEED_TO = (_TO + "ATGCATGCA").replace("N", "G")
SEED_FRAGMENTS = f"""
SELECT source AS sample_id,
       concat('doc-', CAST(doc_id AS STRING), '-', CAST(w AS STRING)) AS fragment_key,
       translate(substr(text, CAST(w * 300 + 1 AS INT), 150), '{_SEED_FROM}', '{_SEED_TO}') AS r1_seq,
       translate(substr(text, CAST(w * 300 + 151 AS INT), 150), '{_SEED_FROM}', '{_SEED_TO}') AS r2_seq
FROM ({WINDOWS}) docs
"""
SEED_PANEL = f"""
SELECT concat('bench-', CAST(item_id AS STRING)) AS contig, translate(text, '{_SEED_FROM}', '{_SEED_TO}') AS sequence
FROM {{benchmark}}
"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The texts of a window's two mates, as the adapters spell them.
_MATE_TEXTS = {f"r{mate}_text": f"substr(text, CAST(w * 300 + {at} AS INT), 150)" for mate, at in ((1, 1), (2, 151))}


def windows(documents: DataFrame) -> DataFrame:
    """(doc_id, source, w, r1_text, r2_text): ``WINDOWS`` and the texts of their mates.

    A text is cut in one pass: to look each window up by its place takes, for all windows of a text, time by the square of
    its length, and rows that keep the text take that much memory.
    """
    text = F.col("text")
    pieces = F.when(F.length(text) > 0, F.regexp_extract_all(text, F.lit("(?s).{1,300}"), F.lit(0))).otherwise(F.array(text))
    dealt = documents.select("doc_id", "source", "text").repartition("doc_id").select("doc_id", "source", F.posexplode(pieces).alias("w", "piece"))
    mates = (F.substring("piece", at, 150).alias(name) for name, at in zip(_MATE_TEXTS, (1, 151)))
    return dealt.select("doc_id", "source", F.col("w").cast("bigint").alias("w"), *mates)


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run an adapter over the parquet tables in ``sf_dir``."""
    used = {}
    if WINDOWS in text:
        used["windows"] = windows(read_table(spark, sf_dir, "documents"))
        text = text.replace(f"({WINDOWS}) docs", "{windows}")
        for mate, cut in _MATE_TEXTS.items():
            text = text.replace(cut, mate)
    used |= {t: read_table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    text = text.replace('"group"', "`group`").replace("//", "DIV")
    text = text.replace("{explode}", "explode").replace("{upto}", "sequence")
    return spark.sql(text, **used)


def plain_sql(text: str) -> str:
    """The adapter for an engine in which the tables are views of the same name."""
    for table in TABLES:
        text = text.replace("{" + table + "}", table)
    return text.replace("{explode}", "unnest").replace("{upto}", "generate_series")
