"""A cross-section of the registered queries against DuckDB; tests/compare.py runs all of them."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from siftline.checks.queries import QUERIES

NAMES = (
    "hits_with_manifest",
    "best_hits_per_class",
    "fragment_classes_paired",
    "cumulative_round_calls",
    "merged_coverage_blocks",
    "clopper_pearson_bounds",
    "decision_reason_trail",
    "sequential_decisions",
    "qc_verdicts",
    "entry_rounds",
    "virus_summaries",
    "release_statuses",
    "dataset_verdicts",
    "audit_completeness",
    "manifest_rows",
    "mate_pairs",
    "fastq_round_trip",
    "seed_vote_hits",
)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, con, name):
    status, detail = compare(entry.queries()[name], entry.oracle_sql()[name], spark, con, sf_dir)
    assert status == "ok", detail


def test_every_query_is_named_and_most_have_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    without = set(QUERIES) - set(entry.oracle_sql())
    assert without == {"siphash_ranks", "minimizer_hits"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
