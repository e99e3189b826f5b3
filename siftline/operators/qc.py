"""Read-pair quality predicates and the first-failure-wins verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.config import QcConfig
from siftline.functions.sequence import entropy_2mer, fast_low_complexity, n_count

R1, R2 = "r1_seq", "r2_seq"


def _size(seq: Column) -> Column:
    return F.coalesce(F.length(seq), F.lit(0))


def pair_complete(r1: str = R1, r2: str = R2) -> Column:
    """Both mates present and non-empty."""
    return (_size(F.col(r1)) > 0) & (_size(F.col(r2)) > 0)


def length_in_bounds(seq: Column, cfg: QcConfig = QcConfig()) -> Column:
    return _size(seq).between(cfg.min_read_length, cfg.max_read_length)


def n_fraction(r1: str = R1, r2: str = R2) -> Column:
    """Share of N over both mates; zero without bases."""
    a, b = F.col(r1), F.col(r2)
    total = _size(a) + _size(b)
    count = F.coalesce(n_count(a), F.lit(0)) + F.coalesce(n_count(b), F.lit(0))
    return F.when(total > 0, count / total).otherwise(0.0)


def qc_verdict(fragments: DataFrame, cfg: QcConfig = QcConfig()) -> DataFrame:
    """Add ``qc`` = (reason, mate, observed); reason ``pass`` when nothing failed.

    Measurements are columns of their own, computed once. Entropies are only
    computed for pairs that survive the cheap tests.
    """
    r1, r2 = F.col(R1), F.col(R2)
    low = F.lit(cfg.min_entropy_bits)
    fine = lambda bits: F.coalesce(bits >= low, F.lit(True))
    has_r2 = r2.isNotNull()
    sized = length_in_bounds(r1, cfg) & (length_in_bounds(r2, cfg) | ~has_r2)
    if cfg.require_pair:
        sized = sized & pair_complete()
    measured = (
        fragments.withColumn("_n", n_fraction())
        .withColumn("_sized", sized & (F.col("_n") <= cfg.max_n_fraction))
        .withColumn("_fast1", F.when(F.col("_sized"), fast_low_complexity(r1)))
        .withColumn("_fast2", F.when(F.col("_sized"), fast_low_complexity(r2)))
        .withColumn("_cheap", F.col("_sized") & fine(F.col("_fast1")) & fine(F.col("_fast2")))
        # Both mates in one pass; others are null and cost nothing.
        .withColumns({f"_bits{mate}": entropy_2mer(F.when(F.col("_cheap"), r)) for mate, r in ((1, r1), (2, r2))})
        .withColumn("_bits2", F.when(fine(F.col("_bits1")), F.col("_bits2")))
    )

    def verdict(reason: str, mate: int, observed: Column) -> Column:
        return F.struct(
            F.lit(reason).alias("reason"),
            F.lit(mate).alias("mate"),
            observed.cast("double").alias("observed"),
        )

    branches = [
        (~length_in_bounds(r1, cfg), verdict("length", 1, _size(r1))),
        (has_r2 & ~length_in_bounds(r2, cfg), verdict("length", 2, _size(r2))),
        (F.col("_n") > cfg.max_n_fraction, verdict("n_content", 0, F.col("_n"))),
        *[
            (~fine(F.col(name)), verdict("low_complexity", mate, F.col(name)))
            for name, mate in (("_fast1", 1), ("_fast2", 2), ("_bits1", 1), ("_bits2", 2))
        ],
    ]
    if cfg.require_pair:
        branches.insert(0, (_size(r1) == 0, verdict("pair_incomplete", 1, F.lit(0))))
        branches.insert(2, (_size(r2) == 0, verdict("pair_incomplete", 2, F.lit(0))))
    expr = F
    for condition, value in branches:
        expr = expr.when(condition, value)
    return measured.withColumn("qc", expr.otherwise(verdict("pass", 0, F.col("_n")))).drop(
        "_n", "_sized", "_fast1", "_fast2", "_cheap", "_bits1", "_bits2"
    )


def qc_passes(cfg: QcConfig = QcConfig()) -> Column:
    """Whether a pair passes, cheapest test first.

    The closed-form complexity test agrees with the entropy and is not repeated.
    """
    r1, r2 = F.col(R1), F.col(R2)
    rich = lambda seq: entropy_2mer(seq) >= cfg.min_entropy_bits
    if cfg.require_pair:
        return (
            pair_complete()
            & length_in_bounds(r1, cfg)
            & length_in_bounds(r2, cfg)
            & (n_fraction() <= cfg.max_n_fraction)
            & rich(r1)
            & rich(r2)
        )
    return (
        length_in_bounds(r1, cfg)
        & (r2.isNull() | length_in_bounds(r2, cfg))
        & (n_fraction() <= cfg.max_n_fraction)
        & rich(r1)
        & (r2.isNull() | rich(r2))
    )


def qc_passing(fragments: DataFrame, cfg: QcConfig = QcConfig()) -> DataFrame:
    """The pairs that pass.

    Spark moves a filter below the columns that it reads and spells them out at each of a dozen mentions; what a generator
    gives is computed once.
    """
    bound = fragments.select(*(c for c in fragments.columns if c not in (R1, R2)), F.inline(F.array(F.struct(R1, R2))))
    return bound.filter(qc_passes(cfg)).select(*fragments.columns)


def qc_stats(verdicts: DataFrame, by=("sample_id",)) -> DataFrame:
    """Total, passed and the four failure buckets."""
    reason = F.col("qc.reason")
    return verdicts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_fragments"),
        F.count_if(reason == "pass").alias("passed_fragments"),
        F.count_if(reason == "low_complexity").alias("low_complexity_filtered"),
        F.count_if(reason == "n_content").alias("n_content_filtered"),
        F.count_if(reason == "length").alias("length_filtered"),
        F.count_if(reason == "pair_incomplete").alias("pair_incomplete"),
    )
