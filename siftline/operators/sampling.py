"""Seeded nested sampling.

A sample can hold a large share of all rows, so no window ever spans a whole
sample. Rows are ranked inside narrow buckets that follow the sort order, and a
histogram of the buckets (a small table) supplies each bucket's starting rank.
The histogram also drops every bucket beyond the retention bound before the
ranking shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.config import PROPORTIONAL_MAX_COUNT, PROPORTIONAL_MIN_COUNT, SamplingPlan
from siftline.functions.siphash import siphash13_hex
from siftline.tuning import is_small

RANK_BUCKET_DIGITS = 3
ORDER_BLOCK = 1 << 16


def rank_key(seed: int, key: Column, hash: str = "md5") -> Column:
    """Order-free seeded rank: fixed-width hex text, so string order is unsigned order."""
    if hash == "siphash13":
        return siphash13_hex(seed, key)
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def bucket_offsets(rows: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """Rows before each bucket (``bucket_start``) and per group (``group_rows``)."""
    counted = rows.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("bucket_rows"))
    group = Window.partitionBy(*by)
    before = group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(
        *by,
        bucket,
        F.coalesce(F.sum("bucket_rows").over(before), F.lit(0)).alias("bucket_start"),
        F.sum("bucket_rows").over(group).alias("group_rows"),
    )


def bucketed_rank(
    rows: DataFrame,
    by: list[str],
    bucket: Column,
    order: list[Column],
    keep: Column | None = None,
) -> DataFrame:
    """Add the exact 0-based ``rank`` within ``by`` and ``group_rows``.

    ``bucket`` must be a coarsening of ``order``. ``keep`` is the number of ranks
    to keep per group, an expression over ``group_rows``; buckets that start
    beyond it never reach the ranking shuffle.
    """
    tagged = rows.withColumn("_bucket", bucket)
    offsets = bucket_offsets(tagged.select(*by, "_bucket"), by, "_bucket")
    if keep is not None:
        offsets = offsets.withColumn("_keep", keep).filter(F.col("bucket_start") < F.col("_keep"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    ranked = tagged.join(offsets, [*by, "_bucket"]).withColumn(
        "rank", F.col("bucket_start") + F.row_number().over(inside) - 1
    )
    if keep is not None:
        ranked = ranked.filter(F.col("rank") < F.col("_keep")).drop("_keep")
    return ranked.drop("_bucket", "bucket_start")


def representative_sample(fragments: DataFrame, seed: int, k: int, hash: str = "md5") -> DataFrame:
    """Exact bottom-k per sample by seeded rank, ties broken by key."""
    hashed = fragments.withColumn("rank_hex", rank_key(seed, F.col("fragment_key"), hash))
    return bucketed_rank(
        hashed,
        ["sample_id"],
        F.substring("rank_hex", 1, RANK_BUCKET_DIGITS),
        [F.col("rank_hex"), F.col("fragment_key")],
        keep=F.lit(k),
    ).drop("group_rows")


def within_sample(rows: DataFrame, sampled: DataFrame, seed: int, hash: str = "md5") -> DataFrame:
    """``rows`` (sample_id, fragment_key and others) without those whose fragment is surely not in ``sampled``, before they move.

    A sample keeps the fragments of smallest seeded rank, so the largest rank that it keeps (one value a sample, broadcast
    after a check of their number) rules out every fragment above it. Exact: no sampled fragment is lost, and only
    unsampled ones of the same rank stay. With too many samples to broadcast, rows stay as they are.
    """
    cutoffs = sampled.groupBy("sample_id").agg(F.max("rank_hex").alias("_cutoff"))
    if not is_small(cutoffs):
        return rows
    below = rank_key(seed, F.col("fragment_key"), hash) <= F.col("_cutoff")
    return rows.join(F.broadcast(cutoffs), "sample_id").filter(below).drop("_cutoff")


def prefix_sizes(targets, retained: Column) -> Column:
    """Array of min(target, retained)."""
    return F.array(*[F.least(F.lit(t).cast("bigint"), retained.cast("bigint")) for t in targets])


def effective_counts(plan: SamplingPlan, passing: Column) -> Column:
    """Array of per-round sample sizes implied by the plan for ``passing`` fragments."""
    if not plan.proportional:
        return prefix_sizes(plan.rounds, passing)
    return F.array(
        *[_effective_count(raw_count(p, passing), passing, plan.allow_threshold_override) for p in plan.proportions]
    )


def raw_count(proportion, passing: Column) -> Column:
    share = proportion if isinstance(proportion, Column) else F.lit(float(proportion))
    return F.round(share * passing.cast("double")).cast("bigint")


def _effective_count(raw: Column, passing: Column, override: bool) -> Column:
    passing = passing.cast("bigint")
    if override:
        return F.least(raw, passing)
    clamped = F.greatest(F.lit(PROPORTIONAL_MIN_COUNT), F.least(F.lit(PROPORTIONAL_MAX_COUNT), raw))
    return F.when(passing < PROPORTIONAL_MIN_COUNT, passing).otherwise(F.least(clamped, passing)).cast("bigint")


def first_covering_round(rank: Column, prefixes: Column) -> Column:
    """1-based first round whose prefix covers a 0-based rank; 0 when none does."""
    return F.array_position(F.transform(prefixes, lambda size: rank < size), True)


def entry_round(fragments: DataFrame, plan: SamplingPlan) -> DataFrame:
    """Keep the sampled fragments and add ``rank``, ``entry_round``, ``group_rows``.

    Later rounds contain earlier ones: round r is every row with ``entry_round <= r``.
    """
    sizes = effective_counts(plan, F.col("group_rows"))
    hashed = fragments.withColumn("rank_hex", rank_key(plan.seed, F.col("fragment_key"), plan.hash))
    ranked = bucketed_rank(
        hashed,
        ["sample_id"],
        F.substring("rank_hex", 1, RANK_BUCKET_DIGITS),
        [F.col("rank_hex"), F.col("fragment_key")],
        keep=F.array_max(sizes),
    )
    return ranked.withColumn("entry_round", first_covering_round(F.col("rank"), sizes).cast("int"))


def first_n(fragments: DataFrame, order_col: str, n: int) -> DataFrame:
    """First n QC-passing fragments per sample in input order (provisional results only)."""
    return bucketed_rank(
        fragments,
        ["sample_id"],
        F.floor(F.col(order_col) / ORDER_BLOCK),
        [F.col(order_col)],
        keep=F.lit(n),
    ).drop("group_rows")


def prefix_entry_round(fragments: DataFrame, order_col: str, rounds) -> DataFrame:
    """Input-order looks: the round in which each of the first max(rounds) fragments enters."""
    ranked = first_n(fragments, order_col, max(rounds))
    sizes = F.array(*[F.lit(r) for r in rounds])
    return ranked.withColumn("entry_round", first_covering_round(F.col("rank"), sizes).cast("int"))


def resolve_rounds(totals: DataFrame, proportions, override: bool = False) -> DataFrame:
    """One row per (sample, round) with raw and effective counts and its warning, if any."""
    shares = F.array(*[F.lit(float(p)) for p in proportions])
    n = F.col("qc_passing_fragments").cast("bigint")
    rows = totals.select("sample_id", n.alias("qc_passing_fragments"), F.posexplode(shares).alias("_i", "proportion"))
    raw, round_no = F.col("raw_count"), F.col("round")
    low, high = F.lit(PROPORTIONAL_MIN_COUNT), F.lit(PROPORTIONAL_MAX_COUNT)
    rows = (
        rows.withColumn("round", F.col("_i") + 1)
        .withColumn("raw_count", raw_count(F.col("proportion"), n))
        .withColumn("effective_count", _effective_count(raw, n, override))
        .drop("_i")
    )
    outside = ~raw.between(low, high)
    thresholds = f"[{PROPORTIONAL_MIN_COUNT}, {PROPORTIONAL_MAX_COUNT}]"
    if override:
        kind = F.when(outside, "sampling_threshold_override")
        text = F.format_string("look %d keeps %d fragments, though its share, %d, is outside " + thresholds, round_no, F.col("effective_count"), raw)
    else:
        small = n < low
        kind = F.when(small & (round_no == 1), "small_dataset_retained_all").when(
            ~small & outside, "effective_count_clamped"
        )
        text = F.when(
            small, F.format_string(f"with %d passing fragments, fewer than {PROPORTIONAL_MIN_COUNT}, each look takes all of them", n)
        ).otherwise(F.format_string("look %d takes %d fragments, as its share, %d, is outside " + thresholds, round_no, F.col("effective_count"), raw))
    whole_dataset = kind == "small_dataset_retained_all"
    return (
        rows.withColumn("warning_kind", kind)
        .withColumn("warning_round", F.when(kind.isNotNull() & ~whole_dataset, round_no))
        .withColumn("warning_message", F.when(kind.isNotNull(), text))
    )


def round_plan_report(rounds: DataFrame) -> DataFrame:
    """One row per sample from :func:`resolve_rounds` output (at most 64 rounds each)."""
    ordered = lambda value: F.transform(
        F.sort_array(F.collect_list(F.struct("round", F.col(value).alias("v")))), lambda s: s["v"]
    )
    warnings = F.sort_array(
        F.collect_list(
            F.when(
                F.col("warning_kind").isNotNull(),
                F.struct(
                    F.col("round").alias("look"),
                    F.col("warning_kind").alias("kind"),
                    F.col("warning_round").alias("round"),
                    F.col("warning_message").alias("message"),
                ),
            )
        )
    )
    return rounds.groupBy("sample_id").agg(
        F.lit("proportional").alias("round_mode"),
        ordered("proportion").alias("requested_proportions"),
        ordered("raw_count").alias("raw_proportional_counts"),
        ordered("effective_count").alias("effective_counts"),
        F.max("qc_passing_fragments").alias("qc_passing_denominator"),
        warnings.alias("warnings"),
    )


def absolute_plan_report(totals: DataFrame, rounds) -> DataFrame:
    """The same row per sample for a plan of absolute rounds: what was asked for and what a sample can give."""
    n = F.col("qc_passing_fragments").cast("bigint")
    return totals.select(
        "sample_id",
        F.lit("absolute").alias("round_mode"),
        F.array(*[F.lit(r).cast("bigint") for r in rounds]).alias("requested_rounds"),
        prefix_sizes(rounds, n).alias("effective_counts"),
        n.alias("qc_passing_denominator"),
    )


def plan_report(totals: DataFrame, plan: SamplingPlan) -> DataFrame:
    """The sampling accounting of every sample (sample_id, qc_passing_fragments), for either kind of plan."""
    if plan.proportional:
        return round_plan_report(resolve_rounds(totals, plan.proportions, plan.allow_threshold_override))
    return absolute_plan_report(totals, plan.rounds)


def qc_baseline(looks: DataFrame) -> DataFrame:
    """Running maximum of each QC counter across re-opened looks; a shrinking total is flagged."""
    history = Window.partitionBy("sample_id").orderBy("round")
    upto = history.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counters = (
        "total_fragments",
        "passed_fragments",
        "low_complexity_filtered",
        "n_content_filtered",
        "length_filtered",
        "pair_incomplete",
    )
    before = F.max("total_fragments").over(history.rowsBetween(Window.unboundedPreceding, -1))
    return looks.select(
        "sample_id",
        "round",
        *[F.max(c).over(upto).alias(c) for c in counters],
        F.coalesce(F.col("total_fragments") < before, F.lit(False)).alias("total_shrank"),
    )
