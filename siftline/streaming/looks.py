"""Live sequential looks over a stream of adjudicated fragments.

The look a fragment enters follows from its sequence number alone, so the stream
needs no per-sample Python state and no sample is confined to one task. Each
micro-batch is reduced like a batch job and appended as round contributions;
contributions are additive, so looks are re-decided from their sum at any time.

``start_contributions`` takes adjudicated fragments with ``sequence``, the 0-based index of the QC-passing fragment within
its sample. ``start_raw`` takes raw reads as they arrive and numbers them itself: a ledger has, for each micro-batch, how many
passing fragments of each sample have arrived up to its end, so a batch adds its own ranks to the entry before its own. A
batch that runs again reads the same entry and overwrites its own: every fragment keeps its number. There is no event
time; order is the sequence number, and late fragments simply complete their round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.config import Profile
from siftline.operators import aggregate, decision, qc
from siftline.operators.sampling import ORDER_BLOCK, bucketed_rank, first_covering_round
from siftline.plans.screen import evaluated_looks, fragment_table
from siftline.tuning import broadcast_if_small


def assign_looks(fragments: DataFrame, rounds) -> DataFrame:
    """Add ``entry_round`` from the sequence number; fragments beyond the last look drop out."""
    sizes = F.array(*[F.lit(r) for r in rounds])
    entered = fragments.withColumn("entry_round", first_covering_round(F.col("sequence"), sizes).cast("int"))
    return entered.filter("entry_round > 0")


def start_contributions(fragments: DataFrame, profile: Profile, table_path: str, checkpoint_path: str, **trigger):
    """Start the query that appends reduced round contributions under ``table_path``.

    One folder per batch id, overwritten on replay, so a retried batch counts once.
    """
    looks = assign_looks(fragments, profile.sampling.rounds)

    def append(batch: DataFrame, batch_id: int) -> None:
        reduced = aggregate.reduce_evidence(aggregate.fragment_evidence(batch, "entry_round"))
        reduced.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    return (
        looks.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint_path)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


LEDGER = "sample_id string, arrived long"


def number_batch(passing: DataFrame, batch_id: int, ledger_path: str, order_col: str = "record_number") -> DataFrame:
    """Add ``sequence`` to the passing fragments of a batch, and write the batch's ledger entry.

    Inside a batch, fragments go by ``order_col``, those of equal place by key. Ranks are taken in narrow buckets, so no
    sample is confined to one task; an entry has one row a sample.
    """
    spark = passing.sparkSession
    before = spark.read.schema(LEDGER).parquet(f"{ledger_path}/batch={batch_id - 1}")
    counts = passing.groupBy("sample_id").agg(F.count(F.lit(1)).alias("here"))
    after = before.join(counts, "sample_id", "full").select(
        "sample_id", (F.coalesce("arrived", F.lit(0)) + F.coalesce("here", F.lit(0))).cast("long").alias("arrived")
    )
    after.write.mode("overwrite").parquet(f"{ledger_path}/batch={batch_id}")
    order = [F.col(order_col), F.col("fragment_key")]
    ranked = bucketed_rank(passing, ["sample_id"], F.floor(F.col(order_col) / ORDER_BLOCK), order).drop("group_rows")
    known = ranked.join(broadcast_if_small(before), "sample_id", "left")
    return known.withColumn("sequence", F.coalesce("arrived", F.lit(0)) + F.col("rank")).drop("arrived", "rank")


def start_raw(
    fragments: DataFrame, mappings, classified: DataFrame, profile: Profile, folder: str, checkpoint_path: str, order_col: str = "record_number", **trigger
):
    """Start the query that judges, numbers and looks at raw reads (sample_id, fragment_key, r1_seq, r2_seq, ``order_col``).

    ``mappings`` has the hits, or is a function from a batch of entered fragments to their hits. Contributions go to
    ``folder``/rounds, the ledger to ``folder``/ledger, both overwritten by batch id on replay. Fragments beyond a sample's last
    look are numbered and go no further.
    """
    rounds_path, ledger_path = f"{folder}/rounds", f"{folder}/ledger"
    spark = classified.sparkSession
    # The entry before the first batch.
    spark.createDataFrame([], LEDGER).write.mode("overwrite").parquet(f"{ledger_path}/batch=-1")

    def take(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        passing = qc.qc_passing(batch, profile.qc).select("sample_id", "fragment_key", order_col)
        entered = assign_looks(number_batch(passing, batch_id, ledger_path, order_col), profile.sampling.rounds)
        hits = mappings(entered) if callable(mappings) else mappings
        judged = fragment_table(hits, classified, profile.fragment, entered.select("sample_id", "fragment_key", "entry_round"))
        reduced = aggregate.reduce_evidence(aggregate.fragment_evidence(judged, "entry_round"))
        reduced.write.mode("overwrite").parquet(f"{rounds_path}/batch={batch_id}")
        batch.unpersist()

    return (
        fragments.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint_path)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_contributions(spark: SparkSession, table_path: str) -> DataFrame:
    """Contributions of all batches, summed."""
    rows = spark.read.parquet(table_path)
    keys = ["sample_id", "entry_round", "kind", "contig", "pos"]
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("val").alias("val"))


def reached_looks(contributions: DataFrame, rounds) -> DataFrame:
    """Largest complete look per sample: its prefix has fully arrived."""
    sampled = contributions.filter("kind = 's'").groupBy("sample_id").agg(F.sum("n").alias("seen"))
    sizes = F.array(*[F.lit(r) for r in rounds])
    return sampled.select(
        "sample_id", "seen", F.size(F.filter(sizes, lambda size: size <= F.col("seen"))).alias("complete_looks")
    )


def decide_now(contributions: DataFrame, classified: DataFrame, profile: Profile, drained: bool = False) -> DataFrame:
    """Look outcomes so far; incomplete looks are held back until the input is ``drained``."""
    rounds = profile.sampling.rounds
    contigs = aggregate.cumulative_rounds(contributions, len(rounds))
    calls = aggregate.to_calls(aggregate.aggregate_candidates(contigs, classified))
    looks = decision.decide(evaluated_looks(calls, profile, reasons=False), len(rounds), profile.decision)
    if drained:
        return looks
    reached = reached_looks(contributions, rounds)
    return looks.join(reached, "sample_id").filter(F.col("round") <= F.col("complete_looks")).drop(
        "seen", "complete_looks"
    )
