"""Looks one after the other: a sample that has stopped is not looked at again.

Mappings of sampled fragments are written once, in folders by entry round and sample. A look reads the folders of its
round and of the samples that are still undecided, and adds their reduced evidence to the evidence of
earlier looks, which is all that a look needs of them. Decisions are those of the plan that computes every look at once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.config import Profile
from siftline.operators import adjudicate, aggregate, decision, hits
from siftline.plans import screen
from siftline.tuning import broadcast_if_small, settle, shared_folder

KEYS = ("sample_id", "fragment_key")

def place() -> Column:
    """A sample as a folder name that never reads as a number."""
    return F.concat(F.lit("s-"), F.col("sample_id")).alias("place")


@dataclass(frozen=True)
class Looks:
    """Evaluated calls and outcomes of the looks taken: of each sample, those up to its stop."""

    evaluated: DataFrame
    looks: DataFrame


def _written(df: DataFrame, name: str) -> DataFrame:
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def split_by_round(mappings: DataFrame, sampled: DataFrame, profile: Profile, folder: str) -> None:
    """Write the mappings of sampled fragments below ``folder`` as entry_round=<round>/place=<sample>; fragments without any stay, as one row."""
    mappings, sampled = screen.of_sample(mappings, sampled, profile)
    met = sampled.select(*KEYS, "entry_round").join(mappings, list(KEYS), "left")
    met.select("*", place()).hint("rebalance", "entry_round", "place").write.partitionBy("entry_round", "place").parquet(folder)


def _merged(state: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Reduced evidence of several rounds as that of one."""
    rows = fresh.drop("entry_round") if state is None else state.unionByName(fresh.drop("entry_round"))
    return rows.groupBy("sample_id", "kind", "contig", "pos").agg(F.sum("n").alias("n"), F.max("val").alias("val"))


def look_by_look(
    folder: str, manifest: DataFrame, samples: DataFrame, profile: Profile, sample_controls=None, background=None, reasons: bool = True
) -> Looks:
    """Take the looks of ``folder`` (see :func:`split_by_round`) until every one of ``samples`` (sample_id) has stopped.

    A driver loop over rounds, at most 64 of them; nothing but an emptiness check comes to the driver.
    """
    spark, planned = manifest.sparkSession, profile.sampling.look_count
    classified = hits.usable_contigs(manifest)
    live = _written(samples.select("sample_id").distinct().withColumn("undecided", F.lit(1)), "live")
    state, calls = None, None
    for number in range(1, planned + 1):
        # A comparison, which lets the join prune the folders of samples that have stopped.
        undecided = broadcast_if_small(live.filter("undecided = 1").select("sample_id", place()))
        entered = spark.read.parquet(folder).filter(F.col("entry_round") == number).join(undecided, "place", "left_semi")
        contigs = hits.attach_manifest(hits.aggregate_hits(entered, ("entry_round",)), classified)
        fragments = adjudicate.adjudicate(hits.best_hits(contigs, ("entry_round",)), profile.fragment)
        fresh = aggregate.reduce_evidence(aggregate.fragment_evidence(fragments, "entry_round"))
        kept = None if state is None else state.join(undecided, "sample_id", "left_semi")
        state = _written(_merged(kept, fresh), "evidence")
        look = aggregate.cumulative_rounds(state.withColumn("entry_round", F.lit(1)), 1, undecided.select("sample_id")).withColumn("round", F.lit(number))
        look = _written(aggregate.to_calls(aggregate.aggregate_candidates(look, classified)), "look")
        calls = look if calls is None else calls.unionByName(look)
        judged = screen.evaluated_looks(calls, profile, sample_controls, background, reasons=False)
        outcome = decision.decide(judged, planned, profile.decision).filter(F.col("round") == number)
        live = _written(outcome.select("sample_id", F.col("stop_reason").isNull().cast("int").alias("undecided")), "live")
        if number == planned or not live.filter("undecided = 1").limit(1).count():
            break
    evaluated = settle(screen.evaluated_looks(calls, profile, sample_controls, background, reasons))
    return Looks(evaluated, decision.decide(evaluated, planned, profile.decision))
