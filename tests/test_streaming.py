import shutil
import time

from pyspark.sql import functions as F

from siftline.checks import queries as Q
from siftline.checks.settings import DECISION, FRAGMENT, PROFILE
from siftline.config import Profile, SamplingPlan
from siftline.operators import decision, qc, sampling
from siftline.plans import screen
from siftline.streaming import looks
from siftline.tuning import settle
from siftline import adapters as A

ROUNDS = (200, 400, 800)


def test_drained_stream_equals_batch(spark, sf_dir, tmp_path):
    profile = Profile(
        fragment=FRAGMENT, candidate=PROFILE.candidate, decision=DECISION, sampling=SamplingPlan(mode="streaming", rounds=ROUNDS)
    )
    mappings, manifest = Q.table(spark, sf_dir, A.HITS), Q.table(spark, sf_dir, A.MANIFEST)
    entered = sampling.prefix_entry_round(Q.table(spark, sf_dir, A.HIT_FRAGMENTS), "record_number", ROUNDS)
    batch_calls = screen.look_calls(mappings, manifest, entered, profile)
    expected = decision.decide(screen.evaluated_looks(batch_calls, profile, reasons=False), len(ROUNDS), DECISION)

    classified = Q.classified(spark, sf_dir)
    fragments = screen.fragment_table(mappings, classified, FRAGMENT, entered)
    ordered = entered.select("sample_id", "fragment_key", F.col("rank").alias("sequence"))
    rows = settle(fragments.drop("entry_round").join(ordered, ["sample_id", "fragment_key"]))
    source = tmp_path / "source"
    rows.repartition(6, "fragment_key").write.parquet(str(source))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(source))
    query = looks.start_contributions(stream, profile, str(tmp_path / "rounds"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert len([p for p in (tmp_path / "rounds").iterdir() if p.name.startswith("batch=")]) == 3

    contributions = looks.read_contributions(spark, str(tmp_path / "rounds"))
    got = looks.decide_now(contributions, classified, profile, drained=True)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
    reached = {r.sample_id: r.complete_looks for r in looks.reached_looks(contributions, ROUNDS).collect()}
    held = looks.decide_now(contributions, classified, profile)
    assert held.count() == sum(reached.values())


def raw_reads(spark, sf_dir):
    """Every fragment with reads that follow from its key; one in six is too short, one in seven of one letter."""
    bases = lambda salt: F.substring(F.translate(F.repeat(F.md5(F.concat("fragment_key", F.lit(salt))), 4), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 110)
    h = F.abs(F.xxhash64("fragment_key"))
    broken = lambda seq: F.when(h % 6 == 0, F.substring(seq, 1, 20)).when(h % 7 == 0, F.repeat(F.lit("A"), 110)).otherwise(seq)
    rows = Q.table(spark, sf_dir, A.HIT_FRAGMENTS)
    return rows.select("sample_id", "fragment_key", broken(bases("1")).alias("r1_seq"), bases("2").alias("r2_seq"), F.col("record_number").cast("long").alias("record_number"))


def test_raw_stream_with_replays_equals_batch(spark, sf_dir, tmp_path):
    profile = Profile(qc=PROFILE.qc, fragment=FRAGMENT, candidate=PROFILE.candidate, decision=DECISION, sampling=SamplingPlan(mode="streaming", rounds=ROUNDS))
    mappings, manifest = Q.table(spark, sf_dir, A.HITS), Q.table(spark, sf_dir, A.MANIFEST)
    reads = settle(raw_reads(spark, sf_dir))
    passing = qc.qc_passing(reads, profile.qc)
    assert 0 < passing.count() < reads.count()
    entered = sampling.prefix_entry_round(passing, "record_number", ROUNDS)
    expected = decision.decide(screen.evaluated_looks(screen.look_calls(mappings, manifest, entered, profile), profile, reasons=False), len(ROUNDS), DECISION)

    # Five files in the order of their records, one a batch.
    source, edges = tmp_path / "source", reads.approxQuantile("record_number", [0.1, 0.3, 0.6, 0.8], 0.0)
    for i, (low, high) in enumerate(zip([float("-inf"), *edges], [*edges, float("inf")])):
        part = reads.filter((F.col("record_number") > low) & (F.col("record_number") <= high)).repartition(3).coalesce(1)
        part.write.mode("append").parquet(str(source))
        time.sleep(1.1)
    classified = Q.classified(spark, sf_dir)

    def run():
        stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        looks.start_raw(stream, mappings, classified, profile, str(tmp_path / "live"), str(tmp_path / "checkpoint")).awaitTermination()

    run()
    # The last batch runs again: its commit is lost, and so is what it wrote.
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    assert len(commits) == 5
    for commit in commits[-1:]:
        commit.unlink()
        (commit.parent / f".{commit.name}.crc").unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "live" / "rounds" / "batch=4")
    run()
    contributions = looks.read_contributions(spark, str(tmp_path / "live" / "rounds"))
    got = looks.decide_now(contributions, classified, profile, drained=True)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))
    ledger = {r.sample_id: r.arrived for r in spark.read.parquet(str(tmp_path / "live" / "ledger" / "batch=4")).collect()}
    assert ledger == {r.sample_id: r["count"] for r in passing.groupBy("sample_id").count().collect()}
