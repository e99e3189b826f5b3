import ast
import hashlib
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.config import SamplingPlan
from siftline.functions.siphash import siphash
from siftline.operators import sampling


def keys(spark, counts):
    rows = [(sample, f"{sample}-{i}", i) for sample, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "sample_id STRING, fragment_key STRING, record_number BIGINT")


def brute(sample, n, seed):
    ranked = sorted((hashlib.md5(f"{seed}:{sample}-{i}".encode()).hexdigest(), f"{sample}-{i}") for i in range(n))
    return [key for _, key in ranked]


def test_bottom_k_matches_brute_force_and_ignores_input_order(spark):
    # One sample holds most of the rows.
    rows = keys(spark, {"big": 3000, "small": 40})
    for frame in (rows, rows.orderBy(F.desc("fragment_key")).repartition(5)):
        got = sampling.representative_sample(frame, 7, 100).orderBy("sample_id", "rank").collect()
        assert [r.fragment_key for r in got if r.sample_id == "big"] == brute("big", 3000, 7)[:100]
        assert [r.fragment_key for r in got if r.sample_id == "small"] == brute("small", 40, 7)


def test_rounds_are_nested_and_exact(spark):
    plan = SamplingPlan(seed=3, rounds=(10, 50, 500))
    got = sampling.entry_round(keys(spark, {"a": 200}), plan)
    assert {r.entry_round: r.n for r in got.groupBy("entry_round").agg(F.count("*").alias("n")).collect()} == {1: 10, 2: 40, 3: 150}
    first = {r.fragment_key for r in got.filter("entry_round = 1").collect()}
    assert first == set(brute("a", 200, 3)[:10])


def test_seed_changes_the_sample(spark):
    rows = keys(spark, {"a": 300})
    pick = lambda seed: {r.fragment_key for r in sampling.representative_sample(rows, seed, 30).collect()}
    assert pick(1) != pick(2)


def test_entry_round_with_duplicate_and_zero_prefixes(spark):
    sizes = F.array(*map(F.lit, [0, 10, 10, 25]))
    rows = spark.createDataFrame([(r,) for r in (0, 9, 10, 25)], "rank BIGINT")
    got = [r[0] for r in rows.select(sampling.first_covering_round(F.col("rank"), sizes)).collect()]
    assert got == [2, 2, 4, 0]


@pytest.mark.parametrize(
    "shares,n,override,expected,warnings",
    [
        ((0.25, 0.5, 1.0), 9_999, False, [9_999] * 3, 1),
        ((0.1, 0.75), 20_000_001, False, [2_000_000, 10_000_000], 1),
        ((0.01, 0.5), 20_000, False, [10_000, 10_000], 1),
        ((0.0001, 1.0), 20_000_001, True, [2_000, 20_000_001], 2),
    ],
)
def test_proportional_rounds(spark, shares, n, override, expected, warnings):
    totals = spark.createDataFrame([("s", n)], "sample_id STRING, qc_passing_fragments BIGINT")
    rows = sampling.resolve_rounds(totals, shares, override).orderBy("round").collect()
    assert [r.effective_count for r in rows] == expected
    assert sum(r.warning_kind is not None for r in rows) == warnings
    report = sampling.round_plan_report(sampling.resolve_rounds(totals, shares, override)).first()
    assert report.effective_counts == expected and len(report.warnings) == warnings


def test_proportional_sampling_keeps_small_samples_whole(spark):
    plan = SamplingPlan(proportions=(0.25, 1.0))
    got = sampling.entry_round(keys(spark, {"a": 120}), plan)
    assert got.filter("entry_round = 1").count() == 120


def test_input_order_prefix_spans_buckets(spark):
    rows = keys(spark, {"a": 500}).withColumn("record_number", F.col("record_number") * 1000)
    got = sampling.first_n(rows, "record_number", 123).orderBy("rank").collect()
    assert [r.record_number for r in got] == [i * 1000 for i in range(123)]


def test_qc_baseline_promotes_maxima(spark):
    columns = "sample_id STRING, round INT, total_fragments BIGINT, passed_fragments BIGINT, low_complexity_filtered BIGINT, n_content_filtered BIGINT, length_filtered BIGINT, pair_incomplete BIGINT"
    looks = spark.createDataFrame([("s", 1, 10, 8, 1, 0, 1, 0), ("s", 2, 20, 7, 3, 0, 1, 0), ("s", 3, 15, 9, 0, 0, 0, 0)], columns)
    rows = sampling.qc_baseline(looks).orderBy("round").collect()
    assert [r.total_fragments for r in rows] == [10, 20, 20]
    assert [r.passed_fragments for r in rows] == [8, 8, 9]
    assert [r.total_shrank for r in rows] == [False, False, True]


def test_plans_are_validated():
    for bad in ({"rounds": (5, 5)}, {"rounds": (0, 5)}, {"proportions": (0.5, 1.2)}, {}, {"rounds": (1,), "proportions": (0.5,)}):
        with pytest.raises(ValueError):
            SamplingPlan(**bad)
    with pytest.raises(ValueError):
        SamplingPlan.resolve(rounds=(1,), proportions=(0.5,))
    assert SamplingPlan.resolve(proportions=("25%", "50%", "100%")).proportions == (0.25, 0.5, 1.0)
    assert SamplingPlan.resolve(profile_rounds=(1, 2, 3), max_rounds=2).rounds == (1, 2)


def test_siphash_vectors():
    """The published vectors of SipHash-2-4, and the first of 1-3, under the key 0, 1, ... 15."""
    keys = tuple(int.from_bytes(bytes(range(8 * i, 8 * i + 8)), "little") for i in range(2))
    texts = pa.array([bytes(range(n)) for n in range(16)], pa.binary())
    found = siphash(texts, keys=keys, c=2, d=4)
    assert int(found[0]) == 0x726FDB47DD0E0E31 and int(found[15]) == 0xA129CA6149BE45E5
    assert siphash(texts, keys=keys)[0].tobytes().hex() == "dcc40f055801acab"
    assert len(siphash(texts.slice(0, 0))) == 0 and (siphash(texts.slice(3, 5)) == siphash(texts)[3:8]).all()


def test_siphash_ranks_are_the_interpreters(spark):
    """Python hashes bytes by SipHash-1-3; hash seed 0 is the zero key."""
    seed, names = 77, ["", "a", "abcdefg", "abcdefgh", "é\U0001f600" * 9, *(f"frag-{i}" for i in range(50)), "x" * 1000]
    code = "import sys; assert sys.hash_info.algorithm == 'siphash13'; print([hash(bytes.fromhex(x)) for x in sys.argv[1:]])"
    texts = [(seed.to_bytes(8, "little") + n.encode()).hex() for n in names]
    out = subprocess.run([sys.executable, "-c", code, *texts], env={"PYTHONHASHSEED": "0"}, capture_output=True, check=True, text=True).stdout
    want = {n: f"{h % (1 << 64):016x}" for n, h in zip(names, ast.literal_eval(out))}
    frame = spark.createDataFrame([(n,) for n in names] + [(None,)], "k string")
    got = {r.k: r.h for r in frame.select("k", sampling.rank_key(seed, F.col("k"), "siphash13").alias("h")).collect()}
    assert got == {**want, None: None}
    rows = spark.createDataFrame([("s", n, i) for i, n in enumerate(names)], "sample_id STRING, fragment_key STRING, record_number BIGINT")
    plan = SamplingPlan(seed=seed, rounds=(5, 20), hash="siphash13")
    ranked = sorted(names, key=lambda n: (want[n], n))
    entered = sampling.entry_round(rows, plan).orderBy("rank").collect()
    assert [r.fragment_key for r in entered] == ranked[:20] and sum(r.entry_round == 1 for r in entered) == 5
    assert sampling.within_sample(rows, sampling.entry_round(rows, plan), seed, "siphash13").count() == 20
    with pytest.raises(ValueError):
        SamplingPlan(rounds=(1,), hash="other")
