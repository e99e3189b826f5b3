import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftline import adapters as A
from siftline.config import QcConfig
from siftline.functions import sequence, text
from siftline.operators import qc
from siftline.schema import FRAGMENTS

GOOD = ("ACGGTCATTGCAAGCT" * 10)[:150]


def frame(spark, pairs):
    rows = [("s", f"f{i}", a, "", b, "") for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, FRAGMENTS)


def test_bucket_counts(spark):
    pairs = [(GOOD, GOOD), (GOOD, ""), (GOOD[:99], GOOD), ("N" * 40 + GOOD[40:], GOOD), ("A" * 150, GOOD)]
    row = qc.qc_stats(qc.qc_verdict(frame(spark, pairs))).first()
    assert tuple(row)[1:] == (5, 1, 1, 1, 1, 1)


def test_first_failure_wins(spark):
    pairs = [
        ("", ""),
        ("A" * 10, ""),
        (GOOD, None),
        (GOOD, "A" * 99),
        ("N" * 100, "A" * 100),
        (GOOD, "A" * 100),
        ("ACACACACAC" * 10, "A" * 100),
        ("at" * 75, "A" * 100),
    ]
    got = [(r.reason, r.mate) for r in qc.qc_verdict(frame(spark, pairs)).orderBy("fragment_key").select("qc.*").collect()]
    assert got == [
        ("pair_incomplete", 1),
        ("length", 1),
        ("pair_incomplete", 2),
        ("length", 2),
        ("n_content", 0),
        ("low_complexity", 2),
        ("low_complexity", 1),
        ("low_complexity", 1),
    ]


def test_unpaired_reads_pass_when_pairs_are_not_required(spark):
    cfg = QcConfig(require_pair=False)
    rows = frame(spark, [(GOOD, None), (GOOD, "")])
    reasons = [r.reason for r in qc.qc_verdict(rows, cfg).orderBy("fragment_key").select("qc.reason").collect()]
    assert reasons == ["pass", "length"]
    assert qc.qc_passing(rows, cfg).count() == 1


def test_pass_filter_agrees_with_the_verdict(spark):
    pairs = [(GOOD, GOOD), ("at" * 75, GOOD), (GOOD, "c" * 120), ("N" * 60 + GOOD[60:], GOOD), (GOOD[:100], GOOD[:250])]
    rows = frame(spark, pairs)
    verdict = {r.fragment_key for r in qc.qc_verdict(rows).filter("qc.reason = 'pass'").collect()}
    assert {r.fragment_key for r in qc.qc_passing(rows).collect()} == verdict


def brute_entropy(seq):
    pairs = [seq[i : i + 2].upper() for i in range(len(seq) - 1)]
    counts = Counter(p for p in pairs if set(p) <= set("ACGT"))
    total = sum(counts.values())
    return -sum(c / total * math.log2(c / total) for c in counts.values()) if total else 0.0


@pytest.mark.parametrize("seq", ["", "A", "AT" * 75, "AAAA", "ACGT", "AANNA", "aAxTTTg", "GGGGGCGGGGG", "TTTT.TTAAT", GOOD])
def test_entropy_matches_brute_force(spark, seq):
    row = spark.createDataFrame([(seq,)], "s STRING").select(
        sequence.entropy_2mer(F.col("s")).alias("bits"), sequence.fast_low_complexity(F.col("s")).alias("fast")
    ).first()
    assert row.bits == pytest.approx(brute_entropy(seq), abs=1e-12)
    if row.fast is not None:
        assert row.fast == pytest.approx(brute_entropy(seq), abs=1e-12)


def test_alternation_is_below_one_bit(spark):
    bits = spark.createDataFrame([("AT" * 75,)], "s STRING").select(sequence.fast_low_complexity(F.col("s"))).first()[0]
    assert 0.999 < bits < 1.0


def test_read_names_and_qualities(spark):
    rows = spark.createDataFrame([("r1/1 x",), ("r1/2",), ("a/1/2",), ("  r7 y",), ("r/3",)], "q STRING")
    assert [r[0] for r in rows.select(text.normalize_qname(F.col("q"))).collect()] == ["r1", "r1", "a/1", "r7", "r/3"]
    scores = spark.createDataFrame([("!I~",), (" I",), ("",)], "q STRING").select(text.decode_phred(F.col("q")))
    assert [r[0] for r in scores.collect()] == [[0, 40, 93], None, []]
    names = spark.createDataFrame([("/x/S1_R1.fastq.gz",), ("b_2.fq",), ("c.bam",), ("_R1.fq",)], "p STRING")
    assert [r[0] for r in names.select(text.sample_name(F.col("p"))).collect()] == ["S1", "b", "c", "sample"]


def test_config_is_validated():
    with pytest.raises(ValueError):
        QcConfig(min_read_length=0)
    with pytest.raises(ValueError):
        QcConfig(max_n_fraction=1.5)


def test_windows_of_texts_are_cut_once_and_as_spelled(spark, tmp_path):
    """Windows by the adapter's own words, on texts of odd lengths; no filter spells a read out more than once."""
    texts = ["", None, "a", "ab" * 75, "x" * 300, "é\U0001f600\n" * 100 + "z", "a c\n\n" * 60 + "\U0001f600" * 150, "m" * 1201]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id bigint, source string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = A.spark_sql(spark, str(tmp_path), A.FRAGMENTS)
    spelled = A.FRAGMENTS.replace("{explode}", "explode").replace("{upto}", "sequence").replace("//", "DIV")
    want = spark.sql(spelled, documents=docs)
    assert got.schema == want.schema and want.count() == 14
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    for frame in (got, qc.qc_passing(got)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("substr") <= 4 and max(line.count("translate(") for line in plan.splitlines()) <= 2
