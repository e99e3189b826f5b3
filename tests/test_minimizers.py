"""Minimizers, chains and placement."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline import adapters as A
from siftline.checks import queries as Q
from siftline.functions import sequence
from siftline.operators import hits, minimizers

SWAP = str.maketrans("ACGT", "TGCA")


def naive_minimizers(text, k, w):
    """Places of each window's smallest k-mer, the first of equals."""
    text, marks = text.upper(), {}
    for i in range(len(text) - k + 1):
        mer = text[i : i + k]
        other = mer[::-1].translate(SWAP)
        if set(mer) <= set("ACGT") and mer != other:
            value = np.array([int("".join(str("ACGT".index(c)) for c in min(mer, other)), 4)], np.uint64)
            marks[i] = int(minimizers._mixed(value)[0]) >> 1, mer < other
    found, n = set(), len(text) - k + 1
    for i in range(max(n - w + 1, 1) if n > 0 else 0):
        inside = [j for j in range(i, min(i + w, n)) if j in marks]
        if inside:
            found.add(min(inside, key=lambda j: (marks[j][0], j)))
    return sorted((j, marks[j][1]) for j in found)


def test_minimizers_are_brute_force():
    rng = random.Random(31)
    texts = ["", "ACG", "NNNNNNNNNN", "acgtacgtacgtacgt", "A" * 40, *("".join(rng.choices("ACGTacgtN", weights=[9] * 8 + [1], k=rng.randint(0, 120))) for _ in range(200))]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    for k, w in ((5, 4), (7, 1), (4, 9)):
        row, place, _seed, ahead = minimizers.minimizers(data, ends - [len(t) for t in texts], ends, k, w)
        got = [[] for _ in texts]
        for r, p, a in zip(row.tolist(), place.tolist(), ahead.tolist()):
            got[r].append((p, a))
        assert got == [naive_minimizers(t, k, w) for t in texts]


def test_chains_are_brute_force():
    rng = random.Random(32)
    for _ in range(300):
        spots = sorted((rng.randint(0, 500), rng.randint(0, 140)) for _ in range(rng.randint(1, 25)))
        contig, read = (np.array([s[i] for s in spots]) for i in range(2))
        best = [0] * len(spots)
        for i, (c, r) in enumerate(spots):
            best[i] = 15
            for j, (d, q) in enumerate(spots[:i]):
                if 0 < r - q <= minimizers.GAP and 0 < c - d <= minimizers.GAP and abs(r - q - c + d) <= minimizers.DRIFT:
                    best[i] = max(best[i], best[j] + min(r - q, 15))
        assert minimizers.best_chain(read, contig, 15)[0] == max(best)


def test_reads_of_both_strands_find_their_place(spark):
    rng = random.Random(33)
    letters = lambda n: "".join(rng.choices("ACGT", k=n))
    repeat = letters(60)
    panel = {f"c{i}": letters(3_000) for i in range(6)} | {"long": letters(20_000)}
    panel |= {f"r{i}": letters(200) + repeat + letters(200) for i in range(40)}
    rows, want = [], {}
    for i in range(60):
        contig = rng.choice([c for c in panel if c[0] != "r"])
        at = rng.randint(0, len(panel[contig]) - 150)
        read, back = panel[contig][at : at + 150], rng.random() < 0.5
        rows.append(("s", f"f{i}", read[::-1].translate(SWAP) if back else read, None))
        want[f"f{i}"] = contig, "-" if back else "+", at
    rows += [("s", "repeat", repeat + letters(90), letters(150)), ("s", "none", None, "")]
    reads = spark.createDataFrame(rows, "sample_id string, fragment_key string, r1_seq string, r2_seq string")
    contigs = spark.createDataFrame(list(panel.items()), "contig string, sequence string")
    for crowd in (1_000, 7):
        found = minimizers.minimizer_hits(reads, contigs, crowd=crowd).collect()
        for r in found:
            if r.fragment_key != "repeat":
                contig, strand, at = want[r.fragment_key]
                assert (r.contig, r.strand) == (contig, strand) and at <= r.target_start <= r.target_end <= at + 150 and r.target_end - r.target_start > 100
        assert {r.fragment_key for r in found} == {*want, "repeat"}
        repeats = [r for r in found if r.fragment_key == "repeat"]
        assert len(repeats) == 40 and {r.mapq for r in repeats} == {1} and sum(r.is_primary for r in repeats) == 1


def test_recall_against_all_seeds(spark, sf_dir):
    """Placements of the form in which all seeds vote, of reads with 3 % of wrong bases and of the given table's."""
    rng = random.Random(34)
    panel = {f"c{i}": "".join(rng.choices("ACGT", k=5_000)) for i in range(20)}
    rows = []
    for i in range(400):
        contig = rng.choice(list(panel))
        at = rng.randint(0, 4_800)
        mates = ("".join(rng.choice("ACGT") if rng.random() < 0.04 else c for c in panel[contig][at + m * 60 : at + m * 60 + 120]) for m in (0, 1))
        rows.append(("s", f"f{i}", *mates))
    reads = spark.createDataFrame(rows, "sample_id string, fragment_key string, r1_seq string, r2_seq string")
    contigs = spark.createDataFrame(list(panel.items()), "contig string, sequence string")
    places = ["sample_id", "fragment_key", "mate", "contig", "strand"]
    for r, c, least in ((reads, contigs, 2), (Q.table(spark, sf_dir, A.SEED_FRAGMENTS), Q.table(spark, sf_dir, A.SEED_PANEL), 2 * minimizers.WINDOW + 1)):
        exact = hits.seed_vote_hits(r, c, 16, 2, 16).filter(F.col("as_score") >= least).select(*places).distinct()
        found = minimizers.minimizer_hits(r, c).select(*places)
        total = exact.count()
        recall = exact.join(found, places, "left_semi").count() / total
        assert total and recall >= 0.9, (total, recall)


def test_kmers_as_longs_vote_as_texts_do(spark, monkeypatch):
    """Codes against a count by hand; the same votes by long and by text keys; reads are taken into seeds once."""
    texts = ["", None, "acgTNacg", "ACé\U0001f600GGTAC", "AC", "T" * 40]
    frame = spark.createDataFrame([(t,) for t in texts], "seq string")
    for reverse in (False, True):
        got = [r[0] for r in frame.select(sequence.kmer_codes(F.col("seq"), 3, reverse)).collect()]
        for t, codes in zip(texts, got):
            mers = [t[i : i + 3].upper() for i in range(len(t) - 2)] if t else []
            mers = [m if set(m) <= set("ACGT") else None for m in mers]
            if reverse:
                mers = [m and m[::-1].translate(str.maketrans("ACGT", "TGCA")) for m in mers]
            assert (codes or []) == [m and sum("ACGT".index(c) << 2 * (2 - i) for i, c in enumerate(m)) for m in mers]
    with pytest.raises(ValueError):
        sequence.kmer_codes(F.col("seq"), 32)
    rng = random.Random(5)
    contig = "".join(rng.choices("ACGT", k=1_500))
    flip = contig[700:820][::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = [("s", "a", contig[500:620].lower(), flip), ("s", "b", contig[20:90] + "N" + contig[91:140], None), ("s", "c", "é" + contig[1380:1500], "")]
    fragments = spark.createDataFrame(reads, "sample_id string, fragment_key string, r1_seq string, r2_seq string")
    panel = spark.createDataFrame([("x", contig), ("y", contig[400:900] + "N" * 30)], "contig string, sequence string")
    for k in (16, 31, 40):
        long = hits.seed_vote_hits(fragments, panel, k)
        assert long._jdf.queryExecution().optimizedPlan().toString().count("r1_seq") <= 4
        with monkeypatch.context() as patched:
            patched.setattr(hits, "LONGEST_CODE", 0)
            short = hits.seed_vote_hits(fragments, panel, k).collect()
        assert sorted(map(str, long.collect())) == sorted(map(str, short)) and {r.fragment_key for r in short} == {"a", "b", "c"}
