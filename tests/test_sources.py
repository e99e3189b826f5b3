import gzip
import json

import pytest
from pyspark.sql import functions as F

from siftline.operators import panel
from siftline.schema import MATE_RECORDS
from siftline.sources import documents, fasta, fastq, sinks
from siftline.sources.lines import numbered_lines


def fastq_text(names, mate, seq="ACGT"):
    return "".join(f"@{n}/{mate} lane\n{seq}\n+\nIIII\n" for n in names)


def test_fastq_pairs(spark, tmp_path):
    (tmp_path / "s1_R1.fastq").write_text(fastq_text(["a", "b"], 1) + "\n")
    (tmp_path / "s1_R2.fastq").write_text(fastq_text(["a", "b"], 2, "GGGG"))
    with gzip.open(tmp_path / "s2_R1.fastq.gz", "wt") as f:
        f.write(fastq_text(["c", "d", "e"], 1))
    with gzip.open(tmp_path / "s2_R2.fastq.gz", "wt") as f:
        f.write(fastq_text(["c", "x"], 2))
    r1 = [str(tmp_path / "s1_R1.fastq"), str(tmp_path / "s2_R1.fastq.gz")]
    r2 = [str(tmp_path / "s1_R2.fastq"), str(tmp_path / "s2_R2.fastq.gz")]
    fragments, rejects = fastq.read_fastq_pairs(spark, r1, r2)
    got = sorted((r.sample_id, r.fragment_key, r.r1_seq, r.r2_seq) for r in fragments.collect())
    assert got == [("s1", "a", "ACGT", "GGGG"), ("s1", "b", "ACGT", "GGGG"), ("s2", "c", "ACGT", "ACGT")]
    assert sorted((r.sample_id, r.ordinal, r.problem) for r in rejects.collect()) == [("s2", 1, "key_mismatch"), ("s2", 2, "orphan_r1")]


def test_standard_names_and_equal_names_in_two_folders(spark, tmp_path):
    """Files pair by place: lanes of one sample, and files of one name in two folders, keep all reads."""
    lists = {1: [], 2: []}
    for lane in ("x", "y"):
        (tmp_path / lane).mkdir()
        for mate in (1, 2):
            path = tmp_path / lane / f"S1_L001_R{mate}_001.fastq"
            path.write_text(fastq_text([f"{lane}1", f"{lane}2"], mate))
            lists[mate].append(str(path))
    fragments, rejects = fastq.read_fastq_pairs(spark, lists[1], lists[2])
    rows = fragments.orderBy("record_number").collect()
    assert [r.fragment_key for r in rows] == ["x1", "x2", "y1", "y2"] and rejects.count() == 0
    assert len({(r.sample_id, r.record_number) for r in rows}) == 4 and len({r.sample_id for r in rows}) == 1
    with pytest.raises(ValueError):
        fastq.read_fastq_pairs(spark, lists[1], lists[2][:1])


def test_blank_records(spark, tmp_path):
    """Blank lines at the end are nothing; a blank record before other records is a reject, one with bases is malformed."""
    for mate in (1, 2):
        (tmp_path / f"b_R{mate}.fq").write_text(fastq_text(["a"], mate) + "\n\n\n\n" + f"\nACGT\n+\nIIII\n" + fastq_text(["c"], mate) + "\n\n\n\n\n\n")
    fragments, rejects = fastq.read_fastq_pairs(spark, str(tmp_path / "b_R1.fq"), str(tmp_path / "b_R2.fq"))
    assert sorted(r.fragment_key for r in fragments.collect()) == ["a", "c"]
    assert sorted((r.ordinal, r.problem) for r in rejects.collect()) == [(1, "blank"), (2, "malformed")]


def test_malformed_fastq(spark, tmp_path):
    (tmp_path / "m_R1.fq").write_text("@a/1\nACGT\n+\nIII\n")
    (tmp_path / "m_R2.fq").write_text("@a/2\nACGT\n+\nIIII\n")
    fragments, rejects = fastq.read_fastq_pairs(spark, str(tmp_path / "m_R1.fq"), str(tmp_path / "m_R2.fq"))
    assert fragments.count() == 0 and rejects.first().problem == "malformed"


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    path = tmp_path / "many.txt"
    path.write_text("".join(f"{i}{'>' if i % 7 == 0 else ''}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = numbered_lines(spark, str(path), flag=lambda line: line.endswith(">")).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.line_no for r in rows] == list(range(5000))
    assert all(int(r.line.rstrip(">")) == r.line_no for r in rows)
    assert all(r.flags_through == r.line_no // 7 + 1 for r in rows)


def test_input_kinds():
    assert fastq.input_kind(["a.fq", "b.fastq.gz"]) == "fastq_pair"
    assert fastq.input_kind(["x.bam"]) == "records"
    for bad in ([], ["a.fq"], ["a.bam", "b.bam"], ["a.fq", "b.fq", "c.fq"]):
        with pytest.raises(ValueError):
            fastq.input_kind(bad)


def test_mate_pairing(spark):
    rows = [
        ("s", 1, "a/1", 128, "A1", "q"), ("s", 2, "a/2", 64, "A2", "q"),
        ("s", 3, "b", 0, "B1", "q"), ("s", 4, "b", 0, "B2", "q"),
        ("s", 5, "c", 64, "C", "q"), ("s", 6, "d", 128, "D", "q"),
        ("s", 7, "e", 64, "E", "q"),
    ]
    fragments, rejects = fastq.pair_mates(spark.createDataFrame(rows, MATE_RECORDS))
    assert sorted((r.fragment_key, r.r1_seq, r.r2_seq) for r in fragments.collect()) == [("a", "A2", "A1"), ("b", "B1", "B2")]
    assert sorted((r.record_number, r.problem) for r in rejects.collect()) == [(5, "key_mismatch"), (7, "orphan")]
    with pytest.raises(ValueError):
        fastq.pair_mates(spark.createDataFrame(rows, MATE_RECORDS), sort_order="coordinate")


def test_fasta(spark, tmp_path):
    path = tmp_path / "p.fa"
    path.write_text("AC\n>\nAC\n>k1 some name\n ACGT \n\nAC\n>k2\n>k3 AC:ZZ9 x\nGG\n")
    contigs, rejects = fasta.read_fasta(spark, str(path), "host", with_sequence=True)
    assert sorted((r.header, r.genome_length, r.sequence) for r in contigs.collect()) == [
        ("k1 some name", 6, "ACGTAC"),
        ("k3 AC:ZZ9 x", 2, "GG"),
    ]
    assert sorted(r.problem for r in rejects.collect()) == ["empty_header", "empty_sequence", "leading_sequence"]
    rows = {r.contig: r for r in panel.manifest_rows(contigs, panel.HOST).collect()}
    assert (rows["k1"].accession, rows["k3"].accession, rows["k3"].taxid) == ("k1", "ZZ9", 9606)


def test_json_documents(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"contig": "c", "accession": "a", "taxid": 1, "virus_name": "v", "segment": None, "group": "g", "genome_length": 5, "source_release": "r", "source_type": "virus", "masked_regions": [[1, 2]]}]))
    row = documents.read_manifest(spark, str(tmp_path / "m.json")).first()
    assert (row.contig, row.segment, row.masked_regions) == ("c", None, [[1, 2]])
    (tmp_path / "n.json").write_text(json.dumps({"control_id": "n1", "control_status": "pass", "candidates": [{"accession_or_group": "a", "unique_fraction": 0.1}, {"accession_or_group": "", "unique_fraction": 0.1}, {"accession_or_group": "b", "unique_fraction": -1}]}))
    controls, candidates, rejects = documents.read_negative_controls(spark, str(tmp_path / "n.json"))
    assert controls.count() == 1 and candidates.count() == 1
    assert sorted(r.problem for r in rejects.collect()) == ["empty_candidate", "invalid_fraction"]
    (tmp_path / "b.json").write_text(json.dumps({"datasets": [{"dataset_id": "d", "input": ["x"], "expected_outcome": "negative"}, {"dataset_id": "e", "input": [], "expected_outcome": "spike_in"}, {"dataset_id": "f", "input": ["x"], "expected_outcome": "negative"}, {"dataset_id": "f", "input": ["x"], "expected_outcome": "negative"}]}))
    good, bad = documents.read_benchmark_manifest(spark, str(tmp_path / "b.json"))
    assert [r.dataset_id for r in good.collect()] == ["d"]
    assert sorted(r.problem for r in bad.collect()) == ["duplicate_dataset_id", "duplicate_dataset_id", "no_input"]
    (tmp_path / "e.json").write_text(json.dumps({"datasets": []}))
    assert documents.read_benchmark_manifest(spark, str(tmp_path / "e.json"))[1].first().problem == "no_datasets"


def test_checksum_inventory_of_files(spark, tmp_path):
    import hashlib

    (tmp_path / "audit").mkdir()
    (tmp_path / "a b.txt").write_text("x")
    (tmp_path / "audit" / "checksum.sha256").write_text("ignored")
    rows = sinks.checksum_inventory(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].sha256 == hashlib.sha256(b"x").hexdigest()


def test_records_cut_by_splits(spark, tmp_path):
    """Splits of a few lines, qualities that begin like a header, and bare carriage."""
    n = 3_000
    names = [f"f{i}" for i in range(n)]
    for mate in (1, 2):
        lines = [f"@{name}/{mate}\n{'ACGTN'[: 1 + i % 5] * 3}\n+\n{'@+I>~'[: 1 + i % 5] * 3}\n" for i, name in enumerate(names)]
        (tmp_path / f"c_R{mate}.fq").write_text("".join(lines))
    kept = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for split, rows in (("997", "10000"), ("50001", "7"), ("128m", "3")):
            for key, value in zip(kept, (split, "1", rows)):
                spark.conf.set(key, value)
            fragments, rejects = fastq.read_fastq_pairs(spark, str(tmp_path / "c_R1.fq"), str(tmp_path / "c_R2.fq"))
            rows = fragments.orderBy("record_number").collect()
            assert [r.fragment_key for r in rows] == names and rejects.count() == 0
            assert all(r.r1_qual == "@+I>~"[: 1 + i % 5] * 3 and r.r2_seq == "ACGTN"[: 1 + i % 5] * 3 for i, r in enumerate(rows))
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
