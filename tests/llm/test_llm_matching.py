"""SimHash, decontamination and top-k against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from siftline.llm import decontaminate, simhash, topk

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def naive_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(marks):
    """The smallest index that each index reaches."""
    low = list(range(len(marks)))
    again = True
    while again:
        again = False
        for i in range(len(marks)):
            for j in range(len(marks)):
                if bin(marks[i] ^ marks[j]).count("1") <= 4 and low[j] > low[i]:
                    low[j], again = low[i], True
    return low


def test_fingerprint_of_any_text():
    rng = random.Random(1)
    texts = ["", " \t\n", "One", "a b c", "É é É é É", "a a a a a a a", *(" ".join(rng.choices("abC dé", k=rng.randint(1, 60))) for _ in range(200))]
    texts.append(" ".join(f"w{i % 1000}" for i in range(20_000)))
    assert [simhash.fingerprint(t.encode()) for t in texts] == [naive_fingerprint(t) for t in texts]


def test_every_pair_within_the_threshold_meets():
    rng = np.random.default_rng(2)
    code = simhash.blocks()
    for _ in range(300):
        x = rng.integers(0, 2**63, dtype=np.uint64)
        y = x
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            y ^= np.uint64(1) << np.uint64(bit)
        met = False
        for block in code:
            home = block.home(block.value(np.array([x])))[0]
            values = block.value(np.array([y]))
            met |= home in block.guests(values)[1]
        assert met


def test_components_of_chains_and_copies(spark, documents):
    """Chains of near fingerprints, through tiles of any size."""
    rng = random.Random(3)
    base = [f"{rng.choice('abcdefgh')}{rng.randint(0, 40)}" for _ in range(260)]
    rows = [(900 - i, " ".join(base[: 200 + i % 60]), "a") for i in range(120)] + [(i, f"other {i} words here {i * 7} now", "b") for i in range(1000, 1060)]
    rows += [(2000, None, "c"), (2001, "", "c"), (1999, " ", "c")]
    found = {r[0]: (r[1] & (2**64 - 1), r[2]) for r in simhash.clusters(documents(rows), "doc_id", "text").collect()}
    ids = sorted(found)
    texts = {i: t for i, t, _s in rows}
    marks = [naive_fingerprint(texts[i]) for i in ids]
    assert [found[i][0] for i in ids] == marks
    assert [found[i][1] for i in ids] == [ids[j] for j in naive_components(marks)]
    guests = simhash.anchored(spark.createDataFrame([(int(np.int64(np.uint64(m))),) for m in sorted(set(marks))], "fingerprint long"), simhash.blocks())
    links = lambda tiles: {(r.node, r.root) for r in simhash.components(simhash.compared(tiles)).collect()}
    assert links(simhash.tiled(guests)) == links(simhash.tiled(guests, 2, 3))


def test_components_join_long_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in simhash.components(links).collect()} == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100}


def test_dedup_of_odd_rows(documents, odd_rows):
    docs = documents(odd_rows)
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    # Null, empty and blank texts are one group; of it the smallest id stays. Repeated rows count once.
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 4), (False, 5), (True, 0)]
    assert simhash.near_dedup(documents([])).count() == 0


def naive_hits(words, items):
    hit, names = set(), set()
    for name, own in items:
        size = min(10, len(own))
        if not size:
            continue
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                names.add(name)
    return hit, names


@pytest.mark.parametrize("alphabet", [2, 3, 6])
def test_automaton_against_windows(alphabet):
    rng = random.Random(alphabet)
    for _ in range(60):
        word = lambda: b"abcdef"[rng.randrange(alphabet) :][:1]
        items = [(str(n), [word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25]))]) for n in range(5)]
        items.append(("copy", items[0][1]))
        machine = decontaminate.Automaton(items)
        for _ in range(5):
            words = [word() if rng.random() < 0.95 else b"zz" for _ in range(rng.randint(0, 80))]
            hit, numbers = machine.match(words)
            want, names = naive_hits(words, items)
            assert set(np.flatnonzero(hit).tolist()) == want
            assert {machine.names[n] for n in numbers} == names


def test_matches_of_odd_rows_and_many_groups(spark, documents, odd_rows):
    items = spark.createDataFrame([(7, "One two. THREE"), (8, " ".join(f"w{i}" for i in range(40, 90))), (9, None), (10, "..."), (8, "six")], "item_id long, text string")
    docs = documents(odd_rows)
    one = decontaminate.matches(docs, decontaminate.bounded_items(items))
    many = decontaminate.matches(docs, decontaminate.bounded_items(items, most=5))
    rows = sorted(map(repr, one.collect()))
    assert rows == sorted(map(repr, many.collect()))
    got = {r.doc_id: r for r in one.collect() if r.doc_id}
    assert (got[1].n_words, got[1].n_hit, got[1]["items"]) == (5, 3, ["7"])
    assert (got[4].n_words, got[4]["items"]) == (30_000, ["8"]) and (got[2].n_words, got[3].n_words) == (0, 0)
    nothing = decontaminate.bounded_items(items.limit(0))
    assert decontaminate.matches(docs, nothing).filter("n_hit > 0").count() == 0
    assert decontaminate.matches(documents([]), nothing).count() == 0


def test_cut_texts_hold_no_window(spark, documents):
    passage = " ".join(f"p{i}" for i in range(14))
    items = decontaminate.bounded_items(spark.createDataFrame([(1, passage)], "item_id long, text string"))
    around = "Clean words, as many as there need be for the text to stay; and some more of them here."
    docs = documents([(1, f"{around} {passage.upper()}! {around}"), (2, passage), (3, around), (4, None), (5, f"p0 p1 p2 p3 p4 {passage} p5 p6 p7 p8 p9 p10 {around} {around}")])
    left = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert sorted(left) == [1, 3, 4, 5]
    assert left[1].text == f"{around} \n! {around}" and left[1].n_chars == len(left[1].text)
    assert left[3].text == around and left[4].text is None
    assert decontaminate.matches(spark.createDataFrame([tuple(r)[:2] for r in left.values()], "doc_id long, text string"), items).filter("n_hit > 0").count() == 0


def test_groups_of_items_cut_as_one(spark, documents, monkeypatch):
    words = lambda letter, a, b: " ".join(f"{letter}{i}" for i in range(a, b))
    # Each item is a group of its own: 'q' is hit alone in 40%, 'r' in 20% of the first document.
    rows = [("1", words("q", 0, 20)), ("2", words("r", 0, 10)), ("3", words("s", 0, 10))]
    items = spark.createDataFrame(rows, "item_id string, text string")
    one, many = decontaminate.bounded_items(items), decontaminate.bounded_items(items, most=5)
    # The cut of 's' joins the halves of 'q', the cut of which joins the halves of 's'.
    nested = f"{words('s', 0, 5)} {words('q', 0, 5)} {words('s', 0, 10)} {words('q', 5, 12)} {words('s', 5, 10)}"
    docs = documents([
        (1, f"{words('q', 0, 20)} {words('x', 0, 20)} {words('r', 0, 10)}"), (2, f"{nested} {words('x', 0, 60)}"), (3, words("x", 0, 9)), (4, None), (5, "")
    ])
    got = []
    for size in (32 << 20, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size, raising=False)
        got += [sorted((r.doc_id, r.text, r.n_chars) for r in decontaminate.decontaminate(docs, i).collect()) for i in (one, many)]
    assert got[0] == got[1] == got[2] == got[3]
    assert [r[0] for r in got[0]] == [2, 3, 4, 5] and got[0][0][1].split() == words("x", 0, 60).split()


def test_item_files_are_bounded_in_bytes(spark, documents):
    rows = [(n, f"{'long' * 500}{n} tail") for n in range(8)] + [(8, "?! " * 5000), (9, None)]
    items = decontaminate.bounded_items(spark.createDataFrame(rows, "item_id long, text string"), most_bytes=5000)
    sizes = [[len(w) for w in spark.read.parquet(f).toPandas()["words"]] for f in items.files]
    assert sum(map(len, sizes)) == 8 and len(sizes) >= 4 and max(map(sum, sizes)) <= 5000
    docs = documents([(n, f"so {text}") for n, text in rows])
    found = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.matches(docs, items).collect()}
    assert found == {n: (2, [str(n)]) for n in range(8)} | {8: (0, []), 9: (0, [])}
    # However many groups there are, a task runs one worker with one automaton.
    plan = decontaminate.matches(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def naive_top(rows, asked, k):
    out = []
    for q, v in asked:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_with_ties_and_blocks(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(topk, "BLOCK_VALUES", 64 * 6)  # many blocks
    rows = [(i, [rng.randint(-3, 3) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, [1, 1, 1, 1, 1, 1]) for i in range(60)]  # one common vector
    rows += [(2000, [2**30] * 6), (2001, [-(2**30)] * 6), (3000, [1, 2]), (3001, [2, 1]), (4000, [])]
    frame = spark.createDataFrame(rows + [(None, [1, 1]), (5, None)], "id long, v array<long>")
    found = topk.top_k(frame, frame.filter("id % 20 = 0"), 7)
    assert sorted(map(tuple, found.collect())) == naive_top(rows, [r for r in rows if r[0] % 20 == 0], 7)


def test_scores_beyond_long_are_errors(spark):
    big = spark.createDataFrame([(20, [2**40, 2**40]), (1, [2**40, 1])], "id long, v array<long>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(big, big.filter("id = 20"), 3).collect()
    with pytest.raises(Exception, match="beyond 64 bits"):
        spark.createDataFrame([([1e300],)], "x array<double>").select(topk.quantised(F.col("x"))).collect()


def test_cells_of_a_slice_and_of_a_block():
    """Phase one lists what a slice alone knows; blocks send on what has a sufficient slice and reaches the cutoff."""
    values = pa.array([[1, 2], [3, 0], [0, 2], None], pa.list_(pa.int64()))
    table = pa.table({
        "side": [0, 1, 1, 2], "slice": pa.array([1] * 4, pa.int32()), "id": [7, None, None, 7], "key": [70, None, None, 70], "vec": [None, 1, 2, 2],
        "cutoff": [4, None, None, None], "values": values, "first": [None, 7, 5, None], "second": pa.array([None, 9, None, None], pa.int64()),
    })
    rows = lambda out: list(zip(*(out.column(c).to_pylist() for c in ("id", "vec", "slice", "part"))))
    assert sorted(rows(topk.listed(5)(table))) == [(7, 1, 1, 3), (7, 2, 1, 4)] and rows(topk.listed(1)(table)) == [(7, 2, 1, 4)]
    assert rows(topk.answered(table)) == [(7, 2, 1, 4)] == rows(topk.collected(5)(table))
    lower = table.set_column(5, "cutoff", pa.array([3, None, None, None]))
    assert [r[1] for r in rows(topk.collected(5)(lower))] == [2, 1] and [r[1] for r in rows(topk.collected(1)(lower))] == [2]
    alone = lower.set_column(8, "second", pa.nulls(4, pa.int64()))
    assert [r[1] for r in rows(topk.collected(5)(alone))] == [2]


def test_top_k_of_repeated_and_missing_rows(spark):
    rows = [(20, [1, 0]), (1, [3, 0]), (1, [3, 0]), (2, [2, 5])]
    frame = spark.createDataFrame(rows, "id long, v array<long>")
    found = sorted(map(tuple, topk.top_k(frame, frame.filter("id = 20"), 5).collect()))
    assert found == [(20, 1, 1, 3), (20, 2, 1, 3), (20, 3, 2, 2)]
    assert topk.top_k(frame.limit(0), frame, 5).count() == 0 and topk.top_k(frame, frame.limit(0), 5).count() == 0
    values = spark.createDataFrame([([0.5, None],), ([float("nan"), 0.0],), ([float("inf")],), (None,), ([-0.01, 0.99],)], "x array<float>")
    assert [r[0] for r in values.select(topk.quantised(F.col("x"))).collect()] == [None, None, None, None, [-1, 63]]
