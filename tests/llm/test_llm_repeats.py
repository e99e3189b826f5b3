"""Periodic runs, substring dedup and the Merkle manifest."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from siftline.llm import merkle, periodic, substrings
from siftline.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def naive_runs(words, least, repeats):
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, repeats * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def test_runs_are_brute_force():
    rng = random.Random(11)
    texts = [[], [b"a"], [b"a"] * 24, [b"a"] * 23, [b"a", b"b"] * 400]
    for _ in range(400):
        words = []
        for _ in range(rng.randint(1, 6)):
            unit = [b"%d" % rng.randint(0, rng.choice((1, 3, 40))) for _ in range(rng.randint(1, 14))]
            words += unit * rng.choice((1, 1, 2, 3, 5, 12)) + unit[: rng.randint(0, len(unit))]
        texts.append(words)
    for least, repeats in ((24, 3), (1, 3), (10, 4), (5, 3)):
        got = periodic.runs_of(texts, least, repeats)
        assert [list(map(tuple, g.tolist())) for g in got] == [naive_runs(w, least, repeats) for w in texts]
    assert sum(map(len, periodic.runs_of(texts))) > 100


def test_splitting_to_stability():
    rng = random.Random(12)
    for _ in range(200):
        words = [rng.randint(0, 12) for _ in range(rng.randint(0, 200))]
        codes = np.array(words, np.int64)

        def split(a, b):
            if b - a < 6:
                return []
            rare = [i for i in range(a, b) if words[a:b].count(words[i]) < 3]
            if not rare:
                return [(a, b)]
            cuts = [a - 1, *rare, b]
            return [s for x, y in zip(cuts, cuts[1:]) for s in split(x + 1, y)]

        starts, ends = periodic.surviving(codes, np.array([0]), np.array([len(words)]), 6, 3)
        assert list(zip(starts.tolist(), ends.tolist())) == split(0, len(words))


def test_long_texts_with_common_words():
    rng = random.Random(13)
    words = [b"%d" % int(rng.paretovariate(0.8)) for _ in range(40_000)]
    unit = [b"%d" % rng.randint(0, 9) for _ in range(700)]
    words[20_000:20_000] = unit * 4
    assert any(q == 700 and a <= 20_000 and a + n >= 22_800 for a, n, q in periodic.runs_of([words])[0].tolist())


def test_runs_of_odd_rows(documents, odd_rows):
    docs = documents([*odd_rows, (9, "\n".join(["x  y z\x0b"] * 9 + ["w"]), "a")]).withColumns({"runs": F.lit("x"), "collapsed": F.lit("x")})
    rows = {(r["doc_id"], r["source"]): r for r in periodic.with_runs(docs).collect()}
    assert [tuple(r) for r in rows[9, "a"]["runs"]] == [(0, 27, 3)] and rows[9, "a"]["collapsed"] == "x y z w"
    assert rows[2, "a"]["runs"] == [] and rows[2, "a"]["collapsed"] == "" and rows[None, None]["collapsed"] == ""
    assert [tuple(r) for r in rows[4, "b"]["runs"]] == [(0, 30_000, 977)]
    assert periodic.with_runs(docs).count() == docs.count() and periodic.with_runs(docs.limit(0)).count() == 0
    assert "size" in periodic.with_runs(docs).columns


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def test_op11_is_brute_force(spark):
    rows = QUERIES["op11_periodic_runs"](spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    held = 0
    for r in rows:
        words = (texts[r["doc_id"]] or "").encode().split()
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if n > 1_500:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = naive_runs(words, 24, 3)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if runs else (None, None, None)
        gone = {i for a, size, q in runs for i in range(a + q, a + size)}
        kept = [w for i, w in enumerate(words) if i not in gone]
        want = (len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(b" ".join(kept)))
        assert tuple(r)[1:] == want
        held += bool(runs)
    assert held > 10


def naive_tree(digests):
    """Root, and each leaf's steps."""
    steps, level, members = [[] for _ in digests], list(digests), [[i] for i in range(len(digests))]
    while len(level) > 1:
        above, held = [], []
        for i in range(0, len(level), 2):
            for j, side, other in ((i, "R", i + 1), (i + 1, "L", i)):
                if j < len(level):
                    for m in members[j]:
                        steps[m].append(side + level[other] if other < len(level) else "")
            above.append(sha("".join(level[i : i + 2])))
            held.append([m for x in members[i : i + 2] for m in x])
        level, members = above, held
    return level[0], steps


def test_append_only_witnesses():
    for n in range(1, 40):
        digests = [sha(str(i)) for i in range(n)]
        assert merkle.append_all(digests, None) == naive_tree(digests)
    root, steps = merkle.append_all(digests[:3], 5)
    assert root == sha(sha(sha(naive_tree(digests[:3])[0]))) and steps[2][1:] == ["L" + sha(digests[0] + digests[1]), "", "", ""]


def test_manifest_in_blocks(spark, documents, odd_rows):
    rows = [*odd_rows, *((None if i % 50 == 0 else i, f"text {i}", "a") for i in range(100, 300)), *[(7, "again", "c")] * 30]
    docs = documents(rows).withColumns({
        "lang": F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") == 299, "").otherwise(F.coalesce("source", F.lit("=x"))),
        "leaf": merkle.leaf(F.col("doc_id"), F.col("text")), "root": F.lit("x"), "tree": F.lit("y"), "at": F.lit("z"),
    })
    found = merkle.manifest(docs, "leaf", "lang", "doc_id", height=2)
    got = found.withColumns({"fold": merkle.folded("leaf", "witness")}).collect()
    assert len(got) == len(rows) and {r["tree"] for r in got} == {"y"}
    want, langs = [], sorted({r["lang"] for r in got}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        leaves = sorted(((r["doc_id"], r["leaf"]) for r in got if r["lang"] == lang), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = leaves, *naive_tree([x[1] for x in leaves])
    root, above = naive_tree([trees[lang][1] for lang in langs])
    for lang, behind in zip(langs, above):
        leaves, subroot, steps = trees[lang]
        want += [(lang, *x, subroot, root, s + behind) for x, s in zip(leaves, steps)]
    spelled = lambda rows: sorted(map(repr, rows))
    assert spelled((r["lang"], r["doc_id"], r["leaf"], r["subroot"], r["root"], list(r["witness"])) for r in got) == spelled(want)
    assert all(r["fold"] == root for r in got)


def test_small_manifests(documents):
    docs = documents([(1, "a", "x"), (2, "b", None)]).withColumn("leaf", F.sha2("text", 256))
    assert merkle.manifest(docs.limit(0), "leaf", "source", "doc_id").count() == 0
    rows = {r["doc_id"]: r for r in merkle.manifest(docs, "leaf", "source", "doc_id").collect()}
    assert rows[1]["root"] == sha(sha("b") + sha("a")) and rows[1]["witness"] == ["L" + sha("b")] and rows[2]["subroot"] == sha("b")
    alone = merkle.manifest(docs.filter("doc_id = 1"), "leaf", "source", "doc_id").first()
    assert alone["root"] == sha("a") and alone["witness"] == []


def naive_kept(rows, length):
    """Kept words of each (id, text)."""
    least = {}
    cut = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in cut:
        for a in range(len(w) - length + 1) if i is not None else ():
            key = tuple(w[a : a + length])
            least[key] = min(least.get(key, i), i)
    kept = []
    for i, w in cut:
        gone = set()
        for a in range(len(w) - length + 1) if i is not None else ():
            if least[tuple(w[a : a + length])] < i:
                gone.update(range(a, a + length))
        kept.append((i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return kept


def test_substrings_are_brute_force(spark):
    rng = random.Random(14)
    pool = [[f"w{rng.randint(0, 30)}" for _ in range(rng.randint(3, 40))] for _ in range(12)]
    rows = [(1, None), (2, ""), (None, " ".join(pool[0] * 3)), (3, "a " * 200), (4, "a  " * 90), (4, "a " * 200), (50, "b a " * 30)]
    for i in range(300):
        words = [w for _ in range(rng.randint(0, 5)) for w in rng.choice((*pool, [f"w{rng.randint(0, 30)}" for _ in range(7)]))]
        for k in range(len(words)):
            if rng.random() < 0.02:
                words[k] = "x"
        rows.append((rng.randint(5, 200), rng.choice((" ", "\n", "  ")).join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(repr, naive_kept(rows, 8)))
    for group in (1 << 30, 4, 0):
        got = substrings.deduplicated(docs, length=8, seed=3, group=group).collect()
        assert sorted(repr((r["doc_id"], r["kept"])) for r in got) == want
        assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_words"] - len(r["kept"].split()) for r in got)
    named = docs.select(F.col("doc_id").cast("string").alias("name"), F.lit("x").alias("row"), F.lit("y").alias("kept"), F.col("text").alias("body"), F.lit("z").alias("text"))
    got = substrings.deduplicated(named, "name", "body", length=8, seed=3).collect()
    spelled = [(None if i is None else str(i), t) for i, t in rows]
    assert sorted(repr((r["name"], r["kept"])) for r in got) == sorted(map(repr, naive_kept(spelled, 8))) and {r["text"] for r in got} == {"z"}


def test_substrings_of_odd_rows(documents, odd_rows):
    docs = documents([*odd_rows, *[(6, odd_rows[6][1], "c")] * 3])
    got = {(r["doc_id"], r["source"]): r for r in substrings.deduplicated(docs).collect()}
    assert [tuple(s) for s in got[6, "c"]["spans"]] == [(0, 30_000)] and got[6, "c"]["kept"] == "" and got[4, "b"]["spans"] == []
    assert got[2, "a"]["n_words"] == 0 and got[2, "a"]["kept"] == "" and got[None, "b"]["kept"] == "six seven"
    assert substrings.deduplicated(docs).count() == docs.count() and substrings.deduplicated(docs.limit(0)).count() == 0
