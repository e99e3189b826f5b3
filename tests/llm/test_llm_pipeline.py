"""Mixing, the registered queries and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import pytest
from compare import compare, duck
from pyspark.sql import functions as F
from test_llm_matching import naive_components, naive_fingerprint, naive_hits

import __spark_entry__ as entry
import corpus_pipeline
from siftline.llm import mixing, toxicity
from siftline.llm.decontaminate import words_of
from siftline.llm.queries import ORACLE
from siftline.llm.shared import table, written


def naive_targets(sizes):
    """Reshare what is cut off until none is above three times its own."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in order if s not in capped]
        scale = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in rest)
        over = {s for s in rest if scale * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else scale * weight[s] for s in order}
        capped |= over


def test_mix_of_a_row_that_is_a_third_of_the_table(spark, documents):
    rng = random.Random(21)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 30])), rng.choice("ab")) for i in range(800)] + [(9_999, "one two three", "a")] * 400
    docs = documents(rows).withColumn("lang", F.concat(F.lit("l"), F.monotonically_increasing_id().cast("string"))).repartition(3)
    groups = mixing.taken(docs, "doc_id", "source", "text", mixing.WEIGHTS, 3, 1, 16)
    assert groups.count() == 801 and groups.filter("many = 400").count() == 1
    found = mixing.copies(docs, group=16).collect()
    assert len(found) == len(rows)
    repeats = Counter(r.copies for r in found if r.doc_id == 9_999)
    assert sum(repeats.values()) == 400 and max(repeats) - min(repeats) <= 1
    sizes = {s: sum(len(t.split()) for _i, t, x in rows if x == s) for s in "ab"}
    for source, target in naive_targets(sizes).items():
        by = {i: s for i, _t, s in rows}
        assert abs(sum(r.size * r.copies for r in found if by[r.doc_id] == source) - target) <= 15
    mix = Counter(r.doc_id for r in mixing.mixed(docs, group=16).collect())
    want = Counter()
    for r in found:
        want[r.doc_id] += r.copies
    assert mix == +want
    # No row of the 400 is taken more than once more than another.
    langs = Counter(r.lang for r in mixing.mixed(docs, group=16).filter("doc_id = 9999").collect())
    assert max(langs.values()) - min(langs.values() if len(langs) == 400 else [0]) <= 1


def test_pivots_are_unbiased(spark):
    """Over many draws, the mean of what each member is rounded to is its fraction, and the words due never change."""
    parts, sizes, draws = (0.2, 0.5, 0.9, 0.35, 0.6), (5, 3, 8, 2, 6), 4_000
    members = F.array(*[
        F.struct(F.lit(p).alias("part"), F.lit(n).cast("long").alias("size"), F.xxhash64("id", F.lit(i)).alias("key"), F.lit(i).alias("member"))
        for i, (p, n) in enumerate(zip(parts, sizes))
    ])
    out = spark.range(draws).select(mixing.pivoted(members, 3).alias("out"))
    ends = out.select(F.explode(F.concat("out.done", F.when(F.col("out.rest").isNotNull(), F.array("out.rest")).otherwise(F.array().cast(out.schema["out"].dataType["done"].dataType)))).alias("m"))
    for r in ends.groupBy("m.member").agg(F.avg("m.part").alias("mean"), F.count(F.lit(1)).alias("n")).collect():
        assert r.n == draws and abs(r.mean - parts[r.member]) < 0.03
    due = sum(p * n for p, n in zip(parts, sizes))
    kept = out.select((F.aggregate("out.done", F.lit(0.0), lambda a, m: a + m["part"] * m["size"]) + F.coalesce(F.col("out.rest.part") * F.col("out.rest.size"), F.lit(0.0))).alias("due"))
    assert kept.filter(F.abs(F.col("due") - due) > 1e-6).count() == 0


def test_mix_meets_its_targets(documents):
    rng = random.Random(10)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 90])), rng.choice(["a", "B", "ç", None, "b", "hot", "hot", "hot"])) for i in range(1500)]
    rows += [(5000, "one two", "tiny"), (5001, "", "void"), (None, "x y z", "a"), (6999, "rep", "a"), (6999, "rep", "a")]
    docs = documents(rows)
    found = mixing.copies(docs, group=16).collect()
    assert len(found) == len(rows) and all(0 <= r.copies <= 3 for r in found)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, largest = Counter(), Counter(), defaultdict(int)
    source = {(i, t): s for i, t, s in rows}
    for i, t, s in rows:
        sizes[s] += words(t)
        largest[s] = max(largest[s], words(t))
    targets = naive_targets(sizes)
    by_id = {i: s for i, _t, s in rows}
    for r in found:
        s = by_id[r.doc_id]
        taken[s] += r.size * r.copies
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(largest[s], 1) / 2 + 1e-6
    again = mixing.copies(docs.repartition(5), group=16).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    mix = mixing.mixed(docs, group=16)
    assert mix.columns == docs.columns and mix.count() == sum(r.copies for r in found) and len(source) == len(rows) - 1
    assert mixing.copies(documents([])).count() == 0 and mixing.mixed(documents([])).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_against_sql(spark, sf_dir, name):
    assert compare(entry.queries()[name], entry.oracle_sql()[name], spark, duck(sf_dir), sf_dir)[0] == "ok"


def test_every_operator_has_a_query():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_stages_of_odd_input(spark, sf_dir, documents, odd_rows):
    """Empty tables, nulls, repeated rows and clashing columns pass through every stage; all but the last keep the columns."""
    rows = [*odd_rows, *[(6, "again and again", "a")] * 20]
    for docs in (documents(rows), documents(rows).limit(0)):
        given = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = written(stage(spark, docs, sf_dir), name)
            assert out.columns == given.columns
            docs = out
        kept = docs.select("doc_id", "text").distinct().count()
        tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
        assert len(tokens) == docs.count() and kept <= 9
    assert not tokens


def test_stages_against_brute_force(spark, sf_dir):
    """Each stage on its own input, as the pipeline runs them."""
    docs = table(spark, sf_dir, "documents")
    names = [n for n, _f in corpus_pipeline.STAGES]
    outputs = {}
    for name, stage in corpus_pipeline.STAGES:
        outputs[name] = (docs, written(stage(spark, docs, sf_dir), name))
        docs = outputs[name][1]
    rows = {n: ([tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()]) for n, (a, b) in outputs.items()}
    before, after = outputs[names[0]]
    scores = toxicity.scored(before, toxicity.learn(before, table(spark, sf_dir, "labels"))).collect()
    assert sorted(rows[names[0]][1]) == sorted(tuple(r)[:5] for r in scores if r.score < 0.7)
    given, kept = (sorted(x) for x in rows[names[1]])
    lowest = naive_components([naive_fingerprint(r[1]) for r in given])
    assert kept == [given[i] for i in sorted(set(lowest))]
    items = [(str(r.item_id), words_of(r.text.encode())) for r in table(spark, sf_dir, "benchmark").collect()]
    given, kept = rows[names[2]]
    left = {r[0]: r for r in kept}
    for r in given:
        words = words_of(r[1].encode())
        hit, _names = naive_hits(words, items)
        if not hit:
            assert left[r[0]] == r
        elif 2 * len(hit) >= len(words):
            assert r[0] not in left
        else:
            assert not naive_hits(words_of(left[r[0]][1].encode()), items)[0] and left[r[0]][4] == len(left[r[0]][1])
    given, kept = rows[names[3]]
    copies = {r.doc_id: r.copies for r in mixing.copies(outputs[names[3]][0]).collect()}
    assert Counter(kept) == Counter({r: copies[r[0]] for r in given if copies[r[0]]})
    assert len(rows[names[4]][1]) == len(kept)
    again = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, again.collect())) == sorted(rows[names[4]][1]) and again.agg(F.min("start")).first()[0] == 0
