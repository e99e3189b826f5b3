"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts carry a label; all other texts of the training side are unlabelled, toxic ones among them. With
the class prior p, the risk of a score f is  p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)]): what the unlabelled texts
hold of the toxic class is taken off, and where that would make the risk of the clean class negative, the step goes
back instead. The classifiers are linear in the words that a text has, with a one-norm penalty that leaves few words.

A bounded sample is learned from: at most POSITIVES toxic and UNLABELLED other texts, the first by hash of
their id, of TEXT_BYTES each at most and of SAMPLE_BYTES in all of either kind; repeated rows count once. Each classifier takes all the toxic texts and leaves out its own part of the others. The class prior counts all labels,
and every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.shared import crc32_of_id

BAGS, POSITIVES, UNLABELLED = 3, 4_000, 15_000
TEXT_BYTES, SAMPLE_BYTES = 1 << 20, 64 << 20
# Features are those that at least so many toxic texts and such a share of them have, and so many times the share of all texts.
LEAST_TEXTS, LEAST_SHARE, LIFT = 3, 0.02, 4.0
STEPS, RATE, PENALTY = 300, 0.1, 5e-5
# Beside each word, its beginnings of these lengths.
BEGINNINGS = (4, 5)
# Where all labels are positive, the share of toxic texts must be assumed.
PRIOR = 0.1
REJECTED = 0.7
# Texts whose words are looked up at once.
ROWS_AT_ONCE = 256

_MODEL = "bag int, words array<long>, weights array<double>, bias double"


def word_hashes(text: Column) -> Column:
    """Hashes of the distinct words of a whole text, in lower case, and of their beginnings; null and empty texts have none."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))
    kinds = [F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))]
    for n in BEGINNINGS:
        starts = F.filter(words, lambda w, n=n: F.length(w) >= n)
        kinds.append(F.transform(starts, lambda w, n=n: F.xxhash64(F.lit("beginning"), F.substring(w, 1, n))))
    return F.array_distinct(F.concat(*kinds))


def training_side(id_col: str) -> Column:
    return F.coalesce(F.pmod(crc32_of_id(id_col), F.lit(3)) != 1, F.lit(False))


def fit(positive: list[np.ndarray], other: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(words, weights, bias): one classifier of the texts' word hashes."""
    nothing = np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior)))
    if not positive or not other:
        return nothing
    sizes = np.array([len(t) for t in (*positive, *other)])
    flat = np.concatenate([np.zeros(0, np.int64), *positive, *other])
    words, codes = np.unique(flat, return_inverse=True)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    toxic = np.bincount(codes[rows < len(positive)], minlength=len(words))
    texts = np.bincount(codes, minlength=len(words)) - toxic
    often = (toxic >= max(LEAST_TEXTS, LEAST_SHARE * len(positive))) & (toxic / len(positive) >= LIFT * (texts + 1) / (len(other) + 1))
    keep = often[codes]
    codes, rows, words = (np.cumsum(often) - 1)[codes[keep]], rows[keep], words[often]
    if not len(words):
        return nothing
    # Rows sorted by word as well, so that both sums are over stretches.
    by_word = np.argsort(codes, kind="stable")
    rows_by_word = rows[by_word]
    n, n_pos = len(sizes), len(positive)
    share = np.where(np.arange(n) < n_pos, 1 / n_pos, 1 / (n - n_pos))
    is_pos = np.arange(n) < n_pos
    weights, bias = np.zeros(len(words)), np.log(prior / (1 - prior))
    word_at = np.searchsorted(codes[by_word], np.arange(len(words)))
    mean, spread = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, STEPS + 1):
        f = np.bincount(rows, weights[codes], minlength=n) + bias
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        soft = np.logaddexp(0, f)  # l(-f)
        clean_risk = (share * soft)[~is_pos].sum() - prior * (share * soft)[is_pos].sum()
        toxic_pull = np.where(is_pos, prior * share * (p - 1), 0)
        clean_push = np.where(is_pos, -prior, 1) * share * p
        slope = toxic_pull + clean_push if clean_risk >= 0 else -clean_push
        gradient = np.concatenate((np.add.reduceat(slope[rows_by_word], word_at), [slope.sum()]))
        mean = 0.9 * mean + 0.1 * gradient
        spread = 0.999 * spread + 0.001 * gradient**2
        scale = RATE / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
        move = scale * mean / (1 - 0.9**step)
        weights = weights - move[:-1]
        weights = np.sign(weights) * np.maximum(np.abs(weights) - scale[:-1] * PENALTY, 0)
        bias -= move[-1]
    held = np.flatnonzero(weights)
    return words[held], weights[held], float(bias)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple]:
    """The classifiers: (words, weights, bias) of each bag. Held-out ids (crc32 mod 3 = 1) and null ids take no part."""
    marks = labels.filter(training_side(id_col)).groupBy(id_col).agg(F.max(label_col).alias("mark")).filter("mark IS NOT NULL")
    counts = marks.agg(F.count(F.lit(1)), F.sum((F.col("mark") == 1).cast("int"))).first()
    all_labels, toxic = counts[0], counts[1] or 0
    prior = toxic / all_labels if 0 < toxic < all_labels else PRIOR
    order = F.xxhash64(F.col("id"), F.lit("toxicity"))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("bytes"))
    texts = texts.filter(training_side("id") & (F.col("bytes") <= TEXT_BYTES))

    def chosen(rows: DataFrame, kind: int, most: int) -> DataFrame:
        first = rows.dropDuplicates(["id", "key"]).withColumn("order", order).orderBy("order", "id", "key").limit(most)
        # At most ``most`` rows in one task.
        so_far = F.sum("bytes").over(Window.orderBy("order", "id", "key"))
        return first.withColumn("so_far", so_far).filter(F.col("so_far") <= SAMPLE_BYTES).select("id", "key", F.lit(kind).alias("kind"))

    every = F.sequence(F.lit(0), F.lit(BAGS - 1))
    toxic_ids = marks.filter("mark = 1").select(F.col(id_col).alias("id"))
    toxic_rows = chosen(texts.join(toxic_ids, "id", "left_semi"), 1, POSITIVES).withColumn("bag", F.explode(every))
    others = F.filter(every, lambda bag: bag != F.pmod(F.xxhash64("id"), F.lit(BAGS)))
    other_rows = chosen(texts, 0, UNLABELLED).withColumn("bag", F.explode(others))
    # At most BAGS * POSITIVES + (BAGS - 1) * UNLABELLED rows.
    picked = F.broadcast(toxic_rows.unionByName(other_rows))
    sample = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).join(picked, ["id", "key"])
    # Repeats of a chosen text go before their words move.
    features = sample.groupBy("bag", "kind", "id", "key").agg(F.first(word_hashes(F.col("text"))).alias("words"))

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["kind", "id", "key"], ascending=False, kind="stable")
        texts = [np.sort(np.asarray(w, np.int64)) for w in group["words"]]
        n = int((group["kind"] == 1).sum())
        words, weights, bias = fit(texts[:n], texts[n:], prior)
        return pd.DataFrame([{"bag": int(group["bag"].iloc[0]), "words": words, "weights": weights, "bias": bias}])

    fitted = [(np.array(r["words"], np.int64), np.array(r["weights"], float), r["bias"]) for r in features.groupBy("bag").applyInPandas(train, _MODEL).orderBy("bag").collect()]
    return fitted or [fit([], [], prior)]


def scored(docs: DataFrame, model: list[tuple], text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the mean probability of the classifiers; texts without words have the model's bias alone.

    Null and empty texts have no words. Repeated rows are scored each; a column called ``name`` is replaced.
    """
    docs = docs.drop(name)
    columns = docs.columns

    def scores(lists: pa.ListArray) -> np.ndarray:
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        total = np.zeros(len(sizes))
        for words, weights, bias in model:
            f = np.full(len(sizes), bias)
            if len(words):
                at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
                hit = words[at] == flat
                f += np.bincount(rows[hit], weights[at[hit]], minlength=len(sizes))
            total += 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return total / len(model)

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            lists = batch.column(len(columns))
            found = [scores(lists.slice(i, ROWS_AT_ONCE)) for i in range(0, len(lists), ROWS_AT_ONCE)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(columns))), pa.array(np.concatenate([np.zeros(0), *found]))], names=[*columns, name]
            )

    with_words = docs.withColumn("_toxicity_words", word_hashes(F.col(text_col)))
    return with_words.mapInArrow(batches, docs.withColumn(name, F.lit(0.0)).schema)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: float = REJECTED) -> DataFrame:
    """``docs`` that score below ``most``."""
    model = learn(docs, labels, id_col, text_col)
    return scored(docs, model, text_col, "_toxicity_score").filter(F.col("_toxicity_score") < most).drop("_toxicity_score")
