"""Placement of reads by minimizers and collinear chains.

Where :func:`siftline.operators.hits.seed_vote_hits` lets every position vote, here a window of ``w`` neighbouring k-mers gives one
seed on either side, its smallest by hash, so that reads and panel move a fraction of their positions; equal stretches of
``w + k - 1`` bases share a seed. A k-mer and its reverse complement are one seed. The places a read's seeds meet on a contig are chained:
the score of a chain is what its seeds cover of the read, and seeds of a chain ascend on both. It is approximate by design, and
the form that lets all seeds vote is kept as the exact way.

Seeds of repeats have many places. Beyond ``CROWD`` of them, a seed's places are dealt over several salts and its reads go
to each, so no task holds all places of a seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.operators.hits import PIECE
from siftline.tuning import broadcast_if_small, settle

K, WINDOW = 15, 8
# Places of a seed that one task takes.
CROWD = 1_000
# Seeds of a chain stand at most so far apart, and their distances on read and contig differ by at most so much.
GAP, DRIFT = 200, 16
LEAST_SEEDS = 2

_CODES = np.full(256, 4, np.uint8)
for _i, _base in enumerate("ACGT"):
    _CODES[[ord(_base), ord(_base.lower())]] = _i


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def minimizers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, place, seed, whether it reads forward) of the minimizers of many sequences of bytes at once.

    K-mers with other symbols than bases are no seeds; a window without any has no minimizer. Shorter sequences than a window
    are one window.
    """
    n = len(data) - k + 1
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    if n <= 0:
        return none
    codes = _CODES[data]
    forward, backward = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for i in range(k):
        base = codes[i : i + n].astype(np.uint64) & np.uint64(3)
        forward = (forward << np.uint64(2)) | base
        backward |= (np.uint64(3) - base) << np.uint64(2 * i)
    odd = np.concatenate(([0], np.cumsum(codes > 3)))
    sequence = np.repeat(np.arange(len(starts)), ends - starts)[:n]
    fine = (odd[k:] == odd[:-k]) & (np.arange(n) + k <= ends[sequence]) & (forward != backward)
    ahead = forward < backward
    seed = _mixed(np.where(ahead, forward, backward))
    order = np.where(fine, seed >> np.uint64(1), np.uint64(1 << 63))
    least, size = np.arange(n), 1
    smaller = lambda a, b: np.where(order[a] <= order[b], a, b)
    while 2 * size <= w:
        least, size = smaller(least[:-size], least[size:]), 2 * size
    # Windows of each sequence: w k-mers, or all where there are fewer.
    kmers = np.maximum(ends - starts - k + 1, 0)
    whole = kmers >= w
    counts = np.where(whole, kmers - w + 1, 0)
    owner = np.repeat(np.arange(len(starts)), counts)
    first = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    found = [smaller(least[first], least[first + w - size])] if len(first) else []
    for s in np.flatnonzero(~whole & (kmers > 0)):
        found.append(starts[s] + np.array([order[starts[s] : starts[s] + kmers[s]].argmin()]))
    at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    at = at[fine[at]]
    return sequence[at], at - starts[sequence[at]], seed[at].view(np.int64), ahead[at]


def seed_rows(rows: DataFrame, seq: str, k: int, w: int) -> DataFrame:
    """``rows`` without their sequence, one for each minimizer: ``seed``, ``place``, ``ahead``. Null sequences have none."""
    kept = [c for c in rows.columns if c != seq]

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            text = batch.column(seq).cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            row, place, seed, ahead = minimizers(data, offsets[:-1], offsets[1:], k, w)
            taken = [batch.column(c).take(pa.array(row)) for c in kept]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(seed), pa.array(place), pa.array(ahead)], names=[*kept, "seed", "place", "ahead"])

    added = [T.StructField("seed", T.LongType()), T.StructField("place", T.LongType()), T.StructField("ahead", T.BooleanType())]
    return rows.select(*kept, seq).mapInArrow(batches, T.StructType([*rows.select(*kept).schema, *added]))


def best_chain(on_read: np.ndarray, on_contig: np.ndarray, k: int) -> tuple[int, int, int, int]:
    """(bases of the read that the best chain covers, its seeds, first and last place on the contig), places in the contig's order.

    Of equal chains, the one that ends first.
    """
    n = len(on_read)
    score, seeds, origin = np.full(n, k), np.ones(n, np.int64), on_contig.copy()
    low = 0
    for i in range(1, n):
        while on_contig[i] - on_contig[low] > GAP:
            low += 1
        step, far = on_read[i] - on_read[low:i], on_contig[i] - on_contig[low:i]
        fits = (step > 0) & (step <= GAP) & (far > 0) & (np.abs(step - far) <= DRIFT)
        if fits.any():
            gained = np.where(fits, score[low:i] + np.minimum(step, k), -1)
            j = int(gained.argmax())
            score[i], seeds[i], origin[i] = gained[j], seeds[low + j] + 1, origin[low + j]
    top = int(score.argmax())
    return int(score[top]), int(seeds[top]), int(origin[top]), int(on_contig[top])


def chained(places, k: int):
    """A column of struct (score, seeds, target_start, target_end) of arrays of (contig place, read place) in order."""
    kind = pa.struct([("score", pa.int32()), ("seeds", pa.int32()), ("target_start", pa.int64()), ("target_end", pa.int64())])

    def best(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        contig, read = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
        rows = [best_chain(read[a:b], contig[a:b], k) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        return pa.array([{"score": s, "seeds": m, "target_start": a, "target_end": b + k} for s, m, a, b in rows], kind)

    return F.arrow_udf(best, "score int, seeds int, target_start long, target_end long")(places)


def panel_index(contigs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """(seed, contig, contig_place, contig_ahead) of the panel, cut into pieces that overlap by a window, so no piece is as long as a contig."""
    cut = contigs.withColumn("_from", F.explode(F.sequence(F.lit(0), F.greatest(F.length("sequence") - 1, F.lit(0)), F.lit(PIECE))))
    pieces = cut.select("contig", "_from", F.substring(F.col("sequence"), F.col("_from") + 1, F.lit(PIECE + w + k - 2)).alias("piece"))
    seeds = seed_rows(pieces, "piece", k, w)
    return seeds.select("seed", "contig", (F.col("_from") + F.col("place")).alias("contig_place"), F.col("ahead").alias("contig_ahead")).distinct()


def minimizer_hits(fragments: DataFrame, contigs: DataFrame, k: int = K, w: int = WINDOW, least: int = LEAST_SEEDS, crowd: int = CROWD) -> DataFrame:
    """Hits, in the schema of :func:`hits.seed_vote_hits`, of reads (sample_id, fragment_key, r1_seq, r2_seq) on a panel (contig, sequence).

    One hit for each mate, contig and strand whose best chain has ``least`` seeds; the score is what it covers of the read.
    """
    mates = fragments.repartition("sample_id", "fragment_key").select(
        "sample_id", "fragment_key",
        F.explode(F.array(*(F.struct(F.lit(m).alias("mate"), F.col(f"r{m}_seq").alias("seq")) for m in (1, 2)))).alias("m"),
    )
    reads = seed_rows(mates.select("sample_id", "fragment_key", "m.mate", F.length("m.seq").alias("size"), "m.seq"), "seq", k, w)
    index = settle(panel_index(contigs, k, w))
    degrees = index.groupBy("seed").agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("salts"))
    crowded = broadcast_if_small(degrees.filter("salts > 1"))
    # Places of a crowded seed are dealt out; its reads go to all salts.
    dealt = index.join(crowded, "seed", "left").withColumn("salt", F.pmod(F.xxhash64("contig", "contig_place"), F.coalesce("salts", F.lit(1)))).drop("salts")
    spread = reads.join(crowded, "seed", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1)))
    met = spread.join(broadcast_if_small(dealt), ["seed", "salt"])
    same = F.col("ahead") == F.col("contig_ahead")
    # On the other strand, places of the read count from its end.
    on_read = F.when(same, F.col("place")).otherwise(F.col("size") - k - F.col("place"))
    mate = ["sample_id", "fragment_key", "mate"]
    strand = F.when(same, "+").otherwise("-").alias("strand")
    places = F.sort_array(F.collect_list(F.struct("contig_place", on_read.cast("long").alias("on_read"))))
    grouped = met.groupBy(*mate, "contig", strand).agg(places.alias("places")).filter(F.size("places") >= least)
    chains = grouped.withColumn("chain", chained(F.col("places"), k)).filter(F.col("chain.seeds") >= least).select(*mate, "contig", "strand", "chain.*")
    top = chains.groupBy(*mate).agg(F.min(F.struct(-F.col("score"), F.col("contig"), F.col("strand"))).alias("top"), F.count(F.lit(1)).alias("placements"))
    best = (F.col("contig") == F.col("top.contig")) & (F.col("strand") == F.col("top.strand"))
    return chains.join(top, mate).select(
        *mate, "contig",
        F.floor(F.lit(60) / F.col("placements")).cast("int").alias("mapq"),
        F.col("score").alias("as_score"), F.lit(None).cast("int").alias("nm"), best.alias("is_primary"), F.lit(False).alias("is_supplementary"),
        F.lit(0).alias("segment_id"), "target_start", "target_end", "strand",
    )
