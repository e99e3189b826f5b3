"""Exact top-k by inner product with a three-phase uniform threshold.

A vector is cut into SLICES, and a score is the sum of the slices' partial scores. Phase one: each slice has cells of its own, which
list their highest partial scores for each query; the lists of a slice are gathered, the partial scores of a candidate summed, and
the slices that a listed candidate lacks asked for in their cells. The k-th highest of these scores is a safe cutoff: k
candidates reach it. Phase two: the cutoff goes back with the query to every block, where each slice collects the candidates whose
partial score is at least cutoff / SLICES; a score that reaches the cutoff has such a slice, so no winner is missed. Phase
three: the slices that a collected candidate lacks are resolved in its block, which sends on its best k. (To send all
collected entries on and ask for their slices as in phase one takes 19 times as long: a twelfth of all pairs are sufficient.)

Queries and candidates are both cut into blocks of bounded size, and every block of one meets every block of the other: the
query set is stated, and its number may follow the number of rows. Candidates with one vector are one, with its k + 1
smallest ids: no other of them can be among the best k of any query, of whose own id the last makes up for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.shared import written

K = 20
SLICES = 2
# Components of a block, and scores that stand in memory at once.
BLOCK_VALUES, SCORES_AT_ONCE = 1 << 19, 1 << 20
QUERY, CANDIDATE, ASKED = 0, 1, 2

_PARTIAL = "id long, key long, vec long, slice int, part long"


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component; null unless all components are finite. Components beyond 64 bits are an error."""
    x = lambda v: v.cast("double")
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < float("inf")))
    long = lambda v: F.when(F.abs(v * scale) < 2.0**63, F.floor(v * scale).cast("long")).otherwise(F.raise_error(F.lit("component beyond 64 bits")).cast("long"))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda v: long(x(v))))


class Cell:
    """One slice, of so many, of a block of queries and a block of candidates."""

    def __init__(self, table: pa.Table, slices: int = SLICES):
        side = table.column("side").to_numpy()
        self.slice = table.column("slice")[0].as_py()
        self.queries, self.candidates, self.asked = (table.filter(pa.array(side == s)) for s in (QUERY, CANDIDATE, ASKED))
        self.q, self.c = self._matrix(self.queries), self._matrix(self.candidates)
        largest = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0))
        bound = largest(self.q) * largest(self.c) * max(self.c.shape[1], 1) * slices
        if bound >= 2.0**63:
            raise OverflowError("scores beyond 64 bits")
        # By floating point where that is exact, else by integers.
        kind = np.float64 if bound < 2.0**53 else np.int64
        self.q, self.c = self.q.astype(kind), self.c.astype(kind)
        self.vecs = self.candidates.column("vec").to_numpy()

    @staticmethod
    def _matrix(table: pa.Table) -> np.ndarray:
        lists = table.column("values").combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return flat.reshape(table.num_rows, len(flat) // max(table.num_rows, 1))

    def turns(self):
        """(first query, partial scores of some queries by all candidates), in turns that bound memory."""
        if self.queries.num_rows and self.candidates.num_rows:
            step = max(1, SCORES_AT_ONCE // self.candidates.num_rows)
            for at in range(0, self.queries.num_rows, step):
                yield at, self.q[at : at + step] @ self.c.T

    def rows(self, query: np.ndarray, candidate: np.ndarray, part: np.ndarray) -> pa.Table:
        taken = self.queries.take(pa.array(query))
        return pa.table({
            "id": taken.column("id"), "key": taken.column("key"), "vec": pa.array(self.vecs[candidate], pa.int64()),
            "slice": pa.array(np.full(len(query), self.slice, np.int32)), "part": pa.array(part.astype(np.int64)),
        })

    def gathered(self, found: list[tuple]) -> pa.Table:
        joined = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return self.rows(*joined)


def listed(most: int):
    """Phase one: the ``most`` highest partial scores of each query in a cell."""

    def run(table: pa.Table) -> pa.Table:
        cell, found = Cell(table), []
        for at, parts in cell.turns():
            many = min(most, parts.shape[1])
            best = np.argpartition(parts, parts.shape[1] - many, axis=1)[:, -many:]
            query = np.repeat(np.arange(len(parts)), many)
            found.append((at + query, best.ravel(), parts[query, best.ravel()]))
        return cell.gathered(found)

    return run


def collected(k: int):
    """Phases two and three in a cell of whole vectors: candidates with a sufficient slice, their scores, and of each query the best
    ``k`` that reach the cutoff, by score and then by their smallest id that is not the query's."""

    def run(table: pa.Table) -> pa.Table:
        cell, found = Cell(table, 1), []
        if not cell.queries.num_rows or not cell.candidates.num_rows:
            return cell.gathered(found)
        first, second = (cell.candidates.column(c).to_pylist() for c in ("first", "second"))
        second = np.array([np.iinfo(np.int64).max if x is None else x for x in second])
        first, alone = np.array(first), second == np.iinfo(np.int64).max
        own, cutoffs = cell.queries.column("id").to_pylist(), cell.queries.column("cutoff").to_pylist()
        width = -(-cell.c.shape[1] // SLICES)
        step = max(1, SCORES_AT_ONCE // len(first))
        for at in range(0, len(own), step):
            some = cell.q[at : at + step]
            parts = [some[:, p : p + width] @ cell.c[:, p : p + width].T for p in range(0, max(width * SLICES, 1), max(width, 1))]
            for row in range(len(some)):
                mine, cutoff = first == own[at + row], cutoffs[at + row]
                enough = ~(mine & alone)
                if cutoff is not None:
                    enough &= np.logical_or.reduce([part[row] * SLICES >= cutoff for part in parts])
                candidate = np.flatnonzero(enough)
                score = sum(part[row, candidate] for part in parts).astype(np.int64)
                if cutoff is not None:
                    candidate, score = candidate[score >= cutoff], score[score >= cutoff]
                best = np.lexsort((np.where(mine, second, first)[candidate], -score))[:k]
                found.append((np.full(len(best), at + row), candidate[best], score[best]))
        return cell.gathered(found)

    return run


def answered(table: pa.Table) -> pa.Table:
    """Phase three: the partial scores that are asked for."""
    cell = Cell(table)
    rows = {pair: i for i, pair in enumerate(zip(cell.queries.column("id").to_pylist(), cell.queries.column("key").to_pylist()))}
    query = np.array([rows[pair] for pair in zip(cell.asked.column("id").to_pylist(), cell.asked.column("key").to_pylist())], np.int64)
    order = np.argsort(cell.vecs)
    candidate = order[np.searchsorted(cell.vecs[order], cell.asked.column("vec").to_numpy())] if len(query) else np.zeros(0, np.int64)
    step, found = max(1, SCORES_AT_ONCE // max(cell.c.shape[1], 1)), []
    for at in range(0, len(query), step):
        some = slice(at, at + step)
        found.append((query[some], candidate[some], (cell.q[query[some]] * cell.c[candidate[some]]).sum(axis=1)))
    return cell.gathered(found)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` best candidates; both tables have (id, v array<long>).

    Rows with a null id or vector take no part, nor does a candidate with the query's own id. Only vectors of one length meet.
    Ties go to the smaller id. A candidate row that is repeated takes a rank for each copy; a query row that is repeated is
    answered once, and one id with several vectors is answered for each. Scores beyond 64 bits are an error.
    """
    usable = lambda df: df.filter("id IS NOT NULL AND v IS NOT NULL").withColumns({"dim": F.size("v"), "key": F.xxhash64("v")})
    counted = usable(candidates).groupBy("dim", "key", "v", "id").agg(F.count(F.lit(1)).alias("n"))
    ids = F.row_number().over(Window.partitionBy("dim", "key", "v").orderBy("id"))
    fewest = counted.withColumn("place", ids).filter(F.col("place") <= k + 1)
    vectors = written(fewest.groupBy("dim", "key", "v").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("ids")), "vectors")
    # A number for each distinct vector.
    c = written(vectors.withColumn("vec", F.monotonically_increasing_id()), "candidates")
    q = written(usable(queries).select("dim", "id", "key", "v").distinct(), "queries")
    (widest, rows), asked = c.agg(F.max("dim"), F.count(F.lit(1))).first(), q.count()
    block = max(64, BLOCK_VALUES // max(widest or 1, 1))
    shards, turns = -(-rows // block) or 1, -(-asked // block) or 1
    turn, shard = F.pmod(F.xxhash64("id", "key"), F.lit(turns)).cast("int"), F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    width = F.ceil(F.col("dim") / SLICES).cast("int")
    values = F.slice("v", F.col("slice") * width + 1, width)
    none = lambda kind: F.lit(None).cast(kind)
    columns = ("dim", "slice", "turn", "shard", "side", "id", "key", "vec", "cutoff", "values", "first", "second")

    def cells(asking: DataFrame, asked: DataFrame | None = None, whole: bool = False):
        """Queries and candidates by cell: a slice of their vectors, or whole ones with the candidates' two smallest ids."""
        own = {"first": none("long"), "second": none("long")}
        left = asking.withColumns({"turn": turn, "side": F.lit(QUERY), "vec": none("long"), **own})
        right = c.withColumns({"shard": shard, "side": F.lit(CANDIDATE), "id": none("long"), "cutoff": none("long"), **own})
        if whole:
            left, right = (df.withColumns({"slice": F.lit(0), "values": F.col("v")}) for df in (left, right))
            right = right.withColumns({"first": F.col("ids")[0]["id"], "second": F.get("ids", F.lit(1))["id"]})
        else:
            left, right = (df.withColumn("slice", every(SLICES)).withColumn("values", values) for df in (left, right))
        both = left.withColumn("shard", every(shards)).select(*columns).unionByName(right.withColumn("turn", every(turns)).select(*columns))
        if asked is not None:
            rest = asked.withColumns({"turn": turn, "shard": shard, "side": F.lit(ASKED), "cutoff": none("long"), "values": none("array<long>"), **own})
            both = both.unionByName(rest.select(*columns))
        return both.groupBy("dim", "slice", "turn", "shard")

    def resolved(partial: DataFrame, asking: DataFrame) -> DataFrame:
        """(dim, id, key, vec, score) of all candidates that have a partial score."""
        known = partial.groupBy("id", "key", "vec").agg(F.sum("part").alias("part"), F.bit_or(F.expr("shiftleft(1, slice)")).alias("slices"))
        known = written(known.join(asking.select("id", "key", "dim"), ["id", "key"]), "partial-scores")
        missing = known.withColumn("slice", every(SLICES)).filter(F.expr("(slices & shiftleft(1, slice)) = 0"))
        more = cells(asking, missing).applyInArrow(answered, _PARTIAL).groupBy("id", "key", "vec").agg(F.sum("part").alias("more"))
        return known.join(more, ["id", "key", "vec"], "left").withColumn("score", F.col("part") + F.coalesce("more", F.lit(0))).drop("part", "slices", "more")

    def owned(scores: DataFrame) -> DataFrame:
        """Scores by candidate id, without the query's own."""
        each = scores.join(c.select("vec", F.explode("ids").alias("own")), "vec").filter(F.col("own.id") != F.col("id"))
        return each.select("id", "key", F.col("own.id").alias("vec_id"), F.least("own.n", F.lit(k).cast("long")).alias("n"), "score")

    asking = q.withColumn("cutoff", none("long"))
    # The own vector may be on a list, so that one more is listed.
    lists = cells(asking).applyInArrow(listed(k + 1), _PARTIAL)
    of_slice = F.row_number().over(Window.partitionBy("id", "key", "slice").orderBy(F.desc("part"), "vec"))
    lists = lists.withColumn("place", of_slice).filter(F.col("place") <= k + 1).drop("place")
    so_far = F.sum("n").over(Window.partitionBy("id", "key").orderBy(F.desc("score"), "vec_id").rowsBetween(Window.unboundedPreceding, 0))
    cutoffs = owned(resolved(lists, asking)).withColumn("so_far", so_far).groupBy("id", "key").agg(F.max(F.when(F.col("so_far") >= k, F.col("score"))).alias("cutoff"))
    asking = written(q.join(cutoffs, ["id", "key"], "left"), "cutoffs")
    scores = cells(asking, whole=True).applyInArrow(collected(k), _PARTIAL)
    best = owned(scores.select("id", "key", "vec", F.col("part").alias("score")))
    copies = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    order = Window.partitionBy("id", "key").orderBy(F.desc("score"), "vec_id", "copy")
    return (
        copies.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
