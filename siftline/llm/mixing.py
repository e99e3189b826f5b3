"""Mixing sources to target weights by pivotal dependent rounding, in SQL functions only.

Each source gets a target number of words; its documents should then be taken ``target / source size`` times. The whole
part of that ratio is certain; the fraction is rounded by the pivotal method: two documents with fractions pass mass
to each other, at random and so that the words they are due stay the same, until one fraction is 0 or 1; the other
goes on to the next. Documents are paired inside small groups; each group leaves at most one fraction,
and these residuals are paired in groups again, level by level, until one document of each source is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.shared import WORD, written

# Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
SEED = 20_251
# Documents that meet in one group; a level leaves one fraction of each.
GROUP = 64
# Repeats of a row that are handed their copies at once.
REPEATS_AT_ONCE = 4_096


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, documents, target) of each source of ``sized`` (source, size, many: how often the row stands).

    Sources share all words by weight, none above ``most`` times its own; what is cut off is shared again by weight among
    the rest until none is above. Sources are numbered by ranges of their names, so that no task holds all of them.
    """
    words = F.sum(F.col("size") * F.col("many"))
    sums = written(sized.groupBy("source").agg(words.alias("source_size"), F.count(F.lit(1)).alias("documents")), "sources")
    # Bytes of UTF-8 sort as code points do.
    ranged = written(
        sums.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumns({"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)}),
        "ranked",
    )
    before, earlier = 0, []
    for row in ranged.groupBy("_part").count().orderBy("_part").toLocalIterator():
        earlier.append(F.when(F.col("_part") == row["_part"], F.lit(before)))
        before += row["count"]
    rank = F.coalesce(*earlier, F.lit(0)) + F.col("_place")
    by_rank = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    weighed = written(ranged.select("source", "source_size", "documents", by_rank.alias("weight"), (F.col("source_size") * float(most)).alias("limit")), "weighed")
    scale, capped = 0.0, -1
    while True:
        full = F.col("limit") < F.lit(scale) * F.col("weight")
        row = weighed.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))
        ).first()
        if row[3] == capped or not row[2]:
            break
        capped, scale = row[3], (float(row[0] or 0) - (row[1] or 0.0)) / row[2]
    return weighed.select("source", "source_size", "documents", F.least("limit", F.lit(scale) * F.col("weight")).alias("target"))


def drawn(*parts: Column) -> Column:
    """A number in [0, 1) that depends only on the parts."""
    return (F.shiftright(F.xxhash64(*parts), 11).cast("double") + float(1 << 52)) / float(1 << 53)


def pivoted(members: Column, seed: int) -> Column:
    """struct(done array, rest struct) of one group, an array of (part, size, key, ...) structs in the order they meet.

    ``part`` is the fraction still open, in (0, 1); a member that is done has exactly 0 or 1.
    """

    def to(member: Column, part: Column) -> Column:
        return member.withField("part", part)

    def step(state: Column, new: Column) -> Column:
        old = state["rest"]
        # Words that can move: up is towards the old one.
        a, b = old["size"], new["size"]
        p, q = old["part"], new["part"]
        old_room, new_room = a * (1 - p), b * (1 - q)
        old_has, new_has = a * p, b * q
        up, down = F.least(old_room, new_has), F.least(old_has, new_room)
        upward = drawn(old["key"], new["key"], F.lit(seed)) * (up + down) < down
        fill = upward & (old_room <= new_has)
        drain = ~upward & (old_has <= new_room)
        old_done = fill | drain
        kept_old = F.when(upward, p + up / a).otherwise(p - down / a)
        kept_new = F.when(upward, q - up / b).otherwise(q + down / b)
        done = F.when(old_done, to(old, F.when(fill, F.lit(1.0)).otherwise(F.lit(0.0)))).otherwise(
            to(new, F.when(upward, F.lit(0.0)).otherwise(F.lit(1.0)))
        )
        rest = F.when(old_done, to(new, kept_new)).otherwise(to(old, kept_old))
        # Arithmetic can land on the edge of the open interval; then both are done.
        closed = (rest["part"] <= 0) | (rest["part"] >= 1)
        edge = to(rest, F.when(rest["part"] <= 0, F.lit(0.0)).otherwise(F.lit(1.0)))
        none = F.lit(None)
        return (
            F.when(old.isNull(), F.struct(state["done"].alias("done"), new.alias("rest")))
            .when(closed, F.struct(F.concat(state["done"], F.array(done, edge)).alias("done"), F.when(~closed, rest).otherwise(none).alias("rest")))
            .otherwise(F.struct(F.concat(state["done"], F.array(done)).alias("done"), rest.alias("rest")))
        )

    empty = F.filter(members, lambda _x: F.lit(False))
    first = F.struct(empty.alias("done"), F.when(F.lit(False), F.element_at(members, 1)).alias("rest"))
    return F.aggregate(members, first, step)


def row_key(id_col: str, source_col: str, text_col: str) -> Column:
    """One value for each distinct (id, source, text)."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in (id_col, source_col, text_col)]
    return F.md5(F.concat_ws("\n", *parts))


def taken(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[float, ...], most: int, seed: int, group: int) -> DataFrame:
    """(id, row_key, size, source_size, target, many, copies) of every distinct row: ``copies`` is what its ``many`` repeats take together.

    Repeats are counted before anything moves, and meet the others as one member, so no group holds more than its share.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"),
        row_key(id_col, source_col, text_col).alias("row_key"),
    )
    sized = written(rows.groupBy("id", "source", "size", "row_key").agg(F.count(F.lit(1)).alias("many")), "sizes")
    targets = source_targets(sized, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(1.0)
    due = (
        sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("ratio", ratio * F.col("many"))
        .withColumns({"base": F.floor("ratio").cast("long"), "part": F.col("ratio") - F.floor("ratio"), "key": F.xxhash64("row_key", F.lit(seed))})
    )
    fields = ("part", "size", "key", "id", "row_key", "base", "source_size", "target", "many")
    kept = ("id", "row_key", "size", "source_size", "target", "many")
    whole = (F.col("part") == 0) | (F.col("size") == 0)
    chance = F.when(drawn(F.col("key"), F.lit("alone")) < F.col("part"), 1).otherwise(0)
    results = [due.filter(whole).select(*kept, (F.col("base") + chance).alias("copies"))]
    open_rows = due.filter(~whole).select("source", "documents", *fields)
    counted = targets.agg(F.max("documents")).first()[0] or 0
    level = 0
    while True:
        last = counted <= group
        groups = F.ceil(F.col("documents") / group)
        # Large documents meet first: what is left at the end is small.
        gathered = open_rows.groupBy("source", "documents", F.pmod(F.xxhash64("key", F.lit(level)), groups).alias("_group")).agg(
            F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("_order"), "key", "row_key", F.struct(*fields).alias("row"))))["row"].alias("members")
        )
        folded = written(gathered.select("source", F.ceil(F.col("documents") / group).alias("documents"), pivoted(F.col("members"), seed + level).alias("out")), "pivots")
        done = folded.select(F.explode("out.done").alias("row")).select(
            *(f"row.{c}" for c in kept), (F.col("row.base") + F.col("row.part").cast("int")).alias("copies")
        )
        results.append(done)
        rest = folded.filter(F.col("out.rest").isNotNull())
        if last:
            nearest = F.when(F.col("out.rest.part") >= 0.5, 1).otherwise(0)
            results.append(
                rest.select(*(f"out.rest.{c}" for c in kept), (F.col("out.rest.base") + nearest).alias("copies"))
            )
            break
        open_rows = rest.select("source", "documents", "out.rest.*")
        counted = -(-counted // group)
        level += 1
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found


def copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
           weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """(id, row_key, size, source_size, target, copies) of every row.

    ``copies`` is a whole number up to ``most``. The words taken of a source differ from its target by at most half the
    size of one document. Null texts and texts without words have size 0; they are copied by chance, each on its own,
    as they weigh nothing. Null ids and sources are ids and sources like others. Draws depend on ids, texts and
    ``seed`` alone; repeated rows are interchangeable, and divide what they take together.
    """
    found = taken(docs, id_col, source_col, text_col, weights, most, seed, group)
    # A row for each repeat, in pieces, so that no array is as long as their number.
    pieces = found.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1, F.lit(REPEATS_AT_ONCE).cast("long"))))
    each = pieces.withColumn("_place", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + REPEATS_AT_ONCE, F.col("many")) - 1)))
    return each.select(F.col("id").alias(id_col), "row_key", "size", "source_size", "target", _own(F.col("_place"), F.col("copies"), F.col("many")).alias("copies"))


def _own(place: Column, together: Column, many: Column) -> Column:
    """What the repeat at ``place``, from 0, has of what ``many`` of them take together."""
    return (F.floor(together / many) + F.when(place < together % many, 1).otherwise(0)).cast("int")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
          weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; names that begin with ``_mix_`` are the operator's own."""
    found = taken(docs, id_col, source_col, text_col, weights, most, seed, group)
    found = written(found.select(F.col("row_key").alias("_mix_key"), F.col("many").alias("_mix_many"), F.col("copies").alias("_mix_all")), "mix")
    met = docs.withColumn("_mix_key", row_key(id_col, source_col, text_col)).join(found, "_mix_key")
    several = met.filter("_mix_many = 1").withColumn("_mix_times", F.col("_mix_all").cast("int"))
    if found.filter("_mix_many > 1").limit(1).count():
        # Repeats are numbered inside the parts of a table, and parts by their counts: no task holds all of one row.
        repeated = written(met.filter("_mix_many > 1").withColumn("_mix_id", F.monotonically_increasing_id()), "repeats")
        repeated = repeated.withColumn("_mix_part", F.shiftright("_mix_id", 33))
        parts = repeated.groupBy("_mix_key", "_mix_part").agg(F.count(F.lit(1)).alias("_mix_rows"))
        parts = parts.withColumn("_mix_before", F.sum("_mix_rows").over(Window.partitionBy("_mix_key").orderBy("_mix_part")) - F.col("_mix_rows"))
        inside = F.row_number().over(Window.partitionBy("_mix_key", "_mix_part").orderBy("_mix_id")) - 1
        repeated = repeated.withColumn("_mix_inside", inside).join(parts, ["_mix_key", "_mix_part"])
        times = _own(F.col("_mix_before") + F.col("_mix_inside"), F.col("_mix_all"), F.col("_mix_many"))
        several = several.unionByName(repeated.withColumn("_mix_times", times).select(*several.columns))
    several = several.filter("_mix_times > 0")
    return several.withColumn("_mix_time", F.explode(F.sequence(F.lit(1), F.col("_mix_times")))).select(*docs.columns)
