"""Candidate aggregation at accession and group level, over nested rounds.

Interval results are computed once per (sample, round, contig): a contig belongs
to one accession and one group, so both levels are sums over contigs. Before any
list is built, intervals are reduced map-side to the furthest end per start (all a
union needs) and the latest start per end (all earliest-end scheduling needs), so
lists hold at most one entry per contig position and entry round, however many
fragments pile up on a contig. Rounds are told apart on these lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline import labels as L
from siftline.functions import stats

LEVELS = ("accession", "group")
EVIDENCE = "struct<kind:string,contig:string,pos:bigint,val:bigint>"


def _evidence(kind: str, contig: Column, pos: Column | None = None, val: Column | None = None) -> Column:
    none = F.lit(None).cast("bigint")
    return F.struct(
        F.lit(kind).alias("kind"),
        contig.cast("string").alias("contig"),
        (none if pos is None else pos.cast("bigint")).alias("pos"),
        (none if val is None else val.cast("bigint")).alias("val"),
    )


def _first_contigs(hits: Column, level: str) -> Column:
    """One contig per candidate of an ambiguous fragment: the best hit's, else the first by name."""
    ids = F.array_distinct(F.transform(hits, lambda h: h[level]))
    several = F.transform(ids, lambda i: F.array_min(F.filter(hits, lambda h: h[level] == i))["contig"])
    return F.when(F.size(hits) == 1, F.array(hits[0]["contig"])).otherwise(several)


def fragment_evidence(adjudicated: DataFrame, round_col: str | None = None) -> DataFrame:
    """Explode each fragment into its additive contributions.

    Kinds: ``s`` sampled, ``v`` accepted, ``u`` union interval (start -> end), ``g``
    schedule interval (end -> start), ``a``/``b`` ambiguous accession / group support.
    """
    virus, klass = F.col("virus"), F.col("fragment_class")
    none = F.array().cast(f"array<{EVIDENCE}>")
    start, end = virus["reference_start"], virus["reference_end"]
    hit = lambda rank, h: F.struct(
        F.lit(rank).alias("rank"),
        h["contig"].alias("contig"),
        h["accession"].alias("accession"),
        h["group"].alias("group"),
    )
    no_hits = F.array().cast("array<struct<rank:int,contig:string,accession:string,group:string>>")
    hits = F.concat(
        F.when(virus.isNotNull(), F.array(hit(0, virus))).otherwise(no_hits),
        F.transform("secondary_virus", lambda h: hit(1, h)),
    )
    support = F.flatten(
        F.transform(
            F.array(hits),
            lambda bound: F.concat(
                F.transform(_first_contigs(bound, "accession"), lambda c: _evidence("a", c)),
                F.transform(_first_contigs(bound, "group"), lambda c: _evidence("b", c)),
            ),
        )
    )
    parts = F.concat(
        F.array(_evidence("s", F.lit(None))),
        F.when(klass == "virus", F.array(_evidence("v", virus["contig"]))).otherwise(none),
        F.when(
            (klass == "virus") & (end > start),
            F.array(
                _evidence("u", virus["contig"], start, end),
                _evidence("g", virus["contig"], end, start),
            ),
        ).otherwise(none),
        F.when(klass == "ambiguous", support).otherwise(none),
    )
    entry = F.lit(1) if round_col is None else F.col(round_col)
    return adjudicated.select("sample_id", entry.cast("int").alias("entry_round"), F.explode(parts).alias("e")).select(
        "sample_id", "entry_round", "e.*"
    )


def reduce_evidence(evidence: DataFrame) -> DataFrame:
    """Map-side combinable reduction of the contributions."""
    return evidence.groupBy("sample_id", "entry_round", "kind", "contig", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.max("val").alias("val")
    )


def max_nonoverlapping(ends: Column) -> Column:
    """Most disjoint half-open intervals, from a sorted array of (pos=end, val=start)."""
    state = F.struct(F.lit(-1).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("count"))

    def step(acc, item):
        free = item["val"] >= acc["last"]
        return F.struct(
            F.when(free, item["pos"]).otherwise(acc["last"]).alias("last"),
            (acc["count"] + free.cast("bigint")).alias("count"),
        )

    return F.aggregate(ends, state, step, lambda acc: acc["count"])


def merged_coverage(starts: Column) -> Column:
    """(blocks, bases) of the union, from a sorted array of (pos=start, val=end).

    Overlap is strict: touching intervals stay separate blocks.
    """
    zero = F.lit(0).cast("bigint")
    state = F.struct(F.lit(-1).cast("bigint").alias("reach"), zero.alias("blocks"), zero.alias("bases"))

    def step(acc, item):
        joins = item["pos"] < acc["reach"]
        gained = item["val"] - F.when(joins, F.least(acc["reach"], item["val"])).otherwise(item["pos"])
        return F.struct(
            F.greatest(acc["reach"], item["val"]).alias("reach"),
            (acc["blocks"] + (~joins).cast("bigint")).alias("blocks"),
            (acc["bases"] + gained).alias("bases"),
        )

    return F.aggregate(
        starts, state, step, lambda acc: F.struct(acc["blocks"].alias("blocks"), acc["bases"].alias("bases"))
    )


def merged_blocks(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Union blocks as rows (``block_start``, ``block_end``) of half-open (start, end) intervals.

    Reduced to one row per start first, so a partition holds at most one row per position.
    """
    reach = intervals.filter("end > start").groupBy(*by, "start").agg(F.max("end").alias("end"))
    ordered = Window.partitionBy(*by).orderBy("start")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)
    island = F.sum("_opened").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        reach.withColumn("_opened", opened)
        .withColumn("block", island)
        .groupBy(*by, "block")
        .agg(F.min("start").alias("block_start"), F.max("end").alias("block_end"))
    )


def cumulative_rounds(reduced: DataFrame, rounds: int, samples: DataFrame | None = None) -> DataFrame:
    """One row per (sample, round, contig), each round covering all entries up to it.

    The row with a null contig stands for the look itself and carries its sampled
    count, so looks without candidates survive. ``samples`` lists samples that may
    have no fragments at all.
    """
    if samples is not None:
        empty = samples.select("sample_id").distinct().selectExpr(
            "sample_id", "1 AS entry_round", "'s' AS kind", "CAST(NULL AS STRING) AS contig",
            "CAST(NULL AS BIGINT) AS pos", "0L AS n", "CAST(NULL AS BIGINT) AS val",
        )
        reduced = reduced.unionByName(empty)
    kind = F.col("kind")
    points = lambda name: F.sort_array(F.collect_list(F.when(kind == name, F.struct("pos", "val", "entry_round"))))
    counts = F.collect_list(F.when(F.col("pos").isNull(), F.struct("entry_round", "kind", "n")))
    # Evidence moves once, to its contig; rounds multiply contigs, not evidence.
    gathered = reduced.groupBy("sample_id", "contig").agg(
        counts.alias("counts"), points("u").alias("all_starts"), points("g").alias("all_ends"), F.min("entry_round").alias("first")
    )
    looks = gathered.withColumn("round", F.explode(F.sequence("first", F.lit(rounds))))
    entered = lambda rows: F.filter(rows, lambda x: x["entry_round"] <= F.col("round"))
    zero = F.lit(0).cast("bigint")
    total = lambda name: F.aggregate("counts", zero, lambda acc, x: acc + F.when((x["kind"] == name) & (x["entry_round"] <= F.col("round")), x["n"]).otherwise(0))
    grouped = looks.select(
        "sample_id", "round", "contig",
        total("s").alias("sampled"), total("v").alias("accepted"),
        total("a").alias("ambiguous_accession"), total("b").alias("ambiguous_group"),
        entered(F.col("all_starts")).alias("starts"), entered(F.col("all_ends")).alias("ends"),
    )
    return grouped.withColumn("union", merged_coverage(F.col("starts"))).select(
        "sample_id",
        "round",
        "contig",
        F.max("sampled").over(Window.partitionBy("sample_id", "round")).alias("total_sampled_fragments"),
        "accepted",
        "ambiguous_accession",
        "ambiguous_group",
        max_nonoverlapping(F.col("ends")).alias("nonoverlap"),
        F.col("union.blocks").alias("blocks"),
        F.col("union.bases").alias("covered"),
    )


def evidence_strength(nonoverlap: Column, breadth: Column) -> Column:
    return (
        F.when((nonoverlap >= 3) & (breadth > 0), "high")
        .when((nonoverlap >= 2) | (breadth > 0), "medium")
        .otherwise("low")
    )


def reconcile_identity(level: Column, entity: Column) -> tuple[Column, Column]:
    """(virus_name, taxid) of a candidate from its contigs' manifest rows.

    Groups of several names take the group key; groups of several taxids take 0.
    """
    name = F.when(
        (level == "group") & (F.min("virus_name") != F.max("virus_name")), entity
    ).otherwise(F.min("virus_name"))
    taxid = F.when((level == "group") & (F.min("taxid") != F.max("taxid")), 0).otherwise(F.min("taxid"))
    return name, taxid.cast("bigint")


def aggregate_candidates(contigs: DataFrame, classified: DataFrame) -> DataFrame:
    """Candidates at both levels, plus one marker row (null level) per look."""
    targets = classified.filter("class = 'virus'").select(
        "contig", "accession", "group", "taxid", "virus_name", "genome_length"
    )
    joined = contigs.join(targets, "contig", "left")

    def at(level: str) -> Column:
        ambiguous = F.col(f"ambiguous_{level}")
        return F.struct(
            F.lit(level).alias("aggregation_level"),
            F.col(level).alias("accession_or_group"),
            ambiguous.alias("ambiguous"),
            ((F.col("accepted") > 0) | (ambiguous > 0)).alias("seen"),
        )

    marker = F.struct(
        F.lit(None).cast("string").alias("aggregation_level"),
        F.lit(None).cast("string").alias("accession_or_group"),
        F.lit(0).cast("bigint").alias("ambiguous"),
        F.lit(True).alias("seen"),
    )
    rows = joined.withColumn(
        "c", F.explode(F.when(F.col("contig").isNull(), F.array(marker)).otherwise(F.array(*map(at, LEVELS))))
    ).filter("c.seen")
    level, entity = F.col("aggregation_level"), F.col("accession_or_group")
    name, taxid = reconcile_identity(level, entity)
    return (
        rows.select("*", "c.aggregation_level", "c.accession_or_group", "c.ambiguous")
        .groupBy("sample_id", "round", "total_sampled_fragments", "aggregation_level", "accession_or_group")
        .agg(
            name.alias("virus_name"),
            taxid.alias("taxid"),
            F.sum("accepted").alias("accepted_fragments"),
            F.sum("nonoverlap").alias("nonoverlap_fragments"),
            F.sum("blocks").alias("coverage_interval_blocks"),
            F.sum("covered").alias("covered_bases"),
            F.coalesce(F.sum("genome_length"), F.lit(0)).alias("genome_length"),
            F.sum("ambiguous").alias("ambiguous_fragments"),
        )
    )


def to_calls(candidates: DataFrame) -> DataFrame:
    """Complete call rows: fractions, bounds, labels and base reasons. Markers pass through."""
    k, n = "accepted_fragments", "total_sampled_fragments"
    level = F.col("aggregation_level")
    low, high = stats.wilson_bounds(k, n)
    breadth = F.when(F.col("genome_length") > 0, F.col("covered_bases") / F.col("genome_length")).otherwise(0.0)
    reason = lambda name, value: F.concat(F.lit(name + "="), value.cast("string"))
    base = candidates.withColumn("breadth", breadth).withColumn("raw_fraction", stats.fraction(k, n))
    return base.select(
        "*",
        F.col("raw_fraction").alias("unique_fraction"),
        low.alias("fraction_ci_95_low"),
        high.alias("fraction_ci_95_high"),
        F.when(level.isNotNull(), stats.clopper_pearson_upper(k, n)).alias("clopper_pearson_upper"),
        F.lit(L.NONOVERLAP_ALGORITHM).alias("nonoverlap_fragments_algorithm"),
        F.lit(L.ACCEPTED_FRACTION_LABEL).alias("accepted_fraction_label"),
        F.lit(L.UNIQUE_FRACTION_LABEL).alias("unique_fraction_label"),
        F.lit(L.DENOMINATOR_SOURCE).alias("fraction_denominator_source"),
        F.lit(0.0).alias("background_ratio"),
        level.alias("multiplicity_family"),
        F.when(level == "group", "not_applicable").otherwise("high").alias("accession_resolution"),
        F.lit("indeterminate").alias("decision"),
        evidence_strength(F.col("nonoverlap_fragments"), F.col("breadth")).alias("evidence_strength"),
        F.array(
            reason("aggregation_level", level),
            reason("multiplicity_family", level),
            reason("coverage_interval_blocks", F.col("coverage_interval_blocks")),
            F.lit("nonoverlap_fragments_algorithm=" + L.NONOVERLAP_ALGORITHM),
            F.lit("accepted_fraction_label=" + L.ACCEPTED_FRACTION_LABEL),
            F.lit("unique_fraction_label=" + L.UNIQUE_FRACTION_LABEL),
            reason(n, F.col(n)),
            F.lit("fraction_denominator_source=" + L.DENOMINATOR_SOURCE),
            F.lit(L.CI_REASON_PREFIX + L.CI_LABEL),
            F.lit(L.CONTROL_POLICY),
            F.lit(L.PENDING_DECISION),
        ).alias("decision_reasons"),
    )


def only_candidates(calls: DataFrame) -> DataFrame:
    """Drop the look markers."""
    return calls.filter("aggregation_level IS NOT NULL")


def candidate_calls(
    adjudicated: DataFrame,
    classified: DataFrame,
    rounds: int = 1,
    round_col: str | None = None,
    samples: DataFrame | None = None,
) -> DataFrame:
    """Adjudicated fragments to call rows (with look markers), for every round at once."""
    reduced = reduce_evidence(fragment_evidence(adjudicated, round_col))
    return to_calls(aggregate_candidates(cumulative_rounds(reduced, rounds, samples), classified))


def rank_candidates(calls: DataFrame) -> DataFrame:
    """Add the 1-based ``candidate_rank`` per (sample, round, level); a panel bounds each partition."""
    order = Window.partitionBy("sample_id", "round", "aggregation_level").orderBy(
        F.desc("accepted_fragments"), F.desc("nonoverlap_fragments"), F.desc("breadth"), F.asc("accession_or_group")
    )
    return calls.withColumn("candidate_rank", F.row_number().over(order))


def accepted_support(adjudicated: DataFrame, level: str = "accession") -> DataFrame:
    """Accepted fragments per candidate."""
    return (
        adjudicated.filter("fragment_class = 'virus'")
        .groupBy("sample_id", F.col(f"virus.{level}").alias("accession_or_group"))
        .agg(F.count(F.lit(1)).alias("accepted_fragments"))
    )


def ambiguous_support(adjudicated: DataFrame, level: str = "accession") -> DataFrame:
    """Ambiguous fragments per candidate, each fragment once per candidate."""
    ids = F.array_distinct(
        F.concat(
            F.when(F.col("virus").isNotNull(), F.array(f"virus.{level}")).otherwise(F.array().cast("array<string>")),
            F.transform("secondary_virus", lambda h: h[level]),
        )
    )
    return (
        adjudicated.filter("fragment_class = 'ambiguous'")
        .select("sample_id", F.explode(ids).alias("accession_or_group"))
        .groupBy("sample_id", "accession_or_group")
        .agg(F.count(F.lit(1)).alias("ambiguous_fragments"))
    )


def candidate_violations(manifest: DataFrame, adjudicated: DataFrame | None = None) -> DataFrame:
    """Inconsistent identities and evidence, as (check, entity, detail) rows."""
    distinct = lambda key, value: (
        manifest.groupBy(key)
        .agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        .filter("lo <> hi")
        .select(
            F.lit(f"conflicting_{value}").alias("check"),
            F.col(key).alias("entity"),
            F.concat_ws(" vs ", F.col("lo").cast("string"), F.col("hi").cast("string")).alias("detail"),
        )
    )
    blank = lambda level: manifest.filter(F.trim(F.coalesce(F.col(level), F.lit(""))) == "").select(
        F.lit(f"empty_{level}_key").alias("check"), F.col("contig").alias("entity"), F.lit("").alias("detail")
    )
    out = (
        distinct("accession", "taxid")
        .unionByName(distinct("accession", "virus_name"))
        .unionByName(distinct("contig", "genome_length"))
        .unionByName(blank("accession"))
        .unionByName(blank("group"))
    )
    if adjudicated is not None:
        fragment = F.concat_ws(":", "sample_id", "fragment_key")
        rows = adjudicated.filter("fragment_class = 'virus'").select(
            F.when(F.col("virus").isNull(), "virus_without_hit")
            .when(F.col("virus.reference_end") < F.col("virus.reference_start"), "inverted_interval")
            .alias("check"),
            fragment.alias("entity"),
            F.coalesce(F.col("virus.contig"), F.lit("")).alias("detail"),
        )
        out = out.unionByName(rows.filter("check IS NOT NULL"))
    return out
