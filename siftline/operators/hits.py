"""Alignment hits: contig classes, manifest join, per-contig aggregates, best hits.

Every argmax is ``min(struct)``, ordered so that the smallest struct wins. A fragment
has few mappings on a contig, so mappings are not combined before they move: one
exchange by fragment serves the per-contig and the per-fragment aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline import labels as L
from siftline.functions.sequence import LONGEST_CODE, kmer_codes, reverse_complement
from siftline.tuning import broadcast_if_small, dealt

INT_MIN, INT_MAX = -(2**31), 2**31 - 1
# Fixed value: score contributed by a mate without an alignment score.
MISSING_MATE_SCORE = -(2**31) // 4

# Positions of a piece of a sequence.
PIECE = 512

TARGET_COLUMNS = ("accession", "group", "taxid", "virus_name", "genome_length")


def _normalized(value: Column) -> Column:
    return F.translate(F.lower(F.trim(value)), "_ ", "--")


def _class_of(value: Column, host, virus, decoy) -> Column:
    return (
        F.when(value.isin(*host), "host").when(value.isin(*virus), "virus").when(value.isin(*decoy), "decoy")
    )


def contig_class(group: Column, source_type: Column) -> tuple[Column, Column]:
    """(class, violation); exactly one of the two is null."""
    by_group = _class_of(_normalized(group), L.HOST_GROUPS, L.VIRUS_GROUPS, L.DECOY_GROUPS)
    by_source = _class_of(
        _normalized(source_type), L.HOST_SOURCE_TYPES, L.VIRUS_SOURCE_TYPES, L.DECOY_SOURCE_TYPES
    )
    conflict = by_group.isNotNull() & by_source.isNotNull() & (by_group != by_source)
    known = F.coalesce(by_group, by_source)
    violation = F.when(conflict, "conflicting_class").when(known.isNull(), "unclassified")
    return F.when(~F.coalesce(conflict, F.lit(False)), known), violation


def classify_contigs(manifest: DataFrame) -> DataFrame:
    """Add ``class`` and ``violation`` (conflict, unclassified or duplicate contig)."""
    klass, violation = contig_class(F.col("group"), F.col("source_type"))
    copies = F.count(F.lit(1)).over(Window.partitionBy("contig"))
    return (
        manifest.withColumn("_n", copies)
        .withColumn("class", klass)
        .withColumn("violation", F.coalesce(violation, F.when(F.col("_n") > 1, "duplicate_contig")))
        .drop("_n")
    )


def usable_contigs(manifest: DataFrame) -> DataFrame:
    """Classified, violation-free contigs, hinted for broadcast when their number allows.

    The size is checked once, here; joins with selections of the result keep the hint.
    """
    return broadcast_if_small(classify_contigs(manifest).filter("violation IS NULL").drop("violation"))


def attach_manifest(hits: DataFrame, classified: DataFrame, columns=("class", "accession", "group")) -> DataFrame:
    """Left join of rows to their contig; an unknown contig leaves ``class`` null.

    Works on mappings and, more cheaply, on the per-contig aggregates.
    """
    return hits.join(classified.select("contig", *columns), "contig", "left")


def unknown_contig_hits(hits: DataFrame, classified: DataFrame) -> DataFrame:
    """Hits on contigs that the manifest does not describe."""
    return hits.join(classified.select("contig"), "contig", "left_anti")


def rejected_hits(hits: DataFrame, classified: DataFrame) -> DataFrame:
    """(sample_id, contig, problem, hits) of hits that no usable contig takes.

    ``classified`` has every contig with its ``violation``; a contig of another name is ``unknown_contig``.
    """
    contigs = classified.groupBy("contig").agg(F.max("violation").alias("violation"), F.lit(True).alias("_known"))
    counted = hits.filter("contig IS NOT NULL").groupBy("sample_id", "contig").agg(F.count(F.lit(1)).alias("hits"))
    problem = F.when(F.col("_known").isNull(), "unknown_contig").otherwise(F.col("violation"))
    return counted.join(contigs, "contig", "left").withColumn("problem", problem).filter("problem IS NOT NULL").select(
        "sample_id", "contig", "problem", "hits"
    )


def _mapping_order() -> Column:
    """Preference among mappings; the smallest struct is the best mapping."""
    return F.struct(
        (~F.col("is_primary")).cast("int").alias("not_primary"),
        F.col("is_supplementary").cast("int").alias("supplementary"),
        (-F.col("mapq").cast("bigint")).alias("mapq_desc"),
        (-F.coalesce(F.col("as_score"), F.lit(INT_MIN)).cast("bigint")).alias("as_desc"),
        F.coalesce(F.col("nm"), F.lit(INT_MAX)).alias("nm_asc"),
        F.col("segment_id"),
        F.col("target_start"),
        F.col("target_end"),
        F.col("as_score"),
        F.col("nm"),
    )


def aggregate_hits(hits: DataFrame, carry=()) -> DataFrame:
    """One row per (sample, fragment, contig) with per-mate evidence and the best mapping.

    ``carry`` columns are constant per fragment. Mappings move once, to their fragment;
    every later step of a fragment finds them together. The manifest joins afterwards,
    on fewer rows, so that mappings move without its columns. Mappings of sampled fragments
    come with ``carry`` and from a join, and are not counted for their move.
    """
    used = ("contig", "mate", "mapq", "as_score", "nm", "is_primary", "is_supplementary", "segment_id", "target_start", "target_end")
    hits = hits.select("sample_id", "fragment_key", *carry, *used)
    hits = hits.repartition("sample_id", "fragment_key") if carry else dealt(hits, "sample_id", "fragment_key")
    mate1, mate2 = F.col("mate") == 1, F.col("mate") == 2
    valid = (F.col("target_start") >= 0) & (F.col("target_end") >= F.col("target_start"))
    start, end = F.min(F.when(valid, F.col("target_start"))), F.max(F.when(valid, F.col("target_end")))
    r1, r2 = F.max(mate1), F.max(mate2)
    return hits.groupBy("sample_id", "fragment_key", *carry, "contig").agg(
        r1.alias("r1_mapped"),
        r2.alias("r2_mapped"),
        (r1 & r2).alias("pair_consistent"),
        F.coalesce(F.max(F.when(mate1, F.col("mapq"))), F.lit(0)).alias("r1_best_mapq"),
        F.coalesce(F.max(F.when(mate2, F.col("mapq"))), F.lit(0)).alias("r2_best_mapq"),
        F.max(F.when(mate1, F.col("as_score"))).alias("r1_best_as"),
        F.max(F.when(mate2, F.col("as_score"))).alias("r2_best_as"),
        F.count_if("is_primary").alias("primary_supports"),
        F.count_if("is_supplementary").alias("supplementary_supports"),
        F.max(~F.col("is_primary") | F.col("is_supplementary")).alias("has_secondary"),
        F.coalesce(start, F.lit(0)).cast("bigint").alias("reference_start"),
        F.coalesce(end, F.lit(0)).cast("bigint").alias("reference_end"),
        F.min(_mapping_order()).alias("best"),
    )


def _contig_order() -> list[Column]:
    """Preference among a fragment's contigs of one class, as leading struct fields."""
    score = lambda name: F.coalesce(F.col(name).cast("bigint"), F.lit(MISSING_MATE_SCORE).cast("bigint"))
    mates = F.col("r1_mapped").cast("int") + F.col("r2_mapped").cast("int")
    mapping = ("not_primary", "supplementary", "mapq_desc", "as_desc", "nm_asc", "segment_id", "target_start", "target_end")
    return [
        # Two mapped mates are what makes a pair consistent, so one field orders both.
        (-mates).alias("mates_desc"),
        (-F.col("primary_supports")).alias("primary_desc"),
        F.col("supplementary_supports"),
        (-(score("r1_best_as") + score("r2_best_as"))).alias("combined_as_desc"),
        (-(F.col("r1_best_mapq") + F.col("r2_best_mapq"))).alias("combined_mapq_desc"),
        *[F.col(f"best.{name}").alias(name) for name in mapping],
        F.col("contig"),
    ]


def _hit_payload() -> list[Column]:
    """What a hit carries beyond its order fields."""
    return [
        F.col("best.as_score").alias("as_score"),
        F.col("best.nm").alias("nm"),
        F.col("reference_start"),
        F.col("reference_end"),
        F.col("accession"),
        F.col("group"),
    ]


def _as_hit(name: str) -> Column:
    """The hit struct behind the winning order struct; null without a hit."""
    win = F.col(name)
    derived = {
        "mapq": (-win["mapq_desc"]).cast("int"),
        "is_primary": win["not_primary"] == 0,
        "is_supplementary": win["supplementary"] == 1,
        "pair_consistent": win["mates_desc"] == -2,
    }
    return F.when(win.isNotNull(), F.struct(*[derived.get(f, win[f]).alias(f) for f in HIT_FIELDS]))


HIT_FIELDS = (
    "contig",
    "mapq",
    "as_score",
    "nm",
    "is_primary",
    "is_supplementary",
    "pair_consistent",
    "reference_start",
    "reference_end",
    "accession",
    "group",
)


def best_hits(contigs: DataFrame, carry=()) -> DataFrame:
    """One row per fragment: best host hit, best virus hit, and secondary virus contigs.

    The secondary list holds distinct contigs, so its length is bounded by the panel.
    ``carry`` columns are constant per fragment and pass through.
    """
    candidate = F.struct(*_contig_order(), *_hit_payload())
    secondary_virus = (F.col("class") == "virus") & F.col("has_secondary")
    grouped = contigs.groupBy("sample_id", "fragment_key", *carry).agg(
        F.min(F.when(F.col("class") == "host", candidate)).alias("_host"),
        F.min(F.when(F.col("class") == "virus", candidate)).alias("_virus"),
        F.coalesce(F.max(F.when(F.col("class").isNotNull(), F.col("has_secondary"))), F.lit(False)).alias("has_secondary"),
        F.collect_set(
            F.when(secondary_virus, F.struct("contig", "accession", "group"))
        ).alias("secondary_virus"),
    )
    return grouped.select(
        "sample_id",
        "fragment_key",
        *carry,
        _as_hit("_host").alias("host"),
        _as_hit("_virus").alias("virus"),
        "has_secondary",
        "secondary_virus",
    )


def secondary_hits(hits: DataFrame, classified: DataFrame) -> DataFrame:
    """Secondary or supplementary mappings on classified contigs, with their contig's pair flags, as rows.

    Rows rather than one list per fragment: the number of mappings is unbounded.
    Evidence order is contig, primary first, not supplementary first, MAPQ and AS
    descending (missing AS last), NM ascending (missing NM last). Mappings move once, to
    their fragment; a window there gives the flags, and what is left meets the manifest.
    """
    used = ("contig", "mate", "mapq", "as_score", "nm", "is_primary", "is_supplementary", "target_start", "target_end")
    named = hits.select("sample_id", "fragment_key", *used).dropna(subset=["sample_id", "fragment_key", "contig"])
    contig = Window.partitionBy("sample_id", "fragment_key", "contig")
    flags = {f"r{mate}_mapped": F.max(F.col("mate") == mate).over(contig) for mate in (1, 2)}
    flagged = dealt(named, "sample_id", "fragment_key").withColumns(flags).withColumn("pair_consistent", F.col("r1_mapped") & F.col("r2_mapped"))
    valid = (F.col("target_start") >= 0) & (F.col("target_end") >= F.col("target_start"))
    return (
        attach_manifest(flagged.filter(~F.col("is_primary") | F.col("is_supplementary")), classified, ("class",))
        .filter("class IS NOT NULL")
        .select(
            "sample_id",
            "fragment_key",
            "contig",
            "class",
            "mapq",
            "as_score",
            "nm",
            "is_primary",
            "is_supplementary",
            "r1_mapped",
            "r2_mapped",
            "pair_consistent",
            F.when(valid, F.col("target_start")).otherwise(0).alias("reference_start"),
            F.when(valid, F.col("target_end")).otherwise(0).alias("reference_end"),
        )
    )


def _exploded_seeds(rows: DataFrame, seq: str, k: int, pos: str, reverse: bool = False) -> DataFrame:
    """One row per position whose ``kmer`` has bases only, by way of pieces that overlap by k - 1: no array is as long as a
    contig, and k-mers are taken inside a piece. They are longs, or texts where they are too long for that."""
    last = F.length(seq) - k
    pieces = (
        rows.filter(last >= 0)
        .withColumn("_from", F.explode(F.sequence(F.lit(0), last, F.lit(PIECE))))
        .withColumn("_piece", F.substring(F.col(seq), F.col("_from") + 1, F.lit(PIECE + k - 1)))
    )
    kept = [c for c in pieces.columns if c != "_piece"]
    if k <= LONGEST_CODE:
        seeds = pieces.select(*kept, F.posexplode(kmer_codes(F.col("_piece"), k, reverse)).alias("_at", "kmer")).filter("kmer IS NOT NULL")
    else:
        text = F.translate(F.substring("_piece", F.col("_at") + 1, F.lit(k)), "acgt", "ACGT")
        seeds = pieces.withColumn("_at", F.explode(F.sequence(F.lit(0), F.length("_piece") - k))).select(*kept, "_at", text.alias("kmer"))
        seeds = seeds.filter(F.col("kmer").rlike(r"^[ACGT]+\z")).withColumn("kmer", reverse_complement(F.col("kmer")) if reverse else F.col("kmer"))
    return seeds.withColumn(pos, F.col("_from") + F.col("_at")).drop("_from", "_at")


def seed_vote_hits(
    fragments: DataFrame, contigs: DataFrame, k: int = 16, min_votes: int = 2, diagonal_bin: int = 16
) -> DataFrame:
    """Competitive assignment by shared k-mers: votes per (mate, contig, strand, diagonal bin).

    A stand-in for base-level alignment, in the hit schema: the score is the number
    of shared seeds and NM is unknown. Seeds with ambiguous bases are skipped, every
    other seed votes. Within a mate the strongest diagonal is primary.
    """
    # Reads move once, to their fragment; the seeds and votes they are multiplied into stay there.
    mates = fragments.repartition("sample_id", "fragment_key").select(
        "sample_id",
        "fragment_key",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("mate"), F.col("r1_seq").alias("seq")),
                F.struct(F.lit(2).alias("mate"), F.col("r2_seq").alias("seq")),
            )
        ).alias("m"),
    ).select("sample_id", "fragment_key", "m.mate", "m.seq")
    read_seeds = _exploded_seeds(mates, "seq", k, "read_pos").select(
        "sample_id", "fragment_key", "mate", "kmer", "read_pos", F.length("seq").alias("read_length")
    )
    # Only the panel is oriented both ways.
    panel_seeds = None
    for strand in ("+", "-"):
        seeds = _exploded_seeds(contigs.select("contig", F.col("sequence").alias("seq")), "seq", k, "contig_pos", strand == "-")
        seeds = seeds.select("contig", "kmer", "contig_pos", F.lit(strand).alias("strand"))
        panel_seeds = seeds if panel_seeds is None else panel_seeds.unionByName(seeds)
    oriented = F.when(F.col("strand") == "+", F.col("read_pos")).otherwise(
        F.col("read_length") - k - F.col("read_pos")
    )
    votes = (
        read_seeds.join(broadcast_if_small(panel_seeds, 2_000_000), "kmer")
        .withColumn("diagonal", F.floor((F.col("contig_pos") - oriented) / diagonal_bin))
        .groupBy("sample_id", "fragment_key", "mate", "contig", "strand", "diagonal")
        .agg(
            F.count(F.lit(1)).cast("int").alias("votes"),
            F.min("contig_pos").cast("bigint").alias("target_start"),
            (F.max("contig_pos") + k).cast("bigint").alias("target_end"),
        )
        .filter(F.col("votes") >= min_votes)
    )
    # Strongest diagonal per mate, by windows over its placements: they are together, and a join would vote twice.
    mate = Window.partitionBy("sample_id", "fragment_key", "mate")
    order = F.row_number().over(mate.orderBy(F.desc("votes"), "contig", "strand", "diagonal"))
    placed = votes.withColumns({"_order": order, "placements": F.count(F.lit(1)).over(mate)})
    return placed.select(
        "sample_id",
        "fragment_key",
        "mate",
        "contig",
        F.when(F.col("placements") == 1, 60).otherwise(F.least(F.lit(60), F.floor(F.lit(60) / F.col("placements")))).cast("int").alias("mapq"),
        F.col("votes").alias("as_score"),
        F.lit(None).cast("int").alias("nm"),
        (F.col("_order") == 1).alias("is_primary"),
        F.lit(False).alias("is_supplementary"),
        F.lit(0).alias("segment_id"),
        "target_start",
        "target_end",
        "strand",
    )
