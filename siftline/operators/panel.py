"""Reference-panel preparation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layer:
    """Constants of one panel layer. ``None`` means: taken from the header."""

    name: str
    source_type: str
    source_release: str
    taxid: int
    group: str | None = None
    virus_name: str | None = None
    # Host headers may carry the accession as ``AC:<id>``.
    accession_tag: bool = False


# Taxids, groups and source types of the standard layers.
HOST = Layer("host", "host_backbone", "host-release", 9606, "human", "human_background", True)
VIRUS = Layer("virus", "refseq-virus", "virus-release", 10239)
DECOY = Layer("decoy", "decoy-panel", "decoy-release", 32630, "decoy")


def reconcile_manifest(manifest: DataFrame, contigs: DataFrame, name: str = "contig") -> DataFrame:
    """Names missing or repeated on either side, one row per (contig, problem).

    Counting the union replaces a full outer join: one combinable shuffle.
    """
    sides = manifest.select(F.col(name).alias("contig"), F.lit(1).alias("m"), F.lit(0).alias("f")).unionByName(
        contigs.select(F.col(name).alias("contig"), F.lit(0).alias("m"), F.lit(1).alias("f"))
    )
    counted = sides.groupBy("contig").agg(F.sum("m").alias("m"), F.sum("f").alias("f"))
    problems = F.array_compact(
        F.array(
            F.when(F.col("f") == 0, "manifest_only"),
            F.when(F.col("m") == 0, "fasta_only"),
            F.when(F.col("m") > 1, "duplicate_in_manifest"),
            F.when(F.col("f") > 1, "duplicate_in_fasta"),
        )
    )
    return counted.select("contig", F.explode(problems).alias("problem"))


def dedupe_contigs(contigs: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """First record of each (layer, contig) by ordinal."""
    rest = [c for c in contigs.columns if c not in ("layer", "contig", ordinal)]
    first = F.min(F.struct(ordinal, *rest)).alias("s")
    return contigs.groupBy("layer", "contig").agg(first).select("layer", "contig", "s.*")


def exclude_layer(contigs: DataFrame, owner: DataFrame) -> DataFrame:
    """Drop contigs that a higher-priority layer owns."""
    return contigs.join(owner.select("contig"), "contig", "left_anti")


def union_layers(*layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all layers in priority order, contigs that occur more than once)."""
    merged = None
    for priority, layer in enumerate(layers):
        tagged = layer.withColumn("layer_priority", F.lit(priority))
        merged = tagged if merged is None else merged.unionByName(tagged)
    repeated = (
        merged.groupBy("contig")
        .agg(F.count(F.lit(1)).alias("copies"), F.sort_array(F.collect_set("layer")).alias("layers"))
        .filter("copies > 1")
    )
    return merged, repeated


def taxonomy(manifest: DataFrame) -> DataFrame:
    return manifest.select("taxid", F.col("virus_name").alias("name")).distinct()


def _first_token(header: Column) -> Column:
    return F.regexp_extract(header, r"^(\S*)", 1)


def manifest_rows(contigs: DataFrame, layer: Layer) -> DataFrame:
    """Manifest rows from (header, genome_length)."""
    header = F.col("header")
    token = _first_token(header)
    tagged = F.regexp_extract(header, r"AC:(\S+)", 1)
    accession = F.when(tagged != "", tagged).otherwise(token) if layer.accession_tag else token
    remainder = F.regexp_replace(header, r"^\S+\s*", "")
    name = F.when(remainder == "", token).otherwise(remainder)
    return contigs.select(
        token.alias("contig"),
        accession.alias("accession"),
        F.lit(layer.taxid).cast("bigint").alias("taxid"),
        (F.lit(layer.virus_name) if layer.virus_name else name).alias("virus_name"),
        F.lit(None).cast("string").alias("segment"),
        (F.lit(layer.group) if layer.group else accession).alias("group"),
        F.col("genome_length").cast("bigint").alias("genome_length"),
        F.lit(layer.source_release).alias("source_release"),
        F.lit(layer.source_type).alias("source_type"),
        F.array().cast("array<array<bigint>>").alias("masked_regions"),
    )
