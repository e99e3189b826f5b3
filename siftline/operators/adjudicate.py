"""Fragment adjudication: host, virus, ambiguous or unmapped.

Input rows carry nullable ``host`` and ``virus`` structs from ``best_hits``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.config import FragmentRules


def _present(side: str) -> Column:
    return F.col(side).isNotNull()


def _counting(side: str) -> Column:
    """Primary and not supplementary; false without a hit."""
    hit = F.col(side)
    return F.coalesce(hit["is_primary"] & ~hit["is_supplementary"], F.lit(False))


def as_diff() -> Column:
    virus, host = F.col("virus.as_score"), F.col("host.as_score")
    return F.when(_present("host"), virus - host).otherwise(virus)


def stronger_host() -> Column:
    """A counting host hit scores at least as high; unknown scores never do."""
    higher = F.col("host.as_score") >= F.col("virus.as_score")
    return _counting("host") & F.coalesce(higher, F.lit(False))


def _mapq_ok(rules: FragmentRules) -> Column:
    return F.coalesce(F.col("virus.mapq") >= rules.min_mapq, F.lit(False))


def _as_diff_ok(rules: FragmentRules) -> Column:
    return F.coalesce(as_diff() >= rules.min_as_diff, F.lit(False))


def _nm_ok(rules: FragmentRules) -> Column:
    return F.coalesce(F.col("virus.nm").between(0, rules.max_nm), F.lit(False))


def _pair_ok(rules: FragmentRules) -> Column:
    consistent = F.coalesce(F.col("virus.pair_consistent"), F.lit(False))
    return consistent if rules.require_pair_consistency else _present("virus")


def virus_confident(rules: FragmentRules = FragmentRules(), low_complexity: Column | None = None) -> Column:
    low = F.lit(False) if low_complexity is None else low_complexity
    return (
        _counting("virus")
        & _mapq_ok(rules)
        & _as_diff_ok(rules)
        & _nm_ok(rules)
        & ~low
        & ~stronger_host()
        & _pair_ok(rules)
    )


def fragment_class(rules: FragmentRules = FragmentRules(), low_complexity: Column | None = None) -> Column:
    host, virus = _counting("host"), _counting("virus")
    return (
        F.when(virus_confident(rules, low_complexity), "virus")
        .when(host & (~virus | stronger_host()), "host")
        .when(_present("virus"), "ambiguous")
        .when(host, "host")
        .when(_present("host") | F.col("has_secondary"), "ambiguous")
        .otherwise("unmapped")
    )


def confidence_flags(rules: FragmentRules = FragmentRules(), low_complexity: Column | None = None) -> Column:
    """Ordered audit flags."""
    low = F.lit(False) if low_complexity is None else low_complexity
    virus = _present("virus")

    def side(name: str) -> Column:
        return (
            F.when(_counting(name), f"{name}_primary")
            .when(_present(name), f"{name}_not_primary")
            .otherwise(f"no_{name}_hit")
        )

    def choice(test: Column, yes: str, no: str) -> Column:
        return F.when(virus, F.when(test, yes).otherwise(no))

    score = F.when(as_diff().isNull(), "as_diff_unavailable").otherwise(
        F.when(_as_diff_ok(rules), "as_diff_ok").otherwise("as_diff_below_min")
    )
    unmapped = ~virus & ~_present("host") & ~F.col("has_secondary")
    return F.array_compact(
        F.array(
            F.when(F.col("has_secondary"), "secondary_or_supplementary_evidence_present"),
            side("host"),
            side("virus"),
            choice(_mapq_ok(rules), "mapq_ok", "mapq_below_min"),
            F.when(virus, score),
            choice(_nm_ok(rules), "nm_ok", "nm_above_max_or_unavailable"),
            choice(low, "low_complexity", "not_low_complexity"),
            choice(stronger_host(), "host_stronger_or_equal", "host_not_stronger"),
            choice(_pair_ok(rules), "pair_consistent", "pair_inconsistent"),
            F.when(unmapped, "unmapped"),
        )
    )


def adjudicate(fragments: DataFrame, rules: FragmentRules = FragmentRules(), flags: bool = False) -> DataFrame:
    """Add ``fragment_class`` and ``as_diff``, and on request the flag array."""
    out = fragments.withColumn("fragment_class", fragment_class(rules)).withColumn("as_diff", as_diff())
    return out.withColumn("confidence_flags", confidence_flags(rules)) if flags else out
