"""Registered queries: every operator over whole driver tables, with its SQL.

``QUERIES`` maps a name to (callable, SQL or None). Doubles are rounded to nine
decimals and arrays are joined, so both engines print equal values.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import adapters as A
from siftline.checks import oracle as O
from siftline.checks.settings import CANDIDATE, DECISION, FRAGMENT, FRAGMENT_PAIRED, PLAN, PROFILE, QC, SINGLE_LOOK
from siftline.functions import sequence, stats, text
from siftline.operators import adjudicate, aggregate, decision, hits, qc, sampling
from siftline.plans import screen, sequential
from siftline.tuning import settle, shared_folder

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def register(build):
        QUERIES[name] = (build, sql)
        return build

    return register


def r9(column, name: str | None = None) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, 9).alias(name) if name else F.round(column, 9)


def table(spark, sf, adapter) -> DataFrame:
    return A.spark_sql(spark, sf, adapter)


def classified(spark, sf) -> DataFrame:
    return hits.usable_contigs(table(spark, sf, A.MANIFEST))


def contig_rows(spark, sf) -> DataFrame:
    return hits.attach_manifest(hits.aggregate_hits(table(spark, sf, A.HITS)), classified(spark, sf))


def fragments(spark, sf, rules=FRAGMENT) -> DataFrame:
    return screen.fragment_table(table(spark, sf, A.HITS), classified(spark, sf), rules)


def calls(spark, sf) -> DataFrame:
    return aggregate.only_candidates(
        screen.single_look_calls(table(spark, sf, A.HITS), table(spark, sf, A.MANIFEST), SINGLE_LOOK)
    )


def sampled_fragments(spark, sf) -> DataFrame:
    return sampling.entry_round(table(spark, sf, A.HIT_FRAGMENTS), PLAN)


def look_calls(spark, sf) -> DataFrame:
    return screen.look_calls(
        table(spark, sf, A.HITS), table(spark, sf, A.MANIFEST), sampled_fragments(spark, sf), PROFILE
    )


def evaluated(spark, sf, reasons=False) -> DataFrame:
    return screen.evaluated_looks(look_calls(spark, sf), PROFILE, reasons=reasons)


def looks(spark, sf) -> DataFrame:
    return decision.decide(evaluated(spark, sf), PLAN.look_count, DECISION)


def verdicts(spark, sf) -> DataFrame:
    return qc.qc_verdict(table(spark, sf, A.FRAGMENTS), QC)


# ---- read names and qualities ------------------------------------------------------


@query(
    "normalized_read_names",
    f"""SELECT record_number, sample_id, qname,
        regexp_replace(regexp_extract(qname, '([^ \\t\\n\\f\\r]+)', 1), '/[12]$', '') AS fragment_key
        FROM ({A.plain_sql(A.MATES)}) m""",
)
def normalized_read_names(spark, sf):
    return table(spark, sf, A.MATES).select(
        "record_number", "sample_id", "qname", text.normalize_qname(F.col("qname")).alias("fragment_key")
    )


def _scores_sql(column: str) -> str:
    return f"""CASE WHEN regexp_matches({column}, '[\\x00-\\x20]') THEN ''
             ELSE coalesce(array_to_string(list_transform(string_split({column}, ''), lambda c: CASE WHEN c = '' THEN NULL ELSE ord(c) - 33 END), ' '), '') END"""


# Document text has spaces and line breaks, which Phred text cannot; tabs stay as invalid symbols.
_PHRED_SQL = "replace(replace({c}, ' ', '~'), chr(10), '') AS {c}"


@query(
    "decoded_qualities",
    f"""SELECT sample_id, fragment_key, NOT regexp_matches(r1_qual, '[\\x00-\\x20]') AS r1_valid, NOT regexp_matches(r2_qual, '[\\x00-\\x20]') AS r2_valid,
        {_scores_sql("r1_qual")} AS r1_scores, {_scores_sql("r2_qual")} AS r2_scores
        FROM (SELECT sample_id, fragment_key, {_PHRED_SQL.format(c="r1_qual")}, {_PHRED_SQL.format(c="r2_qual")}
              FROM ({A.plain_sql(A.FRAGMENTS)}) a) f""",
)
def decoded_qualities(spark, sf):
    phred = lambda c: F.replace(F.replace(c, F.lit(" "), F.lit("~")), F.lit("\n"), F.lit(""))
    rows = table(spark, sf, A.FRAGMENTS).withColumns({c: phred(c) for c in ("r1_qual", "r2_qual")})
    scores = lambda c: F.coalesce(F.array_join(text.decode_phred(F.col(c)).cast("array<string>"), " "), F.lit(""))
    return rows.select(
        "sample_id",
        "fragment_key",
        *(text.phred_valid(F.col(f"{m}_qual")).alias(f"{m}_valid") for m in ("r1", "r2")),
        *(scores(f"{m}_qual").alias(f"{m}_scores") for m in ("r1", "r2")),
    )


# ---- read quality ------------------------------------------------------------------


@query(
    "pair_completeness",
    f"SELECT sample_id, fragment_key, length(r1_seq) > 0 AND length(r2_seq) > 0 AS complete FROM ({O.FRAGMENTS}) f",
)
def pair_completeness(spark, sf):
    return table(spark, sf, A.FRAGMENTS).select("sample_id", "fragment_key", qc.pair_complete().alias("complete"))


@query(
    "length_bounds",
    f"SELECT sample_id, fragment_key, {O._LEN1} AS r1_ok, {O._LEN2} AS r2_ok FROM ({O.FRAGMENTS}) f",
)
def length_bounds(spark, sf):
    return table(spark, sf, A.FRAGMENTS).select(
        "sample_id",
        "fragment_key",
        qc.length_in_bounds(F.col("r1_seq"), QC).alias("r1_ok"),
        qc.length_in_bounds(F.col("r2_seq"), QC).alias("r2_ok"),
    )


@query("n_fractions", f"SELECT sample_id, fragment_key, round(nfrac, 9) AS n_fraction FROM ({O.QC_ROWS}) f")
def n_fractions(spark, sf):
    return table(spark, sf, A.FRAGMENTS).select("sample_id", "fragment_key", r9(qc.n_fraction(), "n_fraction"))


@query(
    "fast_low_complexity",
    f"""SELECT sample_id, fragment_key, coalesce(round(fast1, 9), -1) AS r1_bits, coalesce(round(fast2, 9), -1) AS r2_bits
        FROM ({O.QC_ROWS}) f""",
)
def fast_low_complexity(spark, sf):
    bits = lambda c: F.coalesce(F.round(sequence.fast_low_complexity(F.col(c)), 9), F.lit(-1.0))
    return table(spark, sf, A.FRAGMENTS).select(
        "sample_id", "fragment_key", bits("r1_seq").alias("r1_bits"), bits("r2_seq").alias("r2_bits")
    )


@query(
    "dimer_entropy",
    f"SELECT sample_id, fragment_key, round(bits1, 9) AS r1_bits, round(bits2, 9) AS r2_bits FROM ({O.QC_ROWS}) f",
)
def dimer_entropy(spark, sf):
    return table(spark, sf, A.FRAGMENTS).select(
        "sample_id",
        "fragment_key",
        r9(sequence.entropy_2mer(F.col("r1_seq")), "r1_bits"),
        r9(sequence.entropy_2mer(F.col("r2_seq")), "r2_bits"),
    )


@query(
    "qc_verdicts",
    f"SELECT sample_id, fragment_key, reason, mate, observed FROM ({O.QC_VERDICTS}) v",
)
def qc_verdicts(spark, sf):
    return verdicts(spark, sf).select(
        "sample_id", "fragment_key", "qc.reason", "qc.mate", r9(F.col("qc.observed"), "observed")
    )


@query("qc_statistics", O.QC_STATS)
def qc_statistics(spark, sf):
    return qc.qc_stats(verdicts(spark, sf))


# ---- sampling ----------------------------------------------------------------------

_RANKED = f"""SELECT sample_id, fragment_key, md5('{PLAN.seed}:' || fragment_key) AS rank_hex,
    row_number() OVER (PARTITION BY sample_id ORDER BY md5('{PLAN.seed}:' || fragment_key), fragment_key) - 1 AS rank,
    count(*) OVER (PARTITION BY sample_id) AS n"""


@query("seeded_ranks", f"SELECT sample_id, fragment_key, rank_hex, rank FROM ({_RANKED} FROM ({A.plain_sql(A.HIT_FRAGMENTS)}) f) r")
def seeded_ranks(spark, sf):
    rows = table(spark, sf, A.HIT_FRAGMENTS).withColumn("rank_hex", sampling.rank_key(PLAN.seed, F.col("fragment_key")))
    return sampling.bucketed_rank(
        rows, ["sample_id"], F.substring("rank_hex", 1, 3), [F.col("rank_hex"), F.col("fragment_key")]
    ).select("sample_id", "fragment_key", "rank_hex", "rank")


@query("siphash_ranks", None)
def siphash_ranks(spark, sf):
    """Ranks of the second hash; tests hold it against another implementation."""
    ranked = table(spark, sf, A.HIT_FRAGMENTS).withColumn("rank_hex", sampling.rank_key(PLAN.seed, F.col("fragment_key"), "siphash13"))
    return ranked.select("sample_id", "fragment_key", "rank_hex")


@query(
    "bottom_k_sample",
    f"SELECT sample_id, fragment_key, rank FROM ({_RANKED} FROM ({A.plain_sql(A.HIT_FRAGMENTS)}) f) r WHERE rank < 5000",
)
def bottom_k_sample(spark, sf):
    return sampling.representative_sample(table(spark, sf, A.HIT_FRAGMENTS), PLAN.seed, 5000).select(
        "sample_id", "fragment_key", "rank"
    )


@query(
    "round_prefix_sizes",
    f"""SELECT sample_id, least(1000, n) AS look_1, least(5000, n) AS look_2, least(10000000, n) AS look_3
        FROM (SELECT sample_id, count(*) AS n FROM ({A.plain_sql(A.HIT_FRAGMENTS)}) f GROUP BY 1) g""",
)
def round_prefix_sizes(spark, sf):
    counted = table(spark, sf, A.HIT_FRAGMENTS).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = sampling.prefix_sizes((1_000, 5_000, 10_000_000), F.col("n"))
    return counted.select("sample_id", *[sizes[i].alias(f"look_{i + 1}") for i in range(3)])


@query("entry_rounds", O.sampled("SELECT sample_id, fragment_key, rank, entry_round FROM sampled"))
def entry_rounds(spark, sf):
    return sampled_fragments(spark, sf).select("sample_id", "fragment_key", "rank", "entry_round")


_TOTALS = f"""SELECT c_mktsegment AS sample_id, CAST(floor(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 100 END) / 1000) AS BIGINT) AS qc_passing_fragments
    FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey GROUP BY c_mktsegment
    UNION ALL SELECT concat('status-', o_orderstatus), CAST(count(*) AS BIGINT) FROM {{orders}} GROUP BY o_orderstatus"""
_SHARES = (0.0001, 0.25, 0.5, 1.0)


def _resolved_sql(override: bool) -> str:
    effective = (
        "least(raw_count, n)"
        if override
        else "CASE WHEN n < 10000 THEN n ELSE least(greatest(10000, least(10000000, raw_count)), n) END"
    )
    kind = (
        "CASE WHEN raw_count NOT BETWEEN 10000 AND 10000000 THEN 'sampling_threshold_override' END"
        if override
        else "CASE WHEN n < 10000 THEN CASE WHEN round = 1 THEN 'small_dataset_retained_all' END "
        "WHEN raw_count NOT BETWEEN 10000 AND 10000000 THEN 'effective_count_clamped' END"
    )
    return f"""SELECT sample_id, n AS qc_passing_fragments, round::INT AS round, p AS proportion, raw_count, {effective} AS effective_count,
        coalesce({kind}, '') AS warning_kind
        FROM (SELECT *, round(p * n)::BIGINT AS raw_count FROM
              (SELECT sample_id, qc_passing_fragments AS n, unnest([1, 2, 3, 4]) AS round,
                      unnest([{", ".join(f"{p!r}::DOUBLE" for p in _SHARES)}]) AS p FROM ({A.plain_sql(_TOTALS)}) t) u) v"""


def _resolved(spark, sf, override):
    return sampling.resolve_rounds(table(spark, sf, _TOTALS), _SHARES, override)


@query("proportional_rounds", _resolved_sql(False))
def proportional_rounds(spark, sf):
    return _resolved(spark, sf, False).select(
        "sample_id", "qc_passing_fragments", "round", "proportion", "raw_count", "effective_count",
        F.coalesce("warning_kind", F.lit("")).alias("warning_kind"),
    )


@query("proportional_rounds_override", _resolved_sql(True))
def proportional_rounds_override(spark, sf):
    return _resolved(spark, sf, True).select(
        "sample_id", "qc_passing_fragments", "round", "proportion", "raw_count", "effective_count",
        F.coalesce("warning_kind", F.lit("")).alias("warning_kind"),
    )


_PASSING = f"SELECT * FROM ({O.QC_VERDICTS}) v WHERE reason = 'pass'"


@query(
    "input_order_prefix",
    f"""SELECT sample_id, fragment_key, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY record_number) - 1 AS rank
        FROM ({_PASSING}) p) r WHERE rank < 200""",
)
def input_order_prefix(spark, sf):
    # Ranking reads its rows twice: they are judged once.
    passing = settle(qc.qc_passing(table(spark, sf, A.FRAGMENTS), QC).select("sample_id", "fragment_key", "record_number"))
    return sampling.first_n(passing, "record_number", 200).select("sample_id", "fragment_key", "rank")


_LOOK_SIZES = (100, 200, 400)
_COUNTERS = (
    "total_fragments", "passed_fragments", "low_complexity_filtered", "n_content_filtered", "length_filtered", "pair_incomplete",
)


@query(
    "qc_baseline_by_look",
    f"""SELECT sample_id, round, {", ".join(f"max({c}) OVER w AS {c}" for c in _COUNTERS)},
        coalesce(total_fragments < max(total_fragments) OVER (PARTITION BY sample_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS total_shrank
        FROM (SELECT sample_id, (record_number % 3 + 1)::INT AS round, count(*) AS total_fragments,
              count(*) FILTER (reason = 'pass') AS passed_fragments, count(*) FILTER (reason = 'low_complexity') AS low_complexity_filtered,
              count(*) FILTER (reason = 'n_content') AS n_content_filtered, count(*) FILTER (reason = 'length') AS length_filtered,
              count(*) FILTER (reason = 'pair_incomplete') AS pair_incomplete FROM ({O.QC_VERDICTS}) v GROUP BY 1, 2) s
        WINDOW w AS (PARTITION BY sample_id ORDER BY round)""",
)
def qc_baseline_by_look(spark, sf):
    per_look = verdicts(spark, sf).withColumn("round", (F.col("record_number") % 3 + 1).cast("int"))
    return sampling.qc_baseline(qc.qc_stats(per_look, ("sample_id", "round")))


@query(
    "round_plan_reports",
    f"""SELECT sample_id, 'proportional' AS round_mode, string_agg(proportion::VARCHAR, ',' ORDER BY round) AS requested_proportions,
        string_agg(raw_count::VARCHAR, ',' ORDER BY round) AS raw_proportional_counts,
        string_agg(effective_count::VARCHAR, ',' ORDER BY round) AS effective_counts, max(qc_passing_fragments) AS qc_passing_denominator,
        coalesce(string_agg(CASE WHEN warning_kind <> '' THEN warning_kind END, ',' ORDER BY round), '') AS warning_kinds
        FROM ({_resolved_sql(False)}) r GROUP BY sample_id""".replace("proportion::VARCHAR", "CASE WHEN proportion < 0.001 THEN '1.0E-4' ELSE proportion::VARCHAR END"),
)
def round_plan_reports(spark, sf):
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return sampling.round_plan_report(_resolved(spark, sf, False)).select(
        "sample_id",
        "round_mode",
        joined("requested_proportions"),
        joined("raw_proportional_counts"),
        joined("effective_counts"),
        "qc_passing_denominator",
        F.array_join(F.transform("warnings", lambda w: w["kind"]), ",").alias("warning_kinds"),
    )


@query(
    "absolute_round_plans",
    f"""SELECT sample_id, 'absolute' AS round_mode, '{",".join(map(str, PLAN.rounds))}' AS requested_rounds,
        concat_ws(',', {", ".join(f"least({r}, n)" for r in PLAN.rounds)}) AS effective_counts, n AS qc_passing_denominator
        FROM (SELECT sample_id, count(*) AS n FROM ({A.plain_sql(A.HIT_FRAGMENTS)}) f GROUP BY 1) g""",
)
def absolute_round_plans(spark, sf):
    totals = table(spark, sf, A.HIT_FRAGMENTS).groupBy("sample_id").agg(F.count(F.lit(1)).alias("qc_passing_fragments"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return sampling.plan_report(totals, PLAN).select(
        "sample_id", "round_mode", joined("requested_rounds"), joined("effective_counts"), "qc_passing_denominator"
    )


# ---- hits --------------------------------------------------------------------------


@query(
    "contig_classification",
    f"""SELECT contig, coalesce(class, '') AS class, coalesce(violation, '') AS violation
        FROM ({O._classified(A.CONFLICTED_MANIFEST)}) c""",
)
def contig_classification(spark, sf):
    rows = hits.classify_contigs(table(spark, sf, A.CONFLICTED_MANIFEST))
    return rows.select(
        "contig", F.coalesce("class", F.lit("")).alias("class"), F.coalesce("violation", F.lit("")).alias("violation")
    )


@query(
    "hits_with_manifest",
    f"""SELECT h.sample_id, h.fragment_key, h.mate, h.contig, h.mapq, h.target_start, coalesce(m.class, '') AS class, coalesce(m.accession, '') AS accession
        FROM ({A.plain_sql(A.HITS)}) h LEFT JOIN (SELECT * FROM ({O._classified(A.CONFLICTED_MANIFEST)}) c WHERE violation IS NULL) m USING (contig)""",
)
def hits_with_manifest(spark, sf):
    known = hits.usable_contigs(table(spark, sf, A.CONFLICTED_MANIFEST))
    return hits.attach_manifest(table(spark, sf, A.HITS), known).select(
        "sample_id", "fragment_key", "mate", "contig", "mapq", "target_start",
        F.coalesce("class", F.lit("")).alias("class"), F.coalesce("accession", F.lit("")).alias("accession"),
    )


@query(
    "unknown_contig_hits",
    f"""SELECT h.sample_id, h.fragment_key, h.contig, h.target_start FROM ({A.plain_sql(A.HITS)}) h
        WHERE h.contig NOT IN (SELECT contig FROM ({O._classified(A.CONFLICTED_MANIFEST)}) c WHERE violation IS NULL)""",
)
def unknown_contig_hits(spark, sf):
    known = hits.usable_contigs(table(spark, sf, A.CONFLICTED_MANIFEST))
    return hits.unknown_contig_hits(table(spark, sf, A.HITS), known).select(
        "sample_id", "fragment_key", "contig", "target_start"
    )


@query(
    "rejected_hits",
    f"""SELECT h.sample_id, h.contig, CASE WHEN m.contig IS NULL THEN 'unknown_contig' ELSE m.violation END AS problem, count(*) AS hits
        FROM ({A.plain_sql(A.HITS)}) h LEFT JOIN (SELECT contig, max(violation) AS violation FROM ({O._classified(A.CONFLICTED_MANIFEST)}) c GROUP BY contig) m ON h.contig = m.contig
        WHERE m.contig IS NULL OR m.violation IS NOT NULL GROUP BY 1, 2, 3""",
)
def rejected_hits(spark, sf):
    return hits.rejected_hits(table(spark, sf, A.HITS), hits.classify_contigs(table(spark, sf, A.CONFLICTED_MANIFEST)))


@query(
    "contig_hit_aggregates",
    O.whole(
        """SELECT sample_id, fragment_key, contig, r1_mapped, r2_mapped, pair_consistent, r1_best_mapq, r2_best_mapq,
        coalesce(r1_best_as, -1) AS r1_best_as, coalesce(r2_best_as, -1) AS r2_best_as, primary_supports, supplementary_supports,
        has_secondary, reference_start, reference_end, mapq AS best_mapq, coalesce(as_score, -1) AS best_as, coalesce(nm, -1) AS best_nm,
        is_primary AS best_primary, is_supplementary AS best_supplementary FROM contigs"""
    ),
)
def contig_hit_aggregates(spark, sf):
    best = F.col("best")
    zero = lambda c: F.coalesce(c, F.lit(-1))
    return hits.aggregate_hits(table(spark, sf, A.HITS)).select(
        "sample_id", "fragment_key", "contig", "r1_mapped", "r2_mapped", "pair_consistent", "r1_best_mapq", "r2_best_mapq",
        zero(F.col("r1_best_as")).alias("r1_best_as"),
        zero(F.col("r2_best_as")).alias("r2_best_as"),
        "primary_supports", "supplementary_supports", "has_secondary", "reference_start", "reference_end",
        (-best["mapq_desc"]).cast("int").alias("best_mapq"),
        zero(best["as_score"]).alias("best_as"),
        zero(best["nm"]).alias("best_nm"),
        (best["not_primary"] == 0).alias("best_primary"),
        (best["supplementary"] == 1).alias("best_supplementary"),
    )


@query(
    "best_hits_per_class",
    O.whole(
        """SELECT sample_id, fragment_key, coalesce(h_contig, '') AS host_contig, coalesce(h_as, -1) AS host_as,
        coalesce(v_contig, '') AS virus_contig, coalesce(v_as, -1) AS virus_as, coalesce(v_mapq, -1) AS virus_mapq,
        coalesce(v_nm, -1) AS virus_nm, coalesce(v_accession, '') AS virus_accession, has_secondary FROM pairs"""
    ),
)
def best_hits_per_class(spark, sf):
    text_of = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda c: F.coalesce(F.col(c), F.lit(-1))
    return hits.best_hits(contig_rows(spark, sf)).select(
        "sample_id", "fragment_key",
        text_of("host.contig").alias("host_contig"), number("host.as_score").alias("host_as"),
        text_of("virus.contig").alias("virus_contig"), number("virus.as_score").alias("virus_as"),
        number("virus.mapq").alias("virus_mapq"), number("virus.nm").alias("virus_nm"),
        text_of("virus.accession").alias("virus_accession"), "has_secondary",
    )


@query(
    "secondary_evidence",
    O.whole(
        """SELECT h.sample_id, h.fragment_key, h.contig, c.class, h.mapq, coalesce(h.as_score, -1) AS as_score, coalesce(h.nm, -1) AS nm,
        h.is_primary, h.is_supplementary, c.r1_mapped, c.r2_mapped, c.pair_consistent, h.target_start AS reference_start, h.target_end AS reference_end
        FROM hits h JOIN contigs c USING (sample_id, fragment_key, contig) WHERE NOT h.is_primary OR h.is_supplementary"""
    ),
)
def secondary_evidence(spark, sf):
    found = hits.secondary_hits(table(spark, sf, A.HITS), classified(spark, sf))
    return found.withColumns(
        {"as_score": F.coalesce("as_score", F.lit(-1)), "nm": F.coalesce("nm", F.lit(-1))}
    )


# ---- adjudication ------------------------------------------------------------------


@query("score_margins", O.whole("SELECT sample_id, fragment_key, coalesce(as_diff, -9999) AS as_diff FROM scored"))
def score_margins(spark, sf):
    rows = hits.best_hits(contig_rows(spark, sf))
    return rows.select("sample_id", "fragment_key", F.coalesce(adjudicate.as_diff(), F.lit(-9999)).alias("as_diff"))


@query(
    "stronger_host",
    O.whole("SELECT sample_id, fragment_key, host_stronger AND v_contig IS NOT NULL AS stronger_host FROM scored"),
)
def stronger_host(spark, sf):
    rows = hits.best_hits(contig_rows(spark, sf))
    return rows.select("sample_id", "fragment_key", adjudicate.stronger_host().alias("stronger_host"))


@query("virus_confidence", O.whole("SELECT sample_id, fragment_key, class = 'virus' AS confident FROM adjudicated_paired"))
def virus_confidence(spark, sf):
    rows = hits.best_hits(contig_rows(spark, sf))
    return rows.select("sample_id", "fragment_key", adjudicate.virus_confident(FRAGMENT_PAIRED).alias("confident"))


@query("fragment_classes", O.whole("SELECT sample_id, fragment_key, class AS fragment_class FROM adjudicated"))
def fragment_classes(spark, sf):
    return fragments(spark, sf).select("sample_id", "fragment_key", "fragment_class")


@query(
    "fragment_classes_paired",
    O.whole("SELECT sample_id, fragment_key, class AS fragment_class FROM adjudicated_paired"),
)
def fragment_classes_paired(spark, sf):
    return fragments(spark, sf, FRAGMENT_PAIRED).select("sample_id", "fragment_key", "fragment_class")


_R = FRAGMENT_PAIRED


@query(
    "confidence_flags",
    O.whole(
        f"""SELECT sample_id, fragment_key, concat_ws(',',
          CASE WHEN has_secondary THEN 'secondary_or_supplementary_evidence_present' END,
          CASE WHEN h_counts THEN 'host_primary' WHEN h_contig IS NOT NULL THEN 'host_not_primary' ELSE 'no_host_hit' END,
          CASE WHEN v_counts THEN 'virus_primary' WHEN v_contig IS NOT NULL THEN 'virus_not_primary' ELSE 'no_virus_hit' END,
          CASE WHEN v_contig IS NOT NULL THEN CASE WHEN v_mapq >= {_R.min_mapq} THEN 'mapq_ok' ELSE 'mapq_below_min' END END,
          CASE WHEN v_contig IS NOT NULL THEN CASE WHEN as_diff >= {_R.min_as_diff} THEN 'as_diff_ok' WHEN as_diff IS NOT NULL THEN 'as_diff_below_min' ELSE 'as_diff_unavailable' END END,
          CASE WHEN v_contig IS NOT NULL THEN CASE WHEN v_nm BETWEEN 0 AND {_R.max_nm} THEN 'nm_ok' ELSE 'nm_above_max_or_unavailable' END END,
          CASE WHEN v_contig IS NOT NULL THEN 'not_low_complexity' END,
          CASE WHEN v_contig IS NOT NULL THEN CASE WHEN host_stronger THEN 'host_stronger_or_equal' ELSE 'host_not_stronger' END END,
          CASE WHEN v_contig IS NOT NULL THEN CASE WHEN v_pair THEN 'pair_consistent' ELSE 'pair_inconsistent' END END,
          CASE WHEN class = 'unmapped' THEN 'unmapped' END) AS flags FROM adjudicated_paired"""
    ),
)
def confidence_flags(spark, sf):
    rows = hits.best_hits(contig_rows(spark, sf))
    return rows.select(
        "sample_id", "fragment_key", F.array_join(adjudicate.confidence_flags(FRAGMENT_PAIRED), ",").alias("flags")
    )


# ---- aggregation -------------------------------------------------------------------


@query(
    "ambiguous_support",
    O.whole(
        """SELECT 'accession' AS level, sample_id, id AS accession_or_group, n AS ambiguous_fragments FROM ambiguous_counts WHERE level = 'accession'
        UNION ALL SELECT 'group', sample_id, id, n FROM ambiguous_counts WHERE level = 'group'"""
    ),
)
def ambiguous_support(spark, sf):
    rows = fragments(spark, sf)
    both = [
        aggregate.ambiguous_support(rows, level).select(F.lit(level).alias("level"), "*")
        for level in aggregate.LEVELS
    ]
    return both[0].unionByName(both[1])


@query(
    "accepted_support",
    O.whole(
        "SELECT sample_id, v_accession AS accession_or_group, count(*) AS accepted_fragments FROM accepted GROUP BY 1, 2"
    ),
)
def accepted_support(spark, sf):
    return aggregate.accepted_support(fragments(spark, sf))


@query(
    "two_level_candidates",
    O.whole(
        """SELECT sample_id, level AS aggregation_level, id AS accession_or_group, accepted AS accepted_fragments,
        ambiguous AS ambiguous_fragments, total AS total_sampled_fragments FROM calls"""
    ),
)
def two_level_candidates(spark, sf):
    return calls(spark, sf).select(
        "sample_id", "aggregation_level", "accession_or_group", "accepted_fragments", "ambiguous_fragments",
        "total_sampled_fragments",
    )


@query(
    "nonoverlapping_intervals",
    O.whole("SELECT sample_id, contig, nonoverlap FROM scheduled"),
)
def nonoverlapping_intervals(spark, sf):
    reduced = aggregate.reduce_evidence(aggregate.fragment_evidence(fragments(spark, sf)))
    per_contig = aggregate.cumulative_rounds(reduced, 1)
    return per_contig.filter("nonoverlap > 0").select("sample_id", "contig", "nonoverlap")


@query(
    "merged_coverage_blocks",
    O.whole("SELECT sample_id, contig, island::BIGINT AS block, block_start, block_end FROM blocks"),
)
def merged_coverage_blocks(spark, sf):
    spans = fragments(spark, sf).filter("fragment_class = 'virus'").select(
        "sample_id",
        F.col("virus.contig").alias("contig"),
        F.col("virus.reference_start").alias("start"),
        F.col("virus.reference_end").alias("end"),
    )
    return aggregate.merged_blocks(spans, ["sample_id", "contig"])


@query(
    "breadth",
    O.whole(
        """SELECT sample_id, level AS aggregation_level, id AS accession_or_group, blocks AS coverage_interval_blocks,
        bases AS covered_bases, genome AS genome_length, round(breadth, 9) AS breadth FROM calls"""
    ),
)
def breadth(spark, sf):
    return calls(spark, sf).select(
        "sample_id", "aggregation_level", "accession_or_group", "coverage_interval_blocks", "covered_bases",
        "genome_length", r9("breadth", "breadth"),
    )


@query(
    "group_identity",
    O.whole("SELECT sample_id, level AS aggregation_level, id AS accession_or_group, virus_name, taxid FROM calls"),
)
def group_identity(spark, sf):
    return calls(spark, sf).select("sample_id", "aggregation_level", "accession_or_group", "virus_name", "taxid")


def _conflict_sql(key: str, value: str) -> str:
    return f"""SELECT 'conflicting_{value}' AS "check", {key} AS entity, concat(CAST(min({value}) AS VARCHAR), ' vs ', CAST(max({value}) AS VARCHAR)) AS detail
        FROM m GROUP BY {key} HAVING min({value}) <> max({value})"""


@query(
    "candidate_violations",
    f"""WITH m AS ({A.plain_sql(A.CONFLICTED_MANIFEST)}) {_conflict_sql('accession', 'taxid')}
        UNION ALL {_conflict_sql('accession', 'virus_name')} UNION ALL {_conflict_sql('contig', 'genome_length')}
        UNION ALL SELECT 'empty_accession_key', contig, '' FROM m WHERE trim(accession) = ''
        UNION ALL SELECT 'empty_group_key', contig, '' FROM m WHERE trim("group") = ''""",
)
def candidate_violations(spark, sf):
    return aggregate.candidate_violations(table(spark, sf, A.CONFLICTED_MANIFEST), fragments(spark, sf))


@query(
    "evidence_strength",
    O.whole("SELECT sample_id, level AS aggregation_level, id AS accession_or_group, strength AS evidence_strength FROM gated"),
)
def evidence_strength(spark, sf):
    return calls(spark, sf).select("sample_id", "aggregation_level", "accession_or_group", "evidence_strength")


@query(
    "cumulative_round_calls",
    O.sampled(
        """SELECT sample_id, round::INT AS round, level AS aggregation_level, id AS accession_or_group, accepted AS accepted_fragments,
        nonoverlap AS nonoverlap_fragments, blocks AS coverage_interval_blocks, ambiguous AS ambiguous_fragments,
        total AS total_sampled_fragments, round(breadth, 9) AS breadth FROM calls"""
    ),
)
def cumulative_round_calls(spark, sf):
    return aggregate.only_candidates(look_calls(spark, sf)).select(
        "sample_id", "round", "aggregation_level", "accession_or_group", "accepted_fragments", "nonoverlap_fragments",
        "coverage_interval_blocks", "ambiguous_fragments", "total_sampled_fragments", r9("breadth", "breadth"),
    )


@query(
    "ranked_candidates",
    O.whole(
        """SELECT sample_id, level AS aggregation_level, id AS accession_or_group, accepted AS accepted_fragments, nonoverlap AS nonoverlap_fragments,
        round(breadth, 9) AS breadth, round(fraction, 9) AS raw_fraction,
        row_number() OVER (PARTITION BY sample_id, level ORDER BY accepted DESC, nonoverlap DESC, breadth DESC, id)::INT AS candidate_rank FROM calls"""
    ),
)
def ranked_candidates(spark, sf):
    return aggregate.rank_candidates(calls(spark, sf)).select(
        "sample_id", "aggregation_level", "accession_or_group", "accepted_fragments", "nonoverlap_fragments",
        r9("breadth", "breadth"), r9("raw_fraction", "raw_fraction"), "candidate_rank",
    )


_BASE_REASONS = f"""concat_ws('|', 'aggregation_level=' || level, 'multiplicity_family=' || level, 'coverage_interval_blocks=' || blocks,
  'nonoverlap_fragments_algorithm=max_nonoverlapping_intervals_v1', 'accepted_fraction_label=accepted_fragments_per_sampled_fragment',
  'unique_fraction_label=legacy_alias_not_molecule_unique', 'total_sampled_fragments=' || total, 'fraction_denominator_source=sampled_fragments',
  'fraction_ci_95_label=sampling-only CI: accepted-fragment sampling uncertainty only; not diagnostic confidence',
  'negative_control_policy=not_used_for_default_background_assessment', 'decision_pending_task_16')"""


@query(
    "candidate_call_rows",
    O.whole(
        f"""SELECT sample_id, level AS aggregation_level, id AS accession_or_group, virus_name, taxid, accepted AS accepted_fragments,
        'indeterminate' AS decision, CASE WHEN level = 'group' THEN 'not_applicable' ELSE 'high' END AS accession_resolution,
        {_BASE_REASONS} AS decision_reasons FROM calls"""
    ),
)
def candidate_call_rows(spark, sf):
    return calls(spark, sf).select(
        "sample_id", "aggregation_level", "accession_or_group", "virus_name", "taxid", "accepted_fragments", "decision",
        "accession_resolution", F.array_join("decision_reasons", "|").alias("decision_reasons"),
    )


# ---- statistics --------------------------------------------------------------------


@query(
    "fractions",
    O.sampled("SELECT sample_id, round::INT AS round, level AS aggregation_level, id AS accession_or_group, round(fraction, 9) AS fraction FROM calls"),
)
def fractions(spark, sf):
    rows = aggregate.only_candidates(look_calls(spark, sf))
    value = stats.fraction("accepted_fragments", "total_sampled_fragments")
    return rows.select("sample_id", "round", "aggregation_level", "accession_or_group", r9(value, "fraction"))


@query(
    "wilson_intervals",
    O.sampled(
        """SELECT sample_id, round::INT AS round, level AS aggregation_level, id AS accession_or_group,
        round(greatest(0, (fraction + 3.8416 / (2 * total) - 1.96 * sqrt(fraction * (1 - fraction) / total + 3.8416 / (4.0 * total * total))) / (1 + 3.8416 / total)), 9) AS low,
        round(least(1, (fraction + 3.8416 / (2 * total) + 1.96 * sqrt(fraction * (1 - fraction) / total + 3.8416 / (4.0 * total * total))) / (1 + 3.8416 / total)), 9) AS high
        FROM calls"""
    ),
)
def wilson_intervals(spark, sf):
    low, high = stats.wilson_bounds("accepted_fragments", "total_sampled_fragments")
    return aggregate.only_candidates(look_calls(spark, sf)).select(
        "sample_id", "round", "aggregation_level", "accession_or_group", r9(low, "low"), r9(high, "high")
    )


@query(
    "clopper_pearson_bounds",
    O.sampled(
        """SELECT sample_id, round::INT AS round, level AS aggregation_level, id AS accession_or_group, round(cp_upper, 9) AS cp_upper
        FROM calls c JOIN bounds b ON b.k = c.accepted AND b.n = c.total"""
    ),
)
def clopper_pearson_bounds(spark, sf):
    return aggregate.only_candidates(look_calls(spark, sf)).select(
        "sample_id", "round", "aggregation_level", "accession_or_group", r9("clopper_pearson_upper", "cp_upper")
    )


@query(
    "binomial_survival",
    O.sampled(
        """SELECT sample_id, round::INT AS round, level AS aggregation_level, id AS accession_or_group, round(p_value, 9) AS p_value
        FROM calls c JOIN tails t ON t.k = c.accepted AND t.n = c.total"""
    ),
)
def binomial_survival(spark, sf):
    value = stats.binomial_survival("accepted_fragments", "total_sampled_fragments", DECISION.null_probability)
    return aggregate.only_candidates(look_calls(spark, sf)).select(
        "sample_id", "round", "aggregation_level", "accession_or_group", r9(value, "p_value")
    )


@query(
    "bonferroni_alpha",
    O.sampled("SELECT sample_id, round::INT AS round, level AS aggregation_level, id AS accession_or_group, round(alpha, 12) AS alpha FROM gated"),
)
def bonferroni_alpha(spark, sf):
    rows = decision.look_context(aggregate.only_candidates(look_calls(spark, sf)), PLAN.look_count)
    alpha = stats.bonferroni(DECISION.positive_alpha_global, "candidate_family_size", "planned_round_look_count")
    return rows.select("sample_id", "round", "aggregation_level", "accession_or_group", F.round(alpha, 12).alias("alpha"))


# ---- decisions ---------------------------------------------------------------------

_KEY = "sample_id, round::INT AS round, level AS aggregation_level, id AS accession_or_group"
_KEY_COLUMNS = ("sample_id", "round", "aggregation_level", "accession_or_group")


@query(
    "gate_vectors",
    O.sampled(
        f"""SELECT {_KEY}, g_abundance AS abundance_pass, g_absolute AS absolute_pass, g_nonoverlap AS nonoverlap_pass, g_breadth AS breadth_pass,
        true AS background_pass, g_ambiguity AS ambiguity_pass, g_evidence AS evidence_pass, g_enrichment AS enrichment_pass FROM cored"""
    ),
)
def gate_vectors(spark, sf):
    names = ("abundance", "absolute", "nonoverlap", "breadth", "background", "ambiguity", "evidence", "enrichment")
    return aggregate.only_candidates(evaluated(spark, sf)).select(*_KEY_COLUMNS, *[f"{n}_pass" for n in names])


@query("candidate_statuses", O.sampled(f"SELECT {_KEY}, decision FROM evaluated"))
def candidate_statuses(spark, sf):
    return aggregate.only_candidates(evaluated(spark, sf)).select(*_KEY_COLUMNS, "decision")


@query("accession_resolution", O.sampled(f"SELECT {_KEY}, resolution AS accession_resolution FROM evaluated"))
def accession_resolution(spark, sf):
    return aggregate.only_candidates(evaluated(spark, sf)).select(*_KEY_COLUMNS, "accession_resolution")


@query(
    "look_contexts",
    O.sampled(
        f"SELECT {_KEY}, family AS candidate_family_size, {PLAN.look_count}::BIGINT AS planned_round_look_count, round::BIGINT AS current_look_index FROM gated"
    ),
)
def look_contexts(spark, sf):
    rows = decision.look_context(aggregate.only_candidates(look_calls(spark, sf)), PLAN.look_count)
    return rows.select(*_KEY_COLUMNS, "candidate_family_size", "planned_round_look_count", "current_look_index")


@query(
    "look_decisions",
    O.sampled(
        """SELECT sample_id, round::INT AS round, sampled AS sampled_fragments, accepted AS accepted_virus, accession_status, coalesce(accession_stop, '') AS accession_stop,
        group_status, coalesce(group_stop, '') AS group_stop FROM look_outcomes"""
    ),
)
def look_decisions(spark, sf):
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return looks(spark, sf).select(
        "sample_id", "round", "sampled_fragments", "accepted_virus", "accession_status", blank("accession_stop"),
        "group_status", blank("group_stop"),
    )


@query("group_continuity", O.sampled(f"SELECT {_KEY}, decision, can_stop AS group_can_stop FROM continued WHERE level = 'group'"))
def group_continuity(spark, sf):
    return evaluated(spark, sf).filter("aggregation_level = 'group'").select(*_KEY_COLUMNS, "decision", "group_can_stop")


@query(
    "negative_confirmation",
    O.sampled("SELECT sample_id, round::INT AS round, neg AS negative_confirmed FROM level_looks WHERE level = 'group'"),
)
def negative_confirmation(spark, sf):
    return decision.confirm_negative(evaluated(spark, sf), DECISION)


@query(
    "sequential_decisions",
    O.sampled(
        """SELECT sample_id, rounds_run::INT AS rounds_run, sampled AS sampled_fragments, accepted AS accepted_virus, status AS decision_status, stop AS stop_reason FROM decisions"""
    ),
)
def sequential_decisions(spark, sf):
    return decision.sample_decisions(looks(spark, sf))


@query(
    "sequential_decisions_by_look",
    O.sampled(
        """SELECT sample_id, rounds_run::INT AS rounds_run, sampled AS sampled_fragments, accepted AS accepted_virus, status AS decision_status, stop AS stop_reason FROM decisions"""
    ),
)
def sequential_decisions_by_look(spark, sf):
    """Looks taken one by one, over undecided samples only."""
    folder = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
    sampled = sampled_fragments(spark, sf)
    sequential.split_by_round(table(spark, sf, A.HITS), sampled, PROFILE, folder)
    samples = table(spark, sf, A.HIT_FRAGMENTS).select("sample_id")
    return decision.sample_decisions(sequential.look_by_look(folder, table(spark, sf, A.MANIFEST), samples, PROFILE).looks)


@query(
    "merged_level_outcomes",
    O.sampled("SELECT sample_id, round::INT AS round, status AS decision_status, coalesce(stop, '') AS stop_reason FROM look_outcomes"),
)
def merged_level_outcomes(spark, sf):
    return looks(spark, sf).select(
        "sample_id", "round", "decision_status", F.coalesce("stop_reason", F.lit("")).alias("stop_reason")
    )


@query(
    "round_records",
    O.sampled(
        "SELECT sample_id, round::INT AS round, sampled AS sampled_fragments, accepted AS accepted_virus, status AS decision_status FROM kept_looks"
    ),
)
def round_records(spark, sf):
    return decision.round_records(looks(spark, sf))
