"""Plain SQL for the registered queries, written independently of the operators.

Interval union uses a running maximum, scheduling a list fold, statistics a
bisection on exact sums: none of the formulas the operators use.
"""

from __future__ import annotations

import re

from siftline import adapters as A
from siftline import labels as L
from siftline.checks.settings import (
    CANDIDATE,
    DECISION,
    FRAGMENT,
    FRAGMENT_PAIRED,
    PLAN,
    QC,
)


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _norm(c: str) -> str:
    return f"replace(replace(lower(trim({c})), '_', '-'), ' ', '-')"


def _classified(source: str) -> str:
    group, kind = _norm('"group"'), _norm("source_type")

    def cls(value, host, virus, decoy):
        return (
            f"CASE WHEN {value} IN {_in(host)} THEN 'host' WHEN {value} IN {_in(virus)} THEN 'virus' "
            f"WHEN {value} IN {_in(decoy)} THEN 'decoy' END"
        )

    return f"""
    SELECT *, CASE WHEN by_group <> by_source THEN NULL ELSE coalesce(by_group, by_source) END AS class,
           CASE WHEN by_group <> by_source THEN 'conflicting_class'
                WHEN by_group IS NULL AND by_source IS NULL THEN 'unclassified'
                WHEN copies > 1 THEN 'duplicate_contig' END AS violation
    FROM (SELECT *, count(*) OVER (PARTITION BY contig) AS copies,
                 {cls(group, L.HOST_GROUPS, L.VIRUS_GROUPS, L.DECOY_GROUPS)} AS by_group,
                 {cls(kind, L.HOST_SOURCE_TYPES, L.VIRUS_SOURCE_TYPES, L.DECOY_SOURCE_TYPES)} AS by_source
          FROM ({A.plain_sql(source)}) m) c"""


REP_ORDER = (
    "is_primary DESC, is_supplementary, mapq DESC, coalesce(as_score, -2147483648) DESC, "
    "coalesce(nm, 2147483647), segment_id, target_start, target_end"
)
CONTIG_ORDER = (
    "pair_consistent DESC, (r1_mapped::INT + r2_mapped::INT) DESC, primary_supports DESC, supplementary_supports, "
    "coalesce(r1_best_as, -536870912)::BIGINT + coalesce(r2_best_as, -536870912)::BIGINT DESC, "
    "r1_best_mapq + r2_best_mapq DESC, " + REP_ORDER + ", contig"
)


RANK_ORDER = f"md5('{PLAN.seed}:' || fragment_key), fragment_key"
INPUT_ORDER = "record_number"


def _ctes(order: str | None) -> dict[str, str]:
    """The screening chain over all fragments, or over the looks taken in ``order``."""
    source = A.plain_sql(A.HIT_FRAGMENTS)
    sampled = (
        f"""SELECT sample_id, fragment_key, rank, CASE {" ".join(f"WHEN rank < {n} THEN {i + 1}" for i, n in enumerate(PLAN.rounds))} END AS entry_round
        FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {order}) - 1 AS rank
              FROM ({source}) f) r WHERE rank < {max(PLAN.rounds)}"""
        if order
        else f"SELECT sample_id, fragment_key, 0 AS rank, 1 AS entry_round FROM ({source}) f"
    )
    looks = PLAN.look_count if order else 1
    return {
        "manifest": _classified(A.MANIFEST),
        "sampled": sampled,
        "looks": f"SELECT unnest(range(1, {looks + 1})) AS round",
        "hits": f"SELECT h.*, s.entry_round FROM ({A.plain_sql(A.HITS)}) h JOIN sampled s USING (sample_id, fragment_key)",
        "reps": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, fragment_key, contig ORDER BY {REP_ORDER}) AS rn
            FROM hits) x WHERE rn = 1""",
        "contigs": """SELECT g.*, r.mapq, r.as_score, r.nm, r.is_primary, r.is_supplementary, r.segment_id, r.target_start, r.target_end,
                m.class, m.accession, m."group"
            FROM (SELECT sample_id, fragment_key, contig, bool_or(mate = 1) AS r1_mapped, bool_or(mate = 2) AS r2_mapped,
                    bool_or(mate = 1) AND bool_or(mate = 2) AS pair_consistent,
                    coalesce(max(CASE WHEN mate = 1 THEN mapq END), 0) AS r1_best_mapq,
                    coalesce(max(CASE WHEN mate = 2 THEN mapq END), 0) AS r2_best_mapq,
                    max(CASE WHEN mate = 1 THEN as_score END) AS r1_best_as,
                    max(CASE WHEN mate = 2 THEN as_score END) AS r2_best_as,
                    count(*) FILTER (is_primary) AS primary_supports,
                    count(*) FILTER (is_supplementary) AS supplementary_supports,
                    bool_or(NOT is_primary OR is_supplementary) AS has_secondary,
                    min(target_start) AS reference_start, max(target_end) AS reference_end
                  FROM hits GROUP BY ALL) g
            JOIN reps r USING (sample_id, fragment_key, contig)
            JOIN manifest m USING (contig)""",
        "bests": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, fragment_key, class ORDER BY {CONTIG_ORDER}) AS rn2
            FROM contigs) x WHERE rn2 = 1""",
        "pairs": """SELECT s.sample_id, s.fragment_key, s.entry_round, coalesce(e.has_secondary, false) AS has_secondary,
                h.contig AS h_contig, h.as_score AS h_as, coalesce(h.is_primary AND NOT h.is_supplementary, false) AS h_counts,
                v.contig AS v_contig, v.as_score AS v_as, v.mapq AS v_mapq, v.nm AS v_nm, v.pair_consistent AS v_pair,
                v.accession AS v_accession, v."group" AS v_group, v.reference_start AS v_start, v.reference_end AS v_end,
                coalesce(v.is_primary AND NOT v.is_supplementary, false) AS v_counts
            FROM sampled s
            LEFT JOIN (SELECT sample_id, fragment_key, bool_or(has_secondary) AS has_secondary FROM contigs GROUP BY 1, 2) e USING (sample_id, fragment_key)
            LEFT JOIN (SELECT * FROM bests WHERE class = 'host') h USING (sample_id, fragment_key)
            LEFT JOIN (SELECT * FROM bests WHERE class = 'virus') v USING (sample_id, fragment_key)""",
        "scored": """SELECT *, CASE WHEN v_contig IS NULL THEN NULL WHEN h_contig IS NULL THEN v_as ELSE v_as - h_as END AS as_diff,
                h_counts AND coalesce(h_as >= v_as, false) AS host_stronger FROM pairs""",
        "adjudicated": _adjudicated(FRAGMENT),
        "adjudicated_paired": _adjudicated(FRAGMENT_PAIRED),
        "accepted": """SELECT l.round, a.* FROM adjudicated a JOIN looks l ON a.entry_round <= l.round WHERE class = 'virus'""",
        "ambiguous_hits": """SELECT sample_id, fragment_key, entry_round, 0 AS ord, v_contig AS contig, v_accession AS accession, v_group AS "group"
              FROM adjudicated WHERE class = 'ambiguous' AND v_contig IS NOT NULL
            UNION ALL
            SELECT a.sample_id, a.fragment_key, a.entry_round, 1, c.contig, c.accession, c."group"
              FROM adjudicated a JOIN contigs c USING (sample_id, fragment_key)
              WHERE a.class = 'ambiguous' AND c.class = 'virus' AND c.has_secondary""",
        "ambiguous_support": """SELECT sample_id, fragment_key, min(entry_round) AS entry_round, level, id, arg_min(contig, (ord, contig)) AS contig
            FROM (SELECT *, 'accession' AS level, accession AS id FROM ambiguous_hits
                  UNION ALL SELECT *, 'group', "group" FROM ambiguous_hits) x
            GROUP BY sample_id, fragment_key, level, id""",
        "seen": """SELECT DISTINCT round, sample_id, level, id, contig FROM (
              SELECT round, sample_id, 'accession' AS level, v_accession AS id, v_contig AS contig FROM accepted
              UNION ALL SELECT round, sample_id, 'group', v_group, v_contig FROM accepted
              UNION ALL SELECT l.round, s.sample_id, s.level, s.id, s.contig FROM ambiguous_support s JOIN looks l ON s.entry_round <= l.round) x""",
        "spans": """SELECT DISTINCT round, sample_id, v_contig AS contig, v_start AS a, v_end AS b FROM accepted WHERE v_end > v_start""",
        "scheduled": """SELECT round, sample_id, contig,
              list_reduce(list_prepend({'e': -1::BIGINT, 's': 0::BIGINT, 'n': 0::BIGINT}, list({'e': b, 's': a, 'n': 0::BIGINT} ORDER BY b, a)),
                lambda acc, x: CASE WHEN x.s >= acc.e THEN {'e': x.e, 's': x.s, 'n': acc.n + 1} ELSE acc END).n AS nonoverlap
            FROM spans GROUP BY round, sample_id, contig""",
        "islands": """SELECT *, sum(CASE WHEN reach IS NULL OR a >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY round, sample_id, contig ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island
            FROM (SELECT *, max(b) OVER (PARTITION BY round, sample_id, contig ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans) x""",
        "blocks": """SELECT round, sample_id, contig, island, min(a) AS block_start, max(b) AS block_end FROM islands GROUP BY 1, 2, 3, 4""",
        "covered": """SELECT round, sample_id, contig, count(*) AS blocks, sum(block_end - block_start) AS bases FROM blocks GROUP BY 1, 2, 3""",
        "totals": """SELECT l.round, s.sample_id, count(*) AS n FROM sampled s JOIN looks l ON s.entry_round <= l.round GROUP BY 1, 2""",
        "counts": """SELECT round, sample_id, v_contig AS contig, count(*) AS accepted FROM accepted GROUP BY 1, 2, 3""",
        "ambiguous_counts": """SELECT l.round, s.sample_id, s.level, s.id, count(*) AS n FROM ambiguous_support s JOIN looks l ON s.entry_round <= l.round GROUP BY 1, 2, 3, 4""",
        "raw_calls": """SELECT s.round, s.sample_id, s.level, s.id,
                CASE WHEN s.level = 'group' AND min(m.virus_name) <> max(m.virus_name) THEN s.id ELSE min(m.virus_name) END AS virus_name,
                CASE WHEN s.level = 'group' AND min(m.taxid) <> max(m.taxid) THEN 0 ELSE min(m.taxid) END AS taxid,
                coalesce(sum(c.accepted), 0)::BIGINT AS accepted, coalesce(sum(p.nonoverlap), 0)::BIGINT AS nonoverlap,
                coalesce(sum(v.blocks), 0)::BIGINT AS blocks, coalesce(sum(v.bases), 0)::BIGINT AS bases,
                sum(m.genome_length)::BIGINT AS genome
            FROM seen s JOIN manifest m USING (contig)
            LEFT JOIN counts c USING (round, sample_id, contig)
            LEFT JOIN scheduled p USING (round, sample_id, contig)
            LEFT JOIN covered v USING (round, sample_id, contig)
            GROUP BY s.round, s.sample_id, s.level, s.id""",
        "calls": """SELECT r.*, coalesce(a.n, 0)::BIGINT AS ambiguous, t.n AS total, r.accepted::DOUBLE / t.n AS fraction,
                r.bases::DOUBLE / r.genome AS breadth
            FROM raw_calls r JOIN totals t USING (round, sample_id)
            LEFT JOIN ambiguous_counts a USING (round, sample_id, level, id)""",
        # Exact binomial CDF by direct summation, bisected as many times as doubles can resolve.
        "bounds": """SELECT k, n, CASE WHEN n = 0 THEN 0.0 WHEN k = 0 THEN 1 - pow(0.05, 1.0 / n) WHEN k = n THEN 1.0
                ELSE list_reduce(list_prepend([0.0, 1.0], list_transform(range(0, 60), lambda i: [0.0, 0.0])),
                  lambda acc, x: CASE WHEN 1 - list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
                        + i * ln((acc[1] + acc[2]) / 2) + (n - i) * ln(1 - (acc[1] + acc[2]) / 2)))) < 0.95
                    THEN [(acc[1] + acc[2]) / 2, acc[2]] ELSE [acc[1], (acc[1] + acc[2]) / 2] END)[1] END AS cp_upper
            FROM (SELECT DISTINCT accepted AS k, total AS n FROM calls) d""",
        "tails": f"""SELECT k, n, CASE WHEN k = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - list_sum(list_transform(range(0, k),
                  lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({DECISION.null_probability!r}) + (n - i) * ln(1 - {DECISION.null_probability!r})))))) END AS p_value
            FROM (SELECT DISTINCT accepted AS k, total AS n FROM calls) d""",
        "gated": f"""SELECT c.*, b.cp_upper, t.p_value, count(*) OVER (PARTITION BY sample_id, round, level) AS family,
                {DECISION.positive_alpha_global!r} / (count(*) OVER (PARTITION BY sample_id, round, level) * {looks}) AS alpha,
                CASE WHEN nonoverlap >= 3 AND breadth > 0 THEN 'high' WHEN nonoverlap >= 2 OR breadth > 0 THEN 'medium' ELSE 'low' END AS strength,
                fraction > {DECISION.theta_pos!r} AS g_abundance, accepted >= {CANDIDATE.theta_pos_absolute} AS g_absolute,
                nonoverlap >= {CANDIDATE.min_nonoverlap_fragments} AS g_nonoverlap, breadth >= {CANDIDATE.min_breadth!r} AS g_breadth,
                CASE WHEN accepted > 0 THEN ambiguous::DOUBLE / accepted <= {CANDIDATE.max_ambiguous_fraction_for_positive!r} ELSE false END AS g_ambiguity,
                fraction <= {DECISION.theta_neg_operational!r} AND cp_upper <= {DECISION.negative_cp_lod_max!r} AS below
            FROM calls c JOIN bounds b ON b.k = c.accepted AND b.n = c.total JOIN tails t ON t.k = c.accepted AND t.n = c.total""",
        "cored": """SELECT *, strength IN ('high', 'moderate', 'medium') AS g_evidence, p_value <= alpha AS g_enrichment,
                g_abundance AND g_absolute AND g_nonoverlap AND g_breadth AND strength IN ('high', 'moderate', 'medium') AND p_value <= alpha AS core FROM gated""",
        "evaluated": """SELECT *, CASE WHEN core AND (level = 'group' OR g_ambiguity) THEN 'positive'
                  WHEN g_abundance AND g_absolute AND g_enrichment AND g_ambiguity THEN 'weak_positive'
                  WHEN below THEN 'negative' ELSE 'indeterminate' END AS decision,
                CASE WHEN level = 'group' THEN 'not_applicable' WHEN core AND NOT g_ambiguity THEN 'low_resolution'
                  WHEN core THEN 'high' WHEN NOT g_ambiguity THEN 'unresolved' ELSE 'high' END AS resolution FROM cored""",
        "continued": f"""SELECT e.*, {looks} <= 1 OR (e.level = 'group' AND e.round >= 2 AND p.id IS NOT NULL) AS can_stop
            FROM evaluated e LEFT JOIN (SELECT sample_id, round, level, id FROM evaluated WHERE decision = 'positive') p
              ON p.sample_id = e.sample_id AND p.round = e.round - 1 AND p.level = e.level AND p.id = e.id""",
        "level_looks": """SELECT t.sample_id, t.round, t.n, v.level,
                coalesce(bool_or(c.decision = 'positive'), false) AS pos, coalesce(bool_or(c.decision = 'positive' AND c.can_stop), false) AS pos_stop,
                coalesce(bool_or(c.decision = 'weak_positive'), false) AS weak,
                t.round >= 2 AND coalesce(bool_and(c.below), true) AS neg, coalesce(sum(c.accepted), 0)::BIGINT AS accepted
            FROM totals t CROSS JOIN (VALUES ('accession'), ('group')) v(level)
            LEFT JOIN continued c ON c.sample_id = t.sample_id AND c.round = t.round AND c.level = v.level
            GROUP BY 1, 2, 3, 4""",
        "level_outcomes": f"""SELECT *, CASE WHEN pos THEN 'positive' WHEN weak THEN 'weak_positive' WHEN neg THEN 'negative' ELSE 'indeterminate' END AS status,
                CASE WHEN pos THEN CASE WHEN level = 'accession' OR pos_stop THEN 'positive_boundary_crossed' END
                  WHEN weak THEN CASE WHEN round >= {looks} THEN 'max_rounds_reached' END
                  WHEN neg THEN 'negative_boundary_confirmed' WHEN round >= {looks} THEN 'max_rounds_reached' END AS stop
            FROM level_looks""",
        "look_outcomes": """SELECT a.sample_id, a.round, a.n AS sampled, a.accepted, a.status AS accession_status, a.stop AS accession_stop,
                g.status AS group_status, g.stop AS group_stop,
                CASE WHEN a.status = 'positive' AND a.stop IS NOT NULL THEN a.status ELSE g.status END AS status,
                CASE WHEN a.status = 'positive' AND a.stop IS NOT NULL THEN a.stop ELSE g.stop END AS stop
            FROM level_outcomes a JOIN level_outcomes g USING (sample_id, round) WHERE a.level = 'accession' AND g.level = 'group'""",
        "stops": """SELECT sample_id, coalesce(min(round) FILTER (stop IS NOT NULL), max(round)) AS final_round FROM look_outcomes GROUP BY 1""",
        "kept_looks": """SELECT o.*, s.final_round FROM look_outcomes o JOIN stops s USING (sample_id) WHERE o.round <= s.final_round""",
        "decisions": """SELECT sample_id, round AS rounds_run, sampled, accepted, status, coalesce(stop, 'max_rounds_reached') AS stop FROM kept_looks WHERE round = final_round""",
        "final_calls": """SELECT c.* FROM continued c JOIN stops s ON s.sample_id = c.sample_id AND s.final_round = c.round""",
    }


def _adjudicated(rules) -> str:
    pair = "v_pair" if rules.require_pair_consistency else "true"
    return f"""SELECT *, CASE
          WHEN v_counts AND v_mapq >= {rules.min_mapq} AND coalesce(as_diff >= {rules.min_as_diff}, false)
               AND coalesce(v_nm BETWEEN 0 AND {rules.max_nm}, false) AND NOT host_stronger AND {pair} THEN 'virus'
          WHEN h_counts AND (NOT v_counts OR host_stronger) THEN 'host'
          WHEN v_contig IS NOT NULL THEN 'ambiguous'
          WHEN h_counts THEN 'host'
          WHEN h_contig IS NOT NULL OR has_secondary THEN 'ambiguous' ELSE 'unmapped' END AS class FROM scored"""


def _chain(select: str, order: str | None) -> str:
    """Prefix ``select`` with the steps it needs."""
    steps = _ctes(order)
    needed: set[str] = set()
    pending = [select]
    while pending:
        words = set(re.findall(r"\w+", pending.pop()))
        for name in words & steps.keys() - needed:
            needed.add(name)
            pending.append(steps[name])
    parts = [f"{name} AS ({body})" for name, body in steps.items() if name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + select


def whole(select: str) -> str:
    """A query over all fragments, one look."""
    return _chain(select, None)


def sampled(select: str) -> str:
    """A query over the looks of the seeded sample."""
    return _chain(select, RANK_ORDER)


def in_input_order(select: str) -> str:
    """A query over looks taken in input order."""
    return _chain(select, INPUT_ORDER)


_BASE = {"A": 0, "C": 1, "G": 2, "T": 3}


def _entropy(seq: str) -> str:
    pairs = f"list_filter(list_transform(range(1, length({seq})), lambda i: upper(substr({seq}, i, 2))), lambda p: regexp_full_match(p, '[ACGT][ACGT]'))"
    return f"coalesce(list_entropy({pairs}), 0.0)"


def _fast(seq: str) -> str:
    u = f"upper({seq})"
    c1, c2 = f"substr({u}, 1, 1)", f"substr({u}, 2, 1)"
    m = f"(length({seq}) - 1)"
    half = lambda n: f"(CASE WHEN {n} > 0 THEN -(({n})::DOUBLE / {m}) * log2(({n})::DOUBLE / {m}) ELSE 0 END)"
    return f"""CASE WHEN regexp_full_match({u}, 'A+|C+|G+|T+') THEN 0.0
      WHEN regexp_full_match({c1}, '[ACGT]') AND regexp_full_match({c2}, '[ACGT]') AND {c1} <> {c2}
           AND regexp_full_match({u}, '(' || {c1} || {c2} || ')*' || {c1} || '?')
      THEN {half(f'({m} + 1) // 2')} + {half(f'{m} // 2')} END"""


FRAGMENTS = f"SELECT * FROM ({A.plain_sql(A.FRAGMENTS)}) f"
QC_ROWS = f"""SELECT *, {_fast('r1_seq')} AS fast1, {_fast('r2_seq')} AS fast2, {_entropy('r1_seq')} AS bits1, {_entropy('r2_seq')} AS bits2,
  (regexp_count_n(r1_seq) + regexp_count_n(r2_seq))::DOUBLE / greatest(length(r1_seq) + length(r2_seq), 1) AS nfrac FROM ({FRAGMENTS}) q""".replace(
    "regexp_count_n(r1_seq)", "len(regexp_extract_all(r1_seq, '[Nn]'))"
).replace("regexp_count_n(r2_seq)", "len(regexp_extract_all(r2_seq, '[Nn]'))")
_LEN1 = f"length(r1_seq) BETWEEN {QC.min_read_length} AND {QC.max_read_length}"
_LEN2 = f"length(r2_seq) BETWEEN {QC.min_read_length} AND {QC.max_read_length}"


def _verdict(kind: str) -> str:
    rows = [
        ("length(r1_seq) = 0", "pair_incomplete", 1, "0"),
        (f"NOT ({_LEN1})", "length", 1, "length(r1_seq)"),
        ("length(r2_seq) = 0", "pair_incomplete", 2, "0"),
        (f"NOT ({_LEN2})", "length", 2, "length(r2_seq)"),
        (f"nfrac > {QC.max_n_fraction!r}", "n_content", 0, "nfrac"),
        (f"fast1 < {QC.min_entropy_bits!r}", "low_complexity", 1, "fast1"),
        (f"fast2 < {QC.min_entropy_bits!r}", "low_complexity", 2, "fast2"),
        (f"bits1 < {QC.min_entropy_bits!r}", "low_complexity", 1, "bits1"),
        (f"bits2 < {QC.min_entropy_bits!r}", "low_complexity", 2, "bits2"),
    ]
    pick = {"reason": 1, "mate": 2, "observed": 3}[kind]
    text = lambda v: f"'{v}'" if kind == "reason" else (f"({v})::DOUBLE" if kind == "observed" else str(v))
    default = {"reason": "'pass'", "mate": "0", "observed": "nfrac"}[kind]
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {text(r[pick])}" for r in rows) + f" ELSE {default} END"


QC_VERDICTS = f"""SELECT sample_id, fragment_key, record_number, {_verdict('reason')} AS reason, {_verdict('mate')} AS mate,
  round({_verdict('observed')}, 9) AS observed FROM ({QC_ROWS}) v"""
QC_STATS = f"""SELECT sample_id, count(*) AS total_fragments, count(*) FILTER (reason = 'pass') AS passed_fragments,
  count(*) FILTER (reason = 'low_complexity') AS low_complexity_filtered, count(*) FILTER (reason = 'n_content') AS n_content_filtered,
  count(*) FILTER (reason = 'length') AS length_filtered, count(*) FILTER (reason = 'pair_incomplete') AS pair_incomplete
  FROM ({QC_VERDICTS}) s GROUP BY sample_id"""
