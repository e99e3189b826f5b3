"""Registered queries of the operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from public_tokenizers import path as tokenizer_path

from siftline.llm import chat, decontaminate, merkle, mixing, periodic, pii, secrets, simhash, substrings, tokens, topk, toxicity, wavelet
from siftline.llm.shared import WORD, crc32_of_id, new_folder, table

END_ID = 1
# A key of one's own belongs here; this one only makes the registered query repeatable.
PII_KEY = b"registered query"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def registered(build):
    QUERIES[build.__name__] = build
    return build


@registered
def op1_offset_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.attributed(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@registered
def op2_nonnegative_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id",
        F.coalesce(F.pmod(crc32_of_id("doc_id"), F.lit(3)) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.REJECTED).cast("int").alias("predicted"),
    )


@registered
def op3_relational_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kept = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(kept).alias("text"))
    found = chat.conversations(turns.unionByName(own))
    read = chat.turns_of(F.col("formatted"))
    lines = F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return found.withColumns({"turns": read, "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))}).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE["op3_relational_chat_format"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), near AS (
    SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), pieces AS (
    SELECT *, CASE WHEN before = role THEN '[NEXT]' ELSE '<s>[ROLE]' || regexp_replace(role, CONTROL, '\1\\\2\3', 'g') || '[/ROLE]' END
        || regexp_replace(text, CONTROL, '\1\\\2\3', 'g') || CASE WHEN after = role THEN '' ELSE '</s>' END AS piece
    FROM near
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM pieces GROUP BY conv_id
""".replace("CONTROL", f"'{chat.CONTROL}'")


@registered
def op4_surrogate_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.with_surrogates(docs, PII_KEY)


@registered
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = decontaminate.bounded_items(table(spark, sf_dir, "benchmark"))
    found = decontaminate.matches(table(spark, sf_dir, "documents"), items)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE["op5_benchmark_decontamination"] = """
WITH item AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)
), doc AS (
    SELECT doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), places AS (
    SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS s
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), found AS (
    SELECT doc_id, places.i, places.size, item_id FROM places JOIN windows USING (size, s)
), hits AS (
    SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM found) GROUP BY doc_id
), names AS (
    SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS items
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(names.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)
"""


@registered
def op6_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("v"))
    return topk.top_k(rows, rows.filter("id % 20 = 0"))


ORACLE["op6_threshold_top_k"] = """
WITH usable AS (
    SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT * FROM (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores
) WHERE rank <= 20
"""


@registered
def op7_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    many = lambda number: F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))
    return found.select(
        "doc_id",
        *(many(i).alias(f"n_{rule.kind}") for i, rule in enumerate(secrets.BASE)),
        F.sha2(secrets.spelled(base), 256).alias("base_sha256"),
        secrets.spelled(F.col("spans")).alias("spans"),
    )


def secret_sql() -> str:
    found = []
    for number, rule in enumerate(secrets.RULES):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        found.append(f"""SELECT doc_id, row_no, {number} AS kind, '{rule.kind}' AS name, gaps, hits, checked, {rule.least} AS least FROM (
            SELECT doc_id, row_no, string_split_regex(text, {pattern}) AS gaps, regexp_extract_all(text, {pattern}) AS hits,
                regexp_extract_all(text, {pattern}, {rule.group}) AS checked FROM texts WHERE regexp_matches(text, {pattern}))""")
    rows = " UNION ALL ".join(found)
    return f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS row_no, coalesce(text, '') AS text FROM documents),
kinds AS ({rows}),
places AS (
    SELECT row_no, kind, name, least, checked[i] AS part, len(hits[i]) AS size,
        list_sum([len(g) FOR g IN gaps[1:i]]) + coalesce(list_sum([len(h) FOR h IN hits[1:i - 1]]), 0) AS start
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM kinds)
),
spans AS (SELECT row_no, kind, CAST(start AS BIGINT) AS start, name || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT) AS span FROM places WHERE len(part) >= least),
per_row AS (
    SELECT row_no, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans
    FROM spans GROUP BY row_no
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN per_row USING (row_no)
"""


ORACLE["op7_trigram_secret_scan"] = secret_sql()


@registered
def op8_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@registered
def op9_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents"))


def token_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Token files written to a new shared folder and read back."""
    folder = new_folder(spark, "token-files")
    wavelet.write_token_files(docs, folder, tokenizer_path("word_bpe_49k.json"), END_ID)
    return wavelet.read_token_files(spark, folder)


@registered
def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def planted(text: Column, h: Column) -> Column:
    """The text with a tail of its words written over by a period, where ``h`` divides by ten."""
    g = F.floor(h / 10).cast("long")

    def written_over(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = F.floor((n - a) / (3 + g % 8)).cast("int") + 1
        tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")

    # Through a lambda, so that the words are taken once.
    changed = F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"))), lambda w: F.when(F.size(w) > 0, written_over(w)).otherwise(""))
    return F.when(h % 10 == 0, changed[0]).otherwise(text)


@registered
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), crc32_of_id("doc_id")).alias("text"))
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    # Runs come by start, then period: a later one must be better to be taken.
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", none, lambda best, r: F.when(better(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return periodic.with_runs(docs).withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@registered
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op12_substring_dedup"] = r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM doc WHERE len(w) >= 50)
), later AS (
    SELECT doc_id, i FROM windows JOIN (SELECT s, min(doc_id) AS least FROM windows GROUP BY s) USING (s) WHERE doc_id > least
), gone AS (
    SELECT doc_id, list(DISTINCT word) AS words FROM (SELECT doc_id, unnest(range(i, i + 50)) AS word FROM later) GROUP BY doc_id
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM doc) each
    WHERE NOT EXISTS (FROM (SELECT doc_id, unnest(words) AS i FROM gone) g WHERE g.doc_id = each.doc_id AND g.i = each.i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone.words), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM doc LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@registered
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = [c if name != "n_chars" else c.cast("decimal(20, 0)") + 1 for name, c in zip(("doc_id", "source", "lang", "n_chars", "text"), named)]
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "lang",
        merkle.leaf(*named).alias("leaf"),
        F.when(crc32_of_id("doc_id") % 7 == 0, merkle.leaf(*tampered)).alias("tampered"),
    )
    found = merkle.manifest(rows, "leaf", "lang", "doc_id")
    return found.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), "witness")).select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(merkle.siblings("witness"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


# A node's steps up its tree: its sibling's digest behind the side it stands on; nothing where it has none.
STEPS = """
    SELECT n.name, list(CASE WHEN s.digest IS NULL THEN '' WHEN s.place % 2 = 0 THEN 'L' || s.digest ELSE 'R' || s.digest END ORDER BY t.level) AS steps
    FROM {leaves} n JOIN {tree} t ON t.lang = n.lang AND t.place = n.place >> t.level AND t.size > 1
    LEFT JOIN {tree} s ON s.lang = t.lang AND s.level = t.level AND s.place = xor(t.place, 1) GROUP BY n.name
"""
GROWN = """
    SELECT lang, level + 1, place // 2, (size + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM {tree} WHERE size > 1 GROUP BY lang, level, place // 2, size
"""
FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"

CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda crc, b:
        list_reduce(list_prepend(xor(crc, b), [0::BIGINT FOR i IN range(8)]), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"""

ORACLE["op13_merkle_manifest"] = f"""
WITH RECURSIVE row_leaves AS (
    SELECT row_number() OVER () AS name, doc_id, coalesce('=' || lang, '') AS lang,
        sha256({" || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
        sha256({" || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text"))}) AS tampered
    FROM documents
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size FROM row_leaves
), tree(lang, level, place, size, digest) AS (
    SELECT lang, 0, place, size, leaf FROM leaves UNION ALL {GROWN.format(tree="tree")}
), tops AS (
    SELECT lang AS name, '' AS lang, row_number() OVER (ORDER BY lang) - 1 AS place, count(*) OVER () AS size, digest FROM tree WHERE size = 1
), crown(lang, level, place, size, digest) AS (
    SELECT lang, 0, place, size, digest FROM tops UNION ALL {GROWN.format(tree="crown")}
), low AS ({STEPS.format(leaves="leaves", tree="tree")}), high AS ({STEPS.format(leaves="tops", tree="crown")}),
proofs AS (
    SELECT doc_id, leaf, tampered, tops.digest AS subroot, (SELECT digest FROM crown WHERE size = 1) AS root,
        list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
    FROM leaves JOIN tops ON tops.name = leaves.lang LEFT JOIN low ON low.name = leaves.name LEFT JOIN high ON high.name = leaves.lang
), ids AS (
    SELECT doc_id, {CRC32} AS crc FROM (SELECT DISTINCT doc_id FROM documents)
), folds AS (
    SELECT proofs.*, list_reduce(list_prepend(CASE WHEN crc % 7 = 0 THEN coalesce(tampered, leaf) ELSE leaf END, steps),
        lambda node, step: sha256(CASE WHEN step = '' THEN node WHEN step[1] = 'L' THEN step[2:] || node ELSE node || step[2:] END)) AS folded_root
    FROM proofs LEFT JOIN ids ON ids.doc_id = proofs.doc_id
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([s[2:] FOR s IN steps IF s <> ''], '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folds
"""
