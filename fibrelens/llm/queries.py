"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe_automaton,
    chat_roles,
    decontamination,
    extendible_dedup,
    fill_in_middle,
    host_rules,
    maxent_lm,
    multi_index,
    page_differencing,
    randomness_tests,
    toxicity_trees,
    warc_normaliser,
    weighted_minhash,
)

#: Vocabulary file of op4 and of the pipeline's last stage.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = toxicity_trees.fold(F.col("doc_id"), 7) == 2
    scored = maxent_lm.score_texts(docs, held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_randomness_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return randomness_tests.secret_report(_table(spark, sf_dir, "documents"))


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_normaliser.round_trip(_table(spark, sf_dir, "pages"), least=0)


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.tokenize(_table(spark, sf_dir, "documents"), VOCABULARY)


def op5_extendible_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_dedup.find_duplicates(_table(spark, sf_dir, "documents")).drop("h")


def op6_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_key")


def op7_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_trees.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_roles.canonical_turns(_table(spark, sf_dir, "conversations"))


def op10_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_differencing.extract_main_text(_table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored.cast("binary"), 256).alias("restored_sha256"),
    )


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = multi_index.labelled_vectors(_table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return multi_index.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_maxent_lm,
        op2_randomness_tests,
        op3_warc_normaliser,
        op4_bpe_automaton,
        op5_extendible_dedup,
        op6_weighted_minhash,
        op7_toxicity_trees,
        op8_decontamination,
        op9_chat_roles,
        op10_page_differencing,
        op11_fill_in_middle,
        op12_multi_index,
        op13_host_rules,
    ]
    return {query.__name__: query for query in own}


def oracle_sql() -> dict[str, str]:
    """Expected results where SQL can state them."""
    return {
        "op3_warc_normaliser": WARC_SQL,
        "op5_extendible_dedup": EXACT_DEDUP_SQL,
        "op8_decontamination": DECONTAMINATION_SQL,
        "op11_fill_in_middle": FILL_IN_MIDDLE_SQL,
        "op12_multi_index": HARD_NEGATIVES_SQL,
        "op13_host_rules": HOST_RULES_SQL,
    }


WARC_SQL = """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
    FROM pages
),
bits AS (
    SELECT
        *,
        list_aggregate(
            list_transform(
                string_split(sha1(payload), ''),
                lambda d: right('000' || bin(strpos('0123456789abcdef', d) - 1), 4)
            ),
            'string_agg', ''
        ) AS sha1_bits
    FROM payloads
)
SELECT
    page_id,
    CAST(strlen(payload) AS BIGINT) AS payload_bytes,
    list_aggregate(
        list_transform(
            range(32),
            lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(list_sum(list_transform(range(5),
                lambda j: CAST(sha1_bits[CAST(5 * i + j + 1 AS INT)] AS INT) * CAST(pow(2, 4 - j) AS INT))) AS INT) + 1]
        ),
        'string_agg', ''
    ) AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM bits
"""

DECONTAMINATION_SQL = r"""
WITH lowered AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
),
doc_words AS (
    SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered
),
item_words AS (
    SELECT
        CAST(item_id AS VARCHAR) AS item,
        regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'
        ) AS w
    FROM benchmark WHERE text IS NOT NULL
),
item_windows AS (
    SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS span
    FROM item_words, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s(i)
    WHERE len(w) > 0
),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS span
    FROM doc_words, lengths, unnest(range(1, len(w) - n + 2)) AS s(i)
    WHERE len(w) >= n
),
found AS (
    SELECT d.doc_id, d.i, d.n, b.item FROM doc_windows d JOIN item_windows b ON d.n = b.n AND d.span = b.span
),
hit_words AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM found, unnest(range(i, i + n)) AS s(place) GROUP BY doc_id
),
hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT
    doc_id,
    CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


EXACT_DEDUP_SQL = """
WITH texts AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
    FROM documents
)
SELECT
    doc_id,
    max(doc_id) OVER same AS keep_id,
    count(*) OVER same AS group_size,
    doc_id = max(doc_id) OVER same AS kept,
    sha256(norm) AS text_sha256
FROM texts
WINDOW same AS (PARTITION BY norm)
"""

FILL_IN_MIDDLE_SQL = """
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
),
numbers AS (
    SELECT *, [CAST('0x' || substring(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS x FROM texts
),
cuts AS (
    SELECT
        *,
        least(x[1] % (n + 1), x[2] % (n + 1)) AS a,
        greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
        CASE
            WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 90 THEN 'plain'
            WHEN x[4] % 100 < 20 THEN 'spm'
            ELSE 'psm'
        END AS form
    FROM numbers
)
SELECT
    doc_id,
    n,
    form,
    CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form
        WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
        WHEN 'spm' THEN '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a)
        ELSE t
    END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM cuts
"""

HOST_RULES_SQL = r"""
WITH docs AS (
    SELECT
        row_number() OVER () AS rid,
        doc_id,
        coalesce(text, '') AS t,
        nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(source)), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^www\.', ''), '') AS host,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
windows AS (
    SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
    FROM docs, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 3
),
again AS (SELECT rid, s FROM windows GROUP BY rid, s HAVING count(*) > 1),
repeated AS (
    SELECT rid, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT rid, unnest(range(i, i + 3)) AS p FROM windows JOIN again USING (rid, s)) GROUP BY rid
),
lines AS (
    SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
),
measured AS (
    SELECT
        doc_id, host,
        CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
    FROM docs LEFT JOIN lines USING (rid) LEFT JOIN repeated USING (rid)
),
judged AS (
    SELECT *, [
        n_words < 50,
        100 * n_repeat_words > 50 * n_words,
        10 * n_symbols > n_words,
        10 * n_dup_lines > 3 * n_lines,
        word_chars < 2 * n_words OR word_chars > 12 * n_words
    ] AS fails
    FROM measured
),
hosts AS (
    SELECT host, rule, CAST(count(*) AS DOUBLE) AS n, CAST(count_if(fails[rule]) AS DOUBLE) AS x
    FROM judged, range(1, 6) AS rules(rule) WHERE host IS NOT NULL GROUP BY host, rule
),
sums AS (
    SELECT rule, count(*) AS h, sum(n) AS total, sum(n * n) AS nn, sum(x) / sum(n) AS m, sum(x * x / n) AS xx FROM hosts GROUP BY rule
),
priors AS (
    SELECT rule, m, CASE
        WHEN m * (1 - m) <= 0 OR total - nn / total - (h - 1) <= 0 THEN 0
        ELSE least(greatest(((xx - total * m * m) / (m * (1 - m)) - (h - 1)) / (total - nn / total - (h - 1)), 0), 1)
    END AS r
    FROM sums
),
verdicts AS (
    SELECT host, max((m * (1 - r) + x * r) / (1 - r + n * r)) <= 0.5 AS host_kept FROM hosts JOIN priors USING (rule) GROUP BY host
)
SELECT
    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    fails[1] OR fails[2] AS base_failed,
    NOT (fails[1] OR fails[2]) AND coalesce(host_kept, true) AS kept
FROM judged LEFT JOIN verdicts USING (host)
"""

HARD_NEGATIVES_SQL = """
WITH vectors AS (
    SELECT
        vec_id,
        CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
met AS (
    SELECT
        a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
        CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM met WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
),
near AS (
    SELECT
        p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
    FROM positives p JOIN met m ON m.anchor_id = p.anchor_id AND NOT m.same
     AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM near WHERE rank <= 5
"""
