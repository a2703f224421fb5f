"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemograph.llm import (
    bpe_codec, ctw, fim, hard_negatives, html_text, impact_search, line_dedup, near_dedup, packing,
    pii, preference, quality, token_counts)
from mnemograph.llm.common import documents, stage, table, tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]
#: Only a stand-in: whoever runs this on real data passes a secret of their own.
PII_KEY = b"pseudonyms of the registered query"
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.matched_lines(documents(spark, sf_dir), links=True)
    return lines.select(F.col("doc").alias("doc_id"), F.col("line").alias("line_no"),
                        "class_doc", "class_line", "class_t1", "class_t2", "to_doc", "to_line", "n_links",
                        "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(*quality.fitted(documents(spark, sf_dir), table(spark, sf_dir, "labels")))


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scored(documents(spark, sf_dir))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_preferences(
        preference.stale_reply_pairs(table(spark, sf_dir, "conversations")))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path(WORD_BPE), digest=True)


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymized(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY,
                             spans_col="found")
    return done.select("doc_id", "text", "found", F.size("found").alias("n_found"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dedup.near_classes(documents(spark, sf_dir))
    return near_dedup.class_ids(classes).withColumnRenamed("doc", "doc_id")


def op8_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = impact_search.numbered(impact_search.quantised(table(spark, sf_dir, "embeddings")))
    index = stage(impact_search.build_index(vectors), "impact-index")
    return impact_search.search(index, vectors.where(F.col("id") % 100 == 0), 10)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe_codec.encode(documents(spark, sf_dir), tokenizer_path(WORD_BPE), decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.over_limit(
        token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path(BYTE_BPE)))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(documents(spark, sf_dir)))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.length("text").cast("bigint"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.fixed_rows(table(spark, sf_dir, "embeddings"), label)
    return hard_negatives.mined(rows, F.col("id") % 50 == 0)


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_context_tree": op3_context_tree,
    "op4_preferences": op4_preferences,
    "op5_best_fit": op5_best_fit,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_near_dedup": op7_near_dedup,
    "op8_impact_search": op8_impact_search,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_token_counts": op10_token_counts,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_main_text": op12_main_text,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op4_preferences": """
WITH reply AS (
    SELECT conv_id, min(turn) AS f, max(turn) AS l FROM conversations
    WHERE role = 'assistant' GROUP BY conv_id),
stale AS (
    SELECT c.conv_id, min(c.text) AS text FROM conversations c JOIN reply r
    ON c.conv_id = r.conv_id AND c.turn = r.f AND c.role = 'assistant' GROUP BY c.conv_id),
rejected AS (
    SELECT c.conv_id, c.turn, c.role,
           CASE WHEN c.role = 'assistant' AND c.turn = r.l THEN s.text ELSE c.text END AS text
    FROM conversations c LEFT JOIN reply r ON c.conv_id = r.conv_id
    LEFT JOIN stale s ON c.conv_id = s.conv_id
    WHERE r.l IS NULL OR NOT (c.role = 'assistant' AND c.turn = r.l AND r.f = r.l)),
side AS (
    SELECT 'chosen' AS part, conv_id, turn, role, text FROM conversations
    UNION ALL SELECT 'rejected', conv_id, turn, role, text FROM rejected),
split AS (
    SELECT conv_id, min(turn) AS split FROM (
        SELECT conv_id, turn FROM side GROUP BY conv_id, turn
        HAVING count(*) < 2 OR count(DISTINCT role || chr(0) || text) > 1) GROUP BY conv_id),
placed AS (
    SELECT s.conv_id AS pair_id,
           CASE WHEN p.split IS NULL OR s.turn < p.split THEN 'prompt' ELSE s.part END AS part,
           s.turn AS position, s.role,
           '<|' || s.role || '|>' || chr(10) || s.text || '<|end|>' || chr(10) AS rendered
    FROM side s LEFT JOIN split p ON s.conv_id = p.conv_id
    WHERE s.part = 'chosen' OR s.turn >= p.split)
SELECT pair_id, part, position, role, rendered,
       CAST(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY position)
            - length(rendered) AS BIGINT) AS start,
       part <> 'prompt' AND role = 'assistant' AS trained,
       CASE WHEN part <> 'prompt' AND role = 'assistant'
            THEN CAST(length(role) + 5 AS BIGINT) END AS trained_from
FROM placed""",
    "op8_impact_search": """
WITH v AS (
    SELECT row_number() OVER () AS row, vec_id, [CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) FOR x IN embedding] AS q
    FROM embeddings
    WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
    SELECT a.row, a.vec_id AS query_id, b.vec_id,
           CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.row <> b.row WHERE a.vec_id % 100 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS r FROM s)
WHERE r <= 10""",
    "op11_fill_in_middle": """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t,
           sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
u AS (
    SELECT doc_id, t, length(t) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1,
           CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3,
           CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
f AS (
    SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a,
           greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                     OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
    SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid,
           substring(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p""",
    "op13_hard_negatives": """
WITH v AS (
    SELECT row_number() OVER () AS row, vec_id,
           CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS q
    FROM embeddings
    WHERE label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
    SELECT a.row, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
           CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.row <> b.row AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
p AS (
    SELECT row, anchor_id, vec_id AS positive_id, score AS positive_score,
           row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS place
    FROM s WHERE same QUALIFY place <= 5)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.row, place ORDER BY s.score DESC, s.vec_id) AS r
      FROM p JOIN s ON p.row = s.row AND NOT s.same
           AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
WHERE r <= 3""",
}
