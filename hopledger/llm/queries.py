"""The registered query of each operator and, where SQL can say the same, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopledger.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op2_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hopledger.llm.minmax_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


SQL["op2_minmax_dedup"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
    SELECT a, b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
        FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
    ) JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
    SELECT DISTINCT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
    SELECT a, min(b) AS m FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least ON a = d.doc_id
"""


@query
def op9_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hopledger.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL["op9_hash_threshold_mix"] = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
    FROM documents
), ranked AS (
    SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
    FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)
), filled AS (
    SELECT *, coalesce(sum(source_size) OVER before, 0) AS full_words, coalesce(sum(w) OVER before, 0) AS full_weight,
           sum(source_size) OVER () AS words, sum(w) OVER () AS weight
    FROM ranked WINDOW before AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (
    SELECT *, (1.5 * words - 2 * full_words)::DOUBLE * w / (weight - full_weight)::DOUBLE > 2.0 * source_size AS is_full FROM filled
), targets AS (
    SELECT source, source_size, CASE WHEN is_full THEN 2.0 * source_size ELSE
        (1.5 * words - 2 * coalesce(sum(source_size) FILTER (is_full) OVER (), 0))::DOUBLE * w
        / (weight - coalesce(sum(w) FILTER (is_full) OVER (), 0))::DOUBLE END::DOUBLE AS target
    FROM judged
), groups AS (
    SELECT s.source, h, sum(size)::BIGINT AS words, any_value(source_size) AS source_size, any_value(target) AS target,
           CASE WHEN any_value(source_size) > 0 AND any_value(target) >= any_value(source_size)
                THEN floor(any_value(target) / any_value(source_size)) ELSE 0 END::BIGINT AS base
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source GROUP BY s.source, h
), running AS (
    SELECT *, target - base * source_size AS budget, sum(words) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto FROM groups
), ended AS (
    SELECT *, min(CASE WHEN upto > budget THEN h END) OVER (PARTITION BY source) AS boundary FROM running
), taken AS (
    SELECT source, h, source_size, target, base + CASE
        WHEN boundary IS NULL OR h < boundary THEN 1
        WHEN h = boundary AND words - (budget - (upto - words)) < budget - (upto - words) THEN 1 ELSE 0 END AS copies
    FROM ended
)
SELECT doc_id, size, source_size, target, (least(copies, 2) * size)::BIGINT AS taken
FROM sized s JOIN taken t ON s.source IS NOT DISTINCT FROM t.source AND s.h = t.h
"""


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from hopledger.llm.byte_bpe import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@query
def op1_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hopledger.llm.toxicity import score_held_out

    return score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_language_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hopledger.llm.language import identify_held_out

    return identify_held_out(table(spark, sf_dir, "documents"))


@query
def op6_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hopledger.llm.warc import pages_through_archives

    return pages_through_archives(table(spark, sf_dir, "pages"))


SQL["op6_warc_captures"] = """
WITH digested AS (
    SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM digested
)
SELECT page_id, url, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM firsts
"""


@query
def op7_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hopledger.llm.disclosure import find

    return find(table(spark, sf_dir, "documents")).drop("terms")


@query
def op5_host_suffix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hopledger.llm.main_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


@query
def op3_columnar_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hopledger.llm.exact_search import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"))


SQL["op3_columnar_top_k"] = """
WITH v AS (
    SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter([isfinite(coalesce(x, 'nan'::FLOAT)) FOR x IN embedding], lambda ok: NOT ok)) = 0
), pairs AS (
    SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs) WHERE rank <= 5
"""


@query
def op4_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hopledger.llm.projected_search import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op11_eigen_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hopledger.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hopledger.llm.hard_negatives import mine

    embeddings = table(spark, sf_dir, "embeddings")
    return mine(embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


SQL["op13_strassen_negatives"] = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS kind, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
    FROM embeddings WHERE label IS NOT NULL
      AND len(embedding) > 0 AND len(list_filter([isfinite(coalesce(x, 'nan'::FLOAT)) FOR x IN embedding], lambda ok: NOT ok)) = 0
), pairs AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.kind = b.kind AS same, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


@query
def op12_sentencepiece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from hopledger.llm.sentence_pieces import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
