"""The registered queries of this subpackage: thin functions that read whole tables and call one operator each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tempolane.llm.archives import archive_pages
from tempolane.llm.classifier import classify
from tempolane.llm.counting import count_tokens, review_edits
from tempolane.llm.exact import exact_duplicates
from tempolane.llm.extract import extract_pages
from tempolane.llm.likelihood import score_documents
from tempolane.llm.near import near_duplicates
from tempolane.llm.packing import best_fit
from tempolane.llm.pieces import encode_decode
from tempolane.llm.private import span_report
from tempolane.llm.resampling import resample
from tempolane.llm.rules import quality_rules
from tempolane.llm.shared import read
from tempolane.llm.vectors import compress

#: Place of the merge-type vocabulary file; a parameter of every operator that uses it.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Place of the byte-level vocabulary as ranks, and the pattern of its pre-tokens.
BYTE_RANKS, BYTE_PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"), PIECE_MODEL)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), BYTE_RANKS, BYTE_PATTERN, review_edits())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(read(spark, sf_dir, "documents"), BYTE_RANKS, BYTE_PATTERN)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(read(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_warc": op5_warc,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_personal_data": op12_personal_data,
    "op13_vector_codes": op13_vector_codes,
}


def _assign(k: int) -> str:
    return f"""
        assigned{k} AS (
            SELECT vec_id, p, any_value(m.v) AS v, min(64 * list_sum(list_transform(range(1, len(m.v) + 1), lambda i: (m.v[i] - b.v[i]) * (m.v[i] - b.v[i]))) + entry)::BIGINT AS best
            FROM parts m JOIN book{k} b USING (p) GROUP BY vec_id, p)"""


def _update(k: int) -> str:
    return f"""
        sums{k} AS (SELECT p, best % 64 AS entry, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS mean FROM assigned{k}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY ALL),
        book{k + 1} AS (
            SELECT p, entry, coalesce(new, v) AS v
            FROM book{k} LEFT JOIN (SELECT p, entry, list(mean ORDER BY i) AS new FROM sums{k} GROUP BY p, entry) USING (p, entry))"""


ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_importance_resampling": r"""
        WITH crc_table AS (
            SELECT list(c ORDER BY b) AS t FROM (
                SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))),
        words AS (
            SELECT doc_id, 0 AS side, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
            UNION ALL
            SELECT NULL, 1, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
        vocabulary AS (
            SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)),
        hashed AS (
            SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, i::INT + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
            FROM vocabulary, crc_table),
        counted AS (SELECT doc_id, side, bucket, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY ALL),
        sums AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM counted GROUP BY bucket),
        totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS sa, coalesce(sum(t), 0)::DOUBLE AS ta FROM sums),
        gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (sa + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (ta + 10000))))::BIGINT AS gain FROM sums, totals),
        weighed AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
        scored AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM documents LEFT JOIN weighed USING (doc_id)),
        placed AS (
            SELECT *, n_features >= 20 AS eligible, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, 10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS drawn FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= drawn THEN place END AS rank FROM placed
    """,
    "op13_vector_codes": f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS ints FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS (SELECT vec_id, p, ints[p * len(ints) // 16 + 1 : (p + 1) * len(ints) // 16] AS v FROM kept, range(16) r(p)),
        book0 AS (SELECT p, entry, v FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64) USING (vec_id)),
        {_assign(0)}, {_update(0)}, {_assign(1)}, {_update(1)}, {_assign(2)},
        coded AS (SELECT vec_id, string_agg(lower(lpad(hex(best % 64), 2, '0')), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM assigned2 GROUP BY vec_id),
        digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM book2)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
        FROM kept JOIN coded USING (vec_id), digest
    """,
}
