"""The operators' queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, mixing, ngram_join, packing, pii, quality_ranking, quality_rules, sharding, substrings, toxicity
from millrace.llm.text import table
from millrace.storage import staged


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 under the law ``key``."""
    shuffled = sharding.external_shuffle(table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = shuffled.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        "shard",
        "grown_shard",
        "_bucket",
        "_pos",
    )
    return sharding.with_slots(digest, "doc_id", "size", "text_crc32").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.factorization_machine(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_groups(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    import public_tokenizers

    pieces = packing.tokenized_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digest)


def op7_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ranking.bradley_terry(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document under weights 5, 2, 1 and 150% of all sizes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each document and the verdict with its host (the column ``source``)."""
    docs = table(spark, sf_dir, "documents")
    metrics = staged(quality_rules.document_metrics(docs).drop("text", "lang", "n_chars"), "rules-metrics")
    return quality_rules.quality_rules(metrics).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_sharding,
            op2_toxicity,
            op3_suffix_array_dedup,
            op4_pii,
            op5_ngram_join,
            op6_packing,
            op7_quality_ranking,
            op8_exact_dedup,
            op9_mixing,
            op10_quality_rules,
        )
    }


_OP8 = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents),
g AS (SELECT n, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM t JOIN g USING (n)
"""

_OP10 = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM t),
x AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, array_to_string(w[k:k + 7], ' ')) AS c FROM i),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(k, k + 8)) AS j FROM x WHERE c > 1) GROUP BY 1),
m AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN d USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS f1, 100 * n_symbols > 10 * word_chars AS f2, 100 * n_dup_lines > 30 * n_lines AS f3 FROM m),
h AS (SELECT source, count(*) AS n, sum(f1::INT) AS f1, sum(f2::INT) AS f2, sum(f3::INT) AS f3 FROM b GROUP BY 1),
p AS (SELECT avg(f1 / n) AS m1, var_pop(f1 / n) AS v1, avg(f2 / n) AS m2, var_pop(f2 / n) AS v2, avg(f3 / n) AS m3, var_pop(f3 / n) AS v3 FROM h),
q AS (SELECT *, CASE WHEN v1 > 0 THEN least(1e6, greatest(1, m1 * (1 - m1) / v1 - 1)) ELSE 1e6 END AS s1,
  CASE WHEN v2 > 0 THEN least(1e6, greatest(1, m2 * (1 - m2) / v2 - 1)) ELSE 1e6 END AS s2,
  CASE WHEN v3 > 0 THEN least(1e6, greatest(1, m3 * (1 - m3) / v3 - 1)) ELSE 1e6 END AS s3 FROM p),
v AS (SELECT source, (f1 + m1 * s1) / (n + s1) <= 0.9 AND (f2 + m2 * s2) / (n + s2) <= 0.9 AND (f3 + m3 * s3) / (n + s3) <= 0.9 AS ok FROM h CROSS JOIN q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 AS base_failed, NOT f1 AND ok AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators whose whole result it can express; the others are tested against brute force."""
    return {"op8_exact_dedup": _OP8, "op10_quality_rules": _OP10}
