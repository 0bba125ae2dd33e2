"""The registered queries of this subpackage and their DuckDB statements.

Each reads its whole table and returns the operator's whole result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylink.llm import oracles
from keylink.llm.centroids import cluster_vectors
from keylink.llm.chat import link_quotes
from keylink.llm.fingerprints import compare_with_edits
from keylink.llm.html_text import extract_text
from keylink.llm.kernel_quality import score_quality
from keylink.llm.lexical import search
from keylink.llm.mixing import mix
from keylink.llm.near_dedup import near_duplicates
from keylink.llm.packing import pack
from keylink.llm.pii import find_personal, spans_text
from keylink.llm.quality import quality
from keylink.llm.substring_dedup import drop_repeated_words
from keylink.llm.suffix_index import drop_repeated_bytes

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs, with_text=False).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def op2_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), with_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_left", "base_failed", "kept",
    )


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op5_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op7_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents"), with_text=False)
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(spans_text(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op8_de_bruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return drop_repeated_words(docs, with_text=False).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))


def op10_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return drop_repeated_bytes(docs, with_text=False).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def op11_laesa_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cluster_vectors(vectors).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op12_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels"), with_text=False)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op13_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chosen_path": op1_chosen_path,
    "op2_quotation_links": op2_quotation_links,
    "op3_line_frequency": op3_line_frequency,
    "op4_pack": op4_pack,
    "op5_block_tree": op5_block_tree,
    "op6_poisson_mix": op6_poisson_mix,
    "op7_boosted_pii": op7_boosted_pii,
    "op8_de_bruijn": op8_de_bruijn,
    "op9_simhash": op9_simhash,
    "op10_suffix_levels": op10_suffix_levels,
    "op11_laesa_clusters": op11_laesa_clusters,
    "op12_kernel_quality": op12_kernel_quality,
    "op13_norm_buckets": op13_norm_buckets,
}

ORACLES: dict[str, str] = {
    "op11_laesa_clusters": oracles.clusters(),
    "op13_norm_buckets": oracles.ranked(),
    "op6_poisson_mix": """
WITH counts AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, pow(n, 0.5) / (SELECT sum(pow(n, 0.5)) FROM counts)
    * (SELECT sum(n) FROM counts) / n AS rate
  FROM counts),
terms AS (
  SELECT source, rate, k::BIGINT AS k,
    sum(CASE WHEN k = 0 THEN 0 ELSE ln(greatest(k, 1)::DOUBLE) END)
      OVER (PARTITION BY source ORDER BY k) AS log_factorial
  FROM rates, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS t(k)),
bounds AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - log_factorial))
    OVER (PARTITION BY source ORDER BY k) AS bound
  FROM terms),
uniform AS (
  SELECT *, (('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5)
    / 4503599627370496.0 AS u
  FROM documents),
copies AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, b.k::INTEGER AS copy
  FROM uniform d JOIN bounds b ON d.source IS NOT DISTINCT FROM b.source AND b.bound <= d.u)
SELECT *, ('0x' || substr(md5('0|order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy), 1, 15))::BIGINT
  AS shuffle_key
FROM copies""",
}
