"""The queries of this subpackage and, where SQL can express them, their oracles (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, classifier, fingerprints, licenses, manifest, mixing, oracles, quality_rules, secrets, simhash, suffixes, token_counts, trie
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edit(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=2).select("doc_id", "fingerprint", "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classifier.train(docs, table(spark, sf_dir, "labels").where(~_held_out()))
    scored = classifier.score(docs, model)
    return scored.select("doc_id", _held_out().alias("held_out"), "score", "predicted")


def owners() -> dict:
    """In `documents` a source is an owner, and what it has in one language is a repository of its own."""
    return {"repo": F.concat_ws("/", "source", "lang"), "owner": F.col("source")}


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"), **owners())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.recover(table(spark, sf_dir, "conversations"), learn=F.crc32(F.col("conv_id").cast("string")) % 5 != 0)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.dataset_manifest(table(spark, sf_dir, "documents"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_fingerprints, op3_simhash, op4_token_counts, op5_licenses, op6_quality_classifier, op7_secrets, op8_mixing, op9_quality_rules, op10_chat_format, op11_manifest, op12_trie, op13_suffix_dedup)}


MIX_SQL = r"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM per),
caps AS (SELECT *, (2 * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM ranked),
steps AS (
  SELECT *, coalesce(sum(cap) OVER w, 0.0::DOUBLE) AS cap_before, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0::DOUBLE) AS weight_left
  FROM caps WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (SELECT *, (budget - cap_before) * weight >= cap * weight_left AS stops FROM steps),
shared AS (SELECT *, sum(CASE WHEN stops THEN cap ELSE 0.0::DOUBLE END) OVER () AS capped, sum(CASE WHEN stops THEN 0.0::DOUBLE ELSE weight END) OVER () AS sharing FROM stop),
target AS (SELECT source, source_size, CASE WHEN stops THEN cap ELSE (budget - capped) * weight / sharing END AS target FROM shared),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM s JOIN target t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(floor(target) - epochs * source_size - before, 0), size))::BIGINT AS taken
FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": MIX_SQL, "op11_manifest": oracles.MANIFEST_SQL, "op12_trie": oracles.TRIE_SQL, "op13_suffix_dedup": oracles.REPEATS_SQL}
