"""Queries over keyed records and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as r
from ..sources.tables import activity, messages, table
from .telemetry import ACTIVITY

#: Payloads of more bytes go to a side table.
PAYLOAD_LIMIT = 4096


def j7_repair_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.repair_pairs(activity(spark, sf_dir))


def j17_compact_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = activity(spark, sf_dir).select("agent_id", "k", "ts", "event_id", "type")
    found, receipts = log.where("type = 'tool-result'"), log.where("type = 'conversation-end'")
    return r.compact_findings(found, receipts, ("agent_id", "k"), ("ts", "event_id")).select("agent_id", "k", "event_id")


def j24_sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.col("p_name").alias("title"), F.col("p_size").alias("size"))
    side = lambda skip, odd: parts.where(F.col("n") % skip != 0).select(F.col("n").alias("name"), F.md5(F.concat("title", F.when(F.col("n") % odd == 0, F.col("size").cast("string")).otherwise(""))).alias("hash"))
    return r.sync_diff(side(7, 3), side(5, 11), side(4, 2))


def u8_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    updates = customers.where("c_custkey % 3 = 0").select(F.when(F.col("c_custkey") % 9 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("value"))
    return r.upsert(customers.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value")), updates, "id", "value")


def u7_resolve_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    return r.resolve_ids(keys.select((F.col("c_custkey") + 7).cast("string").alias("ref")), keys.select((F.col("c_custkey") * 13).cast("string").alias("id")))


def u1_distinct_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.distinct_queries(messages(spark, sf_dir).where("role = 'user'"), "content", "id")


def s10_externalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot, _ = r.externalised(table(spark, sf_dir, "documents"), "doc_id", "text", PAYLOAD_LIMIT)
    return hot


def s10_side_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, side = r.externalised(table(spark, sf_dir, "documents"), "doc_id", "text", PAYLOAD_LIMIT)
    return side


_side = "(SELECT p_partkey AS name, md5(p_name || CASE WHEN p_partkey % {odd} = 0 THEN p_size::VARCHAR ELSE '' END) AS hash FROM part WHERE p_partkey % {skip} <> 0)"
ORACLES = {
    "j7_repair_pairs": f"""WITH {ACTIVITY} SELECT agent_id, event_id, 'kept' AS kind FROM a WHERE type IS DISTINCT FROM 'tool-result' OR EXISTS (SELECT 1 FROM a c WHERE c.type = 'tool-call' AND c.agent_id = a.agent_id AND c.k = a.k)
      UNION ALL SELECT agent_id, event_id, 'stub' FROM a WHERE type = 'tool-call' AND NOT EXISTS (SELECT 1 FROM a c WHERE c.type = 'tool-result' AND c.agent_id = a.agent_id AND c.k = a.k)""",
    "j17_compact_findings": f"""WITH {ACTIVITY}, f AS (SELECT *, EXISTS (SELECT 1 FROM a c WHERE c.type = 'conversation-end' AND c.agent_id = a.agent_id AND c.k = a.k) AS seen FROM a WHERE type = 'tool-result'),
      o AS (SELECT *, row_number() OVER (PARTITION BY seen ORDER BY ts DESC, event_id DESC) AS rank FROM f) SELECT agent_id, k, event_id FROM o WHERE NOT seen OR rank <= 32""",
    "j24_sync_diff": f"""SELECT coalesce(b.name, m.name) AS name, CASE WHEN b.name IS NULL THEN 'removed_upstream' WHEN m.name IS NULL THEN 'new' WHEN o.name IS NULL THEN 'deletion_kept' WHEN o.hash IS DISTINCT FROM m.hash THEN 'modified_kept' WHEN b.hash IS DISTINCT FROM m.hash THEN 'updated' ELSE 'unchanged' END AS action
      FROM {_side.format(skip=7, odd=3)} b FULL JOIN {_side.format(skip=5, odd=11)} m ON b.name = m.name LEFT JOIN {_side.format(skip=4, odd=2)} o ON o.name = coalesce(b.name, m.name)""",
    "u8_upsert": """WITH u AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN -c_custkey ELSE c_custkey END AS id, CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_name END AS value FROM customer WHERE c_custkey % 3 = 0)
      SELECT coalesce(c.c_custkey, u.id) AS id, coalesce(nullif(trim(u.value), ''), c.c_mktsegment) AS value FROM customer c FULL JOIN u ON c.c_custkey = u.id""",
    "u7_resolve_ids": """WITH i AS (SELECT (c_custkey * 13)::VARCHAR AS id FROM customer), r AS (SELECT DISTINCT (c_custkey + 7)::VARCHAR AS ref FROM customer)
      SELECT ref, CASE WHEN max(id = ref) THEN ref WHEN count(id) = 1 THEN min(id) END AS id FROM r LEFT JOIN i ON starts_with(id, ref) GROUP BY ref""",
    "u1_distinct_queries": "WITH m AS (SELECT conv_id * 1000 + turn AS id, text AS content, row_number() OVER (PARTITION BY lower(text) ORDER BY conv_id * 1000 + turn) AS n FROM conversations WHERE role = 'user' AND text IS NOT NULL) SELECT id, content FROM m WHERE n = 1 ORDER BY id LIMIT 4",
    "s10_externalised": f"SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS size, CASE WHEN strlen(text) > {PAYLOAD_LIMIT} THEN sha256(text) END AS digest, CASE WHEN coalesce(strlen(text), 0) <= {PAYLOAD_LIMIT} THEN text END AS text FROM documents",
    "s10_side_table": f"SELECT DISTINCT sha256(text) AS digest, text FROM documents WHERE strlen(text) > {PAYLOAD_LIMIT}",
}
QUERIES = {f.__name__: f for f in (j7_repair_pairs, j17_compact_findings, j24_sync_diff, u8_upsert, u7_resolve_ids, u1_distinct_queries, s10_externalised, s10_side_table)}
