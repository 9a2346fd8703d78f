"""Streaming queries: each drains the log as a stream of files; the oracles are those of the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import activity_of
from ..streaming import live
from . import telemetry


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_of(live.read(spark, sf_dir, "events"))


def x1_agent_status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = live.newest(live.drained(live.agent_status(_log(spark, sf_dir)), "update"), "agent_id")
    return last.selectExpr("agent_id", "n_events", "first.event_id AS first_event", "last.event_id AS last_event", "last.type AS last_type", "move.status AS status", "api_calls")


def x3_loop_guard_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drained(live.loop_guard(_log(spark, sf_dir)).where("decision <> 'none'"))


def x5_backoff_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drained(live.backoff(_log(spark, sf_dir)))


def x6_failure_budget_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drained(live.failure_budget(_log(spark, sf_dir)))


def x12_consume_once_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drained(live.consume_once(_log(spark, sf_dir).where("type = 'tool-result'"), "run_id", "k"))


def s9_activity_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One copy of the log by run; the agent's copy is a filter on reading."""
    return live.drained(_log(spark, sf_dir), partition_by=("run_id",)).select("event_id", "run_id", "agent_id", "type")


def x2_publish_once_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drained(live.publish_once(_log(spark, sf_dir).where("type = 'tool-result'"), "run_id", "k"))


def x4_circuit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drained(live.circuit(calls(_log(spark, sf_dir)), "run_id"))


def calls(activity: DataFrame) -> DataFrame:
    """The log as calls: failures are results, a third of them timeouts, with k mod 3 as their fingerprint."""
    return activity.where("type in ('tool-result', 'conversation-end')").selectExpr("run_id", "ts", "event_id", "CASE WHEN type = 'conversation-end' THEN 'ok' WHEN k % 3 = 0 THEN 'timeout' ELSE 'error' END AS outcome", "CAST(k % 3 AS STRING) AS fingerprint")


def x9_route_epochs_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drained(live.route_epochs(_log(spark, sf_dir), "agent_id"))


_A = telemetry.ACTIVITY
ORACLES = {
    "x1_agent_status_stream": telemetry.ORACLES["a22_merge_summaries"],
    "x3_loop_guard_stream": telemetry.ORACLES["x3_loop_guard"],
    "x5_backoff_stream": telemetry.ORACLES["x5_backoff"],
    "x6_failure_budget_stream": f"""WITH {_A}, f AS (SELECT *, count(*) FILTER (type = 'conversation-end') OVER (PARTITION BY agent_id ORDER BY ts, event_id) AS island, CASE WHEN type <> 'tool-result' THEN 0 WHEN k IS NULL THEN 2 ELSE 1 END AS cost FROM a WHERE type IN ('tool-result', 'conversation-end')),
      s AS (SELECT *, sum(cost) OVER (PARTITION BY agent_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM f) SELECT agent_id, event_id, spent, spent >= 2 AS exhausted FROM s WHERE type = 'tool-result'""",
    "x12_consume_once_stream": f"WITH {_A} SELECT DISTINCT run_id, k FROM a WHERE type = 'tool-result'",
    "x2_publish_once_stream": f"WITH {_A}, f AS (SELECT run_id, k::VARCHAR AS k, min((ts, event_id)) AS f FROM a WHERE type = 'tool-result' AND k IS NOT NULL GROUP BY ALL) SELECT run_id, k, f[2] AS event_id, row_number() OVER (PARTITION BY run_id ORDER BY f) AS watermark FROM f",
    "x9_route_epochs_stream": f"""WITH {_A}, d AS (SELECT *, coalesce(k, -1) AS c, count(*) FILTER (type = 'conversation-end') OVER (PARTITION BY agent_id ORDER BY ts, event_id) AS island FROM a WHERE type IN ('tool-call', 'conversation-end')), e AS (SELECT *, CASE WHEN c IS NOT DISTINCT FROM lag(c) OVER (PARTITION BY agent_id, island ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh FROM d WHERE type = 'tool-call'),
      n AS (SELECT *, sum(fresh) OVER (PARTITION BY agent_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e), r AS (SELECT *, CASE WHEN fresh = 1 AND n % 4 = 0 THEN 1 ELSE 0 END AS roll FROM n) SELECT agent_id, event_id, ((n - 1) % 4 + 1)::INT AS streak, (sum(roll) OVER (PARTITION BY agent_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::INT AS epoch FROM r""",
    "s9_activity_sink": f"WITH {_A} SELECT event_id, run_id, agent_id, type FROM a",
}
QUERIES = {f.__name__: f for f in (x1_agent_status_stream, x3_loop_guard_stream, x5_backoff_stream, x6_failure_budget_stream, x12_consume_once_stream, s9_activity_sink, x2_publish_once_stream, x4_circuit_stream, x9_route_epochs_stream)}
