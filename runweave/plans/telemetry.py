"""Queries over the activity log and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import telemetry as t
from ..sources.tables import activity

ACTIVITY = r"""a AS (SELECT event_id, ts, user_id AS agent_id, user_id % 20 AS run_id,
  CASE event_type WHEN 'signup' THEN 'conversation-start' WHEN 'view' THEN 'api-request' WHEN 'click' THEN 'tool-call' WHEN 'purchase' THEN 'conversation-end' WHEN 'error' THEN 'tool-result' END AS type,
  TRY_CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
m AS (SELECT *, CASE type WHEN 'conversation-start' THEN 'running' WHEN 'conversation-end' THEN 'completed' WHEN 'tool-result' THEN 'failed' END AS status FROM a)
"""
RUNS = r"""
s AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY agent_id, {v} ORDER BY ts, event_id) AS grp, {v} AS v FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY agent_id, v, grp ORDER BY ts, event_id) AS streak FROM s)
"""
#: Legal successions of event types for the check of job states.
LEGAL = (("conversation-start", "api-request"), ("api-request", "tool-call"), ("api-request", "conversation-end"), ("tool-call", "tool-result"), ("tool-result", "api-request"), ("tool-call", "api-request"), ("conversation-end", "conversation-start"))
#: Before this moment events count as archived.
ARCHIVED = "2024-01-16 00:00:00"


def s2_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.tail(activity(spark, sf_dir), 50, ("api-request", "tool-call")).select("event_id", "agent_id", "type")


def a14_agent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = activity(spark, sf_dir)
    newest = t.last_n(log, "agent_id", 5).groupBy("agent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("newest"))
    return t.agent_summary(log).join(newest, "agent_id", "left")


def w10_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.last_n(activity(spark, sf_dir), "run_id", 3).select("run_id", "event_id", "rank")


def w2_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.streaks(activity(spark, sf_dir), "agent_id", "type").select("agent_id", "event_id", "type", "streak")


def x3_loop_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.loop_guard(activity(spark, sf_dir)).where("decision <> 'none'").select("agent_id", "event_id", "streak", "decision")


def x5_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.backoff(activity(spark, sf_dir)).select("agent_id", "event_id", "streak", "delay")


def w1_turn_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.turn_deltas(activity(spark, sf_dir)).select("agent_id", "event_id", "delta")


def j16_streak_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.streak_floor(activity(spark, sf_dir))


def j15_pauses_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.pauses_between(activity(spark, sf_dir))


def p21_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.transcript(activity(spark, sf_dir))


def a2_provider_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.provider_status(activity(spark, sf_dir))


def a21_attempt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.attempt_history(activity(spark, sf_dir))


def w12_status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.status_changes(activity(spark, sf_dir))


def x7_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.invalid_transitions(activity(spark, sf_dir), LEGAL)


def x13_closed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.closed_runs(activity(spark, sf_dir))


def a22_merge_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, old = activity(spark, sf_dir), F.col("ts") < F.lit(ARCHIVED).cast("timestamp_ntz")
    return t.merge_summaries(t.partial_summary(log.where(old)), t.partial_summary(log.where(~old)))


def s14_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, old = activity(spark, sf_dir), F.col("ts") < F.lit(ARCHIVED).cast("timestamp_ntz")
    return t.history(log.where(~old), log.where(old), "agent_id").select("event_id", "agent_id", "type")


def s14_whole_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of agents whose last event ends a conversation are archived, the others hot with a stale copy archived."""
    log = activity(spark, sf_dir)
    ended = log.groupBy("agent_id").agg((F.max_by("type", F.struct("ts", "event_id")) == "conversation-end").alias("closed"))
    log = log.join(ended, "agent_id")
    hot, archive = log.where(~F.col("closed")), log.where(F.col("closed") | (F.col("ts") < F.lit(ARCHIVED).cast("timestamp_ntz")))
    return t.history(hot, archive, "agent_id").select("event_id", "agent_id", "type")


def w3_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.novelty(activity(spark, sf_dir))


_legal = ", ".join(f"('{a}', '{b}')" for a, b in LEGAL)
ORACLES = {
    "s2_tail": f"WITH {ACTIVITY} SELECT event_id, agent_id, type FROM a WHERE type IN ('api-request', 'tool-call') ORDER BY ts DESC, event_id DESC LIMIT 50",
    "a14_agent_summary": f"""WITH {ACTIVITY}, o AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, event_id DESC) AS rank, row_number() OVER (PARTITION BY agent_id, status IS NULL ORDER BY ts DESC, event_id DESC) AS srank, row_number() OVER (PARTITION BY agent_id, type ORDER BY ts, event_id) AS frank FROM m)
      SELECT agent_id, count(*) AS n_events, max(CASE WHEN type = 'conversation-start' AND frank = 1 THEN event_id END) AS first_start, max(CASE WHEN rank = 1 THEN event_id END) AS last_event, max(CASE WHEN rank = 1 THEN type END) AS last_type,
      max(CASE WHEN srank = 1 THEN status END) AS status, max(CASE WHEN type = 'api-request' THEN k END) AS api_calls, count(*) FILTER (type = 'tool-call') AS tool_calls, string_agg(CASE WHEN rank <= 5 THEN event_id::VARCHAR END, ',' ORDER BY rank) AS newest FROM o GROUP BY agent_id""",
    "w10_last_n": f"WITH {ACTIVITY}, o AS (SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC)::INT AS rank FROM a) SELECT * FROM o WHERE rank <= 3",
    "w2_streaks": f"WITH {ACTIVITY}, {RUNS.format(v='type')} SELECT agent_id, event_id, type, streak::INT AS streak FROM r",
    "x3_loop_guard": f"WITH {ACTIVITY}, {RUNS.format(v='type')} SELECT agent_id, event_id, streak::INT AS streak, CASE WHEN streak >= 6 THEN 'close' ELSE 'nudge' END AS decision FROM r WHERE streak = 3 OR streak >= 6",
    "x5_backoff": f"WITH {ACTIVITY}, {RUNS.format(v="(type = 'tool-result')")} SELECT agent_id, event_id, streak::INT AS streak, CASE streak WHEN 1 THEN 15 WHEN 2 THEN 60 WHEN 3 THEN 300 ELSE 900 END AS delay FROM r WHERE v",
    "w1_turn_deltas": f"WITH {ACTIVITY} SELECT agent_id, event_id, greatest(k - coalesce(lag(k) OVER (PARTITION BY agent_id ORDER BY ts, event_id), 0), 0) AS delta FROM a WHERE type = 'api-request'",
    "j16_streak_floor": f"WITH {ACTIVITY}, n AS (SELECT *, count(*) FILTER (type = 'conversation-end') OVER (PARTITION BY agent_id ORDER BY ts DESC, event_id DESC) AS resets FROM a) SELECT agent_id, count(*) FILTER (type = 'tool-call' AND resets = 0) AS streak FROM n GROUP BY agent_id",
    "j15_pauses_between": f"""WITH {ACTIVITY}, d AS (SELECT run_id, event_id, ts, lag(ts) OVER w AS pts, lag(event_id) OVER w AS pid FROM a WHERE type = 'api-request' WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id))
      SELECT run_id, event_id, EXISTS (SELECT 1 FROM a WHERE a.run_id = d.run_id AND type = 'tool-result' AND (a.ts, a.event_id) > (pts, pid) AND (a.ts, a.event_id) < (d.ts, d.event_id)) AND EXISTS (SELECT 1 FROM a WHERE a.run_id = d.run_id AND type = 'conversation-end' AND (a.ts, a.event_id) > (pts, pid) AND (a.ts, a.event_id) < (d.ts, d.event_id)) AS paused FROM d""",
    "p21_transcript": f"WITH {ACTIVITY} SELECT agent_id, event_id, row_number() OVER (PARTITION BY agent_id ORDER BY ts, event_id)::INT AS pos, CASE type WHEN 'conversation-start' THEN 'user' WHEN 'api-request' THEN 'assistant' WHEN 'tool-call' THEN 'tool-call' ELSE 'event' END AS role, concat_ws(' ', type, k::VARCHAR) AS text FROM a",
    "a2_provider_status": f"""WITH {ACTIVITY}, g AS (SELECT run_id, count(*) FILTER (type = 'api-request') AS queries, count(*) FILTER (type = 'tool-call') AS results, max(cents) AS max_cents, count(DISTINCT k) FILTER (type = 'tool-result') AS errors FROM a GROUP BY run_id)
      SELECT *, CASE WHEN errors > 0 AND results > 0 THEN 'degraded' WHEN errors > 0 THEN 'error' WHEN results > 0 THEN 'ok' ELSE 'empty' END AS status FROM g""",
    "a21_attempt_history": f"WITH {ACTIVITY}, f AS (SELECT *, row_number() OVER (PARTITION BY run_id, k ORDER BY ts, event_id) AS seen FROM a WHERE type = 'tool-result') SELECT run_id, k, event_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id)::INT AS attempt FROM f WHERE seen = 1",
    "w12_status_changes": f"WITH {ACTIVITY}, c AS (SELECT agent_id, event_id, lag(status) OVER (PARTITION BY agent_id ORDER BY ts, event_id) AS before, status AS after FROM m WHERE status IS NOT NULL) SELECT * FROM c WHERE before IS DISTINCT FROM after",
    "x7_job_state": f"WITH {ACTIVITY}, p AS (SELECT agent_id, event_id, lag(type) OVER (PARTITION BY agent_id ORDER BY ts, event_id) AS before, type FROM a) SELECT * FROM p WHERE before IS NOT NULL AND (before, type) NOT IN ({_legal})",
    "x13_closed_runs": f"WITH {ACTIVITY}, l AS (SELECT run_id, agent_id, type, row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, event_id DESC) AS rank FROM a) SELECT run_id, count(*) AS n_events, count(*) FILTER (rank = 1 AND type <> 'conversation-end') AS open_agents, count(*) FILTER (rank = 1 AND type <> 'conversation-end') = 0 AS closed FROM l GROUP BY run_id",
    "a22_merge_summaries": f"""WITH {ACTIVITY}, o AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY ts, event_id) AS up, row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, event_id DESC) AS down, row_number() OVER (PARTITION BY agent_id, status IS NULL ORDER BY ts DESC, event_id DESC) AS srank FROM m)
      SELECT agent_id, count(*) AS n_events, max(CASE WHEN up = 1 THEN event_id END) AS first_event, max(CASE WHEN down = 1 THEN event_id END) AS last_event, max(CASE WHEN down = 1 THEN type END) AS last_type, max(CASE WHEN srank = 1 THEN status END) AS status, max(CASE WHEN type = 'api-request' THEN k END) AS api_calls FROM o GROUP BY agent_id""",
    "s14_history": f"WITH {ACTIVITY}, h AS (SELECT * FROM a WHERE ts >= '{ARCHIVED}') SELECT event_id, agent_id, type FROM h UNION ALL SELECT event_id, agent_id, type FROM a WHERE ts < '{ARCHIVED}' AND agent_id NOT IN (SELECT agent_id FROM h)",
    "s14_whole_history": f"WITH {ACTIVITY} SELECT event_id, agent_id, type FROM a",
    "w3_novelty": f"WITH {ACTIVITY} SELECT event_id, run_id, k, row_number() OVER (PARTITION BY run_id, k ORDER BY ts, event_id) = 1 AS novel FROM a",
}
QUERIES = {f.__name__: f for f in (s2_tail, a14_agent_summary, w10_last_n, w2_streaks, x3_loop_guard, x5_backoff, w1_turn_deltas, j16_streak_floor, j15_pauses_between, p21_transcript, a2_provider_status, a21_attempt_history, w12_status_changes, x7_job_state, x13_closed_runs, a22_merge_summaries, s14_history, s14_whole_history, w3_novelty)}
