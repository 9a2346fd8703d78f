"""Queries over jobs, evidence, leases, campaigns and queues that the given tables stand for, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, records, telemetry
from ..operators import ledger as o
from ..sources import tables as s
from .telemetry import ACTIVITY

PATHS = "'src/' || (user_id % 5) || CASE WHEN user_id % 3 > 0 THEN '/' || (user_id % 7) ELSE '' END || CASE WHEN user_id % 3 > 1 THEN '/f' || (event_id % 4) ELSE '' END"
LEASES = f"SELECT DISTINCT {PATHS} AS path, CASE WHEN event_id % 9 = 0 THEN ' ' ELSE 'o' || (event_id % 3) END AS owner, CASE WHEN user_id % 2 = 0 THEN 'namespace' ELSE 'file' END AS kind FROM {{events}} WHERE event_type = 'click'"
ASKED = f"SELECT DISTINCT {PATHS} AS path, 'o' || (user_id % 4) AS owner, CASE WHEN event_id % 2 = 0 THEN 'namespace' ELSE 'file' END AS kind FROM {{events}} WHERE event_type = 'purchase'"
ENTRIES = "SELECT event_id AS job_id, user_id AS assignment, event_id AS seq, event_id % 2 = 0 AS checked, event_id % 3 AS f1, CAST(floor(value) AS BIGINT) % 3 AS f2 FROM {events}"
STATEMENTS = "SELECT DISTINCT 'f' || (user_id % 7) AS file, 's' || (user_id % 11) AS symbol, 's' || (user_id % 5) AS statement FROM {events} WHERE user_id < 60"
ATTEMPTS = """SELECT 'b' || (user_id % 60) AS batch, CASE WHEN event_id % 3 = 0 THEN 'statements' ELSE 'proofs' END AS stage, event_type = 'purchase' AND event_id % 4 = 1 AS success, CASE WHEN user_id % 4 = 0 THEN 'manual' ELSE '' END AS provenance, CASE WHEN event_id % 5 = 0 THEN 'no_provider_call' ELSE 'calls' END AS cost_scope,
 CAST(event_id % 16 AS DOUBLE) / 16 AS cost, CASE user_id % 5 WHEN 0 THEN 'USD cost limit' WHEN 1 THEN 'Timeout' WHEN 2 THEN 'rate limit' END AS reason, '' AS failure_class FROM {events}"""
BATCHES = "SELECT 'b' || n_nationkey AS batch FROM {nation} UNION ALL SELECT 'z' || r_regionkey AS batch FROM {region}"
RUNS = "SELECT user_id AS run_id, event_id % 3 AS rejected, event_id % 2 AS coached, event_type = 'error' AS gave_up, event_type = 'error' AND event_id % 2 = 0 AS false_success, event_id % 7 AS launched, 'r' || (event_id % 6) AS r1, 'r' || (user_id % 9) AS r2, 'p' || (event_id % 4) AS p1 FROM {events}"
CASES = "SELECT CASE p_size % 3 WHEN 0 THEN 't2' WHEN 1 THEN 't3' ELSE 'extra' END AS suite, p_partkey AS seq, CASE WHEN p_partkey % 40 = 0 THEN '' ELSE 'c' || (p_partkey % 150) END AS case_id, p_brand AS source, CASE WHEN p_size = 9 THEN '' ELSE 'f' END AS file, 'd' AS declaration FROM {part}"
SOURCES = "SELECT DISTINCT p_brand AS source, CASE WHEN length(p_brand) % 2 = 0 THEN 'main' ELSE substr(md5(p_brand) || md5(p_brand), 1, 40) END AS revision, p_brand = 'Brand#1' AS local FROM {part} WHERE p_brand <> 'Brand#5'"
FINDINGS = "SELECT event_id AS job_id, user_id % 50 AS target, user_id % 4 AS campaign FROM {events} WHERE event_type <> 'signup'"
RECORDS = "SELECT l_orderkey % 97 AS archive, l_orderkey * 10 + l_linenumber AS seq, l_returnflag || l_linenumber || '-' || l_partkey AS payload FROM {lineitem}"
QUEUE = "SELECT user_id % 37 AS scope, event_id AS label, event_id AS seq, CASE event_type WHEN 'error' THEN 'diagnostic' WHEN 'click' THEN 'hole' WHEN 'view' THEN 'tidy' ELSE 'none' END AS bucket, CAST(floor(value) AS INT) % 4 AS rank, user_id % 6 AS key FROM {events}"
BACKLOG = "SELECT user_id % 23 AS scope, event_id % 31 AS id, event_id AS seq, event_type = 'error' AND event_id % 5 = 0 AS displaced FROM {events}"
CANDIDATES = "SELECT event_id AS id, user_id AS target, 'd' || (event_id % 3) AS digest, event_id % 5 AS errors, event_id % 4 AS prefix, event_id % 2 AS context, event_type <> 'error' AS valid, CASE WHEN event_id % 2 = 0 THEN 'me' END AS replayed_by, CASE WHEN event_id % 3 > 0 THEN 2 ELSE 1 END AS contract FROM {events}"
CURRENT = "SELECT DISTINCT user_id AS target, 'd' || (user_id % 4) AS digest FROM {events} WHERE user_id % 5 <> 0"
RANKED = "SELECT user_id % 9 AS scope, event_id AS id, event_id % 13 AS place, event_type = 'purchase' AS exact FROM {events}"
CONTEXTS = "SELECT event_id AS key, event_id % 8 AS attempts, user_id % 4 AS repeated, user_id % 3 AS streak, event_id % 9 AS searches, event_id % 5 AS stable, user_id % 12 AS calls, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 12 END AS most_calls, CASE WHEN event_type = 'error' THEN 'stuck' ELSE ' ' END AS blocker FROM {events}"
HELD = "SELECT 'p' || (user_id % 40) AS path, 'o' || (event_id % 5) AS owner, event_id AS taken, user_id AS ttl FROM {events}"
CLASSES = "SELECT user_id % 9 AS scope, event_id AS at, CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 6 ELSE 12 END AS modulus, CAST(floor(value) AS BIGINT) % CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 6 ELSE 12 END AS residue FROM {events} WHERE event_type = 'error'"
BASE = "SELECT c_custkey AS id, c_mktsegment AS value, c_custkey * 2 AS seq FROM {customer} WHERE c_custkey % 4 <> 0"
UPDATES = "SELECT o_custkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderpriority || o_orderkey END AS value, o_orderkey AS seq FROM {orders} WHERE o_custkey % 3 > 0"
JOBS = "SELECT doc_id AS job_id, CASE WHEN doc_id % 3 = 0 THEN 'running' ELSE 'done' END AS state, doc_id % 5 <> 1 AS consumed, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 2 = 0 END AS released, text AS payload FROM {documents}"


def _view(sql: str):
    return lambda spark, sf_dir: s.derived(spark, sf_dir, sql)


leases, jobs, candidates, current = _view(LEASES), _view(JOBS), _view(CANDIDATES), _view(CURRENT)


def j12_lease_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.lease_conflicts(leases(spark, sf_dir), _view(ASKED)(spark, sf_dir))


def j14_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.superseded(_view(ENTRIES)(spark, sf_dir).withColumn("facts", F.array("f1", F.col("f2") + 10)))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("f"), F.col("user_id") % 7).alias("file"), F.concat(F.lit("s"), F.col("user_id") % 11).alias("symbol"), F.sha2(F.concat(F.lit("s"), F.col("event_id") % 4), 256).alias("digest"))


def j26_current_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.current_evidence(_evidence(spark, sf_dir), _view(STATEMENTS)(spark, sf_dir)).select("id", "file", "symbol")


def x11_stale_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.stale_split(candidates(spark, sf_dir).select("id", "target", "digest"), current(spark, sf_dir)).select("id", "role", "reason")


def a6_campaign_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.campaign_batches(_view(BATCHES)(spark, sf_dir), _view(ATTEMPTS)(spark, sf_dir))


def a6_failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.failure_counts(_view(ATTEMPTS)(spark, sf_dir))


def a8_suite_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.suite_metrics(_view(RUNS)(spark, sf_dir).withColumns({"routes": F.array("r1", "r2"), "shapes": F.array("p1")}))


def a10_manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.manifest_problems(_view(CASES)(spark, sf_dir), _view(SOURCES)(spark, sf_dir), {"t2": 40, "t3": 10, "adversarial": 4})


def a15_run_learnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.run_learnings(s.activity(spark, sf_dir))


def a19_delivery_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _view(FINDINGS)(spark, sf_dir)
    return o.delivery_backlog(found, found.where("job_id % 3 = 0").select("job_id", "target"))


def a20_audit_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _view(RECORDS)(spark, sf_dir)
    # The catalog of each tenth archive knows its records in the other order.
    placed = records.withColumn("place", F.when(F.col("archive") % 10 == 5, -F.col("seq")).otherwise(F.col("seq")))
    catalog = placed.groupBy("archive").agg((F.count("*") + F.when(F.col("archive") % 10 == 1, 1).otherwise(0)).alias("n"), (o.archive_digest("place", "payload") + F.when(F.col("archive") % 10 == 2, 1).otherwise(0)).alias("digest"))
    return o.audit_archives(catalog.where("archive % 10 <> 3").unionByName(catalog.select((F.col("archive") + 1000).alias("archive"), "n", "digest").where("archive % 10 = 4")), records)


def k3_next_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.next_items(_view(QUEUE)(spark, sf_dir))


def k12_backlog_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.backlog_order(_view(BACKLOG)(spark, sf_dir), 12)


def k14_best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.best_candidates(candidates(spark, sf_dir), current(spark, sf_dir))


def k15_replay_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.replay_due(candidates(spark, sf_dir), current(spark, sf_dir), "me", 2)


def k16_next_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _view(RANKED)(spark, sf_dir)
    lanes = ranked.groupBy("scope", F.when(F.col("exact"), "exact").otherwise("generic").alias("lane")).agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("l"))
    cursors = lanes.select("scope", "lane", F.when(F.col("scope") % 3 == 0, "other").otherwise(F.sha2(F.array_join(F.transform("l", lambda x: x["id"].cast("string")), ","), 256)).alias("digest"), (F.col("scope") + 1).alias("cursor"))
    return o.next_batch(ranked, cursors, 5)


def x8_struggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.struggle(_view(CONTEXTS)(spark, sf_dir))


def x10_active_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _view(HELD)(spark, sf_dir)
    return o.active_leases(held, F.lit(500))


def x14_compact_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot, _ = o.compact_ledger(jobs(spark, sf_dir))
    return hot.select("job_id", F.coalesce(F.length("payload"), F.lit(0)).alias("kept"), "digest", "size")


def x14_hydrate_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.hydrate_ledger(*o.compact_ledger(jobs(spark, sf_dir))).select("job_id", F.md5("payload").alias("digest"), "intact")


def j13_contained_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = s.derived(spark, sf_dir, CLASSES)
    return graph.contained_classes(classes, (2, 3, 4, 6, 12))


def j16_streak_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.streak_floor(s.activity(spark, sf_dir), excluded=tuple(range(0, 100, 3)))


def j17_protected_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = s.activity(spark, sf_dir).select("agent_id", "k", "ts", "event_id", "type")
    found, receipts = log.where("type = 'tool-result'"), log.where("type = 'conversation-end'")
    protected = found.where("agent_id % 5 = 0").select("agent_id", "k")
    return records.compact_findings(found, receipts, ("agent_id", "k"), ("ts", "event_id"), 8, protected).select("agent_id", "k", "event_id")


def u8_upsert_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, updates = s.derived(spark, sf_dir, BASE), s.derived(spark, sf_dir, UPDATES)
    kept = records.upsert_in_order(base, updates, "id", "value", "seq").withColumn("mode", F.lit("merge"))
    return kept.unionByName(records.upsert_in_order(base, updates, "id", "value", "seq", replace_all=True).withColumn("mode", F.lit("replace")))


def w2_trailing_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.trailing_streaks(s.activity(spark, sf_dir), "agent_id", "api-request")


def _with(**views: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({s.plain(sql)})" for name, sql in views.items())


_GOES = "state = 'done' AND consumed AND coalesce(released, false) AND strlen(payload) - 64 >= 1024"
ORACLES = {
    "j13_contained_classes": f"{_with(c=CLASSES)} SELECT x.at, min(y.at) AS by FROM c x JOIN c y ON y.scope = x.scope AND y.at < x.at AND x.modulus % y.modulus = 0 AND x.residue % y.modulus = y.residue GROUP BY x.at".replace("x.at", "x.\"at\"").replace("y.at", "y.\"at\""),
    "j16_streak_excluded": f"WITH {ACTIVITY}, n AS (SELECT *, count(*) FILTER (type = 'conversation-end' AND (k IS NULL OR k % 3 <> 0 OR k > 99)) OVER (PARTITION BY agent_id ORDER BY ts DESC, event_id DESC) AS resets FROM a) SELECT agent_id, count(*) FILTER (type = 'tool-call' AND resets = 0) AS streak FROM n GROUP BY agent_id",
    "j17_protected_findings": f"""WITH {ACTIVITY}, p AS (SELECT DISTINCT agent_id, k FROM a WHERE type = 'tool-result' AND agent_id % 5 = 0), f AS (SELECT *, EXISTS (SELECT 1 FROM a c WHERE c.type = 'conversation-end' AND c.agent_id = a.agent_id AND c.k = a.k) AND NOT EXISTS (SELECT 1 FROM p WHERE p.agent_id = a.agent_id AND p.k = a.k) AS seen FROM a WHERE type = 'tool-result'),
      o AS (SELECT *, row_number() OVER (PARTITION BY seen ORDER BY ts DESC, event_id DESC) AS rank FROM f) SELECT agent_id, k, event_id FROM o WHERE NOT seen OR rank <= 8""",
    "u8_upsert_in_order": f"""{_with(b=BASE, u=UPDATES)}, g AS (SELECT id, arg_max(value, seq) FILTER (trim(value) <> '') AS value, min(seq) AS seq FROM u GROUP BY id), l AS (SELECT coalesce(max(seq), 0) AS last FROM b)
      SELECT coalesce(b.id, g.id) AS id, coalesce(g.value, b.value) AS value, coalesce(b.seq, g.seq + last) AS seq, 'merge' AS mode FROM b FULL JOIN g ON g.id = b.id CROSS JOIN l UNION ALL SELECT g.id, coalesce(g.value, b.value), g.seq, 'replace' FROM g LEFT JOIN b ON b.id = g.id""",
    "w2_trailing_streaks": f"WITH {ACTIVITY}, n AS (SELECT *, count(*) FILTER (type IS DISTINCT FROM 'api-request') OVER (PARTITION BY agent_id ORDER BY ts DESC, event_id DESC) AS others FROM a) SELECT agent_id, count(*) FILTER (others = 0) AS streak FROM n GROUP BY agent_id",
    "j12_lease_conflicts": f"""{_with(l=LEASES, a=ASKED)} SELECT DISTINCT a.path AS request_path, a.owner AS request_owner, l.path, l.owner FROM a JOIN l ON l.path = a.path OR l.kind = 'namespace' AND starts_with(a.path, l.path || '/') OR a.kind = 'namespace' AND starts_with(l.path, a.path || '/') WHERE trim(l.owner) <> '' AND l.owner <> a.owner""",
    "j14_superseded": f"""{_with(e=ENTRIES)} SELECT x.job_id, arg_min(y.job_id, y.seq) AS by FROM e x JOIN e y ON y.assignment = x.assignment AND y.seq > x.seq AND y.checked AND y.f1 = x.f1 AND y.f2 = x.f2 GROUP BY x.job_id""",
    "j26_current_evidence": f"WITH d AS ({s.plain(STATEMENTS)}) SELECT event_id AS id, d.file, d.symbol FROM events JOIN d ON d.file = 'f' || (user_id % 7) AND d.symbol = 's' || (user_id % 11) AND d.statement = 's' || (event_id % 4)",
    "x11_stale_split": f"{_with(c=CANDIDATES, n=CURRENT)} SELECT id, CASE WHEN n.digest = c.digest THEN 'finding' ELSE 'evidence_only' END AS role, CASE WHEN n.target IS NULL THEN 'unknown_target' WHEN n.digest <> c.digest THEN 'stale_active_file_revision' END AS reason FROM c LEFT JOIN n ON n.target = c.target",
    "a6_campaign_batches": f"""{_with(b=BATCHES, a=ATTEMPTS)}, o AS (SELECT *, provenance = '' AND cost_scope <> 'no_provider_call' AS agent FROM a),
      r AS (SELECT batch, CASE WHEN bool_or(success AND stage = 'proofs') THEN 'proofs_completed' WHEN bool_or(success AND stage = 'statements') THEN 'statements_completed' ELSE 'pending' END AS status, CASE WHEN bool_or(success AND stage = 'proofs' AND agent) THEN 'proofs_completed' WHEN bool_or(success AND stage = 'statements' AND agent) THEN 'statements_completed' ELSE 'pending' END AS agent_status, count(*) AS attempts, round(sum(cost), 6) AS spend FROM o GROUP BY batch)
      SELECT b.batch, coalesce(status, 'pending') AS status, coalesce(agent_status, 'pending') AS agent_status, coalesce(attempts, 0) AS attempts, coalesce(spend, 0.0)::DOUBLE AS spend FROM b LEFT JOIN r ON r.batch = b.batch""",
    "a6_failure_counts": f"""{_with(a=ATTEMPTS)} SELECT CASE WHEN contains(lower(reason), 'cost limit') THEN 'budget_limit' WHEN contains(lower(reason), 'timeout') THEN 'verification_timeout' WHEN contains(lower(reason), 'rate limit') THEN 'infrastructure' WHEN stage = 'statements' THEN 'statement_generation_incomplete' ELSE 'proof_incomplete' END AS failure_class, count(*) AS n FROM a WHERE NOT success GROUP BY 1""",
    "a8_suite_metrics": f"""{_with(r=RUNS)} SELECT count(*) AS runs, avg(gave_up::INT) AS give_up_rate, avg(false_success::INT) AS false_success_rate, sum(coached) / sum(rejected)::DOUBLE AS coach_coverage, (SELECT count(DISTINCT x) FROM (SELECT r1 AS x FROM r UNION ALL SELECT r2 FROM r)) AS route_diversity, count(DISTINCT p1) AS shape_diversity, sum(launched)::BIGINT AS launched FROM r""",
    "a10_manifest_problems": f"""{_with(c=CASES, s=SOURCES)}, e AS (SELECT unnest(['t2', 't3', 'adversarial']) AS suite, unnest([40, 10, 4]) AS wanted), n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY suite, seq) AS r FROM c)
      SELECT 'count' AS problem, suite, NULL::VARCHAR AS case_id FROM e WHERE wanted <> (SELECT count(*) FROM c WHERE c.suite = e.suite) UNION ALL SELECT 'id', suite, case_id FROM n WHERE case_id = '' OR r > 1 UNION ALL SELECT 'source', suite, case_id FROM c WHERE source NOT IN (SELECT source FROM s) UNION ALL SELECT 'fields', suite, case_id FROM c WHERE file = ''
      UNION ALL SELECT 'revision', source, NULL FROM s WHERE NOT local AND length(revision) <> 40""",
    "a15_run_learnings": r"""WITH a AS (SELECT event_id, ts, user_id % 20 AS run_id, event_type, regexp_extract(props, '(\d+)', 1)::INT AS k FROM events), t AS (SELECT run_id, k, count(*) AS n, row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, k) AS r FROM a WHERE event_type = 'error' GROUP BY run_id, k),
      b AS (SELECT run_id, string_agg(k || ' x ' || n, ', ' ORDER BY r) AS blockers FROM t WHERE r <= 3 GROUP BY run_id), l AS (SELECT run_id, k, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS r FROM a WHERE event_type = 'click'), h AS (SELECT run_id, string_agg(k::VARCHAR, ' | ' ORDER BY r DESC) AS routes FROM l WHERE r <= 6 GROUP BY run_id)
      SELECT i.run_id, coalesce(blockers, '') AS blockers, coalesce(routes, '') AS routes FROM (SELECT DISTINCT run_id FROM a) i LEFT JOIN b ON b.run_id = i.run_id LEFT JOIN h ON h.run_id = i.run_id""",
    "a19_delivery_backlog": f"{_with(f=FINDINGS)} SELECT campaign, target, count(*) AS waiting FROM f WHERE job_id % 3 <> 0 GROUP BY ALL",
    "a20_audit_archives": f"""{_with(r=RECORDS)}, h AS (SELECT DISTINCT archive FROM r) SELECT archive, CASE archive % 10 WHEN 1 THEN 'count' WHEN 2 THEN 'digest' WHEN 5 THEN 'digest' WHEN 3 THEN 'unknown' ELSE '' END AS issue FROM h UNION ALL SELECT archive + 1000, 'missing' FROM h WHERE archive % 10 = 4""",
    "k3_next_items": f"{_with(q=QUEUE)} SELECT scope, label FROM (SELECT *, CASE bucket WHEN 'diagnostic' THEN 0 WHEN 'hole' THEN 1 WHEN 'tidy' THEN 2 END AS b FROM q) WHERE b IS NOT NULL AND rank < 3 QUALIFY row_number() OVER (PARTITION BY scope ORDER BY b, rank, key, seq) = 1",
    "k12_backlog_order": f"{_with(b=BACKLOG)}, g AS (SELECT scope, id, min(seq) AS seq, bool_or(displaced) AS d FROM b GROUP BY ALL) SELECT scope, id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY d DESC, seq, id) AS place FROM g) WHERE place <= 12",
    "k14_best_candidates": f"{_with(c=CANDIDATES, n=CURRENT)} SELECT c.target, c.id FROM c JOIN n ON n.target = c.target AND n.digest = c.digest QUALIFY row_number() OVER (PARTITION BY c.target ORDER BY errors, prefix DESC, context DESC, c.id DESC) = 1",
    "k15_replay_due": f"{_with(c=CANDIDATES, n=CURRENT)} SELECT c.target, c.id, coalesce(NOT (replayed_by = 'me' AND contract = 2), true) AS due FROM c JOIN n ON n.target = c.target AND n.digest = c.digest WHERE valid QUALIFY row_number() OVER (PARTITION BY c.target ORDER BY c.id DESC) = 1",
    "k16_next_batch": f"""{_with(r=RANKED)}, n AS (SELECT *, CASE WHEN exact THEN 'exact' ELSE 'generic' END AS lane, row_number() OVER (PARTITION BY scope, exact ORDER BY place, id) - 1 AS ax, CASE WHEN scope % 3 = 0 THEN 0 ELSE scope + 1 END AS cur FROM r)
      SELECT scope, id, lane FROM n WHERE ax >= cur AND (exact OR ax < cur + 5)""",
    "x8_struggle": f"""{_with(c=CONTEXTS)}, k AS (SELECT key, list_filter([CASE WHEN attempts >= 2 THEN 'failed_attempts=' || CASE WHEN attempts >= 4 THEN 'reroute' ELSE 'nudge' END END, CASE WHEN repeated >= 2 THEN 'repeat_error_signature=nudge' END, CASE WHEN streak >= 2 OR searches >= 6 THEN 'search_spiral=nudge' END,
      CASE WHEN stable >= 2 THEN 'no_progress=' || CASE WHEN stable >= 3 THEN 'reroute' ELSE 'nudge' END END, CASE WHEN most_calls > 0 AND calls / most_calls >= 0.7 THEN 'budget_pressure=nudge' END, CASE WHEN trim(blocker) <> '' THEN 'give_up_phrasing=' || CASE WHEN stable >= 2 THEN 'reroute' ELSE 'nudge' END END], lambda x: x IS NOT NULL) AS s FROM c)
      SELECT key, array_to_string(s, ',') AS signals, CASE WHEN len(s) = 0 THEN 'none' WHEN len(list_filter(s, lambda x: contains(x, 'reroute'))) > 0 OR len(s) >= 2 THEN 'reroute' ELSE 'nudge' END AS severity FROM k""",
    "x10_active_leases": f"{_with(h=HELD)} SELECT path, owner, taken FROM h WHERE taken + ttl > 500 QUALIFY row_number() OVER (PARTITION BY path ORDER BY taken DESC, owner DESC) = 1",
    "x14_compact_ledger": f"{_with(j=JOBS)} SELECT job_id, CASE WHEN {_GOES} THEN 0 ELSE coalesce(length(payload), 0) END AS kept, CASE WHEN {_GOES} THEN sha256(payload) END AS digest, CASE WHEN {_GOES} THEN strlen(payload) END::INT AS size FROM j",
    "x14_hydrate_ledger": "SELECT doc_id AS job_id, md5(text) AS digest, true AS intact FROM documents",
}
QUERIES = {q.__name__: q for q in (j12_lease_conflicts, j14_superseded, j26_current_evidence, x11_stale_split, a6_campaign_batches, a6_failure_counts, a8_suite_metrics, a10_manifest_problems, a15_run_learnings, a19_delivery_backlog, a20_audit_archives, k3_next_items, k12_backlog_order, k14_best_candidates, k15_replay_due, k16_next_batch, x8_struggle, x10_active_leases, x14_compact_ledger, x14_hydrate_ledger, j13_contained_classes, j16_streak_excluded, j17_protected_findings, u8_upsert_in_order, w2_trailing_streaks)}
