"""Queries over sessions, messages and usage, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as f
from ..operators import graph as g
from ..operators import sessions as o
from ..operators import text as x
from ..sources import tables as s
from . import corpus

MESSAGES = """SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, turn AS pos, turn AS ts, CASE WHEN turn % 4 = 2 OR turn % 8 = 3 THEN 'tool' WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
 CASE WHEN turn % 5 = 4 THEN '<REASONING_SCRATCHPAD>' || text || '</REASONING_SCRATCHPAD>' WHEN turn % 11 = 7 THEN '' ELSE text END AS content, CASE WHEN conv_id % 3 = 0 THEN 'thought ' || turn END AS reasoning,
 turn % 4 = 1 AS calls, CASE WHEN turn % 3 = 0 THEN 'no json' ELSE '{{"k": ' || turn || '}}' END AS arguments, CASE WHEN turn % 2 = 0 THEN 'call-' || turn END AS tool_call_id FROM {conversations}"""
SESSIONS = """SELECT o_orderkey AS id, 'chat ' || (o_custkey % 40) || CASE WHEN o_orderkey % 3 = 0 THEN ' #' || (o_orderkey % 9 + 2) ELSE '' END AS title, o_custkey * 86400 + o_orderkey AS started,
 CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_custkey * 86400 + o_orderkey + 60 END AS ended, o_orderpriority AS source FROM {orders}"""
LINES = "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS session_id, l_linenumber AS pos, l_returnflag AS role, l_linestatus AS content FROM {lineitem}"
CHATS = "SELECT DISTINCT conv_id AS id, 'source-' || (conv_id % 3) AS source, conv_id - 5 AS started FROM {conversations}"
CALLS = """SELECT user_id AS session_id, CAST(floor(event_id / 50) AS BIGINT) AS turn, CASE user_id % 6 WHEN 0 THEN 'org/Brand#' || (user_id % 70) WHEN 1 THEN 'Brand#1' || (user_id % 5) || '-mini' WHEN 2 THEN 'x/y/brand#1' WHEN 3 THEN 'my-gpt-big' WHEN 4 THEN 'Brand#99' ELSE 'unknown' END AS model,
 event_id % 1000 AS prompt, user_id % 300 AS completion, CASE WHEN event_type = 'purchase' THEN CAST(event_id % 8 AS DOUBLE) / 8 END AS reported FROM {events}"""
PRICING = "SELECT lower(p_brand) AS key, CAST(min(p_size) AS DOUBLE) AS input, CAST(max(p_size) AS DOUBLE) AS output FROM {part} GROUP BY lower(p_brand) UNION ALL SELECT 'bra', CAST(7 AS DOUBLE), CAST(9 AS DOUBLE) FROM {region} WHERE r_regionkey = 0"
FAMILIES = (("gpt", 10.0, 30.0),)
BATCHES = "SELECT p_brand AS batch, p_partkey AS label FROM {part}"
POSITIONS = "SELECT p_partkey AS label, (p_partkey * 7919) % 1000003 AS position FROM {part} WHERE p_size % 10 <> 0"
JOBS = "SELECT 'job' || CAST(floor(p_partkey / 10) AS BIGINT) || '.' || CASE WHEN p_size % 2 = 0 THEN 'ds' ELSE 'em' END || '-' || p_partkey AS job_id FROM {part}"
REQUESTS = "SELECT DISTINCT 'job' || CAST(floor(p_partkey / 10) AS BIGINT) AS parent, CASE WHEN p_partkey % 10 = 3 THEN 'zz' ELSE 'ds' END AS tag FROM {part}"
RUNS = "SELECT n_nationkey AS run_id, n_name AS run_scope, 'region-' || n_regionkey AS workflow_kind FROM {nation} WHERE n_nationkey < 17"
NOW, HITS = 90 * 86400 + 500 * 86400, 20


def _view(sql: str):
    return lambda spark, sf_dir: s.derived(spark, sf_dir, sql)


messages, sessions, lines = _view(MESSAGES), _view(SESSIONS), _view(LINES)


def s11_export_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = o.export_sessions(_view(CHATS)(spark, sf_dir), messages(spark, sf_dir), "role", "content")
    return rows.select("id", F.size("messages").cast("long").alias("n"), F.md5(F.to_json(F.struct("id", "source", "messages"))).alias("digest"))


def s12_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = F.when(F.col("calls"), F.array(F.struct(F.lit("grep").alias("name"), F.col("arguments"))))
    turns = o.trajectories(messages(spark, sf_dir).withColumn("calls", calls))
    return turns.select("session_id", F.posexplode("turns").alias("turn", "t")).select("session_id", "turn", F.col("t.from").alias("speaker"), F.md5("t.value").alias("digest"))


def f11_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.prices(_view(CALLS)(spark, sf_dir).select("model").distinct(), _view(PRICING)(spark, sf_dir), FAMILIES)


def a13_usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.usage_summary(_view(CALLS)(spark, sf_dir), f11_prices(spark, sf_dir))


def w5_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.reshard(_view(BATCHES)(spark, sf_dir), _view(POSITIONS)(spark, sf_dir), 7)


def w6_compaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.compaction_zones(messages(spark, sf_dir))


def w7_prune_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.prune_stale(messages(spark, sf_dir))


def w8_sample_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.sample_turns(messages(spark, sf_dir))


def w9_next_child_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.next_child_ids(_view(JOBS)(spark, sf_dir), _view(REQUESTS)(spark, sf_dir))


def w11_title_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.next_titles(sessions(spark, sf_dir))


def w14_unflushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    return o.unflushed(rows, rows.where("pos <= session_id % 4").select("session_id", "pos")).select("id", "session_id", "pos")


def u6_prune_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, left = o.prune(sessions(spark, sf_dir), lines(spark, sf_dir), NOW, source="1-URGENT")
    return kept.join(left.groupBy("session_id").agg(F.count("*").alias("messages")), kept["id"] == F.col("session_id"), "left").select("id", F.coalesce("messages", F.lit(0)).alias("messages"))


def j3_list_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.list_sessions(_view(CHATS)(spark, sf_dir), messages(spark, sf_dir), source="source-1")


def j20_enrich_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.enriched(s.activity(spark, sf_dir), _view(RUNS)(spark, sf_dir), "run_scope", "workflow_kind").select("event_id", "run_scope", "workflow_kind")


def t3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = x.search(s.messages(spark, sf_dir), corpus.TERMS, HITS)
    roots = g.roots(s.sessions(spark, sf_dir).withColumnRenamed("parent_session_id", "parent"))
    found = o.recall(hits, roots, s.messages(spark, sf_dir), corpus.TERMS, 5, 300, current=F.col("root") % 7 == 3)
    return found.select("session_id", "hit", F.md5("text").alias("digest"))


_M = f"m AS ({s.plain(MESSAGES)})"
_AT = "row_number() OVER (PARTITION BY session_id ORDER BY pos, id) - 1 AS ax, count(*) OVER (PARTITION BY session_id) AS n"
_PRICED = f"""c AS ({s.plain(CALLS)}), pr AS ({s.plain(PRICING)}), md AS (SELECT DISTINCT model, lower(regexp_extract(model, '([^/]*)$', 1)) AS bare FROM c),
 b AS (SELECT model, arg_max(input, length(key)) AS input, arg_max(output, length(key)) AS output FROM md JOIN pr ON starts_with(bare, key) GROUP BY model),
 p AS (SELECT md.model, coalesce(b.input, CASE WHEN contains(bare, 'gpt') THEN 10.0 ELSE 0.0 END)::DOUBLE AS input, coalesce(b.output, CASE WHEN contains(bare, 'gpt') THEN 30.0 ELSE 0.0 END)::DOUBLE AS output, b.model IS NOT NULL OR contains(bare, 'gpt') AS listed FROM md LEFT JOIN b ON b.model = md.model)"""
_BODY = """CASE WHEN trim(coalesce(reasoning, '')) <> '' THEN '<think>' || chr(10) || reasoning || chr(10) || '</think>' || chr(10) ELSE '' END || CASE WHEN calls THEN CASE WHEN trim(said) <> '' THEN said || chr(10) ELSE '' END || '<tool_call>' || chr(10) || '{"name":"grep","arguments":' || CASE WHEN json_valid(arguments) THEN json(arguments)::VARCHAR ELSE '{}' END || '}' || chr(10) || '</tool_call>' ELSE said END"""
_WINDOWED = f"""list_min(list_filter([{', '.join(f"instr(lower(text), '{t}')" for t in corpus.TERMS)}], lambda p: p > 0))"""
ORACLES = {
    "s11_export_sessions": f"""WITH {_M}, c AS ({s.plain(CHATS)}), g AS (SELECT session_id, list({{'id': id, 'role': role, 'content': content}} ORDER BY pos, id) AS messages FROM m GROUP BY session_id)
      SELECT c.id, len(messages) AS n, md5(to_json({{'id': c.id, 'source': source, 'messages': messages}})::VARCHAR) AS digest FROM c JOIN g ON g.session_id = c.id""",
    "s12_trajectories": f"""WITH {_M}, r AS (SELECT *, replace(replace(coalesce(content, ''), '<REASONING_SCRATCHPAD>', '<think>'), '</REASONING_SCRATCHPAD>', '</think>') AS said, sum(CASE WHEN role = 'tool' THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY pos, id) AS turn FROM m),
      w AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY pos, id) - 1 AS place, first_value(calls) OVER (PARTITION BY session_id, turn ORDER BY pos, id) AS asked, first_value(role) OVER (PARTITION BY session_id, turn ORDER BY pos, id) AS opener, {_BODY} AS body FROM r),
      v AS (SELECT session_id, turn, role = 'tool' AS tool, pos, id, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE 'tool' END AS speaker,
        CASE role WHEN 'user' THEN coalesce(content, '') WHEN 'assistant' THEN trim(CASE WHEN contains(body, '<think>') THEN body ELSE '<think>' || chr(10) || '</think>' || chr(10) || body END, ' ')
        ELSE '<tool_response>' || chr(10) || to_json({{'tool_call_id': coalesce(tool_call_id, ''), 'name': CASE WHEN asked AND opener <> 'tool' AND place = 1 THEN 'grep' ELSE 'unknown' END, 'content': coalesce(content, '')}})::VARCHAR || chr(10) || '</tool_response>' END AS value FROM w),
      t AS (SELECT session_id, turn, tool, speaker, string_agg(value, chr(10) ORDER BY pos, id) AS value FROM v GROUP BY ALL) SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY turn, tool) - 1)::INT AS turn, speaker, md5(value) AS digest FROM t""",
    "f11_prices": f"WITH {_PRICED} SELECT * FROM p",
    "a13_usage_summary": f"""WITH {_PRICED}, k AS (SELECT c.*, coalesce(reported, CASE WHEN listed THEN (prompt * input + completion * output) / 1e6 END) AS cost, CASE WHEN reported IS NOT NULL THEN 'reported' WHEN listed THEN 'estimated' ELSE 'unpriced' END AS kind FROM c JOIN p ON p.model = c.model),
      t AS (SELECT session_id, turn, count(*) AS calls, sum(prompt + completion)::BIGINT AS tokens, coalesce(sum(cost), 0) AS cost, list_sort(list(DISTINCT kind)) AS kinds FROM k GROUP BY ALL)
      SELECT session_id, turn, calls, tokens, (sum(tokens) OVER w)::BIGINT AS session_tokens, round(cost, 6) AS cost, round(sum(cost) OVER w, 6) AS session_cost, CASE WHEN list_contains(kinds, 'unpriced') THEN 'unpriced' WHEN len(kinds) > 1 THEN 'mixed' ELSE kinds[1] END AS source FROM t WINDOW w AS (PARTITION BY session_id ORDER BY turn)""",
    "w5_reshard": f"""WITH b AS ({s.plain(BATCHES)}), p AS ({s.plain(POSITIONS)}), r AS (SELECT batch, b.label, row_number() OVER (PARTITION BY batch ORDER BY position NULLS LAST, b.label) - 1 AS ax FROM b LEFT JOIN p ON p.label = b.label)
      SELECT batch, 'items-' || string_agg(label::VARCHAR, '-' ORDER BY ax) AS shard, count(*) AS n FROM r GROUP BY batch, ax // 7""",
    "w6_compaction_plan": f"""WITH {_M}, r AS (SELECT *, {_AT} FROM m), e AS (SELECT session_id, any_value(n) AS n, coalesce(min(ax) FILTER (ax >= 3 AND role <> 'tool'), any_value(n)) AS st, any_value(n) - 4 - coalesce(max(CASE WHEN role = 'assistant' AND calls THEN 1 ELSE 0 END) FILTER (ax = n - 5), 0) AS en FROM r GROUP BY session_id)
      SELECT id, r.session_id, CASE WHEN NOT (e.n > 8 AND st < en) OR ax < st THEN 'head' WHEN ax < en THEN 'middle' ELSE 'tail' END AS zone FROM r JOIN e ON e.session_id = r.session_id""",
    "w7_prune_stale": f"WITH {_M} SELECT id, CASE WHEN role = 'tool' AND content <> '' AND (SELECT count(*) FROM m u WHERE u.session_id = m.session_id AND u.role = 'user' AND u.pos > m.pos) >= 2 THEN '{o.STALE}' ELSE content END AS content FROM m",
    "w8_sample_turns": f"""WITH {_M}, r AS (SELECT *, {_AT} FROM m), z AS (SELECT r.id, r.session_id, i AS slot FROM r, range(0, 8) t(i) WHERE i <= n - 1 AND ax = CASE WHEN n - 1 < 8 THEN i ELSE CAST(round_even(i * (n - 1) / 7.0::DOUBLE, 0) AS BIGINT) END)
      SELECT id, session_id, slot + 1 AS slot FROM z""",
    "w9_next_child_ids": f"""WITH j AS ({s.plain(JOBS)}), q AS ({s.plain(REQUESTS)}),
      h AS (SELECT regexp_extract(job_id, '^(.*)\\.[^.]*$', 1) AS parent, count(*) AS n FROM j WHERE contains(job_id, '.') GROUP BY ALL),
      k AS (SELECT q.parent, q.tag, coalesce(n, 0) + row_number() OVER (PARTITION BY q.parent ORDER BY q.tag) AS k FROM q LEFT JOIN h ON h.parent = q.parent)
      SELECT parent, tag, parent || '.' || tag || '-' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS next_id FROM k""",
    "w11_title_lineage": f"""WITH s AS ({s.plain(SESSIONS)}), b AS (SELECT id, started, regexp_replace(title, ' #[0-9]+$', '') AS base, TRY_CAST(regexp_extract(title, ' #([0-9]+)$', 1) AS INT) AS k FROM s)
      SELECT base, base || ' #' || (max(coalesce(k, 1)) + 1) AS next_title, coalesce(arg_max(id, (started, id)) FILTER (k IS NOT NULL), arg_max(id, (started, id))) AS newest FROM b GROUP BY base""",
    "w14_unflushed": f"WITH m AS ({s.plain(LINES)}), t AS (SELECT session_id, max(pos) AS p FROM m WHERE pos <= session_id % 4 GROUP BY session_id) SELECT id, m.session_id, pos FROM m LEFT JOIN t ON t.session_id = m.session_id WHERE p IS NULL OR pos > p",
    "u6_prune_sessions": f"WITH s AS ({s.plain(SESSIONS)}), m AS ({s.plain(LINES)}) SELECT s.id, (SELECT count(*) FROM m WHERE m.session_id = s.id) AS messages FROM s WHERE NOT (ended IS NOT NULL AND started < {NOW - 90 * 86400} AND source = '1-URGENT')",
    "j3_list_sessions": f"""WITH {_M}, c AS ({s.plain(CHATS)}), u AS (SELECT session_id, arg_min(content, (ts, id)) AS first FROM m WHERE role = 'user' GROUP BY session_id), a AS (SELECT session_id, count(*) AS messages, max(ts) AS last FROM m GROUP BY session_id)
      SELECT c.id, source, messages, coalesce(substr(trim(replace(replace(first, chr(10), ' '), chr(13), ' ')), 1, 60) || CASE WHEN length(first) > 60 THEN '...' ELSE '' END, '') AS preview, coalesce(last, started) AS last_active FROM c LEFT JOIN a ON a.session_id = c.id LEFT JOIN u ON u.session_id = c.id WHERE source = 'source-1' ORDER BY last_active DESC, id LIMIT 20""",
    "j20_enrich_activity": f"WITH r AS ({s.plain(RUNS)}) SELECT event_id, run_scope, workflow_kind FROM events LEFT JOIN r ON r.run_id = user_id % 20",
    "t3_recall": f"""WITH h AS ({corpus.ORACLES['j1_search']}), ro AS ({corpus.ROOTS}), f AS (SELECT h.id AS hit, score, root FROM h JOIN ro ON ro.id = h.session_id WHERE root % 7 <> 3),
      b AS (SELECT root, arg_max(hit, (score, -hit)) AS hit, max(score) AS score FROM f GROUP BY root ORDER BY max(score) DESC, 2 LIMIT 5), t AS (SELECT conv_id, string_agg('[' || upper(role) || ']: ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
      a AS (SELECT root, hit, text, length(text) AS size, {_WINDOWED} AS ax FROM b JOIN t ON t.conv_id = b.root), c AS (SELECT *, greatest(coalesce(ax - 1, 0) - 150, 0) AS s0 FROM a), d AS (SELECT *, least(size, s0 + 300) AS e FROM c), k AS (SELECT *, CASE WHEN e - s0 < 300 THEN greatest(e - 300, 0) ELSE s0 END AS st FROM d)
      SELECT root AS session_id, hit, md5(CASE WHEN size <= 300 THEN text ELSE CASE WHEN st > 0 THEN '{f.EARLIER}' ELSE '' END || substr(text, st + 1, e - st) || CASE WHEN e < size THEN '{f.LATER}' ELSE '' END END) AS digest FROM k""",
}
QUERIES = {q.__name__: q for q in (s11_export_sessions, s12_trajectories, f11_prices, a13_usage_summary, w5_reshard, w6_compaction_plan, w7_prune_stale, w8_sample_turns, w9_next_child_ids, w11_title_lineage, w14_unflushed, u6_prune_sessions, j3_list_sessions, j20_enrich_activity, t3_recall)}
