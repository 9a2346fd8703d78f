"""Queries over run evidence, manifests and snippets that the given tables stand for, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as o
from ..sources import tables as s

RECORDS = """SELECT user_id % 70 AS run_id, CASE event_id % 40 WHEN 0 THEN 'Audit: Target Drift seen' WHEN 1 THEN 'a Mathlib gap here' WHEN 2 THEN 'use a double coset' WHEN 3 THEN 'Type mismatch at 3' WHEN 4 THEN 'TimeoutError' ELSE event_type END AS text FROM {events} WHERE user_id % 70 <> 11"""
#: Every run has a summary but those of one residue; runs without records are told by their summary or their nodes alone.
SUMMARIES = "SELECT p_partkey % 75 AS run_id, max(CASE WHEN p_size = 50 THEN 'Fidelity Mismatch' ELSE 'no word' END) AS text FROM {part} WHERE p_partkey % 75 <> 69 GROUP BY p_partkey % 75"
NODES = "SELECT p_partkey % 70 AS run_id, p_partkey AS id, CASE WHEN p_partkey % 70 = 11 AND p_size % 2 = 0 THEN 'false' WHEN p_size % 3 = 0 THEN 'proved' ELSE 'stated' END AS status FROM {part}"
RUNS = "SELECT r_regionkey * 14 + n_nationkey % 14 AS run_id, CASE n_nationkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN ' ' WHEN 2 THEN 'running' ELSE 'failed' END AS final_status FROM {region} CROSS JOIN {nation} WHERE n_nationkey < 14"
COUNTERS = "SELECT p_partkey % 70 AS run_id, CASE WHEN p_partkey % 70 = 11 AND p_size % 2 = 0 THEN 'false' WHEN p_size % 3 = 0 THEN 'proved' ELSE 'stated' END AS status, count(*) + CASE WHEN p_partkey % 70 = 5 THEN 1 ELSE 0 END AS n FROM {part} WHERE p_partkey % 70 <> 7 GROUP BY 1, 2, p_partkey % 70"
PACKETS = "SELECT p_partkey % 70 AS run_id, CASE WHEN p_partkey % 33 = 0 THEN '' ELSE 'k' || p_partkey END AS packet_id, CASE WHEN p_partkey % 21 = 0 THEN -1 ELSE p_partkey END AS node_id FROM {part}"
JOURNAL = "SELECT user_id % 70 AS run_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'route' WHEN 'click' THEN 'coached' WHEN 'purchase' THEN 'launched' ELSE 'give_up' END AS event, 'v' || (event_id % 5) AS value FROM {events}"
NOTES = """SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'This   needs explicit verification of ' || p_name WHEN 1 THEN 'not yet checked, ' || p_brand WHEN 2 THEN 'if it fails we stop' WHEN 3 THEN 'a placeholder' WHEN 4 THEN 'no placeholder' WHEN 5 THEN 'The bound may be false; if so x must be replaced' WHEN 6 THEN 'If n grows, k needs to be changed' ELSE p_name END AS text FROM {part}"""
BUNDLE = "SELECT p_size AS bundle, 'a/f' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '.exe' WHEN 1 THEN '.sh' WHEN 2 THEN '.md' ELSE '' END AS path, p_partkey * 997 % 400000 AS size_bytes, p_partkey % 3 = 0 AS executable, CASE p_partkey % 17 WHEN 0 THEN '../x' WHEN 1 THEN '/etc' WHEN 2 THEN 'a/b' END AS link FROM {part}"
ITEMS = """SELECT p_size AS book, p_partkey AS ordinal, CASE p_partkey % 6 WHEN 0 THEN '{{"question":" What is ' || p_name || '?","answer":"' || p_type || '","id":"q' || p_partkey || '","dependencies":["a",""]}}' WHEN 1 THEN '{{"statement":"' || p_name || '","type":"lemma","page_number":' || p_size || ',"uses":["x","y"]}}' WHEN 2 THEN '{{"title":"none"}}'
 WHEN 3 THEN '{{"statement":"","problem":"' || p_brand || '","proof":["no"],"solution":" s "}}' WHEN 4 THEN 'broken' ELSE '{{"text":"t' || p_partkey || '","label":"","uid":"u' || p_partkey || '"}}' END AS item FROM {part}"""
PAGES = "SELECT p_size AS book, 'L' || (p_partkey % 40) AS label, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 11 END AS page FROM {part}"
HITS = "SELECT user_id % 25 AS request_id, event_id AS seq, 'q' || (event_id % 4) AS query, 'name' || (event_id % 37) AS name, CASE event_id % 4 WHEN 0 THEN ' convex hull' WHEN 1 THEN 'sum of hull' WHEN 2 THEN 'le_trans' ELSE event_type END AS text FROM {events}"
TEX = """SELECT 'd' || p_size || '/' || CASE WHEN p_partkey % 50 = 0 THEN 'main' WHEN p_partkey % 50 = 1 THEN 'macros' ELSE 'f' END || p_partkey || '.tex' AS path, CASE WHEN p_partkey % 7 = 0 THEN chr(92) || 'documentclass' || chr(123) || 'x' || chr(125) WHEN p_partkey % 7 = 1 THEN chr(92) || 'title' ELSE 'text' END || ' ' || chr(92) || 'input' || chr(123) || 'f' || (p_partkey + 50) || chr(125) || chr(92) || 'include' || chr(123) || 'f' || (p_partkey + 100) || '.tex' || chr(125) AS text FROM {part}"""
FAILS = """SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN '{{"diagnostics":[{{"message":"Unknown id  after ' || (event_id % 900) || ' ms"}}],"status":"x"}}' WHEN 1 THEN '{{"status":"failed","error":"Took ' || event_id || '.5s"}}' WHEN 2 THEN '{{"error":{{"resets_in_seconds":' || event_id || '}}}}' WHEN 3 THEN 'Please try again in ' || (event_id % 50) || ' hours' WHEN 4 THEN 'Retry-After: ' || event_id ELSE event_type END AS text FROM {events}"""
GOALS = "SELECT p_partkey AS id, 'x : Nat' || chr(10) || '⊢ ' || replace(p_name, ' ', '.') || ' x ≤ Nat.succ ' || lower(p_brand) || ' ∧ x + 1 < yy' AS goal FROM {part}"
ROUTES = "SELECT event_id AS id, user_id % 13 AS scope, event_type AS family, 'Try  Route ' || (event_id % 6) || ' of attempt ' || event_id || ' with ' || (user_id % 4) AS text FROM {events}"
JSONS = """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '{{"b": "  Two  WORDS", "a": [1, {{"ts": 5, "z": "' || p_name || '"}}], "job_id": ' || p_partkey || '}}' WHEN 1 THEN '"' || p_brand || ' X"' ELSE '{{broken  ' || p_brand END AS text FROM {part}"""
NAMES = """SELECT user_id % 11 AS scope, event_id AS seq, CASE event_id % 8 WHEN 0 THEN 'Ns.sum_bound_' || (user_id % 11) || '_of_' || (event_id % 5) WHEN 1 THEN 'Ns.not_sum_bound_' || (user_id % 11) WHEN 2 THEN 'Ns.sum_' || (event_id % 9) WHEN 3 THEN 'Other.sum_bound_' || (event_id % 9) WHEN 4 THEN 'x_not_' || (event_id % 7) WHEN 5 THEN 'Ns.sum_bound_' || (user_id % 11) WHEN 6 THEN ' ' ELSE 'plain' || (event_id % 6) END AS name FROM {events}"""
SNIPPETS = """SELECT doc_id AS id, doc_id, CASE doc_id % 5 WHEN 0 THEN substr(text, 1, 40) || '~none' WHEN 1 THEN chr(10) || split_part(text, chr(10), 1) WHEN 2 THEN '  ' || split_part(text, chr(10), 1) || ' ' WHEN 3 THEN replace(split_part(text, chr(10), 1), ' ', '   ') ELSE split_part(text, chr(10), 1) END AS snippet FROM {documents} WHERE text IS NOT NULL AND text <> ''"""


def _view(sql: str):
    return lambda spark, sf_dir: s.derived(spark, sf_dir, sql)


nodes, tex, fails = _view(NODES), _view(TEX), _view(FAILS)


def a7_campaign_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.campaign_metrics(_view(JOURNAL)(spark, sf_dir))


def a9_score_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = _view(PACKETS)(spark, sf_dir)
    return o.score_artifacts(_view(RUNS)(spark, sf_dir), _view(COUNTERS)(spark, sf_dir), nodes(spark, sf_dir), packets, ("done", "failed"))


def a11_classify_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.classify_runs(_view(RECORDS)(spark, sf_dir), nodes(spark, sf_dir), _view(SUMMARIES)(spark, sf_dir))


def p7_structural_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.structural_findings(_view(BUNDLE)(spark, sf_dir), most_files=4)


def p10_partition_uncertain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.partition_uncertain(_view(NOTES)(spark, sf_dir)).select("id", "evidence", "admitted")


def p12_substantive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("job_id"), "p_name", F.lit("notes"), F.when(F.col("p_size") % 3 == 0, " None  found ").when(F.col("p_size") % 3 == 1, " ").otherwise(F.col("p_type")), F.lit("status"), F.lit("done")).alias("payload"))
    return o.substantive(rows, ("job_id", "status"), "none|n/a|none found").select("id")


def s3_ingest_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.ingest_qa(_view(ITEMS)(spark, sf_dir)).withColumn("uses", F.array_join("uses", ","))


def j4_enrich_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _view(PAGES)(spark, sf_dir)
    items = pages.groupBy("book", "label").agg(F.max("page").alias("page")).withColumn("page", F.when(F.col("book") % 3 == 0, F.col("page")))
    return o.enrich_items(items, pages.where("book % 2 = 0"), pages.where("book % 5 <> 1"))


def k5_rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.rank_candidates(_view(HITS)(spark, sf_dir), ("hull", "convex", "le_", "sum"), 10)


def k11_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.entry_points(tex(spark, sf_dir))


def g9_include_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.include_closure(tex(spark, sf_dir), k11_entry_points(spark, sf_dir).select("path"))


def g10_file_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tex(spark, sf_dir)
    known = o.tex_inputs(files).join(files.select(F.col("path").alias("ref")), "ref", "left_semi").select("src", F.col("ref").alias("dst"))
    return o.file_topology(files, known)


def u5_run_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    union = o.run_union(spark, f"{sf_dir}/events.parquet", f"{sf_dir}/events.parquet")
    return union.groupBy("event_id").agg(F.count("*").alias("copies"), F.count_distinct("source").alias("sources"))


def u5_run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as one file a run, read as one again: rows and sources of each run, and whether all have a fingerprint."""
    path = s.scratch(spark)
    s.activity(spark, sf_dir).repartition("run_id").write.partitionBy("run_id").parquet(path)
    union = o.run_union(spark, path)
    told = F.col("source_bytes").isNotNull() & (F.col("source_bytes") > 0) & F.col("source_time").isNotNull()
    return union.groupBy(F.col("run_id").cast("long").alias("run_id")).agg(F.count("*").alias("n"), F.count_distinct("source", "source_bytes", "source_time").alias("sources"), F.bool_and(told).alias("fingerprints"))


def f4_result_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fails(spark, sf_dir).select("id", o.result_signature(F.col("text")).alias("out"))


def f16_retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fails(spark, sf_dir).select("id", o.retry_after(F.col("text"), 5000 * 24).alias("out"))


def f22_goal_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(GOALS)(spark, sf_dir).select("id", F.array_join(o.goal_symbols(F.col("goal")), " ").alias("out"))


def t4_semantic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = _view(ROUTES)(spark, sf_dir)
    history = o.semantic_keys(routes.where("family = 'error'"), routes.select("scope", F.lit("").alias("key")).limit(0)).join(routes.select("id", "scope"), "id").where("scope % 2 = 0").select("scope", "key")
    return o.semantic_keys(routes, history).select("id", "novel")


def t1_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.locate(_view(SNIPPETS)(spark, sf_dir), s.table(spark, sf_dir, "documents").where("text is not null"))


def t2_closest_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.closest_regions(_view(SNIPPETS)(spark, sf_dir), s.table(spark, sf_dir, "documents").where("text is not null"))


def f2_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _view(JSONS)(spark, sf_dir).select("id", o.canonical_json(F.col("text"), ("ts", "job_id")).alias("c"))
    return found.select("id", F.col("c.text").alias("out"), "c.malformed")


def k8_rank_by_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _view(NAMES)(spark, sf_dir)
    targets = names.select("scope").distinct().withColumn("target", F.concat(F.lit("Ns.sum_bound_"), F.col("scope")))
    return o.rank_by_affinity(names, targets, names.where("seq % 29 = 0").select("scope", "name")).select("scope", "name", "place", "reason")


def k9_target_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = s.derived(spark, sf_dir, "SELECT p_partkey AS id, 'A.long_' || CASE WHEN p_size % 2 = 0 THEN 'name_' ELSE '' END || 'of_part_' || p_partkey AS name, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS statement FROM {part}")
    found = s.derived(spark, sf_dir, "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN ' a.LONG_' || CASE WHEN p_size % 2 = 0 THEN 'name_' ELSE '' END || 'of_part_' || p_partkey ELSE 'other' END AS symbol, CASE WHEN p_partkey % 5 = 1 THEN 'see my_long_' || CASE WHEN p_size % 2 = 0 THEN 'name_' ELSE '' END || 'of_part_' || p_partkey || '.' ELSE 'of_part_' || p_partkey END AS text FROM {part} WHERE p_partkey % 3 > 0")
    return o.target_priority(found, targets)


def f19_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = s.activity(spark, sf_dir)
    details = F.create_map(F.lit("iteration"), F.col("k").cast("string"), F.lit("message_count"), F.when(F.col("event_id") % 2 == 0, "7"), F.lit("tool"), F.when(F.col("event_id") % 3 > 0, "grep"), F.lit("arguments"), F.concat(F.lit(" a   "), F.repeat(F.lit("x"), (F.col("event_id") % 200).cast("int"))), F.lit("user_message"), F.when(F.col("event_id") % 2 == 0, "do  it"), F.lit("completed"), F.when(F.col("event_id") % 2 == 0, "true"))
    return log.select("event_id", o.preview(F.col("type"), details, F.concat(F.lit("message of "), F.col("event_id").cast("string"))).alias("out"))


def w13_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.positions(s.table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", "p_size", "p_partkey").select("p_partkey", "position")


def _with(**views: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({s.plain(sql)})" for name, sql in views.items())


_has = lambda words: "bool_or(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"
_TEX = f"""t AS ({s.plain(TEX)}), e AS (SELECT path AS src, regexp_extract(path, '^(.*/)', 1) || r || CASE WHEN r LIKE '%.tex' THEN '' ELSE '.tex' END AS ref FROM (SELECT path, unnest(regexp_extract_all(text, '\\\\(?:input|include)\\{{([^{{}}]+)\\}}', 1)) AS r FROM t)),
 sc AS (SELECT path, regexp_extract(path, '^(.*/)', 1) AS folder, CASE WHEN path IN (SELECT ref FROM e) THEN -40 ELSE 80 END + 8 + CASE WHEN contains(text, 'documentclass') THEN 120 ELSE 0 END + CASE WHEN contains(text, '\\title') THEN 25 ELSE 0 END - CASE WHEN contains(path, 'macros') THEN 50 ELSE 0 END AS score FROM t),
 en AS (SELECT folder, score, min(path) AS path, count(*) AS ties FROM sc WHERE score = (SELECT max(x.score) FROM sc x WHERE x.folder = sc.folder) GROUP BY ALL)"""
ORACLES = {
    "a7_campaign_metrics": f"{_with(j=JOURNAL)} SELECT run_id, count(*) FILTER (event = 'rejected') AS rejected, count(*) FILTER (event = 'coached') AS coached, count(*) FILTER (event = 'launched') AS launched, count(*) FILTER (event = 'consumed') AS consumed, count(*) FILTER (event = 'proved') AS proved, count(DISTINCT value) FILTER (event = 'route') AS routes, arg_max(event, seq) = 'give_up' AS gave_up FROM j GROUP BY run_id",
    "a9_score_artifacts": f"""{_with(r=RUNS, c=COUNTERS, n=NODES, k=PACKETS)}, g AS (SELECT run_id, status, count(*) AS real FROM n GROUP BY ALL)
      SELECT run_id, CASE WHEN trim(final_status) = '' THEN 'missing_final_report' ELSE 'status_not_terminal' END AS violation FROM r WHERE trim(final_status) = '' OR final_status = 'running' UNION ALL SELECT DISTINCT run_id, 'missing_counters' FROM n WHERE run_id NOT IN (SELECT run_id FROM c)
      UNION ALL SELECT DISTINCT c.run_id, 'counters_diverge' FROM c FULL JOIN g ON g.run_id = c.run_id AND g.status = c.status WHERE c.run_id IS NOT NULL AND coalesce(c.n, 0) <> coalesce(g.real, 0)
      UNION ALL SELECT DISTINCT run_id, 'malformed_packet' FROM k WHERE packet_id = '' UNION ALL SELECT DISTINCT run_id, 'packet_of_unknown_node' FROM k WHERE packet_id <> '' AND node_id = -1""",
    "a11_classify_runs": f"""{_with(r=RECORDS, n=NODES, u=SUMMARIES)}, t AS (SELECT run_id, text FROM r UNION ALL SELECT run_id, text FROM u UNION ALL SELECT run_id, '' FROM n),
      f AS (SELECT run_id, {_has(o.STATEMENT_WORDS)} AS st, {_has(o.GAP_WORDS)} AS gap, {_has(o.STRATEGY_WORDS)} AS strategy, {_has(o.PROOF_WORDS)} AS pr, {_has(o.TOOL_WORDS)} AS degraded FROM t GROUP BY run_id),
      c AS (SELECT run_id, degraded, CASE WHEN run_id IN (SELECT run_id FROM n WHERE status = 'false') THEN 'mathematical' WHEN st THEN 'statement' WHEN gap AND strategy THEN 'library_interface' WHEN pr THEN 'proof_search' ELSE 'undetermined' END AS class FROM f)
      SELECT run_id, class, CASE WHEN class IN ('mathematical', 'statement') THEN 'high' WHEN class = 'undetermined' THEN 'low' ELSE 'medium' END AS confidence, degraded FROM c""",
    "p7_structural_findings": f"""{_with(b=BUNDLE)}, g AS (SELECT bundle, count(*) AS n, sum(size_bytes) AS z FROM b GROUP BY bundle) SELECT bundle, '' AS path, 'too_many_files' AS finding FROM g WHERE n > 4 UNION ALL SELECT bundle, '', 'oversized_bundle' FROM g WHERE z > 1048576 UNION ALL SELECT bundle, path, 'oversized_file' FROM b WHERE size_bytes > 262144
      UNION ALL SELECT bundle, path, 'binary_file' FROM b WHERE path LIKE '%.exe' UNION ALL SELECT bundle, path, 'unexpected_executable' FROM b WHERE executable AND path NOT LIKE '%.exe' AND path NOT LIKE '%.sh' UNION ALL SELECT bundle, path, 'escaping_link' FROM b WHERE link IN ('../x', '/etc')""",
    "p10_partition_uncertain": f"""{_with(t=NOTES)}, e AS (SELECT id, CASE id % 9 WHEN 0 THEN 'verification-needed: needs explicit verification' WHEN 1 THEN 'unverified: not yet checked' WHEN 2 THEN 'conditional-failure: if it fails' WHEN 3 THEN 'placeholder: placeholder' WHEN 5 THEN 'conditional-revision: if so x must be replaced | uncertain-validity: may be false' WHEN 6 THEN 'conditional-revision: If n grows, k needs to be changed' ELSE '' END AS evidence FROM t) SELECT id, evidence, evidence = '' AS admitted FROM e""",
    "p12_substantive": "SELECT p_partkey AS id FROM part WHERE p_size % 3 = 2",
    "s3_ingest_qa": """SELECT p_size AS book, CASE p_partkey % 6 WHEN 0 THEN 'q' || p_partkey WHEN 5 THEN 'u' || p_partkey ELSE 'qa-' || p_partkey END AS label, p_partkey AS ordinal, CASE WHEN p_partkey % 6 = 1 THEN 'lemma' ELSE 'question' END AS kind, CASE p_partkey % 6 WHEN 0 THEN 'What is ' || p_name || '?' WHEN 1 THEN p_name WHEN 3 THEN p_brand ELSE 't' || p_partkey END AS statement,
      CASE p_partkey % 6 WHEN 0 THEN p_type WHEN 3 THEN 's' ELSE '' END AS proof, CASE WHEN p_partkey % 6 = 1 THEN p_size END AS page, CASE p_partkey % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'x,y' ELSE '' END AS uses FROM part WHERE p_partkey % 6 NOT IN (2, 4)""",
    "j4_enrich_items": f"""{_with(p=PAGES)}, i AS (SELECT book, label, CASE WHEN book % 3 = 0 THEN max(page) END AS page FROM p GROUP BY book, label), a AS (SELECT book, label, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages FROM p WHERE page IS NOT NULL GROUP BY ALL)
      SELECT i.book, i.label, CASE WHEN i.page IS NOT NULL THEN i.page::VARCHAR WHEN a.pages IS NOT NULL AND (i.book % 2 = 0 OR i.book % 5 <> 1) THEN a.pages ELSE '' END AS pages, CASE WHEN i.page IS NOT NULL THEN 'item' WHEN a.pages IS NOT NULL AND i.book % 2 = 0 THEN 'audit' WHEN a.pages IS NOT NULL AND i.book % 5 <> 1 THEN 'crop' ELSE 'none' END AS source FROM i LEFT JOIN a ON a.book = i.book AND a.label = i.label""",
    "k5_rank_candidates": f"""{_with(h=HITS)}, g AS (SELECT request_id, name, arg_min(text, seq) AS text, count(DISTINCT query) AS queries, min(seq) AS first FROM h GROUP BY ALL), w AS (SELECT *, 4 * contains(name || ' ' || text, 'hull')::INT + 3 * contains(name || ' ' || text, 'convex')::INT + 2 * contains(name || ' ' || text, 'le_')::INT + contains(name || ' ' || text, 'sum')::INT AS w FROM g)
      SELECT request_id, name, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY w DESC, queries DESC, first) AS place FROM w) WHERE place <= 10""",
    "k11_entry_points": f"WITH {_TEX} SELECT * FROM en",
    "g9_include_closure": f"WITH RECURSIVE {_TEX}, c AS (SELECT path AS entry, path FROM en UNION SELECT c.entry, e.ref AS path FROM c JOIN e ON e.src = c.path) SELECT entry, path, path NOT IN (SELECT path FROM t) AS missing FROM c",
    "g10_file_topology": f"WITH RECURSIVE {_TEX}, k AS (SELECT e.src, e.ref AS dst FROM e JOIN t ON t.path = e.ref), r AS (SELECT path, 0 AS level FROM t UNION SELECT k.src AS path, level + 1 AS level FROM r JOIN k ON k.dst = r.path) SELECT path, max(level) AS level FROM r GROUP BY path",
    "u5_run_logs": "SELECT user_id % 20 AS run_id, count(*) AS n, 1::BIGINT AS sources, true AS fingerprints FROM events GROUP BY user_id % 20",
    "u5_run_union": "SELECT event_id, count(*) * 2 AS copies, 1::BIGINT AS sources FROM events GROUP BY event_id",
    "f4_result_signature": f"""{_with(t=FAILS)} SELECT id, left(sha256(CASE id % 6 WHEN 0 THEN 'unknown id after <t>' WHEN 1 THEN 'failed|took <t>' WHEN 2 THEN '{{"resets_in_seconds":' || id || '}}' ELSE trim(regexp_replace(lower(text), '\\d+(?:\\.\\d+)?\\s*(?:ms|s|seconds|sec)\\b', '<t>', 'g')) END), 16) AS out FROM t""",
    "f16_retry_after": f"WITH t AS (SELECT event_id AS id FROM events) SELECT id, CASE WHEN x BETWEEN 1 AND 120000 THEN x END AS out FROM (SELECT id, CASE id % 6 WHEN 2 THEN id WHEN 3 THEN id % 50 * 3600 WHEN 4 THEN id END AS x FROM t)",
    "f22_goal_symbols": f"{_with(t=GOALS)}, l AS (SELECT id, list_filter(regexp_extract_all(goal[instr(goal, '⊢') + 1:], '([A-Za-z_][A-Za-z0-9_.'']+|[≤∧<]|\\+)', 1), lambda x: x NOT IN ('Nat', 'by')) AS l FROM t) SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS out FROM l",
    "f2_canonical_json": """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '{"a":[1,{"z":"' || lower(p_name) || '"}],"b":"two words"}' WHEN 1 THEN '"' || lower(p_brand) || ' x"' ELSE '{broken ' || lower(p_brand) END AS out, p_partkey % 3 = 2 AS malformed FROM part""",
    "k8_rank_by_affinity": f"""{_with(t=NAMES)}, n AS (SELECT scope, trim(name) AS name, min(seq) AS seq FROM t WHERE trim(name) <> '' GROUP BY ALL), e AS (SELECT DISTINCT scope, trim(name) AS name FROM t WHERE seq % 29 = 0), r AS (SELECT n.*, e.name IS NOT NULL AS exact, 'Ns.sum_bound_' || n.scope AS target FROM n LEFT JOIN e ON e.scope = n.scope AND e.name = n.name),
      z AS (SELECT *, starts_with(name, target || '_') AS suf, name = 'Ns.not_sum_bound_' || scope AS neg, CASE WHEN starts_with(name, target || '_') THEN 3 WHEN name LIKE 'Ns.sum%' THEN 1 ELSE 0 END AS shared, regexp_matches(name, '(^|[._])not_') AS negates FROM r WHERE name <> target),
      y AS (SELECT *, CASE WHEN exact THEN 0 WHEN suf OR neg THEN 1 WHEN shared > 0 THEN 2 WHEN negates THEN 3 ELSE 4 END AS tier, CASE WHEN suf THEN 2 WHEN neg THEN 1 ELSE 0 END AS distance FROM z)
      SELECT scope, name, (row_number() OVER (PARTITION BY scope ORDER BY tier, distance, shared DESC, negates DESC, seq))::INT AS place, ['exact-target-graph-evidence', 'target-derived-helper-name', 'target-name-affinity', 'generic-negation-name', 'same-file-verified-fallback'][tier + 1] AS reason FROM y""",
    "k9_target_priority": "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 2 WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 5 = 1 THEN 1 ELSE 2 END AS priority, CASE WHEN p_partkey % 4 = 0 THEN 1000000 ELSE length(p_name) END AS length FROM part",
    "f19_previews": r"""WITH a AS (SELECT event_id, event_type, TRY_CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k, 'grep a ' || repeat('x', event_id % 200) AS call FROM events) SELECT event_id, coalesce(CASE event_type WHEN 'view' THEN 'API step #' || k || CASE WHEN event_id % 2 = 0 THEN ' · 7 messages' ELSE '' END
      WHEN 'click' THEN CASE WHEN event_id % 3 > 0 THEN CASE WHEN length(trim(call)) > 120 THEN substr(call, 1, 117) || '...' ELSE trim(call) END END WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'Prompt: do it' END WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'Completed' END END, 'message of ' || event_id) AS out FROM a""",
    "w13_positions": "SELECT p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey))::INT AS position FROM part",
    "t4_semantic_keys": f"""{_with(r=ROUTES)}, k AS (SELECT id, scope, family, family || '/' || regexp_extract(text, '([0-9]+)$', 1) AS key FROM r), h AS (SELECT DISTINCT scope, key FROM k WHERE family = 'error' AND scope % 2 = 0)
      SELECT k.id, row_number() OVER (PARTITION BY k.scope, k.key ORDER BY k.id) = 1 AND h.key IS NULL AS novel FROM k LEFT JOIN h ON h.scope = k.scope AND h.key = k.key""",
}
QUERIES = {q.__name__: q for q in (a7_campaign_metrics, a9_score_artifacts, a11_classify_runs, p7_structural_findings, p10_partition_uncertain, p12_substantive, s3_ingest_qa, j4_enrich_items, k5_rank_candidates, k11_entry_points, g9_include_closure, g10_file_topology, u5_run_union, u5_run_logs, f4_result_signature, f16_retry_after, f22_goal_symbols, t1_locate, t2_closest_regions, t4_semantic_keys, f2_canonical_json, k8_rank_by_affinity, k9_target_priority, f19_previews, w13_positions)}
