"""Queries over source files that the given parts stand for, and their oracles, which know how the files were made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import source as o
from ..sources import tables as s

_PATH = "'Pkg' || (p_partkey % 5) || '/B' || p_partkey || '.lean'"
#: Nine lines: imports, a comment that hides a theorem, a theorem, a lemma (with a hole in every second file), a definition.
FILES = f"""SELECT {_PATH} AS path, 'import Pkg' || ((p_partkey + 1) % 5) || '.B' || (p_partkey + 1) || chr(10) || '/- theorem hidden : sorry' || chr(10) || 'import Pkg0.B0 -/' || chr(10) || '@[simp] theorem t' || p_partkey || ' (x : Nat) : x = ' || (p_size % 3) || ' := by' || chr(10) || '  rfl -- sorry, hint: none' || chr(10) || ' ' || chr(10)
 || 'private lemma l' || p_partkey || ' : True := by' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '  sorry' ELSE '  exact "sorry"' END || chr(10) || 'def d' || p_partkey || ' := l' || p_partkey || ' ' || p_size || chr(10) || 'theorem u' || p_partkey || ' (x : Nat) :  x = ' || (p_size % 3) || ' := t' || p_partkey AS text FROM {{part}}"""
OUTPUTS = """SELECT event_id AS id, 'Pkg' || (user_id % 5) || '/B' || user_id || '.lean:' || (event_id % 12) || ':' || (event_id % 4) || CASE event_id % 3 WHEN 0 THEN ': error: unknown: x' WHEN 1 THEN ': warning: unused' ELSE ': note: none' END || chr(10) || 'noise' || chr(10) || 'Pkg' || (user_id % 5) || '/B' || user_id || '.lean:8:2: information: done' AS text FROM {events}"""
#: A compiler's outputs as JSON: bare, in envelopes, among log lines, twice the same, without a severity, and broken.
JSON_OUTPUTS = """SELECT event_id AS id, CASE event_id % 6
 WHEN 0 THEN '{{"diagnostics": [{{"severity": "Error", "message": " m' || user_id || ' ", "range": {{"start": {{"line": ' || (event_id % 12) || '}}}}}}, {{"level": "error", "text": "m' || user_id || '", "line": "' || (event_id % 12) || '"}}]}}'
 WHEN 1 THEN '{{"message": "outer", "items": {{"messages": [{{"detail": "warning: unused", "location": {{"startLine": ' || user_id || '}}}}]}}}}'
 WHEN 2 THEN 'log of ' || event_id || chr(10) || '  {{"kind": "info", "message": "' || event_type || '"}}' || chr(10) || '{{broken' || chr(10) || '[{{"severity": "error"}}, 5, []]'
 WHEN 3 THEN '{{"line": 0, "message": ""}}' WHEN 4 THEN 'A.lean:3:1: error: x' ELSE '[[[{{"errors": [{{"message": "deep", "line": ' || event_id || '}}]}}]]]' END AS text FROM {events}"""
CANDIDATES = "SELECT p_size % 7 AS scope, p_partkey AS label, p_partkey % 2 AS candidate_downstream, p_size % 2 AS candidate_imports, p_partkey % 3 AS project_downstream, 0 AS imported_by, p_partkey % 5 AS difficulty, p_size % 4 AS first_difficulty, p_partkey % 7 AS holes, p_size AS lines, 1 AS declared FROM {part}"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.derived(spark, sf_dir, FILES)


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.derived(spark, sf_dir, OUTPUTS)


def s1_lenient_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as JSON lines, among them broken, oversized and other ones, written and read again."""
    events = s.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    line = F.to_json(F.struct("event_id", "user_id", "event_type", F.when(F.col("event_id") % 11 == 0, F.repeat(F.lit("x"), 3000)).alias("pad")))
    odd = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), line)).when(F.col("event_id") % 7 == 0, F.concat(F.lit("["), line, F.lit("]"))).otherwise(line)
    path = s.scratch(spark)
    events.select(odd.alias("value")).write.text(path)
    return o.read_jsonl(spark, path, T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType())]), 2048).drop("source")


def s8_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.declarations(files(spark, sf_dir)).withColumn("text", F.md5("text"))


def f8_json_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.json_diagnostics(s.derived(spark, sf_dir, JSON_OUTPUTS))


def f8_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.diagnostics(_outputs(spark, sf_dir))


def f21_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.declarations(files(spark, sf_dir)).select("file", "name", o.signature(F.col("text")).alias("signature"))


def j8_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.import_edges(files(spark, sf_dir), "lean")


def j9_pending_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.pending_dependencies(o.declarations(files(spark, sf_dir)))


def j22_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = o.declarations(files(spark, sf_dir))
    number = F.regexp_extract("name", "([0-9]+)$", 1).cast("long")
    kept = before.where(~((number % 6 == 0) & F.col("name").startswith("d"))).withColumn("line", F.when(number % 6 == 1, 20 - F.col("line")).otherwise(F.col("line")))
    kept = kept.withColumn("text", F.when((number % 6 == 2) & F.col("name").startswith("l"), F.replace("text", F.lit("True"), F.lit("False"))).otherwise(F.col("text")))
    return o.snapshot_diff(before, kept.unionByName(kept.where((number % 6 == 3) & F.col("name").startswith("u"))))


def j23_attach_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.attach_diagnostics(o.diagnostics(_outputs(spark, sf_dir)), o.declarations(files(spark, sf_dir))).select("id", "line", "severity", "name")


def j29_earlier_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = o.declarations(files(spark, sf_dir))
    return o.earlier_duplicates(found.select(F.col("name").alias("id"), "file", "line", "text"), found)


def a16_hole_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.hole_stats(o.declarations(files(spark, sf_dir)))


def a24_diagnostic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.diagnostic_counts(o.diagnostics(_outputs(spark, sf_dir)))


def p18_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.finished(o.declarations(files(spark, sf_dir))).select("file", "name", "line", "chars")


def p19_file_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.file_hints(files(spark, sf_dir).withColumn("text", F.concat("text", F.when(F.col("path").contains("7"), "\n#check x\n-- Useful lemma: hint").otherwise(""))), o.declarations(files(spark, sf_dir)))


def a17_file_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("file", "/B([0-9]+)", 1).cast("long")
    found = o.declarations(files(spark, sf_dir)).withColumn("text", F.concat("text", F.when(k % 3 == 0, " Putnam polynomial").when(k % 3 == 1, " mathd abs").otherwise("")))
    return o.file_difficulty(files(spark, sf_dir), found)


def j10_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("file", "/B([0-9]+)", 1)
    found = o.declarations(files(spark, sf_dir))
    results = found.select(F.concat("file", F.lit("#"), "name").alias("id"), "file", F.when(F.col("name").startswith("t"), F.concat(F.lit("Some.Space."), "name")).otherwise(F.col("name")).alias("name"))
    results = results.unionByName(found.where("kind = 'def'").select(F.concat("file", F.lit("#none")).alias("id"), "file", F.lit("imported").alias("name")))
    return o.horizon(results, found, found.where("kind = 'lemma'").select("file", F.when(k.cast("long") % 5 == 0, "gone").otherwise(F.col("name")).alias("target")))


def j21_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("name", "([0-9]+)$", 1).cast("long")
    found = o.declarations(files(spark, sf_dir)).withColumn("digest", F.left(F.sha2("text", 256), F.lit(16)))
    modules = s.derived(spark, sf_dir, "SELECT DISTINCT 'c' || (p_partkey % 3) AS concept, 'Shared.M' || (p_partkey % 3) AS module FROM {part}")
    concepts = F.when(F.col("kind") == "theorem", F.array(F.concat(F.lit("c"), k % 4))).otherwise(F.array().cast("array<string>"))
    return o.placement(found, concepts, modules, found.where((k % 7 == 1) & (F.col("kind") == "lemma")), found.where((k % 7 == 2) & F.col("name").startswith("t")))


def f18_qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = s.derived(spark, sf_dir, "SELECT p_partkey AS id, 'namespace A' || chr(10) || 'def x' || chr(10) || 'namespace B.C' || chr(10) || CASE p_partkey % 4 WHEN 0 THEN 'end A' WHEN 1 THEN 'end' WHEN 2 THEN 'end Z' ELSE 'ending' END || chr(10) || 'def y' AS text, p_partkey % 7 AS line FROM {part}")
    return spaced.select("id", o.namespace_at(F.split("text", "\n"), F.col("line").cast("int")).alias("out"))


def j30_document_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = s.derived(spark, sf_dir, "SELECT 'd/p' || p_partkey || '.tex' AS path, chr(92) || 'bibliography' || chr(123) || 'r' || p_size || ', s' || p_partkey || '.bib' || chr(125) || chr(92) || 'includegraphics[w=1]' || chr(123) || 'fig' || p_partkey || chr(125) AS text FROM {part}")
    there = s.derived(spark, sf_dir, "SELECT 'd/r' || p_size || '.bbl' AS path FROM {part} UNION ALL SELECT 'd/s' || p_partkey || '.bib' AS path FROM {part} WHERE p_partkey % 2 = 0 UNION ALL SELECT 'd/fig' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.svg' ELSE '.txt' END AS path FROM {part}")
    return o.document_assets(docs, there)


def k1_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.file_order(s.derived(spark, sf_dir, CANDIDATES))


def k2_guarded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.derived(spark, sf_dir, CANDIDATES)
    return o.file_order(found, found.where("label % 3 > 0").select("scope", "label", (F.lit(0) - F.col("label")).alias("rank")))


_BASE = f"p AS (SELECT p_partkey AS k, p_size, {_PATH} AS file FROM part)"
_DECLS = f"""{_BASE}, d AS (SELECT file, 't' || k AS name, 'theorem' AS kind, 4 AS line, 5 AS end_line, '@[simp] theorem t' || k || ' (x : Nat) : x = ' || (p_size % 3) || ' := by' || chr(10) || '  rfl -- sorry, hint: none' AS text, false AS has_hole, 'theorem (x : Nat) : x = ' || (p_size % 3) AS signature, k FROM p
 UNION ALL SELECT file, 'l' || k, 'lemma', 7, 8, 'private lemma l' || k || ' : True := by' || chr(10) || CASE WHEN k % 2 = 0 THEN '  sorry' ELSE '  exact "sorry"' END, k % 2 = 0, 'lemma : True', k FROM p UNION ALL SELECT file, 'd' || k, 'def', 9, 9, 'def d' || k || ' := l' || k || ' ' || p_size, false, 'def', k FROM p
 UNION ALL SELECT file, 'u' || k, 'theorem', 10, 10, 'theorem u' || k || ' (x : Nat) :  x = ' || (p_size % 3) || ' := t' || k, false, 'theorem (x : Nat) : x = ' || (p_size % 3), k FROM p)"""
_DIAG = """o AS (SELECT event_id AS id, 'Pkg' || (user_id % 5) || '/B' || user_id || '.lean' AS file, event_id, user_id FROM events), g AS (SELECT id, file, (event_id % 12)::INT AS line, (event_id % 4)::INT AS column, CASE event_id % 3 WHEN 0 THEN 'error' ELSE 'warning' END AS severity, CASE event_id % 3 WHEN 0 THEN 'unknown: x' ELSE 'unused' END AS message FROM o WHERE event_id % 3 < 2
 UNION ALL SELECT id, file, 8, 2, 'info', 'done' FROM o)"""
_EDGES = f"WITH {_BASE} SELECT p.file AS src, q.file AS dst FROM p JOIN p q ON q.k = p.k + 1"
_ORDER = "candidate_downstream DESC, candidate_imports, project_downstream DESC, imported_by DESC"
ORACLES = {
    "s1_lenient_jsonl": "SELECT event_id, user_id, event_type FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0",
    "s8_declarations": f"WITH {_DECLS} SELECT file, name, kind, line, end_line, md5(text) AS text, has_hole FROM d",
    "f8_json_diagnostics": """WITH e AS (SELECT event_id AS id, event_id, user_id, event_type FROM events)
      SELECT id, 0::INT AS nth, 'error' AS severity, 'm' || user_id AS message, CASE WHEN event_id % 12 > 0 THEN event_id % 12 END AS line FROM e WHERE event_id % 6 = 0
      UNION ALL SELECT id, 0, 'info', 'outer', NULL FROM e WHERE event_id % 6 = 1 UNION ALL SELECT id, 1, 'warning', 'warning: unused', CASE WHEN user_id > 0 THEN user_id END FROM e WHERE event_id % 6 = 1
      UNION ALL SELECT id, 0, 'info', event_type, NULL FROM e WHERE event_id % 6 = 2 UNION ALL SELECT id, 1, 'error', '', NULL FROM e WHERE event_id % 6 = 2
      UNION ALL SELECT id, 0, 'info', 'deep', event_id FROM e WHERE event_id % 6 = 5""",
    "f8_diagnostics": f"WITH {_DIAG} SELECT * FROM g",
    "f21_signatures": f"WITH {_DECLS} SELECT file, name, signature FROM d",
    "j8_import_edges": _EDGES,
    "j9_pending_dependencies": f"WITH {_BASE} SELECT file, 'd' || k AS consumer, 'l' || k AS dependency FROM p WHERE k % 2 = 0",
    "j22_snapshot_diff": f"""WITH {_BASE} SELECT file, 'def' AS kind, 'd' || k AS name, 'deleted' AS violation FROM p WHERE k % 6 = 0 UNION ALL SELECT file, '', '', 'reordered' FROM p WHERE k % 6 = 1 UNION ALL SELECT file, 'lemma', 'l' || k, 'changed' FROM p WHERE k % 6 = 2 UNION ALL SELECT file, 'theorem', 'u' || k, 'duplicated' FROM p WHERE k % 6 = 3""",
    "j23_attach_diagnostics": f"WITH {_DIAG}, {_DECLS} SELECT g.id, g.line, g.severity, (SELECT arg_max(d.name, d.line) FROM d WHERE d.file = g.file AND d.line <= g.line) AS name FROM g",
    "j29_earlier_duplicates": f"WITH {_BASE} SELECT 'u' || k AS id, 't' || k AS name FROM p",
    "a16_hole_stats": f"WITH {_BASE} SELECT 'Pkg' || (k % 5) AS project, count(*) AS holes, count(*) AS files FROM p WHERE k % 2 = 0 GROUP BY 1",
    "a24_diagnostic_counts": f"WITH {_DIAG} SELECT id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM g GROUP BY id",
    "p18_finished": f"WITH {_DECLS} SELECT file, name, line, length(text) AS chars FROM d WHERE kind <> 'def' AND NOT has_hole",
    "p19_file_hints": f"WITH {_BASE} SELECT file, CASE WHEN contains(file, '7') THEN 4 ELSE 1 END AS hints, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS worked FROM p",
    "a17_file_difficulty": f"WITH {_BASE}, z AS (SELECT file, k, CASE k % 3 WHEN 0 THEN 10 WHEN 1 THEN 1 ELSE 4 END AS s FROM p) SELECT file, CASE WHEN k % 2 = 0 THEN s ELSE 0 END::BIGINT AS difficulty, CASE WHEN k % 2 = 0 THEN s ELSE 0 END AS first_difficulty, 1 AS hints, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS worked FROM z",
    "j10_horizon": f"""WITH {_DECLS} SELECT file || '#' || name AS id, file, CASE WHEN name LIKE 't%' THEN 'Some.Space.' || name ELSE name END AS name, CASE WHEN k % 5 = 0 OR line < 7 THEN 'usable' WHEN line = 7 THEN 'assigned_declaration_unavailable' ELSE 'future_same_file_unavailable' END AS access FROM d UNION ALL SELECT file || '#none', file, 'imported', 'usable' FROM d WHERE kind = 'def'""",
    "j21_placement": f"""WITH {_DECLS}, x AS (SELECT *, CASE WHEN kind = 'theorem' AND k % 4 < 3 THEN 'Shared.M' || (k % 4) ELSE '' END AS m, CASE WHEN k % 7 = 2 AND name LIKE 't%' THEN 'approved_for_promotion' WHEN k % 7 = 1 AND kind = 'lemma' THEN 'promotion_candidate' WHEN kind = 'theorem' AND k % 4 < 3 THEN 'placement_review' ELSE 'local_default' END AS st FROM d)
      SELECT file, name, CASE WHEN name LIKE 'u%' AND st <> 'local_default' AND k % 7 <> 2 AND m = '' THEN 'blocked_local_dependency' ELSE st END AS status, m AS modules FROM x""",
    "f18_qualified_names": "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 <= 1 THEN '' WHEN p_partkey % 7 <= 3 THEN 'A' WHEN p_partkey % 7 = 4 THEN 'A.B.C' ELSE CASE p_partkey % 4 WHEN 0 THEN '' WHEN 3 THEN 'A.B.C' ELSE 'A' END END AS out FROM part",
    "j30_document_assets": "SELECT 'd/p' || p_partkey || '.tex' AS src, 'd/r' || p_size || '.bbl' AS asset, 'bibliography' AS kind FROM part UNION ALL SELECT 'd/p' || p_partkey || '.tex', 'd/s' || p_partkey || '.bib', 'bibliography' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'd/p' || p_partkey || '.tex', 'd/fig' || p_partkey || '.svg', 'figure' FROM part WHERE p_partkey % 3 = 0",
    "k1_file_order": f"WITH c AS ({s.plain(CANDIDATES)}) SELECT scope, label, (row_number() OVER (PARTITION BY scope ORDER BY {_ORDER}, difficulty, first_difficulty, holes, lines, declared, label))::INT AS place FROM c",
    "k2_guarded_order": f"WITH c AS ({s.plain(CANDIDATES)}), f AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY {_ORDER}, difficulty, first_difficulty, holes, lines, declared, label) AS r FROM c) SELECT scope, label, (row_number() OVER (PARTITION BY scope ORDER BY {_ORDER}, difficulty // 3, first_difficulty // 3, CASE WHEN label % 3 > 0 THEN -label END NULLS LAST, r))::INT AS place FROM f",
}
QUERIES = {q.__name__: q for q in (s1_lenient_jsonl, s8_declarations, f8_diagnostics, f8_json_diagnostics, f21_signatures, j8_import_edges, j9_pending_dependencies, j22_snapshot_diff, j23_attach_diagnostics, j29_earlier_duplicates, a16_hole_stats, a24_diagnostic_counts, p18_finished, p19_file_hints, a17_file_difficulty, j10_horizon, j21_placement, f18_qualified_names, j30_document_assets, k1_file_order, k2_guarded_order)}
