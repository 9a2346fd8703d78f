"""Queries over dependency graphs with two kinds of edges, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as o
from ..sources import tables as s

NODES = """SELECT p_partkey AS id, 'n' || p_partkey AS name, 'f' || (p_partkey % 2) AS file, CASE p_size % 11 WHEN 0 THEN 'false' WHEN 1 THEN 'proved' WHEN 2 THEN 'stated' WHEN 3 THEN 'conjectured' WHEN 4 THEN 'blocked' WHEN 5 THEN 'parked' WHEN 6 THEN 'audited' WHEN 7 THEN 'split' WHEN 8 THEN 'proving' ELSE 'proved' END AS status,
 CASE p_partkey % 4 WHEN 0 THEN 'planner' WHEN 1 THEN 'prover-edit' ELSE '' END AS generated_by, p_partkey % 8 = 0 AS uncertain, (p_partkey * 37) % 1009 AS line, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS statement, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_type END AS notes FROM {part}"""
EDGES = """SELECT p_partkey AS src, CAST(floor(p_partkey / 2) AS BIGINT) AS dst, 'depends_on' AS kind FROM {part} WHERE p_partkey >= 2 UNION ALL SELECT p_partkey AS src, CAST(floor(p_partkey / 7) AS BIGINT) AS dst, 'depends_on' AS kind FROM {part} WHERE p_partkey >= 14
 UNION ALL SELECT p_partkey AS src, CAST(floor(p_partkey / 3) AS BIGINT) AS dst, 'split_of' AS kind FROM {part} WHERE p_partkey >= 3 AND p_partkey % 4 <> 1"""
TRUTH = "SELECT 'f' || (p_partkey % 2) AS file, 'n' || p_partkey AS name, p_partkey % 5 <> 2 AS present, p_partkey % 7 = 3 AS dirty FROM {part} WHERE p_partkey % 2 = 1"
AFTER = "CASE WHEN status = 'proved' AND id % 3 = 0 THEN 'stated' WHEN status NOT IN ('proved', 'split') THEN 'proved' ELSE status END"
#: Parts on a ring of three and what leads into it, for the schedule.
USES = """SELECT p_partkey AS src, CAST(floor(p_partkey / 2) AS BIGINT) AS dst FROM {part} WHERE p_partkey >= 2 UNION SELECT p_partkey AS src, p_partkey + CASE WHEN p_partkey % 50 = 40 THEN -2 ELSE 1 END AS dst FROM {part} WHERE p_partkey % 50 IN (38, 39, 40) UNION SELECT p_partkey AS src, p_partkey + 1000000000 AS dst FROM {part} WHERE p_size = 7"""
DOMAINS = "SELECT DISTINCT 'domain-' || (p_size % 4) AS domain, lower(substr(p_type, 1, 5)) AS concept FROM {part}"
JOBS = "SELECT 'a' || (p_partkey % 10) || CASE WHEN p_partkey % 3 > 0 THEN '.ds-' || CAST(floor(p_partkey / 40) AS BIGINT) ELSE '' END || CASE WHEN p_partkey % 3 = 2 THEN '.em-' || p_partkey ELSE '' END AS job_id FROM {part}"
FINDINGS = "SELECT event_id AS finding, user_id AS target, event_id AS at FROM {events} WHERE event_type = 'error'"
PARENTS = """SELECT DISTINCT conv_id AS id, CASE WHEN conv_id % 10 IN (4, 5, 6) THEN conv_id + CASE WHEN conv_id % 10 = 6 THEN -2 ELSE 1 END WHEN conv_id % 10 = 7 THEN conv_id - 1 WHEN conv_id % 3 = 0 AND conv_id > 0 THEN CAST(floor(conv_id / 2) AS BIGINT) WHEN conv_id % 10 = 8 THEN conv_id + 100000000 END AS parent FROM {conversations}"""


def _view(sql: str):
    return lambda spark, sf_dir: s.derived(spark, sf_dir, sql)


nodes, edges, truth = _view(NODES), _view(EDGES), _view(TRUTH)


def after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).withColumn("status", F.expr(AFTER))


def _of(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    return nodes(spark, sf_dir).where(F.col("status") == status).select("id")


def g4_invalid_or_parked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.dependents(edges(spark, sf_dir).where("kind = 'depends_on'").select("src", "dst"), nodes(spark, sf_dir).where("status in ('false', 'parked')").select("id"))


def g5_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.family(edges(spark, sf_dir), _of(spark, sf_dir, "proving"))


def g6_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.invalidate(nodes(spark, sf_dir), edges(spark, sf_dir), _of(spark, sf_dir, "blocked")).select("id", "status")


def g7_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.lineage(_view(JOBS)(spark, sf_dir).distinct())


def g8_root_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.roots(_view(PARENTS)(spark, sf_dir))


def g1_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.schedule(s.derived(spark, sf_dir, "SELECT p_partkey AS label, p_partkey AS ordinal FROM {part}"), _view(USES)(spark, sf_dir))


def g11_split_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.split_ancestors(nodes(spark, sf_dir), edges(spark, sf_dir))


def g12_assignment_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.assignment_frontier(nodes(spark, sf_dir), edges(spark, sf_dir), nodes(spark, sf_dir).select("id"))


def g14_completed_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.completed_splits(nodes(spark, sf_dir), after(spark, sf_dir), edges(spark, sf_dir))


def k4_open_subgoals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.open_subgoals(nodes(spark, sf_dir), edges(spark, sf_dir))


def _delta(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    new = nodes(spark, sf_dir).select((F.col("id") + F.when(F.col("id") % 2 == 0, 10**9).otherwise(0)).alias("id"), F.when(F.col("id") % 9 == 1, F.lit("other")).otherwise(F.col("statement")).alias("statement"), F.lit("proved").alias("status"), F.lit("note").alias("notes"))
    links = edges(spark, sf_dir).select("src", (F.col("dst") + F.when(F.col("src") % 6 == 0, 10**9).otherwise(0)).alias("dst"), "kind").unionByName(edges(spark, sf_dir).where("src % 8 = 0").select("src", F.col("src").alias("dst"), "kind"))
    return o.merge_delta(nodes(spark, sf_dir).select("id", "statement", "status", "notes"), edges(spark, sf_dir), new, links)


def u2_merge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta(spark, sf_dir)[0]


def u2_merge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links, changes = _delta(spark, sf_dir)
    return changes.groupBy("change").agg(F.count("*").alias("n"), F.sum("src").alias("src")).unionByName(links.groupBy("kind").agg(F.count("*").alias("n"), F.sum("src").alias("src")).withColumnRenamed("kind", "change"))


def u3_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.reconcile(nodes(spark, sf_dir), edges(spark, sf_dir), truth(spark, sf_dir)).select("id", "status", "new_status")


def u4_lost_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.lost_work(nodes(spark, sf_dir), after(spark, sf_dir), truth(spark, sf_dir))


def j5_declared_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = nodes(spark, sf_dir).select(F.col("id").alias("label"), F.array(F.floor(F.col("id") / 2), F.col("line"), F.col("id") * 3).alias("uses"))
    return o.declared_edges(items)


def j6_candidate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their concepts and, as one more, their size, which few items share."""
    rows = s.item_concepts(spark, sf_dir)
    sizes = s.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("label"), F.col("p_partkey").alias("ordinal"), F.col("p_brand").alias("chapter"), F.concat(F.lit("size "), "p_size").alias("concept"))
    return o.candidate_edges(rows.unionByName(sizes))


def j11_late_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.late_dependencies(nodes(spark, sf_dir), edges(spark, sf_dir), _of(spark, sf_dir, "proving"))


def j18_relevant_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.relevant_findings(_view(FINDINGS)(spark, sf_dir), g11_split_ancestors(spark, sf_dir))


def j28_recovery_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.recovery_candidates(nodes(spark, sf_dir), edges(spark, sf_dir), truth(spark, sf_dir), _of(spark, sf_dir, "proving"))


def a4_library_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.library_modules(s.item_concepts(spark, sf_dir), _view(DOMAINS)(spark, sf_dir))[0]


def a4_unassigned_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.library_modules(s.item_concepts(spark, sf_dir), _view(DOMAINS)(spark, sf_dir))[1]


def p17_select_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = nodes(spark, sf_dir).select(F.col("id").alias("label"), F.col("line").alias("position"))
    return o.select_scope(items, edges(spark, sf_dir), nodes(spark, sf_dir).where("status = 'conjectured'").select(F.col("id").alias("label")))


_N, _E, _T = f"n AS ({s.plain(NODES)})", f"e AS ({s.plain(EDGES)})", f"t AS ({s.plain(TRUTH)})"
_DOWN = "d AS (SELECT src, dst FROM e WHERE kind = 'depends_on' UNION SELECT dst AS src, src AS dst FROM e WHERE kind = 'split_of')"
_FAMILY = f"{_N}, {_E}, {_DOWN}, fam AS (SELECT id AS target, id FROM n WHERE status = 'proving' UNION SELECT fam.target, d.dst AS id FROM fam JOIN d ON d.src = fam.id)"
_READY = "(status IN ('stated', 'audited') AND NOT EXISTS (SELECT 1 FROM e LEFT JOIN n q ON q.id = e.dst WHERE e.kind = 'depends_on' AND e.src = n.id AND coalesce(q.status, '') <> 'proved'))"
_SAME = "u AS (SELECT e.src, e.dst FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE kind = 'split_of' AND a.file = b.file), anc AS (SELECT src AS id, dst AS ancestor FROM u UNION SELECT anc.id, u.dst AS ancestor FROM anc JOIN u ON u.src = anc.ancestor)"
_MERGED = """nw AS (SELECT id + CASE WHEN id % 2 = 0 THEN 1000000000 ELSE 0 END AS id, CASE WHEN id % 9 = 1 THEN 'other' ELSE statement END AS statement FROM n),
 b AS (SELECT coalesce(n.id, nw.id) AS id, n.id IS NULL AS fresh, nw.id IS NULL AS same, n.statement AS os, nw.statement AS ds, n.status, n.notes, n.id IS NOT NULL AND nw.id IS NOT NULL AND n.statement <> '' AND nw.statement <> '' AND n.statement <> nw.statement AS conflict FROM n FULL JOIN nw ON nw.id = n.id),
 x AS (SELECT src, dst + CASE WHEN src % 6 = 0 THEN 1000000000 ELSE 0 END AS dst, kind FROM e UNION SELECT src, src AS dst, kind FROM e WHERE src % 8 = 0)"""
_CONCEPTS = r"i AS (SELECT DISTINCT p_partkey AS label, p_brand AS chapter, unnest(regexp_split_to_array(lower(p_name || ' ' || p_type), '\s+')) AS concept FROM part), c AS (SELECT * FROM i WHERE concept <> '')"
_ACTIVE = f"{_CONCEPTS}, a AS (SELECT concept FROM c GROUP BY concept HAVING count(DISTINCT label) >= 2), dm AS ({s.plain(DOMAINS)}), f AS (SELECT DISTINCT label, c.concept, domain FROM c JOIN a ON a.concept = c.concept JOIN dm ON dm.concept = c.concept), k AS (SELECT domain, string_agg(DISTINCT concept, ',' ORDER BY concept) AS concepts, count(DISTINCT label) AS consumers FROM f GROUP BY domain HAVING count(DISTINCT label) >= 2)"
ORACLES = {
    "g4_invalid_or_parked": f"WITH RECURSIVE {_N}, {_E}, r AS (SELECT e.src AS id FROM e JOIN n ON n.id = e.dst WHERE kind = 'depends_on' AND n.status IN ('false', 'parked') UNION SELECT e.src AS id FROM r JOIN e ON e.dst = r.id AND kind = 'depends_on') SELECT id FROM r",
    "g5_family": f"WITH RECURSIVE {_FAMILY} SELECT target, id FROM fam",
    "g6_invalidate": f"""WITH RECURSIVE {_N}, {_E}, ch AS (SELECT id FROM n WHERE status = 'blocked' UNION SELECT e.dst AS id FROM ch JOIN e ON e.src = ch.id AND e.kind = 'split_of'),
      h AS (SELECT e.dst AS id, bool_or(EXISTS (SELECT 1 FROM e v WHERE v.kind = 'depends_on' AND v.src = e.dst AND v.dst = e.src)) AS used FROM e JOIN ch ON ch.id = e.src WHERE e.kind = 'split_of' GROUP BY e.dst)
      SELECT n.id, CASE WHEN status = 'blocked' THEN 'false' WHEN used IS NOT NULL AND status <> 'false' AND (status <> 'proved' OR used) THEN 'conjectured' ELSE status END AS status FROM n LEFT JOIN h ON h.id = n.id""",
    "g7_lineage": f"WITH j AS (SELECT DISTINCT job_id FROM ({s.plain(JOBS)})) SELECT j.job_id, a.job_id AS ancestor, (len(string_split(j.job_id, '.')) - len(string_split(a.job_id, '.')))::INT AS distance FROM j JOIN j a ON starts_with(j.job_id, a.job_id || '.')",
    "g8_root_sessions": f"""WITH RECURSIVE p AS ({s.plain(PARENTS)}), w AS (SELECT id, id AS ax, 0 AS step FROM p UNION ALL SELECT w.id, p.parent AS ax, step + 1 AS step FROM w JOIN p ON p.id = w.ax WHERE p.parent IS NOT NULL AND step < 60),
      l AS (SELECT id, arg_max(ax, step) AS ax, max(step) AS step FROM w GROUP BY id), cy AS (SELECT id, min(ax) AS least FROM w WHERE step > 40 GROUP BY id) SELECT l.id, CASE WHEN l.step = 60 THEN cy.least ELSE l.ax END AS root FROM l LEFT JOIN cy ON cy.id = l.id""",
    "g1_schedule": f"""WITH RECURSIVE u AS (SELECT DISTINCT src, dst FROM ({s.plain(USES)})), i AS (SELECT p_partkey AS label FROM part), k AS (SELECT u.* FROM u JOIN i ON i.label = u.dst), cy AS (SELECT label FROM i WHERE label % 50 IN (38, 39, 40) UNION SELECT k.src AS label FROM cy JOIN k ON k.dst = cy.label),
      r AS (SELECT label, 0 AS level FROM i WHERE label NOT IN (SELECT label FROM cy) UNION SELECT k.src AS label, level + 1 AS level FROM r JOIN k ON k.dst = r.label WHERE k.src NOT IN (SELECT label FROM cy)), lv AS (SELECT i.label, max(level) AS level FROM i LEFT JOIN r ON r.label = i.label GROUP BY i.label)
      SELECT label, row_number() OVER (ORDER BY level NULLS LAST, label) AS position, level, level IS NULL AS in_cycle, (SELECT count(*) FROM u WHERE u.src = lv.label AND u.dst NOT IN (SELECT label FROM i)) AS unresolved FROM lv""",
    "g11_split_ancestors": f"WITH RECURSIVE {_N}, {_E}, {_SAME} SELECT id, ancestor FROM anc",
    "g12_assignment_frontier": f"WITH {_N}, {_E} SELECT DISTINCT b.target, n.id, n.status FROM (SELECT src AS target, dst AS id FROM e WHERE kind = 'depends_on' UNION SELECT dst AS target, src AS id FROM e WHERE kind = 'split_of') b JOIN n ON n.id = b.id JOIN n y ON y.id = b.target WHERE {_READY.replace('(status', '(n.status', 1)}",
    "g14_completed_splits": f"""WITH {_N}, {_E}, a AS (SELECT id, status AS was, {AFTER} AS now FROM n), p AS (SELECT id FROM a WHERE was = 'split' OR now = 'split'), r AS (SELECT DISTINCT src, dst, a.was = 'proved' AS was, a.now = 'proved' AS now FROM e JOIN p ON p.id = e.src LEFT JOIN a ON a.id = e.dst WHERE kind = 'depends_on'),
      g AS (SELECT src FROM r GROUP BY src HAVING bool_and(coalesce(now, false)) AND NOT bool_and(coalesce(was, false))) SELECT r.src AS parent, r.dst AS id FROM r JOIN g ON g.src = r.src WHERE now AND NOT was""",
    "k4_open_subgoals": f"WITH {_N}, {_E}, r AS (SELECT id, status, CASE WHEN {_READY} THEN 0 WHEN status IN ('stated', 'audited', 'conjectured', 'proving') THEN 1 WHEN status IN ('blocked', 'parked') THEN 2 END AS rank FROM n) SELECT rank::INT AS rank, id, status FROM r WHERE rank IS NOT NULL ORDER BY rank, id LIMIT 25",
    "u2_merge_nodes": f"WITH {_N}, {_E}, {_MERGED} SELECT id, CASE WHEN fresh THEN ds WHEN os = '' AND NOT conflict THEN coalesce(ds, os) ELSE os END AS statement, CASE WHEN fresh THEN CASE WHEN trim(ds) = '' THEN 'conjectured' ELSE 'stated' END ELSE status END AS status, CASE WHEN fresh THEN 'note' WHEN trim(notes) = '' AND NOT conflict AND NOT same THEN 'note' ELSE notes END AS notes FROM b",
    "u2_merge_changes": f"""WITH {_N}, {_E}, {_MERGED}, ok AS (SELECT x.* FROM x WHERE src <> dst AND src IN (SELECT id FROM b) AND dst IN (SELECT id FROM b))
      SELECT 'signature_conflict' AS change, count(*) AS n, sum(id)::BIGINT AS src FROM b WHERE conflict UNION ALL SELECT 'self_edge', count(*), sum(src)::BIGINT FROM x WHERE src = dst UNION ALL SELECT 'dangling_edge', count(*), sum(src)::BIGINT FROM x WHERE src <> dst AND (src, dst, kind) NOT IN (SELECT (src, dst, kind) FROM ok)
      UNION ALL SELECT kind, count(*), sum(src)::BIGINT FROM (SELECT src, dst, kind FROM e UNION SELECT src, dst, kind FROM ok) GROUP BY kind""",
    "u3_reconcile": f"""WITH RECURSIVE {_N}, {_E}, {_T}, inv AS (SELECT e.src AS id FROM e JOIN n ON n.id = e.dst WHERE kind = 'depends_on' AND n.status IN ('false', 'parked') UNION SELECT e.src AS id FROM inv JOIN e ON e.dst = inv.id AND kind = 'depends_on'),
      r AS (SELECT n.*, n.file IN (SELECT file FROM t) AS seen, coalesce(t.present, false) AS here, coalesce(t.dirty, false) AS bad, n.id IN (SELECT id FROM inv) AS invalid FROM n LEFT JOIN t ON t.file = n.file AND t.name = n.name)
      SELECT id, status, CASE WHEN NOT seen THEN status WHEN status = 'proved' AND invalid THEN 'conjectured' WHEN status = 'proved' AND (NOT here OR bad) THEN CASE WHEN here THEN 'stated' ELSE 'conjectured' END WHEN NOT here AND generated_by IN ('planner', 'prover-edit') AND status IN ('stated', 'audited', 'proving', 'blocked') THEN 'conjectured'
        WHEN status = 'conjectured' AND here AND NOT (generated_by = 'planner' AND uncertain) THEN 'stated' ELSE status END AS new_status FROM r""",
    "u4_lost_work": f"WITH {_N}, {_T} SELECT id FROM n JOIN t ON t.file = n.file AND t.name = n.name WHERE status = 'proved' AND present AND NOT dirty AND ({AFTER}) <> 'proved'",
    "j5_declared_edges": f"WITH {_N} SELECT DISTINCT id AS src, dst, dst IN (SELECT id FROM n) AS target_known FROM (SELECT id, unnest([id // 2, line, id * 3]) AS dst FROM n)",
    "j6_candidate_edges": f"""WITH {_CONCEPTS}, cs AS (SELECT * FROM c UNION ALL SELECT p_partkey, p_brand, 'size ' || p_size FROM part), s AS (SELECT concept FROM cs GROUP BY concept HAVING count(*) <= (SELECT greatest(8, count(DISTINCT label) // 10) FROM cs)), o AS (SELECT c.* FROM cs c JOIN s ON s.concept = c.concept),
      p AS (SELECT a.label AS src, b.label AS dst, count(*) AS shared FROM o a JOIN o b ON b.chapter = a.chapter AND b.concept = a.concept AND b.label < a.label GROUP BY ALL) SELECT src, dst, shared FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY shared DESC, dst DESC) <= 3""",
    "j11_late_dependencies": f"WITH RECURSIVE {_FAMILY} SELECT fam.target, fam.id FROM fam JOIN n d ON d.id = fam.id JOIN n y ON y.id = fam.target WHERE fam.id <> fam.target AND d.status = 'proved' AND d.file = y.file AND d.line > y.line",
    "j18_relevant_findings": f"""WITH RECURSIVE {_N}, {_E}, {_SAME}, f AS ({s.plain(FINDINGS)}), v AS (SELECT finding, target, 0 AS tier FROM f UNION ALL SELECT finding, anc.id AS target, 1 AS tier FROM f JOIN anc ON anc.ancestor = f.target)
      SELECT target, finding, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY tier, finding DESC) AS rank FROM v) WHERE rank <= 3""",
    "j28_recovery_candidates": f"""WITH RECURSIVE {_FAMILY}, {_T} SELECT fam.target, fam.id FROM fam JOIN n ON n.id = fam.id JOIN t ON t.file = n.file AND t.name = n.name WHERE present AND NOT dirty AND status NOT IN ('proved', 'false', 'parked')
      AND NOT EXISTS (SELECT 1 FROM e LEFT JOIN n q ON q.id = e.dst WHERE e.kind = 'depends_on' AND e.src = n.id AND coalesce(q.status, '') <> 'proved')""",
    "a4_library_modules": f"WITH {_ACTIVE} SELECT * FROM k",
    "a4_unassigned_concepts": f"WITH {_ACTIVE} SELECT concept FROM a WHERE concept NOT IN (SELECT f.concept FROM f JOIN k ON k.domain = f.domain)",
    "p17_select_scope": f"WITH {_N}, {_E} SELECT id AS label, line AS position, CASE WHEN status = 'conjectured' THEN 'selected' ELSE 'dependency' END AS role FROM n WHERE status = 'conjectured' OR id IN (SELECT dst FROM e JOIN n y ON y.id = e.src WHERE y.status = 'conjectured')",
}
QUERIES = {q.__name__: q for q in (g1_schedule, g4_invalid_or_parked, g5_family, g6_invalidate, g7_lineage, g8_root_sessions, g11_split_ancestors, g12_assignment_frontier, g14_completed_splits, k4_open_subgoals, u2_merge_nodes, u2_merge_changes, u3_reconcile, u4_lost_work, j5_declared_edges, j6_candidate_edges, j11_late_dependencies, j18_relevant_findings, j28_recovery_candidates, a4_library_modules, a4_unassigned_concepts, p17_select_scope)}
