"""Queries over LaTeX files and statements of declarations that the given parts stand for, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as f
from ..operators import blocks, cases, inventory
from ..operators import statements as o
from ..operators import tex
from ..sources import tables as s

_VAR = "CASE p_partkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'yy' ELSE 'n''' END"
#: Declarations that say the same where their size is the same, each with binders of its own names.
DECLARATIONS = f"""SELECT 'F' || (p_partkey % 20) AS file, 't' || p_partkey AS name, p_partkey AS line,
 'theorem t' || p_partkey || ' (' || {_VAR} || ' : Nat) (h' || (p_partkey % 4) || ' : ' || {_VAR} || ' > ' || p_size || ') : ' || {_VAR} || ' + 0 = ' || {_VAR} || ' := by' || chr(10) || '  simp' AS text FROM {{part}}"""
CANDIDATES = """SELECT p_partkey AS id, 'F' || (p_partkey % 20) AS file, 't' || p_partkey AS target, CASE WHEN p_partkey % 7 = 0 THEN 'lemma N.t' || (p_partkey - 20) || ' : True'
 ELSE 'theorem new (q : Nat) (r : q > ' || p_size || ') : q + 0 = q' END AS text FROM {part}"""
#: Each third part is a target, the next one a helper that refutes it in one of four ways (one of them too weak), all of them have jobs.
NODES = """SELECT a.p_partkey AS id, 'F' AS file, CASE WHEN a.p_partkey % 3 = 1 AND a.p_size % 5 > 0 THEN 'proved' ELSE 'stated' END AS status, CASE WHEN a.p_partkey % 3 = 1 AND b.p_partkey IS NOT NULL THEN
 'theorem h' || a.p_partkey || CASE a.p_size % 4 WHEN 0 THEN ' (n : Nat) (h : n > ' || b.p_size || ') : ¬ (P n)' WHEN 1 THEN ' : ¬ (∀ (n : Nat) (h : n > ' || b.p_size || '),  P n)' WHEN 2 THEN ' (n : Nat) : ¬ P n' ELSE ' (n : Nat)  (h : n > ' || b.p_size || ') : Not (P n)' END
 ELSE 'theorem t' || a.p_partkey || ' (n : Nat) (h : n > ' || a.p_size || ') : P n' END AS statement FROM {part} a LEFT JOIN {part} b ON b.p_partkey = a.p_partkey - 1"""
EVIDENCE = "SELECT p_partkey AS src, p_partkey - 1 AS dst, CASE WHEN p_size % 7 = 0 THEN 'refers' ELSE 'evidence_for' END AS kind FROM {part} WHERE p_partkey % 3 = 1"
JOBS = """SELECT event_id AS job_id, CASE WHEN event_id % 5 = 0 THEN 'proof' ELSE 'empirical' END AS archetype, CASE WHEN event_id % 4 = 0 THEN 'evidence-to-helper' ELSE 'x' END AS route_key, CASE event_id % 3 WHEN 0 THEN 'Find small cases' ELSE 'prove it' END AS objective, user_id AS target FROM {events}"""
PARENTS = """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'theorem p' || p_partkey || ' (n : Nat) : f n = g n ∧ n ≤ f n' ELSE 'theorem p' || p_partkey || ' (n : ℕ) : ∃ a b : Nat, a < b ∧ b < n' END AS text FROM {part}"""
HELPERS = """SELECT p_partkey AS id, p_partkey AS parent_id, CASE p_partkey % 10 WHEN 0 THEN 'theorem a : f ' || p_size || ' = g ' || p_size || ' ∧ ' || p_size || ' <= f ' || p_size WHEN 2 THEN 'theorem a (m : Nat) : f m = g m ∧ m ≤ f m' WHEN 4 THEN 'theorem a : f ' || p_size || ' = k ' || p_size
 WHEN 6 THEN 'theorem a : f n = g 3' WHEN 8 THEN 'def a := 3' WHEN 1 THEN 'lemma b (n : Nat) : ∃ c d : Nat, c < d ∧ d < n ∧ c = c' WHEN 3 THEN 'lemma b (n : Nat) : ∃ c : Nat, c < n' WHEN 5 THEN 'lemma b (m : Nat) : ∃ c d : Nat, c < d ∧ d < m' WHEN 7 THEN 'lemma b : ∃ a b : Nat, a < b ∧ b < ' || p_size ELSE 'lemma b (n : Nat) : n < n' END AS text FROM {part}"""
#: Each fourth part is an open parent, the others its helpers: with a premise of its own, one that holds the parent's result, or none.
PROVED = """SELECT p_partkey AS id, 'F' AS file, 'N.d' || p_partkey AS name, CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_size % 3 = 0 THEN 'proved' ELSE 'split' END WHEN p_size % 11 = 0 THEN 'stated' ELSE 'proved' END AS status,
 CASE WHEN p_size % 13 = 0 THEN '(∀ y, Q y ' || p_partkey || ')' ELSE '' END AS statement FROM {part}"""
CODE = """SELECT 'F' AS file, 'd' || p_partkey AS name, p_partkey AS line, CASE p_partkey % 4 WHEN 0 THEN 'theorem d' || p_partkey || ' (x : Nat) (h : x > 0) : P x := by' || chr(10) || CASE WHEN p_size % 2 = 0 THEN '  exact N.d' || (p_partkey + 2) ELSE '  sorry' END
 WHEN 1 THEN 'theorem d' || p_partkey || ' (h : x > 0) (k : ∀ y, Q y ' || (p_partkey + 4) || ') : T' WHEN 2 THEN 'theorem d' || p_partkey || ' (x : Nat) (l : (P x → False)) : T' ELSE 'theorem d' || p_partkey || ' (x : Nat) (f : Nat → Nat) (h : x > 0) : T' END AS text FROM {part}"""
SPLITS = "SELECT p_partkey AS src, p_partkey - p_partkey % 4 AS dst, 'split_of' AS kind FROM {part} WHERE p_partkey % 4 > 0 AND p_partkey > 4"
#: Each fortieth part is an open parent; the others, proved in an order of their own, settle a class, a value, or nothing finite.
CASE_NODES = """SELECT p_partkey AS id, 'F' || (p_partkey % 2) AS file, 'd' || p_partkey AS name, CASE WHEN p_partkey % 40 = 0 THEN 'stated' ELSE 'proved' END AS status,
 CASE WHEN p_partkey % 40 > 0 THEN p_partkey * 7919 % 1000003 END AS seq FROM {part}"""
CASE_EDGES = "SELECT p_partkey AS src, p_partkey - p_partkey % 40 AS dst, 'split_of' AS kind FROM {part} WHERE p_partkey % 40 > 0"
CASE_CODE = """SELECT 'F' || (p_partkey % 2) AS file, 'd' || p_partkey AS name, 'theorem d' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN ' (h : t % ' || (p_size % 4 + 2) * (1 + p_partkey % 2) || ' = ' || (p_size % (p_size % 4 + 2)) || ')' WHEN 1 THEN ' (h : t = ' || (p_size % 9) || ')' ELSE '' END || ' : P' AS text FROM {part}"""
#: Files with a declared environment, blocks within blocks, comments, one that is never closed, and proofs near and far.
_B = "chr(92) || "
TEX = rf"""SELECT 'f' || p_partkey || '.tex' AS path, {_B}'newtheorem' || chr(123) || 'satz' || chr(125) || chr(123) || 'Main Lemma' || chr(125) || chr(10) || {_B}'section' || chr(123) || p_brand || chr(125) || chr(10)
 || {_B}'begin' || chr(123) || 'Theorem' || chr(125) || '[' || p_name || ']' || {_B}'label' || chr(123) || 'thm:' || p_partkey || chr(125) || ' ' || {_B}'uses' || chr(123) || 'a' || p_size || ', b,b' || chr(125) || ' Let ' || p_brand || '. % said' || chr(10)
 || {_B}'begin' || chr(123) || 'theorem' || chr(125) || 'in' || {_B}'end' || chr(123) || 'theorem' || chr(125) || {_B}'end' || chr(123) || 'theorem' || chr(125) || CASE p_partkey % 3 WHEN 0 THEN chr(10) || '% near' || chr(10) WHEN 1 THEN ' ' ELSE 'far' END
 || {_B}'begin' || chr(123) || 'proof' || chr(125) || 'By ' || p_size || '.' || chr(10) || {_B}'end' || chr(123) || 'proof' || chr(125) || chr(10) || {_B}'begin' || chr(123) || 'lemma' || chr(125) || ' open ' || chr(10)
 || {_B}'begin' || chr(123) || 'satz' || chr(125) || p_type || {_B}'end' || chr(123) || 'satz' || chr(125) || chr(10) || {_B}'subsection*' || chr(123) || 'S ' || p_size || chr(125) AS text FROM {{part}}"""


def _view(sql: str):
    return lambda spark, sf_dir: s.derived(spark, sf_dir, sql)


def _spread(sql: str):
    """A view over parts whose texts take long to read: they are dealt out first."""
    return lambda spark, sf_dir: s.spread_parts(spark, sf_dir, sql)


def s4_tex_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tex.tex_blocks(_view(TEX)(spark, sf_dir)).withColumn("uses", F.array_join("uses", ",")).drop("lean")


def s4_tex_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tex.tex_sections(_view(TEX)(spark, sf_dir))


def j29_but_for_binders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _spread(DECLARATIONS)(spark, sf_dir)
    return o.duplicates_but_for_binders(found.withColumn("id", F.col("name")), found)


def t5_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.covered(_spread(CANDIDATES)(spark, sf_dir), _spread(DECLARATIONS)(spark, sf_dir))


def j19_universal_obstructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.universal_obstructions(_view(NODES)(spark, sf_dir), _view(EVIDENCE)(spark, sf_dir))


def j19_dominated_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.dominated_jobs(_view(JOBS)(spark, sf_dir), _view(NODES)(spark, sf_dir), _view(EVIDENCE)(spark, sf_dir))


def p23_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.admission(_spread(HELPERS)(spark, sf_dir), _spread(PARENTS)(spark, sf_dir))


def j27_conditional_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = o.conditional_helpers(_view(PROVED)(spark, sf_dir), _view(SPLITS)(spark, sf_dir), _view(CODE)(spark, sf_dir))
    return found.select("id", F.array_join("obligations", "|").alias("obligations"), F.array_join("unresolved", "|").alias("unresolved"), "wrapper")


def a23_finite_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.finite_cases(_view(CASE_NODES)(spark, sf_dir), _view(CASE_EDGES)(spark, sf_dir), _view(CASE_CODE)(spark, sf_dir))


#: Proofs with a block of as many lines as the part's size says, one within it, a short one, one with a hole, and comments.
PROOFS = """SELECT p_partkey AS id, 'theorem t : P := by' || chr(10) || '  have big : A := by -- have no : B := by' || chr(10) || repeat('    have step : C := by simp' || chr(10), p_size % 17) || chr(10) || '  have hole : D := by' || chr(10) || repeat('    sorry' || chr(10), 9)
 || '  have second : E := by' || chr(10) || repeat('    exact h' || chr(10), p_partkey % 13) || '  rfl' || chr(10) || repeat('    -- note' || chr(10), 9) AS text FROM {part}"""


def k10_extraction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.extraction_candidates(_spread(PROOFS)(spark, sf_dir))


#: Entries of plans that lack a field each, and declarations of which some are not made or have no notes.
ITEMS = "SELECT 'L' || p_partkey AS label, CASE p_partkey % 3 WHEN 0 THEN 'Theorem' WHEN 1 THEN 'definition' ELSE 'remark' END AS kind, p_size % 10 = 0 AS has_proof FROM {part}"
ENTRIES = """SELECT 'L' || p_partkey AS label, '- Source locator: ' || CASE WHEN p_size % 7 = 0 THEN 'TBD' ELSE p_brand || ', line ' || p_size END || chr(10) || '- Planned Lean declarations:' || chr(10) || '  - `d' || p_partkey || ' : P`, `d' || (p_partkey + 1) || '`' || chr(10)
 || CASE WHEN p_size % 5 = 0 THEN '' ELSE '- Formal statement review: done' || chr(10) END || '- Source qualifiers: ' || CASE WHEN p_size % 6 = 0 THEN 'n > 0, weakened' ELSE 'n > 0' END || chr(10) || '- Lean coverage: whole' || chr(10) || '- Scope change: none' || chr(10)
 || '- Verification status: ' || CASE WHEN p_size % 4 = 0 THEN 'open' ELSE 'Reviewed' END || chr(10) || '- Prover notes: ' || CASE WHEN p_size % 3 = 0 THEN 'None' ELSE p_type END AS text FROM {part} WHERE p_partkey % 11 > 0"""
MADE = "SELECT 'd' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'theorem' ELSE 'def' END AS kind, CASE WHEN p_size % 2 = 0 THEN 'A Proof Sketch.' END AS comment FROM {part} WHERE p_partkey % 13 > 0"


def j25_inventory_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.inventory_issues(_spread(ITEMS)(spark, sf_dir), _spread(ENTRIES)(spark, sf_dir), _spread(MADE)(spark, sf_dir))


#: Each eighth part is an open parent; its helpers rest on an earlier declaration of one of three names, or have proofs of three shapes.
MECHANISM_NODES = "SELECT p_partkey AS id, 'F' AS file, 'm' || p_partkey AS name, CASE WHEN p_partkey % 8 = 0 THEN 'stated' ELSE 'proved' END AS status FROM {part}"
MECHANISM_EDGES = "SELECT p_partkey AS src, p_partkey - p_partkey % 8 AS dst, 'split_of' AS kind FROM {part} WHERE p_partkey % 8 > 0"
MECHANISM_CODE = """SELECT 'F' AS file, 'm' || p_partkey AS name, p_partkey + 10 AS line, 'theorem m' || p_partkey || ' (x' || p_size || ' : Nat) : P := by' || chr(10) || CASE WHEN p_partkey % 8 < 5 THEN '  exact base' || (p_partkey % 3) || ' x' || p_size || ' m' || (p_partkey + 1) ELSE '  rcases h' || p_size || ' with k' || chr(10) || repeat('  omega ' || p_size, p_partkey % 3) END AS text FROM {part}
 UNION ALL SELECT 'F', 'base' || r_regionkey, r_regionkey + 1, 'theorem base' || r_regionkey || ' : P := trivial' FROM {region}"""
#: Texts of routes that name mechanisms, atoms, numbers, symbols and jobs.
ROUTES = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Split the case modulo ' || p_size || ' by strong  Induction on `Foo.bar_' || p_size || '`' WHEN 1 THEN 'Search Mathlib for h_' || p_partkey || ' and x2; attempt 7' WHEN 2 THEN 'Bounded witness for theta and n over a prime' WHEN 3 THEN 'worker 12 of ds-004 with `ds-004`' ELSE p_name END AS text FROM {part}"""


def f7_route_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spread(ROUTES)(spark, sf_dir).where("id % 5 < 4")
    return rows.select("id", F.array_join(f.route_features(F.col("text")), "|").alias("features"), F.array_join(f.target_symbols(F.col("text")), "|").alias("symbols"))


def g13_mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each helper its basis, and the least helper of the same mechanism."""
    found = o.mechanisms(_view(MECHANISM_NODES)(spark, sf_dir), _view(MECHANISM_EDGES)(spark, sf_dir), _view(MECHANISM_CODE)(spark, sf_dir))
    least = found.groupBy("signature").agg(F.min("id").alias("first"))
    return found.join(least, "signature").select("id", "parent", "basis", "first")


_REFUTED = f"""n AS ({s.plain(NODES)}), e AS ({s.plain(EVIDENCE)}),
  r AS (SELECT p.p_partkey - 1 AS target, p.p_partkey AS helper FROM part p JOIN e ON e.src = p.p_partkey JOIN part b ON b.p_partkey = e.dst WHERE kind = 'evidence_for' AND p.p_size % 5 > 0 AND p.p_size % 4 <> 2)"""
ORACLES = {
    "s4_tex_blocks": """WITH t AS (SELECT *, p_partkey % 3 AS m FROM part)
      SELECT 'f' || p_partkey || '.tex' AS path, 'theorem' AS kind, 'Theorem' AS environment, 'thm:' || p_partkey AS label, p_name AS title, 'a' || p_size || ',b' AS uses, 'Let ' || p_brand || '. ' || chr(92) || 'begin{theorem}in' || chr(92) || 'end{theorem}' AS statement,
        3 AS line, 4 AS end_line, CASE WHEN m < 2 THEN 'By ' || p_size || '.' ELSE '' END AS proof, CASE WHEN m < 2 THEN 4 ELSE 0 END AS proof_line, CASE m WHEN 0 THEN 7 WHEN 1 THEN 5 ELSE 0 END AS proof_end_line FROM t
      UNION ALL SELECT 'f' || p_partkey || '.tex', 'lemma', 'satz', 'line-' || CASE WHEN m = 0 THEN 9 ELSE 7 END, '', '', p_type, CASE WHEN m = 0 THEN 9 ELSE 7 END, CASE WHEN m = 0 THEN 9 ELSE 7 END, '', 0, 0 FROM t""",
    "s4_tex_sections": """SELECT 'f' || p_partkey || '.tex' AS path, 1 AS nth, 'section' AS level, p_brand AS title, 2 AS line FROM part
      UNION ALL SELECT 'f' || p_partkey || '.tex', 2, 'subsection', 'S ' || p_size, CASE WHEN p_partkey % 3 = 0 THEN 10 ELSE 8 END FROM part""",
    "j29_but_for_binders": "SELECT 't' || a.p_partkey AS id, 't' || b.p_partkey AS name FROM part a JOIN part b ON b.p_partkey % 20 = a.p_partkey % 20 AND b.p_size = a.p_size AND b.p_partkey < a.p_partkey",
    "t5_covered": """SELECT p_partkey AS id, 't' || (p_partkey - 20) AS existing, 'same_name' AS reason FROM part WHERE p_partkey % 7 = 0 AND p_partkey > 20
      UNION ALL SELECT a.p_partkey, 't' || min(b.p_partkey), 'same_signature' FROM part a JOIN part b ON b.p_partkey % 20 = a.p_partkey % 20 AND b.p_size = a.p_size AND b.p_partkey < a.p_partkey WHERE a.p_partkey % 7 > 0 GROUP BY a.p_partkey""",
    "j19_universal_obstructions": f"WITH {_REFUTED} SELECT * FROM r",
    "j19_dominated_jobs": f"WITH {_REFUTED} SELECT event_id AS job_id, user_id AS target FROM events WHERE event_id % 5 > 0 AND (event_id % 4 = 0 OR event_id % 3 = 0) AND user_id IN (SELECT target FROM r)",
    "a23_finite_cases": """WITH k AS (SELECT p_partkey AS id, p_partkey % 2 AS file, p_partkey - p_partkey % 40 AS parent, p_partkey * 7919 % 1000003 AS seq, p_partkey % 3 AS kind, (p_size % 4 + 2) * (1 + p_partkey % 2) AS m, p_size % (p_size % 4 + 2) AS r, p_size % 9 AS v FROM part WHERE p_partkey % 40 > 0),
      c AS (SELECT *, CASE kind WHEN 0 THEN 't%' || m || '=' || r ELSE 't=' || v END AS branch FROM k WHERE kind < 2 AND parent IN (SELECT p_partkey FROM part)),
      p AS (SELECT a.id, a.branch, least(4, count(DISTINCT b.branch)) AS prior, coalesce(bool_or(a.kind = 0 AND b.kind = 0 AND b.m > a.m AND b.m % a.m = 0 AND b.r % a.m = a.r), false) AS broader
        FROM c a LEFT JOIN c b ON b.parent = a.parent AND b.file = a.file AND b.seq < a.seq GROUP BY a.id, a.branch)
      SELECT id, branch, prior, prior >= 4 AS saturated, prior >= 4 AND NOT broader AS evidence_only FROM p""",
    "k10_extraction_candidates": """WITH b AS (SELECT p_partkey AS id, 'big' AS name, 2 AS line, p_size % 17 + 1 AS lines, 41 + 29 * (p_size % 17) AS chars FROM part
      UNION ALL SELECT p_partkey, 'second', 2 + p_size % 17 + 12, p_partkey % 13 + 1, 23 + 12 * (p_partkey % 13) FROM part)
      SELECT id, row_number() OVER (PARTITION BY id ORDER BY chars DESC, lines DESC, line) AS rank, name, line, lines, chars FROM b WHERE lines >= 8""",
    "j25_inventory_issues": """WITH e AS (SELECT *, 'L' || p_partkey AS label, p_partkey % 3 = 0 OR p_size % 10 = 0 AS needs FROM part WHERE p_partkey % 11 > 0),
      n AS (SELECT label, needs, p_partkey + i AS k FROM e, (VALUES (0), (1)) v(i))
      SELECT 'L' || p_partkey AS label, 'missing_entry' AS issue, NULL::VARCHAR AS name FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT label, 'locator', NULL FROM e WHERE p_size % 7 = 0 UNION ALL SELECT label, 'review', NULL FROM e WHERE p_size % 5 = 0
      UNION ALL SELECT label, 'qualifiers', NULL FROM e WHERE p_size % 6 = 0 UNION ALL SELECT label, 'not_approved', NULL FROM e WHERE p_size % 4 = 0 UNION ALL SELECT label, 'notes_needed', NULL FROM e WHERE needs AND p_size % 3 = 0
      UNION ALL SELECT label, 'missing_declaration', 'd' || k FROM n WHERE k % 13 = 0 OR k NOT IN (SELECT p_partkey FROM part)
      UNION ALL SELECT label, 'comment_notes', 'd' || k FROM n JOIN part p ON p.p_partkey = k WHERE needs AND k % 13 > 0 AND k % 2 = 0 AND p.p_size % 2 > 0""",
    "f7_route_features": """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'atom:foo.bar_' || p_size || '|' || array_to_string(list_sort(CASE WHEN p_size < 10 THEN ['constant:' || p_size] ELSE ['constant:' || p_size, 'constant:' || p_size % 10] END), '|') || '|decomposition|induction|modular-arithmetic' WHEN 1 THEN CASE WHEN p_partkey >= 10 THEN 'constant:' || substr(p_partkey::VARCHAR, 2) || '|' ELSE '' END || 'library-search' WHEN 2 THEN 'finite-enumeration|inequality|number-theory' ELSE 'atom:$job' END AS features,
      CASE p_partkey % 5 WHEN 0 THEN 'foo.bar_' || p_size WHEN 1 THEN 'h_' || p_partkey || '|x2' WHEN 2 THEN 'n|theta' ELSE '' END AS symbols FROM part WHERE p_partkey % 5 < 4""",
    "g13_mechanisms": """WITH h AS (SELECT p_partkey AS id, p_partkey - p_partkey % 8 AS parent, CASE WHEN p_partkey % 8 < 5 THEN 'dependencies' ELSE 'body' END AS basis, p_partkey % 3 AS m FROM part WHERE p_partkey % 8 > 0)
      SELECT id, parent, basis, min(id) OVER (PARTITION BY basis, m) AS first FROM h WHERE parent IN (SELECT p_partkey FROM part)""",
    "p23_admission": """SELECT p_partkey AS id, p_partkey % 10 NOT IN (0, 7) AS admitted, CASE WHEN p_partkey % 10 IN (0, 7) THEN 'closed_instance' END AS reason, CASE WHEN p_partkey % 10 IN (0, 7) THEN 'n' END AS parameter,
      CASE WHEN p_partkey % 10 IN (0, 7) THEN p_size::VARCHAR END AS literal, p_partkey % 10 <> 1 AS reducing FROM part""",
    "j27_conditional_helpers": """WITH c AS (SELECT p.p_partkey AS id, p.p_partkey % 4 AS m, p.p_size, g.p_size AS of FROM part p JOIN part g ON g.p_partkey = p.p_partkey - p.p_partkey % 4 WHERE p.p_partkey % 4 > 0 AND p.p_partkey > 4 AND p.p_size % 11 > 0 AND g.p_size % 3 > 0),
      k AS (SELECT c.id, '∀ y, Q y ' || (id + 4) AS o, q.p_partkey IS NOT NULL AS met FROM c LEFT JOIN part q ON q.p_partkey = c.id + 4 AND q.p_size % 13 = 0 AND q.p_size % 11 > 0 WHERE m = 1)
      SELECT id, o AS obligations, o AS unresolved, false AS wrapper FROM k WHERE NOT met UNION ALL SELECT id, 'P x → False', 'P x → False', false FROM c WHERE m = 2 AND of % 2 > 0""",
}
QUERIES = {q.__name__: q for q in (s4_tex_blocks, s4_tex_sections, j29_but_for_binders, t5_covered, j19_universal_obstructions, j19_dominated_jobs, p23_admission, j27_conditional_helpers, a23_finite_cases, k10_extraction_candidates, j25_inventory_issues, f7_route_features, g13_mechanisms)}
