"""Queries over documents, pages, sessions and dependency graphs, and their oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import messages as m
from ..operators import text as x
from ..sources import tables as s

TERMS = ("that", "the", "and", "in")


def p16_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.chunks(s.table(spark, sf_dir, "documents"), "doc_id", "text", 1000).select("doc_id", "idx", F.md5("chunk").alias("digest"))


BOOKS = "SELECT p_partkey AS doc_id, p_name || chr(10) || ' ' || (p_size % 5) || '.' || (p_size % 3) || '  Title of ' || p_type || chr(10) || upper(p_type) || ' ' || chr(10) || '1. no' || chr(10) || CASE WHEN p_size % 2 = 0 THEN 'A' ELSE '7 Seven ways' END AS text FROM {part}"


def s5_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.sections(s.derived(spark, sf_dir, BOOKS))


def p6_threat_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.threat_scan(s.table(spark, sf_dir, "documents"))


def a12_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.verdicts(x.threat_scan(s.table(spark, sf_dir, "documents")))


def p5_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "documents").select("doc_id", F.md5(x.redact_assignments(F.col("text"))).alias("digest"))


def p20_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = x.lines(s.table(spark, sf_dir, "documents"), "doc_id", "text").where(F.col("content").rlike("(?i)secret|token|licen[cs]e"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


def f5_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "pages").select("page_id", x.canonical_url(F.col("url")).alias("key"))


def k6_merge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.merge_results(s.table(spark, sf_dir, "pages"))


def s6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "pages").select("page_id", F.md5(x.page_text(F.col("html"))).alias("digest"))


def s7_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.page_links(s.table(spark, sf_dir, "pages"))


def p2_exclude_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.exclude_labels(s.table(spark, sf_dir, "documents"), s.table(spark, sf_dir, "benchmark"))


def a5_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.duplicates(s.table(spark, sf_dir, "documents"))


def j1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.search(s.messages(spark, sf_dir), TERMS, 20)


#: Searches of one registered query: text, sources, roles.
SEARCHES = (("the NOT that", (), ("user",)), ('"of the" OR thin*', (), ()), ("and the", ("source-1", "source-2"), ()), ("que OR \"la le\" NOT und", ("source-0",), ("assistant",)))


def j1_full_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second ten hits of each of SEARCHES, with their neighbours; the positional index is written once."""
    rows = s.messages(spark, sf_dir)
    sessions = rows.select(F.col("session_id").alias("id"), F.concat(F.lit("source-"), F.col("session_id") % 3).alias("source")).distinct()
    terms = s.cut(m.index(rows).repartitionByRange("term").sortWithinPartitions("term"))
    sizes = m.corpus_size(terms)
    found = [m.search(rows, terms, m.query_of(text), sizes, sessions, sources, roles, 10, 10).withColumn("query", F.lit(text)) for text, sources, roles in SEARCHES]
    return reduce(DataFrame.unionByName, found).select("query", "id", "session_id", "score", "before", "after", F.contains("snippet", F.lit(">>>")).alias("marked"))


def j2_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.with_context(s.messages(spark, sf_dir), F.col("content").contains("that"))


def a18_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.messages(spark, sf_dir).groupBy("role").agg(F.count("*").alias("messages"), F.count_distinct("session_id").alias("sessions"))


def a1_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.nodes(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def g1_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.levels(s.nodes(spark, sf_dir), s.edges(spark, sf_dir))


def g2_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.reach(s.edges(spark, sf_dir)).groupBy("dst").agg(F.count("*").alias("downstream"))


def g3_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.frontier(s.nodes(spark, sf_dir), s.edges(spark, sf_dir))


def g4_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.dependents(s.edges(spark, sf_dir), s.nodes(spark, sf_dir).where("status = 'false'"))


ITEMS = "SELECT p_size % 3 AS book, p_partkey AS ordinal, p_partkey AS label, CASE WHEN p_size % 3 = 0 THEN 7 ELSE CAST(floor(p_partkey / 20) AS BIGINT) % 4 END AS chapter FROM {part}"


def w4_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.batches(s.derived(spark, sf_dir, ITEMS))


def a3_concept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.concept_index(s.item_concepts(spark, sf_dir)).withColumn("labels", F.md5(F.array_join(F.transform("labels", lambda v: v.cast("string")), ",")))


def a12_bundle_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trust = F.element_at(F.array(*map(F.lit, ("builtin", "trusted", "community", "agent-created", "other"))), (F.col("doc_id") % 5 + 1).cast("int"))
    docs = s.table(spark, sf_dir, "documents")
    return x.bundle_verdicts(docs.select("doc_id", trust.alias("trust")), x.threat_scan(docs))


def j13_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = s.activity(spark, sf_dir)
    witnesses = log.where("type = 'api-request'").select(F.col("run_id").alias("scope"), F.col("event_id").alias("at"), F.col("k").alias("witness"))
    classes = log.where("type = 'tool-result'").select(F.col("run_id").alias("scope"), F.col("event_id").alias("at"), (F.col("cents") % 7 + 20).cast("int").alias("modulus"), (F.col("k") % (F.col("cents") % 7 + 20)).cast("int").alias("residue"))
    return g.coverage(witnesses, classes, tuple(range(20, 27)))


def _threats() -> str:
    parts = []
    for i, sev, cat, p in x.THREATS:
        quoted = p.replace("'", "''")
        parts.append(f"SELECT doc_id, line, '{i}' AS pattern_id, '{sev}' AS severity, '{cat}' AS category, substr(regexp_extract(content, '{quoted}'), 1, 120) AS match FROM l WHERE regexp_matches(content, '{quoted}')")
    return " UNION ALL ".join(parts)


def _page() -> str:
    out = "html"
    for tag in ("script", "style", "head"):
        out = rf"regexp_replace({out}, '(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>', '', 'g')"
    for pattern, becomes in (("(?i)<(?:br|p|div|li|h[1-6]|tr)(?:[ /][^>]*)?>", "chr(10)"), ("<[^>]*>", "''"), (r"[ \t]+", "' '"), (r"[ \r\n]*\n[ \r\n]*", "chr(10)")):
        out = f"regexp_replace({out}, '{pattern}', {becomes}, 'g')"
    for entity, becomes in x.ENTITIES:
        out = f"replace({out}, '{entity}', chr({ord(becomes)}))"
    return out


LINES = r"l AS (SELECT doc_id, unnest(range(1, len(p) + 1))::INT AS line, unnest(p) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"
MESSAGES = "m AS (SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, turn AS pos, role, text AS content FROM conversations)"
NODES = """n AS (SELECT p_partkey AS id, CASE p_size % 5 WHEN 1 THEN 'stated' WHEN 3 THEN 'audited' WHEN 4 THEN 'false' ELSE 'proved' END AS status FROM part),
e AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, unnest([p_partkey // 2, p_partkey // 3]) AS dst FROM part) WHERE dst >= 1 AND dst < src)"""
URL = rf"""u AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(?:{x.TRACKING})=[^&]*', '\1', 'g'), '&+', '&', 'g'), '\?&', '?', 'g'), '[?&/]+$', '') AS bare FROM pages),
c AS (SELECT *, lower(regexp_extract(bare, '^([A-Za-z]+://[^/?]+)', 1)) || substr(bare, length(regexp_extract(bare, '^([A-Za-z]+://[^/?]+)', 1)) + 1) AS key FROM u)"""
CONCEPTS = r"i AS (SELECT DISTINCT p_partkey AS label, p_brand AS chapter, unnest(regexp_split_to_array(lower(p_name || ' ' || p_type), '\s+')) AS concept FROM part)"
ROOTS = "WITH RECURSIVE s AS (SELECT DISTINCT conv_id AS id, CASE WHEN conv_id % 3 = 0 AND conv_id > 0 THEN conv_id // 2 END AS parent FROM conversations), r AS (SELECT id, id AS at FROM s UNION SELECT r.id, s.parent AS at FROM r JOIN s ON s.id = r.at WHERE s.parent IS NOT NULL) SELECT r.id, r.at AS root FROM r LEFT JOIN s ON s.id = r.at WHERE s.parent IS NULL"
_terms = ", ".join(f"'{t}'" for t in TERMS)
ORACLES = {
    "p16_chunks": "WITH c AS (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT)))::INT AS idx FROM documents WHERE length(text) > 0) SELECT doc_id, idx, md5(substr(text, idx * 1000 + 1, 1000)) AS digest FROM c",
    "s5_sections": f"WITH {LINES.replace('FROM documents', f'FROM ({s.plain(BOOKS)})')}, r AS (SELECT doc_id, line, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS title FROM l) SELECT doc_id, line, title FROM r WHERE regexp_matches(title, '{x.HEADING.replace(chr(39), chr(39) * 2)}')",
    "p6_threat_scan": f"WITH {LINES} {_threats()}",
    "a12_verdicts": f"WITH {LINES}, f AS ({_threats()}) SELECT doc_id, count(*) AS findings, CASE WHEN bool_or(severity = 'critical') THEN 'dangerous' ELSE 'caution' END AS verdict FROM f GROUP BY doc_id",
    "p5_redact": r"SELECT doc_id, md5(regexp_replace(text, '(?i)((?:token|secret|password|api_key)[ ]*[=:][ ]*)([^ \t\r\n]+)', '\1***', 'g')) AS digest FROM documents",
    "a12_bundle_verdicts": f"""WITH {LINES}, f AS ({_threats()}), g AS (SELECT doc_id, count(*) AS n, bool_or(severity = 'critical') AS critical, string_agg(DISTINCT category, ', ' ORDER BY category) AS categories FROM f GROUP BY doc_id), v AS (SELECT d.doc_id, CASE WHEN n IS NULL THEN 'safe' WHEN critical THEN 'dangerous' ELSE 'caution' END AS verdict, coalesce(n, 0) AS findings, coalesce(categories, '') AS categories FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id)
      SELECT *, CASE WHEN verdict = 'safe' OR doc_id % 5 = 0 OR doc_id % 5 = 1 AND verdict = 'caution' THEN 'allow' ELSE 'block' END AS decision FROM v""",
    "p20_grep": f"WITH {LINES} SELECT doc_id, count(*) AS n, min(line) AS first_line FROM l WHERE regexp_matches(content, '(?i)secret|token|licen[cs]e') GROUP BY doc_id",
    "f5_canonical_url": f"WITH {URL} SELECT page_id, key FROM c",
    "k6_merge_results": f"WITH {URL} SELECT key, min(page_id) AS page_id, count(*) AS merged, max(length(html)) AS longest FROM c GROUP BY key",
    "s6_page_text": f"SELECT page_id, md5({_page()}) AS digest FROM pages",
    "s7_page_links": r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1) AS a FROM pages) SELECT page_id, unnest(range(0, len(a)))::INT AS pos, unnest(a) AS href FROM h""",
    "p2_exclude_labels": "WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS c FROM documents), b AS (SELECT item_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS l FROM benchmark) SELECT DISTINCT doc_id, item_id FROM d JOIN b ON l <> '' AND contains(c, l)",
    "a5_duplicates": "SELECT md5(text) AS digest, count(*) AS n, count(DISTINCT source) AS sources, min(doc_id) AS first FROM documents GROUP BY md5(text) HAVING count(*) > 1 AND count(DISTINCT source) >= 2",
    "j1_search": rf"""WITH {MESSAGES}, w AS (SELECT id, session_id, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM m), z AS (SELECT id, session_id, len(w) AS len, w FROM w),
      st AS (SELECT count(*) AS n, avg(len) AS avg FROM z), h AS (SELECT id, session_id, len, term, count(*) AS tf FROM (SELECT id, session_id, len, unnest(w) AS term FROM z) WHERE term IN ({_terms}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM h GROUP BY term)
      SELECT id, session_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg))), 6) AS score FROM h JOIN df USING (term), st GROUP BY id, session_id ORDER BY score DESC, id LIMIT 20""",
    "j1_full_search": f"""WITH {MESSAGES}, w AS (SELECT m.*, list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS w FROM m),
      z AS (SELECT *, len(w) AS len, 'source-' || (session_id % 3) AS source FROM w WHERE len(w) > 0), st AS (SELECT count(*) AS n, avg(len) AS avg FROM z),
      q AS (SELECT * FROM (VALUES ('the NOT that'), ('"of the" OR thin*'), ('and the'), ('que OR "la le" NOT und')) v(query)),
      l AS (SELECT z.id, query, CASE query WHEN 'the NOT that' THEN len(list_filter(w, lambda t: t = 'the')) WHEN '"of the" OR thin*' THEN len(list_filter(w, lambda t, i: t = 'of' AND w[i + 1] = 'the')) WHEN 'and the' THEN len(list_filter(w, lambda t: t = 'and')) ELSE len(list_filter(w, lambda t: t = 'que')) END AS a,
        CASE query WHEN 'the NOT that' THEN 0 WHEN '"of the" OR thin*' THEN len(list_filter(w, lambda t: starts_with(t, 'thin'))) WHEN 'and the' THEN len(list_filter(w, lambda t: t = 'the')) ELSE len(list_filter(w, lambda t, i: t = 'la' AND w[i + 1] = 'le')) END AS b,
        CASE query WHEN 'the NOT that' THEN list_contains(w, 'that') ELSE list_contains(w, 'und') END AS c FROM z, q),
      d AS (SELECT query, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM l GROUP BY query),
      p AS (SELECT l.query, z.id, z.session_id, z.role, source, a, b, c, len, avg, greatest(1e-6::DOUBLE, ln((n - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE))) AS ia, greatest(1e-6::DOUBLE, ln((n - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE))) AS ib FROM l JOIN d USING (query) JOIN z ON z.id = l.id, st),
      r AS (SELECT query, id, session_id, round(ia * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg)) + ib * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg)), 6) AS score FROM p
        WHERE CASE query WHEN 'the NOT that' THEN a > 0 AND NOT c AND role = 'user' WHEN '"of the" OR thin*' THEN a > 0 OR b > 0 WHEN 'and the' THEN a > 0 AND b > 0 AND source <> 'source-0' ELSE (a > 0 OR b > 0 AND NOT c) AND source = 'source-0' AND role = 'assistant' END),
      k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) BETWEEN 11 AND 20)
      SELECT k.*, substr(x.content, 1, 200) AS before, substr(y.content, 1, 200) AS after, true AS marked FROM k LEFT JOIN m x ON x.id = k.id - 1 AND x.session_id = k.session_id LEFT JOIN m y ON y.id = k.id + 1 AND y.session_id = k.session_id""",
    "j2_context": f"WITH {MESSAGES} SELECT m.id, substr(p.content, 1, 200) AS before, substr(n.content, 1, 200) AS after FROM m LEFT JOIN m p ON p.id = m.id - 1 AND p.session_id = m.session_id LEFT JOIN m n ON n.id = m.id + 1 AND n.session_id = m.session_id WHERE contains(m.content, 'that')",
    "a18_counts": "SELECT role, count(*) AS messages, count(DISTINCT conv_id) AS sessions FROM conversations GROUP BY role",
    "a1_status_counts": f"WITH {NODES} SELECT status, count(*) AS n FROM n GROUP BY status",
    "g1_levels": f"WITH RECURSIVE {NODES}, r AS (SELECT id, 0 AS level FROM n UNION SELECT e.src AS id, r.level + 1 AS level FROM r JOIN e ON e.dst = r.id) SELECT id, max(level) AS level FROM r GROUP BY id",
    "g2_reach": f"WITH RECURSIVE {NODES}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT dst, count(*) AS downstream FROM r GROUP BY dst",
    "g3_frontier": f"WITH {NODES} SELECT id, status FROM n WHERE status IN ('stated', 'audited') AND NOT EXISTS (SELECT 1 FROM e LEFT JOIN n d ON d.id = e.dst WHERE e.src = n.id AND coalesce(d.status, '') <> 'proved')",
    "g4_invalid": f"WITH RECURSIVE {NODES}, r AS (SELECT src AS id FROM e JOIN n ON n.id = e.dst WHERE n.status = 'false' UNION SELECT e.src AS id FROM r JOIN e ON e.dst = r.id) SELECT DISTINCT id FROM r",
    "w4_batches": f"""WITH i AS ({s.plain(ITEMS)}), t AS (SELECT *, CASE WHEN chapter IS NOT DISTINCT FROM lag(chapter) OVER w AND lag(ordinal) OVER w IS NOT NULL THEN 0 ELSE 1 END AS turn FROM i WINDOW w AS (PARTITION BY book ORDER BY ordinal)), l AS (SELECT *, sum(turn) OVER (PARTITION BY book ORDER BY ordinal) AS island FROM t),
      p AS (SELECT *, (row_number() OVER (PARTITION BY book, island ORDER BY ordinal) - 1) // 24 AS part FROM l) SELECT book, label, 'chapter-' || chapter || '-batch-' || dense_rank() OVER (PARTITION BY book, chapter ORDER BY island, part) AS batch FROM p""",
    "a3_concept_index": f"WITH {CONCEPTS} SELECT concept, count(DISTINCT label) AS frequency, count(DISTINCT chapter) AS chapters, md5(array_to_string(list_sort(list(DISTINCT label)), ',')) AS labels, count(DISTINCT label) > 1 AS shared FROM i WHERE concept <> '' GROUP BY concept",
    "j13_coverage": r"""WITH a AS (SELECT event_id, user_id % 20 AS run_id, event_type, regexp_extract(props, '(\d+)', 1)::INT AS k, CAST(round(value * 100) AS BIGINT) % 7 + 20 AS modulus FROM events)
      SELECT run_id AS scope, event_id AS at, k AS witness, EXISTS (SELECT 1 FROM a c WHERE c.event_type = 'error' AND c.run_id = a.run_id AND c.event_id < a.event_id AND a.k % c.modulus = c.k % c.modulus) AS covered FROM a WHERE event_type = 'view'""",
}
QUERIES = {f.__name__: f for f in (p16_chunks, s5_sections, p6_threat_scan, a12_verdicts, p5_redact, p20_grep, f5_canonical_url, k6_merge_results, s6_page_text, s7_page_links, p2_exclude_labels, a5_duplicates, j1_search, j1_full_search, j2_context, a18_counts, a1_status_counts, g1_levels, g2_reach, g3_frontier, g4_invalid, w4_batches, a3_concept_index, a12_bundle_verdicts, j13_coverage)}
