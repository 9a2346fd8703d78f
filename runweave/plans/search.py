"""Queries over search results that the given tables stand for, and their oracles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as o
from ..sources import tables as s

ASKED = ("lattice reduction docs", "the convex hull theorem", "release of an api paper")
RESULTS = """SELECT user_id % 20 AS request_id, event_id % 3 AS query_index, event_id % 4 AS provider_index, CAST(floor(event_id / 12) AS BIGINT) AS result_index, CASE event_id % 3 WHEN 0 THEN 'lattice reduction docs' WHEN 1 THEN 'the convex hull theorem' ELSE 'release of an api paper' END AS query,
 'p' || (event_id % 4) AS provider, CASE user_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'code' ELSE 'paper' END AS kind, CASE event_id % 7 WHEN 0 THEN 'A Convex Hull Theorem' WHEN 1 THEN 'On lattice reduction' WHEN 2 THEN 'Release notes of the API' ELSE event_type END || ' ' || (event_id % 5) AS title,
 CASE event_id % 6 WHEN 0 THEN 'https://arxiv.org/abs/2501.0' || (user_id % 9) || 'v' || (event_id % 3 + 1) WHEN 1 THEN 'https://export.arxiv.org/pdf/2501.0' || (user_id % 9) || '.pdf' WHEN 2 THEN 'HTTPS://Example.com/p' || (user_id % 5) || '//?utm_source=x&a=' || (event_id % 2) || '&Ref=9#top' WHEN 3 THEN 'http://h' || (event_id % 4) || '.org' WHEN 4 THEN '' ELSE 'https://d.net/' || (event_id % 40) END AS url,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'a hull of ' || event_type || ' in lattice reduction docs ' || substr('xxxxxxxxxxxxx', 1, CAST(event_id % 13 AS INT)) END AS snippet, CASE WHEN event_id % 11 = 0 THEN 'https://doi.org/10.1/A' || (user_id % 6) WHEN event_id % 11 = 1 THEN 'doi:10.1/a' || (user_id % 6) END AS doi,
 CASE WHEN event_id % 17 = 0 THEN ' 2501.0' || (user_id % 9) || 'v3' END AS arxiv_id, CASE WHEN event_id % 4 = 0 THEN 2000 + event_id % 25 END AS year FROM {events}"""
RAW = """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'crossref' WHEN 1 THEN 'scholar' WHEN 2 THEN 'web' ELSE 'other' END AS provider, CASE p_partkey % 4
 WHEN 0 THEN '{{"title":["' || p_name || '"],"URL":"http://x/' || p_partkey || '","DOI":"10.1/ABC' || p_partkey || '","author":[{{"given":"Ann","family":"' || p_brand || '"}},{{"family":"Solo"}}],"issued":{{"date-parts":[[' || (1990 + p_size) || ',1]]}}}}'
 WHEN 1 THEN '{{"title":"' || p_name || '","url":"http://s/' || p_partkey || '","abstract":"' || p_type || '","externalIds":{{"ArXiv":"2501.' || p_size || '"}},"authors":[{{"name":"A ' || p_brand || '"}},{{"name":"B"}}],"year":' || (1990 + p_size) || '}}'
 WHEN 2 THEN '{{"title":"' || p_name || '","href":"http://w/' || p_partkey || '","body":"' || p_type || '"}}' ELSE 'no json' END AS payload FROM {part}"""
CALLS = "SELECT event_id AS seq, 'p' || (user_id % 30) AS provider, CASE WHEN user_id % 4 = 0 THEN 0 ELSE event_id % 5 END AS results, event_id % 977 AS duration_ms, CASE WHEN user_id % 3 > 0 AND event_id % 9 = 0 THEN 'error ' || (event_id % 4) ELSE '' END AS error FROM {events}"
QUERIES_OF = "SELECT user_id % 40 AS request_id, event_id AS seq, CASE event_id % 4 WHEN 0 THEN '  Hull ' || (event_id % 6) WHEN 1 THEN 'hull ' || (event_id % 6) || ' ' WHEN 2 THEN ' ' ELSE 'Convex ' || (user_id % 9) END AS query FROM {events}"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.derived(spark, sf_dir, RESULTS)


def _requests(found: DataFrame) -> DataFrame:
    return found.select("request_id").distinct().withColumn("queries", F.array(*map(F.lit, ASKED)))


def s13_normalize_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.normalize_results(s.derived(spark, sf_dir, RAW))


def p1_filter_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = o.filter_results(results(spark, sf_dir), F.col("url") != "", F.col("year") > 2005, F.col("kind").isin("web", "paper"))
    return found.groupBy("request_id", "provider").agg(F.count("*").alias("n"))


def p4_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.when(F.col("request_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("request_id") % 5 == 1, F.array(F.lit("theorem"))).otherwise(o.query_terms(F.lit("the lattice hull 2501 api")))
    return o.relevant(results(spark, sf_dir), terms).groupBy("request_id").agg(F.count("*").alias("n"), F.sum("result_index").alias("places"))


def f5_canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = results(spark, sf_dir)
    return found.groupBy(o.canonical_key(found).alias("key")).agg(F.count("*").alias("n"))


def k6_merge_and_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = results(spark, sf_dir)
    return o.merge_results(found, _requests(found)).drop("provider_index", "result_index")


def k7_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = results(spark, sf_dir)
    return o.diversify(o.merge_results(found, _requests(found)), 8)


def a2_provider_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.provider_status(s.derived(spark, sf_dir, CALLS))


def u1_distinct_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.distinct_queries(s.derived(spark, sf_dir, QUERIES_OF))


def _arxiv(value: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim(coalesce({value}, ''))), '\\.pdf$', ''), 'v\\d+$', '')"


_KEYED = f"""r AS ({s.plain(RESULTS)}), u AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS sch, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q,
 {_arxiv('arxiv_id')} AS ax, regexp_replace(replace(lower(coalesce(doi, '')), 'https://doi.org/', ''), '^doi:', '') AS d FROM r),
 k AS (SELECT *, CASE WHEN ax <> '' THEN 'arxiv:' || ax WHEN d <> '' THEN 'doi:' || d WHEN host IN ('arxiv.org', 'export.arxiv.org') AND regexp_matches(path, '^/(abs|pdf)/') THEN 'arxiv:' || {_arxiv("regexp_extract(path, '^/(?:abs|pdf)/(.*)$', 1)")}
  WHEN url <> '' THEN sch || '://' || host || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END || CASE WHEN q <> '' THEN '?' || array_to_string(list_filter(string_split(q, '&'), lambda p: NOT regexp_matches(p, '(?i)^(utm_|ref=)')), '&') ELSE '' END
  ELSE 'text:' || lower(provider || '|' || trim(title) || '|' || coalesce(trim(snippet), '')) END AS key FROM u)"""


def _relevance() -> str:
    best = []
    for query in ASKED:
        terms = [t for t in dict.fromkeys(re.findall(r"[a-z0-9_.+-]+", query)) if len(t) > 1 and t not in o.STOP_WORDS]
        hits = lambda c: "(" + " + ".join(f"contains(lower({c}), '{t}')::INT" for t in terms) + f") / {len(terms)}.0::DOUBLE"  # noqa: B023, E731
        best.append(f"6.0::DOUBLE * {hits('title')} + 2.5::DOUBLE * {hits('snip')} + CASE WHEN contains(lower(title), '{query}') THEN 6.0 WHEN contains(lower(snip), '{query}') THEN 3.0 ELSE 0.0 END::DOUBLE")
    return f"greatest(0.0, {', '.join(best)}) + 2.5::DOUBLE + CASE WHEN list_contains(all_query, '{ASKED[0]}') THEN 0.5 ELSE 0.0 END::DOUBLE - 0.08::DOUBLE * result_index - 0.01::DOUBLE * provider_index"


_ROW = "(query_index, provider_index, result_index)"
ORACLES = {
    "s13_normalize_results": """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'crossref' WHEN 1 THEN 'scholar' WHEN 2 THEN 'web' ELSE 'other' END AS provider, CASE p_partkey % 4 WHEN 0 THEN 'paper' WHEN 1 THEN 'paper' WHEN 2 THEN 'web' END AS kind, CASE WHEN p_partkey % 4 < 3 THEN p_name END AS title,
      CASE p_partkey % 4 WHEN 0 THEN 'http://x/' || p_partkey WHEN 1 THEN 'http://s/' || p_partkey WHEN 2 THEN 'http://w/' || p_partkey END AS url, CASE WHEN p_partkey % 4 IN (1, 2) THEN p_type END AS snippet, CASE WHEN p_partkey % 4 = 0 THEN '10.1/abc' || p_partkey END AS doi, CASE WHEN p_partkey % 4 = 1 THEN '2501.' || p_size END AS arxiv_id,
      CASE p_partkey % 4 WHEN 0 THEN 'Ann ' || p_brand || '; Solo' WHEN 1 THEN 'A ' || p_brand || '; B' END AS authors, CASE WHEN p_partkey % 4 < 2 THEN 1990 + p_size END AS year FROM part""",
    "p1_filter_results": f"WITH r AS ({s.plain(RESULTS)}) SELECT request_id, provider, count(*) AS n FROM r WHERE url <> '' AND year > 2005 AND kind IN ('web', 'paper') GROUP BY ALL",
    "p4_relevant": f"""WITH r AS ({s.plain(RESULTS)}), h AS (SELECT *, lower(title || ' ' || url || ' ' || coalesce(snippet, '')) AS hay FROM r) SELECT request_id, count(*) AS n, sum(result_index)::BIGINT AS places FROM h WHERE request_id % 5 = 0 OR request_id % 5 = 1 AND contains(hay, 'theorem') OR request_id % 5 > 1 AND contains(hay, 'lattice')::INT + contains(hay, 'hull')::INT + contains(hay, '2501')::INT + contains(hay, 'api')::INT >= 2 GROUP BY request_id""",
    "f5_canonical_key": f"WITH {_KEYED} SELECT key, count(*) AS n FROM k GROUP BY key",
    "k6_merge_and_rank": f"""WITH {_KEYED}, qf AS (SELECT request_id, key, query, min({_ROW}) AS f FROM k GROUP BY ALL), pf AS (SELECT request_id, key, provider, min({_ROW}) AS f FROM k GROUP BY ALL), ql AS (SELECT request_id, key, list(query ORDER BY f) AS all_query FROM qf GROUP BY ALL), pl AS (SELECT request_id, key, string_agg(provider, '|' ORDER BY f) AS providers FROM pf GROUP BY ALL),
      g AS (SELECT request_id, key, arg_min(provider, {_ROW}) AS provider, arg_min(kind, {_ROW}) AS kind, arg_min(title, {_ROW}) AS title, arg_min(url, {_ROW}) AS url, arg_min(doi, {_ROW}) FILTER (doi IS NOT NULL) AS doi, arg_min(year, {_ROW}) FILTER (year IS NOT NULL) AS year, min({_ROW}) AS f, arg_min(snippet, (-length(coalesce(snippet, '')), query_index, provider_index, result_index)) FILTER (snippet IS NOT NULL) AS snippet, arg_min(provider_index, {_ROW}) AS provider_index, arg_min(result_index, {_ROW}) AS result_index FROM k GROUP BY ALL),
      j AS (SELECT g.*, coalesce(snippet, '') AS snip, all_query, providers FROM g JOIN ql ON ql.request_id = g.request_id AND ql.key = g.key JOIN pl ON pl.request_id = g.request_id AND pl.key = g.key), z AS (SELECT *, round({_relevance()}, 6) AS score FROM j)
      SELECT request_id, (row_number() OVER (PARTITION BY request_id ORDER BY score DESC, provider_index, result_index, key))::INT AS rank, key, provider, kind, title, url, snippet, doi, year, array_to_string(all_query, '|') AS matched, providers, score FROM z""",
    "a2_provider_roll_up": f"""WITH c AS ({s.plain(CALLS)}), e AS (SELECT provider, error, min(seq) AS seq FROM c WHERE error <> '' GROUP BY ALL), g AS (SELECT provider, string_agg(error, ' | ' ORDER BY seq) AS errors FROM e GROUP BY provider), r AS (SELECT provider, count(*) AS queries, sum(results)::BIGINT AS results, max(duration_ms) AS max_latency_ms FROM c GROUP BY provider)
      SELECT r.*, coalesce(errors, '') AS errors, CASE WHEN results > 0 AND errors IS NOT NULL THEN 'degraded' WHEN results > 0 THEN 'ok' WHEN errors IS NOT NULL THEN 'error' ELSE 'empty' END AS status FROM r LEFT JOIN g ON g.provider = r.provider""",
    "u1_distinct_portfolio": f"WITH q AS ({s.plain(QUERIES_OF)}), g AS (SELECT request_id, lower(trim(query)) AS f, arg_min(trim(query), seq) AS query, min(seq) AS seq FROM q WHERE trim(query) <> '' GROUP BY ALL) SELECT request_id, place::INT AS place, query FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY seq) AS place FROM g) WHERE place <= 4",
}
QUERIES = {q.__name__: q for q in (s13_normalize_results, p1_filter_results, p4_relevant, f5_canonical_key, k6_merge_and_rank, k7_diversify, a2_provider_roll_up, u1_distinct_portfolio)}
