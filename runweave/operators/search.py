"""Operators over search results: normalising, filtering, merging, ranking and diversifying them.

results: request_id, query_index, provider_index, result_index, query, provider, kind, title, url, snippet, doi, arxiv_id, year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("query_index", "provider_index", "result_index")
#: Words of a query that say nothing (fixed values).
STOP_WORDS = ("a", "an", "and", "for", "from", "in", "is", "of", "on", "or", "the", "to", "with")
#: Query parameters that only track, besides those that begin with utm_ (fixed values).
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source")
#: Words of queries that speak for a kind of result (fixed values).
KIND_WORDS = {"code": (".lean", ".v", " code", "lemma", "theorem"), "paper": ("paper", "article", "arxiv", "doi", "formal proof", "literature"), "web": ("docs", "documentation", "install", "latest", "release", "api")}
SCHEMA = ("provider", "kind", "title", "url", "snippet", "doi", "arxiv_id", "authors", "year")


def normalize_results(raw: DataFrame) -> DataFrame:
    """raw (id, provider, payload JSON) of crossref, scholar and web services in one schema: id and SCHEMA.

    Authors are joined by '; '. A payload that is no JSON object gives nulls.
    """
    of = lambda path: F.get_json_object("payload", path)
    year = lambda c: c.try_cast("int")
    crossref = F.from_json("payload", "author array<struct<given:string,family:string>>")["author"]
    scholar = F.from_json("payload", "authors array<struct<name:string>>")["authors"]
    people = lambda a, name: F.when(a.isNotNull(), F.array_join(F.transform(a, name), "; "))
    full = lambda p: F.trim(F.concat_ws(" ", p["given"], p["family"]))
    by = {
        "crossref": ("paper", of("$.title[0]"), of("$.URL"), of("$.abstract"), F.lower(of("$.DOI")), F.lit(None), people(crossref, full), year(of("$.issued.date-parts[0][0]"))),
        "scholar": ("paper", of("$.title"), of("$.url"), of("$.abstract"), F.lower(of("$.externalIds.DOI")), of("$.externalIds.ArXiv"), people(scholar, lambda p: p["name"]), year(of("$.year"))),
        "web": ("web", of("$.title"), of("$.href"), of("$.body"), F.lit(None), F.lit(None), F.lit(None), F.lit(None)),
    }
    kinds = ("string",) * 7 + ("int",)
    columns = []
    for i, name in enumerate(SCHEMA[1:]):
        out = F.lit(None).cast(kinds[i])
        for provider, values in by.items():
            value = F.lit(values[i]) if isinstance(values[i], str) else values[i]
            out = F.when(F.col("provider") == provider, value.cast(kinds[i])).otherwise(out)
        columns.append(out.alias(name))
    return raw.select("id", "provider", *columns)


def relevant(results: DataFrame, terms: Column, most: int = 8) -> DataFrame:
    """Results whose title, url or snippet has at least two (of one: one) of the terms (array<string>, the first `most`); all without terms."""
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("snippet", F.lit(""))))
    asked = F.slice(terms, 1, most)
    return results.where((F.size(asked) == 0) | (F.size(F.filter(asked, lambda t: F.contains(hay, t))) >= F.least(F.lit(2), F.size(asked))))


def query_terms(query: Column, noise: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct lower-case terms of a query of two characters or more that are no noise, in their order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(query), F.lit(r"([a-z0-9_.+-]+)"), 1), lambda t: (F.length(t) > 1) & ~t.isin(*noise)))


def arxiv_id(value: Column) -> Column:
    """A preprint id without .pdf and version; '' for null."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"\.pdf$", ""), r"v\d+$", "")


def canonical_key(results: DataFrame) -> Column:
    """arxiv:id, else doi:id, else the address without tracking parameters and fragment, else text of provider, title, snippet."""
    given, doi = arxiv_id(F.col("arxiv_id")), F.regexp_replace(F.lower(F.trim(F.coalesce("doi", F.lit("")))), r"^(?:https://doi\.org/)?(?:doi:)?", "")
    url = F.trim(F.coalesce("url", F.lit("")))
    part = lambda i: F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", i)
    scheme, host, path = F.lower(part(1)), F.lower(part(2)), part(3)
    query = F.array_join(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).startswith("utm_") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING)), "&")
    bare = F.regexp_replace(path, r"/+$", "")
    address = F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host, F.when(bare == "", "/").otherwise(bare), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    preprint = F.when(host.isin("arxiv.org", "export.arxiv.org"), arxiv_id(F.regexp_extract(path, r"^/(?:abs|pdf)/([^/?#]+)$", 1))).otherwise("")
    text = F.concat(F.lit("text:"), F.lower(F.concat_ws("|", *(F.trim(F.coalesce(c, F.lit(""))) for c in ("provider", "title", "snippet")))))
    return F.when(given != "", F.concat(F.lit("arxiv:"), given)).when(doi != "", F.concat(F.lit("doi:"), doi)).when(preprint != "", F.concat(F.lit("arxiv:"), preprint)).when(url != "", address).otherwise(text)


def relevance(queries: Column, matched: Column) -> Column:
    """Score of a merged result for the queries (array) of its request; matched: the queries (array) that found it."""
    title, snippet = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("snippet", F.lit("")))

    def of(query: Column) -> Column:
        terms = query_terms(query)
        share = lambda text: F.size(F.filter(terms, lambda t: F.contains(text, t))) / F.size(terms)
        whole = F.trim(F.regexp_replace(F.lower(query), r"\s+", " "))
        phrase = F.when((F.length(whole) >= 6) & F.contains(title, whole), 6.0).when((F.length(whole) >= 6) & F.contains(snippet, whole), 3.0).otherwise(0.0)
        return F.when(F.size(terms) > 0, 6.0 * share(title) + 2.5 * share(snippet) + phrase).otherwise(0.0)

    best = F.greatest(F.lit(0.0), F.array_max(F.transform(queries, of)))
    asked = F.lower(F.array_join(queries, " "))
    boost = F.lit(0.0)
    for kind, words in KIND_WORDS.items():
        boost = F.when((F.lower("kind") == kind) & asked.rlike("|".join(w.replace(".", r"\.") for w in words)), 2.5).otherwise(boost)
    first = F.when(F.array_contains(matched, F.get(queries, F.lit(0))), 0.5).otherwise(0.0)
    return best + boost + first - 0.08 * F.col("result_index") - 0.01 * F.col("provider_index")


def merge_results(results: DataFrame, requests: DataFrame) -> DataFrame:
    """One row for each request and canonical key, ranked by score: request_id, rank, key, provider, kind, title, url, snippet, doi, year, matched, providers, score.

    requests: request_id, queries (array). The first result in ORDER gives the fields, the longest snippet wins, doi and
    year are filled from the first that has them; matched and providers are distinct, in order.
    """
    at = F.struct(*ORDER)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    firsts = [F.min_by(c, at).alias(c) for c in ("provider", "kind", "title", "url", "provider_index", "result_index")]
    fills = [F.min_by(c, F.when(~blank(c), at)).alias(c) for c in ("doi", "year")]
    size = F.struct(F.length(F.coalesce("snippet", F.lit(""))), *(-F.col(c) for c in ORDER))
    ordered = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, F.col(c).alias("v")))), lambda x: x["v"])).alias(f"all_{c}")
    merged = results.withColumn("key", canonical_key(results)).groupBy("request_id", "key").agg(*firsts, *fills, F.max_by("snippet", size).alias("snippet"), ordered("query"), ordered("provider"))
    rows = merged.join(requests, "request_id").withColumn("score", F.round(relevance(F.col("queries"), F.col("all_query")), 6))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "provider_index", "result_index", "key"))
    return rows.select("request_id", rank.alias("rank"), "key", "provider", "kind", "title", "url", "snippet", "doi", "year", F.array_join("all_query", "|").alias("matched"), F.array_join("all_provider", "|").alias("providers"), "score", "provider_index", "result_index")


def diversify(ranked: DataFrame, k: int, provider_cost: float = 1.25, domain_cost: float = 0.75) -> DataFrame:
    """request_id, position, key: the k results chosen one by one, each by its score less a cost for every chosen one of its provider and domain.

    ranked: as merge_results() gives. Choosing is sequential, so a request is one group; rows that no choice can reach
    (their score lies more than all possible costs below the k-th best) are left out first, exactly.
    """
    domain = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    rows = ranked.select("request_id", "rank", "key", F.coalesce("provider", F.lit("")).alias("provider"), domain.alias("domain"), "score", "provider_index", "result_index")
    last = rows.where(F.col("rank") <= k).groupBy("request_id").agg(F.min("score").alias("least"))
    near = rows.join(last, "request_id").where(F.col("score") >= F.col("least") - (provider_cost + domain_cost) * (k - 1)).drop("least")
    kind = ranked.schema["request_id"].dataType.simpleString()

    def choose(frame):
        import pandas as pd

        left = frame.sort_values("rank").to_dict("records")
        seen: dict = {}
        out = []
        while left and len(out) < k:
            cost = lambda r: provider_cost * seen.get(("p", r["provider"]), 0) + (domain_cost * seen.get(("d", r["domain"]), 0) if r["domain"] else 0.0)
            best = max(range(len(left)), key=lambda i: (left[i]["score"] - cost(left[i]), -left[i]["provider_index"], -left[i]["result_index"], -i))
            row = left.pop(best)
            for key in (("p", row["provider"]), ("d", row["domain"])):
                seen[key] = seen.get(key, 0) + 1
            out.append((row["request_id"], len(out) + 1, row["key"]))
        return pd.DataFrame(out, columns=["request_id", "position", "key"])

    return near.groupBy("request_id").applyInPandas(choose, f"request_id {kind}, position int, key string")


def filter_results(results: DataFrame, *predicates: Column) -> DataFrame:
    """Results for which all predicates hold; a predicate that is null does not hold."""
    for predicate in predicates:
        results = results.where(predicate)
    return results


def provider_status(calls: DataFrame) -> DataFrame:
    """provider, queries, results, max_latency_ms, errors (distinct, as first seen, ' | '-joined), status.

    calls: seq, provider, results, duration_ms, error (null or '' for none).
    """
    failed = F.coalesce("error", F.lit("")) != ""
    first = calls.where(failed).groupBy("provider", "error").agg(F.min("seq").alias("seq"))
    errors = first.groupBy("provider").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "error"))), lambda x: x["error"]), " | ").alias("errors"))
    rolled = calls.groupBy("provider").agg(F.count("*").alias("queries"), F.sum("results").alias("results"), F.max("duration_ms").alias("max_latency_ms"))
    joined = rolled.join(errors, "provider", "left")
    status = F.when((F.col("results") > 0) & F.col("errors").isNotNull(), "degraded").when(F.col("results") > 0, "ok").when(F.col("errors").isNotNull(), "error").otherwise("empty")
    return joined.select("provider", "queries", "results", "max_latency_ms", F.coalesce("errors", F.lit("")).alias("errors"), status.alias("status"))


def distinct_queries(queries: DataFrame, cap: int = 4) -> DataFrame:
    """request_id, place, query: stripped non-empty queries (request_id, seq, query), one of each folded form, the first `cap`."""
    plain = queries.select("request_id", "seq", F.regexp_replace("query", r"^\s+|\s+$", "").alias("query")).where("query <> ''")
    first = plain.groupBy("request_id", F.lower("query").alias("folded")).agg(F.min_by("query", "seq").alias("query"), F.min("seq").alias("seq"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("seq"))
    return first.withColumn("place", place).where(F.col("place") <= cap).select("request_id", "place", "query")
