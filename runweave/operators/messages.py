"""Full-text search over messages by a positional index: words, phrases and prefixes, joined by AND, OR and NOT."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word of a text; the pieces that a text falls into, words and what is between.
WORD, PIECES = r"(?U)[\p{L}\p{N}]+", r"(?U)[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
#: Parameters of the ranking, and the least weight of a word that most messages have (fixed values).
K1, B, LEAST = 1.2, 0.75, 1e-6

#: A query: a leaf, which is (words, prefix) with the words of a phrase, or (op, left, right).
Query = tuple


def index(messages: DataFrame) -> DataFrame:
    """id, length, term, positions of every different word (in lower case) of messages (id, content), from 0 on.

    Write it once, sorted by term, and searches read the terms of their query only. Null contents have no words.
    """
    words = F.regexp_extract_all(F.lower("content"), F.lit(WORD), 0)
    each = messages.where("content is not null").select("id", words.alias("words")).select("id", F.size("words").alias("length"), F.posexplode("words").alias("pos", "term"))
    return each.groupBy("id", "length", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def query_of(text: str) -> Query | None:
    """The query that a text says: words next to each other or AND, OR, NOT between, "phrases", prefixes with *.

    NOT binds before AND, AND before OR, each from the left. Other signs are blanks; operators without both sides, and
    quotes without an end, are left out. None if no word is left.
    """
    tokens: list = []
    for quoted, word, star in re.findall(r'"([^"]*)"|(\w+)(\*?)', text):
        words = tuple(re.findall(r"[^\W_]+", (quoted or word).lower()))
        if not quoted and word in ("AND", "OR", "NOT"):
            if tokens and not isinstance(tokens[-1], str):
                tokens.append(word)
        elif words:
            if tokens and not isinstance(tokens[-1], str):
                tokens.append("AND")
            tokens.append((words, bool(star)))
    if tokens and isinstance(tokens[-1], str):
        tokens.pop()
    for op in ("NOT", "AND", "OR"):
        out: list = []
        for token in tokens:
            if len(out) > 1 and out[-1] == op and not isinstance(token, str):
                out[-2:] = [(op, out[-2], token)]
            else:
                out.append(token)
        tokens = out
    return tokens[0] if tokens else None


def _leaves(query: Query) -> list[Query]:
    return _leaves(query[1]) + _leaves(query[2]) if isinstance(query[0], str) else [query]


def _holds(query: Query, met: list[Column], at: list[int]) -> Column:
    """Whether a message meets a query, of which it meets the leaves as `met` says."""
    if not isinstance(query[0], str):
        at[0] += 1
        return met[at[0] - 1]
    left, right = _holds(query[1], met, at), _holds(query[2], met, at)
    return left & right if query[0] == "AND" else left | right if query[0] == "OR" else left & ~right


def _counts(query: Query, wanted: bool = True) -> list[bool]:
    """For each leaf whether it adds to the rank: those under the right side of a NOT do not."""
    if not isinstance(query[0], str):
        return [wanted]
    return _counts(query[1], wanted) + _counts(query[2], wanted and query[0] != "NOT")


def hits(terms: DataFrame, query: Query) -> DataFrame:
    """id, leaf, length, starts, words: where the leaves of a query are in messages; starts: positions of their first words."""
    found = []
    for n, (words, prefix) in enumerate(_leaves(query)):
        of = lambda i, w: F.startswith("term", F.lit(w)) if prefix and i == len(words) - 1 else F.col("term") == w  # noqa: B023, E731
        places = F.filter(F.array(*[F.when(of(i, w), F.lit(i)) for i, w in enumerate(words)]), lambda i: i.isNotNull())
        rows = terms.where(reduce(Column.__or__, [of(i, w) for i, w in enumerate(words)])).withColumn("place", F.explode(places))
        shifted = rows.select("id", "length", "place", F.explode(F.transform("positions", lambda p: p - F.col("place"))).alias("start"))
        starts = shifted.groupBy("id", "length", "start").agg(F.count_distinct("place").alias("n")).where(F.col("n") == len(words))
        met = starts.groupBy("id", "length").agg(F.sort_array(F.collect_list("start")).alias("starts"))
        found.append(met.select("id", F.lit(n).alias("leaf"), "length", "starts", F.lit(len(words)).alias("words")))
    return reduce(DataFrame.unionByName, found)


def search(messages: DataFrame, terms: DataFrame, query: Query, sizes: dict, sessions: DataFrame | None = None, sources: tuple[str, ...] = (), roles: tuple[str, ...] = (), limit: int = 20, offset: int = 0, words: int = 40) -> DataFrame:
    """id, session_id, role, score, snippet, before, after: the messages that meet a query, the best first, paged.

    messages: id, session_id, role, content; terms: their index(); sizes: corpus_size(terms). sources (of sessions: id,
    source) and roles, if any, are the only ones. score: BM25 over the leaves, each a word of its own; ties by id, so
    that pages neither miss nor repeat. snippet: the `words` words from the hit on that has most leaves in reach, hits
    as >>>word<<<, ... where it is cut. before, after: 200 characters of the messages of adjacent id in the session.
    """
    leaves = _leaves(query)
    found = hits(terms, query)
    if not leaves:
        raise ValueError("a query has a leaf at least")
    per = found.groupBy("leaf").agg(F.count("*").alias("df"))
    weight = F.log((F.lit(float(sizes["messages"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.size("starts")
    part = F.when(weight > 0, weight).otherwise(LEAST) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / sizes["average"]))
    counts = F.element_at(F.array(*[F.lit(float(c)) for c in _counts(query)]), F.col("leaf") + 1)
    scored = found.join(F.broadcast(per), "leaf")  # as many rows as the query has leaves
    met = [F.bool_or(F.col("leaf") == i).alias(f"m{i}") for i in range(len(leaves))]
    rows = scored.groupBy("id").agg(F.round(F.sum(part * counts), 6).alias("score"), F.collect_list(F.struct("leaf", "starts", "words")).alias("at"), *met)
    rows = rows.where(_holds(query, [F.col(f"m{i}") for i in range(len(leaves))], [0])).select("id", "score", "at")
    rows = rows.join(messages.select("id", "session_id", "role", "content"), "id")
    if roles:
        rows = rows.where(F.col("role").isin(*roles))
    if sources:
        rows = rows.join(sessions.where(F.col("source").isin(*sources)).select(F.col("id").alias("session_id")), "session_id", "left_semi")
    page = rows.orderBy(F.desc("score"), "id").offset(offset).limit(limit)
    page = page.select("id", "session_id", "role", "score", snippet(F.col("content"), F.col("at"), words).alias("snippet"))
    beside = page.select("session_id", F.explode(F.array(F.col("id") - 1, F.col("id") + 1)).alias("id")).distinct()
    near = messages.join(F.broadcast(beside), ["session_id", "id"], "left_semi").select("session_id", "id", F.substring(F.coalesce("content", F.lit("")), 1, 200).alias("text"))
    of = lambda d, name: near.select("session_id", (F.col("id") - d).alias("id"), F.col("text").alias(name))
    return page.join(of(-1, "before"), ["session_id", "id"], "left").join(of(1, "after"), ["session_id", "id"], "left").select("id", "session_id", "role", "score", "snippet", "before", "after")


def corpus_size(terms: DataFrame) -> dict:
    """{"messages": those with a word, "average": their mean number of words} of an index."""
    row = terms.select("id", "length").distinct().agg(F.count("*").alias("messages"), F.avg("length").alias("average")).first()
    return {"messages": row["messages"], "average": row["average"] or 1.0}


def snippet(content: Column, at: Column, words: int = 40) -> Column:
    """A cut of content around hits at: array of (leaf, starts, words)."""
    pieces = F.regexp_extract_all(content, F.lit(PIECES), 0)
    lead = F.when(F.element_at(pieces, 1).rlike(f"^{WORD}"), 0).otherwise(1)  # pieces before the first word
    total = F.size(F.filter(pieces, lambda p: p.rlike(f"^{WORD}")))
    starts = F.array_sort(F.array_distinct(F.flatten(F.transform(at, lambda a: a["starts"]))))
    reach = lambda s: F.size(F.filter(at, lambda a: F.exists(a["starts"], lambda p: (p >= s) & (p + a["words"] <= s + words))))
    best = F.aggregate(F.transform(starts, lambda s: F.struct(reach(s).alias("n"), (-s).alias("s"))), F.struct(F.lit(-1).alias("n"), F.lit(0).alias("s")), lambda a, b: F.greatest(a, b))
    first = F.greatest(F.lit(0), F.least(-best["s"], total - words))
    last = F.least(total, first + words)
    marked = F.flatten(F.transform(at, lambda a: F.flatten(F.transform(a["starts"], lambda s: F.sequence(s, s + a["words"] - 1)))))
    body = F.transform(F.slice(pieces, first * 2 + lead + 1, (last - first) * 2 - 1), lambda p, i: F.when((i % 2 == 0) & F.array_contains(marked, (first + F.floor(i / 2)).cast("int")), F.concat(F.lit(">>>"), p, F.lit("<<<"))).otherwise(p))
    return F.concat(F.when(first > 0, "...").otherwise(""), F.array_join(body, ""), F.when(last < total, "...").otherwise(""))
