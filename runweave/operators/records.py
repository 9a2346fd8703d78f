"""Operators that bring keyed records together: pairing, upserts, diffs, prefixes and large payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repair_pairs(activity: DataFrame, call: str = "tool-call", result: str = "tool-result", keys: tuple[str, ...] = ("agent_id", "k")) -> DataFrame:
    """agent_id, event_id, kind: events without orphan results ('kept'), and a 'stub' for each call without a result.

    A null key pairs with nothing. Both sides of the joins are folded to distinct keys first.
    """
    calls, results = activity.where(F.col("type") == call), activity.where(F.col("type") == result)
    paired = results.join(calls.select(*keys).distinct(), list(keys), "left_semi")
    alone = calls.join(results.select(*keys).distinct(), list(keys), "left_anti")
    rest = activity.where(~F.col("type").eqNullSafe(result))
    out = rest.select("agent_id", "event_id").unionByName(paired.select("agent_id", "event_id")).withColumn("kind", F.lit("kept"))
    return out.unionByName(alone.select("agent_id", "event_id", F.lit("stub").alias("kind")))


def compact_findings(findings: DataFrame, receipts: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], newest: int = 32, protected: DataFrame | None = None) -> DataFrame:
    """Findings without a receipt or among the protected ones (keys), and the newest of the others with one."""
    seen = receipts.select(*keys).distinct()
    if protected is not None:
        seen = seen.join(protected.select(*keys).distinct(), list(keys), "left_anti")
    waiting = findings.join(seen, list(keys), "left_anti")
    delivered = findings.join(seen, list(keys), "left_semi").orderBy(*[F.desc(c) for c in order]).limit(newest)
    return waiting.unionByName(delivered)


def sync_diff(bundled: DataFrame, manifest: DataFrame, local: DataFrame) -> DataFrame:
    """name, action for each name that is bundled or in the manifest; each side has name (unique) and hash."""
    b, m, o = (side.select("name", F.col("hash").alias(c), F.lit(True).alias(f"has_{c}")) for side, c in ((bundled, "b"), (manifest, "m"), (local, "o")))
    rows = b.join(m, "name", "full").join(o, "name", "left")
    has = lambda c: F.coalesce(F.col(f"has_{c}"), F.lit(False))
    action = (
        F.when(~has("b"), "removed_upstream").when(~has("m"), "new").when(~has("o"), "deletion_kept")
        .when(~F.col("o").eqNullSafe(F.col("m")), "modified_kept").when(~F.col("b").eqNullSafe(F.col("m")), "updated").otherwise("unchanged")
    )
    return rows.select("name", action.alias("action"))


def upsert(base: DataFrame, updates: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: updates win over base, but a blank or null update keeps the old value; both have unique keys."""
    new = updates.select(key, F.when(F.trim(value) != "", F.col(value)).alias("_new"))
    return base.select(key, value).join(new, key, "full").select(key, F.coalesce("_new", value).alias(value))


def upsert_in_order(base: DataFrame, updates: DataFrame, key: str, value: str, order: str, replace_all: bool = False) -> DataFrame:
    """key, value, order: as upsert(), each key at the place (order) where it was first seen, new ones after all old ones.

    Of repeated updates the last that is not blank counts. replace_all: only keys of the updates stay, at their own places.
    """
    last = F.max_by(F.when(F.trim(value) != "", F.col(value)), F.when(F.trim(value) != "", F.col(order)))
    new = updates.groupBy(key).agg(last.alias("_new"), F.min(order).alias("_at"))
    joined = base.select(key, value, order).join(new, key, "right" if replace_all else "full")
    if replace_all:
        return joined.select(key, F.coalesce("_new", value).alias(value), F.col("_at").alias(order))
    after = base.agg(F.coalesce(F.max(order), F.lit(0)).alias("_last"))
    return joined.join(F.broadcast(after)).select(key, F.coalesce("_new", value).alias(value), F.coalesce(F.col(order), F.col("_at") + F.col("_last")).alias(order))


def resolve_ids(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """ref, id: the id that equals ref, else the only id that begins with it, else null. ids.id is unique.

    Each id gives its prefixes, which are counted with map-side combining, so prefixes meet refs in an equi-join.
    """
    wanted = refs.select("ref").distinct()
    prefixes = ids.select("id", F.explode(F.sequence(F.lit(1), F.length("id"))).alias("n")).where(F.col("n") > 0).select(F.expr("substring(id, 1, n)").alias("ref"), "id")
    met = prefixes.groupBy("ref").agg(F.count("*").alias("n"), F.min("id").alias("only"), F.max(F.col("id") == F.col("ref")).alias("exact"))
    return wanted.join(met, "ref", "left").select("ref", F.when(F.col("exact"), F.col("ref")).when(F.col("n") == 1, F.col("only")).alias("id"))


def distinct_queries(rows: DataFrame, text: str, order: str, cap: int = 4) -> DataFrame:
    """The first `cap` texts that differ without regard to case, in order, as first written; a top-k report."""
    first = rows.where(F.col(text).isNotNull()).groupBy(F.lower(text).alias("folded")).agg(F.min(order).alias(order), F.min_by(text, order).alias(text))
    return first.orderBy(order).limit(cap).select(order, text)


def externalised(rows: DataFrame, key: str, payload: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(hot, side): payloads of more than `limit` bytes leave the hot rows and go, once each, to a table by digest."""
    size = F.coalesce(F.octet_length(payload), F.lit(0)).cast("long")
    large = size > limit
    hot = rows.select(key, size.alias("size"), F.when(large, F.sha2(payload, 256)).alias("digest"), F.when(~large, F.col(payload)).alias(payload))
    side = rows.where(large).select(F.sha2(payload, 256).alias("digest"), payload).groupBy("digest").agg(F.first(payload).alias(payload))
    return hot, side
