"""Operators over the activity log: event_id, ts, agent_id, run_id, type, k, cents. Order is (ts, event_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "event_id")
#: Role of a transcript row by activity type (fixed values).
ROLES = {"conversation-start": "user", "api-request": "assistant", "tool-call": "tool-call"}
#: Status that an event type leads to (fixed values); others leave the status as it is.
STATUS = {"conversation-start": "running", "conversation-end": "completed", "tool-result": "failed"}


def mapped(column: str, values: dict[str, str], other: Column) -> Column:
    out = other
    for value, becomes in values.items():
        out = F.when(F.col(column) == value, becomes).otherwise(out)
    return out


def by_agent(*more: str) -> Window:
    return Window.partitionBy("agent_id", *more).orderBy(*ORDER)


def tail(activity: DataFrame, n: int, types: tuple[str, ...] = (), agent_id: int | None = None) -> DataFrame:
    """The newest n events that pass the filters; Spark takes them without a full sort."""
    found = activity.where(F.col("type").isin(*types)) if types else activity
    found = found.where(F.col("agent_id") == agent_id) if agent_id is not None else found
    return found.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def last_n(activity: DataFrame, key: str, n: int) -> DataFrame:
    """The newest n events of each key with rank 1..n; the limit is applied before the shuffle as well."""
    newest = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return activity.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)


def agent_summary(activity: DataFrame) -> DataFrame:
    """One row per agent, by partial aggregation only (a busy agent costs a row a task).

    n_events, first_start and last_event (ids), last_type, status after the last transition, api_calls (largest
    counter of a request), tool_calls.
    """
    at = F.struct(*ORDER)
    of = lambda kind: F.col("type") == kind
    return activity.groupBy("agent_id").agg(
        F.count("*").alias("n_events"),
        F.min_by(F.when(of("conversation-start"), F.col("event_id")), F.when(of("conversation-start"), at)).alias("first_start"),
        F.max_by("event_id", at).alias("last_event"),
        F.max_by("type", at).alias("last_type"),
        F.max_by(mapped("type", STATUS, F.lit(None)), F.when(F.col("type").isin(*STATUS), at)).alias("status"),
        F.max(F.when(of("api-request"), F.col("k"))).alias("api_calls"),
        F.count(F.when(of("tool-call"), 1)).alias("tool_calls"),
    )


def partial_summary(activity: DataFrame) -> DataFrame:
    """A summary that keeps the order of what it holds, so that two of them can be merged."""
    at = F.struct(*ORDER)
    move = F.when(F.col("type").isin(*STATUS), F.struct(*ORDER, mapped("type", STATUS, F.lit(None)).alias("status")))
    return activity.groupBy("agent_id").agg(F.count("*").alias("n_events"), F.max(F.struct(*ORDER, "type")).alias("last"), F.max(move).alias("move"), F.max(F.when(F.col("type") == "api-request", F.col("k"))).alias("api_calls"), F.min(at).alias("first"))


def merge_summaries(cold: DataFrame, hot: DataFrame) -> DataFrame:
    """Partial summaries of both sides in one row per agent; whichever side has the later value wins."""
    merged = cold.unionByName(hot).groupBy("agent_id").agg(F.sum("n_events").alias("n_events"), F.max("last").alias("last"), F.max("move").alias("move"), F.max("api_calls").alias("api_calls"), F.min("first").alias("first"))
    return merged.select("agent_id", "n_events", F.col("first.event_id").alias("first_event"), F.col("last.event_id").alias("last_event"), F.col("last.type").alias("last_type"), F.col("move.status").alias("status"), "api_calls")


def streaks(df: DataFrame, key: str, value: str) -> DataFrame:
    """df with streak: how many rows of the key in a row, this one included, have had this value."""
    order = Window.partitionBy(key).orderBy(*ORDER)
    starts = df.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(order)) | (F.row_number().over(order) == 1)).cast("int"))
    runs = starts.withColumn("_run", F.sum("_new").over(order))
    return runs.withColumn("streak", F.row_number().over(Window.partitionBy(key, "_run").orderBy(*ORDER))).drop("_new", "_run")


def loop_guard(activity: DataFrame, nudge: int = 3, close: int = 6) -> DataFrame:
    """Events of one agent that repeat the same type: none, nudge at the streak `nudge`, close from `close` on."""
    return streaks(activity, "agent_id", "type").withColumn("decision", F.when(F.col("streak") >= close, "close").when(F.col("streak") == nudge, "nudge").otherwise("none"))


def backoff(activity: DataFrame, delays: tuple[int, ...] = (15, 60, 300, 900)) -> DataFrame:
    """Failures with the delay (seconds) before a retry: it grows with failures in a row and is capped at the last."""
    failed = streaks(activity.withColumn("_failed", F.col("type") == "tool-result"), "agent_id", "_failed").where("_failed").drop("_failed")
    return failed.withColumn("delay", F.element_at(F.array(*map(F.lit, delays)), F.least(F.col("streak"), F.lit(len(delays)))))


def turn_deltas(activity: DataFrame) -> DataFrame:
    """Requests with the growth of the counter k since the agent's request before, not below 0."""
    requests = activity.where(F.col("type") == "api-request")
    return requests.withColumn("delta", F.greatest(F.col("k") - F.coalesce(F.lag("k").over(by_agent()), F.lit(0)), F.lit(0)))


def streak_floor(activity: DataFrame, decision: str = "tool-call", reset: str = "conversation-end", excluded: tuple[int, ...] = ()) -> DataFrame:
    """agent_id, streak: decisions since the latest reset of the agent that touches (k) more than excluded nodes."""
    touches = ~F.coalesce(F.col("k").isin(*excluded), F.lit(False)) if excluded else F.lit(True)
    floor = activity.where((F.col("type") == reset) & touches).groupBy("agent_id").agg(F.max(F.struct(*ORDER)).alias("floor"))
    agents = activity.select("agent_id", F.struct(*ORDER).alias("at"), (F.col("type") == decision).alias("decides"))
    after = F.col("decides") & (F.col("floor").isNull() | (F.col("at") > F.col("floor")))
    return agents.join(floor, "agent_id", "left").groupBy("agent_id").agg(F.count(F.when(after, 1)).alias("streak"))


def trailing_streaks(activity: DataFrame, key: str, of: str) -> DataFrame:
    """key, streak: how many of a key's last events in a row are of a type; 0 where the last one is not. Two aggregates, no window."""
    other = F.max(F.when(F.col("type") != of, F.struct(*ORDER)))
    last = activity.groupBy(key).agg(other.alias("other"))
    joined = activity.join(last, key).where(F.col("other").isNull() | (F.struct(*ORDER) > F.col("other")))
    counted = joined.groupBy(key).agg(F.count("*").alias("streak"))
    return last.select(key).join(counted, key, "left").select(key, F.coalesce("streak", F.lit(0)).alias("streak"))


def pauses_between(activity: DataFrame, decision: str = "api-request", failure: str = "tool-result", exited: str = "conversation-end", every: str = "hour") -> DataFrame:
    """Decisions of a run with paused: a failure and an exit both lie strictly between it and the decision before.

    Counts of both up to each decision replace the interval join. A run is counted in buckets of time, so that a busy
    one is no single task; only one row a bucket is put in order over the whole run.
    """
    rows = activity.withColumn("bucket", F.date_trunc(every, "ts"))
    inside = Window.partitionBy("run_id", "bucket").orderBy(*ORDER)
    count = lambda kind: F.count(F.when(F.col("type") == kind, 1))
    decisions = rows.select("run_id", "bucket", *ORDER, "type", count(failure).over(inside).alias("f"), count(exited).over(inside).alias("e")).where(F.col("type") == decision)
    decisions = decisions.withColumns({"pf": F.lag("f").over(inside), "pe": F.lag("e").over(inside)})
    last = decisions.groupBy("run_id", "bucket").agg(F.max("f").alias("lf"), F.max("e").alias("le"))
    sums = rows.groupBy("run_id", "bucket").agg(count(failure).alias("nf"), count(exited).alias("ne")).join(last, ["run_id", "bucket"], "left")
    before = Window.partitionBy("run_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"bf": F.coalesce(F.sum("nf").over(before), F.lit(0)), "be": F.coalesce(F.sum("ne").over(before), F.lit(0))})
    sums = sums.select("run_id", "bucket", "bf", "be", F.last(F.col("bf") + F.col("lf"), ignorenulls=True).over(before).alias("af"), F.last(F.col("be") + F.col("le"), ignorenulls=True).over(before).alias("ae"))
    joined = decisions.join(sums, ["run_id", "bucket"])
    more = lambda c: F.col(f"b{c}") + F.col(c) > F.coalesce(F.col(f"b{c}") + F.col(f"p{c}"), F.col(f"a{c}"))
    return joined.select("run_id", "event_id", F.coalesce(more("f") & more("e"), F.lit(False)).alias("paused"))


def transcript(activity: DataFrame) -> DataFrame:
    """Events as rows of a transcript: pos within the agent, role, text."""
    return activity.select("agent_id", "event_id", F.row_number().over(by_agent()).alias("pos"), mapped("type", ROLES, F.lit("event")).alias("role"), F.concat_ws(" ", "type", F.col("k").cast("string")).alias("text"))


def provider_status(activity: DataFrame, provider: str = "run_id") -> DataFrame:
    """Roll-up per provider: queries, results, largest cost, distinct errors, and what they amount to."""
    rolled = activity.groupBy(provider).agg(F.count(F.when(F.col("type") == "api-request", 1)).alias("queries"), F.count(F.when(F.col("type") == "tool-call", 1)).alias("results"), F.max("cents").alias("max_cents"), F.count_distinct(F.when(F.col("type") == "tool-result", F.col("k"))).alias("errors"))
    status = F.when((F.col("errors") > 0) & (F.col("results") > 0), "degraded").when(F.col("errors") > 0, "error").when(F.col("results") > 0, "ok").otherwise("empty")
    return rolled.withColumn("status", status)


def attempt_history(activity: DataFrame) -> DataFrame:
    """Failures by run without repeats of the same (run, fingerprint): event_id, k, attempt 1, 2, ... in order."""
    first = activity.where(F.col("type") == "tool-result").groupBy("run_id", "k").agg(F.min(F.struct(*ORDER)).alias("at"))
    order = Window.partitionBy("run_id").orderBy("at")
    return first.select("run_id", "k", F.col("at.event_id").alias("event_id"), F.row_number().over(order).alias("attempt"))


def status_changes(activity: DataFrame) -> DataFrame:
    """Rows at which the status of an agent changes: before (null at first), after."""
    moves = activity.where(F.col("type").isin(*STATUS)).withColumn("after", mapped("type", STATUS, F.lit(None)))
    moves = moves.withColumn("before", F.lag("after").over(by_agent()))
    return moves.where(~F.col("before").eqNullSafe(F.col("after"))).select("agent_id", "event_id", "before", "after")


def invalid_transitions(activity: DataFrame, legal: tuple[tuple[str, str], ...]) -> DataFrame:
    """Events whose (type before, type) is not among `legal`."""
    pairs = activity.withColumn("before", F.lag("type").over(by_agent())).where("before is not null")
    fine = F.lit(False)
    for a, b in legal:
        fine = fine | ((F.col("before") == a) & (F.col("type") == b))
    return pairs.where(~fine).select("agent_id", "event_id", "before", "type")


def closed_runs(activity: DataFrame) -> DataFrame:
    """run_id, n_events, open_agents, closed: a run is closed if the last event of each of its agents is an end."""
    last = activity.groupBy("run_id", "agent_id").agg(F.max_by("type", F.struct(*ORDER)).alias("last"), F.count("*").alias("n"))
    runs = last.groupBy("run_id").agg(F.sum("n").alias("n_events"), F.count(F.when(F.col("last") != "conversation-end", 1)).alias("open_agents"))
    return runs.withColumn("closed", F.col("open_agents") == 0)


def history(hot: DataFrame, archive: DataFrame, key: str = "run_id") -> DataFrame:
    """Hot rows and those archived rows whose key the hot side does not have."""
    return hot.unionByName(archive.join(hot.select(key).distinct(), key, "left_anti"))


def novelty(activity: DataFrame) -> DataFrame:
    """event_id, novel: no earlier event of the run has this fingerprint."""
    seen = F.row_number().over(Window.partitionBy("run_id", "k").orderBy(*ORDER))
    return activity.select("event_id", "run_id", "k", (seen == 1).alias("novel"))
