"""Streaming operators over the activity log.

Each takes a streaming DataFrame with the columns of `sources.tables.activity` and returns one. Events of one key in
one micro-batch are put in order (ts, event_id) before they change the state of the key; across micro-batches the order
is that of arrival. The state is a few values a key. What a key has in one micro-batch is held in one task: limit it
with the source's maxFilesPerTrigger.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.telemetry import ORDER, partial_summary
from ..sources.tables import scratch


def drained(stream: DataFrame, mode: str = "append", partition_by: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """All that `stream` yields for what its source holds now, written to the shared folder and read again.

    mode append: the file sink, which takes each micro-batch once. mode update: each micro-batch is a folder of its own,
    overwritten if it is tried again, and comes back with its number in the column `batch`. With the path of an earlier
    call it goes on from that call's checkpoint.
    """
    spark, path = stream.sparkSession, path or scratch(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.partitionBy(*partition_by).format("parquet").option("path", f"{path}/rows").start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/rows/batch=-1")
    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/rows")


def newest(updates: DataFrame, key: str) -> DataFrame:
    """The last state of each key among the rows of an update stream."""
    return updates.groupBy(key).agg(F.max_by(F.struct(*[c for c in updates.columns if c not in (key, "batch")]), "batch").alias("s")).select(key, "s.*")


def agent_status(stream: DataFrame) -> DataFrame:
    """Partial summaries per agent, kept by Spark's own incremental aggregation; run in update mode."""
    return partial_summary(stream)


def streaks(stream: DataFrame, key: str, value: str) -> DataFrame:
    """key, event_id, value string, streak int: how many rows of the key in a row have had this value."""
    import pandas as pd

    kind = {f.name: f.dataType.simpleString() for f in stream.schema}

    def work(_: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(list(ORDER))
        out = []
        for v in rows["v"]:
            v = None if pd.isna(v) else v
            n = n + 1 if n and v == last else 1
            last = v
            out.append(n)
        state.update((last, n))
        yield pd.DataFrame({key: rows["key"], "event_id": rows["event_id"], value: rows["v"], "streak": out})

    rows = stream.select(F.col(key).alias("key"), *ORDER, F.col(value).cast("string").alias("v"))
    return rows.groupBy("key").applyInPandasWithState(work, f"{key} {kind[key]}, event_id {kind['event_id']}, {value} string, streak int", "last string, n int", "append", GroupStateTimeout.NoTimeout)


def loop_guard(stream: DataFrame, nudge: int = 3, close: int = 6) -> DataFrame:
    """Events that repeat the type of the agent's events before: nudge at the streak `nudge`, close from `close` on."""
    found = streaks(stream, "agent_id", "type")
    return found.select("agent_id", "event_id", "streak", F.when(F.col("streak") >= close, "close").when(F.col("streak") == nudge, "nudge").otherwise("none").alias("decision"))


def backoff(stream: DataFrame, delays: tuple[int, ...] = (15, 60, 300, 900)) -> DataFrame:
    """Failures with the delay (seconds) before a retry, by failures in a row; capped at the last delay."""
    failed = streaks(stream.withColumn("failed", F.col("type") == "tool-result"), "agent_id", "failed").where("failed = 'true'")
    return failed.select("agent_id", "event_id", "streak", F.element_at(F.array(*map(F.lit, delays)), F.least("streak", F.lit(len(delays)))).alias("delay"))


def failure_budget(stream: DataFrame, budget: int = 2, success: str = "conversation-end") -> DataFrame:
    """agent_id, event_id, spent, exhausted of each failure: an error (k is known) costs 1, a timeout 2; success clears."""
    import pandas as pd

    kind = {f.name: f.dataType.simpleString() for f in stream.schema}

    def work(_: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(list(ORDER))
        out = []
        for cost in rows["cost"]:
            spent = spent + int(cost) if cost else 0
            out.append(spent)
        state.update((spent,))
        rows = rows.assign(spent=out)
        rows = rows[rows["cost"] > 0]
        yield pd.DataFrame({"agent_id": rows["agent_id"], "event_id": rows["event_id"], "spent": rows["spent"]})

    cost = F.when(F.col("type") == success, 0).when(F.col("k").isNull(), 2).otherwise(1)
    rows = stream.where(F.col("type").isin("tool-result", success)).select("agent_id", *ORDER, cost.alias("cost"))
    found = rows.groupBy("agent_id").applyInPandasWithState(work, f"agent_id {kind['agent_id']}, event_id {kind['event_id']}, spent long", "spent long", "append", GroupStateTimeout.NoTimeout)
    return found.withColumn("exhausted", F.col("spent") >= budget)


def consume_once(stream: DataFrame, *keys: str, within: str | None = None) -> DataFrame:
    """The keys of the stream, each once; the state is one receipt for each different key.

    within (as '2 days'): receipts are dropped when the watermark on ts has passed them by that much, so that the state
    is bounded; a key that comes again later than that is taken again.
    """
    if within is None:
        return stream.select(*keys).dropDuplicates(list(keys))
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", within).dropDuplicatesWithinWatermark(list(keys)).select(*keys)


def publish_once(stream: DataFrame, scope: str, source: str, cap: int = 4096, acknowledged: str | None = None) -> DataFrame:
    """scope, source string, event_id, watermark long: each source of a scope once, with numbers 1, 2, ... in the order of arrival.

    A source that comes again keeps its number and gives no row. acknowledged: a column of numbers; a row that has one
    acknowledges all numbers up to it and publishes nothing. Of over `cap` sources the oldest acknowledged ones are
    forgotten, of which a later event is news again; sources that nobody has acknowledged are never forgotten.
    """
    import pandas as pd

    kind = {f.name: f.dataType.simpleString() for f in stream.schema}

    def work(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        made, acked, known, numbers = state.get if state.exists else (0, 0, [], [])
        order = dict(zip(known, numbers, strict=True))
        out = []
        for row in pd.concat(list(frames)).sort_values(list(ORDER)).itertuples(index=False):
            if row.acked == row.acked and row.acked is not None:
                acked = max(acked, min(int(row.acked), made))
            elif row.source is not None and row.source not in order:
                made += 1
                order[row.source] = made
                out.append((key[0], row.source, row.event_id, made))
            for name in [n for n, number in list(order.items())[: max(0, len(order) - cap)] if number <= acked]:
                del order[name]
        state.update((made, acked, list(order), list(order.values())))
        yield pd.DataFrame(out, columns=[scope, source, "event_id", "watermark"])

    acked = F.col(acknowledged).cast("long") if acknowledged else F.lit(None).cast("long")
    rows = stream.select(F.col(scope).alias("scope"), F.col(source).cast("string").alias("source"), acked.alias("acked"), *ORDER).where("source is not null or acked is not null")
    gives = f"{scope} {kind[scope]}, {source} string, event_id {kind['event_id']}, watermark long"
    return rows.groupBy("scope").applyInPandasWithState(work, gives, "made long, acked long, known array<string>, numbers array<long>", "append", GroupStateTimeout.NoTimeout)


def circuit(stream: DataFrame, key: str, first_s: int = 300, most_s: int = 1800, timeouts: int = 1, failures: int = 2) -> DataFrame:
    """key, event_id, allowed, open_count, open_until (seconds, null where closed) of each call.

    stream: key, ts, event_id, outcome ('ok', 'timeout' or another failure), fingerprint. A failure of another
    fingerprint begins anew. The circuit opens at `timeouts` timeouts or `failures` failures in a row of one fingerprint,
    for first_s seconds, doubled each time up to most_s, but never while it is open; a success closes it. allowed says
    whether the call came while the circuit was not open.
    """
    import pandas as pd

    kind = {f.name: f.dataType.simpleString() for f in stream.schema}

    def work(key_: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        print_, failed, timed, opened, until = state.get if state.exists else ("", 0, 0, 0, None)
        out = []
        for row in pd.concat(list(frames)).sort_values(["at", "event_id"]).itertuples(index=False):
            allowed = until is None or row.at >= until
            if row.outcome == "ok":
                print_, failed, timed, opened, until = "", 0, 0, 0, None
            else:
                if row.fingerprint != print_:
                    print_, failed, timed, opened, until = row.fingerprint, 0, 0, 0, None
                failed, timed = failed + 1, timed + 1 if row.outcome == "timeout" else 0
                if (row.outcome == "timeout" and timed >= timeouts or failed >= failures) and (until is None or row.at >= until):
                    opened += 1
                    until = int(row.at) + min(most_s, first_s * 2 ** min(16, opened - 1))
            out.append((key_[0], row.event_id, allowed, opened, until))
        state.update((print_, failed, timed, opened, until))
        frame = pd.DataFrame(out, columns=[key, "event_id", "allowed", "open_count", "open_until"])
        yield frame.astype({"open_until": "Int64"})

    rows = stream.select(F.col(key).alias("key"), F.col("ts").cast("timestamp").cast("long").alias("at"), "event_id", "outcome", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))
    return rows.groupBy("key").applyInPandasWithState(work, f"{key} {kind[key]}, event_id {kind['event_id']}, allowed boolean, open_count int, open_until long", "print string, failed int, timed int, opened int, until long", "append", GroupStateTimeout.NoTimeout)


def route_epochs(stream: DataFrame, key: str, decision: str = "tool-call", progress: str = "conversation-end", rollover: int = 4) -> DataFrame:
    """key, event_id, streak, epoch of each decision: decisions without progress, in a row, and how often they rolled over.

    A decision of the same k as the one before it, with no progress between, is a refresh and does not count. Progress
    ends the streak; at `rollover` the epoch is one more and the next streak begins.
    """
    import pandas as pd

    kind = {f.name: f.dataType.simpleString() for f in stream.schema}

    def work(key_: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak, epoch, last = state.get if state.exists else (0, 0, None)
        out = []
        for row in pd.concat(list(frames)).sort_values(list(ORDER)).itertuples(index=False):
            if row.type == progress:
                streak, last = 0, None
                continue
            if row.k != last:
                streak, last = streak % rollover + 1, row.k
                epoch += streak == rollover
            out.append((key_[0], row.event_id, streak, epoch))
        state.update((streak, epoch, last))
        yield pd.DataFrame(out, columns=[key, "event_id", "streak", "epoch"])

    rows = stream.where(F.col("type").isin(decision, progress)).select(F.col(key).alias("key"), *ORDER, "type", F.coalesce("k", F.lit(-1)).alias("k"))
    return rows.groupBy("key").applyInPandasWithState(work, f"{key} {kind[key]}, event_id {kind['event_id']}, streak int, epoch int", "streak int, epoch int, last int", "append", GroupStateTimeout.NoTimeout)


def read(spark: SparkSession, sf_dir: str, name: str, files_at_once: int | None = None) -> DataFrame:
    """A given table as a stream of files; the braces make the path a pattern, so that it may be one file or a folder."""
    reader = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema)
    reader = reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader
    return reader.parquet(f"{sf_dir}/{{{name}}}.parquet")
