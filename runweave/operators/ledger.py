"""Operators over jobs, evidence, leases, campaigns and work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as f


def lease_conflicts(leases: DataFrame, requests: DataFrame) -> DataFrame:
    """request_path, request_owner, path, owner: leases of other owners that a request overlaps.

    Both: path, owner, kind ('file' or 'namespace'). They overlap on the same path, inside a leased namespace, or with
    a lease inside the requested namespace; a namespace holds what is below its path. Joined on equal prefixes.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    held = leases.where(F.trim(F.coalesce("owner", F.lit(""))) != "")
    asked = requests.select(F.col("path").alias("request_path"), F.col("owner").alias("request_owner"), F.col("kind").alias("request_kind"), prefixes.alias("up"))
    above = asked.withColumn("path", F.explode("up")).join(held, "path").where((F.col("path") == F.col("request_path")) | (F.col("kind") == "namespace"))
    below = held.withColumn("request_path", F.explode(prefixes)).join(asked.where("request_kind = 'namespace'"), "request_path").where(F.col("path") != F.col("request_path"))
    columns = ["request_path", "request_owner", "path", "owner"]
    return above.select(*columns).unionByName(below.select(*columns)).where(F.col("owner") != F.col("request_owner")).distinct()


def superseded(entries: DataFrame) -> DataFrame:
    """job_id, by: entries all facts of which a later checked entry of the same assignment has too, and the first such.

    entries: job_id, assignment, seq, checked, facts (array). An entry without facts is not superseded.
    """
    facts = entries.select("job_id", "assignment", "seq", F.size(F.array_distinct("facts")).alias("n"), F.explode(F.array_distinct("facts")).alias("fact"))
    later = entries.where("checked").select(F.col("job_id").alias("by"), "assignment", F.col("seq").alias("then"), F.explode(F.array_distinct("facts")).alias("fact"))
    held = facts.join(later, ["assignment", "fact"]).where("then > seq").groupBy("job_id", "n", "by", "then").agg(F.count("*").alias("both")).where("both = n")
    return held.groupBy("job_id").agg(F.min_by("by", "then").alias("by"))


def current_evidence(evidence: DataFrame, declarations: DataFrame) -> DataFrame:
    """Evidence (file, symbol, digest, ...) whose digest is that of the statement (file, symbol, statement) as it is now."""
    now = declarations.select("file", "symbol", F.sha2(F.coalesce("statement", F.lit("")), 256).alias("digest"))
    return evidence.join(now, ["file", "symbol", "digest"], "left_semi").select(*evidence.columns)


def stale_split(results: DataFrame, current: DataFrame) -> DataFrame:
    """results (target, digest, ...) with role and reason: evidence_only where the target's digest is another now, or gone."""
    now = current.select(F.col("target").alias("of"), F.col("digest").alias("now"))
    joined = results.join(now, results["target"] == now["of"], "left")
    reason = F.when(F.col("of").isNull(), "unknown_target").when(F.col("now") != F.col("digest"), "stale_active_file_revision")
    return joined.select(*results.columns, F.when(reason.isNull(), "finding").otherwise("evidence_only").alias("role"), reason.alias("reason"))


def campaign_batches(batches: DataFrame, attempts: DataFrame) -> DataFrame:
    """batch, status, agent_status, attempts, spend: what the attempts of each batch (batch) amount to.

    attempts: batch, stage, success, provenance, cost_scope, cost. Proofs go before statements, else pending;
    agent_status counts only attempts of the agent (provenance given, else manual_gold where no provider was called).
    """
    origin = F.when(F.trim(F.coalesce("provenance", F.lit(""))) != "", F.trim("provenance")).when(F.col("cost_scope") == "no_provider_call", "manual_gold").otherwise("agent")
    won = lambda stage, also: F.coalesce(F.bool_or(F.col("success") & (F.coalesce("stage", F.lit("proofs")) == stage) & also), F.lit(False))
    status = lambda also: F.when(won("proofs", also), "proofs_completed").when(won("statements", also), "statements_completed").otherwise("pending")
    rolled = attempts.withColumn("origin", origin).groupBy("batch").agg(status(F.lit(True)).alias("status"), status(F.col("origin") == "agent").alias("agent_status"), F.count("*").alias("attempts"), F.round(F.sum("cost"), 6).alias("spend"))
    return batches.select("batch").join(rolled, "batch", "left").select("batch", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("agent_status", F.lit("pending")).alias("agent_status"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("spend", F.lit(0.0)).alias("spend"))


def failure_counts(attempts: DataFrame) -> DataFrame:
    """failure_class, n of all attempts that failed."""
    kind = f.failure_class(F.col("success"), F.col("failure_class"), F.col("reason"), F.col("stage"))
    return attempts.select(kind.alias("failure_class")).where("failure_class <> ''").groupBy("failure_class").agg(F.count("*").alias("n"))


def suite_metrics(runs: DataFrame) -> DataFrame:
    """One row of ratios of sums over all runs: rejected, coached, gave_up, false_success, routes, shapes (arrays), launched."""
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0))
    plain = runs.agg(F.count("*").alias("runs"), share("gave_up").alias("give_up_rate"), share("false_success").alias("false_success_rate"), F.sum("coached").alias("coached"), F.sum("rejected").alias("rejected"), F.coalesce(F.sum("launched"), F.lit(0)).alias("launched"))
    kinds = [runs.select(F.explode(column).alias("c")).agg(F.count_distinct("c").alias(name)) for name, column in (("route_diversity", "routes"), ("shape_diversity", "shapes"))]
    coverage = F.when(F.coalesce("rejected", F.lit(0)) > 0, F.col("coached") / F.col("rejected")).otherwise(1.0)
    return plain.join(F.broadcast(kinds[0])).join(F.broadcast(kinds[1])).select("runs", "give_up_rate", "false_success_rate", coverage.alias("coach_coverage"), "route_diversity", "shape_diversity", "launched")


def manifest_problems(cases: DataFrame, sources: DataFrame, expected: dict[str, int]) -> DataFrame:
    """problem, suite, case_id: counts off, missing or repeated ids, unknown sources, missing fields, revisions not pinned.

    cases: suite, seq, case_id, source, file, declaration; sources: source, revision, local.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    no = F.lit(None).cast("string")
    wanted = F.array(*[F.struct(F.lit(k).alias("suite"), F.lit(n).cast("long").alias("wanted")) for k, n in expected.items()])
    asked = sources.sparkSession.range(1).select(F.explode(wanted).alias("w")).select("w.*")
    counts = asked.join(cases.groupBy("suite").agg(F.count("*").alias("n")), "suite", "left").where(F.coalesce("n", F.lit(0)) != F.col("wanted")).select(F.lit("count").alias("problem"), "suite", no.alias("case_id"))
    first = F.row_number().over(Window.partitionBy("case_id").orderBy("suite", "seq"))
    ids = cases.withColumn("r", first).where(blank("case_id") | (F.col("r") > 1)).select(F.lit("id").alias("problem"), "suite", "case_id")
    unknown = cases.join(sources.select("source"), "source", "left_anti").select(F.lit("source").alias("problem"), "suite", "case_id")
    fields = cases.where(blank("file") | blank("declaration")).select(F.lit("fields").alias("problem"), "suite", "case_id")
    loose = sources.where(~F.col("local") & ~F.coalesce(F.col("revision").rlike("^[A-Za-z0-9]{40}$"), F.lit(False))).select(F.lit("revision").alias("problem"), F.col("source").alias("suite"), no.alias("case_id"))
    return counts.unionByName(ids).unionByName(unknown).unionByName(fields).unionByName(loose)


def run_learnings(activity: DataFrame, k: int = 3, routes: int = 6) -> DataFrame:
    """run_id, blockers, routes: the k most frequent failures of a run as 'fingerprint x n', and its last routes in order."""
    failed = activity.where("type = 'tool-result'").groupBy("run_id", "k").agg(F.count("*").alias("n"))
    top = failed.withColumn("r", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("n"), "k"))).where(F.col("r") <= k)
    blockers = top.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "k", "n"))), lambda x: F.concat_ws(" x ", x["k"].cast("string"), x["n"].cast("string"))), ", ").alias("blockers"))
    newest = Window.partitionBy("run_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = activity.where("type = 'tool-call'").withColumn("r", F.row_number().over(newest)).where(F.col("r") <= routes)
    history = last.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("r"), "k"))), lambda x: x["k"].cast("string")), " | ").alias("routes"))
    return activity.select("run_id").distinct().join(blockers, "run_id", "left").join(history, "run_id", "left").select("run_id", F.coalesce("blockers", F.lit("")).alias("blockers"), F.coalesce("routes", F.lit("")).alias("routes"))


def delivery_backlog(findings: DataFrame, receipts: DataFrame) -> DataFrame:
    """campaign, target, waiting: findings (job_id, target, campaign) without a receipt (job_id, target)."""
    waiting = findings.join(receipts.select("job_id", "target").distinct(), ["job_id", "target"], "left_anti")
    return waiting.groupBy("campaign", "target").agg(F.count("*").alias("waiting"))


def archive_digest(seq: str, payload: str) -> Column:
    """Aggregate: a digest of records and their order, the sum of 60 bits of the hash of each with its place.

    It is combined before the shuffle, and records that change places, come twice or differ in a byte change it.
    """
    hashed = F.sha2(F.concat_ws(":", F.col(seq).cast("string"), F.coalesce(F.col(payload), F.lit(""))), 256)
    return F.sum(F.conv(F.left(hashed, F.lit(15)), 16, 10).cast("decimal(38,0)"))


def audit_archives(catalog: DataFrame, records: DataFrame) -> DataFrame:
    """archive, issue: archives of the catalog (archive, n, digest) whose records (archive, seq, payload) are not those.

    issue is missing, unknown, count, digest, or '' for one that is complete.
    """
    held = records.groupBy("archive").agg(F.count("*").alias("found"), archive_digest("seq", "payload").alias("sum"))
    joined = catalog.select("archive", "n", "digest").join(held, "archive", "full")
    issue = F.when(F.col("n").isNull(), "unknown").when(F.col("found").isNull(), "missing").when(F.col("n") != F.col("found"), "count").when(F.col("digest") != F.col("sum"), "digest").otherwise("")
    return joined.select("archive", issue.alias("issue"))


def next_items(queue: DataFrame) -> DataFrame:
    """scope, label: the next item of each scope. queue: scope, label, seq, bucket (diagnostic, hole, tidy), rank, key.

    Rank 3 and over never; rank 2 only where its bucket has nothing better; buckets in their order, then rank, key, seq.
    """
    bucket = F.when(F.col("bucket") == "diagnostic", 0).when(F.col("bucket") == "hole", 1).when(F.col("bucket") == "tidy", 2)
    rows = queue.withColumn("at", bucket).where("at is not null and rank < 3")
    return rows.groupBy("scope").agg(F.min_by("label", F.struct("at", "rank", "key", "seq")).alias("label"))


def backlog_order(candidates: DataFrame, cap: int) -> DataFrame:
    """scope, id, place: candidates (scope, id, seq, displaced) one each (the first), displaced ones first, `cap` at most."""
    one = candidates.groupBy("scope", "id").agg(F.min("seq").alias("seq"), F.bool_or("displaced").alias("displaced"))
    place = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("displaced"), "seq", "id"))
    return one.withColumn("place", place).where(F.col("place") <= cap).select("scope", "id", "place")


def best_candidates(candidates: DataFrame, declarations: DataFrame) -> DataFrame:
    """target, id: of those with the current digest the one of fewest errors, then longest prefix, then most context, then newest."""
    now = candidates.join(declarations.select("target", "digest"), ["target", "digest"], "left_semi")
    return now.groupBy("target").agg(F.max_by("id", F.struct((-F.col("errors")).alias("e"), "prefix", "context", "id")).alias("id"))


def replay_due(candidates: DataFrame, declarations: DataFrame, process: str, contract: int) -> DataFrame:
    """target, id, due: the newest valid candidate of the current digest; due unless this process replayed it under this contract."""
    now = candidates.where("valid").join(declarations.select("target", "digest"), ["target", "digest"], "left_semi")
    due = ~((F.col("replayed_by") == process) & (F.col("contract") == contract))
    newest = now.groupBy("target").agg(F.max_by(F.struct("id", F.coalesce(due, F.lit(True)).alias("due")), F.col("id")).alias("c"))
    return newest.select("target", "c.id", "c.due")


def next_batch(ranked: DataFrame, cursors: DataFrame, n: int) -> DataFrame:
    """scope, id, lane: all exact candidates and the next n generic ones after the cursor of their scope.

    ranked: scope, id, place, exact; cursors: scope, lane, digest, cursor. A cursor holds only while the digest of the
    lane's ordered ids is its own; else the lane begins anew. Exact candidates before their cursor are done, too.
    """
    lane = F.when(F.col("exact"), "exact").otherwise("generic")
    rows = ranked.withColumn("lane", lane)
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("scope", "lane").orderBy("place", "id")) - 1)
    digests = rows.groupBy("scope", "lane").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"].cast("string")), ","), 256).alias("digest"))
    held = digests.join(cursors, ["scope", "lane", "digest"], "left").select("scope", "lane", F.coalesce("cursor", F.lit(0)).alias("cursor"))
    found = rows.join(held, ["scope", "lane"]).where((F.col("at") >= F.col("cursor")) & ((F.col("lane") == "exact") | (F.col("at") < F.col("cursor") + n)))
    return found.select("scope", "id", "lane")


def struggle(contexts: DataFrame) -> DataFrame:
    """key, signals, severity from attempts, repeated, streak, searches, stable, calls, most_calls, blocker.

    signals: kind=severity, comma-joined. Two kinds of nudges together reroute.
    """
    nudge = lambda test, kind, reroute=None: F.when(test, F.struct(F.lit(kind).alias("kind"), (F.when(reroute, "reroute") if reroute is not None else F.lit(None)).alias("high")))
    c = F.col
    found = F.array_compact(F.array(
        nudge(c("attempts") >= 2, "failed_attempts", c("attempts") >= 4), nudge(c("repeated") >= 2, "repeat_error_signature"), nudge((c("streak") >= 2) | (c("searches") >= 6), "search_spiral"),
        nudge(c("stable") >= 2, "no_progress", c("stable") >= 3), nudge((c("most_calls") > 0) & (c("calls") / c("most_calls") >= 0.7), "budget_pressure"), nudge(F.trim("blocker") != "", "give_up_phrasing", c("stable") >= 2),
    ))
    rows = contexts.withColumn("s", F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), F.coalesce(x["high"], F.lit("nudge")).alias("severity"))))
    nudges, high = F.size(F.filter("s", lambda x: x["severity"] == "nudge")), F.exists("s", lambda x: x["severity"] == "reroute")
    severity = F.when(F.size("s") == 0, "none").when(high | (nudges >= 2), "reroute").otherwise("nudge")
    return rows.select("key", F.array_join(F.transform("s", lambda x: F.concat_ws("=", x["kind"], x["severity"])), ",").alias("signals"), severity.alias("severity"))


def active_leases(leases: DataFrame, now: Column) -> DataFrame:
    """The leases (path, owner, taken, ttl seconds) that have not run out; of one path the latest taken."""
    live = leases.where((F.col("taken") + F.col("ttl")) > now)
    return live.groupBy("path").agg(F.max_by(F.struct("owner", "taken"), F.struct("taken", "owner")).alias("l")).select("path", "l.owner", "l.taken")


def compact_ledger(jobs: DataFrame, least: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(hot, archive): payloads of done, consumed and released jobs go to the archive by digest, if that saves `least` bytes.

    jobs: job_id, state, consumed, released, payload. hot has payload null and its digest and size for those; archive:
    digest, payload, one row each.
    """
    size = F.octet_length("payload")
    goes = F.coalesce((F.col("state") == "done") & F.col("consumed") & F.col("released") & (size - 64 >= least), F.lit(False))
    digest = F.when(goes, F.sha2("payload", 256))
    hot = jobs.select("job_id", "state", "consumed", "released", F.when(~goes, F.col("payload")).alias("payload"), digest.alias("digest"), F.when(goes, size).alias("size"))
    return hot, jobs.where(goes).select(F.sha2("payload", 256).alias("digest"), "payload").dropDuplicates(["digest"])


def hydrate_ledger(hot: DataFrame, archive: DataFrame) -> DataFrame:
    """job_id, payload, intact: the payloads as they were; intact is false where the archive lacks one or holds another."""
    held = archive.select(F.col("digest").alias("of"), F.col("payload").alias("stored"))
    # Payloads without a digest stay where they are: a join would bring all of them to the task of the null key.
    stay = hot.where("digest is null").select("job_id", "payload", F.lit(True).alias("intact"))
    joined = hot.where("digest is not null").join(held, F.col("digest") == F.col("of"), "left")
    fine = F.coalesce(F.sha2("stored", 256) == F.col("digest"), F.lit(False))
    return stay.unionByName(joined.select("job_id", F.coalesce("payload", "stored").alias("payload"), fine.alias("intact")))
