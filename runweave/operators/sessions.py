"""Operators over sessions (id, parent, title, started, ended, source), their messages (id, session_id, pos, role, content) and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as f

#: Body of a tool message whose output is no longer of use.
STALE = "[old tool output cleared]"


def export_sessions(sessions: DataFrame, messages: DataFrame, *fields: str) -> DataFrame:
    """The columns of sessions with messages: an array of structs (id and fields) in the order of pos, id; empty without any.

    A session's messages are its feature, so they come together in one row; sessions are the unit of parallel work.
    """
    own = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", *fields))).alias("own"))
    joined = sessions.join(own, sessions["id"] == own["session_id"], "left")
    nested = F.transform(F.coalesce("own", F.array().cast(own.schema["own"].dataType)), lambda m: F.struct(m["id"], *(m[c] for c in fields)))
    return joined.select(*sessions.columns, nested.alias("messages"))


def trajectories(messages: DataFrame) -> DataFrame:
    """session_id, turns: array<struct<from, value>> of each session, as training data has them.

    messages also has reasoning, calls (array<struct<name, arguments>>) and tool_call_id. user is human, assistant is
    gpt with reasoning in <think> (an empty one if there is none) and its calls as JSON, arguments that are no JSON
    object being {}. The tool messages that follow an assistant turn make one tool turn, each named by its place among
    the calls. Other roles are left out.
    """
    order = Window.partitionBy("session_id").orderBy("pos", "id")
    turn = F.sum(F.when(F.col("role") == "tool", 0).otherwise(1)).over(order)
    rows = messages.where(F.col("role").isin("user", "assistant", "tool")).withColumn("turn", turn)
    within = Window.partitionBy("session_id", "turn").orderBy("pos", "id")
    rows = rows.withColumns({"place": F.row_number().over(within) - 1, "asked": F.first("calls").over(within)})
    think = F.when(F.trim(F.coalesce("reasoning", F.lit(""))) != "", F.concat(F.lit("<think>\n"), "reasoning", F.lit("\n</think>\n"))).otherwise("")
    said = F.replace(F.replace(F.coalesce("content", F.lit("")), F.lit("<REASONING_SCRATCHPAD>"), F.lit("<think>")), F.lit("</REASONING_SCRATCHPAD>"), F.lit("</think>"))
    arguments = lambda c: F.when(F.get_json_object(c["arguments"], "$").startswith("{"), F.get_json_object(c["arguments"], "$")).otherwise("{}")
    called = lambda c: F.concat(F.lit('<tool_call>\n{"name":'), F.to_json(F.struct(c["name"].alias("n"))).substr(F.lit(6), F.length(F.to_json(F.struct(c["name"].alias("n")))) - 6), F.lit(',"arguments":'), arguments(c), F.lit("}\n</tool_call>"))
    calls = F.array_join(F.transform("calls", called), "\n")
    has_calls = F.coalesce(F.size("calls"), F.lit(0)) > 0
    body = F.concat(think, F.when(has_calls, F.concat(F.when(F.trim(said) != "", F.concat(said, F.lit("\n"))).otherwise(""), calls)).otherwise(said))
    gpt = F.trim(F.when(body.contains("<think>"), body).otherwise(F.concat(F.lit("<think>\n</think>\n"), body)))
    named = F.coalesce(F.get("asked", F.col("place") - 1)["name"], F.lit("unknown"))
    reply = F.concat(F.lit("<tool_response>\n"), F.to_json(F.struct(F.coalesce("tool_call_id", F.lit("")).alias("tool_call_id"), named.alias("name"), F.coalesce("content", F.lit("")).alias("content"))), F.lit("\n</tool_response>"))
    value = F.when(F.col("role") == "user", F.coalesce("content", F.lit(""))).when(F.col("role") == "assistant", gpt).otherwise(reply)
    made = rows.select("session_id", "turn", (F.col("role") == "tool").alias("tool"), F.struct("pos", "id", value.alias("value")).alias("at"), F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise("tool").alias("from"))
    turns = made.groupBy("session_id", "turn", "tool", "from").agg(F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["value"]), "\n").alias("value"))
    return turns.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "tool", "from", "value"))), lambda t: F.struct(t["from"], t["value"])).alias("turns"))


def prices(models: DataFrame, pricing: DataFrame, families: tuple[tuple[str, float, float], ...] = ()) -> DataFrame:
    """model, input, output (per million tokens), listed: by the whole bare name, else its longest prefix in pricing, else a family's word.

    models: model, one row each; pricing: key, input, output, with lower-case keys. What follows the last '/' is the
    bare name. A model without any price costs 0 and is not listed. Prefixes are looked up by equality of each prefix.
    """
    bare = F.lower(F.substring_index("model", "/", -1))
    each = models.select("model", bare.alias("bare")).withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("bare"), F.lit(1))), lambda n: F.substring("bare", F.lit(1), n))))
    best = each.join(pricing, "key").groupBy("model").agg(F.max_by(F.struct("input", "output"), F.length("key")).alias("price"))
    joined = models.join(best, "model", "left").withColumn("bare", bare)
    price, listed = F.col("price"), F.col("price").isNotNull()
    family = F.lit(None).cast("struct<input:double,output:double>")
    for word, a, b in reversed(families):
        family = F.when(F.col("bare").contains(word), F.struct(F.lit(a).alias("input"), F.lit(b).alias("output"))).otherwise(family)
    found = F.coalesce(price, family)
    return joined.select("model", F.coalesce(found["input"], F.lit(0.0)).alias("input"), F.coalesce(found["output"], F.lit(0.0)).alias("output"), (listed | family.isNotNull()).alias("listed"))


def usage_summary(calls: DataFrame, priced: DataFrame) -> DataFrame:
    """session_id, turn, calls, tokens of the turn and of the session so far, cost likewise, source of the cost.

    calls: session_id, turn, model, prompt, completion (tokens), reported (dollars or null); priced: as prices() gives.
    A reported cost goes before an estimate; the source is reported, estimated, mixed, or unpriced where a model is not
    listed.
    """
    estimate = (F.col("prompt") * F.col("input") + F.col("completion") * F.col("output")) / 1e6
    rows = calls.join(priced, "model", "left").withColumns({"cost": F.coalesce("reported", F.when(F.col("listed"), estimate)), "kind": F.when(F.col("reported").isNotNull(), "reported").when(F.col("listed"), "estimated").otherwise("unpriced")})
    turns = rows.groupBy("session_id", "turn").agg(F.count("*").alias("calls"), F.sum(F.col("prompt") + F.col("completion")).alias("tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    so_far = Window.partitionBy("session_id").orderBy("turn")
    source = F.when(F.array_contains("kinds", "unpriced"), "unpriced").when(F.size("kinds") > 1, "mixed").otherwise(F.get("kinds", F.lit(0)))
    return turns.select("session_id", "turn", "calls", "tokens", F.sum("tokens").over(so_far).alias("session_tokens"), F.round("cost", 6).alias("cost"), F.round(F.sum("cost").over(so_far), 6).alias("session_cost"), source.alias("source"))


def sample_turns(messages: DataFrame, n: int = 8) -> DataFrame:
    """id, session_id, slot: n messages of each session, evenly spread over it by half-even rounding; all of shorter ones."""
    order = Window.partitionBy("session_id").orderBy("pos", "id")
    rows = messages.withColumns({"at": F.row_number().over(order) - 1, "last": F.count("*").over(Window.partitionBy("session_id")) - 1})
    places = F.transform(F.sequence(F.lit(0), F.least(F.lit(n - 1), F.col("last")).cast("int")), lambda i: F.when(F.col("last") < n, i).otherwise(F.bround(i * F.col("last") / (n - 1), 0)).cast("long"))
    return rows.withColumn("slot", F.array_position(places, F.col("at").cast("long"))).where("slot > 0").select("id", "session_id", F.col("slot").cast("long"))


def reshard(batches: DataFrame, positions: DataFrame, n: int) -> DataFrame:
    """batch, shard, labels: the labels of a batch (batch, label) in their execution order (label, position), n to a shard.

    Labels without a position come last, by label. The shard's name is made of its labels.
    """
    order = Window.partitionBy("batch").orderBy(F.col("position").asc_nulls_last(), "label")
    rows = batches.join(positions, "label", "left").withColumn("at", F.row_number().over(order) - 1)
    shards = rows.groupBy("batch", F.floor(F.col("at") / n).alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"].cast("string")).alias("labels"))
    return shards.select("batch", F.concat(F.lit("items-"), F.array_join("labels", "-")).alias("shard"), F.size("labels").cast("long").alias("n"))


def next_titles(sessions: DataFrame) -> DataFrame:
    """base, next_title, newest: for each base title (without its ' #k') the next title and the session a title leads to.

    newest is the most recently started numbered session, else the one of the plain title.
    """
    base, k = F.regexp_replace("title", r" #[0-9]+$", ""), F.regexp_extract("title", r" #([0-9]+)$", 1).try_cast("int")
    rows = sessions.where("title is not null").select("id", "started", base.alias("base"), k.alias("k"))
    at = F.struct("started", "id")
    grouped = rows.groupBy("base").agg(F.greatest(F.max(F.coalesce("k", F.lit(1))), F.lit(1)).alias("top"), F.max_by("id", F.when(F.col("k").isNotNull(), at)).alias("numbered"), F.max_by("id", at).alias("plain"))
    return grouped.select("base", F.concat("base", F.lit(" #"), (F.col("top") + 1).cast("string")).alias("next_title"), F.coalesce("numbered", "plain").alias("newest"))


def next_child_ids(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """parent, tag, next_id: `parent.tag-NNN`, one more than all direct children of the parent; requests: parent, tag.

    Children of any tag count, and so do the requests of one batch before this one, in the order of their tags.
    """
    held = jobs.where(F.instr("job_id", ".") > 0).groupBy(F.regexp_extract("job_id", r"(?s)^(.*)\.[^.]*$", 1).alias("parent")).agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("parent").orderBy("tag"))
    joined = requests.withColumn("nth", nth).join(held, "parent", "left")
    number = F.coalesce("n", F.lit(0)) + F.col("nth")
    return joined.select("parent", "tag", F.concat("parent", F.lit("."), "tag", F.format_string("-%03d", number)).alias("next_id"))


def unflushed(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """Messages after the last stored position of their session (session_id, pos); all of a session without any."""
    last = stored.groupBy("session_id").agg(F.max("pos").alias("stored_pos"))
    return messages.join(last, "session_id", "left").where(F.col("stored_pos").isNull() | (F.col("pos") > F.col("stored_pos"))).select(*messages.columns)


def prune(sessions: DataFrame, messages: DataFrame, now: int, days: int = 90, source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) that stay: ended sessions (of source) that started over `days` before now (seconds) go with their messages."""
    gone = F.col("ended").isNotNull() & (F.col("started") < now - days * 86400)
    gone = gone & (F.col("source") == source) if source else gone
    kept = sessions.where(~F.coalesce(gone, F.lit(False)))
    return kept, messages.join(kept.select(F.col("id").alias("session_id")), "session_id", "left_semi").select(*messages.columns)


def list_sessions(sessions: DataFrame, messages: DataFrame, source: str | None = None, limit: int = 20, chars: int = 60) -> DataFrame:
    """The `limit` sessions last active: id, source, messages, preview (first user message), last_active (else started)."""
    user = F.col("role") == "user"
    text = F.col("content")
    preview = F.min_by(F.when(user, F.concat(F.substring(F.trim(F.translate(text, "\n\r", "  ")), 1, chars), F.when(F.length(text) > chars, "...").otherwise(""))), F.when(user, F.struct("ts", "id")))
    own = messages.groupBy("session_id").agg(F.count("*").alias("messages"), preview.alias("preview"), F.max("ts").alias("last"))
    chosen = sessions.where(F.col("source") == source) if source else sessions
    joined = chosen.join(own, chosen["id"] == own["session_id"], "left")
    rows = joined.select("id", "source", F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("preview", F.lit("")).alias("preview"), F.coalesce("last", "started").alias("last_active"))
    return rows.orderBy(F.desc("last_active"), "id").limit(limit)


def compaction_zones(messages: DataFrame, head: int = 3, tail: int = 4) -> DataFrame:
    """id, session_id, zone: head and tail of a session stay, what lies between is the middle; call and result groups stay whole.

    messages: id, session_id, pos, role, calls (whether an assistant message has tool calls). The middle begins after
    the tool results that follow the head, and takes in a calling message whose results the tail would begin with. A
    session of head + tail + 1 messages or fewer, or without a middle, is all head.
    """
    order, whole = Window.partitionBy("session_id").orderBy("pos", "id"), Window.partitionBy("session_id")
    rows = messages.withColumns({"at": F.row_number().over(order) - 1, "n": F.count("*").over(whole), "calling": (F.col("role") == "assistant") & F.col("calls")})
    start = F.coalesce(F.min(F.when((F.col("at") >= head) & (F.col("role") != "tool"), F.col("at"))).over(whole), F.col("n"))
    end = F.col("n") - tail
    before = F.max(F.when(F.col("at") == end - 1, F.col("calling").cast("int"))).over(whole)
    rows = rows.withColumns({"start": start, "end": end - F.coalesce(before, F.lit(0))})
    open_ = (F.col("n") > head + tail + 1) & (F.col("start") < F.col("end"))
    return rows.select("id", "session_id", F.when(~open_ | (F.col("at") < F.col("start")), "head").when(F.col("at") < F.col("end"), "middle").otherwise("tail").alias("zone"))


def prune_stale(messages: DataFrame, keep: int = 2, marker: str = STALE) -> DataFrame:
    """id, content: a non-empty tool body with at least `keep` later user turns in its session becomes the marker."""
    later = F.count(F.when(F.col("role") == "user", 1)).over(Window.partitionBy("session_id").orderBy(F.desc("pos"), F.desc("id")))
    stale = (F.col("role") == "tool") & (F.col("later") >= keep) & (F.coalesce("content", F.lit("")) != "")
    return messages.withColumn("later", later).select("id", F.when(stale, marker).otherwise(F.col("content")).alias("content"))


def recall(hits: DataFrame, roots: DataFrame, messages: DataFrame, terms: tuple[str, ...], k: int, chars: int, current: Column | None = None) -> DataFrame:
    """session_id (root), hit (best message), text: of the k best roots the transcript around the first term.

    hits: id, session_id, score; roots: id, root. One hit stands for each root; hits of sessions or roots for which
    `current` (over session_id and root) holds are left out. The k roots are the feature; only their messages are read on.
    """
    found = hits.join(roots, hits["session_id"] == roots["id"]).select(hits["id"].alias("hit"), "session_id", "root", "score")
    found = found.where(~current) if current is not None else found
    best = found.groupBy("root").agg(F.max_by("hit", F.struct("score", -F.col("hit"))).alias("hit"), F.max("score").alias("score")).orderBy(F.desc("score"), "hit").limit(k)
    own = messages.join(F.broadcast(best.select(F.col("root").alias("session_id"))), "session_id", "left_semi")
    line = F.concat(F.lit("["), F.upper("role"), F.lit("]: "), F.coalesce("content", F.lit("")))
    texts = own.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("text"))
    return best.join(texts, best["root"] == texts["session_id"]).select("session_id", "hit", f.window_text(F.col("text"), terms, chars).alias("text"))


def enriched(activity: DataFrame, runs: DataFrame, *fields: str) -> DataFrame:
    """activity with `fields` of its run; an event's own value goes first; runs: run_id, fields, one row a run."""
    other = runs.select(F.col("run_id").alias("of_run"), *(F.col(c).alias(f"run_{c}") for c in fields))
    joined = activity.join(other, activity["run_id"] == other["of_run"], "left")
    own = [F.coalesce(F.col(c), F.col(f"run_{c}")).alias(c) if c in activity.columns else F.col(f"run_{c}").alias(c) for c in fields]
    return joined.select(*(c for c in activity.columns if c not in fields), *own)
