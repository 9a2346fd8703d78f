"""Operators over source files (path, text), their declarations (file, name, kind, line, end_line, text, has_hole) and diagnostics."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as f
from ..sources.tables import spread

#: Line that begins a declaration: modifiers, kind, name (fixed values).
DECLARATION = r"^\s*(?:@\[[^\]]*\]\s*)?(?:(?:private|protected|noncomputable|unsafe|partial|nonrec)\s+)*(theorem|lemma|def|abbrev|example|instance|structure|inductive|class|axiom)\b\s*([^\s:({\[⦃]*)"
DIAGNOSTIC = r"^(.+?):(\d+):(\d+): (error|warning|info|information): (.*)$"
HOLE = r"(?<![\w.'])sorry(?![\w'])"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, max_bytes: int = 1 << 20) -> DataFrame:
    """Rows of JSON lines, and `source`, their file; lines over max_bytes, malformed ones and those that are no object are left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source")).where(F.octet_length("value") <= max_bytes)
    parsed = T.StructType([*schema.fields, T.StructField("_malformed", T.StringType())])
    row = F.from_json("value", parsed, {"columnNameOfCorruptRecord": "_malformed"})
    rows = lines.select("source", F.when(F.trim("value").startswith("{"), row).alias("r")).where(F.col("r").isNotNull() & F.col("r._malformed").isNull())
    return rows.select("source", *(F.col(f"r.{name}").alias(name) for name in schema.names))


def code_of(text: Column) -> Column:
    """A text without block comments, line comments and the inside of strings; its lines keep their numbers."""
    pieces = F.split(text, r"(?=/-)|(?<=-/)")
    open_ = F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("/-"), F.regexp_replace(p, r"[^\n]", "")).otherwise(p)), "")
    return F.regexp_replace(F.regexp_replace(open_, r'"(?:[^"\\\n]|\\.)*"', '""'), r"--[^\n]*", "")


def declarations(files: DataFrame) -> DataFrame:
    """file, name, kind, line, end_line, text, has_hole of each declaration; one without a name is '<anonymous>'.

    A declaration ends before the next one, without blank lines at its end. Comments and strings neither declare nor
    have holes. A file is one unit of work for its lines' order. Files are dealt out before they become lines, as a task
    of many small files holds many times their bytes.
    """
    dealt = spread(files.select(F.col("path").alias("file"), "text"), "file")
    both = dealt.select("file", F.posexplode(F.arrays_zip(F.split("text", "\n").alias("raw"), F.split(code_of(F.col("text")), "\n").alias("code"))).alias("line", "l"))
    rows = both.select("file", (F.col("line") + 1).alias("line"), "l.raw", "l.code", F.regexp_extract("l.code", DECLARATION, 1).alias("kind"), F.regexp_extract("l.code", DECLARATION, 2).alias("name"))
    begin = F.sum(F.when(F.col("kind") != "", 1).otherwise(0)).over(Window.partitionBy("file").orderBy("line"))
    rows = rows.withColumn("n", begin).where("n > 0")
    own = rows.groupBy("file", "n").agg(
        F.min("line").alias("line"), F.max_by("line", F.when(F.trim("raw") != "", F.col("line"))).alias("end_line"), F.min_by("kind", "line").alias("kind"), F.min_by("name", "line").alias("name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "\n").alias("text"), F.bool_or(F.col("code").rlike(HOLE)).alias("has_hole"),
    )
    return own.select("file", F.when(F.col("name") == "", "<anonymous>").otherwise(F.col("name")).alias("name"), "kind", "line", "end_line", F.regexp_replace("text", r"\s+$", "").alias("text"), "has_hole")


def import_edges(files: DataFrame, ending: str) -> DataFrame:
    """src, dst: files that import others of the same table by their module names, not themselves."""
    named = files.select(F.col("path").alias("dst"), f.module_name(F.col("path"), ending).alias("module"))
    asked = files.select(F.col("path").alias("src"), F.explode(f.imports(code_of(F.col("text")))).alias("module"))
    return asked.join(named, "module").where("src <> dst").select("src", "dst").distinct()


def signature(text: Column) -> Column:
    """The statement of a declaration, before := or where, without its name, blanks collapsed."""
    head = F.regexp_extract(text, r"^([\s\S]*?)(?::=|\bwhere\b|$(?![\s\S]))", 1)
    bare = F.regexp_replace(head, DECLARATION, "$1 ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def pending_dependencies(found: DataFrame) -> DataFrame:
    """file, consumer, dependency: declarations that name an earlier one of their file that still has a hole."""
    words = found.select("file", F.col("name").alias("consumer"), F.col("line").alias("at"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_'.]*)"), 1))).alias("word"))
    short = F.element_at(F.split("name", r"\."), -1)
    pending = found.where("has_hole and name <> '<anonymous>'").select("file", F.col("name").alias("dependency"), "line", F.explode(F.array_distinct(F.array(F.col("name"), short))).alias("word"))
    return words.join(pending, ["file", "word"]).where("line < at and dependency <> consumer").select("file", "consumer", "dependency").distinct()


def earlier_duplicates(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """id, name: declarations of the file with the signature of the candidate (id, file, line, text) before its line."""
    asked = candidates.select("id", "file", F.col("line").alias("at"), signature(F.col("text")).alias("signature"))
    held = found.select("file", "name", "line", signature(F.col("text")).alias("signature"))
    return asked.join(held, ["file", "signature"]).where("line < at").select("id", "name")


def hole_stats(found: DataFrame) -> DataFrame:
    """project (first part of the path), holes, files: declarations with holes and files with any."""
    rows = found.where("has_hole").withColumn("project", F.substring_index("file", "/", 1))
    return rows.groupBy("project").agg(F.count("*").alias("holes"), F.count_distinct("file").alias("files"))


def finished(found: DataFrame) -> DataFrame:
    """file, name, line, chars of named theorems and lemmas without holes."""
    return found.where("kind in ('theorem', 'lemma') and not has_hole and name <> '<anonymous>'").select("file", "name", "line", F.length("text").alias("chars"))


def file_hints(files: DataFrame, found: DataFrame) -> DataFrame:
    """file, hints, worked: see hint_count(); finished theorems, lemmas and examples before the first hole, 0 without any hole."""
    first = found.where("has_hole").groupBy("file").agg(F.min("line").alias("first"))
    worked = found.where("not has_hole and kind in ('example', 'theorem', 'lemma')").join(first, "file").where("line < first").groupBy("file").agg(F.count("*").alias("worked"))
    return files.select(F.col("path").alias("file"), hint_count(F.col("text")).cast("long").alias("hints")).join(worked, "file", "left").select("file", "hints", F.coalesce("worked", F.lit(0)).alias("worked"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, kind, name, violation: declarations deleted, changed, duplicated or (by their file) reordered.

    Both: file, kind, name, line, text. reordered: files whose common declarations, each once, stand in another order.
    """
    key = ["file", "kind", "name"]
    fold = lambda df, p: df.groupBy(*key).agg(F.count("*").alias(f"{p}n"), F.min("line").alias(f"{p}line"), F.min_by(signature(F.col("text")), "line").alias(f"{p}text"))
    joined = fold(before, "b").join(fold(after, "a"), key, "left")
    kind = F.when(F.col("an").isNull(), "deleted").when(F.col("an") > F.col("bn"), "duplicated").when(F.col("atext") != F.col("btext"), "changed")
    single = joined.select(*key, kind.alias("violation")).where("violation is not null")
    common = joined.where("an is not null")
    place = lambda c: F.row_number().over(Window.partitionBy("file").orderBy(c, "kind", "name"))
    moved = common.select("file", (place("bline") != place("aline")).alias("moved")).groupBy("file").agg(F.bool_or("moved").alias("moved")).where("moved")
    return single.unionByName(moved.select("file", F.lit("").alias("kind"), F.lit("").alias("name"), F.lit("reordered").alias("violation")))


def diagnostics(outputs: DataFrame) -> DataFrame:
    """id, file, line, column, severity, message of the `file:line:col: severity: message` lines of outputs (id, text), each once."""
    each = outputs.select("id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("l")).where(F.col("l").rlike(DIAGNOSTIC))
    part = lambda i: F.regexp_extract("l", DIAGNOSTIC, i)
    severity = F.when(part(4) == "information", "info").otherwise(part(4))
    return each.select("id", part(1).alias("file"), part(2).cast("int").alias("line"), part(3).cast("int").alias("column"), severity.alias("severity"), part(5).alias("message"))


#: Keys of a JSON diagnostic and of what holds more of them (fixed values).
SHAPE, HOLDERS = ("severity", "level", "kind", "message", "line", "range", "location"), ("items", "diagnostics", "messages", "errors", "warnings")


def _line_of(item: dict) -> int | None:
    """The line that a JSON diagnostic names: its own, that of its location, or the start of its range."""
    start = item["range"].get("start") if isinstance(item.get("range"), dict) else None
    own = [item.get(key) for key in ("line", "startLine", "start_line")]
    for value in own:
        try:
            if int(value) > 0:
                return int(value)
        except (TypeError, ValueError, OverflowError):
            pass
    if isinstance(item.get("location"), dict) and (line := _line_of(item["location"])):
        return line
    return _line_of({"line": start.get("line")}) if isinstance(start, dict) else None


def _json_items(value: object) -> Iterator[tuple[str, str, int | None]]:
    """(severity, message, line) of the diagnostics in a JSON value, whatever envelopes it has, outer ones first."""
    if isinstance(value, list):
        for child in value:
            yield from _json_items(child)
    elif isinstance(value, dict):
        if any(key in value for key in SHAPE):
            message = str(value.get("message") or value.get("text") or value.get("detail") or "").strip()
            severity = str(value.get("severity") or value.get("level") or value.get("kind") or "").strip().lower()
            low, line = message.lower(), _line_of(value)
            severity = severity or ("error" if "error:" in low else "warning" if "warning:" in low else "info" if low else "")
            if severity or message or line:
                yield severity, message, line
        for key in HOLDERS:
            if isinstance(value.get(key), (list, dict)):
                yield from _json_items(value[key])


def json_diagnostics(outputs: DataFrame) -> DataFrame:
    """id, nth, severity, message, line of the JSON diagnostics of outputs (id, text), each once a text, in their order.

    A text is one JSON value or lines of which some are; envelopes (lists, or values under `items`, `diagnostics`,
    `messages`, `errors` and `warnings`) nest to any depth that the parser takes. Texts without JSON give no row:
    diagnostics() reads their `file:line:col:` lines. severity is in lower case; a line is positive or null.
    """
    kind = "array<struct<nth:int,severity:string,message:string,line:long>>"

    @F.pandas_udf(kind)
    def parsed(texts: pd.Series) -> pd.Series:
        return pd.Series([_json_rows(text) for text in texts])

    some = outputs.where(F.col("text").rlike(r"(?m)^\s*[\[{]"))
    return some.select("id", F.inline(parsed("text")))


def _json_rows(text: str) -> list[dict]:
    values = []
    for part in (text.strip(),), [line.strip() for line in text.splitlines()]:
        for candidate in part:
            if candidate[:1] in ("[", "{"):
                try:
                    values.append(json.loads(candidate))
                except (ValueError, RecursionError):
                    pass
        if values:
            break
    found = dict.fromkeys(item for value in values for item in _json_items(value))
    return [{"nth": i, "severity": s, "message": m, "line": line if line is None or line < 1 << 63 else None} for i, (s, m, line) in enumerate(found)]


def diagnostic_counts(found: DataFrame) -> DataFrame:
    """id, errors, warnings."""
    return found.groupBy("id").agg(F.count(F.when(F.col("severity") == "error", 1)).alias("errors"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"))


def attach_diagnostics(found: DataFrame, declared: DataFrame) -> DataFrame:
    """found with `name`: the last declaration of its file that begins at or before its line, null before the first.

    As-of by one union and one window over the lines of a file.
    """
    marks = declared.select("file", "line", F.lit(0).alias("kind"), F.col("name").alias("mark"), F.lit(None).cast(found.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("message"))
    asks = found.select("file", "line", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("mark"), "id", "severity", "message")
    order = Window.partitionBy("file").orderBy("line", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(asks).withColumn("name", F.last("mark", ignorenulls=True).over(order)).where("kind = 1").select("id", "file", "line", "severity", "message", "name")


#: Counts by which files are put in order: column and direction, then the label (fixed values).
PRIORITY = (("candidate_downstream", -1), ("candidate_imports", 1), ("project_downstream", -1), ("imported_by", -1), ("difficulty", 1), ("first_difficulty", 1), ("holes", 1), ("lines", 1), ("declared", 1))


def file_order(candidates: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """scope, label, place: candidates (scope, label and the columns of PRIORITY) of a scope in their order.

    external (scope, label, rank): another order, which counts only among files that the first four columns and the two
    difficulties, divided by three, do not tell apart; files without a rank come after those with one.
    """
    keys = [F.col(c).desc() if d < 0 else F.col(c).asc() for c, d in PRIORITY]
    own = F.row_number().over(Window.partitionBy("scope").orderBy(*keys, "label"))
    ranked = candidates.withColumn("place", own)
    if external is None:
        return ranked.select("scope", "label", "place")
    coarse = [*keys[:4], F.floor(F.col("difficulty") / 3), F.floor(F.col("first_difficulty") / 3)]
    joined = ranked.join(external.select("scope", "label", "rank"), ["scope", "label"], "left")
    guarded = F.row_number().over(Window.partitionBy("scope").orderBy(*coarse, F.col("rank").asc_nulls_last(), "place"))
    return joined.withColumn("place", guarded).select("scope", "label", "place")


#: Words that make a declaration hard or easy, with their weights (fixed values).
HARD = {"putnam": 5, "imo": 4, "aime": 3, "amc": 2, "numbertheory": 2, "olympiad": 3, "convexhull": 2, "euclideanspace": 2, "volume": 2, "polynomial": 1, "finset": 1, "strictmono": 1}
EASY = {"mathd": 2, "linear": 1, "lipschitz": 1, "abs": 1}


def hint_count(text: Column) -> Column:
    """Lines of #check, and how often a text says hint, useful lemma and useful mathlib."""
    low = F.lower(text)
    return F.regexp_count(text, F.lit(r"(?m)^\s*#check\b")) + F.regexp_count(low, F.lit("hint")) + F.regexp_count(low, F.lit("useful lemma")) + F.regexp_count(low, F.lit("useful mathlib"))


def file_difficulty(files: DataFrame, found: DataFrame, first: int = 8) -> DataFrame:
    """file, difficulty, first_difficulty, hints, worked of each file: from its first `first` declarations with holes.

    A declaration has 4 points, and those of its words, and one each for over 12 and 24 lines, not below 0. A file has
    two thirds of its first one's and a third of their mean (half-even), less at most 4 for hints and worked examples.
    """
    both = F.concat(F.lower("name"), F.lit("\n"), F.lower("text"))
    score = F.lit(4)
    for words, sign in ((HARD, 1), (EASY, -1)):
        for word, weight in words.items():
            score = score + F.when(both.contains(word), sign * weight).otherwise(0)
    span = F.greatest(F.lit(1), F.col("end_line") - F.col("line") + 1)
    score = F.greatest(F.lit(0), score + F.when(span > 12, 1).otherwise(0) + F.when(span > 24, 1).otherwise(0))
    place = F.row_number().over(Window.partitionBy("file").orderBy("line"))
    pending = found.where("has_hole").withColumns({"score": score, "place": place}).where(F.col("place") <= first)
    scored = pending.groupBy("file").agg(F.min_by("score", "line").alias("first_difficulty"), F.round(F.avg("score"), 2).alias("mean"))
    hints = file_hints(files, found)
    joined = hints.join(scored, "file", "left")
    discount = F.least(F.lit(4), F.floor(F.col("hints") / 2) + F.floor(F.col("worked") / 3))
    whole = F.greatest(F.lit(0), F.bround((F.col("first_difficulty") * 2 + F.col("mean")) / 3, 0).cast("long") - discount)
    return joined.select("file", F.coalesce(whole, F.lit(0)).cast("long").alias("difficulty"), F.coalesce("first_difficulty", F.lit(0)).alias("first_difficulty"), "hints", "worked")


def horizon(results: DataFrame, found: DataFrame, assignments: DataFrame) -> DataFrame:
    """results (id, file, name) with access: usable, assigned_declaration_unavailable or future_same_file_unavailable.

    assignments: file, target. A result or target counts only if exactly one declaration of the file has its whole or
    its short name; what is not certain stays usable.
    """
    def lines(df: DataFrame, name: str, as_: str) -> DataFrame:
        names = F.array_distinct(F.array(F.trim(name), F.element_at(F.split(F.trim(F.col(name)), r"\."), -1)))
        asked = df.select("file", name).distinct().withColumn("n", F.explode(names))
        met = asked.join(found.select("file", F.col("name").alias("n"), "line"), ["file", "n"])
        return met.groupBy("file", name).agg(F.count("*").alias("times"), F.min("line").alias(as_)).where("times = 1").drop("times")

    target = assignments.join(lines(assignments, "target", "assigned"), ["file", "target"]).select("file", "assigned")
    rows = results.join(lines(results, "name", "at"), ["file", "name"], "left").join(target, "file", "left")
    access = F.when(F.col("at") == F.col("assigned"), "assigned_declaration_unavailable").when(F.col("at") > F.col("assigned"), "future_same_file_unavailable").otherwise("usable")
    return rows.select("id", "file", "name", access.alias("access"))


def placement(found: DataFrame, concepts: Column, modules: DataFrame, duplicates: DataFrame, promotions: DataFrame) -> DataFrame:
    """file, name, status, modules of declarations (file, name, digest, text): where reusable ones may go.

    concepts: array<string> of a row; modules: concept, module; duplicates and (verified) promotions: name, digest. A
    declaration that could move is blocked if it names one of its file that is not approved and shares no module.
    """
    rows = found.withColumn("concepts", concepts)
    targets = rows.select("file", "name", F.explode("concepts").alias("concept")).join(modules, "concept").groupBy("file", "name").agg(F.array_sort(F.collect_set("module")).alias("modules"))
    flag = lambda df, as_: df.select("name", "digest").distinct().withColumn(as_, F.lit(True))
    rows = rows.join(targets, ["file", "name"], "left").join(flag(promotions, "promoted"), ["name", "digest"], "left").join(flag(duplicates, "repeated"), ["name", "digest"], "left")
    rows = rows.withColumn("modules", F.coalesce("modules", F.array().cast("array<string>")))
    status = F.when(F.col("promoted"), "approved_for_promotion").when(F.col("repeated"), "promotion_candidate").when(F.size("modules") > 0, "placement_review").otherwise("local_default")
    rows = rows.withColumn("status", status)
    words = rows.select("file", "name", F.col("modules").alias("own"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_']+)"), 1))).alias("other"))
    named = rows.select("file", F.col("name").alias("other"), F.col("status").alias("of"), F.col("modules").alias("theirs"))
    blocked = words.join(named, ["file", "other"]).where((F.col("other") != F.col("name")) & (F.col("of") != "approved_for_promotion") & ~F.arrays_overlap("own", "theirs")).select("file", "name").distinct().withColumn("blocked", F.lit(True))
    out = F.when(F.col("blocked") & (F.col("status") != "local_default"), "blocked_local_dependency").otherwise(F.col("status"))
    return rows.join(blocked, ["file", "name"], "left").select("file", "name", out.alias("status"), F.array_join("modules", ",").alias("modules"))


def namespace_at(lines: Column, line: Column) -> Column:
    """The names of the namespaces open before a line (from 1) of a file's lines, dot-joined: a fold over the lines before it."""

    def step(stack: Column, raw: Column) -> Column:
        opened, closes = F.regexp_extract(raw, r"^\s*namespace\s+([A-Za-z_][\w.']*)", 1), raw.rlike(r"^\s*end\b")
        named = F.regexp_extract(raw, r"^\s*end\s+([A-Za-z_][\w.']*)", 1)
        back = F.array_position(F.reverse(stack), named).cast("int")
        drop = F.when((named != "") & (back > 0), back).otherwise(F.least(F.lit(1), F.size(stack)))
        return F.when(opened != "", F.concat(stack, F.array(opened))).when(closes, F.slice(stack, 1, F.size(stack) - drop)).otherwise(stack)

    return F.array_join(F.aggregate(F.slice(lines, 1, F.greatest(line - 1, F.lit(0))), F.array().cast("array<string>"), step), ".")


def document_assets(files: DataFrame, paths: DataFrame) -> DataFrame:
    r"""src, asset, kind of files (path, text): the existing paths (path) that their bibliographies and figures name.

    \bibliography, \addbibresource: .bib and .bbl; \includegraphics, \epsfig: as named or with a picture's ending. Looked
    up beside the file, by equality of each candidate.
    """
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    books = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"\\(?:bibliography|addbibresource)\s*\{([^{}]+)\}"), 1), lambda v: F.transform(F.split(v, ","), lambda p: F.trim(p))))
    pictures = F.regexp_extract_all("text", F.lit(r"(?i)\\(?:includegraphics|epsfig)\s*(?:\[[^\]]*\])?\s*\{([^{}]+)\}"), 1)
    endings = {"bibliography": (".bib", ".bbl"), "figure": ("", ".png", ".jpg", ".jpeg", ".pdf", ".eps", ".svg")}
    found = None
    for kind, refs in (("bibliography", books), ("figure", pictures)):
        each = files.select(F.col("path").alias("src"), folder.alias("folder"), F.explode(F.array_distinct(refs)).alias("ref")).withColumn("bare", F.regexp_replace("ref", r"\.bib$", "") if kind == "bibliography" else F.col("ref"))
        tried = each.select("src", F.explode(F.array(*[F.concat("folder", "bare", F.lit(e)) for e in endings[kind]])).alias("asset"), F.lit(kind).alias("kind"))
        found = tried if found is None else found.unionByName(tried)
    return found.join(paths.select(F.col("path").alias("asset")).distinct(), "asset", "left_semi").select("src", "asset", "kind").distinct()
