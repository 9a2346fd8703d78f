"""Completeness of a plan: source blocks against the entries that plan them and the declarations that were made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of an entry's fields, the first that has a value counts (fixed values).
LOCATOR = ("Source locator", "Source location", "Source line/page", "Source lines", "Source page")
PLANNED = ("Planned Lean declarations", "Planned Lean declaration", "Formal names", "Formal name", "Lean declarations", "Lean declaration")
QUALIFIERS, COVERAGE, SCOPE = ("Source qualifiers", "Source qualifier", "Fidelity axes"), ("Lean coverage", "Formal coverage", "Lean statement coverage"), ("Scope changes", "Intentional scope changes", "Scope change")
VERIFIED, NOTES, REVIEW = ("Statement verification status", "Statement/source verification", "Source verification status", "Verification status"), ("Source proof / prover notes", "Proof strategy", "Prover notes"), "Formal statement review"
#: Values that are none, words of unresolved and of approved ones, kinds that need notes, marks of notes (fixed values).
MISSING, NO_NOTES = ("", "_pending_", "pending", "todo", "tbd"), ("none", "none needed", "n/a")
UNRESOLVED = r"(?i)\b(_pending_|pending|todo|tbd|missing|unresolved|unchecked|unverified|not covered|not formalized|omitted|weakened)\b"
APPROVED = r"(?i)\b(approved|verified|reviewed|accepted)\b"
NEED_NOTES, MARKS = ("theorem", "lemma", "proposition", "corollary"), ("source proof", "proof sketch", "proof strategy", "prover notes", "paper proof")
NAME = r"^[A-Za-z_][A-Za-z0-9_'.]*$"


def _has(entry: Column, label: str, found: Column) -> Column:
    """found, looked for only in entries that name the label at all."""
    return F.when(F.contains(F.lower(entry), F.lit(label.lower())), found).otherwise(F.when(entry.isNotNull(), F.lit("")))


def _value(entry: Column, label: str) -> Column:
    return _has(entry, label, F.trim(F.regexp_extract(entry, rf"(?im)^\s*-\s*{label}\s*:\s*(.*?)\s*$", 1)))


def _block(entry: Column, label: str) -> Column:
    """A field with the lines under it, up to the next field at the margin."""
    return _has(entry, label, F.trim(F.regexp_extract(entry, rf"(?i)((?<=^|\n)[ \t]*-\s*{label}\s*:[\s\S]*?)(?=\n-\s*[A-Za-z][A-Za-z0-9 /_-]{{0,80}}\s*:|\z)", 1)))


def _first(entry: Column, labels: tuple[str, ...], *of) -> Column:
    found = [F.nullif(f(entry, label), F.lit("")) for label in labels for f in (of or (_value,))]
    return F.coalesce(*found, F.lit(""))


def _missing(value: Column) -> Column:
    return F.lower(F.trim(value)).isin(*MISSING)


def _open(value: Column, words: str | None = None) -> Column:
    pending = _missing(value) | value.rlike(r"(?i):\s*(_pending_|pending|todo|tbd)\s*$")
    return pending | value.rlike(words) if words else pending


def planned_names(value: Column) -> Column:
    """Names of declarations that a field plans: of declarations and in backticks, else between commas."""
    made = F.regexp_extract_all(value, F.lit(r"(?m)^\s*(?:theorem|lemma|def|abbrev|opaque|structure|class|instance|example)\s+([A-Za-z_][A-Za-z0-9_'.]*)\b"), 1)
    inline = F.regexp_replace(value, r"(?i)```(?:lean)?", "")
    bare = lambda names: F.filter(F.transform(names, lambda n: F.substring_index(F.trim(F.substring_index(F.trim(n), ":", 1)), " ", 1)), lambda n: n.rlike(NAME))
    marked = F.array_distinct(F.concat(bare(made), bare(F.regexp_extract_all(inline, F.lit(r"(?<!`)`([^`\n]+)`(?!`)"), 1))))
    return F.when(F.size(marked) > 0, marked).otherwise(F.array_distinct(bare(F.split(inline, r"[,;]|\band\b"))))


def inventory_issues(items: DataFrame, entries: DataFrame, declarations: DataFrame, source: str = "") -> DataFrame:
    """label, issue, name: what a plan lacks, one row an issue; name: of the declaration, if the issue is about one.

    items: source blocks label, kind, has_proof; entries: label, text (bullets `- Field: value`, with lines under them);
    declarations: name, kind, comment (what stands above). issue: missing_entry; else locator, locator_source (that of
    `source`, if given), planned, planned_names, missing_declaration, review, qualifiers, coverage, scope, verification,
    not_approved, notes, notes_needed, comment_notes. Of entries with one label the longest counts; blank ones are none.
    """
    entry = entries.where(F.col("text").rlike(r"\S")).groupBy("label").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("entry"))
    rows = items.select("label", F.lower(F.trim("kind")).alias("kind"), F.coalesce("has_proof", F.lit(False)).alias("has_proof")).join(entry, "label", "left")
    e = F.col("entry")
    fidelity = lambda labels: _first(e, labels, _block, _value)
    # Fields are columns of their own, so that each is looked for once a row, however often it is named.
    rows = rows.withColumns({"planned": _first(e, PLANNED), "listed": _first(e, tuple(p for p in PLANNED if "Lean" in p), _block), "review": fidelity((REVIEW,)), "qualifiers": fidelity(QUALIFIERS), "coverage": fidelity(COVERAGE), "scope": fidelity(SCOPE)})
    planned, listed = F.col("planned"), F.col("listed")
    plan = F.when(_missing(planned), listed).when(~F.contains(planned, listed), F.concat_ws("\n", planned, listed)).otherwise(planned)
    rows = rows.withColumns({"locator": _first(e, LOCATOR), "plan": plan, "notes": _first(e, NOTES), "verified": _first(e, VERIFIED), "needs": F.col("has_proof") | F.col("kind").isin(*NEED_NOTES)})
    rows = rows.withColumn("names", F.when(e.isNotNull() & ~_missing(F.col("plan")), planned_names(F.col("plan"))))
    there = e.isNotNull()
    when = {
        "missing_entry": ~there, "locator": there & _missing(F.col("locator")), "locator_source": there & ~_missing(F.col("locator")) & F.lit(bool(source)) & ~F.contains("locator", F.lit(source)), "planned": there & _missing(F.col("plan")),
        "planned_names": F.size("names") == 0, "review": there & _open(F.col("review")), "qualifiers": there & _open(F.col("qualifiers"), UNRESOLVED), "coverage": there & _open(F.col("coverage"), UNRESOLVED),
        "scope": there & _open(F.col("scope"), UNRESOLVED), "verification": there & _missing(F.col("verified")), "not_approved": there & ~_missing(F.col("verified")) & ~F.col("verified").rlike(APPROVED),
        "notes": there & _missing(F.col("notes")), "notes_needed": there & F.col("needs") & F.lower("notes").isin(*NO_NOTES),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in when.items()]), lambda i: i.isNotNull())
    single = rows.select("label", F.explode(found).alias("issue"), F.lit(None).cast("string").alias("name"))
    named = rows.select("label", "needs", F.explode("names").alias("name")).join(declarations.groupBy("name").agg(F.first("kind").alias("made"), F.first("comment").alias("comment")), "name", "left")
    noted = F.exists(F.array(*map(F.lit, MARKS)), lambda m: F.contains(F.lower(F.coalesce("comment", F.lit(""))), m))
    about = F.when(F.col("made").isNull(), "missing_declaration").when(F.col("needs") & F.lower("made").isin("theorem", "lemma", "example") & ~noted, "comment_notes")
    return single.unionByName(named.select("label", about.alias("issue"), "name").where("issue is not null"))
