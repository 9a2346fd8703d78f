"""Operators over the statements of declarations: what binders, premises and results say, and what they add to a parent.

One pass cuts each declaration at its top-level colon into groups of binders and a result; everything else is joins over
the premises, tokens and normal forms that come of it.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut, shuffled, spread

#: Modifiers, kinds and names that begin a declaration; brackets (fixed values).
HEAD = re.compile(
    r"\s*(?:(?:@\[[^\]]*\]|@[A-Za-z0-9_.]+|private|protected|noncomputable|unsafe|partial|nonrec|scoped|local)\s+)*"
    r"(theorem|lemma|example|def|abbrev|opaque|axiom|instance|class|structure|inductive)\b\s*(«[^»]+»|[A-Za-z_À-￿][^\s:(){}\[\]⦃]*)?"
)
BRACKETS = {"(": ")", "{": "}", "[": "]", "⦃": "⦄", "⟨": "⟩"}
ANY_BRACKET = re.compile("[" + re.escape("".join(BRACKETS) + "".join(BRACKETS.values())) + "]")
#: Statuses of a parent that is still open (fixed values).
OPEN_STATUSES = ("conjectured", "stated", "audited", "proving", "blocked", "split")
#: Tokens of a statement, other spellings of them, and those that count (fixed values).
TOKEN = r"(?U)[\p{L}_][\w']*(?:\.[\p{L}_][\w']*)*|\d+|<->|->|=>|:=|<=|>=|\S"
IDENTIFIER = r"(?U)^[\p{L}_][\w']*(?:\.[\p{L}_][\w']*)*$"
SPELLINGS = {"Nat": "ℕ", "Rat": "ℚ", "->": "→", "=>": "⇒", "<=": "≤", ">=": "≥"}
CONNECTIVES, RELATIONS = ("∧", "∨"), ("=", "≠", "<", ">", "≤", "≥", "∣")
EXISTS = r"(?i)(?:∃|\bexists\b)\s+([^,:]+?)\s*:"
#: Signs that a type is a proposition (fixed values).
PROPOSITION = r"∃|∧|∨|¬|≠|≤|≥|∈|∉|(?<![:<>=!])=(?!=)|(?<![-<])<(?![=-])|(?<![-=>])>(?![=])|\b(?:False|True|Prop)\b"
#: A condition that a helper must keep when it derives the second from the third (fixed values).
SIDE_CONDITION, DERIVED, SOURCE = "Disjoint", "physicalPieces", "playEnds"
#: Likeness of an instance to its parent from which it is one (fixed value).
NEAR = 0.96
#: Routes and words of objectives that look for finite instances (fixed values).
FINITE_ROUTES = ("small-case-invariant", "boundary-counterexample-probe", "evidence-to-helper")
FINITE_WORDS = r"(?i)\b(?:boundary cases?|counterexamples?|finite(?:-instance)?|instances?|small cases?|witness(?:es)?)\b"

#: Tokens of a proof, identifiers among them, and the words of the proof language that stay as they are (fixed values).
BODY_TOKEN, BODY_NAME = r"[A-Za-z_][A-Za-z0-9_'.-]*|\d+|:=|=>|<-|->|[^\s]", r"^[A-Za-z_][A-Za-z0-9_'.-]*$"
PROOF_WORDS = (
    "aesop", "all_goals", "any_goals", "apply", "assumption", "at", "by", "by_cases", "calc", "case", "cases", "change", "constructor", "contradiction", "convert", "decide", "do", "dsimp", "else", "exact", "first", "fun", "have", "if", "induction",
    "intro", "intros", "left", "let", "linarith", "match", "native_decide", "next", "nlinarith", "norm_num", "obtain", "omega", "only", "positivity", "rcases", "refine", "repeat", "right", "ring", "ring_nf", "rw", "rwa", "set", "show", "simp",
    "simp_all", "simpa", "subst", "suffices", "tauto", "then", "trivial", "unfold", "using", "with",
)

PARSED = "kind string, name string, groups array<struct<opens:string,names:array<string>,type:string,text:string>>, binders string, result string, alpha string, body string"


def _uncommented(text: str) -> str:
    """text with comments (nested ones too) and the insides of strings as blanks."""
    out, depth = [], 0
    for m in re.finditer(r'/-|-/|--[^\n]*|"(?:\\.|[^"\\])*"|[^/"-]+|(?s:.)', text):
        piece = m.group()
        if piece == "/-":
            depth += 1
        elif piece == "-/" and depth:
            depth -= 1
        elif not depth:
            out.append(" " if piece.startswith("--") else '""' if len(piece) > 1 and piece[0] == '"' else piece)
    return "".join(out)


def _close(text: str, start: int) -> int:
    """The place of the bracket that closes the one at start; -1 for none."""
    stack = []
    for m in ANY_BRACKET.finditer(text, start):
        if m.group() in BRACKETS:
            stack.append(BRACKETS[m.group()])
        elif stack and m.group() == stack[-1]:
            stack.pop()
            if not stack:
                return m.start()
    return -1


def _top_level(text: str, marks: tuple[str, ...]) -> list[int]:
    """Places of marks outside brackets."""
    out, i = [], 0
    ahead = re.compile("[" + re.escape("".join(BRACKETS)) + "]|" + "|".join(map(re.escape, marks)))
    while m := ahead.search(text, i):
        i = m.start()
        if text[i] in BRACKETS and (end := _close(text, i)) >= 0:
            i = end
        elif text.startswith(marks, i):
            out.append(i)
        i += 1
    return out


def compact(value: str) -> str:
    """A type without comments, runs of blanks, and brackets around the whole."""
    text = " ".join(_uncommented(value).split())
    while text.startswith("(") and _close(text, 0) == len(text) - 1:
        text = text[1:-1].strip()
    return text.removeprefix(":").strip()


def parse(text: str | None) -> dict | None:
    """PARSED of a declaration; None if it is none. result is empty where there is no top-level colon."""
    bare = _uncommented(text or "")
    head = HEAD.match(bare)
    if head is None:
        return None
    core, bound, body = bare[head.end() :], 0, ""
    for m in re.finditer(r"\b(?:let|have)\b|:=|\bwhere\b", core):
        if m.group() in ("let", "have"):
            bound += 1
        elif m.start() in _top_level(core[: m.end()], (m.group(),)):
            if m.group() == ":=" and bound:
                bound -= 1
                continue
            core, body = core[: m.start()], core[m.end() :].strip() if m.group() == ":=" else ""
            break
    groups, at = [], 0
    colons = [i for i in _top_level(core, (":",)) if not core.startswith(":=", i)]
    stop = colons[0] if colons else len(core)
    while at < stop:
        if core[at] in BRACKETS and (end := _close(core, at)) >= 0:
            inner = core[at + 1 : end]
            inside = [i for i in _top_level(inner, (":",)) if not inner.startswith(":=", i)]
            names = inner[: inside[0]].split() if inside else []
            groups.append({"opens": core[at], "names": names, "type": compact(inner[inside[0] + 1 :]) if inside else "", "text": " ".join(inner.split())})
            at = end
        at += 1
    binders, result = " ".join(core[:stop].split()), " ".join(core[stop + 1 :].split())
    return {"kind": head[1], "name": head[2] or "", "groups": groups, "binders": binders, "result": result, "alpha": _alpha(head[1], core, groups), "body": body}


def _alpha(kind: str, core: str, groups: list[dict]) -> str:
    """The statement without its name, the names of its leading binders numbered; `_` and what has the name of none stay."""
    number: dict[str, str] = {}
    for group in groups:
        if not group["names"] or any(not re.fullmatch(r"(?:[^\W\d]|_)[\w']*", n) for n in group["names"]):
            break
        for name in group["names"]:
            if name != "_":
                number.setdefault(name, f"\x02{len(number)}")
    bare = " ".join(core.split())
    if number:
        names = "|".join(re.escape(n) for n in sorted(number, key=len, reverse=True))
        bare = re.sub(rf"(?<![\w'])(?:{names})(?![\w'])", lambda m: number[m.group()], bare)
    return f"{kind} {bare}"


def parsed(text: Column | str) -> Column:
    """PARSED of each declaration, with nulls for what is none."""
    return F.pandas_udf(_parsed, PARSED)(text)


def _parsed(texts: pd.Series) -> pd.DataFrame:
    empty = dict.fromkeys(("kind", "name", "groups", "binders", "result", "alpha", "body"))
    return pd.DataFrame([parse(t) or empty for t in texts], columns=list(empty))


def compacted(text: Column | str) -> Column:
    return F.pandas_udf(_compacted, "string")(text)


def _compacted(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: compact(t or ""))


def _short(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def covered(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """id, existing, reason of candidates that stand in their file before their target already.

    candidates: id, file, target, text; found: declarations file, name, line, text. reason: `same_name`, the first
    earlier declaration of the candidate's name; else `same_signature`, the first that says the same but for its own
    name and those of leading binders. A target that the file does not have just once covers nothing.
    """
    decl = found.select("file", "name", "line", F.md5(parsed("text")["alpha"]).alias("alpha"), _short(F.col("name")).alias("short"))
    asked = candidates.select("id", "file", "target", parsed("text").alias("p")).where("p.name <> ''").select("id", "file", "target", _short(F.col("p.name")).alias("short"), F.md5("p.alpha").alias("alpha"))
    names = F.explode(F.array_distinct(F.array("target", _short(F.col("target"))))).alias("alias")
    targets = asked.select("id", "file", names).join(shuffled(found.groupBy("file", F.col("name").alias("alias")).agg(F.min("line").alias("line"), F.count("*").alias("times"))), ["file", "alias"]).groupBy("id").agg(F.min("line").alias("until"), F.sum("times").alias("n")).where("n = 1")
    asked = asked.join(shuffled(targets.select("id", "until")), "id")
    first = decl.groupBy("file", "short", "alpha").agg(F.min(F.struct("line", "name")).alias("d"))
    of_name = first.groupBy("file", "short").agg(F.min("d").alias("d"))
    named = asked.join(shuffled(of_name), ["file", "short"]).where("d.line < until").select("id", F.col("d.name").alias("existing"), F.lit("same_name").alias("reason"))
    # Of what says the same, the first, and the first of another short name than that has, are all that can be asked for.
    other = F.col("short") != F.col("least.short")
    of_alpha = first.join(shuffled(first.groupBy("file", "alpha").agg(F.min(F.struct("d", "short")).alias("least"))), ["file", "alpha"]).groupBy("file", "alpha", "least").agg(F.min(F.when(other, F.col("d"))).alias("next"))
    alike = asked.join(shuffled(of_alpha), ["file", "alpha"]).withColumn("d", F.when(F.col("short") != F.col("least.short"), F.col("least.d")).otherwise(F.col("next")))
    alike = alike.where("d.line < until").select("id", F.col("d.name").alias("existing"), F.lit("same_signature").alias("reason"))
    return named.unionByName(alike.join(shuffled(named.select("id")), "id", "left_anti"))


def earlier_pairs(asked: DataFrame, held: DataFrame, key: str, block: int = 512) -> DataFrame:
    """id, name: of asked (id, file, at, key) and held (file, name, line, key), those of one file and key with line < at.

    Pairs are as many as they are, so a large group is dealt out: those asked in blocks, each of which meets all held.
    """
    sizes = asked.groupBy("file", key).agg(F.ceil(F.count("*") / block).alias("blocks"))
    # A group is met as often as it has blocks; a row of it that is asked lies in one of them.
    dealt = asked.join(sizes, ["file", key]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).drop("blocks")
    met = held.join(sizes, ["file", key]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    keys = ["file", key, "block"]
    return spread(met, *keys).join(spread(dealt, *keys).hint("merge"), keys).where("line < at").select("id", "name")


def duplicates_but_for_binders(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """id, name: declarations of the file before the candidate's line (id, file, line, text) that say the same but for names."""
    asked = cut(candidates.select("id", "file", F.col("line").alias("at"), F.md5(parsed("text")["alpha"]).alias("alpha")))
    held = found.select("file", "name", "line", F.md5(parsed("text")["alpha"]).alias("alpha"))
    return earlier_pairs(asked, held, "alpha")


def _stripped(text: str) -> str:
    text = " ".join(text.split())
    while text.startswith("(") and _close(text, 0) == len(text) - 1:
        text = text[1:-1].strip()
    return text


def negation_keys(text: str | None, of_target: bool) -> list[str]:
    """What the helper's statement refutes, or by what the target's is refuted: pointwise, and closed over its binders."""
    said = parse(text)
    if said is None or said["kind"] not in ("theorem", "lemma") or not said["result"]:
        return []
    binders, result = said["binders"], _stripped(said["result"])
    if of_target:
        closed = [f"\x02{_stripped(f'∀ {binders}, {said["result"]}')}"] if binders else []
        return [f"{binders}\x02{result}", *closed]
    if result.startswith("¬"):
        body = _stripped(result[1:])
    elif m := re.match(r"Not\b(.+)$", result, re.DOTALL):
        body = _stripped(m[1])
    else:
        return []
    return [f"{binders}\x02{body}"] if body else []


def _refutes(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: negation_keys(t, False))


def _refuted_by(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: negation_keys(t, True))


def universal_obstructions(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("evidence_for",)) -> DataFrame:
    """target, helper: proved helpers that refute the whole statement of a node of their file, which an edge of `kinds` names.

    nodes: id, file, status, statement; edges: src (the helper), dst, kind. The helper either repeats the binders and
    negates the result, or negates the statement closed over all binders, up to blanks and outer brackets. A weaker
    negation (of an instance, under more premises, or in other words) is none.
    """
    linked = edges.where(F.col("kind").isin(*kinds)).select("src", "dst").distinct()
    helpers = nodes.where("status = 'proved'").select(F.col("id").alias("src"), "file", F.explode(F.pandas_udf(_refutes, "array<string>")("statement")).alias("key"))
    targets = nodes.select(F.col("id").alias("dst"), "file", F.explode(F.pandas_udf(_refuted_by, "array<string>")("statement")).alias("key"))
    met = helpers.join(linked, "src").join(targets, ["dst", "file", "key"])
    return met.select(F.col("dst").alias("target"), F.col("src").alias("helper")).distinct()


def dominated_jobs(jobs: DataFrame, nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("evidence_for",)) -> DataFrame:
    """job_id, target: jobs (job_id, archetype, route_key, objective, target) that look for finite instances of what is refuted."""
    finite = F.trim("route_key").isin(*FINITE_ROUTES) | F.col("objective").rlike(FINITE_WORDS)
    asked = jobs.where((F.trim("archetype") == "empirical") & F.coalesce(finite, F.lit(False)))
    return asked.join(universal_obstructions(nodes, edges, kinds).select("target"), "target", "left_semi").select("job_id", "target")


def tokens(text: Column, grouping: bool = True) -> Column:
    """The tokens of a statement in one spelling; grouping: with round brackets."""
    spelled = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), lambda t: F.coalesce(F.element_at(spelled, t), t))
    return found if grouping else F.filter(found, lambda t: ~t.isin("(", ")"))


def _profile(result: Column) -> Column:
    """struct(variables, logical, relations): the existential variables, connected parts and relations of a result."""
    said = tokens(result)
    names = F.transform(F.regexp_extract_all(result, F.lit(EXISTS), 1), lambda v: F.size(F.filter(F.regexp_extract_all(v, F.lit(TOKEN), 0), lambda t: t.rlike(IDENTIFIER))))
    variables = F.when(F.exists(names, lambda n: n == 0), 0).otherwise(F.aggregate(names, F.lit(0), lambda a, n: a + n))
    count = lambda words: F.size(F.filter(said, lambda t: t.isin(*words)))
    return F.struct(variables.alias("variables"), F.when(F.size(said) > 0, count(CONNECTIVES) + 1).otherwise(0).alias("logical"), count(RELATIONS).alias("relations"))


def _not_reducing(parent: Column, helper: Column) -> Column:
    """Whether a helper (PARSED) with its parent's premises keeps all of the burden of an existential result."""
    groups = lambda p: F.transform(p["groups"], lambda g: tokens(g["text"], False))
    a, b = _profile(parent["result"]), _profile(helper["result"])
    real = (parent["result"] != "") & (helper["result"] != "") & (groups(parent) == groups(helper))
    witnessed = (a["variables"] > 0) & (b["variables"] > 0) & (F.greatest(a["logical"], a["relations"]) >= 2)
    return F.coalesce(real & witnessed & (b["variables"] >= a["variables"]) & (b["logical"] >= a["logical"]) & (b["relations"] >= a["relations"]), F.lit(False))


def _instance(parent: pd.Series, helper: pd.Series, parameter: pd.Series) -> pd.DataFrame:
    """The literal with which a parent's tokens are most like a helper's, and that likeness."""
    rows = []
    for of_parent, of_helper, name in zip(parent, helper, parameter, strict=True):
        best = (None, 0.0)
        plain = [t for t in of_helper if t not in "()"]
        for literal in dict.fromkeys(t for t in of_helper if t.isdecimal()):
            said = [literal if t == name else t for t in of_parent]
            same = said == list(of_helper)
            like = 1.0 if same else difflib.SequenceMatcher(None, [t for t in said if t not in "()"], plain, autojunk=False).ratio()
            if like > best[1]:
                best = (literal, like)
            if same:
                break
        rows.append(best)
    return pd.DataFrame(rows, columns=["literal", "similarity"])


def admission(candidates: DataFrame, parents: DataFrame) -> DataFrame:
    """id, admitted, reason, parameter, literal, reducing of proposed helpers (id, parent_id, text) of parents (id, text).

    Not admitted: `dropped_disjointness`, a helper that derives DERIVED from SOURCE without its parent's SIDE_CONDITION;
    `closed_instance`, one whose result is that of its parent with a literal for its only natural-number parameter (up
    to a likeness of NEAR). What does not parse, or is not such a shape for sure, is admitted. reducing is false where
    the helper keeps its parent's premises and at least its witnesses, connectives and relations.
    """
    p, h = F.col("p"), F.col("h")
    over = parents.select(F.col("id").alias("parent_id"), parsed("text").alias("p"))
    rows = candidates.select("id", "parent_id", parsed("text").alias("h")).join(over, "parent_id", "left")
    proved = lambda s: s["kind"].isin("theorem", "lemma") & (s["result"] != "") & (s["name"] != "")
    rows = rows.withColumns({"known": F.coalesce(proved(p) & proved(h), F.lit(False)), "pt": tokens(p["result"]), "ht": tokens(h["result"]), "hs": tokens(F.concat_ws(" ", h["binders"], h["result"]))})
    nat = lambda s: F.array_distinct(F.flatten(F.transform(F.filter(s["groups"], lambda g: F.trim(F.substring_index(g["type"], ":=", 1)).isin("Nat", "ℕ") & F.forall(g["names"], lambda n: n.rlike(IDENTIFIER))), lambda g: g["names"])))
    has = F.array_contains
    dropped = has("pt", SIDE_CONDITION) & has("pt", DERIVED) & has("ht", DERIVED) & F.exists("hs", lambda t: (t == SOURCE) | t.endswith(f".{SOURCE}")) & ~has("hs", SIDE_CONDITION)
    relevant = F.array_intersect(nat(p), F.col("pt"))
    names = lambda c: F.filter(F.array_distinct(c), lambda t: t.rlike(IDENTIFIER))
    parameter = F.when(F.size(relevant) == 1, F.element_at(relevant, 1))
    closed = ~has("ht", parameter) & (F.size(F.array_intersect(nat(h), F.col("ht"))) == 0) & (F.size(F.array_except(names(F.col("ht")), F.array_remove(names(F.col("pt")), parameter))) == 0)
    rows = rows.withColumns({"dropped": F.col("known") & dropped, "parameter": F.when(F.col("known"), parameter)})
    rows = rows.withColumn("ask", F.coalesce(F.col("parameter").isNotNull() & closed & F.exists("ht", lambda t: t.rlike(r"^\d+$")), F.lit(False)))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("met", F.pandas_udf(_instance, "literal string, similarity double")(F.when(F.col("ask"), F.col("pt")).otherwise(none), F.when(F.col("ask"), F.col("ht")).otherwise(none), "parameter"))
    instance = F.col("ask") & (F.col("met.similarity") >= NEAR)
    reason = F.when(F.coalesce("dropped", F.lit(False)), "dropped_disjointness").when(F.coalesce(instance, F.lit(False)), "closed_instance")
    told = reason == "closed_instance"
    return rows.select("id", reason.isNull().alias("admitted"), reason.alias("reason"), F.when(told, F.col("parameter")).alias("parameter"), F.when(told, F.col("met.literal")).alias("literal"), (~F.when(F.col("known"), _not_reducing(p, h)).otherwise(False)).alias("reducing"))


def _contains(whole: Column, part: Column) -> Column:
    """Whether a type contains another as a whole, not within a longer name."""
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_'.])\Q"), F.replace(part, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9_'.])"))
    return (part != "") & ((whole == part) | F.rlike(whole, quoted))


def _arrows(types: pd.Series) -> pd.Series:
    return types.map(lambda t: bool(_top_level(t or "", ("→", "->"))))


def conditional_helpers(nodes: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """id, obligations, unresolved, wrapper: proved helpers that only move the burden of an open parent, not yet used there.

    nodes: id, file, name, status, statement; edges: src, dst, kind (split_of from child to parent, depends_on from
    parent to child); found: declarations file, name, text. An obligation is an explicit premise that no open parent of
    the helper's file has, and that is a proposition over arrows or a quantifier, or contains a parent's result. It is
    resolved if a proved node states it, or one that an edge joins to the helper or its parents. wrapper: the helper has
    the parent's premises and keeps all of its existential result. A helper that a parent's proof names is none.
    Names that a file declares twice, or not at all, tell nothing.
    """
    both = edges.where("kind = 'split_of'").select(F.col("src").alias("id"), F.col("dst").alias("parent"))
    both = both.unionByName(edges.where("kind = 'depends_on'").select(F.col("dst").alias("id"), F.col("src").alias("parent"))).distinct()
    once = found.groupBy("file", "name").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    names = nodes.select("id", "file", "status", F.col("name").alias("full"), F.explode(F.array_distinct(F.array("name", _short(F.col("name"))))).alias("name"))
    told = names.join(once, ["file", "name"]).groupBy("id", "file", "status", "full").agg(F.sum("n").alias("n"), F.first("text").alias("text")).where("n = 1")
    told = told.select("id", "file", "status", "full", "text", parsed("text").alias("p"))
    of_parent = told.where(F.col("status").isin(*OPEN_STATUSES)).select(F.col("id").alias("parent"), F.col("file").alias("of_file"), F.col("text").alias("of_text"), F.col("p").alias("of"))
    is_open = nodes.where(F.col("status").isin(*OPEN_STATUSES)).select(F.col("id").alias("parent"))
    open_parents = both.join(is_open, "parent", "left_semi")
    pairs = told.where("status = 'proved'").join(open_parents, "id").join(of_parent, "parent").where("file = of_file")
    body = F.regexp_extract("of_text", r"(?s):=(.*)$", 1)
    used = F.arrays_overlap(F.regexp_extract_all(body, F.lit(r"[A-Za-z_«][A-Za-z0-9_'.«»-]*"), 0), F.array("full", _short(F.col("full"))))
    state = pairs.groupBy("id").agg(F.bool_or(used).alias("used"), F.bool_or(_not_reducing(F.col("of"), F.col("p"))).alias("wrapper"))
    types = lambda p: F.filter(F.transform(p["groups"], lambda g: g["type"]), lambda t: t != "")
    premises = told.where("status = 'proved'").join(open_parents.select("id").distinct(), "id", "left_semi").select("id", F.explode(F.array_distinct(types(F.col("p")))).alias("type"))
    held = pairs.select("id", F.explode(types(F.col("of"))).alias("type")).distinct()
    results = pairs.select("id", F.explode(F.array(compacted(F.col("of.result")))).alias("result")).distinct()
    added = premises.join(held, ["id", "type"], "left_anti")
    higher = F.col("type").rlike(r"^(?:∀|forall )") | (F.pandas_udf(_arrows, "boolean")("type") & F.col("type").rlike(PROPOSITION))
    asks = added.withColumn("higher", higher).join(results, "id", "left").groupBy("id", "type").agg(F.bool_or(F.col("higher") | F.coalesce(_contains(F.col("type"), F.col("result")), F.lit(False))).alias("asks")).where("asks")
    ends = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    related = open_parents.select("id", F.col("parent").alias("a")).unionByName(open_parents.select("id", F.col("id").alias("a"))).distinct()
    near = related.join(ends, "a").select("id", F.col("b").alias("node")).distinct().withColumn("near", F.lit(True))
    stated = nodes.select(F.col("id").alias("node"), (F.col("status") == "proved").alias("is_proved"), compacted("statement").alias("type"))
    met = asks.join(stated, "type").join(related.select("id", F.col("a").alias("node")), ["id", "node"], "left_anti").join(near, ["id", "node"], "left")
    resolved = met.where("is_proved or near").select("id", "type").distinct().withColumn("resolved", F.lit(True))
    asked = asks.join(resolved, ["id", "type"], "left").groupBy("id").agg(F.sort_array(F.collect_list("type")).alias("obligations"), F.sort_array(F.collect_list(F.when(F.col("resolved").isNull(), F.col("type")))).alias("unresolved"))
    out = state.join(asked, "id", "full").where(~F.coalesce("used", F.lit(False)))
    none = F.array().cast("array<string>")
    out = out.select("id", F.coalesce("obligations", none).alias("obligations"), F.coalesce("unresolved", none).alias("unresolved"), F.coalesce("wrapper", F.lit(False)).alias("wrapper"))
    return out.where((F.size("unresolved") > 0) | F.col("wrapper"))


def mechanisms(nodes: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """id, parent, signature, basis, dependencies: what carries the proof of each helper of an open parent.

    nodes: id, file, name, status; edges as in conditional_helpers(); found: file, name, line, text. basis is
    `dependencies` where the proof names earlier declarations of its file, and the signature is that of their sorted
    names; else `body`, and it is that of the proof with identifiers and numbers as placeholders, but for words of the
    proof language and qualified or capitalised names. So helpers that differ in names and numbers only have one
    mechanism. Declarations without a proof have none; of several of a name the first counts.
    """
    both = edges.where("kind = 'split_of'").select(F.col("src").alias("id"), F.col("dst").alias("parent"))
    both = both.unionByName(edges.where("kind = 'depends_on'").select(F.col("dst").alias("id"), F.col("src").alias("parent"))).distinct()
    is_open = nodes.where(F.col("status").isin(*OPEN_STATUSES)).select(F.col("id").alias("parent"))
    helpers = both.join(is_open, "parent", "left_semi")
    names = nodes.join(helpers.select("id").distinct(), "id", "left_semi").select("id", "file", F.explode(F.array_distinct(F.array("name", _short(F.col("name"))))).alias("name"))
    first = names.join(found, ["file", "name"]).groupBy("id", "file").agg(F.min_by(F.struct("line", "text"), "line").alias("d")).select("id", "file", "d.line", parsed("d.text")["body"].alias("body")).where("body <> ''")
    tokens_ = F.regexp_extract_all("body", F.lit(BODY_TOKEN), 0)
    words = first.select("id", "file", F.col("line").alias("until"), F.explode(F.array_distinct(F.filter(tokens_, lambda t: t.rlike(BODY_NAME)))).alias("name"))
    used = words.join(found.select("file", "name", "line"), ["file", "name"]).where("line < until").groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("dependencies"))
    none = F.array().cast("array<string>")
    rows = first.join(used, "id", "left").withColumn("dependencies", F.coalesce("dependencies", none))
    kept = lambda t: t.isin(*PROOF_WORDS) | F.contains(t, F.lit(".")) | t.rlike("^[A-Z]")
    plain = F.transform(tokens_, lambda t: F.when(t.rlike(r"^\d+$"), "$num").when(t.rlike(BODY_NAME) & ~kept(t), "$id").otherwise(t))
    by_names = F.size("dependencies") > 0
    basis = F.when(by_names, "dependencies").otherwise("body")
    signature = F.sha2(F.concat_ws("\x1f", basis, F.when(by_names, F.array_join("dependencies", "\x1f")).otherwise(F.array_join(plain, " "))), 256)
    return helpers.join(rows.select("id", signature.alias("signature"), basis.alias("basis"), "dependencies"), "id").select("id", "parent", "signature", "basis", "dependencies")
