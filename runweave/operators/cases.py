"""Finite cases: proved helpers that each settle one value or one residue class of their parent, and say no more together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statements import OPEN_STATUSES, parsed

#: Forms of cases in signatures and names (fixed values).
CONGRUENCE, SINGLE = r"\bt\s*%\s*(\d+)\s*=\s*(\d+)\b", r"\bt\s*=\s*(\d+)\b(?!\s*[*+/\-^])"
AUDIT, CASE = r"^([A-Za-z_][A-Za-z0-9_']*)_audit_k(\d+)$", r"^([A-Za-z_][A-Za-z0-9_']*)_case_k_eq_(\d+)$"
WITNESS, TYPED = r"(?s)^\s*∃\s+(?:\([^()]*:\s*(?:ℕ|Nat)\s*\)|[^,:]+:\s*(?:ℕ|Nat))\s*,", r"\(([^()]*)\s*:\s*(?:ℕ|Nat)\s*\)"
EVERY = r"(?:∀|forall)\s+(?:\([^()]*:\s*(?:ℕ|Nat)\s*\)|[^,.:()]+\s*:\s*(?:ℕ|Nat)\b)"
#: Different cases proved before from which another one is evidence only (fixed value).
SATURATED = 4


def _sole(found: Column) -> Column:
    """The only different value of an array, else null."""
    return F.when(F.size(F.array_distinct(found)) == 1, F.element_at(found, 1))


def finite_branches(found: DataFrame) -> DataFrame:
    """found (name, target, text) with branch, modulus, residue: the one case that a declaration is limited to, else null.

    branch: `t%m=r` or `t=v`, named by the signature, which must name just one of all; `case:stem:k=v` and
    `audit:stem:k=v`, closed instances that the name tells, with a proof without holes, a natural number that exists and
    the literal in a typed expression; `closed:` and a digest for other closed declarations named after the target.
    """
    p = F.col("p")
    rows = found.withColumn("p", parsed("text"))
    signature = F.concat_ws(" : ", p["binders"], p["result"])
    number = lambda i: F.transform(F.regexp_extract_all(signature, F.lit(CONGRUENCE), i), lambda v: v.cast("decimal(38,0)"))
    classes = F.filter(F.arrays_zip(number(1).alias("m"), number(2).alias("r")), lambda c: (c["m"] > 0) & (c["r"] < c["m"]))
    said = F.transform(classes, lambda c: F.concat(F.lit("t%"), c["m"].cast("string"), F.lit("="), c["r"].cast("string")))
    values = F.transform(F.regexp_extract_all(signature, F.lit(SINGLE), 1), lambda v: F.concat(F.lit("t="), v.cast("decimal(38,0)").cast("string")))
    plain = _sole(F.concat(said, values))
    short, target = F.element_at(F.split(p["name"], r"\."), -1), F.element_at(F.split(F.trim("target"), r"\."), -1)
    audit, case = short.rlike(AUDIT), short.rlike(CASE)
    part = lambda i: F.when(audit, F.regexp_extract(short, AUDIT, i)).otherwise(F.regexp_extract(short, CASE, i))
    stem, value = part(1), F.regexp_replace(part(2), r"^0+(?=\d)", "")
    own = F.when(case, stem == target).otherwise((stem == target) | F.startswith(target, F.concat(stem, F.lit("_"))))
    proof = F.regexp_extract("text", r"(?s):=(.*)$", 1)
    whole = (F.instr("text", ":=") > 0) & ~proof.rlike(r"(?<![\w.'])sorry(?![\w'])")
    literal = F.concat(F.lit("(?<![A-Za-z0-9_'])"), value, F.lit("(?![A-Za-z0-9_'])"))
    typed = F.exists(F.regexp_extract_all(p["result"], F.lit(TYPED), 1), lambda e: F.rlike(e, literal))
    closed = (p["binders"] == "") & ~p["result"].rlike(EVERY)
    instance = F.when(own & whole & closed & p["result"].rlike(WITNESS) & typed, F.concat(F.when(case, "case:").otherwise("audit:"), stem, F.lit(":k="), value))
    named = F.startswith(short, F.concat(target, F.lit("_at_"))) & (target != "") & closed & p["result"].rlike(r"\b\d+\b")
    digest = F.concat(F.lit("closed:"), F.left(F.sha2(F.concat_ws(" ", p["kind"], p["name"], p["result"]), 256), F.lit(20)))
    theorem = p["kind"].isin("theorem", "lemma")
    branch = F.when(audit | case, instance).otherwise(F.coalesce(plain, F.when(theorem & named, digest)))
    rows = rows.withColumn("branch", branch)
    part = lambda i: F.nullif(F.regexp_extract("branch", r"^t%(\d+)=(\d+)$", i), F.lit("")).cast("decimal(38,0)")
    return rows.withColumns({"modulus": part(1), "residue": part(2)}).drop("p")


def finite_cases(nodes: DataFrame, edges: DataFrame, found: DataFrame, enough: int = SATURATED) -> DataFrame:
    """id, branch, prior, saturated, evidence_only of proved nodes that settle one case of an open parent.

    nodes: id, file, name, status, seq (the order in which nodes were proved); edges: src, dst, kind (split_of to the
    parent, depends_on from it); found: file, name, text; a name that a file has twice tells nothing. prior: different
    cases of nodes of the same file that share an open parent and were proved before, counted up to `enough`. A node is
    evidence only when they are enough, unless it is a class that holds a class proved before, or when it is a `case:`.

    Of each parent only the first `enough` + 1 cases are joined to its nodes; which classes hold which is an equi-join
    on (parent, modulus, residue), for the different moduli of the parent.
    """
    both = edges.where("kind = 'split_of'").select(F.col("src").alias("id"), F.col("dst").alias("parent"))
    both = both.unionByName(edges.where("kind = 'depends_on'").select(F.col("dst").alias("id"), F.col("src").alias("parent"))).distinct()
    opened = nodes.where(F.col("status").isin(*OPEN_STATUSES)).select(F.col("id").alias("parent"), F.col("name").alias("target"))
    once = found.groupBy("file", "name").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    short = F.element_at(F.split("name", r"\."), -1)
    proved = nodes.where("status = 'proved' and seq is not null").select("id", "file", "seq", F.explode(F.array_distinct(F.array("name", short))).alias("name"))
    told = proved.join(once, ["file", "name"]).groupBy("id", "file", "seq").agg(F.sum("n").alias("n"), F.first("text").alias("text")).where("n = 1").drop("n")
    of = finite_branches(told.join(both, "id").join(opened, "parent").withColumn("name", F.lit("")))
    chosen = of.where("branch is not null").groupBy("id").agg(F.min_by(F.struct("branch", "modulus", "residue"), "parent").alias("b"))
    held = of.select("id", "parent", "file", "seq").join(chosen.select("id", "b.*"), "id")
    group = ["parent", "file"]
    first = held.groupBy(*group, "branch").agg(F.min("seq").alias("since"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("since", "branch"))
    early = first.withColumn("rank", rank).where(F.col("rank") <= enough + 1).select(*group, F.col("branch").alias("other"), "since")
    counted = held.join(early, group, "left").groupBy("id", "branch").agg(F.least(F.lit(enough), F.count_distinct(F.when(F.col("since") < F.col("seq"), F.col("other")))).alias("prior"))
    classes = held.where("modulus is not null")
    moduli = classes.select(*group, F.col("modulus").alias("by")).distinct()
    within = classes.join(moduli, group).where("modulus % by = 0 and modulus > by").groupBy(*group, F.col("by").alias("modulus"), (F.col("residue") % F.col("by")).alias("residue")).agg(F.min("seq").alias("inner"))
    broader = classes.join(within, [*group, "modulus", "residue"]).where("inner < seq").select("id").distinct().withColumn("broader", F.lit(True))
    out = counted.join(broader, "id", "left").withColumn("saturated", F.col("prior") >= enough)
    evidence = F.startswith("branch", F.lit("case:")) | (F.col("saturated") & F.col("broader").isNull())
    return out.select("id", "branch", "prior", "saturated", evidence.alias("evidence_only"))
