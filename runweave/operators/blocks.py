"""Blocks within proofs that could be statements of their own, ranked by what taking them out would save."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A line that begins a block, its indentation and name; the mark before its proof; holes (fixed values).
START = r"^([ \t]*)have\s+([A-Za-z_«][\w'.«»]*)"
PROOF, HOLE = r":=\s*by\b", r"\b(?:sorry|admit)\b"


def blank(text: str | None) -> str:
    """text with comments, nested ones too, and strings as blanks; lines keep their places."""
    out, depth = [], 0
    for m in re.finditer(r'/-|-/|--[^\n]*|"(?:\\.|[^"\\])*(?:"|$)|[^/"-]+|(?s:.)', text or ""):
        piece = m.group()
        hide = depth or piece == "/-" or piece.startswith(("--", '"'))
        depth += (piece == "/-") - (piece == "-/" and depth > 0)
        out.append(re.sub(r"[^\n]", " ", piece) if hide else piece)
    return "".join(out)


def _blanked(texts: pd.Series) -> pd.Series:
    return texts.map(blank)


def extraction_candidates(found: DataFrame, least: int = 8) -> DataFrame:
    """id, rank, name, line, lines, chars: the outermost named `have` blocks of declarations (id, text), the longest first.

    Outermost are those of the least indentation (a tab counts two) of all of a declaration. A block ends before the
    nearest later line of code that is indented no more than it, and has no blank lines at its end. It has a tactic
    proof without holes and `least` lines or more. Comments and strings are no code; a null text has no blocks.
    Lines are exploded and looked at in the order of their declaration: one window finds the ends of all blocks.
    """
    both = found.select("id", F.posexplode(F.arrays_zip(F.split("text", "\n").alias("raw"), F.split(F.pandas_udf(_blanked, "string")("text"), "\n").alias("code"))).alias("line", "l")).select("id", "line", "l.raw", "l.code")
    width = F.length(F.replace(F.regexp_extract("code", r"^[ \t]*", 0), F.lit("\t"), F.lit("  ")))
    lines = both.withColumns({"width": width, "name": F.nullif(F.regexp_extract("code", START, 2), F.lit("")), "is_code": F.trim(F.translate("code", "\t\r", "  ")) != ""})
    outer = F.min(F.when(F.col("name").isNotNull(), F.col("width"))).over(Window.partitionBy("id"))
    order = Window.partitionBy("id").orderBy("line")
    lines = lines.withColumn("outer", outer).where("outer is not null").withColumn("begins", F.col("name").isNotNull() & (F.col("width") == F.col("outer")))
    stops = F.col("is_code") & (F.col("width") <= F.col("outer"))
    lines = lines.withColumn("block", F.last(F.when(stops, F.when(F.col("begins"), F.col("line")).otherwise(-1)), True).over(order)).where("block >= 0")
    filled = F.trim(F.translate("raw", "\t\r", "  ")) != ""
    ends = lines.withColumn("last", F.max(F.when(filled, F.col("line"))).over(Window.partitionBy("id", "block"))).where("line <= last")
    told = ends.groupBy("id", F.col("block").alias("line")).agg(
        F.first("name", True).alias("name"), F.count("*").alias("lines"), F.rtrim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "\n")).alias("source"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "code"))), lambda x: x["code"]), "\n").alias("code"),
    )
    whole = told.where(F.col("code").rlike(PROOF) & ~F.col("code").rlike(HOLE) & (F.col("lines") >= max(2, least))).withColumn("chars", F.length("source"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("chars"), F.desc("lines"), "line"))
    return whole.select("id", rank.alias("rank"), "name", (F.col("line") + 1).alias("line"), "lines", "chars")
