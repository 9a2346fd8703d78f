r"""Operators over LaTeX files (path, text): theorem-like blocks with their proofs, and sections.

Environments are matched by their \begin and \end marks: a file's marks are exploded with their offsets, a running depth
for each environment pairs a \begin with the \end that closes it, and of the pairs the outermost are blocks. Names of
environments that a file declares itself are joined to its marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Environments that are theorem-like without being declared, and their kinds (fixed values).
ENVIRONMENTS = {
    "assumption": "assumption", "claim": "claim", "construction": "construction", "theorem": "theorem", "thm": "theorem", "lemma": "lemma", "lem": "lemma", "proposition": "proposition", "prop": "proposition",
    "corollary": "corollary", "cor": "corollary", "definition": "definition", "defn": "definition", "def": "definition", "conjecture": "conjecture", "conj": "conjecture", "example": "example", "ex": "example",
    "exercise": "exercise", "fact": "fact", "notation": "notation", "observation": "observation", "problem": "problem", "question": "question", "remark": "remark", "rem": "remark",
}
#: Words of a declared environment's title or name that tell its kind, the first that fits counts (fixed values).
KINDS = ("theorem", "lemma", "proposition", "corollary", "definition", "conjecture", "example", "remark", "claim", "problem", "question", "assumption", "observation", "construction", "fact", "comment", "notation", "exercise")
#: Declarations of environments: name, then title (fixed values).
DECLARED = (
    r"(?i)\\newtheorem\*?\s*\{([^{}\s]+)\}(?:\[[^\]]+\])?\s*\{([^{}]+)\}", r"(?i)\\(?:newmdtheoremenv|mdtheorem)\s*(?:\[[^\]]*\])?\s*\{([^{}\s]+)\}\s*\{([^{}]*)\}",
    r"(?i)\\spnewtheorem\*?\s*\{([^{}\s]+)\}\s*(?:\[[^\]]+\])?\s*\{([^{}]+)\}", r"(?i)\\newtcbtheorem\s*(?:\[[^\]]*\])?\s*\{([^{}\s]+)\}\s*\{([^{}]+)\}",
)
#: Declarations with the title among their options, and those that have a name only (fixed values).
DECLARED_OPTIONS, DECLARED_PLAIN = r"(?i)\\declaretheorem\s*(?:\[([^\]]*)\])?\s*\{([^{}\s]+)\}", r"(?i)\\(?:new|renew)environment\s*\{([^{}\s]+)\}"
OPTION_NAME = r"(?i)(?:^|,)\s*name\s*=\s*(?:\{([^{}]+)\}|([^,\]]+))"
#: Where a text is cut so that every mark begins a piece; the marks themselves.
MARKS = r"(?i)(?=\\(?:begin|end)\{[^{}]*\}|\\profess\{|\\endprofess)"
BEGIN, END, PROFESS = r"(?i)^\\begin\{([^{}]*)\}", r"(?i)^\\end\{([^{}]*)\}", r"(?i)^\\profess\{([^{}]+)\}"
SECTION = r"^\\(chapter|section|subsection|subsubsection)\*?\{([^{}\n]+)\}"
#: What may stand between a block and its proof, and the proof; characters after a block in which it is looked for.
PROOF = r"(?is)^\s*(?:%[^\n]*(?:\n|$)\s*)*(?:\\begin\{proof\}(?:\[[^\]]*\])?(.*?)\\end\{proof\}|\\proof\b(.*?)\\endproof)"
PLAIN_PROOF = r"(?is)^\s*\\proof\s*(.*?)\\endproof"
AFTER, AFTER_PLAIN = 20_000, 12_000


def _kind(title: Column, env: Column) -> Column:
    """The kind that a declared environment's title and name tell: a known word, else the first word."""
    both = F.lower(F.concat_ws(" ", title, env))
    known = F.coalesce(*[F.when(both.rlike(rf"\b{word}\b"), word) for word in KINDS])
    words = F.trim(F.lower(F.regexp_replace(F.when(title != "", title).otherwise(env), r"[^A-Za-z]+", " ")))
    return F.coalesce(known, F.nullif(F.substring_index(words, " ", 1), F.lit("")), F.lit("statement"))


def environments(files: DataFrame) -> DataFrame:
    """path, env, kind of the environments that a file declares; the later declaration of a name counts."""
    text = F.col("text")
    titled = F.concat(*[F.zip_with(F.regexp_extract_all(text, F.lit(p), 1), F.regexp_extract_all(text, F.lit(p), 2), lambda e, t: F.struct(e.alias("env"), F.trim(t).alias("title"))) for p in DECLARED])
    named = F.zip_with(
        F.regexp_extract_all(text, F.lit(DECLARED_OPTIONS), 2), F.regexp_extract_all(text, F.lit(DECLARED_OPTIONS), 1),
        lambda e, o: F.struct(e.alias("env"), F.trim(F.concat(F.regexp_extract(o, OPTION_NAME, 1), F.regexp_extract(o, OPTION_NAME, 2))).alias("title")),
    )
    given = files.select("path", F.posexplode(F.concat(titled, named)).alias("at", "d")).select("path", F.col("d.env").alias("env"), F.col("d.title").alias("title"), "at")
    last = given.groupBy("path", "env").agg(F.max_by("title", "at").alias("title"))
    told = last.select("path", "env", _kind(F.col("title"), F.col("env")).alias("kind"))
    plain = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(DECLARED_PLAIN), 1))).alias("env"))
    plain = plain.select("path", "env", _kind(F.lit(""), F.col("env")).alias("kind")).where((F.col("kind") != "statement") & ~F.col("env").isin(*ENVIRONMENTS))
    return told.unionByName(plain.join(told, ["path", "env"], "left_anti"))


def _uses(body: Column, command: str) -> Column:
    """The values of a command's braces, each once, in their order."""
    values = F.flatten(F.transform(F.regexp_extract_all(body, F.lit(rf"\\{command}\{{([^{{}}]+)\}}"), 1), lambda v: F.split(v, ",")))
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))


def clean_statement(body: Column) -> Column:
    """A body without marks of labels and uses, comments and runs of blanks."""
    text = F.regexp_replace(body, r"\\(?:label|lean|uses|proves|discussion)\{[^{}]*\}", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"\\(?:leanok|notready|mathlibok)\b", " "), r"%[^\n]*", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _lines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n")))


def tex_blocks(files: DataFrame) -> DataFrame:
    r"""path, kind, environment, label, title, uses, lean, statement, line, end_line, proof, proof_line, proof_end_line.

    One row a theorem-like block: an environment by name or by declaration, its own or the file's (case of names does
    not matter in marks), or \profess{kind} ... \endprofess. Blocks within blocks belong to the outer one; an
    environment that is never closed, and an \end without its \begin, are no blocks. label: that of the body, else
    `line-N`. The proof follows the block, with nothing but blanks and comments between; without one, proof is empty and
    its lines 0. Texts are whole. Files of one path are one; a null text has no blocks.
    """
    texts = files.where("text is not null").select("path", "text")
    pieces = texts.select("path", F.posexplode(F.split("text", MARKS)).alias("nth", "piece"))
    before = Window.partitionBy("path").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.select("path", "piece", "nth", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).alias("at"))
    begins, ends = F.regexp_extract("piece", BEGIN, 1), F.regexp_extract("piece", END, 1)
    profess = F.col("piece").rlike(PROFESS)
    env = F.when(profess | F.col("piece").rlike(r"(?i)^\\endprofess"), "\\profess").otherwise(F.lower(F.concat(begins, ends)))
    opens = profess | (begins != "")
    head = F.when(profess, F.regexp_extract("piece", PROFESS, 0)).otherwise(F.regexp_extract("piece", r"(?i)^\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", 0))
    marks = placed.where(F.col("piece").rlike(r"(?i)^\\(?:begin\{|end\{|profess\{|endprofess)")).select(
        "path", "at", env.alias("env"), opens.alias("opens"), F.when(profess, F.regexp_extract("piece", PROFESS, 1)).otherwise(begins).alias("given"), F.length(head).alias("head"),
        F.regexp_extract(head, r"\[([^\]]*)\]$", 1).alias("option"),
    )
    fixed = F.create_map(*[F.lit(x) for pair in ENVIRONMENTS.items() for x in pair])
    declared = environments(texts).select("path", F.lower("env").alias("env"), "kind").groupBy("path", "env").agg(F.max("kind").alias("declared"))
    known = marks.join(declared, ["path", "env"], "left").withColumn("kind", F.coalesce("declared", fixed[F.col("env")]))
    known = known.where(F.col("kind").isNotNull() | (F.col("env") == "\\profess"))
    # A \begin's depth is that after it, an \end's that before it: both of a pair have the same, and are next to each other there.
    step = F.when(F.col("opens"), 1).otherwise(-1)
    here = Window.partitionBy("path", "env").orderBy("at")
    depth = known.withColumn("depth", F.sum(step).over(here) + F.when(F.col("opens"), 0).otherwise(1))
    level = Window.partitionBy("path", "env", "depth").orderBy("at")
    closed = depth.withColumns({"end": F.when(~F.lead("opens").over(level), F.lead("at").over(level)), "tail": F.lead("head").over(level)})
    pairs = closed.where(F.col("opens") & F.col("end").isNotNull()).withColumn("tail", F.when(F.col("env") == "\\profess", F.length(F.lit("\\endprofess"))).otherwise(F.length("env") + 6))
    outer = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pairs.withColumn("covered", F.coalesce(F.max("end").over(outer), F.lit(-1))).where("at > covered")
    listed = blocks.groupBy("path").agg(F.collect_list(F.struct("at", "end", "head", "tail", "env", "given", "option", "kind")).alias("blocks"))
    text = F.col("text")

    def cut(b: Column) -> Column:
        body = F.substring(text, b["at"] + b["head"] + 1, b["end"] - b["at"] - b["head"])
        stop = (b["end"] + b["tail"]).cast("int")
        return F.struct(
            b["env"].alias("env"), b["given"].alias("given"), b["option"].alias("option"), b["kind"].alias("kind"), body.alias("body"),
            (_lines(F.substring(text, F.lit(1), b["at"])) + 1).alias("line"), (_lines(F.substring(text, F.lit(1), stop)) + 1).alias("end_line"), F.substring(text, stop + 1, F.lit(AFTER)).alias("after"),
        )

    rows = texts.join(listed, "path").select("path", F.inline(F.transform("blocks", lambda b: cut(b.withField("at", b["at"].cast("int")).withField("end", b["end"].cast("int"))))))
    is_profess = F.col("env") == "\\profess"
    met = F.when(is_profess, F.regexp_extract(F.substring("after", 1, AFTER_PLAIN), PLAIN_PROOF, 0)).otherwise(F.regexp_extract("after", PROOF, 0))
    inner = F.when(is_profess, F.regexp_extract(F.substring("after", 1, AFTER_PLAIN), PLAIN_PROOF, 1)).otherwise(F.concat(F.regexp_extract("after", PROOF, 1), F.regexp_extract("after", PROOF, 2)))
    rows = rows.withColumns({"met": met, "inner": inner})
    said = F.trim(F.lower(F.regexp_replace("given", r"[^A-Za-z]+", " ")))
    label = F.trim(F.regexp_extract("body", r"\\label\{([^{}]+)\}", 1))
    return rows.select(
        "path",
        F.when(is_profess, F.when(said != "", said).otherwise("statement")).otherwise(F.col("kind")).alias("kind"),
        F.when(~is_profess, F.col("given")).alias("environment"),
        F.when(label != "", label).otherwise(F.concat(F.lit("line-"), "line")).alias("label"),
        F.when(is_profess, F.trim("given")).otherwise(F.col("option")).alias("title"),
        _uses(F.col("body"), "uses").alias("uses"),
        _uses(F.col("body"), "lean").alias("lean"),
        clean_statement(F.col("body")).alias("statement"),
        "line",
        "end_line",
        clean_statement(F.col("inner")).alias("proof"),
        F.when(F.col("met") != "", F.col("end_line")).otherwise(0).alias("proof_line"),
        F.when(F.col("met") != "", F.col("end_line") + _lines(F.col("met"))).otherwise(0).alias("proof_end_line"),
    )


def tex_sections(files: DataFrame) -> DataFrame:
    r"""path, nth, level, title, line of the chapters, sections and subsections of files, in their order."""
    pieces = files.select("path", F.posexplode(F.split("text", r"(?=\\(?:chapter|section|subsection|subsubsection)\*?\{)")).alias("at", "piece"))
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("line", F.coalesce(F.sum(_lines(F.col("piece"))).over(before), F.lit(0)) + 1).where(F.col("piece").rlike(SECTION))
    nth = F.row_number().over(Window.partitionBy("path").orderBy("at"))
    return placed.select("path", nth.alias("nth"), F.regexp_extract("piece", SECTION, 1).alias("level"), F.trim(F.regexp_extract("piece", SECTION, 2)).alias("title"), "line")
