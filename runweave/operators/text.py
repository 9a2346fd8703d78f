"""Operators over documents, pages and messages; all are column expressions or joins on equal keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Query parameters that only track (fixed values).
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"
#: Threat patterns: id, severity, category, regular expression.
THREATS = (("env_secret", "high", "credentials", r"(?i)(token|secret|password|api_key)[ ]*="), ("access_key", "critical", "credentials", r"AKIA[A-Z0-9]{12}"), ("mail", "low", "personal", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"), ("hidden", "high", "obfuscation", "[​‌‍⁠]"))
COMPACT = r"[^a-z0-9]"


def chunks(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id_col, idx, chunk: consecutive pieces of at most `size` characters; empty and null texts give none."""
    n = F.ceil(F.length(text_col) / size).cast("int")
    return df.where(F.length(text_col) > 0).select(id_col, text_col, F.explode(F.sequence(F.lit(0), n - 1)).alias("idx")).select(id_col, "idx", F.substring(F.col(text_col), F.col("idx") * size + 1, F.lit(size)).alias("chunk"))


def lines(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """id_col, line (from 1), content."""
    return df.select(id_col, *more, F.posexplode(F.split(text_col, "\n")).alias("line", "content")).withColumn("line", F.col("line") + 1)


#: A heading: a section number and a title, or capitals only (fixed values).
HEADING = r"^(?:[0-9]+(?:\.[0-9]+)*\s+[A-Z][^\n]{2,120}|[A-Z][A-Z0-9 ,;:()'/-]{6,120})$"


def sections(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, line, title of the lines that, stripped, are headings."""
    rows = lines(df, id_col, text_col).withColumn("title", F.regexp_replace("content", r"^\s+|\s+$", ""))
    return rows.where(F.col("title").rlike(HEADING)).select(id_col, "line", "title")


def threat_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One finding per pattern and line: id_col, line, pattern_id, severity, category, match (120 characters)."""
    found = F.array_compact(F.array(*[F.when(F.col("content").rlike(p), F.struct(F.lit(i).alias("pattern_id"), F.lit(s).alias("severity"), F.lit(c).alias("category"), F.substring(F.regexp_extract("content", f"({p})" , 1), 1, 120).alias("match"))) for i, s, c, p in THREATS]))
    return lines(df, id_col, text_col).select(id_col, "line", F.explode(found).alias("f")).select(id_col, "line", "f.*")


def verdicts(findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Worst severity per bundle: critical is dangerous, anything else is caution."""
    return findings.groupBy(id_col).agg(F.count("*").alias("findings"), F.when(F.bool_or(F.col("severity") == "critical"), "dangerous").otherwise("caution").alias("verdict"))


#: Whether a bundle may be used, by trust and verdict safe, caution, dangerous (fixed values); other trust is community.
POLICY = {"builtin": ("allow", "allow", "allow"), "trusted": ("allow", "allow", "block"), "community": ("allow", "block", "block"), "agent-created": ("allow", "block", "block")}


def bundle_verdicts(bundles: DataFrame, findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, verdict, findings, categories, decision of every bundle (id_col, trust): safe without findings, else as verdicts()."""
    found = findings.groupBy(id_col).agg(F.count("*").alias("findings"), F.bool_or(F.col("severity") == "critical").alias("critical"), F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories"))
    rows = bundles.join(found, id_col, "left")
    verdict = F.when(F.col("findings").isNull(), "safe").when(F.col("critical"), "dangerous").otherwise("caution")
    at = F.when(verdict == "safe", 0).when(verdict == "caution", 1).otherwise(2)
    decision = F.get(F.array(*map(F.lit, POLICY["community"])), at)
    for trust, by_verdict in POLICY.items():
        decision = F.when(F.col("trust") == trust, F.get(F.array(*map(F.lit, by_verdict)), at)).otherwise(decision)
    return rows.select(id_col, verdict.alias("verdict"), F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("categories", F.lit("")).alias("categories"), decision.alias("decision"))


def redact_assignments(text: Column) -> Column:
    """Values of secret-looking assignments become ***."""
    return F.regexp_replace(text, r"(?i)((?:token|secret|password|api_key)[ ]*[=:][ ]*)([^ \t\r\n]+)", "$1***")


def canonical_url(url: Column) -> Column:
    """Lower scheme and host, no fragment, no tracking parameters, no trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), rf"([?&])(?:{TRACKING})=[^&]*", "$1")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "&+", "&"), r"\?&", "?"), r"[?&/]+$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z]+://[^/?]+)", 1)
    return F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


#: Named entities that are decoded, & last (fixed values).
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def page_text(html: Column) -> Column:
    """Readable text of a page by patterns: no head, script or style, block tags as new lines, blanks collapsed, entities decoded.

    An element that is never closed loses its tag only, so broken markup keeps its text.
    """
    out = html
    for tag in ("script", "style", "head"):
        out = F.regexp_replace(out, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", "")
    out = F.regexp_replace(out, r"(?i)<(?:br|p|div|li|h[1-6]|tr)(?:[ /][^>]*)?>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", ""), r"[ \t]+", " ")
    out = F.regexp_replace(out, r"[ \r\n]*\n[ \r\n]*", "\n")
    for entity, becomes in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(becomes))
    return out


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href of each anchor in its order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?i)<a [^>]*href="([^"]*)"'), 1)).alias("pos", "href"))


def merge_results(pages: DataFrame) -> DataFrame:
    """One row per canonical address: key, first page, pages merged, and the length of the longest one."""
    return pages.groupBy(canonical_url(F.col("url")).alias("key")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("merged"), F.max(F.length("html")).alias("longest"))


def exclude_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """id_col, label_col: the compact lower-case letters and digits of the document contain those of the label.

    A label of at least 2 B - 1 characters covers a whole aligned block of B characters wherever it lies, so for each
    class of label lengths (B a power of two, up to 32) documents give their different blocks, labels their first B
    windows, and only equal keys are verified. Labels of one or two characters meet the different windows of their
    length, of which a document has at most 1,296. Compact texts are written once. Labels of no characters are in no
    document.
    """
    small = lambda c: F.regexp_replace(F.lower(c), COMPACT, "")
    labels = cut(labels.select(label_col, small(F.col(text_col)).alias("label")).where(F.length("label") > 0).withColumn("block", F.when(F.length("label") <= 2, -F.length("label")).otherwise(F.least(F.lit(32), F.pow(F.lit(2.0), F.floor(F.log2((F.length("label") + 1) / 2.0)))).cast("int"))))
    texts = cut(docs.select(id_col, small(F.col(text_col)).alias("compact")))
    found = None
    for row in labels.select("block").distinct().collect():  # at most eight classes
        size, step = abs(row["block"]), max(1, row["block"])
        # A pattern cuts a text in one go; substrings by place would each be sought from its beginning.
        blocks = F.array_distinct(F.regexp_extract_all("compact", F.lit(f"(.{{{size}}})" if step == size else f"(?=(.{{{size}}}))"), 1))
        keyed = texts.where(F.length("compact") >= size).select(id_col, F.explode(blocks).alias("key"))
        own = labels.where(F.col("block") == row["block"])
        windows = own.select(label_col, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(step - 1)), _piece("label", size, 1)))).alias("key"))
        pairs = keyed.join(windows, "key").select(id_col, label_col).distinct()
        if row["block"] > 0:
            pairs = pairs.join(texts, id_col).join(own.select(label_col, "label"), label_col).where(F.contains("compact", "label")).select(id_col, label_col).distinct()
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct() if found is not None else docs.select(id_col).join(labels.select(label_col), F.lit(False))


def _piece(column: str, size: int, step: int):
    return lambda i: F.substring(F.col(column), i * step + 1, F.lit(size))


def duplicates(docs: DataFrame, least: int = 2) -> DataFrame:
    """Exact repeats of a text with at least `least` distinct sources: digest, n, sources, first."""
    same = docs.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.min("doc_id").alias("first"))
    return same.where((F.col("n") > 1) & (F.col("sources") >= least))


def search(messages: DataFrame, query: tuple[str, ...], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best messages for any of the query's terms by BM25: id, session_id, score (6 digits)."""
    words = F.filter(F.split(F.lower("content"), r"[^a-z0-9]+"), lambda w: w != "")
    tokens = messages.select("id", "session_id", words.alias("w"))
    sized = tokens.select("id", "session_id", F.size("w").alias("len"), F.filter("w", lambda w: w.isin(*query)).alias("w"))
    stats = sized.agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    hits = sized.select("id", "session_id", "len", F.explode("w").alias("term")).groupBy("id", "session_id", "len", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    joined = hits.join(F.broadcast(df), "term").join(F.broadcast(stats))  # as many rows as the query has terms, and one
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return joined.groupBy("id", "session_id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def with_context(messages: DataFrame, hit: Column, chars: int = 200) -> DataFrame:
    """Hits with the neighbours of adjacent id in their session, cut to `chars` characters."""
    order = Window.partitionBy("session_id").orderBy("id")
    beside = lambda f, d: F.when(f("id").over(order) == F.col("id") + d, F.substring(f("content").over(order), 1, chars))
    return messages.withColumns({"before": beside(F.lag, -1), "after": beside(F.lead, 1)}).where(hit).select("id", "before", "after")


def batches(items: DataFrame, most: int = 24) -> DataFrame:
    """book, label, batch: items of a book in their order; a new batch at each change of chapter and after `most` items.

    items: book, ordinal, label, chapter. The name counts the batches of a chapter, also of one that comes again.
    """
    order = Window.partitionBy("book").orderBy("ordinal")
    rows = items.withColumn("turn", F.when(F.col("chapter").eqNullSafe(F.lag("chapter").over(order)), 0).otherwise(1)).withColumn("island", F.sum("turn").over(order))
    rows = rows.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("book", "island").orderBy("ordinal")) - 1) / most))
    k = F.dense_rank().over(Window.partitionBy("book", "chapter").orderBy("island", "part"))
    return rows.select("book", "label", F.concat(F.lit("chapter-"), F.coalesce(F.col("chapter").cast("string"), F.lit("unscoped")), F.lit("-batch-"), k.cast("string")).alias("batch"))


def concept_index(item_concepts: DataFrame) -> DataFrame:
    """concept, frequency, chapters, labels (ascending array), shared: held by more than one item."""
    found = item_concepts.groupBy("concept").agg(F.count_distinct("label").alias("frequency"), F.count_distinct("chapter").alias("chapters"), F.array_sort(F.collect_set("label")).alias("labels"))
    return found.withColumn("shared", F.col("frequency") > 1)
