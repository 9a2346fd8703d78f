"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

Candidate spans come from fixed patterns. All candidate values of the corpus are hashed and counted by distinct
repositories and owners: a value that many owners hold, or some owners in many repositories, is a widely copied
example; one of a single owner, in however many repositories, looks live. The base kinds (assign, access, hex) are always reported; the further kinds only where their value looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, no_clash

#: Marks put around matches; texts that hold them get a stand-in of the same length, which no pattern matches.
OPEN, MID, CLOSE, STAND_IN = "\ue000", "\ue001", "\ue002", "\ufffd"
#: The base kinds in their order: pattern, group of the value, least length of the value (None: in the pattern).
#: Runs with a least length stand for runs of any length of which shorter ones are dropped: a greedy run from the first
#: place where it can begin is the same match.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}+", 0, None),
    ("hex", r"[0-9a-f]{32,}+", 0, None),
)
#: A private key from BEGIN to END; without END to the last line of base64 (a short last line only if it stands alone).
#: Line ends may be escaped. Bounds keep the groups' loops from running deep.
KEY_MARK = r"-----(?:BEGIN|END) [A-Z0-9 ]{0,24}PRIVATE KEY(?: BLOCK)?-----"
_GAP = r"(?:\\[nr]|[\s>#*|\"'+,]){0,40}+"
PRIVATE_KEY = (
    KEY_MARK.replace("(?:BEGIN|END)", "BEGIN")
    + r"(?:[^-]{0,32768}+(?:-(?!----(?:BEGIN|END) )[^-]{0,32768}+){0,64}+" + KEY_MARK.replace("(?:BEGIN|END)", "END")
    + rf"|(?:{_GAP}(?:Proc-Type|DEK-Info|Version|Comment|Hash): [^\n\\]*+){{0,8}}+(?:{_GAP}[A-Za-z0-9+/]{{16,}}+={{0,2}}+){{0,1000}}+(?:\s{{1,4}}+[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?=\s*+\n|\s*+\z))?+)"
)
#: Further kinds, in one pattern: vendor tokens, web tokens, private keys, credentials in URLs, mixed runs.
EXTRA = (
    r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{30,}+|[rs]k_live_[A-Za-z0-9]{16,}+)"
    r"|\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
    rf"|{PRIVATE_KEY}"
    r"|://[^\s:/@]{1,64}:[^\s:/@]{4,128}@"
    r"|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+"
)
#: A value is a copied example if at least so many owners hold it, or two or more owners in so many repositories.
COPIED_OWNERS, COPIED_REPOS = 3, 6
#: A value with at least this share of all candidates is looked up by a broadcast join; at most 1 / HOT values have it.
HOT = 1e-4


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _parts(items: Column) -> Column:
    """An array in about sqrt(n) runs of about sqrt(n) items, so that what grows while it is folded stays short."""
    step = F.greatest(F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), step), lambda i: F.slice(items, i, step))


def _each_start(parts: Column, start: Column, total) -> Column:
    """array<struct<part, pos>>: each part with the fold of total(pos, part) over start and the parts before it."""
    none = F.array().cast("array<int>")
    fold = F.aggregate(parts, F.struct(start.alias("pos"), none.alias("out")), lambda s, part: F.struct(total(s["pos"], part).alias("pos"), F.concat(s["out"], F.array(s["pos"])).alias("out")), lambda s: s["out"])
    return F.zip_with(parts, fold, lambda part, pos: F.struct(part.alias("part"), pos.alias("pos")))


def _spans(text: Column, kind: Column | None, pattern: str, group: int, least: int | None) -> Column:
    """array<struct<start, end, kind, value>> of the leftmost non-overlapping matches, in code points."""
    none = F.array().cast("array<struct<start:int,end:int,match:string,value:string>>")

    def found_in(piece: Column) -> Column:
        """match, value, and the characters of the text that the piece stands for."""
        match = F.substring_index(piece, MID, 1)
        value = F.substring_index(F.substring_index(piece, CLOSE, 1), MID, -1)
        return F.struct(match.alias("match"), value.alias("value"), (F.length(piece) - F.length(value) - 2).alias("chars"))

    def step(state: Column, x: Column) -> Column:
        found = F.struct(state["pos"].alias("start"), (state["pos"] + F.length(x["match"])).alias("end"), x["match"].alias("match"), x["value"].alias("value"))
        return F.struct((state["pos"] + x["chars"]).alias("pos"), F.concat(state["out"], F.array(found)).alias("out"))

    def placed(pieces: Column) -> Column:
        rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), found_in)
        parts = _let(rest, lambda r: _each_start(_parts(r), F.length(F.get(pieces, F.lit(0))), lambda pos, part: pos + F.aggregate(part, F.lit(0), lambda n, x: n + x["chars"])))
        return F.flatten(F.transform(parts, lambda p: F.aggregate(p["part"], F.struct(p["pos"].alias("pos"), none.alias("out")), step, lambda s: s["out"])))

    pieces = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{MID}${group}{CLOSE}"), OPEN)
    found = _let(pieces, lambda p: F.when(F.size(p) > 1, placed(p)).otherwise(none))
    if least:
        found = F.filter(found, lambda x: F.length(x["value"]) >= least)
    # A key is counted by its body: its marks, which all keys share, and its line ends go.
    value = lambda x: x["value"] if kind is not None else F.when(x["match"].startswith("-----"), F.regexp_replace(x["value"], KEY_MARK + r"|\\[nr]|\s++", "")).otherwise(x["value"])
    return F.transform(found, lambda x: F.struct(x["start"], x["end"], (kind if kind is not None else _extra_kind(x["match"])).alias("kind"), F.sha2(value(x), 256).alias("hash"), x["match"].alias("match")))


def _extra_kind(match: Column) -> Column:
    return F.when(match.startswith("eyJ") & match.contains("."), "jwt").when(match.startswith("-----"), "key").when(match.startswith("://"), "url").when(match.rlike(r"^(?:gh[pousr]_|xox[abprs]-|AIza|[rs]k_live_)"), "vendor").otherwise("mixed")


def candidates(text: Column) -> tuple[Column, Column]:
    """(base spans, further spans) of a text: array<struct<start, end, kind, hash>>, each kind on its own."""
    clean = F.translate(F.coalesce(text, F.lit("")), OPEN + MID + CLOSE, STAND_IN * 3)
    base = F.concat(*[_spans(clean, F.lit(kind), pattern, group, least) for kind, pattern, group, least in BASE])
    extra = F.filter(_spans(clean, None, EXTRA, 0, None), lambda x: (x["kind"] != "mixed") | (x["match"].rlike("[0-9]") & x["match"].rlike("[a-z]") & x["match"].rlike("[A-Z]")))
    bare = lambda spans: F.transform(spans, lambda x: F.struct(x["start"], x["end"], x["kind"], x["hash"]))
    return bare(base), bare(extra)


def ownership(found: DataFrame) -> DataFrame:
    """hash, n, repos, owners long: spans, and distinct non-null repositories and owners, of each value.

    found: hash, repo, owner; a repository is one of its owner. Folded by (hash, repo, owner) on the map side first, so
    that a value in a third of all rows costs a row a task.
    """
    each = found.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    return each.groupBy("hash").agg(F.sum("n").alias("n"), F.count("repo").alias("repos"), F.countDistinct("owner").alias("owners"))


def copied(copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> Column:
    """Whether a row of ownership() is a widely copied example."""
    return (F.col("owners") >= copied_owners) | (F.col("owners") >= 2) & (F.col("repos") >= copied_repos)


def scanned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """id_col, text_hash, found: array<struct<start, end, kind, live>> of each row with any span, for each whole text.

    found holds the base spans and those further ones that look live, by start, then kind. live is false for values
    that are widely copied (see copied()). Rows without spans are left out; equal rows give equal arrays, once each.
    """
    repo, owner = F.lit(None).cast("string") if repo is None else repo, F.lit(None).cast("string") if owner is None else owner
    base, extra = candidates(F.col(text_col))
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"), repo.alias("repo"), owner.alias("owner"), base.alias("base"), extra.alias("extra"))
    rows = cut(rows.where("size(base) + size(extra) > 0"))
    every = F.concat(F.transform("base", lambda x: F.struct(x["start"], x["end"], x["kind"], x["hash"], F.lit(True).alias("is_base"))), F.transform("extra", lambda x: F.struct(x["start"], x["end"], x["kind"], x["hash"], F.lit(False).alias("is_base"))))
    single = rows.select("id", "text_hash", "repo", "owner", F.explode(every).alias("s")).select("id", "text_hash", "repo", "owner", "s.*")
    held = cut(ownership(single).select("hash", "n", (~copied(copied_owners, copied_repos)).alias("live")))
    total = held.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") >= max(1.0, HOT * total)
    hot = F.broadcast(held.where(often).select("hash", "live"))
    seldom = single.join(hot, "hash", "left_anti").join(held.where(~often).select("hash", "live"), "hash")
    judged = single.join(hot, "hash").unionByName(seldom).where("is_base or live")
    order = F.when(F.col("kind") == "assign", 0).when(F.col("kind") == "access", 1).when(F.col("kind") == "hex", 2).otherwise(3)
    spans = judged.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", order.alias("order"), "kind", "end", "live"))).alias("found"))
    return spans.select(F.col("id").alias(id_col), "text_hash", F.transform("found", lambda x: F.struct(x["start"], x["end"], x["kind"], x["live"])).alias("found"))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """One row for each row of df: id_col, n_assign, n_access, n_hex long, base_sha256, spans string, n_live, n_copied.

    base_sha256: SHA-256 of kind:start:end of the base spans by start, then kind, comma-joined (code points, end
    exclusive); spans: all spans, joined likewise. Null and empty texts have none. Repeated rows stay. Further columns
    of df, whatever their names, do not matter; id_col by the name of an output is an error (ValueError).
    """
    no_clash([id_col], "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied")
    found = scanned(df, id_col, text_col, repo, owner).select(F.col(id_col).alias("found_id"), F.col("text_hash").alias("found_hash"), "found")
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash")), "left")
    spans = F.coalesce("found", F.array().cast("array<struct<start:int,end:int,kind:string,live:boolean>>"))
    base = F.filter(spans, lambda x: x["kind"].isin("assign", "access", "hex"))
    number = lambda test: F.size(F.filter(spans, test)).cast("long")
    written = lambda some: F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of_kind = lambda kind: number(lambda x: x["kind"] == kind).alias(f"n_{kind}")
    counts = [of_kind(kind) for kind, *_ in BASE]
    return joined.select(F.col("id").alias(id_col), *counts, F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"), number(lambda x: x["live"]).alias("n_live"), number(lambda x: ~x["live"]).alias("n_copied"))


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None, mask: str = "[secret]") -> DataFrame:
    """df with every reported span of text_col replaced by `mask`; n_chars, where df has it, follows the new text.

    Overlapping spans become one mask. Rows without spans, null texts among them, stay as they are. All columns of df
    stay, whatever their names.
    """
    of_row, of_hash, of_found, new = fresh(df, "id", "hash", "found", "masked")
    found = scanned(df, id_col, text_col, repo, owner).select(F.col(id_col).alias(of_row), F.col("text_hash").alias(of_hash), F.col("found").alias(of_found))
    joined = df.join(found, df[id_col].eqNullSafe(found[of_row]) & (F.xxhash64(F.coalesce(df[text_col], F.lit(""))) == F.col(of_hash)), "left")
    text = F.col(text_col)

    def part_of(base: Column, own: Column, spans: Column) -> Column:
        """`own`, the text from base to the end of spans, with its spans masked."""

        def step(state: Column, x: Column) -> Column:
            gap = F.substring(own, state["pos"] - base + 1, x["start"] - state["pos"])
            more = F.when(x["start"] >= state["pos"], F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"])
            return F.struct(F.greatest(state["pos"], x["end"]).alias("pos"), more.alias("out"))

        return F.aggregate(spans, F.struct(base.alias("pos"), F.lit("").alias("out")), step, lambda s: s["out"])

    def masked(spans: Column) -> Column:
        last = lambda some: F.array_max(F.transform(some, lambda x: x["end"]))
        parts = _each_start(_parts(spans), F.lit(0), lambda pos, part: F.greatest(pos, last(part)))
        written = F.transform(parts, lambda p: _let(F.substring(text, p["pos"] + 1, last(p["part"]) - p["pos"]), lambda own: part_of(p["pos"], own, p["part"])))
        return F.concat(F.array_join(written, ""), F.substring(text, last(spans) + 1, F.length(text)))

    out = joined.withColumn(new, F.when(F.col(of_found).isNull(), text).otherwise(_let(F.col(of_found), masked)))
    columns = [F.col(new).alias(c) if c == text_col else F.when(F.col(of_found).isNull(), F.col(c)).otherwise(F.length(new)).cast(df.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in df.columns]
    return out.select(*columns)
