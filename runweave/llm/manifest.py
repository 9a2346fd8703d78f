"""Merkle manifest of a dataset: one root over all rows, with a proof for each.

Rows become leaves of one tree a part, in ascending order of their ids. No row is sorted for that: the ids of each part
are merged into a bitmap of 64-bit words, of which only those with a bit are kept; a directory of popcounts over words,
blocks of words and blocks of blocks gives the rank of an id as directory + popcount(word below the bit). The rank is
the leaf's coordinate. Leaves are put into slot arrays of SLOTS by coordinate, each array is reduced by all its levels
at once, and its top is a slot of the next array, so a tree of n leaves takes log(n) / log(SLOTS) rounds.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, no_clash

#: Slots of an array that is reduced at once; a power of two.
SLOTS = 1024
#: Bits by which the popcount directory goes up: a block has at most 2^STEP children, of 58 bits of word numbers.
STEP, WORD_BITS = 14, 58
#: Word number of rows without an id; they come before all others.
NO_ID = -(1 << (WORD_BITS - 1)) - 1


def digest(text: str) -> str:
    """H: lowercase hex SHA-256 of a text's UTF-8 bytes."""
    return sha256(text.encode()).hexdigest()


def leaf(fields: Iterable[F.Column]) -> F.Column:
    """H of the fields, concatenated: `-` for null, else the number of bytes, a colon and the value."""
    texts = [field.cast("string") for field in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def leaves(docs: DataFrame, id_col: str = "doc_id", part_col: str = "lang", size_col: str = "n_chars", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, part (never null: `=` and the value, or empty, which keeps their order), leaf, tampered (null where nothing is).

    Where 7 divides the CRC-32 of the decimal id, `tampered` is the leaf of the row with 1 added to its size (null sizes
    stay, a largest possible one turns over); rows without an id are not tampered with.
    """
    id_, part, size, text, source = (F.col(c) for c in (id_col, part_col, size_col, text_col, source_col))
    more = F.when(size == (1 << 63) - 1, F.lit(-(1 << 63))).otherwise(F.try_add(size.cast("long"), F.lit(1).cast("long")))
    return docs.select(
        id_.cast("long").alias("id"),
        F.coalesce(F.concat(F.lit("="), part), F.lit("")).alias("part"),
        leaf((id_, source, part, size, text)).alias("leaf"),
        F.when(F.crc32(id_.cast("string")) % 7 == 0, leaf((id_, source, part, more, text))).alias("tampered"),
    )


def _word(id_: F.Column) -> F.Column:
    return F.coalesce(F.shiftright(id_, 6), F.lit(NO_ID))


def bitmap(rows: DataFrame) -> DataFrame:
    """part, word, bits, rows, before: the words of each part's bitmap that have a bit, with the rows before each.

    rows: part, id. The directory is made level by level, each prefix sum within one parent of at most 2^STEP children.
    """
    bit = F.coalesce(F.expr("shiftleft(1L, cast(id & 63 as int))"), F.lit(1).cast("long"))
    words = cut(rows.groupBy("part", _word(F.col("id")).alias("word")).agg(F.bit_or(bit).alias("bits"), F.count("*").alias("rows")))
    levels = [words.withColumnRenamed("word", "k0")]
    while STEP * len(levels) < WORD_BITS:
        i = len(levels)
        parent = F.shiftright(f"k{i - 1}", STEP).alias(f"k{i}")
        levels.append(levels[-1].groupBy("part", parent).agg(F.sum("rows").alias("rows")))
    before = None
    for i in reversed(range(len(levels))):
        up = [F.lit(0).alias("none")] if before is None else [F.shiftright(f"k{i}", STEP).alias("up")]
        level = levels[i].select("*", *up)
        within = Window.partitionBy("part", "none" if before is None else "up").orderBy(f"k{i}").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("inner", F.coalesce(F.sum("rows").over(within), F.lit(0)))
        if before is None:
            level = level.withColumn("before", F.col("inner"))
        else:
            level = level.join(before.select("part", F.col(f"k{i + 1}").alias("up"), F.col("before").alias("outer")), ["part", "up"]).withColumn("before", F.col("outer") + F.col("inner"))
        before = level
    return cut(before.select("part", F.col("k0").alias("word"), "bits", "rows", "before"))


def coordinates(rows: DataFrame) -> DataFrame:
    """rows (part, id, leaf, tampered) with idx, each row's place among its part's, counted from 0, and word.

    The place is the rank of the id in the bitmap. Where ids repeat (words with more rows than bits), the rows of the
    word are counted by (id, first bits of the leaf), so that a hot id falls into many groups; rows of one id are
    in the order of their leaves, and equal rows, which are the same leaf, take the places in any order.
    """
    below = F.expr("if(id & 63 = 0, 0L, shiftrightunsigned(-1L, cast(64 - (id & 63) as int)))")
    words = bitmap(rows.select("part", "id"))
    met = rows.withColumn("word", _word(F.col("id"))).join(words, ["part", "word"])
    single = F.col("rows") == F.bit_count("bits")
    rank = F.col("before") + F.coalesce(F.bit_count(F.col("bits").bitwiseAND(below)), F.lit(0))
    once = met.where(single).select("part", "id", "leaf", "tampered", rank.alias("idx"))
    if words.where(~single).isEmpty():
        return once
    prior = (Window.unboundedPreceding, -1)
    same = met.where(~single).groupBy("part", "word", "before", "id", "leaf", "tampered").agg(F.count("*").alias("n"))
    same = cut(same.withColumn("head", F.substring("leaf", 1, 4)))
    heads = same.groupBy("part", "word", "id", "head").agg(F.sum("n").alias("n"))
    ids = heads.groupBy("part", "word", "id").agg(F.sum("n").alias("n"))
    ids = ids.withColumn("lower", F.coalesce(F.sum("n").over(Window.partitionBy("part", "word").orderBy("id").rowsBetween(*prior)), F.lit(0)))
    heads = heads.withColumn("lower", F.coalesce(F.sum("n").over(Window.partitionBy("part", "word", "id").orderBy("head").rowsBetween(*prior)), F.lit(0)))
    same = same.withColumn("inner", F.coalesce(F.sum("n").over(Window.partitionBy("part", "word", "id", "head").orderBy("leaf").rowsBetween(*prior)), F.lit(0)))
    s, h, i = same.alias("s"), heads.alias("h"), ids.alias("i")
    on_head = (F.col("s.part") == F.col("h.part")) & (F.col("s.word") == F.col("h.word")) & F.col("s.id").eqNullSafe(F.col("h.id")) & (F.col("s.head") == F.col("h.head"))
    on_id = (F.col("s.part") == F.col("i.part")) & (F.col("s.word") == F.col("i.word")) & F.col("s.id").eqNullSafe(F.col("i.id"))
    start = F.col("s.before") + F.col("i.lower") + F.col("h.lower") + F.col("s.inner")
    repeated = s.join(h, on_head).join(i, on_id).select("s.part", "s.id", "s.leaf", "s.tampered", F.explode(F.sequence(start, start + F.col("s.n") - 1)).alias("idx"))
    return once.unionByName(repeated)


def _numbered(parts: DataFrame) -> DataFrame:
    """parts (part, rows) with no: their place in bytewise order, by ranges that are sorted and counted apart."""
    ranged = cut(parts.repartitionByRange("part").sortWithinPartitions("part").select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")))
    ranges = ranged.groupBy("range").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return cut(ranged.join(ranges.select("range", "least", "before"), "range").select("part", "rows", (F.col("before") + F.col("at") - F.col("least")).alias("no")))


def _levels(slots: list[str], n: int, size: int) -> list[list[str]]:
    """All levels of a slot array, from its slots to its top; n: nodes of the whole level that it is a piece of.

    An array of a longer level is always reduced by log2(size) levels, one that is all of its level until one is left.
    """
    levels = [slots]
    steps = size.bit_length() - 1 if n > size else (n - 1).bit_length()
    for _ in range(steps):
        now = levels[-1]
        levels.append([digest("".join(now[i : i + 2])) for i in range(0, len(now), 2)])
    return levels


def _tops(group: pd.DataFrame, size: int) -> pd.DataFrame:
    """The top of one slot array as a slot of the next."""
    n = int(group["n"].iloc[0])
    top = _levels(_slots(group, size), n, size)[-1][0]
    return pd.DataFrame({"part": group["part"].iloc[:1], "idx": group["idx"].iloc[:1] // size, "n": [-(-n // size)], "node": [top]})


def _slots(group: pd.DataFrame, size: int) -> list[str]:
    slots = [""] * len(group)
    for idx, node in zip(group["idx"] % size, group["node"], strict=True):
        slots[idx] = node
    return slots


def _way(levels: list[list[str]], slot: int) -> list[str]:
    """The siblings of a slot, level by level: `<` and the left one, `>` and the right one, or nothing."""
    way = []
    for level in levels[:-1]:
        other = slot ^ 1
        way.append(("<" if other < slot else ">") + level[other] if other < len(level) else "")
        slot //= 2
    return way


def _ways(nodes: pd.DataFrame, above: pd.DataFrame, size: int) -> pd.DataFrame:
    """The way from each node of one slot array to the root, given that of the array's top."""
    levels = _levels(_slots(nodes, size), int(nodes["n"].iloc[0]), size)
    rest, root = list(above["way"].iloc[0]), above["root"].iloc[0]
    subroot = above["subroot"].iloc[0]
    rows = [(part, idx, _way(levels, idx % size) + rest, subroot, root) for part, idx in zip(nodes["part"], nodes["idx"], strict=True)]
    return pd.DataFrame(rows, columns=["part", "idx", "way", "subroot", "root"])


def fold(node: str, way: Iterable[str]) -> str:
    """What a leaf and its siblings give at the root."""
    for step in way:
        node = digest(step[1:] + node if step[:1] == "<" else node + step[1:])
    return node


def _proved(nodes: pd.DataFrame, above: pd.DataFrame, size: int) -> pd.DataFrame:
    """One row a leaf: its proof's digest, and the root recomputed from it or from its tampered form."""
    levels = _levels(_slots(nodes, size), int(nodes["n"].iloc[0]), size)
    rest = list(above["way"].iloc[0])
    subroot, root = above["subroot"].iloc[0], above["root"].iloc[0]
    rows = []
    for id_, idx, node, tampered in zip(nodes["id"].astype("Int64").where(nodes["has_id"]), nodes["idx"], nodes["node"], nodes["tampered"], strict=True):
        way = _way(levels, idx % size) + rest
        folded = fold(node if pd.isna(tampered) else tampered, way)
        rows.append((id_, node, subroot, root, digest("".join(step[1:] for step in way)), folded, folded == root))
    out = pd.DataFrame(rows, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    return out.astype({"id": "Int64"})


def _reduced(nodes: DataFrame, largest: int, size: int) -> list[DataFrame]:
    """All rounds of nodes (part, idx, n, node), from the given ones to one a part; largest: the most nodes of a part."""
    rounds = [nodes]
    while True:
        grouped = rounds[-1].select("part", "idx", "n", "node").groupBy("part", F.expr(f"idx div {size}").alias("array"))
        rounds.append(cut(grouped.applyInPandas(partial(_tops, size=size), "part long, idx long, n long, node string")))
        largest = -(-largest // size)
        if largest <= 1:
            return rounds


def _down(rounds: list[DataFrame], way: DataFrame, last, schema: str, size: int) -> DataFrame:
    """Carry the ways of the tops (part, idx, way, subroot, root) down the rounds; `last` makes the rows of the first."""
    for i in reversed(range(len(rounds) - 1)):
        nodes = rounds[i].groupBy("part", F.expr(f"idx div {size}").alias("array"))
        tops = way.groupBy("part", F.col("idx").alias("array"))
        work, gives = (_ways, WAY) if i else (last, schema)
        way = nodes.cogroup(tops).applyInPandas(partial(work, size=size), gives)
    return way


WAY = "part long, idx long, way array<string>, subroot string, root string"
PROOF = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of rows (part, id, leaf, tampered).

    Each part's leaves ascend by id (none: first); nodes are paired, a last single one becomes its own H, until one is
    left, the part's subroot; subroots, in the order of `part`, give the root in the same way. proof_sha256: H of the
    siblings from leaf to root. folded_root comes from `tampered` where it is not null. An empty table gives no rows.
    """
    rows = cut(rows)
    placed = cut(coordinates(rows))
    parts = _numbered(placed.groupBy("part").agg(F.count("*").alias("rows")))
    size = parts.agg(F.max("rows").alias("most"), F.count("*").alias("parts")).first()
    if not size["parts"]:
        return rows.sparkSession.createDataFrame([], PROOF)
    leaf_nodes = cut(placed.join(parts, "part").select(F.col("no").alias("part"), "idx", F.col("rows").alias("n"), F.col("leaf").alias("node"), F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("has_id"), "tampered"))
    trees = _reduced(leaf_nodes, size["most"], slots)
    subroots = trees[-1].select(F.lit(0).cast("long").alias("part"), F.col("part").alias("idx"), F.lit(size["parts"]).alias("n"), "node")
    top = _reduced(subroots, size["parts"], slots)
    root = top[-1].select("part", "idx", F.array().cast("array<string>").alias("way"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    ways = _down(top, root, _ways, WAY, slots)
    tops = trees[-1].select("part", F.col("node").alias("sub")).join(ways.select(F.col("idx").alias("part"), "way", "root"), "part")
    return _down(trees, tops.select("part", F.lit(0).cast("long").alias("idx"), "way", F.col("sub").alias("subroot"), "root"), _proved, PROOF, slots)


def dataset_manifest(docs: DataFrame, id_col: str = "doc_id", slots: int = SLOTS, **columns: str) -> DataFrame:
    """The manifest of docs with the id under its own name: leaves as `leaves`, tampering included.

    Null fields count as `-`; null ids come first in their part; repeated rows are leaves of their own; other columns do
    not matter; an id column that is named as an output is an error (ValueError).
    """
    no_clash([id_col], "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return manifest(leaves(docs, id_col, **columns), slots).withColumnRenamed("id", id_col)
