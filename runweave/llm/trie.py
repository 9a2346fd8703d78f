"""Prefix trie of conversations, rolled up by centroids.

Conversations that start with the same turns share the nodes of a trie; a node is known by its smallest member and its
depth. Subtree totals are not summed level by level, which takes as many rounds as the longest conversation has turns:
each component of the forest of parent edges is split at its centroid, the total of the centroid's part of the component
is added along the path from the centroid to the component's top, and the pieces, none above half of the nodes, are split
again. Components of many nodes are split by joins, one round for all of them; those of at most LARGEST nodes are
finished within a task. A node gets at most log2(nodes) additions, and there are at most log2(nodes / LARGEST) rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut

#: Components of at most so many nodes are decomposed within one task.
LARGEST = 4096
#: Conversations share the first turns of the first of so many numbers; at most HEADS - 1 turns.
FAMILY, HEADS = 20, 4
#: Turns, depths and ids of one block of prefix sums and lists, as bits.
TURN_BITS, DEPTH_BITS, ID_BITS = 8, 10, 12
_PRIOR = (Window.unboundedPreceding, -1)


def _before(value: str, keys: list[str], *order: str) -> Column:
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*_PRIOR)), F.lit(0))


def positions(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(runs, convs): runs are conv, a, b (hashes of role and text), words, n, pos; convs are conv, turns, h, base.

    Equal rows of one turn number are one run of n places from pos, counted from 1. Turns are in the order of their
    numbers (null first), then of their hashes. No window holds a conversation: places are summed by blocks of turn
    numbers, then by number and first bits of the hash, then within those. Rows without a conversation are left out.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turn = F.col(turn_col).cast("long")
    given = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.coalesce(F.shiftright(turn, TURN_BITS), F.lit(-(1 << 62))).alias("block"),
        turn.isNotNull().alias("numbered"), F.coalesce(turn, F.lit(0)).alias("turn"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"),
        F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("words"),
    )
    runs = given.groupBy("conv", "block", "numbered", "turn", F.shiftright("a", 56).alias("head"), "a", "b").agg(F.max("words").alias("words"), F.count("*").alias("n"))
    runs = cut(runs)
    fine = runs.groupBy("conv", "block", "numbered", "turn", "head").agg(F.sum("n").alias("n"))
    coarse = cut(fine.groupBy("conv", "block").agg(F.sum("n").alias("n")))
    convs = coarse.groupBy("conv").agg(F.sum("n").alias("turns"))
    h = (F.crc32(F.col("conv").cast("string")) % HEADS).cast("long")
    convs = cut(convs.select("conv", "turns", h.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base")))
    coarse = coarse.withColumn("outer", _before("n", ["conv"], "block"))
    fine = fine.withColumn("inner", _before("n", ["conv", "block"], "numbered", "turn", "head"))
    fine = fine.join(coarse.select("conv", "block", "outer"), ["conv", "block"]).select("conv", "block", "numbered", "turn", "head", (F.col("outer") + F.col("inner")).alias("start"))
    keys = ["conv", "block", "numbered", "turn", "head"]
    placed = runs.join(fine, keys).withColumn("pos", F.col("start") + _before("n", keys, "a", "b") + 1)
    return placed.select("conv", "a", "b", "words", "n", "pos"), convs


def rebuilt(runs: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths): conv, depth, a, b, words of every rebuilt turn; conv, len of every rebuilt conversation.

    Conversation c takes the first h turns of the conversation `base` (none if there is none), then its own after its
    first h.
    """
    runs = cut(runs)
    many = F.explode(F.sequence("pos", F.least(F.col("pos") + F.col("n") - 1, F.lit(HEADS - 1))))
    heads = runs.where(F.col("pos") < HEADS).select(F.col("conv").alias("base"), "a", "b", "words", many.alias("depth"))
    bases = convs.select(F.col("conv").alias("base"), F.col("turns").alias("base_turns"))
    known = cut(convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("base_turns", F.lit(0)))))
    taken = known.select("conv", "base", "h").join(heads, "base").where("depth <= h").select("conv", "depth", "a", "b", "words")
    first, shift = F.greatest(F.col("pos"), F.col("h") + 1), F.col("k") - F.col("h")
    own = runs.join(known.select("conv", "h", "k"), "conv").where("pos + n - 1 > h")
    own = own.select("conv", F.explode(F.sequence(first + shift, F.col("pos") + F.col("n") - 1 + shift)).alias("depth"), "a", "b", "words")
    lengths = known.select("conv", (F.col("k") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("len"))
    return taken.unionByName(own), lengths


def members(turns: DataFrame) -> DataFrame:
    """conv, depth, rep, n_convs, words: the node of each conversation at each depth, by its smallest member.

    A sequence of turns is known by 108 bits: sums over its turns of hashes of (depth, role, text), which are prefix
    sums, made by blocks of depths.
    """
    low = F.lit((1 << 36) - 1)
    hashed = turns.withColumns({"x": F.xxhash64("depth", "a", "b"), "y": F.xxhash64("b", "a", "depth")})
    hashed = hashed.select(
        "conv", "depth", F.shiftright(F.col("depth") - 1, DEPTH_BITS).alias("block"), "words", F.col("x").bitwiseAND(low).alias("k1"), F.col("y").bitwiseAND(low).alias("k2"),
        (F.shiftrightunsigned("x", 36) + F.shiftleft(F.shiftrightunsigned("y", 36).bitwiseAND(255), 28)).alias("k3"),
    )
    hashed = cut(hashed)
    sums = hashed.groupBy("conv", "block").agg(*[F.sum(k).alias(k) for k in ("k1", "k2", "k3")])
    sums = sums.select("conv", "block", *[_before(k, ["conv"], "block").alias(f"o{k}") for k in ("k1", "k2", "k3")])
    here = Window.partitionBy("conv", "block").orderBy("depth")
    keyed = hashed.join(sums, ["conv", "block"]).select("conv", "depth", "words", *[(F.sum(k).over(here) + F.col(f"o{k}")).alias(k) for k in ("k1", "k2", "k3")])
    keyed, keys = cut(keyed), ["depth", "k1", "k2", "k3"]
    found = keyed.groupBy(*keys).agg(F.min("conv").alias("rep"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    return cut(keyed.select("conv", *keys).join(found, keys).select("conv", "depth", "rep", "n_convs", "words"))


def nodes(met: DataFrame, lengths: DataFrame) -> DataFrame:
    """rep, depth, parent, n_convs, n_children, saved, leaf, size of every node of the trie over members `met`.

    size counts a node's subtree: each member adds the nodes that it is the smallest member of, which are the end of its
    way; only the node's own smallest member has some of them above the node.
    """
    whole = lengths.agg(F.min("conv").alias("rep"), F.count("*").alias("n_convs")).first()
    own = lengths.join(met.where("conv = rep").groupBy("conv").agg(F.count("*").alias("own")), "conv", "left").select("conv", "len", F.coalesce("own", F.lit(0)).alias("own"))
    own = cut(own)
    below = met.select("conv", "depth", "rep").join(own.select("conv", "own"), "conv").groupBy("rep", "depth").agg(F.sum("own").alias("below"))
    first = met.where("conv = rep").select("rep", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    up = met.select(F.col("conv").alias("rep"), (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent"))
    made = first.join(below, ["rep", "depth"]).join(own.select(F.col("conv").alias("rep"), "len", "own"), "rep")
    size = F.col("below") - F.col("own") + F.col("len") - F.col("depth") + 1
    made = cut(made.join(up, ["rep", "depth"], "left").select("rep", "depth", "parent", "n_convs", "saved", size.alias("size")))
    made = made.withColumn("parent", F.when(F.col("depth") == 1, F.lit(whole["rep"]).cast("long")).otherwise(F.col("parent")))
    root = [(whole["rep"], 0, None, whole["n_convs"], 0, made.count() + 1)] if whole["n_convs"] else []
    made = cut(made.unionByName(made.sparkSession.createDataFrame(root, "rep long, depth long, parent long, n_convs long, saved long, size long")))
    children = made.where("depth > 0").groupBy(F.col("parent").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    made = made.join(children, ["rep", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return cut(made.withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")))


STATE = "rep long, depth long, parent long, leaf long, saved long, size long, crep long, cdepth long, total long, n_leaves long, saved_tokens long, done boolean"


def rolled(tree: DataFrame, met: DataFrame, largest: int = LARGEST) -> DataFrame:
    """rep, depth, n_leaves, saved_tokens: the sums of leaf and saved over the subtree of every node of `tree`."""
    root = tree.where("depth = 0").first() or {"rep": None, "size": 0}
    value = lambda x: F.lit(x).cast("long")
    begin = (value(root["rep"]).alias("crep"), value(0).alias("cdepth"), value(root["size"]).alias("total"), value(0).alias("n_leaves"), value(0).alias("saved_tokens"))
    state = cut(tree.select("rep", "depth", "parent", "leaf", "saved", "size", *begin, F.lit(False).alias("done")))
    finished = [state.where((F.col("total") <= largest) | F.col("done"))]
    while not (big := state.where((F.col("total") > largest) & ~F.col("done"))).isEmpty():
        state = cut(_split(big, met))
        finished.append(state.where((F.col("total") <= largest) | F.col("done")))
    rest = finished[0]
    for more in finished[1:]:
        rest = rest.unionByName(more)
    near = rest.where(~F.col("done")).repartition("crep", "cdepth").sortWithinPartitions("crep", "cdepth", "depth")
    out = "rep long, depth long, n_leaves long, saved_tokens long"
    local = near.select("rep", "depth", F.coalesce("parent", F.lit(-1)).alias("parent"), "leaf", "saved", "crep", "cdepth", "n_leaves", "saved_tokens").mapInPandas(_finished, out)
    return local.unionByName(rest.where("done").select("rep", "depth", "n_leaves", "saved_tokens"))


def _split(big: DataFrame, met: DataFrame) -> DataFrame:
    """Every component of `big` cut at its centroid; its part of the total is added along the way to its top.

    The nodes of which the subtree holds half of the component or more are the way from the top to the centroid. Which
    nodes lie under the centroid is looked up: a node's ancestor at a depth is its smallest member's node there.
    """
    comp = ["crep", "cdepth"]
    on_way = F.col("size") * 2 >= F.col("total")
    centroid = big.where(on_way).groupBy(*comp).agg(F.min_by(F.struct("rep", "depth", "size"), "size").alias("c"))
    joined = big.join(centroid, comp).withColumn("c_depth", F.col("c.depth"))
    at = met.select(F.col("conv").alias("rep"), F.col("depth").alias("c_depth"), F.col("rep").alias("there"))
    below = met.select(F.col("conv").alias("rep"), (F.col("depth") - 1).alias("c_depth"), F.col("rep").alias("branch"))
    joined = joined.join(at, ["rep", "c_depth"], "left").join(below, ["rep", "c_depth"], "left")
    under = (F.col("c_depth") == 0) | ((F.col("there") == F.col("c.rep")) & (F.col("depth") >= F.col("c_depth")))
    joined = cut(joined.withColumn("under", F.coalesce(under, F.lit(False))))
    part = joined.where("under").groupBy(*comp).agg(F.sum("leaf").alias("add_leaf"), F.sum("saved").alias("add_saved"))
    joined = joined.join(part, comp)
    is_c = (F.col("rep") == F.col("c.rep")) & (F.col("depth") == F.col("c_depth"))
    falls = F.col("under") & ~is_c
    cut_at = joined.select(
        "rep", "depth", "parent", "leaf", "saved",
        F.when(on_way & ~is_c, F.col("size") - F.col("c.size")).otherwise(F.col("size")).alias("size"),
        F.when(falls, F.col("branch")).otherwise(F.col("crep")).alias("crep"),
        F.when(falls, F.col("c_depth") + 1).otherwise(F.col("cdepth")).alias("cdepth"),
        (F.col("n_leaves") + F.when(on_way, F.col("add_leaf")).otherwise(0)).alias("n_leaves"),
        (F.col("saved_tokens") + F.when(on_way, F.col("add_saved")).otherwise(0)).alias("saved_tokens"),
        is_c.alias("done"),
    )
    cut_at = cut(cut_at)
    totals = cut_at.where(~F.col("done")).groupBy(*comp).agg(F.count("*").alias("total"))
    return cut_at.join(totals, comp, "left").select(*[F.coalesce("total", F.lit(1)).alias("total") if c.startswith("total") else c.split()[0] for c in STATE.split(", ")])


def _finished(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the components that lie one after another in the frames."""
    rows: list[tuple] = []
    out: list[tuple] = []
    for frame in frames:
        for row in frame.itertuples(index=False, name=None):
            if rows and rows[-1][5:7] != row[5:7]:
                out += _decomposed(rows)
                rows = []
            rows.append(row)
        if len(out) > 1 << 16:
            yield _frame(out)
            out = []
    yield _frame(out + (_decomposed(rows) if rows else []))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["rep", "depth", "n_leaves", "saved_tokens"], dtype="int64")


def _decomposed(rows: list[tuple]) -> list[tuple]:
    """(rep, depth, leaves, saved) of the nodes (rep, depth, parent, leaf, saved, ...) of one component, top first."""
    at = {row[:2]: i for i, row in enumerate(rows)}
    children: list[list[int]] = [[] for _ in rows]
    for i, (_, depth, parent, *_) in enumerate(rows[1:], 1):
        children[at[parent, depth - 1]].append(i)
    size = [1] * len(rows)
    for i in range(len(rows) - 1, 0, -1):
        size[at[rows[i][2], rows[i][1] - 1]] += size[i]
    sums = [[row[7], row[8]] for row in rows]
    gone = [False] * len(rows)
    tops = [0]
    while tops:
        top = tops.pop()
        way, total = [top], size[top]
        while (heavy := next((c for c in children[way[-1]] if not gone[c] and 2 * size[c] >= total), None)) is not None:
            way.append(heavy)
        centroid = way[-1]
        leaves = saved = 0
        walk = [centroid]
        while walk:
            node = walk.pop()
            leaves, saved = leaves + rows[node][3], saved + rows[node][4]
            walk += [c for c in children[node] if not gone[c]]
        for node in way:
            sums[node][0] += leaves
            sums[node][1] += saved
        for node in way[:-1]:
            size[node] -= size[centroid]
        gone[centroid] = True
        tops += [c for c in children[centroid] if not gone[c]]
        if centroid != top:
            tops.append(top)
    return [(*row[:2], *both) for row, both in zip(rows, sums, strict=True)]


def ends(met: DataFrame, lengths: DataFrame) -> DataFrame:
    """rep, depth, ends_sha256 of nodes at which conversations end: H of their ids in order, joined by commas.

    Ids are put into lists by blocks of numbers; a node's lists then pass one after another through its hash.
    """
    stops = lengths.join(met.select("conv", F.col("depth").alias("len"), "rep"), ["conv", "len"]).select("rep", F.col("len").alias("depth"), "conv")
    least = lengths.agg(F.min("conv")).first()[0]
    stops = stops.unionByName(lengths.where("len = 0").select(F.lit(least).cast("long").alias("rep"), F.col("len").alias("depth"), "conv"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    lists = stops.groupBy("rep", "depth", F.shiftright("conv", ID_BITS).alias("block")).agg(ids.alias("ids"))
    lists = lists.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "block")
    return lists.mapInPandas(_hashed, "rep long, depth long, ends_sha256 string")


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    node, state = None, None
    for frame in frames:
        out = []
        for rep, depth, ids in zip(frame["rep"], frame["depth"], frame["ids"], strict=True):
            if (rep, depth) != node:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (rep, depth), sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["rep", "depth", "ends_sha256"])
    if node:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["rep", "depth", "ends_sha256"])


def prefix_trie(conversations: DataFrame, largest: int = LARGEST, **columns: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    A null role or text is empty; a null turn number comes first; turns of one number are in the order of their hashes;
    rows without a conversation are left out; an empty table has no nodes; other columns do not matter.
    """
    runs, convs = positions(conversations, **columns)
    turns, lengths = rebuilt(runs, convs)
    lengths = cut(lengths)
    met = members(turns)
    tree = nodes(met, lengths)
    sums = rolled(tree, met, largest)
    stops = ends(met, lengths)
    nothing = F.lit(sha256(b"").hexdigest())
    return (
        tree.select("rep", "depth", "parent", "n_convs", "n_children")
        .join(sums, ["rep", "depth"])
        .join(stops, ["rep", "depth"], "left")
        .select(F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    )
