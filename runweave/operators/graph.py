"""Operators over dependency graphs: nodes (id, status), edges (src depends on dst).

Loops write what is new in each round, once, and stop when nothing is; what is known is the union of what was written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut, shuffled, spread

#: Most nodes of a graph whose sets of members are whole (fixed value).
MOST_MEMBERS = 1 << 20
#: Members and targets of a component that one task pairs, and those in a list of theirs (fixed values). Rows whose columns
#: repeat after a multiple of eight are written as Parquet in a tenth of the bytes.
BLOCK, TARGETS, LISTED, SHORT = 1 << 12, 1 << 16, 256, 32


def frontier(nodes: DataFrame, edges: DataFrame, open_: tuple[str, ...] = ("stated", "audited"), done: str = "proved") -> DataFrame:
    """Open nodes all of whose dependencies are done; a dependency that is missing blocks."""
    blocked = edges.join(nodes.where(F.col("status") == done).select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.where(F.col("status").isin(*open_)).join(blocked.select(F.col("src").alias("id")), "id", "left_anti")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the strongly connected components of two nodes (id) or more, by their least ids.

    What neither lies on nor between cycles is left out first, from both ends. Then each round colours the nodes by the
    least id that leads to them; what leads back to that id within its colour is its component, and the rest goes on.
    """
    between = lambda ids: edges.join(shuffled(ids.select(F.col("id").alias("src"))), "src", "left_semi").join(shuffled(ids.select(F.col("id").alias("dst"))), "dst", "left_semi").select("src", "dst")
    up = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    rest = cut(levels(nodes, edges).where("level is null").select("id"))
    if not rest.isEmpty():
        rest = cut(levels(rest, up.join(shuffled(rest.select(F.col("id").alias("dst"))), "dst", "left_semi").select("src", "dst")).where("level is null").select("id"))
    done = [cut(rest.limit(0).select("id", F.col("id").alias("component")))]
    inside = cut(between(rest).where("src <> dst").distinct())
    while not rest.isEmpty():
        colour = cut(rest.select("id", F.col("id").alias("colour")))
        new = colour
        while not new.isEmpty():
            told = inside.join(shuffled(new.select(F.col("id").alias("src"), "colour")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("told"))
            both = cut(colour.join(shuffled(told), "id", "left").select("id", F.least("colour", "told").alias("colour"), F.coalesce(F.col("told") < F.col("colour"), F.lit(False)).alias("lower")))
            colour, new = both.select("id", "colour"), both.where("lower").select("id", "colour")
        inside = cut(inside.join(shuffled(colour.select(F.col("id").alias("src"), "colour")), "src").join(shuffled(colour.select(F.col("id").alias("dst"), F.col("colour").alias("other"))), "dst").where("colour = other").select("src", "dst"))
        back = reach_from(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("id = colour").select("id"))
        done.append(cut(back.join(shuffled(colour), "id").select("id", F.col("colour").alias("component"))))
        rest = cut(colour.join(shuffled(done[-1]), "id", "left_anti").select("id"))
        inside = cut(inside.join(shuffled(rest.select(F.col("id").alias("src"))), "src", "left_semi").join(shuffled(rest.select(F.col("id").alias("dst"))), "dst", "left_semi").select("src", "dst"))
    found = _union(done)
    return found.join(shuffled(found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")), "component", "left_semi").select("id", "component")


def _condensed(edges: DataFrame, of: DataFrame) -> DataFrame:
    """src, dst: edges between components; of: id, component of the nodes that share one."""
    for end in ("src", "dst"):
        edges = edges.join(shuffled(of.select(F.col("id").alias(end), F.col("component").alias("_of"))), end, "left").withColumn(end, F.coalesce("_of", end)).drop("_of")
    return cut(edges.where("src <> dst").select("src", "dst").distinct())


def reach(edges: DataFrame) -> DataFrame:
    """src, dst: the transitive closure without self pairs.

    Cycles are first taken as one node each. Then nodes are visited by level, so that each gathers the finished sets of
    those it leads to once, whatever the number of paths; large graphs have them in parts by the hash of the member.
    """
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())
    nodes = cut(edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct())
    parts = 1 + nodes.count() // MOST_MEMBERS
    placed, of = cut(levels(nodes, edges)), None
    if not placed.where("level is null").isEmpty():
        of = cut(components(placed.where("level is null").select("id"), edges))
        edges = _condensed(edges, of)
        placed = cut(levels(edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct(), edges))
    rows = cut(edges.join(shuffled(placed.select(F.col("id").alias("src"), "level")), "src"))
    top = placed.agg(F.max("level")).first()[0] or 0
    sets = []
    for level in range(1, top + 1):
        mine = rows.where(F.col("level") == level).select("src", "dst")
        own = mine.select("src", F.pmod(F.xxhash64("dst"), F.lit(parts)).alias("part"), F.array("dst").alias("members"))
        if sets:
            below = _union(sets).withColumnRenamed("src", "dst")
            own = own.unionByName(mine.join(shuffled(below), "dst").select("src", "part", "members"))
        sets.append(cut(own.groupBy("src", "part").agg(F.array_distinct(F.flatten(F.collect_list("members"))).alias("members"))))
    out = _union(sets).select("src", F.explode("members").alias("dst")) if sets else edges.select("src", "dst")
    if of is None:
        return out
    within = of.select(F.col("id").alias("src"), "component").join(of.select(F.col("id").alias("dst"), "component"), "component").where("src <> dst").select("src", "dst")
    for end in ("src", "dst"):
        out = out.join(shuffled(of.select(F.col("component").alias(end), F.col("id").alias("_id"))), end, "left").withColumn(end, F.coalesce("_id", end)).drop("_id")
    return out.select("src", "dst").unionByName(within)


def reach_from(edges: DataFrame, starts: DataFrame, *keys: str) -> DataFrame:
    """(*keys, id): what the starts (*keys, id) lead to along edges from src to dst, themselves included."""
    edges = cut(edges.select("src", "dst"))
    new = cut(starts.select(*keys, "id").distinct())
    known = [new]
    while not new.isEmpty():
        found = new.withColumnRenamed("id", "src").join(shuffled(edges), "src").select(*keys, F.col("dst").alias("id")).distinct()
        new = cut(found.join(shuffled(_union(known)), [*keys, "id"], "left_anti"))
        known.append(new)
    return _union(known)


def dependents(edges: DataFrame, start: DataFrame) -> DataFrame:
    """id of each node that depends on one of start (id), directly or not; start nodes only if they do."""
    up = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    first = up.join(start.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("id"))
    return reach_from(up, first)


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, level: 0 without dependencies, else one more than the highest dependency; null for nodes on or behind a cycle.

    A round counts down the open dependencies of the nodes above those placed last; only what is new is written.
    """
    edges = cut(edges.select("src", "dst").distinct().join(shuffled(nodes.select(F.col("id").alias("src"))), "src", "left_semi").select("src", "dst"))
    degree = cut(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("open")))
    placed = [cut(nodes.select("id").distinct().join(shuffled(degree), "id", "left_anti").withColumn("level", F.lit(0)))]
    met: list[DataFrame] = []
    while not placed[-1].isEmpty():
        below = placed[-1].select(F.col("id").alias("dst"))
        met.append(cut(edges.join(shuffled(below), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("met"))))
        sums = _union(met).join(shuffled(met[-1].select("id")), "id", "left_semi").groupBy("id").agg(F.sum("met").alias("met"))
        placed.append(cut(sums.join(shuffled(degree), "id").where("met = open").select("id", F.lit(len(placed)).alias("level"))))
    found = _union(placed)
    return found.unionByName(degree.join(shuffled(found), "id", "left_anti").select("id", F.lit(None).cast("int").alias("level")))


def schedule(items: DataFrame, edges: DataFrame) -> DataFrame:
    """label, position, level, in_cycle, unresolved: items (label, ordinal) in rounds of what is ready, by ordinal.

    edges: src uses dst. Items on or behind a cycle come last by ordinal; unresolved counts dependencies that are no item.
    """
    nodes = items.select(F.col("label").alias("id"))
    known = edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    lacking = edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").groupBy(F.col("src").alias("label")).agg(F.count_distinct("dst").alias("unresolved"))
    rows = items.join(levels(nodes, known).withColumnRenamed("id", "label"), "label").join(lacking, "label", "left")
    # Positions by counts: those of the levels before, and a rank within the level.
    sizes = rows.groupBy("level").agg(F.count("*").alias("n"))
    before = sizes.select("level", F.coalesce(F.sum("n").over(Window.orderBy(F.col("level").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("level").orderBy("ordinal", "label")))
    placed = ranked.join(F.broadcast(before.withColumnRenamed("level", "of")), F.col("level").eqNullSafe(F.col("of")))
    return placed.select("label", (F.col("before") + F.col("rank")).alias("position"), "level", F.col("level").isNull().alias("in_cycle"), F.coalesce("unresolved", F.lit(0)).alias("unresolved"))


def roots(parents: DataFrame) -> DataFrame:
    """id, root: the end of each parent chain (id, parent), by pointer jumping in about log n rounds.

    A parent that is no id ends the chain. Chains that run into a cycle end at its least id.
    """
    base = parents.select("id", F.coalesce("parent", "id").alias("root"))
    # least: the least id met on the way; on a cycle, after enough doublings, that of the cycle itself.
    now = cut(base.withColumn("least", F.least("id", "root")))
    for _ in range(64):
        up = now.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("least").alias("further"))
        jumped = cut(now.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.least("least", F.coalesce("further", "least")).alias("least"), (F.coalesce("next", "root") != F.col("root")).alias("moved"), (F.coalesce("further", "least") < F.col("least")).alias("lower")))
        now = jumped.select("id", "root", "least")
        if jumped.where("moved").isEmpty():
            return now.select("id", "root")
        if jumped.where("lower").isEmpty():
            break
    # What still moves lies on or behind a cycle: where it points to now is on the cycle, whose least id is met there.
    ends = parents.where("parent is null").select(F.col("id").alias("root")).unionByName(parents.select(F.col("parent").alias("root")).where("root is not null").join(parents.select(F.col("id").alias("root")), "root", "left_anti")).distinct()
    straight = now.join(ends, "root", "left_semi").select("id", "root")
    on_cycle = now.select(F.col("id").alias("root"), F.col("least").alias("end"))
    return straight.unionByName(now.join(ends, "root", "left_anti").join(on_cycle, "root").select("id", F.col("end").alias("root")))


def _down(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'depends_on'").select("src", "dst").unionByName(edges.where("kind = 'split_of'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def family(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """target, id: what each target (id) leads to by depends_on from src and by split_of from dst, itself included."""
    asked = targets.select(F.col("id").alias("target")).distinct()
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).unionByName(targets.select("id")).distinct()
    return _families_with(edges, asked, ids)


def _lists(df: DataFrame, name: str, value: Column, length: int, *keys: str) -> DataFrame:
    """*keys, name: value of the rows of df in sorted lists of one length; only the last one of a group is shorter."""
    whole = df.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(name))
    starts = F.sequence(F.lit(1), F.size(name), F.lit(length))
    return whole.withColumn(name, F.explode(F.transform(starts, lambda at: F.slice(name, at, length))))


def _families_with(edges: DataFrame, targets: DataFrame, ids: DataFrame, *same: str, later: str = "") -> DataFrame:
    """target, id: for each of targets (target, ...) those of ids (id, ...) that are in its family.

    same: columns that both have alike; later: one that must be greater for the id. Nodes of one cycle have one family,
    so it is walked between components, and only from those (or back to those) that are asked, whichever are fewer.
    Pairs of nodes are made last, of lists of targets and members, and are neither kept nor shuffled.
    """
    down = cut(_down(edges).where("src <> dst"))
    nodes = down.select(F.col("src").alias("id")).unionByName(down.select(F.col("dst").alias("id"))).distinct()
    of = cut(components(nodes, down))
    along = _condensed(down, of)
    placed = lambda df, c, as_: df.join(shuffled(of.select(F.col("id").alias(c), F.col("component").alias("_of"))), c, "left").withColumn(as_, F.coalesce("_of", c)).drop("_of")
    targets, ids = cut(placed(targets, "target", "top")), cut(placed(ids, "id", "component"))
    starts, ends = targets.select("top").distinct(), ids.select("component").distinct()
    if starts.count() <= ends.count():
        pairs = reach_from(along, starts.select("top", F.col("top").alias("id")), "top").withColumnRenamed("id", "component")
    else:
        up = along.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        pairs = reach_from(up, ends.select("component", F.col("component").alias("id")), "component").withColumnRenamed("id", "top")
    return _paired(targets.join(shuffled(pairs), "top").drop("top"), ids, ["component", *same], later)


def _paired(asked: DataFrame, held: DataFrame, keys: list[str], later: str) -> DataFrame:
    """target, id of the rows of asked (*keys, target) and held (*keys, id) of one key; later: a column that is greater in held.

    A key is dealt as blocks of its targets by blocks of its ids. What is shuffled for a block are lists, so it is less
    than its pairs by the length of a block.
    """
    value = (lambda c: F.struct(later, c)) if later else F.col
    sizes = asked.groupBy(*keys).agg(F.ceil(F.count("*") / TARGETS).alias("tall")).join(shuffled(held.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("wide"))), keys)
    asked = asked.join(shuffled(sizes), keys).withColumn("i", F.pmod(F.xxhash64("target"), "tall"))
    held = held.join(shuffled(sizes), keys).withColumn("j", F.pmod(F.xxhash64("id"), "wide"))
    # Lists are dealt before each goes to all blocks of the other side: a task has the copies of one list at a time.
    asked = spread(_lists(asked, "targets", value("target"), LISTED, *keys, "i", "wide")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("wide") - 1))).drop("wide")
    held = spread(_lists(held, "ids", value("id"), SHORT, *keys, "j", "tall")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tall") - 1))).drop("tall")
    block = [*keys, "i", "j"]
    met = spread(held, *block).join(shuffled(spread(asked, *block)), block)
    if later:
        met = met.where(F.element_at("ids", -1)[later] > F.element_at("targets", 1)[later])
    rows = met.select("targets", F.explode("ids").alias("m")).select("m", F.explode("targets").alias("t"))
    return rows.where(F.col("m")[later] > F.col("t")[later]).select("t.target", "m.id") if later else rows.select(F.col("t").alias("target"), F.col("m").alias("id"))


def invalidate(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """nodes with the status after ids turn out false: they are false, and their split ancestors drop to conjectured.

    A false ancestor stays; a proved one drops only if it depends on the child through which the chain comes.
    """
    up = edges.where("kind = 'split_of'").select("src", "dst")
    chain = reach_from(up, ids.select("id"))
    steps = up.join(chain.select(F.col("id").alias("src")), "src", "left_semi")
    used = edges.where("kind = 'depends_on'").select(F.col("src").alias("dst"), F.col("dst").alias("src")).withColumn("used", F.lit(True)).distinct()
    hit = steps.join(used, ["src", "dst"], "left").groupBy(F.col("dst").alias("id")).agg(F.bool_or(F.coalesce("used", F.lit(False))).alias("used"))
    gone = ids.select("id").distinct().withColumn("gone", F.lit(True))
    status = F.when(F.col("gone"), "false").when(F.col("used").isNotNull() & (F.col("status") != "false") & ((F.col("status") != "proved") | F.col("used")), "conjectured").otherwise(F.col("status"))
    return nodes.join(gone, "id", "left").join(hit, "id", "left").select(*(status.alias(c) if c == "status" else c for c in nodes.columns))


def lineage(jobs: DataFrame) -> DataFrame:
    """job_id, ancestor, distance: the jobs whose dotted id is a prefix of another's, by equality of each prefix."""
    parts = F.split("job_id", r"\.")
    each = jobs.select("job_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), ".").alias("ancestor"), (F.size(parts) - n).alias("distance")))).alias("p")).where("p.distance > 0")
    return each.select("job_id", "p.ancestor", "p.distance").join(jobs.select(F.col("job_id").alias("ancestor")).distinct(), "ancestor", "left_semi").select("job_id", "ancestor", "distance")


def split_ancestors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, ancestor: the split parents of a node, and theirs, as long as each is in the file of the node."""
    of = nodes.select("id", "file")
    same = edges.where("kind = 'split_of'").join(of.select(F.col("id").alias("src"), "file"), "src").join(of.select(F.col("id").alias("dst"), F.col("file").alias("other")), "dst").where("file = other").select("src", "dst")
    return reach(same).select(F.col("src").alias("id"), F.col("dst").alias("ancestor"))


def assignment_frontier(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """target, id, status: the ready nodes among the direct dependencies and split children of each target (id)."""
    beside = edges.where("kind = 'depends_on'").select(F.col("src").alias("target"), F.col("dst").alias("id")).unionByName(edges.where("kind = 'split_of'").select(F.col("dst").alias("target"), F.col("src").alias("id"))).distinct()
    mine = beside.join(targets.select(F.col("id").alias("target")), "target", "left_semi")
    ready = frontier(nodes.select("id", "status"), edges.where("kind = 'depends_on'").select("src", "dst"))
    return mine.join(ready, "id").select("target", "id", "status")


def completed_splits(before: DataFrame, after: DataFrame, edges: DataFrame) -> DataFrame:
    """parent, id: newly proved dependencies that complete a split parent: all of its are proved now and were not before."""
    parents = after.where("status = 'split'").select(F.col("id").alias("src")).unionByName(before.where("status = 'split'").select(F.col("id").alias("src"))).distinct()
    deps = edges.where("kind = 'depends_on'").select("src", "dst").distinct().join(parents.join(after.select(F.col("id").alias("src")), "src", "left_semi"), "src", "left_semi")
    was, now = before.select(F.col("id").alias("dst"), (F.col("status") == "proved").alias("was")), after.select(F.col("id").alias("dst"), (F.col("status") == "proved").alias("now"))
    rows = deps.join(was, "dst", "left").join(now, "dst", "left").select("src", "dst", F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("now", F.lit(False)).alias("now"))
    done = rows.groupBy("src").agg(F.bool_and("now").alias("all_now"), F.bool_and("was").alias("all_was")).where("all_now and not all_was")
    return rows.where("now and not was").join(done, "src", "left_semi").select(F.col("src").alias("parent"), F.col("dst").alias("id"))


def open_subgoals(nodes: DataFrame, edges: DataFrame, n: int = 25) -> DataFrame:
    """rank, id, status: ready nodes (0), those that wait (1), blocked or parked ones (2), the first n by rank and id."""
    ready = frontier(nodes.select("id", "status"), edges.where("kind = 'depends_on'").select("src", "dst")).select("id", F.lit(True).alias("ready"))
    rank = F.when(F.col("ready"), 0).when(F.col("status").isin("stated", "audited", "conjectured", "proving"), 1).when(F.col("status").isin("blocked", "parked"), 2)
    return nodes.join(ready, "id", "left").withColumn("rank", rank).where("rank is not null").orderBy("rank", "id").limit(n).select("rank", "id", "status")


def merge_delta(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, changes) after a delta. nodes: id, statement, status, notes; edges: src, dst, kind.

    A node that is there keeps its values; blank ones are filled. Another statement than its own is rejected (change
    `signature_conflict`, nothing of that row is taken). A new node is `stated` with a statement, else `conjectured`,
    whatever it says. Edges are one each; those to itself or to no node are dropped (`self_edge`, `dangling_edge`).
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    old, new = nodes.alias("o"), new_nodes.alias("d")
    both = old.join(new, F.col("o.id") == F.col("d.id"), "full")
    fresh = F.col("o.id").isNull()
    conflict = ~fresh & F.col("d.id").isNotNull() & ~blank(F.col("o.statement")) & ~blank(F.col("d.statement")) & (F.col("o.statement") != F.col("d.statement"))
    filled = lambda c: F.when(blank(F.col(f"o.{c}")) & ~conflict, F.coalesce(f"d.{c}", f"o.{c}")).otherwise(F.col(f"o.{c}"))
    merged = both.select(F.coalesce("o.id", "d.id").alias("id"), filled("statement").alias("statement"), F.when(fresh, F.when(blank(F.col("d.statement")), "conjectured").otherwise("stated")).otherwise(F.col("o.status")).alias("status"), filled("notes").alias("notes"))
    conflicts = both.where(conflict).select(F.col("o.id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit("signature_conflict").alias("change"))
    known = merged.select("id")
    added = new_edges.select("src", "dst", "kind").distinct()
    inside = added.where("src <> dst").join(known.select(F.col("id").alias("src")), "src", "left_semi").join(known.select(F.col("id").alias("dst")), "dst", "left_semi")
    out = edges.select("src", "dst", "kind").unionByName(inside.select("src", "dst", "kind")).distinct()
    dropped = added.where("src <> dst").join(inside, ["src", "dst", "kind"], "left_anti").select("src", "dst", F.lit("dangling_edge").alias("change"))
    return merged, out, conflicts.unionByName(added.where("src = dst").select("src", "dst", F.lit("self_edge").alias("change"))).unionByName(dropped)


def reconcile(nodes: DataFrame, edges: DataFrame, truth: DataFrame, generators: tuple[str, ...] = ("planner", "decomposer", "prover-edit", "prover-edit-backfill")) -> DataFrame:
    """nodes with new_status after a look at what is there: truth (file, name, present, dirty). Nothing becomes proved.

    Only nodes of files in truth are judged. A proved node is conjectured if it depends on a false or parked one or is
    gone, stated if it is dirty; an open node of a generator that is gone is conjectured; a conjectured one that is
    there is stated, unless it is marked uncertain and comes from the planner or the decomposer.
    """
    seeds = nodes.where("status in ('false', 'parked')").select("id")
    invalid = dependents(edges.where("kind = 'depends_on'").select("src", "dst"), seeds).withColumn("invalid", F.lit(True))
    seen = truth.select("file").distinct().withColumn("seen", F.lit(True))
    rows = nodes.join(seen, "file", "left").join(truth.select("file", "name", F.col("present").alias("here"), F.col("dirty").alias("bad")), ["file", "name"], "left").join(invalid, "id", "left")
    here, bad, status = F.coalesce("here", F.lit(False)), F.coalesce("bad", F.lit(False)), F.col("status")
    uncertain = F.col("generated_by").isin("planner", "decomposer") & F.col("uncertain")
    new = (
        F.when(F.col("seen").isNull(), status).when((status == "proved") & F.col("invalid"), "conjectured").when((status == "proved") & (~here | bad), F.when(here, "stated").otherwise("conjectured"))
        .when(~here & F.col("generated_by").isin(*generators) & status.isin("stated", "audited", "proving", "blocked"), "conjectured").when((status == "conjectured") & here & ~uncertain, "stated").otherwise(status)
    )
    return rows.select(*nodes.columns, new.alias("new_status"))


def lost_work(before: DataFrame, after: DataFrame, truth: DataFrame) -> DataFrame:
    """id of the nodes that were proved, are there and clean, and are not proved afterwards."""
    clean = before.where("status = 'proved'").join(truth.where("present and not dirty").select("file", "name"), ["file", "name"], "left_semi")
    return clean.join(after.where("status = 'proved'").select("id"), "id", "left_anti").select("id")


def late_dependencies(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """target, id: proved nodes of a target's family in its file that stand on a later line. nodes: id, status, file, line."""
    at = nodes.select("id", "file", "line")
    mine = at.join(targets.select("id").distinct(), "id", "left_semi")
    # Only proved nodes on a line after the first target of their file can be late.
    first = mine.groupBy("file").agg(F.min("line").alias("first"))
    late = nodes.where("status = 'proved'").select("id", "file", "line").join(first, "file").where("line > first").select("id", "file", "line")
    asked = mine.select(F.col("id").alias("target"), "file", "line")
    return _families_with(edges, asked, late, "file", later="line").where("id <> target")


def recovery_candidates(nodes: DataFrame, edges: DataFrame, truth: DataFrame, targets: DataFrame) -> DataFrame:
    """target, id: nodes of a target's family that are there and clean, are not proved, and whose dependencies all are."""
    deps = edges.where("kind = 'depends_on'").select("src", "dst")
    clean = nodes.where("status not in ('proved', 'false', 'parked')").join(truth.where("present and not dirty").select("file", "name"), ["file", "name"], "left_semi")
    ready = frontier(clean.select("id", "status").withColumn("status", F.lit("stated")).unionByName(nodes.where("status = 'proved'").select("id", "status")), deps)
    return _families_with(edges, targets.select(F.col("id").alias("target")).distinct(), ready.select("id").distinct())


def relevant_findings(findings: DataFrame, ancestors: DataFrame, k: int = 3) -> DataFrame:
    """target, finding, rank: the newest k findings (finding, target, at) of each target, then those of its split ancestors.

    ancestors: id, ancestor. Targets without findings of their own take all k from their ancestors. No more than the
    newest k of a target can be among those of another one, so only these are joined to its descendants.
    """
    newest = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("at"), F.desc("finding")))
    findings = findings.withColumn("_newest", newest).where(F.col("_newest") <= k).drop("_newest")
    other = findings.select("finding", F.col("target").alias("ancestor"), "at").join(ancestors, "ancestor").select("finding", F.col("id").alias("target"), "at", F.lit(1).alias("tier"))
    every = findings.select("finding", "target", "at", F.lit(0).alias("tier")).unionByName(other)
    rank = F.row_number().over(Window.partitionBy("target").orderBy("tier", F.desc("at"), F.desc("finding")))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("target", "finding", "rank")


def declared_edges(items: DataFrame) -> DataFrame:
    """src, dst, target_known: what items (label, uses array) say that they use, each once."""
    each = items.select(F.col("label").alias("src"), F.explode("uses").alias("dst")).distinct()
    known = items.select(F.col("label").alias("dst"), F.lit(True).alias("known"))
    return each.join(known, "dst", "left").select("src", "dst", F.coalesce("known", F.lit(False)).alias("target_known"))


def candidate_edges(item_concepts: DataFrame, k: int = 3) -> DataFrame:
    """src, dst, shared: for each item the k earlier ones of its chapter with most concepts in common, the latest first.

    item_concepts: label, ordinal, chapter, concept. Concepts of more than max(8, items / 10) items say nothing.
    """
    rows = item_concepts.select("label", "ordinal", "chapter", "concept").distinct()
    most = rows.agg(F.greatest(F.lit(8), F.floor(F.count_distinct("label") / 10)).alias("most"))
    selective = rows.groupBy("concept").agg(F.count("*").alias("n")).join(F.broadcast(most)).where("n <= most").select("concept")
    chosen = rows.join(selective, "concept", "left_semi")
    pairs = _candidates(chosen, k)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("shared"), F.desc("before")))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("src", "dst", "shared")


def _candidates(rows: DataFrame, k: int) -> DataFrame:
    """src, dst, before, shared: of each kind of items (those of one chapter with the same concepts) the k latest before src.

    Kinds are compared instead of items; then only places within them are looked up, so copies do not meet as pairs.
    """
    items = rows.where("chapter is not null").groupBy("label", "ordinal", "chapter").agg(F.array_sort(F.collect_set("concept")).alias("concepts"))
    items = cut(items.withColumn("kind", F.md5(F.to_json(F.struct("chapter", "concepts")))))
    each = items.select("kind", "chapter", "concepts").distinct().select("kind", "chapter", F.explode("concepts").alias("concept"))
    alike = cut(each.join(each.withColumnRenamed("kind", "of"), ["chapter", "concept"]).groupBy("kind", "of").agg(F.count("*").alias("shared")))
    asked = alike.join(items, "kind").select("kind", "of", "shared", "label", "ordinal", F.lit(0).alias("held"))
    held = alike.join(items.withColumnRenamed("kind", "of").drop("label"), "of").select("kind", "of", "shared", F.lit(None).cast(items.schema["label"].dataType).alias("label"), "ordinal", F.lit(1).alias("held"))
    before = F.sum("held").over(Window.partitionBy("kind", "of").orderBy("ordinal", "held").rowsBetween(Window.unboundedPreceding, 0))
    seen = asked.unionByName(held).withColumn("n", before).where("held = 0 and n > 0")
    wanted = seen.select(F.col("label").alias("src"), "of", "shared", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - (k - 1)), F.col("n"))).alias("nth"))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("ordinal", "label")).cast("long")
    places = items.select(F.col("kind").alias("of"), nth.alias("nth"), F.col("label").alias("dst"), F.col("ordinal").alias("before"))
    return wanted.join(places, ["of", "nth"]).select("src", "dst", "before", "shared")


def library_modules(item_concepts: DataFrame, domains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(domain, concepts, consumers) and (concept) of no domain: concepts of two items or more, domains of two items or more.

    domains: domain, concept.
    """
    rows = item_concepts.select("label", "concept").distinct()
    active = rows.groupBy("concept").agg(F.count("*").alias("n")).where("n >= 2").select("concept")
    found = rows.join(active, "concept", "left_semi").join(domains, "concept")
    kept = found.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set("concept")), ",").alias("concepts"), F.count_distinct("label").alias("consumers")).where("consumers >= 2")
    assigned = found.join(kept.select("domain"), "domain", "left_semi").select("concept").distinct()
    return kept, active.join(assigned, "concept", "left_anti")


def select_scope(items: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """label, position, role of the selected labels and of what they use directly. items: label, position."""
    chosen = labels.select("label").distinct()
    beside = edges.join(chosen.select(F.col("label").alias("src")), "src", "left_semi").select(F.col("dst").alias("label")).distinct().join(chosen, "label", "left_anti")
    roles = chosen.withColumn("role", F.lit("selected")).unionByName(beside.withColumn("role", F.lit("dependency")))
    return items.join(roles, "label").select("label", "position", "role")


def coverage(witnesses: DataFrame, classes: DataFrame, moduli: tuple[int, ...]) -> DataFrame:
    """witness rows (scope, at, witness) with covered: an earlier class (scope, at, modulus, residue) of the scope holds it.

    Each witness is looked up by its residue for each modulus, so the join is on equal keys.
    """
    first = classes.groupBy("scope", "modulus", "residue").agg(F.min("at").alias("since"))
    each = witnesses.withColumn("modulus", F.explode(F.array(*map(F.lit, moduli)))).withColumn("residue", F.pmod("witness", "modulus"))
    hit = each.join(first, ["scope", "modulus", "residue"], "left").withColumn("hit", F.coalesce(F.col("since") < F.col("at"), F.lit(False)))
    return hit.groupBy("scope", "at", "witness").agg(F.bool_or("hit").alias("covered"))


def contained_classes(classes: DataFrame, moduli: tuple[int, ...]) -> DataFrame:
    """at, by: classes (scope, at, modulus, residue) that an earlier class of their scope contains, and the first such.

    A class lies in another if the other's modulus divides its own and the residues agree; each is looked up by its
    residue for each modulus that divides its own.
    """
    first = classes.groupBy("scope", F.col("modulus").alias("m"), F.col("residue").alias("r")).agg(F.min("at").alias("by"))
    each = classes.select("scope", "at", "modulus", "residue", F.explode(F.array(*map(F.lit, moduli))).alias("m")).where("modulus % m = 0").withColumn("r", F.pmod("residue", "m"))
    return each.join(first, ["scope", "m", "r"]).where(F.col("by") < F.col("at")).groupBy("at").agg(F.min("by").alias("by"))
