"""Closures of graphs with cycles, against brute force, and what they write and broadcast on the way."""

import random

import pytest
from pyspark.sql import functions as F

from runweave.operators import graph


def _closure(pairs, starts=None):
    next_ = {}
    for a, b in pairs:
        next_.setdefault(a, set()).add(b)
    out = {}
    for start in starts if starts is not None else {x for p in pairs for x in p}:
        seen, todo = set(), [start]
        while todo:
            for b in next_.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[start] = seen
    return out


@pytest.fixture
def written(monkeypatch):
    """Rows and plans of all that is written."""
    out, cut = [], graph.cut

    def count(df):
        done = cut(df)
        out.append((done.count(), df._jdf.queryExecution().toString()))
        return done

    monkeypatch.setattr(graph, "cut", count)
    return out


def test_reach_with_cycles(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(14), rng.randrange(14)) for _ in range(17)] + [(20, 21), (21, 22), (22, 20), (22, 23), (20, 20)]
    got = [tuple(r) for r in graph.reach(spark.createDataFrame(pairs, "src long, dst long")).select("src", "dst").collect()]
    want = {(a, b) for a, bs in _closure(pairs).items() for b in bs if a != b}
    assert len(got) == len(set(got))
    assert set(got) == want
    nodes = spark.createDataFrame([(x,) for x in {x for p in pairs for x in p}], "id long")
    reached = _closure(pairs)
    whole = {x: min({x} | {y for y in reached[x] if x in reached[y]}) for x in reached if any(x in reached[y] and y in reached[x] for y in reached if y != x)}
    assert dict(map(tuple, graph.components(nodes, spark.createDataFrame(pairs, "src long, dst long")).collect())) == whole


def test_family_on_cycles(spark, written, monkeypatch):
    """The family of each node of a ring is the ring, of which less is written than the pairs."""
    monkeypatch.setattr(graph, "BLOCK", 7)
    ring = [(i, (i + 1) % 12 if i < 12 else i + 1) for i in range(12)] + [(30, 0), (5, 40), (50, 51)]
    edges = [(b, a, "split_of") if a % 2 else (a, b, "depends_on") for a, b in ring]
    targets = [*range(12), 30, 40, 50, 60]
    got = [tuple(r) for r in graph.family(spark.createDataFrame(edges, "src long, dst long, kind string"), spark.createDataFrame([(t,) for t in targets], "id long")).select("target", "id").collect()]
    assert sorted(got) == sorted((t, i) for t, ids in _closure(ring, targets).items() for i in ids | {t})
    assert max(n for n, _ in written) < 60 < len(got)


def test_families_are_written_small(spark, tmp_path):
    """A family is as many rows as it is, but what is written of them, and shuffled for them, is a part of a byte a row."""
    n = 1501
    targets = spark.range(n)
    ends = targets.where("id > 0").select(F.explode(F.array(F.struct(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst")), F.struct(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")))).alias("e"))
    wheel = ends.select("e.src", "e.dst", F.lit("depends_on").alias("kind"))
    graph.family(wheel, targets).write.parquet(f"{tmp_path}/family")
    assert spark.read.parquet(f"{tmp_path}/family").count() == n * n
    assert sum(p.stat().st_size for p in (tmp_path / "family").glob("*.parquet")) < 0.4 * n * n
    nodes = targets.select("id", F.lit("proved").alias("status"), F.lit("f").alias("file"), (F.col("id") * 37 % 101).alias("line"))
    graph.late_dependencies(nodes, wheel, targets).write.parquet(f"{tmp_path}/late")
    late = spark.read.parquet(f"{tmp_path}/late").count()
    lines = [i * 37 % 101 for i in range(n)]
    assert late == sum(a < b for a in lines for b in lines)
    assert sum(p.stat().st_size for p in (tmp_path / "late").glob("*.parquet")) < 0.4 * late


def test_late_dependencies_in_blocks(spark, monkeypatch):
    """Blocks and lists of all lengths give each pair once, whatever the lines and files."""
    for name, n in (("BLOCK", 7), ("TARGETS", 9), ("LISTED", 4), ("SHORT", 3)):
        monkeypatch.setattr(graph, name, n)
    rng = random.Random(5)
    pairs = [e for i in range(1, 40) for e in ((0, i), (i, 0))] + [(50, 0), (3, 51), (60, 61)]
    nodes = {i: (rng.choice(["proved", "proved", "stated"]), rng.choice("fg"), rng.randrange(12)) for i in [*range(40), 50, 51, 60, 61]}
    targets = [i for i in nodes if i % 3]
    edges = spark.createDataFrame([(a, b, "depends_on") for a, b in pairs], "src long, dst long, kind string")
    got = [tuple(r) for r in graph.late_dependencies(spark.createDataFrame([(i, *v) for i, v in nodes.items()], "id long, status string, file string, line int"), edges, spark.createDataFrame([(t,) for t in targets], "id long")).collect()]
    want = [(t, i) for t, ids in _closure(pairs, targets).items() for i in ids - {t} if nodes[i][0] == "proved" and nodes[i][1] == nodes[t][1] and nodes[i][2] > nodes[t][2]]
    assert sorted(got) == sorted(want)


def test_loops_do_not_broadcast(spark, written):
    """What a loop joins in each round is shuffled, so that nothing of it passes through the driver."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    got = graph.dependents(edges, spark.createDataFrame([(4,)], "id long"))
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3]
    assert not [plan for _, plan in written if "BroadcastExchange" in plan]


def test_candidate_edges_of_copies(spark):
    """Items with the same concepts meet the latest three before them only, not each other as pairs."""
    rng = random.Random(3)
    items = [(i, i * 2 if i % 5 else i * 2 + 2, f"c{i % 2}", rng.choice([("a",), ("a", "b"), ("b", "c"), ("d",)])) for i in range(60)]
    rows = spark.createDataFrame([(i, at, c, x) for i, at, c, xs in items for x in xs], "label long, ordinal long, chapter string, concept string")
    made = graph._candidates(rows, 3).collect()
    assert len(made) <= 60 * 3 * 3
    want = {}
    for i, at, c, xs in items:
        found = [(len(set(xs) & set(ys)), before, j) for j, before, d, ys in items if d == c and before < at and set(xs) & set(ys)]
        want[i] = sorted(((s, b) for s, b, _ in found), reverse=True)[:3]
    got = {i: sorted(((r["shared"], r["before"]) for r in made if r["src"] == i), reverse=True)[:3] for i in range(60)}
    assert got == want
