"""How work is dealt out: over a fixed number of tasks, and not by keys that are null or the same."""

from runweave.operators import blocks, ledger, source, statements
from runweave.sources import tables


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_declarations_are_dealt_by_file(spark):
    files = spark.createDataFrame([("a.lean", "theorem a : P\ntheorem b : P")], "path string, text string")
    found = source.declarations(files)
    assert "RepartitionByExpression [file#" in _plan(found) and found.count() == 2


def test_payloads_without_digest_are_not_joined(spark):
    hot = spark.createDataFrame([(1, "x", None), (2, "y", None), (3, None, "d")], "job_id long, payload string, digest string")
    out = ledger.hydrate_ledger(hot, spark.createDataFrame([("d", "z")], "digest string, payload string"))
    assert "isnotnull(digest" in _plan(out) and "Union" in _plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, "x", True), (2, "y", True), (3, "z", False)]


def test_earlier_pairs_in_blocks(spark):
    """All pairs of a group are there, once, whatever the size of a block."""
    asked = spark.createDataFrame([(i, "F", i, "k") for i in range(30)], "id long, file string, at long, key string")
    held = asked.selectExpr("id as name", "file", "at as line", "key")
    got = statements.earlier_pairs(asked, held, "key", 4).collect()
    assert sorted((r["id"], r["name"]) for r in got) == [(a, b) for a in range(30) for b in range(a)]


def test_blank_by_runs():
    assert blocks.blank("ab -- x\n/- y\n-/ c - / d") == "ab     \n    \n   c - / d"


def test_spread_keeps_its_tasks(spark):
    assert tables.spread(spark.range(3), "id").rdd.getNumPartitions() == tables.tasks(spark)
