"""Choices one after another, and streams over several files with a restart, against brute force and batch forms."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from runweave.operators import graph, search
from runweave.plans import search as plan
from runweave.plans import streams
from runweave.sources import tables
from runweave.streaming import live

SF = "/root/testdata/sf0.001"


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_diversify(spark):
    ranked = search.merge_results(plan.results(spark, SF), plan._requests(plan.results(spark, SF))).cache()
    by = defaultdict(list)
    for r in ranked.collect():
        by[r["request_id"]].append(r)
    want = []
    for request, left in by.items():
        left.sort(key=lambda r: r["rank"])
        chosen = []
        domain = lambda r: r["url"].split("/")[2].lower() if "//" in r["url"] else ""
        while left and len(chosen) < 8:
            score = lambda r: r["score"] - 1.25 * sum(c["provider"] == r["provider"] for c in chosen) - 0.75 * sum(domain(c) == domain(r) != "" for c in chosen)  # noqa: E731, B023
            best = max(left, key=lambda r: (score(r), -r["provider_index"], -r["result_index"], -r["rank"]))
            left.remove(best)
            chosen.append(best)
        want += [(request, i + 1, r["key"]) for i, r in enumerate(chosen)]
    assert rows(search.diversify(ranked, 8), "request_id", "position", "key") == sorted(want, key=repr)


def brute_circuit(calls):
    state, out = {}, []
    for r in sorted(calls, key=lambda r: (r["ts"], r["event_id"])):
        s = state.setdefault(r["run_id"], {"p": None, "f": 0, "t": 0, "o": 0, "u": None})
        at = int(r["ts"].timestamp())
        allowed = s["u"] is None or at >= s["u"]
        if r["outcome"] == "ok":
            state[r["run_id"]] = s = {"p": None, "f": 0, "t": 0, "o": 0, "u": None}
        else:
            if s["p"] != r["fingerprint"]:
                s.update(p=r["fingerprint"], f=0, t=0, o=0, u=None)
            s["f"] += 1
            s["t"] = s["t"] + 1 if r["outcome"] == "timeout" else 0
            if (s["t"] >= 1 or s["f"] >= 2) and (s["u"] is None or at >= s["u"]):
                s["o"] += 1
                s["u"] = at + min(1800, 300 * 2 ** (s["o"] - 1))
        out.append((r["run_id"], r["event_id"], allowed, s["o"], s["u"]))
    return sorted(out, key=repr)


def test_circuit(spark):
    calls = streams.calls(tables.activity(spark, SF)).collect()
    got = streams.x4_circuit_stream(spark, SF)
    assert rows(got, "run_id", "event_id", "allowed", "open_count", "open_until") == brute_circuit(calls)
    assert len({r[3] for r in brute_circuit(calls)}) > 1


def test_circuit_doubles_its_cooldown(spark):
    times = [0, 1, 299, 301, 500, 1000, 2500, 9000, 20000, 40000, 40001]
    events = [(1, f"1970-01-02 {t // 3600 % 24:02d}:{t // 60 % 60:02d}:{t % 60:02d}", i, "ok" if i == 9 else "error", "x") for i, t in enumerate(times)]
    df = spark.createDataFrame(events, "run_id long, ts string, event_id long, outcome string, fingerprint string").withColumn("ts", F.col("ts").cast("timestamp"))
    want = [r[3] for r in sorted(brute_circuit(df.collect()), key=lambda r: r[1])]
    assert max(want) >= 4 and want[-2:] == [0, 0]


@pytest.mark.parametrize("name", ["x1_agent_status_stream", "x2_publish_once_stream", "x3_loop_guard_stream", "x4_circuit_stream", "x5_backoff_stream", "x6_failure_budget_stream", "x9_route_epochs_stream", "x12_consume_once_stream"])
def test_streams_of_several_files_with_a_restart(spark, name, tmp_path, monkeypatch):
    """Four files, one a micro-batch, with a stop after three of them, give what one file gives."""
    want = streams.QUERIES[name](spark, SF)
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").toPandas()
    folder, at = tmp_path / "events.parquet", tables.scratch(spark)
    folder.mkdir()
    edges = [0, 200, 201, 700, len(events)]
    schema = spark.read.parquet(f"{SF}/events.parquet").schema

    def add(i):
        import pyarrow as pa
        import pyarrow.parquet as pq

        table = pq.read_table(f"{SF}/events.parquet")
        pq.write_table(pa.Table.from_pandas(events.iloc[edges[i] : edges[i + 1]], schema=table.schema, preserve_index=False), folder / f"{i}.parquet")

    def read(session, sf_dir, table, files_at_once=1):
        return session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    drained = live.drained
    monkeypatch.setattr(live, "read", read)
    monkeypatch.setattr(live, "drained", lambda stream, mode="append", partition_by=(): drained(stream, mode, partition_by, path=at))
    for i in range(3):
        add(i)
    streams.QUERIES[name](spark, SF).count()
    add(3)
    got = streams.QUERIES[name](spark, SF)
    columns = sorted(want.columns)
    assert rows(got, *columns) == rows(want, *columns)


def test_consume_once_with_bounded_receipts(spark):
    stream = tables.activity_of(live.read(spark, SF, "events"))
    assert live.drained(live.consume_once(stream.where("type = 'tool-result'"), "run_id", "k", within="3650 days")).count() == streams.x12_consume_once_stream(spark, SF).count()


def test_roots_of_cycles(spark):
    rnd = random.Random(3)
    parents = [(1, 2), (2, 1), (3, 4), (4, 5), (5, 3), (6, 5), (7, 7), (8, None), (9, 8), (10, 99), (11, 6), (12, 11)] + [(i, i - 1) for i in range(101, 160)] + [(100, None)]
    rnd.shuffle(parents)
    got = {r["id"]: r["root"] for r in graph.roots(spark.createDataFrame(parents, "id long, parent long")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 3, 7: 7, 8: 8, 9: 8, 10: 99, 11: 3, 12: 3, 100: 100, **{i: 100 for i in range(101, 160)}}


def test_schedule_of_the_smallest_cases(spark):
    items = spark.createDataFrame([("1.1", 1), ("1.2", 2), ("1.3", 3)], "label string, ordinal int")
    uses = lambda *pairs: spark.createDataFrame(list(pairs), "src string, dst string")
    got = rows(graph.schedule(items, uses(("1.1", "1.2"), ("1.2", "1.1"), ("1.3", "missing"))), "position", "label", "in_cycle", "unresolved")
    assert got == [(1, "1.3", False, 1), (2, "1.1", True, 0), (3, "1.2", True, 0)]
    assert [r[1] for r in rows(graph.schedule(items, uses(("1.2", "1.1"))), "position", "label")] == ["1.1", "1.3", "1.2"]




def test_locate(spark):
    """Places of snippets by the first form that finds them, against a loop over the lines."""
    import re

    from runweave.operators import evidence
    from runweave.plans import evidence as found

    strip = lambda c: re.sub(r"^\s+|\s+$", "", c, flags=re.A)
    collapse = lambda c: strip(re.sub(r"\s+", " ", c, flags=re.A))
    escape = lambda c: collapse(re.sub(r"""\\(["'])""", r"\1", c.replace("\\t", " ")))
    text = 'def f():\n    say("a  b")\n\n    return 1\ndef f():\n  say("a b")\n'
    docs = [(1, text), (2, "x\ny\nx\ny"), (3, "")]
    asked = [(1, 1, 'def f():\n    say("a  b")'), (2, 1, "  def f():  \n say(\"a  b\")"), (3, 1, 'say("a b")'), (4, 1, 'say(\\"a b\\")\n\nreturn 1'), (5, 2, "x\ny"), (6, 2, "\ny"), (7, 2, "z"), (8, 3, "x"), (9, 2, " "), (10, 1, "\n    return 1")]
    table = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    docs += [(r["doc_id"] + 100, r["text"]) for r in table.collect()]
    asked += [(r["id"] + 100, r["doc_id"] + 100, r["snippet"]) for r in tables.derived(spark, SF, found.SNIPPETS).collect()]
    texts, want = dict(docs), set()
    for number, doc, snippet in asked:
        for name, form in (("exact", str), ("trimmed", strip), ("collapsed", collapse), ("unescaped", escape)):
            have, lines = [form(x) for x in texts[doc].split("\n")], [form(x) for x in snippet.split("\n")]
            at = [i + 1 for i in range(len(have)) if have[i : i + len(lines)] == lines]
            if at and snippet.strip(" "):
                want.add((number, doc, at[0], name, len(at)))
                break
    got = evidence.locate(spark.createDataFrame(asked, "id long, doc_id long, snippet string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == want
    assert {w[3] for w in want} == {"exact", "trimmed", "collapsed", "unescaped"}


def test_closest_regions(spark):
    from difflib import SequenceMatcher

    from runweave.operators import evidence

    text = "alpha beta\n  gamma delta\nepsilon\n\nalpha bet"
    asked = [(1, 1, "gama delta"), (2, 1, "alpha beta\ngamma delta"), (3, 1, "zzz"), (4, 2, "x"), (5, 1, "a\nb\nc\nd\ne\nf\ng")]
    want = []
    for number, doc, snippet in asked:
        if doc == 1:
            lines, size = text.split("\n"), snippet.count("\n") + 1
            scores = [SequenceMatcher(None, snippet.strip(), "\n".join(lines[i : i + size]).strip()).ratio() for i in range(max(0, len(lines) - size) + 1)]
            want.append((number, doc, scores.index(max(scores)) + 1, round(max(scores), 3)))
    got = evidence.closest_regions(spark.createDataFrame(asked, "id long, doc_id long, snippet string"), spark.createDataFrame([(1, text), (2, " ")], "doc_id long, text string"))
    assert rows(got, "id", "doc_id", "line", "similarity") == sorted(want)
