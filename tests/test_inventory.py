"""Issues of literal plans."""

from runweave.operators import inventory

WHOLE = """### thm:a
- Source locator: book.tex, lines 3-9
- Planned Lean declarations:
  - `A.main : P`, `A.aux`
- Formal statement review: done by two
- Source qualifiers: n > 0
- Lean coverage: all of them
- Scope changes: none
- Statement verification status: Approved
- Prover notes: by induction
"""


def test_planned_names(spark):
    values = ["`a.b : T`, `c d` and ``x``", "theorem foo : P\n```lean\ndef bar := 1\n```", "one, two; three and four", "TBD?", "`1x`"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(inventory.planned_names(inventory.F.col("v")).alias("n")).collect()
    assert [r["n"] for r in rows] == [["a.b", "c"], ["foo", "bar"], ["one", "two", "three", "four"], [], []]


def test_issues(spark):
    entries = [
        ("thm:a", WHOLE), ("thm:b", WHOLE.replace("book.tex", "other.tex").replace("by induction", "n/a").replace("Approved", "open").replace("all of them", "partly, two omitted")),
        ("def:c", "- Source locator: pending\n- Formal name: x y, z\n- Formal statement review:\n  - state: TODO\n- Scope change: none\n- Proof strategy: none"), ("def:d", "  \n"), ("def:e", WHOLE.replace("`A.main : P`, `A.aux`", "1, 2")),
    ]
    items = spark.createDataFrame([("thm:a", "Theorem", True), ("thm:b", "lemma", None), ("def:c", "definition", False), ("def:d", "definition", False), ("def:e", "remark", False), ("def:f", None, None)], "label string, kind string, has_proof boolean")
    made = spark.createDataFrame([("A.main", "theorem", "/-- Proof sketch: x -/"), ("A.aux", "lemma", None), ("x", "def", "")], "name string, kind string, comment string")
    got = {}
    for r in inventory.inventory_issues(items, spark.createDataFrame(entries, "label string, text string"), made, "book.tex").collect():
        got.setdefault(r["label"], set()).add(r["issue"] + (f" {r['name']}" if r["name"] else ""))
    assert got == {
        "thm:a": {"comment_notes A.aux"}, "thm:b": {"comment_notes A.aux", "locator_source", "notes_needed", "not_approved", "coverage"},
        "def:c": {"locator", "missing_declaration z", "review", "qualifiers", "coverage", "verification"}, "def:d": {"missing_entry"}, "def:e": {"planned_names"}, "def:f": {"missing_entry"},
    }
