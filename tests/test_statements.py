"""Statements of declarations: signatures but for binders, negations, admission and conditional helpers, literally."""

import pytest

from runweave.operators import statements as s


def test_parse():
    said = s.parse("@[simp] private theorem A.b (x y : Nat) {h : x = (y : Nat)} [Inst] -- note\n (f : ∀ n, let k := 1; n = k) : x /- : -/ = y := by\n  sorry")
    assert (said["kind"], said["name"], said["result"], said["binders"]) == ("theorem", "A.b", "x = y", "(x y : Nat) {h : x = (y : Nat)} [Inst] (f : ∀ n, let k := 1; n = k)")
    assert [(g["opens"], g["names"], g["type"]) for g in said["groups"]] == [("(", ["x", "y"], "Nat"), ("{", ["h"], "x = (y : Nat)"), ("[", [], ""), ("(", ["f"], "∀ n, let k := 1; n = k")]
    assert s.parse("no declaration") is None and s.parse(None) is None and s.parse("theorem x")["result"] == ""
    assert s.compact("((a = /- no -/ b))") == "a = b" and s.compact("(a) = (b)") == "(a) = (b)"


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("theorem p (x : Nat) : x = x := rfl", "theorem q (y : Nat) : y = y := by simp", True), ("theorem p (x y : Nat) : x = y", "theorem q (y x : Nat) : y = x", True),
        ("theorem p (x y : Nat) : x = y", "theorem q (x y : Nat) : y = x", False), ("theorem p (x : Nat) : x = x", "lemma q (x : Nat) : x = x", False), ("theorem p (_ : Nat) (x : Nat) : x = x", "theorem q (_ : Nat) (z : Nat) : z = z", True),
        ("theorem p (_ : Nat) : 1 = 1", "theorem q (x : Nat) : 1 = 1", False), ("theorem p (x : Nat) : f.x x = x'", "theorem q (z : Nat) : f.z z = x'", True), ("theorem p (x : Nat) (h : x > 0) : ∃ y, y > x", "theorem q (n : Nat) (h0 : n > 0) : ∃ y, y > n", True),
        ("theorem p (x : Nat) (x : Int) : x = x", "theorem q (y : Nat) (y : Int) : y = y", True), ("theorem p (x : Nat) : x = 1", "theorem q (x : Int) : x = 1", False),
    ],
)
def test_alpha(a, b, same):
    assert (s.parse(a)["alpha"] == s.parse(b)["alpha"]) == same


def test_covered(spark):
    found = spark.createDataFrame(
        [("f", "N.one", 1, "theorem N.one (x : Nat) : x = x := rfl"), ("f", "two", 5, "theorem two (a b : Nat) : a + b = b + a := by omega"), ("f", "goal", 9, "theorem goal : True := sorry"),
         ("f", "late", 12, "theorem late (x : Nat) : x + 0 = x := rfl"), ("g", "goal", 3, "theorem goal : True"), ("g", "goal", 7, "theorem goal : True"), ("g", "one", 1, "theorem one (x : Nat) : x = x := rfl")],
        "file string, name string, line int, text string",
    )
    asked = spark.createDataFrame(
        [(1, "f", "goal", "theorem new (y : Nat) : y = y := by rfl"), (2, "f", "goal", "theorem M.two : False"), (3, "f", "goal", "theorem x (n : Nat) : n + 0 = n"), (4, "f", "N.goal", "theorem w (p q : Nat) : p + q = q + p"),
         (5, "g", "goal", "theorem new (y : Nat) : y = y"), (6, "f", "goal", "not one"), (7, "f", "goal", None), (8, "f", "goal", "theorem one (z : Nat) : z = z")],
        "id int, file string, target string, text string",
    )
    got = {r["id"]: (r["existing"], r["reason"]) for r in s.covered(asked, found).collect()}
    assert got == {1: ("N.one", "same_signature"), 2: ("two", "same_name"), 4: ("two", "same_signature"), 8: ("N.one", "same_name")}


def test_covered_without_broadcasts(spark):
    """No side of a join passes through the driver, however small Spark takes it to be."""
    found = spark.createDataFrame([("f", "one", 1, "theorem one : True")], "file string, name string, line int, text string")
    asked = spark.createDataFrame([(1, "f", "one", "theorem new : True")], "id int, file string, target string, text string")
    done = s.covered(asked, found)
    done.collect()
    assert "Broadcast" not in done._jdf.queryExecution().executedPlan().toString()


def test_dominated(spark):
    nodes = spark.createDataFrame(
        [(1, "f", "stated", "theorem t (n : Nat) (h : n > 0) : p n"), (2, "f", "proved", "theorem a (n : Nat) (h : n > 0) : ¬ (p n)"), (3, "f", "proved", "theorem b : ¬ (∀ (n : Nat) (h : n > 0), p n)"), (4, "f", "proved", "theorem c (n : Nat) : ¬ p n"),
         (5, "f", "stated", "theorem d (n : Nat) (h : n > 0) : Not (p n)"), (6, "g", "proved", "theorem e (n : Nat) (h : n > 0) : ¬ p n"), (7, "f", "stated", "theorem u : q"), (8, "f", "proved", "lemma v : Not q"), (9, "f", "proved", "theorem w : ¬ p 3")],
        "id int, file string, status string, statement string",
    )
    edges = spark.createDataFrame([(h, 1, "evidence_for") for h in (2, 3, 4, 5, 6, 9)] + [(8, 7, "evidence_for"), (2, 7, "evidence_for"), (3, 7, "other")], "src int, dst int, kind string")
    assert sorted(map(tuple, s.universal_obstructions(nodes, edges).collect())) == [(1, 2), (1, 3), (7, 8)]
    jobs = spark.createDataFrame([(1, "empirical", "small-case-invariant", "", 1), (2, "empirical", "x", "find a Witness", 1), (3, "proof", "x", "witness", 1), (4, "empirical", "x", "prove", 7), (5, "empirical", None, "small cases", 7), (6, "empirical", "x", "instances", 4)], "job_id int, archetype string, route_key string, objective string, target int")
    assert sorted(r["job_id"] for r in s.dominated_jobs(jobs, nodes, edges).collect()) == [1, 2, 5]


def test_admission(spark):
    parents = spark.createDataFrame([(1, "theorem t (n : ℕ) (h : 0 < n) : Disjoint (f n) (g n) ∧ n ≤ f n"), (2, "theorem u (n : Nat) : ∃ a b : Nat, a < b ∧ b < n"), (3, "theorem v (s : Set Nat) : Disjoint s ∧ physicalPieces s = 1"), (4, "def x := 1")], "id int, text string")
    helpers = {
        1: (1, "theorem a : Disjoint (f 7) (g 7) ∧ 7 ≤ f 7"), 2: (1, "theorem a (m : Nat) : Disjoint (f m) (g m) ∧ m ≤ f m"), 3: (1, "theorem a : Disjoint (f 7) (k 7) ∧ 7 ≤ f 7"), 4: (1, "theorem a : Disjoint (f (7)) (g 7) ∧ 7 <= f 7"),
        5: (2, "lemma b (n : Nat) : ∃ c d : Nat, c < d ∧ d < n ∧ c = c"), 6: (2, "lemma b (n : Nat) : ∃ c : Nat, c < n"), 7: (3, "theorem c (s : Set Nat) (h : A.playEnds s) : physicalPieces s = 1"), 8: (3, "theorem c (s : Set Nat) (h : A.playEnds s) (d : Disjoint s) : physicalPieces s = 1"),
        9: (4, "theorem a : x 7"), 10: (5, "theorem a : x 7"), 11: (1, None),
    }
    rows = s.admission(spark.createDataFrame([(i, p, t) for i, (p, t) in helpers.items()], "id int, parent_id int, text string"), parents).collect()
    got = {r["id"]: (r["admitted"], r["reason"], r["parameter"], r["literal"], r["reducing"]) for r in rows}
    instance = (False, "closed_instance", "n", "7", True)
    free = (True, None, None, None, True)
    assert got == {1: instance, 2: free, 3: free, 4: instance, 5: (True, None, None, None, False), 6: free, 7: (False, "dropped_disjointness", None, None, True), 8: free, 9: free, 10: free, 11: free}


def test_conditional_helpers(spark):
    found = spark.createDataFrame(
        [("f", "goal", "theorem goal (x : Nat) (h : x > 0) : P x := by\n  exact used x"), ("f", "bridge", "theorem bridge (x : Nat) (h : x > 0) (k : ∀ y, Q y) (l : P x → False) (m : R x) : P x := sorry"),
         ("f", "used", "theorem used (k : ∀ y, Q y) : P 1 := by trivial"), ("f", "fine", "theorem fine (x : Nat) (f : Nat → Nat) : R x"), ("f", "done", "theorem done (k : ∀ y, Z y) : T"), ("g", "bridge", "theorem bridge (k : ∀ y, Q y) : T"),
         ("f", "ex", "theorem ex (n : Nat) : ∃ a : Nat, a < n ∧ n < a"), ("f", "exh", "theorem exh (m : Nat) : True"), ("f", "exw", "theorem exw (n : Nat) : ∃ b : Nat, b < n ∧ n < b")],
        "file string, name string, text string",
    )
    nodes = spark.createDataFrame(
        [(1, "f", "goal", "stated", ""), (2, "f", "A.bridge", "proved", ""), (3, "f", "used", "proved", ""), (4, "f", "fine", "proved", ""), (5, "f", "done", "proved", ""), (6, "x", "y", "proved", "(∀ y, Z y)"), (7, "x", "z", "stated", "∀ y, Q y"),
         (8, "g", "bridge", "proved", ""), (9, "f", "ex", "split", ""), (10, "f", "exw", "proved", ""), (11, "x", "w", "stated", "P x → False")],
        "id int, file string, name string, status string, statement string",
    )
    edges = spark.createDataFrame([(2, 1, "split_of"), (1, 3, "depends_on"), (4, 1, "split_of"), (5, 1, "split_of"), (8, 1, "split_of"), (10, 9, "split_of"), (1, 11, "refers")], "src int, dst int, kind string")
    got = {r["id"]: (r["obligations"], r["unresolved"], r["wrapper"]) for r in s.conditional_helpers(nodes, edges, found).collect()}
    assert got == {2: (["P x → False", "∀ y, Q y"], ["∀ y, Q y"], False), 8: (["∀ y, Q y"], ["∀ y, Q y"], False), 10: ([], [], True)}


def test_mechanisms(spark):
    found = spark.createDataFrame(
        [("f", "base", 1, "theorem base : P := trivial"), ("f", "a", 3, "theorem a (x : Nat) : P := by\n  exact base x 5 -- later"), ("f", "b", 5, "theorem b (y : Nat) : Q := by simpa using base y"), ("f", "c", 7, "theorem c (n : Nat) (h : n = 3) : P := by\n  rcases h with h1\n  omega 3"),
         ("f", "d", 9, "theorem d (m : Nat) (k : m = 4) : P := by\n  rcases k with k7\n  omega 4"), ("f", "e", 11, "theorem e : P := by rcases k with later\n  omega Nat.succ"), ("f", "later", 13, "theorem later : P := trivial"), ("f", "none", 15, "theorem none : P"), ("g", "a", 3, "theorem a : P := by exact base x 5")],
        "file string, name string, line int, text string",
    )
    nodes = spark.createDataFrame([(0, "f", "goal", "stated"), (1, "f", "N.a", "proved"), (2, "f", "b", "proved"), (3, "f", "c", "proved"), (4, "f", "d", "proved"), (5, "f", "e", "stated"), (6, "f", "none", "proved"), (7, "g", "a", "proved"), (8, "f", "done", "proved")], "id int, file string, name string, status string")
    edges = spark.createDataFrame([(i, 0, "split_of") for i in (1, 2, 3, 5, 6, 7)] + [(0, 4, "depends_on"), (1, 8, "split_of")], "src int, dst int, kind string")
    got = {r["id"]: r for r in s.mechanisms(nodes, edges, found).collect()}
    assert {i: (r["parent"], r["basis"], r["dependencies"]) for i, r in got.items()} == {1: (0, "dependencies", ["base"]), 2: (0, "dependencies", ["base"]), 3: (0, "body", []), 4: (0, "body", []), 5: (0, "body", []), 7: (0, "body", [])}
    assert got[1]["signature"] == got[2]["signature"] and got[3]["signature"] == got[4]["signature"] and len({got[i]["signature"] for i in (1, 3, 5, 7)}) == 4
