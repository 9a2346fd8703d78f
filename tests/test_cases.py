"""Finite cases of literal declarations, and their counts against brute force."""

import random

from runweave.operators import cases


def test_branches(spark):
    want = {
        "theorem a (t : Nat) (h : t % 5 = 3) : P t": "t%5=3", "theorem a (h : t % 5 = 7) : P t": None, "theorem a (h : t = 4) : P": "t=4", "theorem a : t = 4 * k": None, "theorem a (h : t = 4 ∨ t = 5) : P": None, "theorem a (h : t % 5 = 3) : t % 5 = 3": "t%5=3",
        "theorem a (h : t % 5 = 3) : t = 8": None, "theorem goal_case_k_eq_7 : ∃ n : ℕ, n > (7 : ℕ) := by simp": "case:goal:k=7", "theorem goal_case_k_eq_7 : ∃ n : ℕ, n > (8 : ℕ) := by simp": None, "theorem goal_case_k_eq_7 : ∃ n : ℕ, n > (7 : ℕ) := by sorry": None,
        "theorem goal_case_k_eq_7 (t : Nat) (h : t = 4) : ∃ n : ℕ, n > (7 : ℕ) := x": None, "theorem other_case_k_eq_7 : ∃ n : ℕ, n > (7 : ℕ) := x": None, "lemma goal_audit_k3 : ∃ (n : Nat), (n + 3 : Nat) = 4 := x": "audit:goal:k=3",
        "theorem goal_at_two (n : Nat) : n = 2": None, "theorem goal_at_two : f = g": None, "def x := 1": None, None: None,
    }
    rows = cases.finite_branches(spark.createDataFrame([("", "N.goal", t) for t in want], "name string, target string, text string")).collect()
    assert {r["text"]: r["branch"] for r in rows} == want
    closed = cases.finite_branches(spark.createDataFrame([("", "goal", "theorem goal_at_two : f 2 = g -- x"), ("", "goal", "theorem goal_at_two :  f 2 = g")], "name string, target string, text string")).collect()
    assert closed[0]["branch"] == closed[1]["branch"] and closed[0]["branch"].startswith("closed:")


def test_finite_cases(spark):
    rng = random.Random(2)
    nodes, edges, found, facts = [(0, "f", "goal", "stated", None), (1, "f", "other", "split", None), (2, "f", "shut", "proved", None)], [], [], {}
    for i in range(3, 90):
        m = rng.choice([2, 3, 4, 6, 12])
        kind = rng.choice(["class", "class", "value", "none", "case"])
        fact = {"class": ("class", m, rng.randrange(m)), "value": ("value", rng.randrange(6), 0), "none": None, "case": ("case", 3, 0)}[kind]
        name = f"goal_case_k_eq_3_{i}" if kind == "none" else f"d{i}"
        text = {"class": lambda f: f"theorem d{i} (h : t % {f[1]} = {f[2]}) : P", "value": lambda f: f"theorem d{i} (h : t = {f[1]}) : P", "none": lambda f: f"theorem {name} : P", "case": lambda f: "theorem goal_case_k_eq_3 : ∃ n : ℕ, n = (3 : ℕ) := x"}[kind](fact)
        file = rng.choice("fg")
        parents = rng.sample([0, 1, 2], rng.randrange(1, 3))
        nodes.append((i, file, name, "proved", (i * 37) % 101))
        found.append((file, name, text))
        edges += [(i, p, "split_of") if rng.random() < 0.5 else (p, i, "depends_on") for p in parents]
        if fact and (kind != "case" or 0 in parents):
            facts[i] = (fact, file, (i * 37) % 101, {p for p in parents if p < 2})
    facts = {i: f for i, f in facts.items() if f[3]}
    want = {}
    for i, (fact, file, seq, parents) in facts.items():
        before = [f for f, g, s, q in facts.values() if g == file and s < seq and q & parents]
        prior = min(4, len(set(before)))
        broader = fact[0] == "class" and any(f[0] == "class" and f != fact and f[1] % fact[1] == 0 and f[2] % fact[1] == fact[2] for f in before)
        want[i] = (prior, prior >= 4, fact[0] == "case" or prior >= 4 and not broader)
    frames = (spark.createDataFrame(nodes, "id int, file string, name string, status string, seq int"), spark.createDataFrame(edges, "src int, dst int, kind string"), spark.createDataFrame(found, "file string, name string, text string"))
    got = {r["id"]: (r["prior"], r["saturated"], r["evidence_only"]) for r in cases.finite_cases(*frames).collect()}
    assert got == want and len({v for v in want.values()}) > 4
