"""Full-text search of messages: queries as texts, and results against brute force."""

import math
import random
import re

import pytest

from runweave.operators import messages as m


@pytest.mark.parametrize(
    ("text", "query"),
    [
        ("docker", (("docker",), False)), ("Docker deploy*", ("AND", (("docker",), False), (("deploy",), True))), ('"exact phrase" OR x', ("OR", (("exact", "phrase"), False), (("x",), False))), ("python NOT java", ("NOT", (("python",), False), (("java",), False))),
        ("a OR b c NOT d", ("OR", (("a",), False), ("AND", (("b",), False), ("NOT", (("c",), False), (("d",), False))))), ("hello AND", (("hello",), False)), ("OR world", (("world",), False)), ("C++", (("c",), False)), ('"unterminated', (("unterminated",), False)),
        ("***", None), ("", None), ("AND NOT", None), ("foo-bar", ("AND", (("foo",), False), (("bar",), False))), ("a AND OR b", ("AND", (("a",), False), (("b",), False))),
    ],
)
def test_queries(text, query):
    assert m.query_of(text) == query


def brute(rows, text, roles, sources, source_of):
    query = m.query_of(text)
    words = {i: re.findall(r"[^\W_]+", (c or "").lower()) for i, _, _, c in rows}
    words = {i: w for i, w in words.items() if w}
    average = sum(map(len, words.values())) / len(words)

    def starts(own, leaf):
        fits = lambda k, w: w.startswith(leaf[0][k]) if leaf[1] and k == len(leaf[0]) - 1 else w == leaf[0][k]
        return [s for s in range(len(own) - len(leaf[0]) + 1) if all(fits(k, own[s + k]) for k in range(len(leaf[0])))]

    def holds(q, own):
        if not isinstance(q[0], str):
            return bool(starts(own, q))
        a, b = holds(q[1], own), holds(q[2], own)
        return a and b if q[0] == "AND" else a or b if q[0] == "OR" else a and not b

    leaves, counts = m._leaves(query), m._counts(query)
    out = []
    for i, session, role, _ in rows:
        if i in words and holds(query, words[i]) and (not roles or role in roles) and (not sources or source_of[session] in sources):
            score = 0.0
            for leaf, c in zip(leaves, counts, strict=True):
                df, tf = sum(bool(starts(w, leaf)) for w in words.values()), len(starts(words[i], leaf))
                if c and tf:
                    idf = math.log((len(words) - df + 0.5) / (df + 0.5))
                    score += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[i]) / average))
            out.append((-round(score, 6), i))
    return [(i, -s) for s, i in sorted(out)]


def test_search(spark):
    rng = random.Random(8)
    vocabulary = ["deploy", "deployed", "docker", "python", "java", "straße", "x1", "the", "of"]
    rows = [(i, i // 10, rng.choice(["user", "assistant"]), " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 30)))) for i in range(120)] + [(500, 3, "user", None), (501, 3, "user", "?!")]
    source_of = {s: "cli" if s % 2 else "web" for s in range(13)}
    frame = spark.createDataFrame(rows, "id long, session_id long, role string, content string").cache()
    sessions = spark.createDataFrame(list(source_of.items()), "id long, source string")
    terms = m.index(frame).cache()
    sizes = m.corpus_size(terms)
    cases = [("docker", (), ()), ("deploy* NOT java", ("user",), ()), ('"docker python" OR "the of the"', (), ("cli",)), ("STRASSE OR straße x1", (), ()), ("python NOT java NOT the OR \"of dep*\"", ("assistant",), ("web",)), ("missing", (), ()), ("the the", (), ())]
    for text, roles, sources in cases:
        want = brute(rows, text, roles, sources, source_of)
        pages = [m.search(frame, terms, m.query_of(text), sizes, sessions, sources, roles, limit=15, offset=o).collect() for o in (0, 15)]
        got = [(r["id"], r["score"]) for page in pages for r in sorted(page, key=lambda r: (-r["score"], r["id"]))]
        assert [i for i, _ in got] == [i for i, _ in want][:30], text
        assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got, want, strict=False))


def test_snippets_and_context(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(1, 1, "user", "before " * 60), (2, 1, "user", f"({long}) Hit, and: hit."), (3, 1, "user", None), (4, 2, "user", "-- the hit of it"), (5, 2, "user", "hit")]
    frame = spark.createDataFrame(rows, "id long, session_id long, role string, content string")
    terms = m.index(frame)
    got = {r["id"]: (r["snippet"], r["before"], r["after"]) for r in m.search(frame, terms, m.query_of("hit"), m.corpus_size(terms), words=5).collect()}
    assert got == {2: ("...w98 w99) >>>Hit<<<, and: >>>hit<<<", ("before " * 60)[:200], ""), 4: ("the >>>hit<<< of it", None, "hit"), 5: (">>>hit<<<", "-- the hit of it", None)}
    phrase = m.search(frame, terms, m.query_of('w3 "hit and"'), m.corpus_size(terms), words=4).collect()
    assert [r["snippet"] for r in phrase] == ["...>>>w3<<< w4 w5 w6..."]
