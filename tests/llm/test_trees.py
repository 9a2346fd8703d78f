"""The manifest and the prefix trie against brute force, on odd rows and with small limits that make many rounds."""

import random
import re
from hashlib import sha256
from zlib import crc32

import pytest

from runweave.llm import manifest, trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, part int"
CONVS = "conv_id long, turn long, role string, text string, depth int"


def digest(text):
    return sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, i):
    steps = []
    for level in levels[:-1]:
        other = level[i ^ 1] if i ^ 1 < len(level) else ""
        steps.append((other, "") if i & 1 else ("", other))
        i //= 2
    return steps


def brute_manifest(rows):
    def leaf(row, size):
        return digest("".join(map(field, (row["doc_id"], row["source"], row["lang"], size, row["text"]))))

    parts = {}
    for row in rows:
        parts.setdefault(row["lang"], []).append((row["doc_id"], leaf(row, row["n_chars"]), row))
    order = sorted(parts, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {}
    for lang in order:
        parts[lang].sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        trees[lang] = tree([t[1] for t in parts[lang]])
    top = tree([trees[lang][-1][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for i, (id_, own, row) in enumerate(parts[lang]):
            steps = way(trees[lang], i) + way(top, k)
            now = leaf(row, row["n_chars"] + 1) if id_ is not None and row["n_chars"] is not None and crc32(str(id_).encode()) % 7 == 0 else own
            for left, right in steps:
                now = digest(left + now + right)
            root = top[-1][0]
            out.append((id_, own, trees[lang][-1][0], root, digest("".join(left + right for left, right in steps)), now, now == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("slots", [4, 1024])
def test_manifest(spark, slots):
    rows = [(i * 37 % 400, f"text {i}", ("en", "de", "é", None)[i % 9 % 4], f"s{i % 3}", i, "x", 1) for i in range(150)]
    rows += [(None, "x", None, "s", 1, None, 0)] * 3 + [(None, "y", None, None, None, None, 0), (-5, "z", "en", None, None, None, 0), (-64, "z", "", None, 3, None, 0)]
    rows += [(63, "a", "é", "", 3, None, 0), (64, "b", "é", None, 3, None, 0), (127, None, "zz", None, 3, None, 0), (2**63 - 1, None, "zz", None, 7, None, 0), (-(2**63), "", "zz", None, 0, None, 0)]
    rows += [(77, f"other {i}", "en", "s", i, None, 0) for i in range(40)] + rows[:20]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert sorted((tuple(r) for r in manifest.dataset_manifest(docs, slots=slots).collect()), key=repr) == brute_manifest(docs.collect())
    one = spark.createDataFrame(rows[:1], DOCS)
    assert [tuple(r) for r in manifest.dataset_manifest(one).collect()] == brute_manifest(one.collect())


def test_manifest_of_nothing(spark):
    assert manifest.dataset_manifest(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        manifest.dataset_manifest(spark.createDataFrame([], DOCS), id_col="root")


def brute_trie(rows):
    given = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            given.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {conv: [t[2:] for t in sorted(own)] for conv, own in given.items()}
    built = {}
    for conv, own in turns.items():
        h = crc32(str(conv).encode()) % 4
        built[conv] = tuple(turns.get(conv - conv % 20, [])[:h] + own[h:])
    members = {}
    for conv, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(conv)
    children = {seq: [s for s in members if len(s) == len(seq) + 1 and s[:-1] == seq] for seq in members}

    def below(seq):
        return [s for s in members if s[: len(seq)] == seq]

    def saved(seq):
        return (len(members[seq]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0

    out = []
    for seq, in_ in members.items():
        stops = sorted(c for c in in_ if len(built[c]) == len(seq))
        out.append((min(in_), len(seq), min(members[seq[:-1]]) if seq else None, len(in_), len(children[seq]), sum(not children[s] for s in below(seq)), sum(map(saved, below(seq))), digest(",".join(map(str, stops)))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("largest", [1, 5, 4096])
def test_trie(spark, largest):
    rng = random.Random(largest)
    rows = []
    for conv in [*range(0, 130), 5000, 9000]:
        n = 60 if conv == 60 else rng.randrange(1, 7)
        rows += [(conv, t * 300 if conv % 2 else t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "a  b c"]), 1) for t in range(n)]
    rows += [(7, None, "user", "a b", 1), (None, 1, "user", "lost", 1)] + [(9, 2, "user", "same", 1)] * 5
    # Conversation 20 repeats as 21 to 39, with turns of its own after them.
    rows += [(1000 + c, t, "user", f"chain {t}", 1) for c in range(20) for t in range(12)]
    convs = spark.createDataFrame(rows, CONVS).repartition(4)
    distinct = {(r[0], r[1]) for r in rows}
    assert len(distinct) < len(rows)
    assert sorted((tuple(r) for r in trie.prefix_trie(convs, largest=largest).collect()), key=repr) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(spark.createDataFrame([], CONVS)).count() == 0


def test_turns_of_one_number_keep_one_order(spark):
    """All turns of a conversation without numbers, spread over many partitions, make the same trie on every run."""
    rows = [(c, None, "user", f"w{(i * 7 + c) % 50}", 1) for c in (3, 4) for i in range(50)]
    once = sorted(map(tuple, trie.prefix_trie(spark.createDataFrame(rows, CONVS)).collect()), key=repr)
    again = sorted(map(tuple, trie.prefix_trie(spark.createDataFrame(rows[::-1], CONVS).repartition(7)).collect()), key=repr)
    assert once == again and max(r[1] for r in once) == 50
