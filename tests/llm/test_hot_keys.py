"""Hot and odd keys: a third of all rows under one id, ids that sources share, and more languages than are broadcast."""

import random

from pyspark.sql import functions as F

from runweave.llm import classifier, mixing, quality_rules, simhash

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string"


def test_mixing_of_a_repeated_id(spark):
    """Rows of one id, equal or not, lie in many ranges and take what their source's target says."""
    rows = [(7, "a b c", None, "x")] * 3000 + [(7, f"w{i} v", None, "x") for i in range(3000)] + [(i, "one two", None, "y") for i in range(3000)] + [(None, None, None, "y")] * 1000
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    sizes = mixing.sized(docs)
    assert sizes.count() == 1 + 3000 + 3000 + 1 and sizes.groupBy(F.shiftright("key", 52)).count().agg(F.max("count")).first()[0] < 100
    mixed = mixing.mix(docs)
    assert mixed.count() == len(rows)
    taken = {r["source"]: (r["taken"], r["target"]) for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert all(got == int(target) for got, target in taken.values())
    assert mixed.where("taken > 2 * size or taken < 0").count() == 0


def test_copies_of_ids_that_sources_share(spark):
    """Null ids and ids that two sources have take the copies of their own source."""
    rows = [(None if i % 2 else i, f"t{i} u v", None, "a") for i in range(200)] + [(None if i % 2 else i, f"t{i} u w x", None, "b") for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    target = {r["source"]: r["target"] for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    words = mixing.mixed(docs).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    assert all(abs(r["n"] - target[r["source"]]) <= 4 for r in words) and len(words) == 2


def test_classifier_takes_one_row_an_id(spark):
    rng = random.Random(4)
    texts = ["good " * rng.randrange(1, 9) + rng.choice(["fine", "well"]) for _ in range(40)] + ["bad " * rng.randrange(1, 9) + rng.choice(["poor", "ill"]) for _ in range(40)]
    docs = [(i, t, None, None) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id long, quality int")
    frame = spark.createDataFrame(docs, SCHEMA)
    once = classifier.train(frame, labels)
    hot = frame.unionByName(spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(texts[5]).alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")))
    assert classifier.train(hot.repartition(5), labels) == once


def test_more_languages_than_are_broadcast(spark):
    rng = random.Random(5)
    words = {lang: ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(30)] for lang in range(60)}
    rows = [(i, " ".join(rng.choice(words[i % 60]) for _ in range(rng.randrange(5, 200 + (i % 60)))), None if i % 60 == 59 else f"l{i % 60}", None) for i in range(600)]
    rows += [(1000 + i, "#! ?? 12 " * 60, f"l{i}", None) for i in range(60)] + [(2000, None, "alone", None), (2001, "word " * 60, "single", None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    few, many = (sorted(map(tuple, quality_rules.judged(docs, most_langs=n).collect())) for n in (20, 2000))
    assert few == many and len(few) == len(rows)


def test_copies_nearer_to_their_text_than_to_each_other(spark):
    """Copies with edits of their own are similar to the text they come from only: stars around it link them all."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    rows = [(1000, " ".join(base), None, None)]
    for i in range(200):
        words = list(base)
        for at in rng.sample(range(10, 150, 10), 2):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words), None, None))
    rows += [(2000 + i, " ".join(f"o{i}y{k}" for k in range(50)), None, None) for i in range(20)]
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert sum(found[i] == 0 for i in range(200)) >= 198 and found[1000] == 0
    assert all(found[i] == i for i in range(2000, 2020))


def _edited(rng, base, share, name):
    """base with some words replaced, each by one that no other text has."""
    words = list(base)
    for at in rng.sample(range(len(base)), round(share * len(base))):
        words[at] = f"{name}x{at}"
    return " ".join(words)


def test_copies_that_are_just_not_similar(spark, monkeypatch):
    """Copies under the bound, from their text and from each other, are told apart without a row for each pair."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    texts = [" ".join(base), *(_edited(rng, base, 0.035, f"e{i}") for i in range(500))]
    held = []
    verified = simhash._verified

    def counted(df, docs, pairs, *more):
        held.append(pairs.count())
        return verified(df, docs, pairs, *more)

    monkeypatch.setattr(simhash, "_verified", counted)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    sets = [brute.shingle_set(t, 5) for t in texts]
    near = [(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert found == brute.joined(range(len(sets)), near)
    assert sum(held[1:]) < len(texts)


def test_groups_linked_at_their_edges(spark):
    """Two groups of copies whose centers are not similar are one where some of their copies are."""
    rng = random.Random(9)
    texts = []
    for group in range(20):
        base = [f"g{group}w{k}" for k in range(200)]
        other = _edited(rng, base, 0.03, f"o{group}").split()
        for i in range(12):
            between = [x if rng.random() < 0.5 else y for x, y in zip(base, other, strict=True)]
            texts += [_edited(rng, base, 0.01, f"a{group}y{i}"), _edited(rng, other, 0.01, f"b{group}y{i}"), " ".join(between)]
    sets = [brute.shingle_set(t, 5) for t in texts]
    near = [(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert found == brute.joined(range(len(texts)), near)


def test_rows_of_stars_grow_with_the_documents():
    """Near copies that meet again and again in a task have two rows each at most, and each that meets another has one."""
    import numpy as np
    import pyarrow as pa

    rng, bits = np.random.default_rng(8), 8
    for copies in (400, 800):
        whole = rng.permutation(np.arange(copies, dtype=np.int64)) << 40
        flips = rng.integers(0, 64, (copies, 4)).astype(np.uint64)
        check = np.bitwise_xor.reduce(np.uint64(1) << flips, axis=1).view(np.int64)
        code = rng.integers(0, 4, (copies, 6)) + (np.arange(6) << bits)  # six tables, of which few bits differ
        rows = [pa.array(code.ravel()), pa.array(np.repeat(check, 6)), pa.array(np.repeat(whole, 6))]
        alone = [pa.array([6 << bits, 7 << bits]), pa.array([0, 0]), pa.array([-1, -2])]
        made = pa.Table.from_batches(simhash._stars(bits)(pa.RecordBatch.from_arrays(x, names=["key", "check", "whole"]) for x in (rows, alone)))
        src, dst = made["src"].to_numpy(), made["dst"].to_numpy()
        assert len(made) <= 2 * copies and np.all(src < dst)
        assert set(src) | set(dst) == set(whole)


def test_marks_rule_out_no_similar_pair():
    """The difference by size and marks never exceeds the real one, whatever the widths; pairs that may be similar stay."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 40_000).astype(np.uint64)
    sets = [np.unique(pool[:0]), *(np.unique(pool[at : at + n]) for n in (1, 2, 31, 32, 33, 40, 250, 256, 300, 5_000, 9_000, 30_000) for at in (0, n // 12, n // 9, n // 5, n))]
    assert max(len(simhash._marks(s)) * 64 for s in sets) == simhash.MOST_MARKS
    size = np.array([len(s) for s in sets])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    shared = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    both = size[a] + size[b]
    far = simhash._differences(size, pa.array([simhash._marks(s) for s in sets], pa.list_(pa.int64())), 0.8)(a, b)
    similar = (shared >= 0.8 * (both - shared) - 1e-9) & (both > 0)
    assert similar.sum() > 2 * len(sets) and np.all(far[similar] < np.inf)
    kept = far < np.inf
    assert np.all(far[kept] * np.maximum(both[kept], 1) <= both[kept] - 2 * shared[kept] + 1e-6)
    assert (kept & ~similar & (both > 0)).sum() < 0.2 * (~similar).sum()


def test_index_of_more_than_a_million_documents(spark, monkeypatch):
    """Tables and bits of over 2 ** 20 documents make keys that an int cannot hold."""
    plan = simhash._plan((1 << 20) + 1, 0.8)
    monkeypatch.setattr(simhash, "_plan", lambda n, least: plan)
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(base), " ".join([*base[:99], "x"]), " ".join(f"o{k}" for k in range(50)), " ".join(base)]
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 0}
