"""Removal of repeated strings against brute force, and merged transforms against plain sets of strings."""

import hashlib
import random

import numpy as np
import pytest

from runweave.llm import suffixes

DOCS = "doc_id long, text string, id int, n_bytes string"


def brute(rows, length):
    """rows: (doc_id, text), each distinct row once, in the order of the operator."""
    seen, out = {}, {}
    for row in rows:
        data = (row[1] or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            string = data[i : i + length]
            if seen.setdefault(string, (row, i)) != (row, i):
                gone[i : i + length] = True
        spans = sum(1 for i in range(len(data)) if gone[i] and not (i and gone[i - 1]))
        out[row] = (row[0], len(data), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def check(spark, rows, length, hot=suffixes.HOT):
    docs = spark.createDataFrame([(*row, 1, "x") for row in rows], DOCS).repartition(5)
    keyed = suffixes._keyed(docs, "doc_id", "text").collect()
    place = {(r["given"], bytes(r["text"])): (r["id"], r["th"]) for r in keyed}
    want = brute(sorted({(i, t or "") for i, t in rows}, key=lambda row: place[row[0], row[1].encode()]), length)
    got = suffixes.without_repeats(docs.drop("id", "n_bytes").withColumnsRenamed({"text": "body"}), length, hot, text_col="body").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((want[i, t or ""] for i, t in rows), key=repr)


@pytest.mark.parametrize("hot", [1, 4096])
def test_repeats(spark, hot):
    rng = random.Random(hot)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    line = " ".join(words[:40])
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 120)))
        at = rng.randrange(len(text) + 1)
        rows.append((i, text[:at] + line[rng.randrange(9) : 90 + rng.randrange(60)] + text[at:] if i % 3 == 0 else text))
    near = rows[5][1]
    rows += [(100 + i, near[: i * 7] + "#" + near[i * 7 :]) for i in range(20)]
    rows += [(200, "ab" * 90 + "x" + "ab" * 70), (201, "a" * 400), (202, "a" * 99), (203, None), (204, ""), (None, near), (None, None), (-7, near), (205, "日本" * 60), (1 << 40, line)]
    rows += [(206, near), (206, near), (206, near + "!"), (207, "z" + near), (None, near)]
    check(spark, rows, 100, hot)


def test_short_strings(spark):
    """Strings of a few bytes repeat everywhere: many pieces of one seed, many blocks that go on to the last round."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 60)))) for i in range(50)]
    for length in (1, 2, 7, 16):
        check(spark, rows, length, hot=8)


def test_long_text(spark):
    """A text of several blocks repeats strings of its own and of others across the edges of blocks."""
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh") for _ in range(int(2.2 * suffixes.BLOCK)))
    edge = suffixes.BLOCK
    text = text[:-5000] + text[edge - 300 : edge + 300] + text[-4400:]
    check(spark, [(1, text[edge - 150 : edge + 40]), (2, text), (3, text[2 * edge - 50 : 2 * edge + 60]), (4, text[500:1500])], 100)


def test_nothing(spark):
    assert suffixes.without_repeats(spark.createDataFrame([], DOCS).drop("n_bytes")).count() == 0
    with pytest.raises(ValueError):
        suffixes.without_repeats(spark.createDataFrame([], DOCS), id_col="n_bytes")


def test_merged_transforms():
    rng = random.Random(1)
    for _ in range(150):
        length, n = rng.choice([1, 2, 3, 5, 8, 13, 20]), rng.randrange(1, 12)
        strings = [bytes(rng.choice([97, 98, 255, 0]) for _ in range(rng.randrange(length, 60))) for _ in range(n)]
        buckets = np.array(sorted(rng.randrange(3) for _ in strings))
        rows, bounds = suffixes.transforms([np.frombuffer(s, np.uint8) for s in strings], buckets)
        shards, order = [], []
        for i, bucket in enumerate(np.unique(buckets)):
            own = np.flatnonzero(buckets == bucket)
            sent = suffixes._shard_data(rows[bounds[i] : bounds[i + 1]], np.zeros(len(own), suffixes.STRING))
            shards.append((suffixes._shard_of(sent)[0], np.array([len(strings[j]) for j in own])))
            order += own.tolist()
        places, blocks = suffixes.merged(shards, length)
        found, want = {}, {}
        for string, offset, block in zip(*places, blocks, strict=True):
            found.setdefault(int(block), []).append((order[string], int(offset)))
        for i, string in enumerate(strings):
            for offset in range(len(string) - length + 1):
                want.setdefault(string[offset : offset + length], []).append((i, offset))
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))
