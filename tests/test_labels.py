"""Label exclusion over labels of all lengths, against the definition."""

import random
import re

from runweave.operators import text


def test_labels_of_all_lengths(spark):
    rnd = random.Random(1)
    docs = [(i, "".join(rnd.choice("ab c-D1") for _ in range(rnd.choice([0, 1, 5, 40, 300])))) for i in range(60)] + [(99, None)]
    compact = lambda t: re.sub("[^a-z0-9]", "", (t or "").lower())
    labels = [(k, compact(docs[rnd.randrange(60)][1])[rnd.randrange(5) :][: rnd.choice([1, 2, 3, 4, 6, 7, 9, 20, 33, 70])]) for k in range(80)] + [(200, "-"), (201, None), (202, "zz"), (203, "q")]
    got = text.exclude_labels(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "item_id long, text string"))
    want = sorted((d, k) for d, t in docs for k, label in labels if compact(label) and compact(label) in compact(t))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == want
    none = spark.createDataFrame([], "item_id long, text string")
    assert text.exclude_labels(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0
