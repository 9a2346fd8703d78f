"""A quality classifier: naive Bayes support vectors.

Features of a text are indicators of n-grams: words, word pairs and n-grams of word shapes (with a rough share of the
text, so that one odd word differs from a text full of them). Each indicator is scaled by the log-count ratio of the
two classes, texts are scaled to length one, and a linear hinge-loss model is fitted to them by dual coordinate
descent. A Platt sigmoid fitted to margins of held-back rows turns margins into scores. Fitting takes a bounded,
deterministic sample of labelled rows; scoring is one pass over all texts with weights of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import no_clash

#: Most labelled rows that a model is fitted to; places of the hashed weights (a power of two).
MOST_ROWS, PLACES = 8192, 1 << 18
#: Constants of the fit: smoothing of the ratios, cost of the hinge loss, passes over the rows, held-back share.
SMOOTH, COST, PASSES, HELD_BACK = 1.0, 1.0, 12, 5
#: A margin at which the classes balance best gets this score.
THRESHOLD = 0.3


def _shape_table() -> bytes:
    """Bytes to classes: a lower (and not ASCII), A upper, 0 digit, white space as blank, other ASCII as itself."""
    out = bytearray(range(256))
    for b in range(256):
        c = chr(b)
        out[b] = ord("a") if b > 127 or c.islower() else ord("A") if c.isupper() else ord("0") if c.isdigit() else 32 if c in " \t\n\x0b\x0c\r" else b
    return bytes(out)


_SHAPES = _shape_table()


def features(text: str):
    """Sorted different feature numbers (int32) of a text below PLACES; the empty text has the ones of its length."""
    import zlib

    import numpy as np

    data = text.encode()
    words = data.lower().split()
    n, mask = len(words), np.uint32(PLACES - 1)
    crc = zlib.crc32
    parts = [np.array([crc(b"length %d" % n.bit_length()), crc(b"different %d" % (8 * len(set(words)) // max(1, n)))], dtype=np.uint32)]
    if n:
        single = np.fromiter(map(crc, words), dtype=np.uint32, count=n)
        parts.append(single)
        pairs = (single[:-1] * np.uint32(0x9E3779B1)) ^ (single[1:] + np.uint32(0x7F4A7C15))
        parts.append(pairs ^ (pairs >> np.uint32(15)))
        same = np.count_nonzero(single[:-1] == single[1:])
        parts.append(np.array([crc(b"same %d" % (8 * same // n))], dtype=np.uint32))
        shapes = np.frombuffer(data.translate(_SHAPES), dtype=np.uint8)
        shapes = shapes[np.concatenate([[True], shapes[1:] != shapes[:-1]])].tobytes().split()
        known: dict[bytes, int] = {}
        codes = np.fromiter((known.setdefault(s, len(known)) for s in shapes), dtype=np.int64, count=len(shapes))
        hashes = np.fromiter(map(crc, known), dtype=np.uint32, count=len(known))
        for size in (1, 2, 3):
            if len(codes) < size:
                break
            grams = np.zeros(len(codes) - size + 1, dtype=np.uint32)
            for i in range(size):
                grams = (grams ^ hashes[codes[i : i + len(grams)]]) * np.uint32(0x85EBCA6B) + np.uint32(size)
            grams, times = np.unique(grams, return_counts=True)
            share = np.floor(np.log2(times / len(codes) * 64 + 1)).astype(np.uint32)
            parts.append(grams ^ (grams >> np.uint32(13)))
            parts.append((grams + np.uint32(0x27D4EB2F)) * (np.uint32(2) * share + np.uint32(3)))
    return np.unique(np.concatenate(parts) & mask).astype(np.int32)


def fit(rows: list, labels) -> bytes:
    """Weights (float32, PLACES of them), bias, slope and offset of the sigmoid, as bytes. rows: feature arrays.

    With one class only, or no rows, every text gets the share of label 1 (0.5 without rows).
    """
    import numpy as np

    y = np.asarray(labels, dtype=np.int64)
    weights, share = np.zeros(PLACES, dtype=np.float32), float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return np.concatenate([weights, np.array([0, 1, np.log(share / (1 - share))], dtype=np.float32)]).astype("<f4").tobytes()

    def descend(take):
        counts = [np.full(PLACES, SMOOTH), np.full(PLACES, SMOOTH)]
        for i in take:
            counts[y[i]][rows[i]] += 1
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        data = []
        for i in take:
            v = ratio[rows[i]]
            data.append((rows[i], v / max(1e-9, float(np.sqrt(v @ v + 1)))))
        sign, w, b = np.where(y[take] > 0, 1.0, -1.0), np.zeros(PLACES), 0.0
        cost = np.where(y[take] > 0, COST * 0.5 / y[take].mean(), COST * 0.5 / (1 - y[take].mean()))
        alpha, order = np.zeros(len(take)), np.random.default_rng(7)
        norm = np.array([v @ v + 1 for _, v in data])
        for _ in range(PASSES):
            for k in order.permutation(len(take)):
                at, v = data[k]
                gradient = sign[k] * (w[at] @ v + b) - 1
                new = min(max(alpha[k] - gradient / norm[k], 0.0), cost[k])
                if new != alpha[k]:
                    step = (new - alpha[k]) * sign[k]
                    w[at] += step * v
                    b += step
                    alpha[k] = new
        return ratio, w, b

    def margin(model, at):
        ratio, w, b = model
        v = ratio[at]
        return float(w[at] @ v / max(1e-9, float(np.sqrt(v @ v + 1))) + b)

    numbers = np.arange(len(y))
    held = numbers[numbers % HELD_BACK == 0]
    rest = numbers[numbers % HELD_BACK != 0]
    slope, offset = 2.0, 0.0
    if len(held) >= 10 and 0 < y[held].mean() < 1 and 0 < y[rest].mean() < 1:
        model = descend(rest)
        m = np.array([margin(model, rows[i]) for i in held])
        slope, offset = _sigmoid(m, y[held])
        # The sigmoid keeps its slope; its offset puts THRESHOLD where both classes are best told apart.
        ordered = np.sort(m)
        cuts = (ordered[1:] + ordered[:-1]) / 2
        good = [(m[y[held] == 1] >= c).mean() + (m[y[held] == 0] < c).mean() for c in cuts]
        best = np.mean(cuts[np.isclose(good, max(good))])
        offset = np.log(THRESHOLD / (1 - THRESHOLD)) - slope * best
    ratio, w, b = descend(numbers)
    # Folded: the ratios scale both the features and their norm, so ratio and weight * ratio are both needed.
    return np.concatenate([w * ratio, ratio, [b, slope, offset]]).astype("<f4").tobytes()


def _sigmoid(margins, labels) -> tuple[float, float]:
    """Slope (> 0) and offset by Newton steps on the log loss, with Platt's softened targets."""
    import numpy as np

    pos, neg = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * margins).sum() + 1e-3 * (a - 1), g.sum()])
        hess = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return max(float(a), 0.1), float(b)


class Scorer:
    """Scores texts with fitted weights; one lives in each Python worker."""

    def __init__(self, model: bytes):
        import numpy as np

        data = np.frombuffer(model, dtype="<f4").astype(np.float64)
        self.bias, self.slope, self.offset = data[-3:]
        data = data[:-3]
        self.scaled = data[:PLACES]
        self.ratio = data[PLACES:] if len(data) > PLACES else np.zeros(PLACES)

    def score(self, text: str) -> float:
        import numpy as np

        at = features(text)
        r = self.ratio[at]
        margin = self.scaled[at].sum() / max(1e-9, float(np.sqrt(r @ r + 1))) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


_scorers: dict[int, Scorer] = {}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> bytes:
    """A model of label_col (0 or 1) fitted to at most most_rows labelled documents, chosen by a hash of the id.

    labels: id_col and label_col; rows with another or no label, and documents without text, are left out. The same
    tables give the same model. Texts do not move: the chosen ids are broadcast (their number is the bound), only
    feature numbers of their documents are shuffled, of each id one document (that of the least hash), and go to the one
    task that fits.
    """
    import pyarrow as pa

    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y")).orderBy(F.xxhash64(id_col), id_col).limit(most_rows)
    texts = docs.select(id_col, F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(chosen), id_col).select(F.col(id_col).cast("string").alias("id"), "y", "text")

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f.tobytes() for f in found], pa.binary())], names=["id", "y", "f"])

    def fitted(frame):
        import numpy as np
        import pandas as pd

        frame = frame.sort_values(["id", "y", "f"])
        return pd.DataFrame({"model": [fit([np.frombuffer(f, dtype=np.int32) for f in frame["f"]], frame["y"].to_numpy())]})

    # Rows that repeat an id are one: the one whose features have the least hash.
    rows = texts.mapInArrow(extract, "id string, y int, f binary").groupBy("id").agg(F.min_by(F.struct("y", "f"), F.xxhash64("f")).alias("least")).select("id", "least.y", "least.f")
    made = rows.groupBy(F.lit(0).alias("all")).applyInPandas(fitted, "model binary").first()
    return bytes(made["model"]) if made else fit([], [])


def score(docs: DataFrame, model: bytes, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """Columns `keep`, score double (0 to 1), predicted int (1 if score >= threshold) for each whole text.

    Null counts as the empty text, which gets a score too. Rows come out as they went in, with repeats and null keys.
    A column of `keep` by the name of an output is an error (ValueError); other columns of df do not matter.
    """
    import pyarrow as pa

    no_clash(keep, "score", "predicted")
    own = [f"k{i}" for i in range(len(keep))]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*(F.col(c).alias(k) for k, c in zip(own, keep, strict=True)), F.col(text_col).alias("text"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = getattr(shared, "id", id(shared))
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(shared.value)
        scorer = _scorers[key]
        for batch in batches:
            scores = [scorer.score(t.as_py() or "") for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=[*own, "score", "predicted"])

    found = rows.mapInArrow(work, T.StructType([*(rows.schema[k] for k in own), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
    return found.select(*(F.col(k).alias(c) for k, c in zip(own, keep, strict=True)), "score", "predicted")
