"""Document fingerprints from prefix polynomial hashes.

For a text c[0..n) and a base B the prefix array P[i] = sum of c[j] * B^j (j < i) modulo the Mersenne prime 2^31 - 1
gives the hash of any span in constant time: spans of equal length are equal (two bases: up to a chance of about
2^-62) if (P[i+L] - P[i]) * B^-i agrees. A fingerprint is made of the smallest mixed hashes of all windows of a fixed
length, so two fingerprints estimate the share of text that two documents have in common; longest common extensions
come from the same arrays by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import no_clash

#: The modulus 2^31 - 1, two bases, the characters of a window, and the hashes a fingerprint keeps.
PRIME, BASES, WINDOW, SIZE = (1 << 31) - 1, (911_382_323, 972_663_749), 16, 64
#: Texts of fewer characters than SHORT also keep the hashes of all windows of SHORT_WINDOW characters.
SHORT, SHORT_WINDOW = 64, 3
#: Positions worked on at once: texts of any length need arrays of this size only, besides their prefix arrays.
PIECE = 1 << 16
#: Bytes of text a task is dealt about.
TASK_BYTES = 32 << 20

_tables: list = []


def _powers():
    """(up, down) for each base: B^i and B^-i modulo PRIME for i < PIECE; made once in each Python worker."""
    import numpy as np

    if not _tables:
        for base in BASES:
            both = []
            for step in (base, pow(base, -1, PRIME)):
                row = np.ones(1, dtype=np.uint64)
                while len(row) < PIECE:
                    row = np.concatenate([row, row * np.uint64(pow(step, len(row), PRIME)) % np.uint64(PRIME)])
                both.append(row)
            _tables.append(both)
    return _tables


def _reduced(x):
    """x modulo PRIME for x < 2^62, by shifts; PRIME itself stands for 0 in what comes out of the first two steps."""
    import numpy as np

    p, s = np.uint64(PRIME), np.uint64(31)
    x = (x & p) + (x >> s)
    x = (x & p) + (x >> s)
    x[x >= p] -= p
    return x


class PrefixHashes:
    """Prefix arrays of one text for both bases, 8 bytes a character."""

    def __init__(self, text: str):
        import numpy as np

        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        n = self.n = len(codes)
        self.prefix = []
        for base, (up, _) in zip(BASES, _powers(), strict=True):
            row, last = np.zeros(n + 1, dtype=np.uint32), 0
            for at in range(0, n, PIECE):
                part = codes[at : at + PIECE].astype(np.uint64) + np.uint64(1)
                part = _reduced(part * up[: len(part)])  # below 2^53, so the sums of a piece stay below 2^47
                if at:
                    part = _reduced(part * np.uint64(pow(base, at, PRIME)))
                part = _reduced(np.cumsum(part) + np.uint64(last))
                row[at + 1 : at + 1 + len(part)] = part
                last = int(part[-1])
            self.prefix.append(row)

    def span(self, start: int, length: int) -> tuple[int, int]:
        """Hash of one span, as one number a base."""
        return tuple((int(row[start + length]) - int(row[start])) * pow(base, -start, PRIME) % PRIME for row, base in zip(self.prefix, BASES, strict=True))

    def spans(self, length: int, low: int, high: int):
        """64-bit hashes of the spans of `length` characters that begin at low <= i < high, piece by piece."""
        import numpy as np

        for at in range(low, high, PIECE):
            n, parts = min(PIECE, high - at), []
            for base, row, (_, down) in zip(BASES, self.prefix, _powers(), strict=True):
                gap = _reduced((row[at + length : at + length + n].astype(np.uint64) + np.uint64(PRIME) - row[at : at + n]) * down[:n])
                parts.append(_reduced(gap * np.uint64(pow(base, -at, PRIME))) if at else gap)
            yield (parts[0] << np.uint64(31)) | parts[1]


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """Length of the longest common extension of a from i and b from j, by binary search over span hashes."""
    if i == 0 and j == 0:  # spans from the start are the prefix values themselves
        (a0, a1), (b0, b1) = a.prefix, b.prefix
        low, high = 0, min(a.n, b.n)
        while low < high:
            half = (low + high + 1) // 2
            if a0[half] == b0[half] and a1[half] == b1[half]:
                low = half
            else:
                high = half - 1
        return low
    low, high = 0, max(0, min(a.n - i, b.n - j))
    back = [(pow(base, -i, PRIME), pow(base, -j, PRIME)) for base in BASES]
    sides = [(own, int(own[i]), down, other, int(other[j]), up) for own, other, (down, up) in zip(a.prefix, b.prefix, back, strict=True)]
    while low < high:
        half = (low + high + 1) // 2
        if all(((int(own[i + half]) - p) * down - (int(other[j + half]) - q) * up) % PRIME == 0 for own, p, down, other, q, up in sides):
            low = half
        else:
            high = half - 1
    return low


def mixed(hashes):
    """32-bit values of window hashes, mixed so that their order is as if by chance."""
    import numpy as np

    out = hashes * np.uint64(0x9E3779B97F4A7C15)
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (out >> np.uint64(32)).astype(np.uint32)


def smallest(values, size: int = SIZE):
    """The `size` smallest different values, ascending."""
    import numpy as np

    if len(values) > 8 * size:
        bound = (4 * size << 32) // len(values)
        while bound < 1 << 32:
            low = np.unique(values[values < bound])
            if len(low) >= size:
                return low[:size]
            bound *= 8
    return np.unique(values)[:size]


def sketch(hashes: PrefixHashes, length: int, low: int = 0, high: int | None = None, size: int = SIZE):
    """The smallest different mixed values of the windows of `length` characters that begin at low <= i < high.

    high: by default all windows. A text shorter than a window is one window; an empty text has none.
    """
    import numpy as np

    length = min(length, hashes.n)
    if high is None:
        high = hashes.n - length + 1 if length else 0
    out = np.zeros(0, dtype=np.uint32)
    for part in hashes.spans(length, low, max(low, high)):
        values = mixed(part)
        if len(out) == size:
            values = values[values < out[-1]]
        out = smallest(np.concatenate([out, values]) if len(out) else values, size)
    return out


def merged(a, b, size: int = SIZE):
    """The sketch of all windows of two sketches."""
    import numpy as np

    return np.unique(np.concatenate([a, b]))[:size]


class Print:
    """A fingerprint: the sketch of the long windows and, for texts shorter than SHORT, that of the short ones."""

    def __init__(self, long, short=None):
        self.long, self.short = long, short

    @classmethod
    def of(cls, hashes: PrefixHashes) -> Print:
        return cls(sketch(hashes, WINDOW), sketch(hashes, SHORT_WINDOW) if hashes.n < SHORT else None)

    def written(self) -> str:
        """Lowercase hex, eight digits a value; the short windows follow after a point. Empty texts give ''."""
        hexed = [x.astype(">u4").tobytes().hex() for x in (self.long, self.short) if x is not None]
        return ".".join(hexed).strip(".")


def resemblance(a, b, size: int = SIZE) -> float:
    """2J / (1 + J) for the estimated resemblance J of two sketches; 1 for two empty ones, 0 if one is empty."""
    import numpy as np

    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = np.union1d(a, b)[:size]
    j = np.count_nonzero(np.isin(least, a) & np.isin(least, b)) / len(least)
    return 2 * j / (1 + j)


def likeness(a: Print, b: Print) -> float:
    """Estimated share of text in common (0 to 1) of two fingerprints.

    Two texts shorter than SHORT are compared by their short windows, all others by the long ones. Two empty texts are
    alike (1.0), an empty and another text are not (0.0).
    """
    if a.short is not None and b.short is not None:
        return resemblance(a.short, b.short)
    return resemblance(a.long, b.long)


def fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """df with out_col: the fingerprint of each whole text as lowercase hex; null counts as empty, which gives ''.

    A column of the name out_col in df is an error (ValueError).
    """
    import pyarrow as pa

    no_clash(df.columns, out_col)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            made = [Print.of(PrefixHashes(t.as_py() or "")).written() for t in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, out_col])

    return df.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())]))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_a_bucket: int = 1000, most_buckets: int = 1 << 20) -> DataFrame:
    """Rows dealt out and sorted so that a task can walk from each document to the next: bucket, extra, key, id, text.

    Ids are cut into buckets at quantiles (one aggregate over ids and lengths) and evenly between them. The first row
    of each bucket also goes, as an `extra` row, to the bucket before it, that of the first bucket to the last one. So
    each text is shuffled once, to partitions in number as the bytes of all texts, no window runs over the whole table,
    and reruns agree. Order: null ids first, then ascending; rows of equal id by their text. A null text counts as
    empty. Only one number a bucket, at most most_buckets of them, comes to the driver and is broadcast.
    """
    import numpy as np

    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = df.select(key.alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    steps = [i / 256 for i in range(257)]
    found = rows.agg(F.count("*").alias("n"), F.percentile_approx("key", steps, 100_000).alias("cuts"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not found["n"]:
        return rows.select(F.lit(0).alias("bucket"), F.lit(False).alias("extra"), "key", "id", "text")
    cuts = np.unique(np.array(found["cuts"], dtype=np.float64))
    each = max(1, min(found["n"] // rows_a_bucket, most_buckets) // max(1, len(cuts) - 1))

    def place(keys: pd.Series):
        return np.floor(np.interp(keys.to_numpy(np.float64), cuts, np.arange(len(cuts), dtype=np.float64)) * each).astype(np.int64)

    @F.pandas_udf("long")
    def bucket_of(keys: pd.Series) -> pd.Series:
        return pd.Series(place(keys))

    lows = rows.select("key", bucket_of("key").alias("bucket")).groupBy("bucket").agg(F.min("key").alias("low")).toArrow().sort_by("bucket")
    bounds = df.sparkSession.sparkContext.broadcast((lows.column("bucket").to_numpy(), lows.column("low").to_numpy()))

    @F.pandas_udf("array<struct<bucket:long,extra:boolean>>")
    def targets(keys: pd.Series) -> pd.Series:
        buckets, low = bounds.value
        own = place(keys)
        at = np.searchsorted(buckets, own)
        first, before = low[at] == keys.to_numpy(), buckets[at - 1]
        return pd.Series([[{"bucket": int(b), "extra": False}, {"bucket": int(o), "extra": True}] if f else [{"bucket": int(b), "extra": False}] for b, o, f in zip(own, before, first, strict=True)])

    dealt = rows.withColumn("to", F.explode(targets("key"))).select("to.bucket", "to.extra", "key", "id", "text")
    return dealt.repartition(max(1, -(-found["bytes"] // TASK_BYTES)), "bucket").sortWithinPartitions("bucket", "extra", "key", "text")


def compare_with_edit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4) -> DataFrame:
    """Fingerprints of each whole text, of its edited text, and their likeness to each other and to the next document.

    The edited text has the last floor(n / share) code points replaced by the first as many (or all) of the next
    document by ascending id; after the last comes the first. Columns: id_col, n_chars long, edited_sha256, fingerprint,
    edited_fingerprint string, near_edited, near_next double, same_prefix long (longest common extension of the text
    and its edited text from their starts), same_prefix_next long. Null counts as empty: fingerprint '', likeness 1
    to another empty text and 0 to any other. A single document is its own next. Repeated rows stay. Further columns
    of df, whatever their names, do not matter; id_col by the name of an output is an error (ValueError).

    The edited text shares its head with the text: only windows that touch its tail are hashed anew.
    """
    import pyarrow as pa

    kind = df.schema[id_col].dataType
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "same_prefix", "same_prefix_next"]
    no_clash([id_col], *names)
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def hashed(text: str) -> tuple:
        """(prefix arrays, fingerprint, sketch of the windows that end before the part that is edited)."""
        hashes = PrefixHashes(text)
        if hashes.n < SHORT:
            return hashes, Print.of(hashes), None
        edge = max(0, hashes.n - hashes.n // share - WINDOW + 1)
        head = sketch(hashes, WINDOW, 0, edge)
        return hashes, Print(merged(head, sketch(hashes, WINDOW, edge, hashes.n - WINDOW + 1))), head

    def compared(text: str, now: tuple, after: str, then: tuple) -> tuple:
        hashes, own, head = now
        n, q = hashes.n, hashes.n // share
        edited = text[: n - q] + after[:q]
        if head is None or len(edited) < SHORT:
            its = Print.of(PrefixHashes(edited))
        else:
            tail = PrefixHashes(edited[max(0, n - q - WINDOW + 1) :])
            its = Print(merged(head, sketch(tail, WINDOW)) if tail.n >= WINDOW else head)
        same = n - q + common_extension(hashes, n - q, then[0], 0)
        return (n, hashlib.sha256(edited.encode()).hexdigest(), own.written(), its.written(), likeness(own, its), likeness(own, then[1]), same, common_extension(hashes, 0, then[0], 0))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            ids, out = [], []
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("bucket", "extra", "id", "text")]
            for row in zip(*columns, strict=True):
                bucket, extra, number, text = (x.as_py() for x in row)
                if extra and (held is None or held[0] != bucket):
                    continue  # a further row of the same lowest id: only the first is the next document
                now = hashed(text)
                if held is not None and held[0] == bucket:
                    ids.append(held[1])
                    out.append(compared(held[2], held[3], text, now))
                held = None if extra else (bucket, number, text, now)
            if ids:
                made = [pa.array(values, k) for values, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, columns[2].type), *made], names=[id_col, *names])

    types = [T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType(), T.LongType(), T.LongType()]
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(n, t) for n, t in zip(names, types, strict=True))])
    return with_next(df, id_col, text_col).mapInArrow(work, schema)
