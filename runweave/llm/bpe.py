"""Byte-level BPE encoding and decoding by merge replay.

A task takes its documents in blocks. The distinct pre-tokens of a block that the worker has not met yet form one
small corpus: all their bytes lie in one array of positions with links to both neighbours, and an inverted index
leads from each mergeable pair (named by the rank that it merges to) to its positions. The merges are then applied in
rank order to all words at once, and each touches only the index entries of the two neighbours. Words repeat, so
results are kept per worker (bounded); no pre-token is ever shuffled, and a very long pre-token costs no more per
byte than short ones.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_blocks, no_clash

#: Most pre-tokens a worker remembers, and the longest (characters) among them.
CACHE_WORDS, CACHE_CHARS = 400_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes, from a file with `base64 rank` on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Encodes sets of words with given ranks; equal to encoding each word alone, lowest rank first, leftmost first."""

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np

        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        single = [ranks.get(bytes([i])) for i in range(256)]
        if None in single:
            raise ValueError("the ranks lack single bytes")
        self.single = np.array(single, dtype=np.int64)
        self.byte_pairs = np.array([ranks.get(bytes([i, j]), -1) for i in range(256) for j in range(256)], dtype=np.int64)
        self.merged: dict[int, int] = {}

    def pair(self, key: int) -> int:
        """The rank to which the tokens of key (left * 2^24 + right) merge, or -1; remembered."""
        if len(self.merged) > 2_000_000:
            self.merged.clear()
        out = self.merged[key] = self.ranks.get(self.token[key >> 24] + self.token[key & 0xFFFFFF], -1)
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """For each word its ids as little-endian unsigned 32-bit integers."""
        import numpy as np

        whole, parts, out = self.ranks.get, [], [b""] * len(words)
        for number, word in enumerate(words):
            if (rank := whole(word)) is not None:
                out[number] = rank.to_bytes(4, "little")
            elif word:
                parts.append(number)
        if not parts:
            return out
        ends = np.cumsum([len(words[number]) for number in parts])
        data = np.frombuffer(b"".join(words[number] for number in parts), dtype=np.uint8).astype(np.int64)
        # At each position: its token, its neighbours (-1: none), and the rank of the pair that begins there (-1: none).
        n, last = len(data), ends - 1
        pairs = np.full(n, -1, dtype=np.int64)
        pairs[:-1] = self.byte_pairs[data[:-1] * 256 + data[1:]]
        pairs[last] = -1
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        right[last], left[np.concatenate([[0], ends[:-1]])] = -1, -1
        at = np.nonzero(pairs >= 0)[0]
        at = at[np.argsort(pairs[at], kind="stable")]
        kinds, begins = np.unique(pairs[at], return_index=True)
        index = {rank: places.tolist() for rank, places in zip(kinds.tolist(), np.split(at, begins[1:]), strict=True)} if len(at) else {}
        ids, ranks, after, before, alive = self.single[data].tolist(), pairs.tolist(), right.tolist(), left.tolist(), bytearray(b"\1") * n
        heap, known, pair = sorted(index), self.merged.get, self.pair
        while heap:
            rank = heappop(heap)
            places = index.pop(rank, None)
            if not places:
                continue
            places.sort()
            later: list[int] = []
            closed = -1
            for place in places:
                if ranks[place] != rank:
                    continue
                if place < closed:
                    later.append(place)
                    continue
                second = after[place]
                third = after[second]
                ids[place], ranks[second], alive[second], after[place] = rank, -1, 0, third
                lower = False
                if third >= 0:
                    before[third] = place
                    key = rank << 24 | ids[third]
                    if (new := known(key)) is None:
                        new = pair(key)
                    ranks[place] = new
                    if new >= 0:
                        lower = new < rank
                        if new in index:
                            index[new].append(place)
                        else:
                            index[new] = [place]
                            heappush(heap, new)
                else:
                    ranks[place] = -1
                first = before[place]
                if first >= 0:
                    key = ids[first] << 24 | rank
                    if (new := known(key)) is None:
                        new = pair(key)
                    ranks[first] = new
                    if new >= 0:
                        lower = lower or new < rank
                        if new in index:
                            index[new].append(first)
                        else:
                            index[new] = [first]
                            heappush(heap, new)
                if lower:  # the rest of this word must take the lower rank first
                    closed = int(ends[np.searchsorted(ends, place, side="right")])
            if later:
                if rank in index:
                    index[rank] += later
                else:
                    index[rank] = later
                    heappush(heap, rank)
        kept = np.frombuffer(alive, dtype=np.uint8).astype(bool)
        packed = np.array(ids, dtype="<u4")[kept].tobytes()
        stops = (4 * np.cumsum(kept)[last]).tolist()
        begin = 0
        for number, stop in zip(parts, stops, strict=True):
            out[number] = packed[begin:stop]
            begin = stop
        return out


class Codec:
    """Texts to ids and back; one lives in each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.replay = MergeReplay(ranks)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        cut = [self.find(text) for text in texts]
        new = list({word for words in cut for word in words if word not in known})
        long: list[str] = []
        for word, packed in zip(new, self.replay.encode_words([w.encode() for w in new]), strict=True):
            known[word] = packed
            if len(word) > CACHE_CHARS:
                long.append(word)
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        for word in long:
            del known[word]
        return out

    def decode(self, packed: bytes) -> bytes:
        ids = array("I")
        ids.frombytes(packed)
        return b"".join(map(self.replay.token.__getitem__, ids))


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    key = (shared.id, pattern) if hasattr(shared, "id") else (id(shared), pattern)
    if key not in _codecs:
        _codecs.clear()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.split(b"\n") if line.strip())}
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _shared_ranks(df: DataFrame, ranks_path: str):
    """The rank file itself, broadcast: its size is that of the vocabulary, whatever the corpus."""
    with open(ranks_path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _mapped(df: DataFrame, work, fields: list[T.StructField]) -> DataFrame:
    return df.mapInArrow(work, T.StructType([*df.schema.fields, *fields]))


def encode(df: DataFrame, ranks_path: str, pattern: str | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with the column ids_col: array<int> of token ids of the whole text.

    Null and empty texts give an empty array; repeated rows stay; columns of df are kept as they are. An existing
    column named ids_col is an error of the caller (ValueError).
    """
    import pyarrow as pa

    no_clash(df.columns, ids_col)
    shared, pattern = _shared_ranks(df, ranks_path), pattern or _pattern()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        codec = _codec(shared, pattern)
        for batch in batches:
            for start, texts in column_blocks(batch, text_col):
                packed = codec.encode(texts)
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32))
                ids = pa.ListArray.from_arrays(pa.array(ends), values)
                rows = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*rows.columns, ids], names=[*rows.schema.names, ids_col])

    return _mapped(df, work, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))])


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with the column bytes_col: the bytes that ids_col (array<int>) stands for; null ids give empty bytes.

    An id outside the vocabulary fails the task with a KeyError that names it. An existing column named bytes_col is an
    error of the caller (ValueError).
    """
    import pyarrow as pa

    no_clash(df.columns, bytes_col)
    shared = _shared_ranks(df, ranks_path)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, ".")
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            decoded = pa.array([codec.decode(array("I", ids.as_py() or []).tobytes()) for ids in column], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, bytes_col])

    return _mapped(df, work, [T.StructField(bytes_col, T.BinaryType())])


def round_trip(df: DataFrame, ranks_path: str, pattern: str | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode and decode whole texts in one pass and return digests of both, with the columns `keep`.

    n_tokens long, ids_sha256 and decoded_sha256 (lowercase hex), exact boolean (decoded bytes equal the text's).
    Null counts as the empty text. Map-only: rows come out as they went in, with repeats and null keys. A column of
    `keep` by the name of an output is an error (ValueError); other columns of df do not matter.
    """
    import pyarrow as pa

    no_clash(keep, "n_tokens", "ids_sha256", "decoded_sha256", "exact")
    shared, pattern = _shared_ranks(df, ranks_path), pattern or _pattern()
    own = [f"k{i}" for i in range(len(keep))]
    df = df.select(*(F.col(c).alias(k) for k, c in zip(own, keep, strict=True)), F.col(text_col).alias("text"))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("exact", T.BooleanType())]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            for start, texts in column_blocks(batch, "text"):
                rows: list[tuple] = []
                for text, packed in zip(texts, codec.encode(texts), strict=True):
                    decoded = codec.decode(packed)
                    rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest(), decoded == text.encode()))
                part = batch.slice(start, len(texts)).select(own)
                made = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *(f.name for f in fields)])

    found = df.mapInArrow(work, T.StructType([*(df.schema[k] for k in own), *fields]))
    return found.select(*(F.col(k).alias(c) for k, c in zip(own, keep, strict=True)), *(f.name for f in fields))
