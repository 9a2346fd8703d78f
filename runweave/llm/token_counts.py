"""Token counts by a two-tier lookup on the map side.

One pass over the whole corpus finds frequent pre-tokens: each task keeps a bounded summary (the smallest counts are
dropped when it is full), and the summaries, a fixed number of rows a task, are added up. The most frequent ones are
encoded once and broadcast as a compact hash table from pre-token to length; its size is a parameter. A second pass
looks each pre-token up there, encodes misses with the tokenizer through a bounded cache in the worker, and adds the
lengths. No pre-token is shuffled, and the table only saves work: a miss is always encoded.

Pre-tokens are cut by a pattern, which the tokenizer's own cutting may follow for another version of Unicode. Both are
compared code point by code point when a query is planned; only a text with a code point on which they disagree (a
letter that one of them does not know) is encoded by the library as a whole.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_blocks, no_clash

#: Entries of a task's summary, entries of the broadcast table, words in a worker's cache.
SUMMARY, FREQUENT, CACHE = 8192, 16384, 400_000
#: Longest pre-token (characters) that is summed up or remembered.
LONGEST = 64
#: Code points that are compared; texts with one beyond (none is assigned there) go to the library.
COMPARED = (range(0x80, 0xD800), range(0xE000, 0x32400), range(0xE0000, 0xE0200))
_odd: dict[tuple[str, str], str] = {}


def odd_characters(model: str, pattern: str) -> str:
    """The code points on which pattern and the model's own cutting disagree, ascending; those not compared are odd too."""
    import regex
    from tokenizers import Tokenizer

    if (model, pattern) not in _odd:
        own, find = Tokenizer.from_str(model).pre_tokenizer, regex.compile(pattern).findall

        def differing(codes: list[int]) -> list[int]:
            probe = "".join(f"a{c}1{c} {c}\n" for c in map(chr, codes))
            if [b - a for _, (a, b) in own.pre_tokenize_str(probe)] == [len(w) for w in find(probe)]:
                return []
            if len(codes) == 1:
                return codes
            step = -(-len(codes) // 8)
            return [c for at in range(0, len(codes), step) for c in differing(codes[at : at + step])]

        found = [c for codes in COMPARED for at in range(0, len(codes), 512) for c in differing(list(codes[at : at + 512]))]
        _odd[model, pattern] = "".join(map(chr, sorted(found)))
    return _odd[model, pattern]


class _Odd:
    """Whether a text has an odd character; a text without any from the first odd one on is told by one scan."""

    def __init__(self, odd: str):
        import regex

        outside = [range(a.stop, b.start) for a, b in zip(COMPARED, [*COMPARED[1:], range(0x110000, 0x110000)], strict=True)]
        self.beyond = regex.compile("[" + "".join(f"\\U{r.start:08x}-\\U{r.stop - 1:08x}" for r in outside if r.start < 0xD800 or r.start >= 0xE000) + "]").search
        self.some = regex.compile(f"[\\U{ord(odd[0]) if odd else 0x10FFFF:08x}-\U0010ffff]").search
        self.odd = frozenset(odd)

    def __call__(self, text: str) -> bool:
        return not text.isascii() and bool(self.some(text)) and (not self.odd.isdisjoint(text) or bool(self.beyond(text)))


class _Counter:
    """Counts tokens in one worker."""

    def __init__(self, model: str, pattern: str, odd: str, frequent: dict[str, int] | None = None):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(model)
        self.added = [t["content"] for t in json.loads(model)["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in json.loads(model)["added_tokens"]):
            raise ValueError("added tokens that take in their neighbourhood are not handled")
        self.find = regex.compile(pattern).findall
        self.odd = _Odd(odd)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))).split if self.added else None
        self.frequent = frequent or {}
        self.cache: dict[str, int] = {}

    def words(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of text and the number of added tokens in it."""
        if not self.split or not any(token in text for token in self.added):
            return self.find(text), 0
        parts = self.split(text)
        return [word for part in parts for word in self.find(part)], len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        cut = [(None, 0) if self.odd(text) else self.words(text) for text in texts]
        frequent, cache = self.frequent, self.cache
        new = list({w for words, _ in cut if words for w in words if w not in frequent and w not in cache})
        for word, tokens in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
            cache[word] = len(tokens.ids)
        first, second = frequent.get, cache.__getitem__
        out = []
        for text, (words, added) in zip(texts, cut, strict=True):
            if words is None:
                out.append(len(self.tokenizer.encode(text, add_special_tokens=False).ids))
            else:
                out.append(added + sum(first(w) or second(w) for w in words))
        for word in new:
            if len(word) > LONGEST:
                del cache[word]
        return out


_workers: dict[tuple, _Counter] = {}


def _worker(shared, pattern: str) -> _Counter:
    key = (shared.id if hasattr(shared, "id") else id(shared), pattern)
    if key not in _workers:
        _workers.clear()
        _workers[key] = _Counter(shared.value["model"], pattern, shared.value["odd"], shared.value["frequent"])
    return _workers[key]


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def frequent_lengths(df: DataFrame, model: str, pattern: str, text_col: str = "text", size: int = FREQUENT, summary: int = SUMMARY) -> dict[str, int]:
    """Lengths of the about `size` most frequent pre-tokens of all texts of df; summary rows a task go to one sum."""
    import pyarrow as pa

    odd = odd_characters(model, pattern)
    shared = df.sparkSession.sparkContext.broadcast({"model": model, "odd": odd, "frequent": {}})

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, counts = _worker(shared, pattern), Counter()
        for batch in batches:
            for _, texts in column_blocks(batch, "text"):
                for text in texts:
                    counts.update(worker.words(text)[0])
                if len(counts) > 16 * summary:
                    counts = Counter(dict(counts.most_common(4 * summary)))
        top = [(word, n) for word, n in counts.most_common(summary) if len(word) <= LONGEST and n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    rows = df.select(F.col(text_col).alias("text")).mapInArrow(summed, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size).select("word").toArrow()
    words = rows.column("word").to_pylist()
    tokenizer = _Counter(model, pattern, odd).tokenizer
    return {word: len(tokens.ids) for word, tokens in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True)}


def count_tokens(df: DataFrame, model_path: str, pattern: str | None = None, text_col: str = "text", limit: int = 512, keep: tuple[str, ...] = ("doc_id",), frequent: int = FREQUENT) -> DataFrame:
    """Columns `keep`, n_bytes long (UTF-8), n_tokens long, over_limit boolean (n_tokens > limit) of every whole text.

    Counts are those of the tokenizers library for the byte-level BPE file model_path, without begin or end tokens;
    special strings inside a text count as the library's default has it. Null counts as the empty text: 0 bytes, 0
    tokens, not over. Rows come out as they went in, with repeats and null keys. A column of `keep` by the name of an
    output is an error (ValueError); other columns of df do not matter.
    """
    import pyarrow as pa

    no_clash(keep, "n_bytes", "n_tokens", "over_limit")
    with open(model_path, encoding="utf-8") as file:
        model = file.read()
    pattern = pattern or _pattern()
    own = [f"k{i}" for i in range(len(keep))]
    df = df.select(*(F.col(c).alias(k) for k, c in zip(own, keep, strict=True)), F.col(text_col).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast({"model": model, "odd": odd_characters(model, pattern), "frequent": frequent_lengths(df, model, pattern, size=frequent)})

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _worker(shared, pattern)
        for batch in batches:
            for start, texts in column_blocks(batch, "text"):
                counts = worker.count(texts)
                part = batch.slice(start, len(texts)).select(own)
                made = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "n_bytes", "n_tokens", "over_limit"])

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    found = df.mapInArrow(work, T.StructType([*(df.schema[k] for k in own), *fields]))
    return found.select(*(F.col(k).alias(c) for k, c in zip(own, keep, strict=True)), "n_bytes", "n_tokens", "over_limit")
