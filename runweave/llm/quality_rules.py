"""Quality rules: counts of words, symbols and repeats, and divergence from references of the language.

The references are exact histograms over all documents of a language, however the rows are split: classes of
characters, and the most frequent words. A document is compared to those of its language by Jensen-Shannon distance (base 2, from 0 to 1), each comparison only
from a minimum length on. Everything but the references is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, cut, no_clash

#: Words whose shares are compared; different words a task counts before it sends its counts on and begins anew.
COMMON, COUNTED = 64, 1 << 17
#: Languages, those of the most words, whose references are broadcast; those of further ones are joined to their texts.
MOST_LANGS = 2_000
#: Largest Jensen-Shannon distances that pass, and the least characters and words from which they are applied. Clean
#: documents of sf0.1 reach a word distance of 0.43, word lists and made-up words are mostly at 0.51 to 0.61.
CLASS_LIMIT, WORD_LIMIT, LEAST_CHARS, LEAST_WORDS = 0.30, 0.50, 200, 50
#: Least share of common words, as a part of their share in the reference: a text without any is only 0.43 away from
#: it. Clean documents of sf0.1 whose language is labelled right have 0.68 of it or more.
LEAST_COMMON = 0.25
#: Languages, those of the most words, against which a text is held too that diverges from its own: labels can be wrong.
OTHERS = 16
#: Base rule: at least so many words, and at most so many hundredths of them in repeated 8-word windows.
FEWEST_WORDS, REPEAT_SHARE, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"


#: Classes of characters: 0 space, 1 lower, 2 upper, 3 number, 4 stop and comma, 5 symbol, 6 other punctuation, 7 letter
#: without case, 8 mark, 9 control and unassigned.
CLASSES = 10
_GENERAL = {"Ll": 1, "Lu": 2, "Lt": 2, "Lo": 7, "Lm": 7, "M": 8, "N": 3, "P": 6, "S": 5, "Z": 0, "C": 9}


def _class_of(code: int) -> int:
    c = chr(code)
    if code < 128:
        return 0 if c in " \t\n\x0b\x0c\r" else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c in ".,;:'" else 5 if c in "#*$%&|<>!?{}[]\\^~_=+@" else 6
    category = unicodedata.category(c)
    return _GENERAL.get(category, _GENERAL.get(category[0], 9))


_ASCII = bytes(map(_class_of, range(128))) + bytes(128)
_all: list = []


def class_counts(text: str):
    """How many code points of a text are of each class."""
    import numpy as np

    if text.isascii():
        found = np.frombuffer(text.encode().translate(_ASCII), dtype=np.uint8)
    else:
        if not _all:  # a table of all code points, made once in a worker that needs it
            _all.append(np.fromiter(map(_class_of, range(0x110000)), dtype=np.uint8, count=0x110000))
        found = _all[0][np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
    return np.bincount(found, minlength=CLASSES)


def js_distance(p, q) -> float:
    """Jensen-Shannon distance, base 2; 0 if either histogram is empty."""
    import numpy as np

    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left, right = np.where(p > 0, p * np.log2(p / m), 0.0).sum(), np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(max(0.0, (left + right) / 2) ** 0.5)


def repeated_words(words: list[bytes], size: int = REPEAT_WINDOW) -> int:
    """Words inside windows of `size` words that occur twice or more."""
    import numpy as np

    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.uint64, count=len(words))

    def groups(windows):
        """A number for each window (equal for equal ones) and how often it occurs."""
        _, inverse, times = np.unique(windows, return_inverse=True, return_counts=True)
        return inverse, times

    hashes = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        hashes = (hashes ^ (ids[i : i + n] + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(32)
    if len(np.unique(hashes)) == n:
        return 0
    # Some hashes repeat: settle it exactly, by naming runs of 1, 2, 4, ... words with consecutive numbers.
    names, length = ids.astype(np.int64), 1
    while length < size:
        step = min(length, size - length)
        pairs = names[: len(names) - step] * np.int64(len(words) + 1) + names[step:]
        names, _ = groups(pairs)
        length += step
    inverse, times = groups(names)
    hit = np.nonzero(times[inverse] > 1)[0]
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _measured(text: str) -> tuple[int, int, int, int, int]:
    data = text.encode()
    words = data.split()
    word_chars = len(text) - (len(data) - len(data.translate(None, _SPACE)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated_words(words))


def references(df: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST_LANGS) -> dict[str | None, dict]:
    """The main languages of all_references()."""
    return all_references(df, text_col, lang_col, most)[0]


def all_references(df: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST_LANGS) -> tuple[dict[str | None, dict], DataFrame | None]:
    """(main, further): for each of the `most` languages of most words {"classes": counts, "words": {word: count},
    "total": words} over all rows, None for a null one; the counts (lang, counts) of further languages, if there are any.

    Words are lower-cased (A-Z). Each task counts words in bounded memory and sends its counts on whenever they are
    many, so the sums are exact. At most `most` times (CLASSES + COMMON + 1) numbers come to the driver.
    """
    import pyarrow as pa

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, words, size = {}, {}, 0

        def counted() -> pa.RecordBatch:
            rows = [(lang, word.decode(), n) for lang, own in words.items() for word, n in own.items()]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

        for batch in batches:
            langs = batch.column(1)
            at = 0
            for block in blocks(x.as_py() for x in batch.column(0)):
                for text in block:
                    lang = langs[at].as_py()
                    at += 1
                    classes[lang] = classes.get(lang, 0) + class_counts(text)
                    own = words.setdefault(lang, Counter())
                    cut, before = text.encode().lower().split(), len(own)
                    own.update(cut)
                    own[b"\n"] += len(cut)
                    size += len(own) - before
                if size > COUNTED:
                    yield counted()
                    words, size = {}, 0
        for lang, counts in classes.items():
            words.setdefault(lang, Counter()).update({b"\t%d" % i: int(n) for i, n in enumerate(counts)})
        yield counted()

    counts = df.select(F.coalesce(text_col, F.lit("")).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(summed, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # Classes and totals, CLASSES + 1 rows a language, are ranked apart, so that one bound on the rank takes them all.
    rank = F.row_number().over(Window.partitionBy("lang", F.substring("word", 1, 1).isin("\t", "\n")).orderBy(F.desc("n"), "word"))
    top = counts.withColumn("r", rank).where(F.col("r") <= COMMON).select("lang", "word", "n")
    top = cut(top)
    totals = top.where(F.col("word") == "\n").orderBy(F.desc("n"), "lang").limit(most + 1).collect()
    if len(totals) <= most:
        rows, further = top.collect(), None
    else:
        main = df.sparkSession.createDataFrame([(row["lang"],) for row in totals[:most]], "main string")
        is_main = top["lang"].eqNullSafe(main["main"])
        rows = top.join(F.broadcast(main), is_main, "left_semi").collect()
        further = top.join(F.broadcast(main), is_main, "left_anti").groupBy("lang").agg(F.collect_list(F.struct("word", "n")).alias("counts"))
    by_lang: dict[str | None, list] = {}
    for row in rows:
        by_lang.setdefault(row["lang"], []).append((row["word"], row["n"]))
    return {lang: _reference(counts) for lang, counts in by_lang.items()}, further


def _reference(counts: Iterable[tuple[str, int]]) -> dict:
    """A language's counts, the words from the most frequent on."""
    own: dict = {"classes": [0] * CLASSES, "words": {}, "total": 0}
    for word, n in sorted(counts, key=lambda pair: (-pair[1], pair[0])):
        if word.startswith("\t"):
            own["classes"][int(word[1:])] = n
        elif word == "\n":
            own["total"] = n
        else:
            own["words"][word] = n
    return own


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def _divergence(text: str, n: int, reference: dict) -> tuple[bool, float, float]:
    """(whether a text of n words diverges from a reference, class distance, word distance)."""
    import numpy as np

    of_class = js_distance(class_counts(text).astype(np.float64), reference["class_array"])
    common, shares = reference["index"], reference["shares"]
    hist = np.zeros(len(shares))
    for word, times in Counter(text.encode().lower().split()).items() if n >= LEAST_WORDS else ():
        hist[common.get(word, -1)] += times
    of_words = js_distance(hist, shares)
    few = hist[:-1].sum() * shares.sum() < LEAST_COMMON * n * shares[:-1].sum()
    odd = len(text) >= LEAST_CHARS and of_class > CLASS_LIMIT or n >= LEAST_WORDS and (of_words > WORD_LIMIT or few)
    return bool(odd), of_class, of_words


def verdict(text: str, reference: dict | None, others: tuple[dict, ...] = ()) -> tuple:
    """The values of NAMES for one text; reference, others: indexed ones of its language (or None) and of the main ones."""
    counts = _measured(text)
    n, _, _, _, repeat = counts
    failed = n < FEWEST_WORDS or 100 * repeat > REPEAT_SHARE * n
    if reference is None:
        return (*counts, failed, not failed, 0.0, 0.0)
    odd, of_class, of_words = _divergence(text, n, reference)
    if odd and not failed:
        odd = all(_divergence(text, n, other)[0] for other in others if other is not reference)
    return (*counts, failed, not failed and not odd, of_class, of_words)


def _indexed(reference: dict) -> dict:
    """A language's reference as arrays: class_array, shares (of the common words and, last, of all others), index."""
    import numpy as np

    words = reference["words"]
    return {
        "class_array": np.array(reference["classes"], dtype=np.float64), "index": {w.encode(): i for i, w in enumerate(words)},
        "shares": np.array([*words.values(), max(0, reference["total"] - sum(words.values()))], dtype=np.float64),
    }


def _judged(df: DataFrame, text_col: str, lang_col: str, keep: tuple[str, ...], reference: dict | None, most: int) -> DataFrame:
    """Columns k0, k1, ... for `keep`, then NAMES."""
    import pyarrow as pa

    needed = [*keep, text_col, lang_col]
    rows = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(needed)))
    known, further = (reference, None) if reference is not None else all_references(df, text_col, lang_col, most)
    shared = df.sparkSession.sparkContext.broadcast(known)
    own = rows.schema.fields[: len(keep)]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexed = {lang: _indexed(r) for lang, r in shared.value.items()}
        main = tuple(indexed[lang] for lang in sorted(indexed, key=lambda k: (-shared.value[k]["total"], k is None, k or ""))[:OTHERS])
        for batch in batches:
            texts, langs, *counts = batch.columns[len(keep) :]
            out = []
            for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
                of = indexed.get(lang.as_py()) if not counts else _indexed(_reference((c["word"], c["n"]) for c in counts[0][i].as_py()))
                out.append(verdict(text.as_py() or "", of, main))
            made = [pa.array(values, k) for values, k in zip(zip(*out, strict=True) if out else [[]] * len(NAMES), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[f.name for f in own] + list(NAMES))

    types = [T.LongType()] * 5 + [T.BooleanType()] * 2 + [T.DoubleType()] * 2
    schema = T.StructType([*own, *(T.StructField(n, t) for n, t in zip(NAMES, types, strict=True))])
    if further is None:
        return rows.mapInArrow(work, schema)
    # Texts of the further languages, none of which has many, meet their references by a join.
    further = cut(further.select(F.col("lang").alias("of"), "counts"))
    same = rows[f"k{len(keep) + 1}"].eqNullSafe(further["of"])
    apart = rows.join(further, same).drop("of").mapInArrow(work, schema)
    return rows.join(further.select("of"), same, "left_anti").mapInArrow(work, schema).unionByName(apart)


def judged(df: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ("doc_id",), reference: dict | None = None, most_langs: int = MOST_LANGS) -> DataFrame:
    """Columns `keep`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words long, base_failed, kept boolean,
    class_distance, word_distance double.

    Counts are over the whole text; null counts as empty, which fails the base rule (fewer than 20 words). kept is
    false if the base rule fails, or a distance from the reference of the document's language is over its limit or
    its common words have less than LEAST_COMMON of their share there, and the document is long enough for it, and it
    diverges likewise from each of the OTHERS main languages (so a wrong label alone rejects nothing).
    reference: as references() gives it, by default over df; a language that it lacks is held against none, with
    distances 0. Rows come out as they went in, with repeats and null keys; a null language has a reference of its own.
    A column of `keep` by the name of an output is an error (ValueError); other columns of df do not matter. Of any
    number of languages the `most_langs` (at least OTHERS) of most words are broadcast, the others joined to their texts.
    """
    no_clash(keep, *NAMES)
    found = _judged(df, text_col, lang_col, keep, reference, most_langs)
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *NAMES)


def accept(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of df that judged() keeps, with the columns of df, whatever their names; one pass over texts, no shuffle."""
    found = _judged(df, text_col, lang_col, tuple(df.columns), None, MOST_LANGS).where("kept")
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(df.columns)))
