"""Mixing sources to target weights.

Each document gets a hash-random key. Within each source the documents are taken in the order of their keys up to the
source's exact budget; budgets over the size of a source repeat it. The order is never computed in one task: keys are
cut into ranges (as many as the table asks for), sizes are summed by range, and prefix sums over ranges of ranges, over
ranges and inside a range add up to each document's place.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut, fresh, no_clash

#: Weights of the sources in their order, repeated; the share of all sizes that is mixed; most repeats of a source.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: About so many documents share a range of keys.
ROWS_A_RANGE = 128


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size (words of the whole text, null: 0), th (a hash of the text), key (hash-random, the same on every run), n.

    Rows that are alike in id, source and text are one row, n times.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")
    # 60 bits of id and text, so that rows that share an id, or have none, are spread.
    key = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text))), 1, 15), 16, 10).cast("long")
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text).alias("th"), key.alias("key"))
    return rows.groupBy("id", "source", "size", "th", "key").agg(F.count("*").alias("n"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, docs, source_size long, weight, target double for each source; sizes: source, size, n.

    Sources stand in the order of their code points, null last, and weigh as `weights`, repeated. They share `share`
    of all sizes by weight; a target stops at `repeats` times its source's size, and the excess is shared again by
    weight until none is above. Solved at once: in the order of cap / weight a source stops if what is left, shared by
    weight from it on, is at least its cap. The windows run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({"budget": F.sum("source_size").over(everything).cast("double") * share, "cap_before": F.coalesce(F.sum("cap").over(rising), F.lit(0.0)), "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0))})
    ranked = ranked.withColumn("stops", (F.col("budget") - F.col("cap_before")) * F.col("weight") >= F.col("cap") * F.col("weight_left"))
    open_ = ranked.withColumns({"capped": F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0.0)).over(everything), "sharing": F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(everything)})
    return open_.select("source", "docs", "source_size", "weight", F.when(F.col("stops"), F.col("cap")).otherwise((F.col("budget") - F.col("capped")) * F.col("weight") / F.col("sharing")).alias("target"))


def placed(sizes: DataFrame, rows: int) -> DataFrame:
    """sizes (id, source, size, th, key, n), each n times, with `before`: the sizes of its source's documents of smaller (key, id)."""
    bits = max(2, ceil(log2(max(1, rows / ROWS_A_RANGE))))
    low = bits // 2
    fine = F.shiftright("key", 60 - bits)
    ranged = sizes.withColumn("fine", fine).withColumn("coarse", F.shiftrightunsigned("fine", low))
    prior = (Window.unboundedPreceding, -1)
    sums = ranged.groupBy("source", "coarse", "fine").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    inner = sums.withColumn("inner", F.coalesce(F.sum("words").over(Window.partitionBy("source", "coarse").orderBy("fine").rowsBetween(*prior)), F.lit(0)))
    outer = sums.groupBy("source", "coarse").agg(F.sum("words").alias("words"))
    outer = outer.select(F.col("source").alias("s2"), F.col("coarse").alias("c2"), F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("coarse").rowsBetween(*prior)), F.lit(0)).alias("outer"))
    starts = inner.join(outer, F.col("source").eqNullSafe(F.col("s2")) & (F.col("coarse") == F.col("c2"))).select(F.col("source").alias("s3"), F.col("fine").alias("f3"), (F.col("inner") + F.col("outer")).alias("start"))
    within = Window.partitionBy("source", "fine").orderBy("key", "id", "size").rowsBetween(*prior)
    own = ranged.withColumn("own", F.coalesce(F.sum(F.col("size") * F.col("n")).over(within), F.lit(0)))
    placed = own.join(starts, F.col("source").eqNullSafe(F.col("s3")) & (F.col("fine") == F.col("f3"))).select("id", "source", "size", "th", "key", "n", (F.col("own") + F.col("start")).alias("first"))
    copies = placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return copies.select("id", "source", "size", "th", "key", (F.col("first") + F.col("nth") * F.col("size")).alias("before"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """For each row of df: id_col, source_col, size, source_size long, target double, taken long.

    taken counts the words that the mix takes from a document, repeats included: the whole epochs that fit into the
    source's target, and one more up to the exact (rounded down) budget in the order of the keys, so that the source
    takes just its target; the document at the cut gives a part. Null texts have size 0 and take 0; null sources are
    one source; repeated rows are documents of their own. Further columns of df, whatever their names, do not matter;
    id_col or source_col by the name of an output is an error (ValueError).
    """
    no_clash([id_col, source_col], "size", "source_size", "target", "taken")
    taken = _taken(df, id_col, text_col, source_col, weights, share, repeats)
    return taken.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken")


def _taken(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """id, source, th, size, source_size, target, taken of each row."""
    sizes = cut(sized(df, id_col, text_col, source_col))
    per = targets(sizes, weights, share, repeats).select(F.col("source").alias("s"), "source_size", "target")
    rows = placed(sizes, sizes.count())
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target")) - epochs * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))
    return rows.join(per, F.col("source").eqNullSafe(F.col("s"))).select("id", "source", "th", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The documents of the mix with the columns of df: each row as often as the mix takes it, 0 to `repeats` times.

    A document of which the last epoch takes half or more is taken whole, one of less is not; documents without words
    are not taken. Rows of df that are alike in id, source and text take the same number of copies, the rounded mean of
    theirs. All columns of df stay, whatever their names.
    """
    i, s, h, times, copy = fresh(df, "id", "source", "th", "times", "copy")
    taken = _taken(df, id_col, text_col, source_col, weights, share, repeats).where("size > 0")
    chosen = taken.groupBy(F.col("id").alias(i), F.col("source").alias(s), F.col("th").alias(h)).agg(F.floor(F.avg(F.floor(F.col("taken") / F.col("size") + 0.5)) + 0.5).cast("int").alias(times)).where(F.col(times) > 0)
    same = df[id_col].eqNullSafe(chosen[i]) & df[source_col].eqNullSafe(chosen[s]) & (F.xxhash64(F.coalesce(df[text_col], F.lit(""))) == chosen[h])
    return df.join(chosen, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*df.columns)
