"""Tables of the engine as views over the given Parquet tables, and written cuts of a plan."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event types of the given table by the activity type that they stand for (fixed values).
TYPES = {"signup": "conversation-start", "view": "api-request", "click": "tool-call", "purchase": "conversation-end", "error": "tool-result"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view in SQL that Spark and DuckDB both run: {name} stands for a given table."""
    names = {name for _, name, _, _ in string.Formatter().parse(sql) if name}
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in names})


def tasks(spark: SparkSession) -> int:
    """Into how many tasks work that is heavy for its bytes is dealt; the number stays as it is whatever the bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over tasks(): rows of small files, of which few tasks would do all that is made of them."""
    return df.repartition(tasks(df.sparkSession), *keys)


def shuffled(df: DataFrame) -> DataFrame:
    """df to be joined by a shuffle: Spark guesses sizes from those of compressed files, and what it broadcasts passes through the driver."""
    return df.hint("merge")


def spread_parts(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view in SQL over the parts alone, which are dealt first, so that its texts are made where they are used."""
    return spark.sql(sql, part=spread(table(spark, sf_dir, "part"), "p_partkey"))


def plain(sql: str) -> str:
    """The same view as DuckDB reads it, over tables of their own names."""
    return sql.format(**{name: name for _, name, _, _ in string.Formatter().parse(sql) if name})


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, agent_id, run_id, type, k int (a counter or fingerprint), cents long."""
    return activity_of(table(spark, sf_dir, "events"))


def activity_of(events: DataFrame) -> DataFrame:
    """The activity log that `events`, a table or a stream, stands for."""
    kind = F.lit(None).cast("string")
    for given, stands_for in TYPES.items():
        kind = F.when(F.col("event_type") == given, stands_for).otherwise(kind)
    return events.select(
        "event_id", "ts", F.col("user_id").alias("agent_id"), (F.col("user_id") % 20).alias("run_id"), kind.alias("type"),
        F.regexp_extract("props", r"(\d+)", 1).try_cast("int").alias("k"), F.round(F.col("value") * 100).cast("long").alias("cents"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, session_id, pos long, role, content."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent_session_id (null for roots)."""
    parent = F.when((F.col("conv_id") % 3 == 0) & (F.col("conv_id") > 0), F.expr("conv_id div 2"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), parent.alias("parent_session_id")).distinct()


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, status of a dependency graph."""
    names = F.array(*[F.lit(s) for s in ("proved", "stated", "proved", "audited", "false")])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(names, (F.col("p_size") % 5 + 1).cast("int")).alias("status"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src depends on dst; acyclic."""
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    made = ids.select("src", F.explode(F.array(F.expr("src div 2"), F.expr("src div 3"))).alias("dst"))
    return made.where("dst >= 1 and dst < src").distinct()


def item_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, ordinal, chapter, concept: the distinct lower-case words of an item's title and kind."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), r"\s+"), lambda w: w != ""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("label"), F.col("p_partkey").alias("ordinal"), F.col("p_brand").alias("chapter"), F.explode(words).alias("concept"))


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet into the folder that driver and executors share, and read again.

    It ends the lineage of iterative plans at a place that outlives executors; the files go with the session.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder name in the folder that driver and executors share; what is put there goes with the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='runweave-')}"
    path = f"{folder.rstrip('/')}/runweave-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(place.getParent())
    system.deleteOnExit(place)
    return path
