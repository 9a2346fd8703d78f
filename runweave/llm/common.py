"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Code points of ASCII white space; a word is a run of anything else.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: About so many characters of text are worked on together inside a task.
BLOCK_CHARS = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master only, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='runweave-')}"
        spark.conf.set("spark.checkpoint.dir", folder) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    Cuts the lineage at a place that survives the loss of executors, and makes sure that costly columns are
    computed once. The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/runweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def blocks(texts: Iterable[str | None], chars: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """Texts in order, in lists of about `chars` characters; null becomes the empty text."""
    block: list[str] = []
    size = 0
    for text in texts:
        block.append(text or "")
        size += len(block[-1])
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def column_blocks(batch, name: str) -> Iterator[tuple[int, list[str]]]:
    """(offset, texts) over one column of an Arrow batch, never holding more than a block of texts as Python strings."""
    column = batch.column(batch.schema.get_field_index(name))
    start = 0
    for block in blocks(value.as_py() for value in column):
        yield start, block
        start += len(block)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of df, whatever its case rules."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def no_clash(columns: Iterable[str], *outputs: str) -> None:
    """ValueError if one of the names of `columns` is, whatever its case, that of an output column."""
    taken = {c.lower() for c in columns}
    if clash := [name for name in outputs if name.lower() in taken]:
        raise ValueError(f"columns that an operator adds are there already: {', '.join(clash)}")
