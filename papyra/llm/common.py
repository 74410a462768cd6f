"""Helpers shared by the corpus operators: staging folder, document reading, bounded caches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that one Arrow batch carries to a Python worker: texts may be long, and a worker holds a batch several times over.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


#: A table of fewer bytes may lie in one row group, which would be one task's work; it is dealt over all cores first.
SMALL_TABLE = 64 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(spark.sparkContext.defaultParallelism) if size < SMALL_TABLE else df


#: Characters of a text whose words are held at once, as objects many times the size of the text.
PIECE = 1 << 22
_SPACE = re.compile(r"[ \t\n\r\f\v]")


def pieces(text: str, size: int | None = None) -> Iterator[str]:
    """A text in slices of about `size` characters (PIECE) that end before a white space, so that no word is cut."""
    at, size = 0, size or PIECE
    while len(text) - at > size and (end := _SPACE.search(text, at + size)):
        yield text[at : end.start()]
        at = end.start()
    yield text[at:]


def staging_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a folder of our own only where none is named."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="papyra-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: a cut of the lineage that survives lost executors,
    and rows whose order-dependent columns (row ids, partition ids) can no longer change on a retry."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{staging_root(spark)}/papyra/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders written by `staged` and not removed since, oldest first.
_WRITTEN: list[str] = []


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the intermediate tables written inside it: for a caller who by then has written what reads them."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        gone, _WRITTEN[before:] = _WRITTEN[before:], []
        for path in gone:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_staging(spark: SparkSession) -> None:
    """Removes all written intermediate tables; call it when no result that reads them is needed any more."""
    _WRITTEN.clear()
    remove(spark, f"{staging_root(spark)}/papyra")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have (case-insensitively), one for each wanted name."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def partitions_for(rows: int, per_partition: int, most: int = 4096) -> int:
    return max(1, min(most, -(-rows // per_partition)))


def ascii_digits_crc(column: str):
    """crc32 of an integer id written as decimal text (the split rule of the labelled rows)."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
