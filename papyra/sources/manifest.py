"""Backup manifests: (path, size, sha256) rows, read from files, compared and validated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Manifest rows of all files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/") + "/")
    path = F.substring(F.regexp_replace("path", "^file:/+", "/"), F.length(base) + 1, F.lit(1 << 20))
    return files.select(path.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def faults(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """path, fault: missing, extra or changed."""
    m = manifest.select("path", F.col("size").alias("ms"), F.col("sha256").alias("mh"))
    d = found.select("path", F.col("size").alias("ds"), F.col("sha256").alias("dh"))
    fault = F.when(F.col("dh").isNull(), "missing").when(F.col("mh").isNull(), "extra").when((F.col("ms") != F.col("ds")) | (F.col("mh") != F.col("dh")), "changed")
    return m.join(d, "path", "full_outer").select("path", fault.alias("fault")).where("fault is not null")


def invalid(manifest: DataFrame) -> DataFrame:
    """path, fault: unsafe paths, paths that are equal but for case, hashes that are none."""
    n = manifest.groupBy(F.lower("path").alias("lp")).agg(F.count("*").alias("n"))
    unsafe = F.col("path").startswith("/") | F.contains("path", F.lit(".."))
    fault = F.when(unsafe, "unsafe").when(F.col("n") > 1, "duplicate").when(~F.col("sha256").rlike("^[0-9a-f]{64}$"), "hash")
    return manifest.join(n, F.lower("path") == F.col("lp")).select("path", fault.alias("fault")).where("fault is not null")
