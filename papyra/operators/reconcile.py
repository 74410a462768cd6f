"""Matching records to regions, creations with name rules, path migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconciled(records: DataFrame, regions: DataFrame) -> DataFrame:
    """records (doc_id, rec, title, rid), regions (doc_id, reg, title) -> doc_id, rec, reg, how: by the region id a record
    names, then by titles that are unique among what is left on both sides."""
    by_id = records.where("rid is not null").join(regions.select("doc_id", "reg"), (records["doc_id"] == regions["doc_id"]) & (F.col("rid") == F.col("reg"))).select(records["doc_id"], "rec", "reg", F.lit("id").alias("how"))
    left = records.join(by_id.select("doc_id", "rec"), ["doc_id", "rec"], "left_anti").groupBy("doc_id", "title").agg(F.min("rec").alias("rec"), F.count("*").alias("n")).where("n = 1")
    free = regions.join(by_id.select("doc_id", "reg"), ["doc_id", "reg"], "left_anti").groupBy("doc_id", "title").agg(F.min("reg").alias("reg"), F.count("*").alias("m")).where("m = 1")
    return by_id.union(left.join(free, ["doc_id", "title"]).select("doc_id", "rec", "reg", F.lit("title")))


def creations(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (name) -> name, result: blank, taken (whatever the case) or created."""
    taken = named.select(F.lower("name").alias("k")).distinct().withColumn("hit", F.lit(True))
    j = wanted.withColumn("k", F.lower(F.trim("name"))).join(taken, "k", "left")
    return j.select("name", F.when(F.coalesce(F.length("k"), F.lit(0)) == 0, "blank").when(F.col("hit"), "taken").otherwise("created").alias("result"))


def migrated(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Absolute paths made relative: new value and whether it changed (a dry run counts these)."""
    new = F.regexp_replace(column, prefix, "")
    return rows.withColumn("new", new).withColumn("changed", F.col("new") != F.col(column))
