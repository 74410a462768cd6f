"""Writes and state, as result sets: what a table holds after a change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with the same key."""
    return old.join(new, key, "left_anti").unionByName(new)


def inserted_or_ignored(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def cascade(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return children.join(gone, key, "left_anti")


def latest(versions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last version of each key; no window, so hot keys are combined before the shuffle."""
    rest = [c for c in versions.columns if c != key and c not in order]
    m = versions.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("m"))
    return m.select(key, *[F.col(f"m.{c}").alias(c) for c in (*order, *rest)])


def assigned(docs: DataFrame, tags: list[str], existing: DataFrame) -> DataFrame:
    """The pairs that an assignment of all tags to all docs adds."""
    pairs = docs.select("doc_id", F.explode(F.array(*[F.lit(t) for t in tags])).alias("tag_id"))
    return pairs.join(existing, ["doc_id", "tag_id"], "left_anti")


def name_conflicts(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted names (name) that are taken, whatever their case."""
    taken = named.select(F.lower("name").alias("k"))
    return wanted.join(taken, F.lower(wanted["name"]) == F.col("k"), "left_semi")


def changed_state(rows: DataFrame, allowed: list[str], to: str) -> DataFrame:
    """The new state where the current one is among the allowed."""
    return rows.withColumn("state", F.when(F.col("state").isin(*allowed), to).otherwise(F.col("state")))


def rollup_state(jobs: DataFrame, key: str) -> DataFrame:
    """Ready, building, failed counts and one state by precedence: ready (all), building, error, paused, missing."""
    s = F.col("state")
    a = jobs.groupBy(key).agg(F.count("*").alias("total"), F.count_if(s == "ready").alias("ready"), F.count_if(s == "building").alias("building"), F.count_if(s == "error").alias("failed"), F.count_if(s == "paused").alias("paused"))
    overall = F.when(F.col("ready") == F.col("total"), "ready").when(F.col("building") > 0, "building").when(F.col("failed") > 0, "error").when(F.col("paused") > 0, "paused").otherwise("missing")
    return a.withColumn("overall", overall)


def admissions(jobs: DataFrame, active: list[str], per_key: int = 1, overall: int = 3, key: str = "doc_id", order: str = "event_id") -> DataFrame:
    """Waiting jobs that may start: at most per_key of a key, and the first `overall` of these."""
    waiting = jobs.where(F.col("state").isin(*active))
    mine = waiting.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("r") <= per_key).drop("r")
    return mine.orderBy(order).limit(overall)


def violations(rows: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Rows that break an enumeration: (column, value, n)."""
    out = None
    for c, values in allowed.items():
        bad = rows.where(F.col(c).isNull() | ~F.col(c).isin(*values)).groupBy(F.lit(c).alias("column"), F.col(c).alias("value")).agg(F.count("*").alias("n"))
        out = bad if out is None else out.unionByName(bad)
    return out
