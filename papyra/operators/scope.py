"""Scopes: which documents a request covers, as composable predicates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SORTABLE = {"doc_id", "source", "lang", "n_chars"}


def tagged(docs: DataFrame, document_tags: DataFrame, tags: list[str], every: bool) -> DataFrame:
    """Documents with every tag (relational division) or with any of them."""
    hit = document_tags.where(F.col("tag_id").isin(*tags)).select("doc_id", "tag_id").distinct()
    if every:
        hit = hit.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(set(tags)))
    return docs.join(hit.select("doc_id").distinct(), "doc_id", "left_semi")


def in_group(docs: DataFrame, document_tags: DataFrame, tags: DataFrame, group: str) -> DataFrame:
    members = document_tags.join(tags.where(F.col("group_id") == group), "tag_id", "left_semi")
    return docs.join(members, "doc_id", "left_semi")


def untagged(docs: DataFrame, document_tags: DataFrame) -> DataFrame:
    return docs.join(document_tags, "doc_id", "left_anti")


def scoped(docs: DataFrame, document_tags: DataFrame, tags: DataFrame, unassigned: bool = False, tag: str | None = None, all_of: list[str] | None = None, any_of: list[str] | None = None, group: str | None = None) -> DataFrame:
    """The first condition that is given holds alone: unassigned, one tag, all of, any of, group; without one, all."""
    if unassigned:
        return untagged(docs, document_tags)
    if tag:
        return tagged(docs, document_tags, [tag], False)
    if all_of:
        return tagged(docs, document_tags, all_of, True)
    if any_of:
        return tagged(docs, document_tags, any_of, False)
    return in_group(docs, document_tags, tags, group) if group else docs


def sorted_page(docs: DataFrame, column: str, descending: bool = False, limit: int = 0, offset: int = 0, key: str = "doc_id") -> DataFrame:
    """Order by a listed column, then by key; a limit of 0 means all rows."""
    if column not in SORTABLE:
        column = key
    c = F.col(column)
    out = docs.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_first(), key)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit > 0 else out


def clamped(limit: int, least: int = 1, most: int = 200) -> int:
    return max(least, min(most, limit))


def scope_violations(tags: DataFrame, tag_groups: DataFrame, groups: list[str], chosen: list[str]) -> DataFrame:
    """(kind, id): chosen groups that do not exist and chosen tags of no chosen group."""
    spark = tags.sparkSession
    asked_g = spark.createDataFrame([(g,) for g in groups], "id string")
    asked_t = spark.createDataFrame([(t,) for t in chosen], "id string")
    no_group = asked_g.join(tag_groups, asked_g["id"] == tag_groups["group_id"], "left_anti").select(F.lit("group").alias("kind"), "id")
    inside = tags.where(F.col("group_id").isin(*groups))
    no_tag = asked_t.join(inside, asked_t["id"] == inside["tag_id"], "left_anti").select(F.lit("tag").alias("kind"), "id")
    return no_group.union(no_tag)
