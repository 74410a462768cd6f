"""Export of recognised pages: which pages, whose version, how their paragraphs join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators.layout import paragraphs


def chosen_pages(pages: DataFrame, single: int | None = None, listed: list[int] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """One page, listed pages, or a range; all without a choice."""
    if single is not None:
        return pages.where(F.col("page") == single)
    if listed is not None:
        return pages.where(F.col("page").isin(*listed))
    out = pages if first is None else pages.where(F.col("page") >= first)
    return out if last is None else out.where(F.col("page") <= last)


def merged_versions(edited: DataFrame, stored: DataFrame, key: str = "page") -> DataFrame:
    """Edited pages win over stored ones; those that are only edited are added. Both: (key, body)."""
    e, s = edited.select(key, F.col("body").alias("e")), stored.select(key, F.col("body").alias("s"))
    return e.join(s, key, "full_outer").select(key, F.coalesce("e", "s").alias("body"))


def export_rows(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, body) -> doc_id, para, text: lines of all pages, paragraphs that go on over a page joined."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("body", "\n")).alias("line", "text")).where(F.length(F.trim("text")) > 0)
    numbered = lines.withColumn("pos", F.expr("row_number() over (partition by doc_id order by page, line)"))
    return paragraphs(numbered.select("doc_id", "page", "pos", "text"))
