"""Text sinks: Markdown and HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import html_escaped


def markdown_lines(blocks: DataFrame, headings: DataFrame) -> DataFrame:
    """doc_id, pos, md: headings get their marks."""
    h = headings.select("doc_id", "pos", "level")
    md = F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.trim("text"))).otherwise(F.trim("text"))
    return blocks.join(h, ["doc_id", "pos"], "left").select("doc_id", "pos", md.alias("md"))


def documents_of(lines: DataFrame, column: str, glue: str = "\n\n") -> DataFrame:
    """One text for each document from its lines in order."""
    rows = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", column))).alias("r"))
    return rows.select("doc_id", F.array_join(F.transform("r", lambda x: x[column]), glue).alias(column))


def html_lines(blocks: DataFrame, headings: DataFrame) -> DataFrame:
    """doc_id, pos, html: h1 to h6 or p, escaped."""
    h = headings.select("doc_id", "pos", "level")
    tag = F.when(F.col("level").isNotNull(), F.concat(F.lit("h"), F.least(F.lit(6), F.col("level")))).otherwise(F.lit("p"))
    return blocks.join(h, ["doc_id", "pos"], "left").select("doc_id", "pos", F.concat(F.lit("<"), tag, F.lit(">"), html_escaped(F.trim("text")), F.lit("</"), tag, F.lit(">")).alias("html"))


def write_markdown(blocks: DataFrame, headings: DataFrame, path: str) -> None:
    documents_of(markdown_lines(blocks, headings), "md").select("doc_id", F.col("md").alias("value")).write.partitionBy("doc_id").text(path)
