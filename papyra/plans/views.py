"""The document model derived from the driver tables: lines of text as blocks, short lines as headings, and so on."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.text import non_blank

_SQL = {
    "blocks": "select doc_id, cast(pos as integer) as pos, line as text from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents) where length(trim(line)) > 0",
    "tags": "select distinct source as tag_id, case when source in ('src0','src1','src2','src3','src4') then 'g0' when source in ('src5','src6','src7') then 'g1' when source in ('src8','src9') then 'g2' else null end as group_id from documents union all select 'good' as tag_id, 'g2' as group_id",
    "document_tags": "select doc_id, source as tag_id from documents where doc_id % 7 <> 0 union all select doc_id, 'good' as tag_id from labels where quality = 1",
    "tag_groups": "select 'g0' as group_id, 'news' as name, 0 as order_idx union all select 'g1', 'web', 1 union all select 'g2', 'curated', 2 union all select 'g3', 'unused', 3",
    "headings": "select doc_id, pos, text, cast(1 + pos % 3 as integer) as level from blocks where length(text) < 40",
    "lines": "select doc_id, pos, cast(floor(pos / 40.0) as integer) as page, cast((pos % 2) * 500 + doc_id % 37 as integer) as x, cast((pos % 40) * 24 as integer) as y, cast(least(480, 8 * length(text)) as integer) as w, 20 as h, text from blocks",
    "cells": "select p.doc_id, p.page, r.r as row_no, c.c as col_no, c.c * 500 as x, r.r * 240 as y, 500 as w, 240 as h from (select distinct doc_id, page from lines) p cross join (select 0 as r union all select 1 union all select 2 union all select 3) r cross join (select 0 as c union all select 1) c",
    "chunks": "select vec_id as chunk_id, label as doc_id, case when label % 2 = 0 then 'en' else 'ja' end as lane, embedding as vector from embeddings",
    "jobs": "select event_id, user_id as doc_id, ts, case event_type when 'view' then 'queued' when 'click' then 'building' when 'purchase' then 'ready' when 'signup' then 'paused' else 'error' end as state from events",
}
_NEEDS = {"headings": ("blocks",), "lines": ("blocks",), "cells": ("blocks", "lines")}


def with_views(names: str, sql: str) -> str:
    """DuckDB SQL with the named views (and those they need) as common table expressions."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in (*_NEEDS.get(n, ()), n) if x not in order]
    head = ", ".join(f"{n} as ({_SQL[n]})" for n in order)
    body = sql.strip()
    if not order:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {head}, {body[15:]}"
    return f"with {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}"


class Views:
    """Driver tables and derived tables of one folder, each made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, table: str) -> DataFrame:
        if table.startswith("_"):
            raise AttributeError(table)
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    @cached_property
    def blocks(self) -> DataFrame:
        return self.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(non_blank(F.col("text")))

    @cached_property
    def tags(self) -> DataFrame:
        source = F.col("source")
        group = F.when(source.isin(*[f"src{i}" for i in range(5)]), "g0").when(source.isin("src5", "src6", "src7"), "g1").when(source.isin("src8", "src9"), "g2")
        return self.documents.select(source.alias("tag_id"), group.alias("group_id")).distinct().union(self.spark.sql("select 'good' as tag_id, 'g2' as group_id"))

    @cached_property
    def document_tags(self) -> DataFrame:
        return self.documents.where("doc_id % 7 <> 0").select("doc_id", F.col("source").alias("tag_id")).union(self.labels.where("quality = 1").select("doc_id", F.lit("good")))

    @cached_property
    def tag_groups(self) -> DataFrame:
        return self.spark.sql("select * from values ('g0','news',0), ('g1','web',1), ('g2','curated',2), ('g3','unused',3) as t(group_id, name, order_idx)")

    @cached_property
    def headings(self) -> DataFrame:
        return self.blocks.where(F.length("text") < 40).select("doc_id", "pos", "text", (1 + F.col("pos") % 3).cast("int").alias("level"))

    @cached_property
    def lines(self) -> DataFrame:
        return self.blocks.select(
            "doc_id", "pos", F.floor(F.col("pos") / 40).cast("int").alias("page"), (F.col("pos") % 2 * 500 + F.col("doc_id") % 37).cast("int").alias("x"),
            (F.col("pos") % 40 * 24).cast("int").alias("y"), F.least(F.lit(480), 8 * F.length("text")).cast("int").alias("w"), F.lit(20).alias("h"), "text",
        )

    @cached_property
    def cells(self) -> DataFrame:
        grid = F.explode(F.expr("flatten(transform(sequence(0, 3), r -> transform(sequence(0, 1), c -> struct(r, c))))")).alias("g")
        return self.lines.select("doc_id", "page").distinct().select("doc_id", "page", grid).selectExpr("doc_id", "page", "g.r as row_no", "g.c as col_no", "g.c * 500 as x", "g.r * 240 as y", "500 as w", "240 as h")

    @cached_property
    def chunks(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), F.when(F.col("label") % 2 == 0, "en").otherwise("ja").alias("lane"), F.col("embedding").alias("vector"))

    @cached_property
    def jobs(self) -> DataFrame:
        kind = F.col("event_type")
        state = F.when(kind == "view", "queued").when(kind == "click", "building").when(kind == "purchase", "ready").when(kind == "signup", "paused").otherwise("error")
        return self.events.select("event_id", F.col("user_id").alias("doc_id"), "ts", state.alias("state"))
