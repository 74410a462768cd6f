"""Recognised pages: batches of page folders, JSON of several envelopes, layout XML, dictionaries, page sinks, import guard."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RECT = "x: int, y: int, w: int, h: int"
LINE = f"struct<{_RECT}, text: string, is_vertical: boolean, confidence: double, class_index: int, type: string>"
REGION = f"struct<id: string, name: string, type: string, {_RECT}, text: string, reading_order: int, orientation: string>"
PAGE = f"page_number int, filename string, regions array<{REGION}>, ocr_lines array<{LINE}>, headings array<struct<id: string, title: string, level: int, {_RECT}>>, footnotes array<struct<id: string, text: string>>, figures array<struct<id: string, path: string, caption: string>>, body_text string, image_width int, image_height int"


def read_batches(spark: SparkSession, root: str) -> DataFrame:
    """All pages of all batches (root/batch/page_N/page_data.json): batch, page, the page's fields, path. The page number
    falls back to the folder's."""
    rows = spark.read.schema(PAGE).option("multiLine", "true").option("pathGlobFilter", "page_data.json").option("recursiveFileLookup", "true").json(root).withColumn("path", F.col("_metadata.file_path"))
    folder = F.regexp_extract("path", r"/page_?0*(\d+)/[^/]*$", 1)
    return rows.withColumn("batch", F.regexp_extract("path", r"/([^/]+)/[^/]+/[^/]*$", 1)).withColumn("page", F.coalesce("page_number", F.nullif(folder, F.lit("")).cast("int")))


def batch_list(pages: DataFrame, modified: DataFrame) -> DataFrame:
    """batch, pages (count), newest first. modified: (batch, mtime) of page files."""
    n = pages.groupBy("batch").agg(F.count_distinct("page").alias("pages"))
    t = modified.groupBy("batch").agg(F.max("mtime").alias("mtime"), F.count("*").alias("files"))
    return t.join(n, "batch", "left").select("batch", F.greatest("files", F.coalesce("pages", F.lit(0))).alias("pages"), "mtime").orderBy(F.desc("mtime"), "batch")


def page_lines(pages: DataFrame) -> DataFrame:
    """batch, page, pos and the fields of each recognised line."""
    return pages.select("batch", "page", F.posexplode("ocr_lines").alias("pos", "l")).select("batch", "page", "pos", "l.*")


def page_figures(pages: DataFrame, first: int = 1, last: int = 1 << 30) -> DataFrame:
    return pages.where(F.col("page").between(first, last)).select("batch", "page", F.posexplode("figures").alias("pos", "f")).select("batch", "page", "pos", "f.*")


def footnote_catalogue(pages: DataFrame) -> DataFrame:
    """batch, page, note_id, text: ids are kept, missing ones are made from page and place."""
    n = pages.select("batch", "page", F.posexplode("footnotes").alias("pos", "n"))
    made = F.concat(F.lit("note-"), F.col("page").cast("string"), F.lit("-"), (F.col("pos") + 1).cast("string"))
    return n.select("batch", "page", F.coalesce(F.nullif(F.trim("n.id"), F.lit("")), made).alias("note_id"), "n.text")


def write_pages(pages: DataFrame, path: str) -> None:
    """One folder for each batch and page, holding its JSON."""
    pages.write.partitionBy("batch", "page").mode("overwrite").json(path)


_BOX = "struct<x: double, y: double, w: double, h: double, width: double, height: double, boundingBox: array<array<double>>, bbox: array<double>, text: string, confidence: double, isVertical: string>"


def recognised_lines(json_text: Column) -> Column:
    """Lines of a recogniser's JSON, whatever its envelope: {contents: [[..]]}, [..], {results|blocks|ocr: [..]} or one line
    -> array<struct<x, y, w, h, text, confidence>>."""
    obj = F.from_json(json_text, f"contents array<array<{_BOX}>>, results array<{_BOX}>, blocks array<{_BOX}>, ocr array<{_BOX}>")
    listed = F.from_json(json_text, f"array<{_BOX}>")
    one = F.from_json(json_text, _BOX)
    nested = F.flatten(obj["contents"])
    is_list = F.trim(json_text).startswith("[")
    lines = F.when(is_list, listed).otherwise(F.coalesce(nested, obj["results"], obj["blocks"], obj["ocr"], F.array(one)))

    def rect(b: Column) -> Column:
        xs, ys = F.transform(b["boundingBox"], lambda p: p[0]), F.transform(b["boundingBox"], lambda p: p[1])
        x = F.coalesce(b["x"], F.array_min(xs), F.get(b["bbox"], F.lit(0)))
        y = F.coalesce(b["y"], F.array_min(ys), F.get(b["bbox"], F.lit(1)))
        w = F.coalesce(b["w"], b["width"], F.array_max(xs) - F.array_min(xs), F.get(b["bbox"], F.lit(2)) - x)
        h = F.coalesce(b["h"], b["height"], F.array_max(ys) - F.array_min(ys), F.get(b["bbox"], F.lit(3)) - y)
        return F.struct(*[v.cast("int").alias(n) for v, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))], b["text"].alias("text"), F.coalesce(b["confidence"], F.lit(1.0)).alias("confidence"))

    return F.transform(F.filter(lines, lambda b: b["text"].isNotNull()), rect)


def read_layout_xml(spark: SparkSession, path: str) -> DataFrame:
    """PAGE elements with LINE elements (attributes X, Y, WIDTH, HEIGHT, STRING, ORDER) -> page, pos, x, y, w, h, text."""
    schema = "_IMAGENAME string, LINE array<struct<_X: int, _Y: int, _WIDTH: int, _HEIGHT: int, _STRING: string, _ORDER: int>>"
    rows = spark.read.format("xml").option("rowTag", "PAGE").schema(schema).load(path)
    lines = rows.select(F.col("_IMAGENAME").alias("page"), F.posexplode("LINE").alias("pos", "l"))
    return lines.select("page", F.coalesce("l._ORDER", "pos").alias("pos"), F.col("l._X").alias("x"), F.col("l._Y").alias("y"), F.col("l._WIDTH").alias("w"), F.col("l._HEIGHT").alias("h"), F.col("l._STRING").alias("text"))


def dictionary_rules(text: str) -> list[dict]:
    """Rules of a user dictionary: {rules: [..]}, or {exact: {a: b}, regex: {a: b}}; inactive and empty ones are dropped,
    the longest come first."""
    data = json.loads(text) if text.strip() else {}
    rules = list(data.get("rules", [])) if isinstance(data, dict) else list(data)
    if isinstance(data, dict):
        rules += [{"pattern": a, "replacement": b, "type": k} for k in ("exact", "regex") for a, b in (data.get(k) or {}).items()]
    rules = [{"type": "exact", "active": True, "replacement": "", **r} for r in rules if r.get("pattern")]
    return sorted((r for r in rules if r["active"]), key=lambda r: -len(r["pattern"]))


#: File kinds that may be imported, with their first bytes.
KINDS = {"docx": b"PK\x03\x04", "odt": b"PK\x03\x04", "pdf": b"%PDF-", "md": b"", "txt": b"", "html": b""}


def guarded(files: DataFrame, most_bytes: int = 50 << 20) -> DataFrame:
    """files (path, content, length) -> path, fault (null: may be imported): kind, size, first bytes, archive limits."""
    from papyra.sources.archives import zip_fault

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content, n in zip(pdf["path"], pdf["content"], pdf["length"], strict=True):
                kind = path.rsplit(".", 1)[-1].lower()
                fault = "kind" if kind not in KINDS else "size" if n > most_bytes else "first bytes" if not bytes(content[:8]).startswith(KINDS[kind]) else None
                out.append(fault or (zip_fault(bytes(content)) if kind in ("docx", "odt") else None))
            yield pd.DataFrame({"path": pdf["path"], "fault": out})

    return files.select("path", "content", "length").mapInPandas(check, "path string, fault string")
