"""Geometry over rows of rectangles, page by page. The page is the equi-join key of every rectangle join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.geometry import centre_in, overlap_1d, overlap_area

PAGE = ("doc_id", "page")


def on_page(a: str, b: str, keys: Sequence[str] = PAGE):
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"{a}{k}") == F.col(f"{b}{k}"))
    return cond


def lines_in_cells(lines: DataFrame, cells: DataFrame, margin: int = 0, keys: Sequence[str] = PAGE) -> DataFrame:
    """(page keys, pos, row_no, col_no): lines whose centre lies in a cell; a line on a border is in both cells."""
    return lines.alias("l").join(cells.alias("c"), on_page("l.", "c.", keys) & centre_in("l.", "c.", margin)).select(*[F.col(f"l.{k}") for k in keys], "l.pos", "c.row_no", "c.col_no")


def lines_outside(lines: DataFrame, regions: DataFrame, margin: int = 0, keys: Sequence[str] = PAGE) -> DataFrame:
    return lines.alias("l").join(regions.alias("c"), on_page("l.", "c.", keys) & centre_in("l.", "c.", margin), "left_anti")


def overlapping(blocks: DataFrame, regions: DataFrame, share: float = 0.15, keys: Sequence[str] = PAGE) -> DataFrame:
    """Pairs whose common area is over a share of either one's area."""
    both = overlap_area("l.", "c.")
    area_l, area_c = F.col("l.w") * F.col("l.h"), F.col("c.w") * F.col("c.h")
    return blocks.alias("l").join(regions.alias("c"), on_page("l.", "c.", keys) & ((both > share * area_l) | (both > share * area_c)))


def nearest_above(tables: DataFrame, captions: DataFrame, reach: int = 40, share: float = 0.3, keys: Sequence[str] = PAGE) -> DataFrame:
    """For each table the caption line that ends at most `reach` above it and shares `share` of its width; the smallest gap,
    then the leftmost, then the first wins."""
    gap = F.col("t.y") - (F.col("c.y") + F.col("c.h"))
    shared = overlap_1d(F.col("t.x"), F.col("t.x") + F.col("t.w"), F.col("c.x"), F.col("c.x") + F.col("c.w"))
    pairs = tables.alias("t").join(captions.alias("c"), on_page("t.", "c.", keys) & gap.between(0, reach) & (shared >= share * F.least(F.col("t.w"), F.col("c.w"))))
    best = pairs.groupBy(*[F.col(f"t.{k}").alias(k) for k in keys], F.col("t.row_no").alias("row_no"), F.col("t.col_no").alias("col_no")).agg(F.min(F.struct(gap.alias("gap"), F.col("c.x").alias("cx"), F.col("c.pos").alias("pos"))).alias("best"))
    return best.select(*keys, "row_no", "col_no", F.col("best.pos").alias("pos"), F.col("best.gap").alias("gap"))


def gap_groups(rows: DataFrame, value: str, gap: float, keys: Sequence[str] = PAGE, order: Sequence[str] = (), name: str = "grp") -> DataFrame:
    """Groups of sorted values; a new one starts where the step from the previous row is over `gap`."""
    w = Window.partitionBy(*keys).orderBy(value, *order)
    step = F.col(value) - F.lag(value).over(w)
    return rows.withColumn(name, F.sum(F.when(step > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def running_mean_clusters(rows: DataFrame, value: str, tolerance: float, keys: Sequence[str] = PAGE) -> DataFrame:
    """Sorted values of each key join the open cluster while within the tolerance of its mean, else open the next one:
    a fold over the sorted distinct-or-not values of one page. -> keys, cluster, mean, members."""
    start = F.expr("cast(array() as array<struct<total: double, n: int>>)")
    v = lambda x: x.cast("double")

    def step(acc, x):
        open_one = F.try_element_at(acc, F.lit(-1))
        near = (F.size(acc) > 0) & (F.abs(v(x) - open_one["total"] / open_one["n"]) <= tolerance)
        grown = F.struct((open_one["total"] + v(x)).alias("total"), (open_one["n"] + 1).alias("n"))
        return F.when(near, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(F.struct(v(x).alias("total"), F.lit(1).alias("n")))))

    folded = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("v")).select(*keys, F.posexplode(F.aggregate("v", start, step)).alias("cluster", "c"))
    return folded.select(*keys, "cluster", (F.col("c.total") / F.col("c.n")).alias("mean"), F.col("c.n").alias("members"))


def thinned(rows: DataFrame, value: str, gap: float, keys: Sequence[str] = PAGE) -> DataFrame:
    """Keeps a sorted value if it is over `gap` beyond the last kept one. -> keys, value."""
    keep = F.aggregate("v", F.expr("cast(array() as array<int>)"), lambda a, x: F.when((F.size(a) == 0) | (x - F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) > gap), F.concat(a, F.array(x.cast("int")))).otherwise(a))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("v")).select(*keys, F.explode(keep).alias(value))


def lattice(xs: DataFrame, ys: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Cells between neighbouring x and y positions: xs (keys, x), ys (keys, y) -> keys, row_no, col_no, x, y, w, h."""

    def spans(df: DataFrame, c: str, no: str, size: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(c)
        return df.select(*keys, c).distinct().select(*keys, c, (F.row_number().over(w) - 1).alias(no), (F.lead(c).over(w) - F.col(c)).alias(size)).where(F.col(size).isNotNull())

    return spans(xs, "x", "col_no", "w").join(spans(ys, "y", "row_no", "h"), list(keys)).select(*keys, "row_no", "col_no", "x", "y", "w", "h")


def parents(headings: DataFrame, key: str = "doc_id", order: str = "pos", level: str = "level", deepest: int = 6) -> DataFrame:
    """Adds parent: order of the nearest earlier heading of a smaller level (one window for each level)."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = {n: F.max(F.when(F.col(level) == n, F.col(order))).over(before) for n in range(1, deepest)}
    parent = F.lit(None).cast("int")
    for n in range(2, deepest + 1):
        parent = F.when(F.col(level) == n, F.greatest(*[last[k] for k in range(1, n)]) if n > 2 else last[1]).otherwise(parent)
    return headings.withColumn("parent", parent)


def body_region(lines: DataFrame, gap: int = 30, keys: Sequence[str] = PAGE) -> DataFrame:
    """Bounding box of the largest group of lines by x gap; ties go to the leftmost group."""
    g = gap_groups(lines, "x", gap, keys, ("pos",))
    box = g.groupBy(*keys, "grp").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    best = box.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("grp")).alias("neg"), "x0", "y0", "x1", "y1")).alias("b"))
    return best.select(*keys, "b.n", "b.x0", "b.y0", "b.x1", "b.y1")


def two_columns(lines: DataFrame, width: int = 1000, tolerance: int = 50, keys: Sequence[str] = PAGE) -> DataFrame:
    """Reading order with two columns where both hold over two lines, else top to bottom: adds col and reading_order."""
    page = Window.partitionBy(*keys)
    left = (F.col("x") + F.col("w") / 2 <= width / 2 + tolerance).cast("int")
    both = (F.sum(left).over(page) > 2) & (F.sum(1 - left).over(page) > 2)
    cols = lines.withColumn("col", F.when(both, 1 - left).otherwise(0).cast("int"))
    return cols.withColumn("reading_order", F.row_number().over(page.orderBy("col", "y", "x", "pos")))


def classified(lines: DataFrame, height: int = 960) -> DataFrame:
    """kind: page_number, header, footer, heading or body, by place and text."""
    t = F.trim("text")
    top, bottom = F.col("y") < 0.06 * height, F.col("y") + F.col("h") > 0.94 * height
    kind = (
        F.when((top | bottom) & t.rlike("^[-– ]*[0-9]{1,4}[-– ]*$"), "page_number")
        .when(top & (F.length(t) < 40), "header")
        .when(bottom & (F.length(t) < 40), "footer")
        .when((F.length(t) < 25) & ~t.rlike("[.!?]$"), "heading")
        .otherwise("body")
    )
    return lines.withColumn("kind", kind)


def paragraphs(lines: DataFrame, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """Paragraphs that go on over a page: the first line of a page joins the last one of the page before unless that ends
    with terminal punctuation. -> key, para, text."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag("text").over(w)
    joins = (F.col("page") != F.lag("page").over(w)) & ~F.rtrim(before).rlike("[.!?。！？:;]$")
    marked = lines.withColumn("para", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    parts = marked.groupBy(key, "para").agg(F.array_sort(F.collect_list(F.struct(order, F.trim("text").alias("t")))).alias("p"))
    glue = lambda a, x: F.when(F.length(a) == 0, x["t"]).when(a.rlike("[A-Za-z]-$"), F.concat(F.regexp_replace(a, "-$", ""), x["t"])).otherwise(F.concat(a, F.lit(" "), x["t"]))
    return parts.select(key, "para", F.aggregate("p", F.lit(""), glue).alias("text"))


def section_paths(headings: DataFrame) -> DataFrame:
    """headings (doc_id, pos, level) -> doc_id, pos, path: the positions of the headings above, of any depth, and its own. One
    pass over a document's headings keeps the open ones: a heading closes those of its own and of deeper levels."""
    opened = "array<struct<level:int,pos:int>>"
    zero = F.struct(F.array().cast(opened).alias("stack"), F.array().cast("array<struct<pos:int,path:string>>").alias("out"))

    def step(acc, h):
        stack = F.concat(F.filter(acc["stack"], lambda o: o["level"] < h["level"]), F.array(F.struct(h["level"].alias("level"), h["pos"].alias("pos"))))
        path = F.array_join(F.transform(stack, lambda o: o["pos"].cast("string")), "/")
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(F.struct(h["pos"].alias("pos"), path.alias("path")))).alias("out"))

    rows = headings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), F.col("level").cast("int").alias("level")))).alias("h"))
    return rows.select("doc_id", F.inline(F.aggregate("h", zero, step)["out"]))


def peaks(projection: DataFrame, at: str, value: str, least: float, apart: int = 8) -> DataFrame:
    """projection (doc_id, page, at, value) -> doc_id, page, at, value of the local maxima above `least`, `apart` or more from the
    last one kept. A plateau counts once, at its beginning; what lies outside the projection counts as nothing."""
    w = Window.partitionBy("doc_id", "page").orderBy(at)
    before, after = F.coalesce(F.lag(value).over(w), F.lit(0)), F.coalesce(F.lead(value).over(w), F.lit(0))
    high = projection.withColumn("_b", before).withColumn("_a", after).where((F.col(value) > least) & (F.col(value) > F.col("_b")) & (F.col(value) >= F.col("_a")))
    kept = thinned(high.select("doc_id", "page", at), at, apart - 1)
    return high.join(kept, ["doc_id", "page", at]).select("doc_id", "page", at, value)
