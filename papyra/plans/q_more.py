"""Further operators of the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.operators import hybrid, layout, state
from papyra.operators import pages as PG
from papyra.operators import retrieval as R
from papyra.plans.registry import query


# --- joins ---------------------------------------------------------------------------------------------------------
@query("tags tag_groups", "select g.name, t.tag_id from tag_groups g join tags t on t.group_id = g.group_id")
def c9_application_hash_join(v):
    return v.tag_groups.join(v.tags, "group_id").select("name", "tag_id")


@query("blocks lines cells", """
with m as (select l.doc_id, l.page, l.pos, l.h, l.x, l.y, l.w, c.row_no, c.col_no from lines l join cells c on l.doc_id = c.doc_id and l.page = c.page
 where l.x + l.w / 2.0 between c.x and c.x + c.w and l.y + l.h / 2.0 between c.y and c.y + c.h
  or greatest(0, least(l.x + l.w, c.x + c.w) - greatest(l.x, c.x)) * greatest(0, least(l.y + l.h, c.y + c.h) - greatest(l.y, c.y)) >= 0.5 * l.w * l.h),
r as (select distinct a.doc_id, a.pos from lines a join lines b on a.doc_id = b.doc_id and a.page = b.page and a.pos <> b.pos and length(a.text) <= 20 and length(b.text) > 20 and abs(a.y - b.y) <= 24 and a.x < b.x + b.w and b.x < a.x + a.w)
select doc_id, page, pos, row_no, col_no from m where not exists (select 1 from r where r.doc_id = m.doc_id and r.pos = m.pos)""")
def c16_region_lines_without_ruby(v):
    """Lines of a region by centre or half their area; short lines right beside a longer one that they lie over (ruby) go."""
    from papyra.functions.geometry import centre_in, overlap_area

    m = v.lines.alias("l").join(v.cells.alias("c"), layout.on_page("l.", "c.") & (centre_in("l.", "c.") | (overlap_area("l.", "c.") >= 0.5 * F.col("l.w") * F.col("l.h"))))
    m = m.select("l.doc_id", "l.page", "l.pos", "c.row_no", "c.col_no")
    a, b = v.lines.where(F.length("text") <= 20).alias("a"), v.lines.where(F.length("text") > 20).alias("b")
    over = (F.abs(F.col("a.y") - F.col("b.y")) <= 24) & (F.col("a.x") < F.col("b.x") + F.col("b.w")) & (F.col("b.x") < F.col("a.x") + F.col("a.w"))
    ruby = a.join(b, layout.on_page("a.", "b.") & (F.col("a.pos") != F.col("b.pos")) & over, "left_semi").select("doc_id", "pos")
    return m.join(ruby, ["doc_id", "pos"], "left_anti").select("doc_id", "page", "pos", "row_no", "col_no")


_RULES = "rules as (select doc_id, page, pos, y as at, x as s, x + w as e from lines where w >= 300)"


@query("blocks lines", f"""with {_RULES},
p as (select a.doc_id, a.page, a.at as y0, b.at as y1, greatest(a.s, b.s) as x0, least(a.e, b.e) as x1, a.pos as pa, b.pos as pb from rules a join rules b on a.doc_id = b.doc_id and a.page = b.page and b.at > a.at + 100 and least(a.e, b.e) - greatest(a.s, b.s) >= 200),
r as (select *, row_number() over (partition by doc_id, page order by (y1 - y0) * (x1 - x0) desc, y0, x0, pa, pb) as n from p)
select doc_id, page, x0, y0, x1, y1 from r where n = 1""")
def c19_bordered_rectangles(v):
    """Two long rules that share a span enclose a rectangle; the largest of each page stays."""
    r = v.lines.where("w >= 300").selectExpr("doc_id", "page", "pos", "y as at", "x as s", "x + w as e")
    shared = F.least("a.e", "b.e") - F.greatest("a.s", "b.s")
    j = r.alias("a").join(r.alias("b"), layout.on_page("a.", "b.") & (F.col("b.at") > F.col("a.at") + 100) & (shared >= 200))
    area = (F.col("b.at") - F.col("a.at")) * shared
    m = F.min(F.struct((-area).alias("neg"), F.col("a.at").alias("y0"), F.greatest("a.s", "b.s").alias("x0"), F.col("a.pos").alias("pa"), F.col("b.pos").alias("pb"), F.col("b.at").alias("y1"), F.least("a.e", "b.e").alias("x1")))
    return j.groupBy("a.doc_id", "a.page").agg(m.alias("m")).select("doc_id", "page", "m.x0", "m.y0", "m.x1", "m.y1")


@query("blocks lines cells", f"""with {_RULES}
select r.doc_id, r.page, r.pos, c.row_no, c.col_no, greatest(r.s, c.x) as s, least(r.e, c.x + c.w) as e from rules r join cells c on r.doc_id = c.doc_id and r.page = c.page and r.at between c.y - 3 and c.y + c.h + 3 and r.s < c.x + c.w + 3 and r.e > c.x - 3""")
def c20_clipped_rules(v):
    r = v.lines.where("w >= 300").selectExpr("doc_id", "page", "pos", "y as at", "x as s", "x + w as e").alias("r")
    c = v.cells.alias("c")
    meet = F.col("r.at").between(F.col("c.y") - 3, F.col("c.y") + F.col("c.h") + 3) & (F.col("r.s") < F.col("c.x") + F.col("c.w") + 3) & (F.col("r.e") > F.col("c.x") - 3)
    return r.join(c, layout.on_page("r.", "c.") & meet).select("r.doc_id", "r.page", "r.pos", "c.row_no", "c.col_no", F.greatest("r.s", "c.x").alias("s"), F.least(F.col("r.e"), F.col("c.x") + F.col("c.w")).alias("e"))


@query("blocks headings", """
with rec as (select doc_id, pos as rec, text as title, case when pos % 2 = 0 then pos end as rid from headings where level = 1),
reg as (select doc_id, pos as reg, text as title from headings where level = 1 and doc_id % 5 <> 0),
byid as (select rec.doc_id, rec.rec, reg.reg, 'id' as how from rec join reg on reg.doc_id = rec.doc_id and reg.reg = rec.rid),
ur as (select doc_id, title, min(rec) as rec from rec where (doc_id, rec) not in (select doc_id, rec from byid) group by 1, 2 having count(*) = 1),
ug as (select doc_id, title, min(reg) as reg from reg where (doc_id, reg) not in (select doc_id, reg from byid) group by 1, 2 having count(*) = 1)
select * from byid union all select ur.doc_id, ur.rec, ug.reg, 'title' from ur join ug on ug.doc_id = ur.doc_id and ug.title = ur.title""")
def c26_heading_reconciliation(v):
    from papyra.operators.reconcile import reconciled

    h = v.headings.where("level = 1")
    rec = h.select("doc_id", F.col("pos").alias("rec"), F.col("text").alias("title"), F.when(F.col("pos") % 2 == 0, F.col("pos")).alias("rid"))
    return reconciled(rec, h.where("doc_id % 5 <> 0").select("doc_id", F.col("pos").alias("reg"), F.col("text").alias("title")))


@query("", """select doc_id, 'note-' || doc_id || '-' || i as note_id, n as text from (select doc_id, unnest(regexp_extract_all(text, '[0-9]{16}')) as n, generate_subscripts(regexp_extract_all(text, '[0-9]{16}'), 1) as i from documents)""")
def c27_footnote_catalogue(v):
    n = v.documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[0-9]{16}"), F.lit(0))).alias("i", "text"))
    return n.select("doc_id", F.concat(F.lit("note-"), F.col("doc_id").cast("string"), F.lit("-"), (F.col("i") + 1).cast("string")).alias("note_id"), "text")


@query("", "select doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') as revision from documents")
def d20_revision_digest(v):
    """Digest of a record as JSON, keys in order, without its volatile ones."""
    return v.documents.select("doc_id", F.sha2(F.to_json(F.struct("doc_id", "lang", "source")), 256).alias("revision"))


# --- ordered -------------------------------------------------------------------------------------------------------
@query("")
def e13_evidence_windows(v):
    """No SQL: a greedy choice of windows; tests hold it against a plain loop."""
    import pandas as pd

    from papyra.operators.evidence import evidence_windows

    groups = [("license", 2.0, ["licence"]), ("copyright", 1.5, [])]

    def run(batches):
        for pdf in batches:
            rows = [(d, a, b - a) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for a, b in evidence_windows(t or "", groups)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "size"])

    return v.documents.select("doc_id", "text").mapInPandas(run, "doc_id long, start int, size int")


@query("")
def e14_quote_pieces(v):
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [(d, i, q) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for i, q in enumerate(PG.split_quotes(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "quote"])

    return v.documents.select("doc_id", "text").mapInPandas(run, "doc_id long, piece int, quote string")


# --- sorts, page orders, duplicate reads ---------------------------------------------------------------------------
@query("", "select doc_id from documents order by doc_id limit 10 offset 20")
def f2_limit_offset(v):
    return v.documents.select("doc_id").orderBy("doc_id").offset(20).limit(10)


@query("", "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 15")
def f5_rank_ordered_top(v):
    return v.customer.select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(15)


@query("", "with r as (select c_nationkey, c_custkey, c_acctbal, cast(row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as integer) as rank from customer) select * from r where rank <= 5")
def f7_top_k_per_query(v):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return v.customer.select("c_nationkey", "c_custkey", "c_acctbal", F.row_number().over(w).alias("rank")).where("rank <= 5")


def _reads(v, again: bool = True):
    """Lines with a confidence and, with `again`, a second read of every fifth one, a little off."""
    sure = (F.pmod(F.col("pos") * 37 + F.col("doc_id"), F.lit(100)) / 100).cast("double")
    passes = F.when(F.col("pos") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))) if again else F.array(F.lit(0))
    n = F.col("pass_no")
    both = v.lines.withColumn("confidence", sure).withColumn("pass_no", F.explode(passes))
    both = both.withColumns({"x": F.col("x") + 2 * n, "pos": F.col("pos") + 100_000 * n, "confidence": F.when(n == 1, 1 - F.col("confidence")).otherwise(F.col("confidence"))})
    return both.select("doc_id", "pos", "page", "x", "y", "w", "h", "text", "confidence", "pass_no")


_BOX = ("x", "y", "w", "h")


def _ordered(fn):
    return lambda v: PG.per_page(_reads(v, again=False), fn, "doc_id long, page int, pos int, reading_order int", _BOX)


def _kept(fn, *more):
    return lambda v: PG.per_page(_reads(v), fn, "doc_id long, page int, pos int, pass_no int", (*_BOX, "confidence", "pass_no", *more))


def _named(name, fn, doc):
    fn.__name__, fn.__doc__ = name, doc
    query("")(fn)


_named("f8_vertical_order", _ordered(PG.vertical_order), "Columns right to left.")
_named("f9_horizontal_order", _ordered(PG.horizontal_order), "Rows by running means.")
_named("f11_margin_order", _ordered(PG.margin_order), "Comparator sort with a margin.")
_named("f12_xy_cut", _ordered(PG.xy_cut), "Recursive cuts.")
_named("f13_smoothed_order", _ordered(PG.one_after_other(PG.xy_cut, PG.smoothed_order)), "Least path near the order.")
_named("g5_adjacent_dedup", _kept(PG.adjacent_deduplicated), "Adjacent overlapping lines.")
_named("g6_suppression", _kept(PG.suppressed), "Non-maximum suppression.")
_named("g10_fused_passes", _kept(PG.fused_passes, "text"), "Fusion of recognition passes (with contained and weak reads).")


@query("")
def j10_band_groups(v):
    return PG.per_page(_reads(v, again=False), PG.band_groups, "doc_id long, page int, pos int, band int", _BOX)


@query("")
def j13_seed_groups(v):
    return PG.per_page(_reads(v, again=False), PG.seed_groups, "doc_id long, page int, pos int, seed_group int", _BOX)


# --- text ----------------------------------------------------------------------------------------------------------
@query("")
def h17_unlooped(v):
    from papyra.functions.text import unlooped

    return v.documents.select("doc_id", unlooped(F.col("text")).alias("text"))


@query("")
def h17_clean_lines(v):
    """Latin lines stay: the driver's texts are Latin throughout."""
    from papyra.functions.text import clean_line

    return v.lines.select("doc_id", "pos", clean_line(F.col("text"), drop_latin_noise=False).alias("text"))


@query("blocks", "select doc_id, pos, case when length(text) < 20 then 'heading3' when length(text) < 30 then 'heading2' when length(text) < 40 and not regexp_matches(text, '[.!?]$') then 'heading1' else 'body' end as kind from blocks")
def h34_heading_classes(v):
    n = F.length("text")
    return v.blocks.select("doc_id", "pos", F.when(n < 20, "heading3").when(n < 30, "heading2").when((n < 40) & ~F.col("text").rlike("[.!?]$"), "heading1").otherwise("body").alias("kind"))


@query("blocks lines", """with m as (select doc_id, page, median(w) as mw from lines group by 1, 2)
select l.doc_id, l.page, l.pos from lines l join m on m.doc_id = l.doc_id and m.page = l.page where l.w < 0.2 * m.mw
 and exists (select 1 from lines b where b.doc_id = l.doc_id and b.page = l.page and b.pos <> l.pos and b.w >= m.mw and abs(b.y - l.y) <= 24)""")
def h43_caption_noise(v):
    m = v.lines.groupBy("doc_id", "page").agg(F.median("w").alias("mw"))
    small = v.lines.join(m, ["doc_id", "page"]).where(F.col("w") < 0.2 * F.col("mw")).alias("a")
    near = layout.on_page("a.", "b.") & (F.col("a.pos") != F.col("b.pos")) & (F.col("b.w") >= F.col("a.mw")) & (F.abs(F.col("a.y") - F.col("b.y")) <= 24)
    return small.join(v.lines.alias("b"), near, "left_semi").select("doc_id", "page", "pos")


@query("")
def h14_name_similarity(v):
    from papyra.operators.dedup import similar_names

    f = v.customer.select(F.col("c_custkey").alias("file_no"), F.lower("c_name").alias("key"))
    d = v.customer.select(F.col("c_custkey").alias("doc_id"), F.lower("c_name").alias("key"))
    return similar_names(f, d).where("file_no < doc_id").select("file_no", "doc_id", F.round("ratio", 6).alias("ratio"))


@query("")
def h30_folded_key(v):
    from papyra.functions.unicode import folded_key

    return v.documents.select("doc_id", folded_key(F.col("text")).alias("key"))


# --- retrieval -----------------------------------------------------------------------------------------------------
@query("")
def i5_hybrid_search(v):
    """The whole request: terms and aliases, hits, quotas, windows, context, fusion with dense candidates, topicality, greedy
    choice. The dense candidates of a document (the label of a vector) are cited by its first block."""
    b = v.blocks.withColumn("page", F.floor(F.col("pos") / 40).cast("int"))
    asked = v.chunks.where("chunk_id = 0").select(F.lit("q").alias("query_id"), F.col("vector").alias("q"))
    dense = R.dense_top_k(v.chunks.where("chunk_id <> 0"), asked, 60).groupBy("doc_id").agg(F.min(F.struct("language_rank", "lane")).alias("m"))
    first = b.groupBy("doc_id").agg(F.min(F.struct("pos", F.length("text").alias("n"))).alias("f"))
    semantic = dense.join(first, "doc_id").select("doc_id", F.col("f.pos").alias("block"), F.lit(0).alias("start"), F.least(F.lit(1000), F.col("f.n")).alias("end"), F.col("m.language_rank").alias("rank"), "m.lane")
    found = hybrid.search(b, "Apache license version", v.documents.count(), semantic)
    return found.select("place", "doc_id", "block", "start", "end", "lane", F.round("relevance", 9).alias("relevance"), F.sha2("quote", 256).alias("quote_hash"))


@query("blocks", """select doc_id, pos, round(greatest(least(1.0, (case when instr(lower(text), 'license') > 0 then 2.0 else 0.0 end + case when instr(lower(text), 'apache') > 0 then 1.0 else 0.0 end) / 3.0), 0.85 * (case when instr(lower(text), 'copyright') > 0 then 1.0 else 0.0 end)), 9) as topic from blocks""")
def i12_topicality(v):
    t = hybrid.topicality(v.blocks, [("license", 2.0, []), ("apache", 1.0, [])], [("copyright", 1.0, [])])
    return t.select("doc_id", "pos", F.round("topic", 9).alias("topic"))


@query("")
def i14_final_greedy(v):
    c = v.orders.select(F.lit("q").alias("query_id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("section"), F.col("o_orderkey").alias("block"), F.lit(0).alias("start"), F.lit(100).alias("end"), F.when(F.col("o_orderkey") % 2 == 0, "en").otherwise("ja").alias("lane"), F.col("o_totalprice").alias("relevance"))
    return hybrid.pick_evidence(hybrid.enough_evidence(c))


@query("")
def i18_context_expansion(v):
    """Every block as a hit, with its context on the same page."""
    from papyra.operators.evidence import expanded

    b = v.blocks.withColumn("page", F.floor(F.col("pos") / 40).cast("int"))
    out = expanded(b, v.blocks.select("doc_id", "pos", F.lit(0).alias("start"), F.length("text").alias("end")))
    return out.select("doc_id", "pos", F.col("segments")[0]["pos"].alias("first_pos"), F.element_at("segments", -1)["pos"].alias("last_pos"), F.sha2("quote", 256).alias("quote_hash"))


@query("")
def i9_related_terms(v):
    found = hybrid.related_terms(v.blocks, [("license", 1.0, [])], v.documents.count(), pattern=hybrid.RELATED + "|[a-z]{9,24}")  # the texts are in lower case
    return v.spark.createDataFrame([(i + 1, t) for i, t in enumerate(found)], "place int, term string")


@query("chunks", """with c as (select chunk_id, list_sum(list_transform(vector, lambda e: cast(e as double) * cast(e as double))) as s, vector from chunks)
select chunk_id, round(sqrt(s), 5) as norm, round(cast(vector[1] as double) / sqrt(s), 5) as first_component from c""")
def i17_normalised_vectors(v):
    s = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    return v.chunks.select("chunk_id", F.round(s, 5).alias("norm"), F.round(F.col("vector")[0].cast("double") / s, 5).alias("first_component"))


# --- layout --------------------------------------------------------------------------------------------------------
@query("blocks lines cells", """
with taken as (select distinct l.doc_id, l.pos from lines l join cells c on l.doc_id = c.doc_id and l.page = c.page and c.row_no = 3 and l.x + l.w / 2.0 between c.x and c.x + c.w and l.y + l.h / 2.0 between c.y and c.y + c.h),
free as (select * from lines l where not exists (select 1 from taken t where t.doc_id = l.doc_id and t.pos = l.pos)),
u as (select doc_id, page, pos, 'text' as kind, y from free union all select distinct c.doc_id, c.page, 1000000 + c.row_no, 'table', c.y from cells c where c.row_no = 3 and c.col_no = 0)
select doc_id, page, pos, kind, cast(row_number() over (partition by doc_id order by page, y, pos) as integer) as reading_order from u""")
def j7_page_blocks(v):
    """Text outside tables and tables as blocks, in one reading order for each document."""
    region = v.cells.where("row_no = 3")
    free = layout.lines_outside(v.lines, region).select("doc_id", "page", "pos", F.lit("text").alias("kind"), "y")
    tables = region.where("col_no = 0").selectExpr("doc_id", "page", "1000000 + row_no as pos", "'table' as kind", "y")
    w = Window.partitionBy("doc_id").orderBy("page", "y", "pos")
    return free.union(tables).select("doc_id", "page", "pos", "kind", F.row_number().over(w).alias("reading_order"))


@query("blocks lines", "select doc_id, page, x >= 500 as right_side, count(*) as n, min(x) as x0, max(x + w) as x1, min(y) as y0, max(y + h) as y1 from lines where h < 100 group by 1, 2, 3 having count(*) >= 2")
def j9_body_candidates(v):
    return v.lines.where("h < 100").groupBy("doc_id", "page", (F.col("x") >= 500).alias("right_side")).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.min("y").alias("y0"), F.max(F.col("y") + F.col("h")).alias("y1")).where("n >= 2")


@query("blocks lines", """with g0 as (select *, case when x - max(x + w) over (partition by doc_id, page order by x, pos rows between unbounded preceding and 1 preceding) > 10 then 1 else 0 end as s from lines)
select doc_id, page, pos, cast(sum(s) over (partition by doc_id, page order by x, pos rows unbounded preceding) as integer) as part from g0""")
def j11_valley_split(v):
    """Parts along x: a new one starts beyond everything before it."""
    w = Window.partitionBy("doc_id", "page").orderBy("x", "pos")
    end = F.max(F.col("x") + F.col("w")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = v.lines.withColumn("s", F.when(F.col("x") - end > 10, 1).otherwise(0))
    return s.select("doc_id", "page", "pos", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("part"))


@query("blocks lines cells", """
with marks as (select distinct l.doc_id, l.page, cast(floor(l.y / 240.0) as integer) as row_no from lines l where l.x >= 500)
select c.doc_id, c.page, c.row_no, c.col_no, case when m.row_no is null then 2 else 1 end as colspan from cells c left join marks m on m.doc_id = c.doc_id and m.page = c.page and m.row_no = c.row_no where c.col_no = 0 or m.row_no is not null""")
def j12_colspans(v):
    """A cell spans to the right where no rule (here: no line starting right of the gutter) parts its row."""
    m = v.lines.where("x >= 500").select("doc_id", "page", F.floor(F.col("y") / 240).cast("int").alias("row_no")).distinct().withColumn("ruled", F.lit(True))
    j = v.cells.join(m, ["doc_id", "page", "row_no"], "left").where("col_no = 0 or ruled")
    return j.select("doc_id", "page", "row_no", "col_no", F.when(F.col("ruled"), 1).otherwise(2).alias("colspan"))


@query("blocks lines cells", """select l.doc_id, l.pos, c.row_no from lines l join cells c on l.doc_id = c.doc_id and l.page = c.page and c.col_no = 1 and l.x + l.w / 2.0 between c.x and c.x + c.w and l.y + l.h / 2.0 between c.y and c.y + c.h""")
def j14_block_membership(v):
    return layout.lines_in_cells(v.lines, v.cells.where("col_no = 1")).select("doc_id", "pos", "row_no")


# --- state ---------------------------------------------------------------------------------------------------------
@query("", """select coalesce(n.doc_id, o.doc_id) as doc_id, coalesce(n.n_chars, o.n_chars) as n_chars, case when o.doc_id is null then 'inserted' when n.doc_id is null then 'kept' else 'updated' end as how
from (select doc_id, n_chars from documents where doc_id % 2 = 0) o full outer join (select doc_id, n_chars + 1 as n_chars from documents where doc_id % 3 = 0) n on n.doc_id = o.doc_id""")
def k2_on_conflict_update(v):
    o = v.documents.where("doc_id % 2 = 0").select("doc_id", F.col("n_chars").alias("old"))
    n = v.documents.where("doc_id % 3 = 0").select("doc_id", (F.col("n_chars") + 1).alias("new"))
    how = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "kept").otherwise("updated")
    return o.join(n, "doc_id", "full_outer").select("doc_id", F.coalesce("new", "old").alias("n_chars"), how.alias("how"))


@query("tags", "select w.name, case when w.name is null or trim(w.name) = '' then 'blank' when lower(trim(w.name)) in (select lower(tag_id) from tags) then 'taken' else 'created' end as result from (select unnest(['fresh', ' GOOD ', '  ', 'src3']) as name) w")
def k3a_create_tags(v):
    from papyra.operators.reconcile import creations

    return creations(v.tags.select(F.col("tag_id").alias("name")), v.spark.createDataFrame([("fresh",), (" GOOD ",), ("  ",), ("src3",)], "name string"))


@query("tag_groups", "select 'fourth' as name, coalesce(max(order_idx), -1) + 1 as order_idx from tag_groups")
def k3b_create_group(v):
    return v.tag_groups.agg((F.coalesce(F.max("order_idx"), F.lit(-1)) + 1).alias("order_idx")).select(F.lit("fourth").alias("name"), "order_idx")


@query("tags", "select tag_id, case when tag_id in ('src1', 'good') then 'g0' else group_id end as group_id from tags")
def k3c_assign_group(v):
    return v.tags.select("tag_id", F.when(F.col("tag_id").isin("src1", "good"), "g0").otherwise(F.col("group_id")).alias("group_id"))


@query("document_tags", "select d.doc_id, 'src2' as tag_id from (select unnest([2, 4, 999999]) as doc_id) a join documents d on d.doc_id = a.doc_id where not exists (select 1 from document_tags x where x.doc_id = d.doc_id and x.tag_id = 'src2')")
def k4a_assign_one(v):
    asked = v.spark.createDataFrame([(2,), (4,), (999999,)], "doc_id long").join(v.documents.select("doc_id"), "doc_id", "left_semi")
    return state.assigned(asked, ["src2"], v.document_tags)


@query("", "select page_id, replace(html, '<p>', '<p style=\"margin:0\">') <> html as changed, md5(replace(html, '<p>', '<p style=\"margin:0\">')) as new_hash from pages")
def k11_style_propagation(v):
    styled = F.replace("html", F.lit("<p>"), F.lit('<p style="margin:0">'))
    return v.pages.select("page_id", (styled != F.col("html")).alias("changed"), F.md5(styled).alias("new_hash"))


@query("", "select count(*) filter (new <> url) as changed, count(*) as total from (select url, regexp_replace(url, '^https?://[^/]+/', '') as new from pages)")
def k12_path_migration(v):
    from papyra.operators.reconcile import migrated

    return migrated(v.pages.select("url"), "url", r"^https?://[^/]+/").agg(F.count_if("changed").alias("changed"), F.count("*").alias("total"))


@query("jobs", "select doc_id, case when max_by(state, (ts, event_id)) in ('queued', 'building') and doc_id % 2 = 0 then 'paused' else max_by(state, (ts, event_id)) end as state from jobs group by doc_id")
def l3_pause(v):
    now = state.latest(v.jobs, "doc_id", ["ts", "event_id"])
    return now.select("doc_id", F.when(F.col("state").isin("queued", "building") & (F.col("doc_id") % 2 == 0), "paused").otherwise(F.col("state")).alias("state"))


@query("jobs", "with c as (select doc_id, max_by(state, (ts, event_id)) as state, max(ts) as ts from jobs group by doc_id) select doc_id, ts from c where state = 'queued' order by ts desc, doc_id limit 40")
def f15_newest_first(v):
    now = state.latest(v.jobs, "doc_id", ["ts", "event_id"]).where("state = 'queued'")
    return now.select("doc_id", "ts").orderBy(F.desc("ts"), "doc_id").limit(40)
