"""Scans, predicates, joins, aggregates, ordered operators, sorts and set operations (SURVEY A to G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators import layout, scope, state
from papyra.plans.registry import query
from papyra.sources.sinks import markdown_lines


# --- A: scans, sources, sinks -------------------------------------------------------------------------------------
@query("", "select doc_id, lang, source, n_chars from documents where doc_id = 42")
def a1_point_lookup(v):
    return v.documents.where("doc_id = 42").select("doc_id", "lang", "source", "n_chars")


@query("blocks headings", """
with h as (select b.doc_id, b.pos, b.text, h.text as section from blocks b left join headings h on h.doc_id = b.doc_id and h.pos = b.pos)
select doc_id, pos, section, sha256(text) as content_hash from h""")
def a2_document_blocks(v):
    h = v.headings.select("doc_id", "pos", F.col("text").alias("section"))
    return v.blocks.join(h, ["doc_id", "pos"], "left").select("doc_id", "pos", "section", F.sha2("text", 256).alias("content_hash"))


@query("blocks", "select doc_id, sha256(string_agg(sha256(text), chr(10) order by pos)) as fingerprint, count(*) as blocks from blocks group by doc_id")
def d19_document_fingerprint(v):
    rows = v.blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.sha2("text", 256).alias("h")))).alias("r"))
    return rows.select("doc_id", F.sha2(F.array_join(F.transform("r", lambda x: x["h"]), "\n"), 256).alias("fingerprint"), F.size("r").cast("long").alias("blocks"))


@query("blocks headings document_tags", """
select d.doc_id, d.source, coalesce(b.n, 0) as blocks, coalesce(h.n, 0) as headings, coalesce(t.tags, '') as tags
from documents d
left join (select doc_id, count(*) n from blocks group by 1) b on b.doc_id = d.doc_id
left join (select doc_id, count(*) n from headings group by 1) h on h.doc_id = d.doc_id
left join (select doc_id, string_agg(tag_id, ',' order by tag_id) tags from (select distinct doc_id, tag_id from document_tags) group by 1) t on t.doc_id = d.doc_id""")
def a3_bundle(v):
    b = v.blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"))
    h = v.headings.groupBy("doc_id").agg(F.count("*").alias("headings"))
    t = v.document_tags.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("tag_id")), ",").alias("tags"))
    out = v.documents.select("doc_id", "source").join(b, "doc_id", "left").join(h, "doc_id", "left").join(t, "doc_id", "left")
    return out.select("doc_id", "source", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("headings", F.lit(0)).alias("headings"), F.coalesce("tags", F.lit("")).alias("tags"))


@query("blocks headings", """
select b.doc_id, b.pos, 'block' as kind, length(b.text) as size from blocks b
union all select doc_id, pos, 'heading', length(text) from headings""")
def a4_profile_export(v):
    return v.blocks.select("doc_id", "pos", F.lit("block").alias("kind"), F.length("text").alias("size")).union(v.headings.select("doc_id", "pos", F.lit("heading"), F.length("text")))


@query("blocks headings", """
select b.doc_id, b.pos, case when h.level is not null then repeat('#', h.level) || ' ' || trim(b.text) else trim(b.text) end as md
from blocks b left join headings h on h.doc_id = b.doc_id and h.pos = b.pos""")
def a17_markdown_lines(v):
    return markdown_lines(v.blocks, v.headings)


_ESC = "replace(replace(replace(replace(replace(trim(b.text), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\'\'', '&#x27;')"


@query("blocks headings", f"""
select b.doc_id, b.pos, '<' || coalesce('h' || h.level, 'p') || '>' || {_ESC} || '</' || coalesce('h' || h.level, 'p') || '>' as html
from blocks b left join headings h on h.doc_id = b.doc_id and h.pos = b.pos""")
def a18_html_lines(v):
    from papyra.sources.sinks import html_lines

    return html_lines(v.blocks, v.headings)


@query("", "select sha256(text) as hash, 'doc_' || substr(sha256(text), 1, 16) || '.txt' as file, min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by text")
def a24_content_addressed_store(v):
    h = F.sha2("text", 256)
    return v.documents.where("text is not null").groupBy(h.alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("hash", F.concat(F.lit("doc_"), F.substring("hash", 1, 16), F.lit(".txt")).alias("file"), "doc_id", "copies")


@query("", """
with disk as (select 'docs/' || doc_id || '.txt' as path, strlen(text) as size, sha256(text) as sha from documents where doc_id % 11 <> 0),
mani as (select 'docs/' || doc_id || '.txt' as path, strlen(text) + (case when doc_id % 13 = 0 then 1 else 0 end) as size, sha256(text) as sha from documents where doc_id % 17 <> 0)
select coalesce(m.path, d.path) as path, case when d.path is null then 'missing' when m.path is null then 'extra' else 'changed' end as fault
from mani m full outer join disk d on m.path = d.path where m.path is null or d.path is null or m.size <> d.size or m.sha <> d.sha""")
def a26_manifest_verify(v):
    from papyra.sources.manifest import faults

    row = lambda df, extra: df.select(F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("path"), (F.octet_length("text") + extra).cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))
    disk = row(v.documents.where("doc_id % 11 <> 0"), F.lit(0))
    mani = row(v.documents.where("doc_id % 17 <> 0"), F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0))
    return faults(mani, disk)


@query("", """
with m as (select case when doc_id % 19 = 0 then '../' || source when doc_id % 23 = 0 then '/abs/' || source else source || '/' || doc_id end as path, sha256(text) as sha from documents),
k as (select lower(path) as lp, count(*) as n from m group by 1)
select m.path, case when m.path like '/%' or m.path like '%..%' then 'unsafe' when k.n > 1 then 'duplicate' when not regexp_matches(sha, '^[0-9a-f]{64}$') then 'hash' end as fault
from m join k on lower(m.path) = k.lp where m.path like '/%' or m.path like '%..%' or k.n > 1 or not regexp_matches(sha, '^[0-9a-f]{64}$')""")
def a28_manifest_validate(v):
    from papyra.sources.manifest import invalid

    path = F.when(F.col("doc_id") % 19 == 0, F.concat(F.lit("../"), "source")).when(F.col("doc_id") % 23 == 0, F.concat(F.lit("/abs/"), "source")).otherwise(F.concat("source", F.lit("/"), "doc_id"))
    return invalid(v.documents.select(path.alias("path"), F.sha2("text", 256).alias("sha256")))


# --- B: predicates -------------------------------------------------------------------------------------------------
@query("", "select doc_id, coalesce(lang, 'und') as language, n_chars as size from documents")
def b1_projection(v):
    return v.documents.select("doc_id", F.coalesce("lang", F.lit("und")).alias("language"), F.col("n_chars").alias("size"))


@query("", "select doc_id, lang from documents where lang in ('de', 'fr') and source in ('src1', 'src2', 'src3')")
def b2_in_list(v):
    return v.documents.where(F.col("lang").isin("de", "fr") & F.col("source").isin("src1", "src2", "src3")).select("doc_id", "lang")


@query("document_tags", "select doc_id from documents d where not exists (select 1 from document_tags t where t.doc_id = d.doc_id)")
def b3_unassigned(v):
    return scope.scoped(v.documents, v.document_tags, v.tags, unassigned=True).select("doc_id")


@query("document_tags tags", "select doc_id from documents d where exists (select 1 from document_tags t join tags g on g.tag_id = t.tag_id where t.doc_id = d.doc_id and g.group_id = 'g1')")
def b3_group_scope(v):
    return scope.scoped(v.documents, v.document_tags, v.tags, group="g1").select("doc_id")


@query("document_tags", "select doc_id from documents where doc_id in (select doc_id from document_tags where tag_id in ('good', 'src3'))")
def b3_any_tag(v):
    return scope.scoped(v.documents, v.document_tags, v.tags, any_of=["good", "src3"]).select("doc_id")


@query("", "select doc_id from documents where instr(lower(text), lower('The THE')) > 0")
def b4_substring(v):
    return v.documents.where(T.contains_folded(F.col("text"), "The THE")).select("doc_id")


@query("blocks", "select doc_id, pos from blocks where text ilike '%license%'")
def b5_like(v):
    return v.blocks.where(F.col("text").ilike("%license%")).select("doc_id", "pos")


@query("", "select doc_id from documents where contains(lower(source), 'src1') or contains(lower(text), 'mit license')")
def b6_phrase_title_or_text(v):
    return v.documents.where(F.contains(F.lower("source"), F.lit("src1")) | F.contains(F.lower("text"), F.lit("mit license"))).select("doc_id")


@query("", "select doc_id, cast(pos as integer) as pos from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents) where length(trim(line)) > 0")
def b7_non_blank(v):
    return v.blocks.select("doc_id", "pos")


@query("blocks lines", "select doc_id, page, count(*) as n from lines where page in (0, 2) or page between 5 and 7 group by doc_id, page")
def b8_page_filter(v):
    return v.lines.where(F.col("page").isin(0, 2) | F.col("page").between(5, 7)).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


@query("tags tag_groups", """
select 'group' as kind, g as id from (select unnest(['g1', 'g9']) as g) where g not in (select group_id from tag_groups)
union all select 'tag', t from (select unnest(['src5', 'src1', 'nope']) as t) where t not in (select tag_id from tags where group_id in ('g1', 'g9'))""")
def b9_scope_violations(v):
    return scope.scope_violations(v.tags, v.tag_groups, ["g1", "g9"], ["src5", "src1", "nope"])


@query("", "select conv_id, turn from (select *, case when role = 'user' and turn % 2 = 1 then 'x' end as deleted_at from conversations) where deleted_at is null")
def b10_soft_deleted(v):
    deleted = F.when((F.col("role") == "user") & (F.col("turn") % 2 == 1), "x")
    return v.conversations.withColumn("deleted_at", deleted).where(F.col("deleted_at").isNull()).select("conv_id", "turn")


@query("", """
select s.doc_id, case when u.rev = s.rev then 'updated' else 'conflict' end as result, case when u.rev = s.rev then s.rev + 1 else s.rev end as revision
from (select doc_id, n_chars % 3 as rev from documents) s join (select doc_id, doc_id % 3 as rev from documents where doc_id % 5 = 0) u on u.doc_id = s.doc_id""")
def b11_optimistic_update(v):
    stored = v.documents.select("doc_id", (F.col("n_chars") % 3).alias("rev"))
    asked = v.documents.where("doc_id % 5 = 0").select("doc_id", (F.col("doc_id") % 3).alias("asked"))
    ok = F.col("asked") == F.col("rev")
    return stored.join(asked, "doc_id").select("doc_id", F.when(ok, "updated").otherwise("conflict").alias("result"), F.when(ok, F.col("rev") + 1).otherwise(F.col("rev")).alias("revision"))


@query("", "select doc_id from documents where contains(regexp_replace(lower(text), '\\s', '', 'g'), 'thethe') and contains(regexp_replace(lower(text), '\\s', '', 'g'), 'andthe')")
def b12_all_terms_spaceless(v):
    key = F.lower(F.regexp_replace("text", r"\s", ""))
    return v.documents.where(F.forall(F.array(F.lit("thethe"), F.lit("andthe")), lambda t: F.contains(key, t))).select("doc_id")


@query("", "select event_id, value from events where value >= 15 and (length(props) > 8 or value >= 30)")
def b13_confidence(v):
    return v.events.where((F.col("value") >= 15) & ((F.length("props") > 8) | (F.col("value") >= 30))).select("event_id", "value")


@query("blocks lines", """
select doc_id, pos, kind from (select *, case
  when (y < 0.06 * 960 or y + h > 0.94 * 960) and regexp_matches(trim(text), '^[-– ]*[0-9]{1,4}[-– ]*$') then 'page_number'
  when y < 0.06 * 960 and length(trim(text)) < 40 then 'header'
  when y + h > 0.94 * 960 and length(trim(text)) < 40 then 'footer'
  when length(trim(text)) < 25 and not regexp_matches(trim(text), '[.!?]$') then 'heading' else 'body' end as kind from lines)""")
def b14_block_kinds(v):
    return layout.classified(v.lines).select("doc_id", "pos", "kind")


@query("", """select 'event_type' as "column", event_type as "value", count(*) as n from events where event_type not in ('view', 'click', 'purchase') or event_type is null group by 2""")
def b15_enum_violations(v):
    return state.violations(v.events, {"event_type": ["view", "click", "purchase"]})


# --- C: joins ------------------------------------------------------------------------------------------------------
@query("blocks", "select b.doc_id, b.pos, d.source from blocks b join documents d on d.doc_id = b.doc_id where contains(lower(b.text), 'license')")
def c1_inner_join(v):
    return v.blocks.where(F.contains(F.lower("text"), F.lit("license"))).join(v.documents.select("doc_id", "source"), "doc_id").select("doc_id", "pos", "source")


@query("tags tag_groups document_tags", "select t.tag_id, g.name, count(x.doc_id) as n from tags t left join tag_groups g on g.group_id = t.group_id left join document_tags x on x.tag_id = t.tag_id group by 1, 2")
def c2_left_join_counts(v):
    return v.tags.join(v.tag_groups, "group_id", "left").join(v.document_tags, "tag_id", "left").groupBy("tag_id", "name").agg(F.count("doc_id").alias("n"))


@query("blocks lines headings", "select b.doc_id, b.pos, d.lang, l.page, h.level from blocks b left join documents d on d.doc_id = b.doc_id left join lines l on l.doc_id = b.doc_id and l.pos = b.pos left join headings h on h.doc_id = b.doc_id and h.pos = b.pos")
def c3_left_join_chain(v):
    k = ["doc_id", "pos"]
    return v.blocks.select(*k).join(v.documents.select("doc_id", "lang"), "doc_id", "left").join(v.lines.select(*k, "page"), k, "left").join(v.headings.select(*k, "level"), k, "left").select(*k, "lang", "page", "level")


@query("document_tags", "select doc_id, source from documents d where exists (select 1 from document_tags t where t.doc_id = d.doc_id and t.tag_id = 'good')")
def c4_semi_join(v):
    return v.documents.join(v.document_tags.where("tag_id = 'good'"), "doc_id", "left_semi").select("doc_id", "source")


@query("", "select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def c5_anti_join(v):
    return v.documents.join(v.labels, "doc_id", "left_anti").select("doc_id")


@query("document_tags tags tag_groups", "select doc_id from documents d where exists (select 1 from document_tags x join tags t on t.tag_id = x.tag_id join tag_groups g on g.group_id = t.group_id where x.doc_id = d.doc_id and g.name = 'web') order by doc_id limit 25")
def c6_semi_before_limit(v):
    bridge = v.document_tags.join(v.tags.join(v.tag_groups.where("name = 'web'"), "group_id", "left_semi"), "tag_id", "left_semi")
    return v.documents.join(bridge, "doc_id", "left_semi").select("doc_id").orderBy("doc_id").limit(25)


@query("document_tags", "select d.doc_id, (select string_agg(distinct t.tag_id, ',' order by t.tag_id) from document_tags t where t.doc_id = d.doc_id) as tags from documents d")
def c7_scalar_subquery(v):
    t = v.document_tags.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("tag_id")), ",").alias("tags"))
    return v.documents.select("doc_id").join(t, "doc_id", "left")


@query("document_tags", "select doc_id from document_tags where tag_id in ('src0', 'good') group by doc_id having count(distinct tag_id) = 2")
def c8_division(v):
    return scope.tagged(v.documents, v.document_tags, ["src0", "good"], True).select("doc_id")


@query("", "select coalesce(m.doc_id, k.doc_id) as doc_id, coalesce(m.body, k.body) as body from (select doc_id, 'memory' as body from documents where doc_id % 4 = 0) m full outer join (select doc_id, 'disk' as body from documents where doc_id % 3 = 0) k on m.doc_id = k.doc_id")
def c10_override_join(v):
    m = v.documents.where("doc_id % 4 = 0").select("doc_id", F.lit("memory").alias("m"))
    k = v.documents.where("doc_id % 3 = 0").select("doc_id", F.lit("disk").alias("k"))
    return m.join(k, "doc_id", "full_outer").select("doc_id", F.coalesce("m", "k").alias("body"))


_IN = "l.doc_id = c.doc_id and l.page = c.page and l.x + l.w / 2.0 between c.x - {m} and c.x + c.w + {m} and l.y + l.h / 2.0 between c.y - {m} and c.y + c.h + {m}"


@query("blocks lines cells", f"select l.doc_id, l.page, l.pos, c.row_no, c.col_no from lines l join cells c on {_IN.format(m=0)}")
def c11_point_in_rectangle(v):
    return layout.lines_in_cells(v.lines, v.cells)


@query("blocks lines cells", f"select l.doc_id, l.page, l.pos, c.row_no, c.col_no from lines l join cells c on {_IN.format(m=4)}")
def c12_point_in_rectangle_margin(v):
    return layout.lines_in_cells(v.lines, v.cells, 4)


@query("blocks lines cells", f"select l.doc_id, l.pos from lines l where not exists (select 1 from cells c where c.row_no = 0 and {_IN.format(m=0)})")
def c13_outside_regions(v):
    return layout.lines_outside(v.lines, v.cells.where("row_no = 0")).select("doc_id", "pos")


@query("blocks lines cells", f"select distinct l.doc_id, l.pos from lines l where (l.doc_id, l.pos) not in (select l.doc_id, l.pos from lines l join cells c on {_IN.format(m=0)} where c.col_no = 1)")
def c14_unassigned_lines(v):
    taken = layout.lines_in_cells(v.lines, v.cells.where("col_no = 1")).select("doc_id", "pos").distinct()
    return v.lines.select("doc_id", "pos").join(taken, ["doc_id", "pos"], "left_anti")


@query("blocks lines cells", """
select l.doc_id, l.pos, c.row_no, c.col_no from lines l join cells c on l.doc_id = c.doc_id and l.page = c.page
where greatest(0, least(l.x + l.w, c.x + c.w) - greatest(l.x, c.x)) * greatest(0, least(l.y + l.h, c.y + c.h) - greatest(l.y, c.y)) > 0.15 * l.w * l.h
   or greatest(0, least(l.x + l.w, c.x + c.w) - greatest(l.x, c.x)) * greatest(0, least(l.y + l.h, c.y + c.h) - greatest(l.y, c.y)) > 0.15 * c.w * c.h""")
def c15_overlap_join(v):
    return layout.overlapping(v.lines, v.cells).select("l.doc_id", "l.pos", "c.row_no", "c.col_no")


@query("blocks lines cells", """
with p as (select t.doc_id, t.page, t.row_no, t.col_no, c.pos, t.y - (c.y + c.h) as gap, c.x as cx
  from cells t join lines c on t.doc_id = c.doc_id and t.page = c.page and t.y - (c.y + c.h) between 0 and 40
   and greatest(0, least(t.x + t.w, c.x + c.w) - greatest(t.x, c.x)) >= 0.3 * least(t.w, c.w)),
r as (select *, row_number() over (partition by doc_id, page, row_no, col_no order by gap, cx, pos) as rn from p)
select doc_id, page, row_no, col_no, pos, gap from r where rn = 1""")
def c17_nearest_above(v):
    return layout.nearest_above(v.cells, v.lines)


@query("blocks lines cells", """
with p as (select t.doc_id, t.page, t.row_no, t.col_no, c.pos, abs((t.y + t.h / 2.0) - (c.y + c.h / 2.0)) as gap from cells t join lines c on t.doc_id = c.doc_id and t.page = c.page
 where length(c.text) < 60 and least(abs(c.y - (t.y + t.h)), abs(t.y - (c.y + c.h))) <= 120),
r as (select *, row_number() over (partition by doc_id, page, row_no, col_no order by gap, pos) as rn from p)
select doc_id, page, row_no, col_no, pos from r where rn = 1""")
def c18_nearest_caption(v):
    t, c = v.cells.alias("t"), v.lines.where(F.length("text") < 60).alias("c")
    near = F.least(F.abs(F.col("c.y") - (F.col("t.y") + F.col("t.h"))), F.abs(F.col("t.y") - (F.col("c.y") + F.col("c.h")))) <= 120
    gap = F.abs((F.col("t.y") + F.col("t.h") / 2) - (F.col("c.y") + F.col("c.h") / 2))
    j = t.join(c, layout.on_page("t.", "c.") & near)
    keys = [F.col(f"t.{k}").alias(k) for k in ("doc_id", "page", "row_no", "col_no")]
    return j.groupBy(*keys).agg(F.min(F.struct(gap.alias("g"), F.col("c.pos").alias("pos"))).alias("m")).select("doc_id", "page", "row_no", "col_no", "m.pos")


@query("blocks lines", "select doc_id, pos, cast(floor(y / 240.0) as integer) as band from lines")
def c21_band_assignment(v):
    edges = F.array(*[F.lit(e) for e in range(240, 961, 240)])
    return v.lines.select("doc_id", "pos", F.size(F.filter(edges, lambda e: e <= F.col("y"))).alias("band"))


_CITES = "cites as (select doc_id, pos, doc_id * 100000 + pos as cite_id, pos * 7 % 50 as s, pos * 7 % 50 + 60 + doc_id % 30 as e from blocks)"


@query("blocks", f"""with {_CITES}, o as (select doc_id, pos, cite_id + 500 as cite_id, s + 20 as s, e + 45 as e from cites)
select a.cite_id as a_id, b.cite_id as b_id, round(sum(least(a.e, b.e) - greatest(a.s, b.s)) / greatest(1.0, least(any_value(a.e - a.s), any_value(b.e - b.s))), 6) as share
from cites a join o b on a.doc_id = b.doc_id and a.pos = b.pos and a.s < b.e and b.s < a.e group by 1, 2""")
def c22_quote_overlap(v):
    from papyra.operators.retrieval import quote_overlap

    c = v.blocks.selectExpr("doc_id", "pos as block_id", "doc_id * 100000 + pos as cite_id", "pos * 7 % 50 as start", "pos * 7 % 50 + 60 + doc_id % 30 as end")
    c = c.withColumn("quote_len", F.col("end") - F.col("start"))
    o = c.select("doc_id", "block_id", (F.col("cite_id") + 500).alias("cite_id"), (F.col("start") + 20).alias("start"), (F.col("end") + 45).alias("end")).withColumn("quote_len", F.col("end") - F.col("start"))
    return quote_overlap(c, o).select("a_id", "b_id", F.round("share", 6).alias("share"))


@query("blocks", """
with seen as (select doc_id, pos, sha256(case when doc_id % 9 = 0 then text || 'x' else text end) as h from blocks)
select s.doc_id, bool_and(s.h = sha256(b.text)) as fresh from seen s join blocks b on b.doc_id = s.doc_id and b.pos = s.pos group by s.doc_id""")
def c23_freshness(v):
    seen = v.blocks.select("doc_id", "pos", F.sha2(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("h"))
    return seen.join(v.blocks, ["doc_id", "pos"]).groupBy("doc_id").agg(F.bool_and(F.col("h") == F.sha2("text", 256)).alias("fresh"))


@query("blocks", """
with q as (select doc_id, pos, substr(text, 3, 30) as quote, sha256(case when pos % 5 = 0 then '' else text end) as h from blocks)
select q.doc_id, q.pos, case when b.text is null then 'missing' when sha256(b.text) <> q.h then 'changed' when substr(b.text, 3, 30) <> q.quote then 'quote' end as fault
from q left join (select * from blocks where doc_id % 8 <> 0) b on b.doc_id = q.doc_id and b.pos = q.pos
where b.text is null or sha256(b.text) <> q.h or substr(b.text, 3, 30) <> q.quote""")
def c24_source_faults(v):
    q = v.blocks.select("doc_id", "pos", F.substring("text", 3, 30).alias("quote"), F.sha2(F.when(F.col("pos") % 5 == 0, "").otherwise(F.col("text")), 256).alias("h"))
    j = q.join(v.blocks.where("doc_id % 8 <> 0"), ["doc_id", "pos"], "left")
    fault = F.when(F.col("text").isNull(), "missing").when(F.sha2("text", 256) != F.col("h"), "changed").when(F.substring("text", 3, 30) != F.col("quote"), "quote")
    return j.select("doc_id", "pos", fault.alias("fault")).where("fault is not null")


@query("", """
with f as (select doc_id as file_no, sha256(text) as sha, source || '-' || (doc_id % 50) as name from documents where doc_id % 5 = 0),
d as (select doc_id, sha256(text) as sha, source || '-' || (doc_id % 50) as name from documents where doc_id % 5 <> 0)
select f.file_no, min(d.doc_id) as doc_id, 'content' as reason, count(*) as n_docs from f join d on f.sha = d.sha group by 1
union all select f.file_no, min(d.doc_id), 'name', count(*) from f join d on f.name = d.name group by 1""")
def c25_import_duplicates(v):
    from papyra.operators.dedup import import_duplicates

    r = v.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.concat("source", F.lit("-"), F.col("doc_id") % 50).alias("name"))
    return import_duplicates(r.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "file_no"), r.where("doc_id % 5 <> 0"))


# --- D: aggregates -------------------------------------------------------------------------------------------------
@query("", "select count(*) as n from documents")
def d1_count(v):
    return v.documents.agg(F.count("*").alias("n"))


@query("tag_groups tags", "select g.group_id, count(t.tag_id) as n from tag_groups g left join tags t on t.group_id = g.group_id group by 1")
def d2_count_over_left_join(v):
    return v.tag_groups.join(v.tags, "group_id", "left").groupBy("group_id").agg(F.count("tag_id").alias("n"))


@query("tag_groups tags document_tags", "select g.group_id, count(distinct t.tag_id) as tags, count(distinct x.doc_id) as docs from tag_groups g left join tags t on t.group_id = g.group_id left join document_tags x on x.tag_id = t.tag_id group by 1")
def d3_two_distinct_counts(v):
    return v.tag_groups.join(v.tags, "group_id", "left").join(v.document_tags, "tag_id", "left").groupBy("group_id").agg(F.count_distinct("tag_id").alias("tags"), F.count_distinct("doc_id").alias("docs"))


@query("document_tags tags", "select distinct t.group_id, x.doc_id from document_tags x join tags t on t.tag_id = x.tag_id where t.group_id is not null")
def d4_distinct_pairs(v):
    return v.document_tags.join(v.tags.where("group_id is not null"), "tag_id").select("group_id", "doc_id").distinct()


@query("", "select source, string_agg(distinct lang, ',' order by lang) as langs from documents group by source")
def d5_group_concat_distinct(v):
    return v.documents.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("tag_groups", "select coalesce(max(order_idx), 0) + 1 as next_order from tag_groups")
def d6_next_order(v):
    return v.tag_groups.agg((F.coalesce(F.max("order_idx"), F.lit(0)) + 1).alias("next_order"))


@query("jobs", """
with a as (select doc_id, count(*) total, count(*) filter (state = 'ready') ready, count(*) filter (state = 'building') building, count(*) filter (state = 'error') failed, count(*) filter (state = 'paused') paused from jobs group by 1)
select *, case when ready = total then 'ready' when building > 0 then 'building' when failed > 0 then 'error' when paused > 0 then 'paused' else 'missing' end as overall from a""")
def d7_status_rollup(v):
    return state.rollup_state(v.jobs, "doc_id")


@query("blocks", "select t.term, count(distinct b.doc_id) as df, count(*) as blocks from blocks b join (select unnest(['the', 'license', 'und', 'que']) as term) t on contains(lower(b.text), t.term) group by 1")
def d8_document_frequency(v):
    from papyra.operators.retrieval import exploded_terms

    return exploded_terms(v.blocks, ["the", "license", "und", "que"]).groupBy("term").agg(F.count_distinct("doc_id").alias("df"), F.count("*").alias("blocks"))


@query("blocks", """
with w as (select doc_id, pos, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) as token from blocks)
select token, count(*) as frequency, count(distinct doc_id) as docs, count(distinct (doc_id, pos)) as rows from w group by token having count(distinct doc_id) >= 3""")
def d9_cooccurrence(v):
    w = v.blocks.select("doc_id", "pos", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0))).alias("token"))
    return w.groupBy("token").agg(F.count("*").alias("frequency"), F.count_distinct("doc_id").alias("docs"), F.count_distinct("doc_id", "pos").alias("rows")).where("docs >= 3")


@query("", """
with s as (select source, list(distinct lang || (n_chars % 7)) as l from documents group by source)
select a.source as a, b.source as b, round(len(list_intersect(a.l, b.l)) / cast(len(list_distinct(list_concat(a.l, b.l))) as double), 6) as jaccard from s a join s b on a.source < b.source""")
def d10_jaccard(v):
    s = v.documents.groupBy("source").agg(F.collect_set(F.concat("lang", (F.col("n_chars") % 7).cast("string"))).alias("l"))
    pairs = s.select(F.col("source").alias("a"), F.col("l").alias("x")).join(s.select(F.col("source").alias("b"), F.col("l").alias("y")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("jaccard"))


@query("blocks lines", """
with g0 as (select *, case when x - lag(x) over (partition by doc_id, page order by x, pos) > 30 then 1 else 0 end as s from lines),
g as (select *, sum(s) over (partition by doc_id, page order by x, pos rows unbounded preceding) as grp from g0),
b as (select doc_id, page, grp, count(*) n, min(x) x0, min(y) y0, max(x + w) x1, max(y + h) y1 from g group by 1, 2, 3),
r as (select *, row_number() over (partition by doc_id, page order by n desc, grp) rn from b)
select doc_id, page, n, x0, y0, x1, y1 from r where rn = 1""")
def d11_largest_group_box(v):
    return layout.body_region(v.lines)


@query("blocks lines", "select doc_id, page, median(w) as w, median(length(text)) as chars from lines group by 1, 2")
def d12_medians(v):
    return v.lines.groupBy("doc_id", "page").agg(F.median("w").alias("w"), F.median(F.length("text")).alias("chars"))


@query("blocks lines", "select doc_id, page, count(*) filter (h * 4 > w) * 2 > count(*) as vertical from lines group by 1, 2")
def d13_majority(v):
    return v.lines.groupBy("doc_id", "page").agg((F.count_if(F.col("h") * 4 > F.col("w")) * 2 > F.count("*")).alias("vertical"))


@query("blocks lines", "select doc_id, page, min(x) x0, min(y) y0, max(x + w) x1, max(y + h) y1 from lines group by 1, 2")
def d14_bounding_box(v):
    return v.lines.groupBy("doc_id", "page").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))


@query("", "select source, doc_id, n_chars, max(n_chars) over (partition by source) as best from documents")
def d15_max_per_group(v):
    best = v.documents.groupBy("source").agg(F.max("n_chars").alias("best"))
    return v.documents.select("source", "doc_id", "n_chars").join(best, "source")


@query("", """
with recursive o as (select conv_id, turn, length(text) as n, row_number() over (partition by conv_id order by turn) as rn from conversations),
f as (select conv_id, rn, turn, n <= 900 as taken, case when n <= 900 then n else 0 end as used, case when n <= 900 then 1 else 0 end as c from o where rn = 1
  union all select o.conv_id, o.rn, o.turn, f.used + o.n <= 900 and f.c < 4, case when f.used + o.n <= 900 and f.c < 4 then f.used + o.n else f.used end, case when f.used + o.n <= 900 and f.c < 4 then f.c + 1 else f.c end
  from f join o on o.conv_id = f.conv_id and o.rn = f.rn + 1)
select conv_id, turn from f where taken""")
def d16_quote_budget(v):
    from papyra.operators.retrieval import quote_budget

    return quote_budget(v.conversations.withColumn("n", F.length("text")), "conv_id", "turn", "n", 4, 900)


@query("blocks lines", """
select kind, count(*) as n from (select case
  when (y < 0.06 * 960 or y + h > 0.94 * 960) and regexp_matches(trim(text), '^[-– ]*[0-9]{1,4}[-– ]*$') then 'page_number'
  when y < 0.06 * 960 and length(trim(text)) < 40 then 'header' when y + h > 0.94 * 960 and length(trim(text)) < 40 then 'footer'
  when length(trim(text)) < 25 and not regexp_matches(trim(text), '[.!?]$') then 'heading' else 'body' end as kind from lines) group by kind""")
def d17_kind_counts(v):
    return layout.classified(v.lines).groupBy("kind").agg(F.count("*").alias("n"))


@query("", "select count(*) as files, sum(strlen(text)) as bytes, count(*) filter (n_chars > 5000) as large from documents")
def d18_backup_preview(v):
    return v.documents.agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"), F.count_if(F.col("n_chars") > 5000).alias("large"))


# --- E: ordered operators ------------------------------------------------------------------------------------------
_GAP = """with g0 as (select *, case when {c} - lag({c}) over (partition by doc_id, page order by {c}, pos) > {g} then 1 else 0 end as s from lines)
select doc_id, page, pos, cast(sum(s) over (partition by doc_id, page order by {c}, pos rows unbounded preceding) as integer) as grp from g0"""


@query("blocks lines", _GAP.format(c="x", g=30))
def e1_gap_groups_x(v):
    return layout.gap_groups(v.lines, "x", 30, order=("pos",)).select("doc_id", "page", "pos", "grp")


@query("blocks lines", _GAP.format(c="y", g=20))
def e1_gap_groups_y(v):
    return layout.gap_groups(v.lines, "y", 20, order=("pos",)).select("doc_id", "page", "pos", "grp")


@query("", """with g0 as (select *, case when date_diff('second', lag(ts) over (partition by user_id order by ts, event_id), ts) > 21600 then 1 else 0 end as s from events)
select user_id, event_id, cast(sum(s) over (partition by user_id order by ts, event_id rows unbounded preceding) as integer) as grp from g0""")
def e1_sessions(v):
    e = v.events.withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))
    return layout.gap_groups(e, "t", 21600, keys=("user_id",), order=("event_id",)).select("user_id", "event_id", "grp")


@query("blocks lines", """with g0 as (select *, case when y - lag(y) over (partition by doc_id, page order by y, pos) > 15 then 1 else 0 end as s from lines),
g as (select *, cast(sum(s) over (partition by doc_id, page order by y, pos rows unbounded preceding) as integer) as row_no from g0)
select doc_id, page, row_no, string_agg(substr(text, 1, 5), '|' order by x, pos) as cells, count(*) as n from g group by 1, 2, 3""")
def e2_row_matrix(v):
    g = layout.gap_groups(v.lines, "y", 15, order=("pos",), name="row_no")
    r = g.groupBy("doc_id", "page", "row_no").agg(F.array_sort(F.collect_list(F.struct("x", "pos", F.substring("text", 1, 5).alias("t")))).alias("c"))
    return r.select("doc_id", "page", "row_no", F.array_join(F.transform("c", lambda c: c["t"]), "|").alias("cells"), F.size("c").cast("long").alias("n"))


@query("")
def e3_running_mean(v):
    """No SQL: a recursion over all lines; a test holds it against a plain loop."""
    return layout.running_mean_clusters(v.lines, "x", 40).withColumn("mean", F.round("mean", 6))


@query("")
def e3a_thinning(v):
    """No SQL: a recursion over all lines; a test holds it against a plain loop."""
    return layout.thinned(v.lines, "y", 60)


@query("blocks headings", "select h.doc_id, h.pos, h.level, (select max(p.pos) from headings p where p.doc_id = h.doc_id and p.pos < h.pos and p.level < h.level) as parent from headings h")
def e4_heading_parents(v):
    return layout.parents(v.headings).select("doc_id", "pos", "level", "parent")


@query("blocks lines", r"""
with a as (select *, lag(page) over w as p0, lag(text) over w as t0 from lines window w as (partition by doc_id order by pos)),
b as (select *, sum(case when p0 is not null and page <> p0 and not regexp_matches(rtrim(t0), '[.!?。！？:;]$') then 0 else 1 end) over (partition by doc_id order by pos rows unbounded preceding) as para from a),
c as (select *, lead(pos) over (partition by doc_id, para order by pos) is not null and regexp_matches(trim(text), '[A-Za-z]-$') as hyphen from b)
select doc_id, cast(para as integer) as para, rtrim(string_agg(case when hyphen then regexp_replace(trim(text), '-$', '') else trim(text) || ' ' end, '' order by pos), ' ') as text from c group by 1, 2""")
def e5_cross_page_paragraphs(v):
    return layout.paragraphs(v.lines)


@query("blocks lines", "select doc_id, page, pos, pos = min(pos) over (partition by doc_id, page) as first_on_page, pos = max(pos) over (partition by doc_id, page) as last_on_page from lines")
def e6_first_last(v):
    w = Window.partitionBy("doc_id", "page")
    return v.lines.select("doc_id", "page", "pos", (F.col("pos") == F.min("pos").over(w)).alias("first_on_page"), (F.col("pos") == F.max("pos").over(w)).alias("last_on_page"))


@query("blocks headings", """
with recursive t as (select h.doc_id, h.pos, h.level, (select max(p.pos) from headings p where p.doc_id = h.doc_id and p.pos < h.pos and p.level < h.level) as parent from headings h),
r as (select doc_id, pos, cast(pos as varchar) as path from t where parent is null union all select t.doc_id, t.pos, r.path || '/' || t.pos from t join r on r.doc_id = t.doc_id and r.pos = t.parent)
select doc_id, pos, path from r""")
def e7_section_paths(v):
    return layout.section_paths(v.headings)


@query("chunks", "with r as (select lane, chunk_id, cast(row_number() over (partition by lane order by round(vector[1], 6) desc, chunk_id) as integer) as rank from chunks) select * from r where rank <= 60")
def e8_lane_rank(v):
    w = Window.partitionBy("lane").orderBy(F.desc(F.round(F.col("vector")[0].cast("double"), 6)), "chunk_id")
    return v.chunks.select("lane", "chunk_id", F.row_number().over(w).alias("rank")).where("rank <= 60")


@query("blocks", """
with s as (select doc_id, pos, length(text) as size from blocks),
r as (select *, row_number() over (order by size desc, doc_id, pos) as g, row_number() over (partition by doc_id order by size desc, pos) as d from s)
select doc_id, pos from r where g <= 96 or d <= 4""")
def e9_quota(v):
    s = v.blocks.select("doc_id", "pos", F.length("text").alias("size"))
    top = s.orderBy(F.desc("size"), "doc_id", "pos").limit(96).select("doc_id", "pos")
    per = s.withColumn("d", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size"), "pos"))).where("d <= 4").select("doc_id", "pos")
    return top.union(per).distinct()


@query("chunks", """
with p as (select chunk_id, q as variant, row_number() over (partition by q order by round(vector[q + 1], 6) desc, chunk_id) as rank, case q when 0 then 0 when 1 then 10 else 45 end as penalty from chunks cross join (select unnest([0, 1, 2]) as q)),
r as (select chunk_id, rank + penalty as rank, variant, row_number() over (partition by chunk_id order by rank + penalty, variant) as n from p where rank <= 120)
select chunk_id, rank, variant from r where n = 1""")
def e10_best_variant(v):
    from papyra.operators.retrieval import best_variant

    q = v.chunks.select("chunk_id", F.posexplode(F.slice("vector", 1, 3)).alias("variant", "s"))
    w = Window.partitionBy("variant").orderBy(F.desc(F.round(F.col("s").cast("double"), 6)), "chunk_id")
    r = q.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 120").withColumn("penalty", F.when(F.col("variant") == 0, 0).when(F.col("variant") == 1, 10).otherwise(45))
    return best_variant(r)


@query("blocks", """
select doc_id, pos, sum(length(text) + 1) over (partition by doc_id order by pos rows between 12 preceding and 1 preceding) as before, sum(length(text) + 1) over (partition by doc_id order by pos rows between 1 following and 12 following) as after from blocks""")
def e11_context_sizes(v):
    w = Window.partitionBy("doc_id").orderBy("pos")
    n = F.length("text") + 1
    return v.blocks.select("doc_id", "pos", F.sum(n).over(w.rowsBetween(-12, -1)).alias("before"), F.sum(n).over(w.rowsBetween(1, 12)).alias("after"))


@query("", """
select doc_id, cast(s as integer) as start, length(substr(text, cast(s as integer) + 1, 1000)) as size, sha256(substr(text, cast(s as integer) + 1, 1000)) as hash
from (select doc_id, text, unnest(generate_series(0, greatest(0, length(text) - 1), 840)) as s from documents) where s = 0 or s + 160 < length(text)""")
def e12_char_chunks(v):
    from papyra.operators.retrieval import char_chunks

    c = v.documents.select("doc_id", F.explode(char_chunks(F.col("text"))).alias("c"))
    return c.select("doc_id", "c.start", F.length("c.piece").alias("size"), F.sha2("c.piece", 256).alias("hash"))


@query("blocks lines", "select distinct a.doc_id, a.pos from lines a join lines b on a.doc_id = b.doc_id and a.page = b.page and a.pos <> b.pos and length(a.text) < 60 and abs(a.x - b.x) <= 5 and (abs(b.y - (a.y + a.h)) <= greatest(12, 1.6 * a.h) or abs(a.y - (b.y + b.h)) <= greatest(12, 1.6 * a.h))")
def e15_neighbour_continuation(v):
    a, b = v.lines.where(F.length("text") < 60).alias("a"), v.lines.alias("b")
    reach = F.greatest(F.lit(12), 1.6 * F.col("a.h"))
    near = (F.abs(F.col("b.y") - (F.col("a.y") + F.col("a.h"))) <= reach) | (F.abs(F.col("a.y") - (F.col("b.y") + F.col("b.h"))) <= reach)
    return a.join(b, layout.on_page("a.", "b.") & (F.col("a.pos") != F.col("b.pos")) & (F.abs(F.col("a.x") - F.col("b.x")) <= 5) & near, "left_semi").select("doc_id", "pos")


@query("blocks", """
with f as (select doc_id, pos, length(text) > 200 as flag from blocks),
g as (select *, pos - row_number() over (partition by doc_id, flag order by pos) as grp, row_number() over (partition by doc_id order by pos) - row_number() over (partition by doc_id, flag order by pos) as run from f)
select doc_id, min(pos) as first_pos, max(pos) as last_pos, count(*) as n from g where flag group by doc_id, run""")
def e17_runs(v):
    w = Window.partitionBy("doc_id").orderBy("pos")
    f = v.blocks.select("doc_id", "pos", (F.length("text") > 200).alias("flag")).withColumn("run", F.row_number().over(w) - F.row_number().over(Window.partitionBy("doc_id", "flag").orderBy("pos")))
    return f.where("flag").groupBy("doc_id", "run").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n")).drop("run")


# --- F: sorts and limits -------------------------------------------------------------------------------------------
@query("blocks lines", """
with p as (select doc_id, page, y, cast(sum(w) as bigint) as ink from lines group by 1, 2, 3),
n as (select *, coalesce(lag(ink) over w, 0) as b, coalesce(lead(ink) over w, 0) as a from p window w as (partition by doc_id, page order by y))
select doc_id, page, y, ink from n where ink > 250 and ink > b and ink >= a""")
def e16_peaks(v):
    """Peaks of the ink along y, above a quarter of the page's width of 1,000; rows are 24 apart, so none is too near."""
    ink = v.lines.groupBy("doc_id", "page", "y").agg(F.sum("w").cast("long").alias("ink"))
    return layout.peaks(ink, "y", "ink", 250)


@query("", "select doc_id, n_chars from documents order by n_chars desc nulls last, doc_id limit 20 offset 5")
def f1_sorted_page(v):
    return scope.sorted_page(v.documents, "n_chars", True, 20, 5).select("doc_id", "n_chars")


@query("", "select doc_id from documents order by source nulls first, doc_id limit 200")
def f4_clamped_limit(v):
    return scope.sorted_page(v.documents, "source", limit=scope.clamped(5000)).select("doc_id")


@query("tags", "select tag_id, group_id, cast(row_number() over (order by group_id nulls first, tag_id) as integer) as place from tags")
def f3_nulls_first(v):
    return v.tags.select("tag_id", "group_id", F.row_number().over(Window.orderBy(F.col("group_id").asc_nulls_first(), "tag_id")).alias("place"))  # a row for each tag


@query("", "select event_id, ts from events order by ts desc, event_id desc limit 50")
def f6_recency(v):
    return v.events.select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query("blocks lines", "select doc_id, page, pos, cast(row_number() over (partition by doc_id, page order by col, y, x, pos) as integer) as reading_order from (select *, case when sum(case when x + w / 2.0 <= 550 then 1 else 0 end) over p > 2 and sum(case when x + w / 2.0 <= 550 then 0 else 1 end) over p > 2 then case when x + w / 2.0 <= 550 then 0 else 1 end else 0 end as col from lines window p as (partition by doc_id, page))")
def f10_two_columns(v):
    return layout.two_columns(v.lines).select("doc_id", "page", "pos", "reading_order")


@query("", "select c_custkey, c_name, cast(row_number() over (order by c_mktsegment, c_acctbal desc, c_custkey) as integer) as place from customer qualify place <= 100")
def f14_archive_sort(v):
    top = v.customer.orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey").limit(100)
    return top.select("c_custkey", "c_name", F.row_number().over(Window.orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey")).alias("place"))  # 100 rows


# --- G: set operations ---------------------------------------------------------------------------------------------
@query("", "select doc_id from documents except select doc_id from labels where quality = 0")
def g1_difference(v):
    return v.documents.select("doc_id").exceptAll(v.labels.where("quality = 0").select("doc_id").distinct()).distinct()


@query("", "select text, min(doc_id) as first_id from documents group by text")
def g2_first_wins_distinct(v):
    """Grouped by a hash of the text, so that no text is a key; the first row of each is kept on the way."""
    g = v.documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.min(F.struct("doc_id", "text")).alias("m"))
    return g.select("m.text", F.col("m.doc_id").alias("first_id"))


@query("", """
with w as (select doc_id, unnest(string_split(text, ' ')) as term, generate_subscripts(string_split(text, ' '), 1) as i from documents),
d as (select *, row_number() over (partition by doc_id, lower(term) order by i) as n from w),
k as (select *, row_number() over (partition by doc_id order by i) as r from d where n = 1)
select doc_id, string_agg(term, ' ' order by i) as terms from k where r <= 16 group by doc_id""")
def g3_distinct_terms(v):
    return v.documents.select("doc_id", F.array_join(T.distinct_folded(F.split("text", " "), 16), " ").alias("terms"))


@query("document_tags", "select doc_id, tag_id from document_tags union all select doc_id, tag_id from (select distinct doc_id, 'src1' as tag_id from documents where doc_id % 2 = 0) n where not exists (select 1 from document_tags t where t.doc_id = n.doc_id and t.tag_id = n.tag_id)")
def g4_insert_or_ignore(v):
    return state.inserted_or_ignored(v.document_tags, v.documents.where("doc_id % 2 = 0").select("doc_id", F.lit("src1").alias("tag_id")), ["doc_id", "tag_id"])


_REGIONS = "regions as (select doc_id, page, pos as region_id, x, y, w, h from lines union all select doc_id, page, 1000000 + 10 * row_no + col_no, x, y, w, h from cells)"


@query("blocks lines cells", f"""with {_REGIONS}
select distinct a.doc_id, a.page, a.region_id from regions a join regions b on a.doc_id = b.doc_id and a.page = b.page and a.region_id <> b.region_id
 and (a.w * a.h < b.w * b.h or (a.w * a.h = b.w * b.h and a.region_id > b.region_id))
 and a.x >= b.x - 5 and a.y >= b.y - 5 and a.x + a.w <= b.x + b.w + 5 and a.y + a.h <= b.y + b.h + 5""")
def g7_contained_regions(v):
    """Regions (lines and cells) that lie in a larger one, with a margin of 5; of equal ones the first stays."""
    from papyra.functions.geometry import columns

    cells = v.cells.selectExpr("doc_id", "page", "1000000 + 10 * row_no + col_no as region_id", "x", "y", "w", "h")
    r = v.lines.selectExpr("doc_id", "page", "pos as region_id", "x", "y", "w", "h").union(cells)
    ax, ay, aw, ah = columns("a.")
    bx, by, bw, bh = columns("b.")
    larger = (aw * ah < bw * bh) | ((aw * ah == bw * bh) & (F.col("a.region_id") > F.col("b.region_id")))
    inside = (ax >= bx - 5) & (ay >= by - 5) & (ax + aw <= bx + bw + 5) & (ay + ah <= by + bh + 5)
    return r.alias("a").join(r.alias("b"), layout.on_page("a.", "b.") & (F.col("a.region_id") != F.col("b.region_id")) & larger & inside, "left_semi").select("doc_id", "page", "region_id")


@query("document_tags", """
with a as (select doc_id, list_sort(list(distinct tag_id)) as l from document_tags group by 1)
select doc_id, l = ['good', 'src1'] as same from a""")
def g11_same_scope(v):
    a = v.document_tags.groupBy("doc_id").agg(F.array_sort(F.collect_set("tag_id")).alias("l"))
    return a.select("doc_id", (F.col("l") == F.array(F.lit("good"), F.lit("src1"))).alias("same"))
