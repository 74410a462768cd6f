"""Retrieval, layout, state and incremental operators (SURVEY I to L), and extensions on events and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.operators import layout, state
from papyra.operators import retrieval as R
from papyra.plans.registry import query

TERMS = ["the", "license", "und", "que", "tion"]
_TF = "cast((length(lower(b.text)) - length(replace(lower(b.text), t.term, ''))) / length(t.term) as integer)"
_HITS = f"""facts as (select greatest(1.0, coalesce(avg(length(text)), 0)) as mean from blocks),
hits as (select doc_id, pos, term, tf, -tf / (tf + 1.2 * (1 - 0.75 + 0.75 * n / mean)) as score from
 (select b.doc_id, b.pos, t.term, length(b.text) as n, {_TF} as tf from blocks b cross join (select unnest({TERMS}) as term) t) cross join facts where tf > 0)"""


@query("blocks", f"with {_HITS} select doc_id, pos, term, tf, round(score, 9) as score from hits")
def i5_lexical_hits(v):
    return R.lexical_hits(v.blocks, TERMS).withColumn("score", F.round("score", 9))


@query("blocks", f"""with {_HITS}, q as (select *, round(score, 9) as s from hits),
r as (select *, row_number() over (partition by term order by s, doc_id, pos) as rank, row_number() over (partition by term, doc_id order by s, pos) as doc_rank from q)
select doc_id, pos, term from r where rank <= 96 or doc_rank <= 4""")
def i5_quota(v):
    return R.with_quota(R.lexical_hits(v.blocks, TERMS).withColumn("score", F.round("score", 9))).select("doc_id", "pos", "term")


@query("blocks", f"""with {_HITS}, d as (select term, count(distinct doc_id) as df from hits group by term)
select term, df, round(ln(1 + ((select count(*) from documents) + 1) / cast(df + 1 as double)) * case when term = 'the' then 0.12 else 1 end, 9) as weight from d""")
def i6_term_weights(v):
    return R.term_weights(R.lexical_hits(v.blocks, TERMS), v.documents.count(), ("the",)).withColumn("weight", F.round("weight", 9))


@query("blocks", """select doc_id, pos, round(case when instr(lower(text), 'license') > 0 then 2.0 when instr(lower(text), 'licence') > 0 or instr(lower(text), 'copyright') > 0 then 1.7 else 0.0 end + case when instr(lower(text), 'the') > 0 then 0.3 else 0.0 end, 6) as relevance,
cast(instr(lower(text), 'license') > 0 or instr(lower(text), 'licence') > 0 or instr(lower(text), 'copyright') > 0 as integer) + cast(instr(lower(text), 'the') > 0 as integer) as coverage from blocks""")
def i7_relevance(v):
    out = R.relevance(v.blocks, [("license", 2.0, ["licence", "copyright"]), ("the", 0.3, [])])
    return out.select("doc_id", "pos", F.round("relevance", 6).alias("relevance"), "coverage")


_BM = """facts as (select count(*) as n, avg(greatest(0, length(text) - 2)) as mean, count(*) filter (instr(lower(text), 'license') > 0) as df from blocks),
hits as (select doc_id, pos, text, -greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(0, length(text) - 2) / greatest(1.0, mean))) as score
 from (select *, (length(lower(text)) - length(replace(lower(text), 'license', ''))) / 7.0 as tf from blocks where instr(lower(text), 'license') > 0) cross join facts)"""


@query("blocks", f"with {_BM} select doc_id, pos, round(score, 9) as score from hits")
def p13_bm25(v):
    return R.bm25(v.blocks, "license").select("doc_id", "pos", F.round("score", 9).alias("score"))


@query("blocks", f"with {_BM} select doc_id, pos, round(score, 7) as score from hits order by round(score, 7), doc_id, pos limit 20")
def i1_block_search(v):
    hits = R.bm25(v.blocks, "license").withColumn("score", F.round("score", 7))
    return hits.orderBy("score", "doc_id", "pos").limit(20).select("doc_id", "pos", "score")


@query("blocks", """with a as (select *, instr(lower(text), 'ä') as hit from blocks where instr(lower(text), 'ä') > 0)
select doc_id, pos, substr(text, greatest(1, hit - 40), hit - greatest(1, hit - 40)) || '<mark>' || substr(text, hit, 1) || '</mark>' || substr(text, hit + 1, 40) as snippet from a order by doc_id, pos limit 50""")
def i2_global_search_short(v):
    return R.global_search(v.blocks, "Ä", 50)


@query("blocks", """with syn as (select unnest(['license', 'licence', 'copyright']) as term)
select distinct b.doc_id, b.pos from blocks b join syn on contains(lower(b.text), syn.term) order by 1, 2 limit 100""")
def i3_keyword_synonyms(v):
    return R.exploded_terms(v.blocks, ["license", "licence", "copyright"]).select("doc_id", "pos").distinct().orderBy("doc_id", "pos").limit(100)


_Q = "(select chunk_id as query_id, vector as q from chunks where chunk_id % 100 = 7)"


@query("chunks", f"""with s as (select query_id, lane, chunk_id, doc_id, round(list_sum(list_transform(generate_series(1, len(vector)), lambda i: cast(q[i] as double) * cast(vector[i] as double))), 6) as score from chunks cross join {_Q}),
r as (select *, cast(row_number() over (partition by query_id, lane order by score desc, chunk_id) as integer) as language_rank from s)
select query_id, lane, chunk_id, doc_id, score, language_rank from r where language_rank <= 10""")
def i10_dense_top_k(v):
    q = v.chunks.where("chunk_id % 100 = 7").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("q"))
    return R.dense_top_k(v.chunks, q, 10)


@query("", """
with a as (select doc_id as id, row_number() over (order by n_chars desc, doc_id) as rank from documents qualify rank <= 60),
b as (select doc_id as id, row_number() over (order by doc_id * 7919 % 1009, doc_id) as rank from documents qualify rank <= 120)
select id, round(sum(1.0 / (60 + rank)), 9) as fusion from (select * from a union all select * from b) group by id""")
def i11_fusion(v):
    def ranked(order, n):
        top = v.documents.select(F.col("doc_id").alias("id"), "n_chars").orderBy(*order).limit(n)
        return top.select("id", F.row_number().over(Window.orderBy(*[o for o in order])).alias("rank"))  # n rows

    a = ranked([F.desc("n_chars"), F.col("id")], 60)
    b = ranked([F.col("id") * 7919 % 1009, F.col("id")], 120)
    return R.reciprocal_rank_fusion(a, b).withColumn("fusion", F.round("fusion", 9))


@query("", """with r as (select o_custkey as doc_id, o_orderkey as item, 1.0 / (60 + o_orderkey % 97) as fusion, (o_orderkey % 11) / 11.0 as topic from orders)
select doc_id, item, round(fusion * (0.3 + 0.7 * topic) + 0.020 * topic + 0.006 * max(topic) over (partition by doc_id), 9) as relevance from r""")
def i13_final_relevance(v):
    r = v.orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("item"), (1.0 / (60 + F.col("o_orderkey") % 97)).alias("fusion"), (F.col("o_orderkey") % 11 / 11.0).alias("topic"))
    return R.final_relevance(r).select("doc_id", "item", F.round("relevance", 9).alias("relevance"))


@query("")
def i8_diversified_pick(v):
    """No SQL: a greedy choice; tests hold it against a plain loop."""
    return R.diversified(v.orders.select(F.col("o_orderpriority").alias("query_id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("score")), 32)


@query("blocks", "select cast(row_number() over (partition by doc_id order by pos) as integer) as cite_no, doc_id, pos, substr(text, 1, 120) as context, '[' || row_number() over (partition by doc_id order by pos) || '] ' || substr(text, 1, 120) as line from blocks where contains(lower(text), 'license')")
def i19_citations(v):
    """Citations of one document each, numbered in it."""
    hits = v.blocks.where(F.contains(F.lower("text"), F.lit("license")))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return hits.select(n.alias("cite_no"), "doc_id", "pos", F.substring("text", 1, 120).alias("context")).withColumn("line", F.concat(F.lit("["), "cite_no", F.lit("] "), "context"))


@query("", """with picked as (select doc_id as quote_id from documents where doc_id % 50 = 0 union all select -1)
select p.quote_id, d.source, d.doc_id is not null as known from picked p left join documents d on d.doc_id = p.quote_id""")
def i21_quote_restoration(v):
    p = v.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("quote_id")).union(v.spark.sql("select -1L"))
    d = v.documents.select("doc_id", "source")
    return p.join(d, F.col("quote_id") == F.col("doc_id"), "left").select("quote_id", "source", F.col("doc_id").isNotNull().alias("known"))


@query("", """with a as (select conv_id as answer_id, case when conv_id % 3 = 0 then 'answered' else 'insufficient' end as status, count(*) filter (role <> 'user') as paragraphs from conversations group by conv_id),
e as (select conv_id as answer_id, case when conv_id % 7 = 0 then -1 else conv_id end as source_id, case when conv_id % 5 = 0 then 'ab c' when conv_id % 4 = 0 then substr(text, 2, 40) || '#' else substr(text, 2, 40) end as quote from conversations where turn = 0),
s as (select conv_id as source_id, text from conversations where turn = 0)
select answer_id, 'no paragraphs' as fault from a where status = 'answered' and paragraphs = 0
union all select answer_id, 'unexpected paragraphs' from a where status <> 'answered' and paragraphs > 0
union all select answer_id, fault from (select e.answer_id, case when s.text is null then 'unknown source' when length(regexp_replace(quote, '\\s+', '', 'g')) < 8 then 'short quote' when not contains(regexp_replace(s.text, '\\s+', '', 'g'), regexp_replace(quote, '\\s+', '', 'g')) then 'unfounded quote' end as fault from e left join s on s.source_id = e.source_id) where fault is not null""")
def i22_answer_faults(v):
    from papyra.operators.proofs import answer_faults

    a = v.conversations.groupBy(F.col("conv_id").alias("answer_id")).agg(F.count_if(F.col("role") != "user").alias("paragraphs")).withColumn("status", F.when(F.col("answer_id") % 3 == 0, "answered").otherwise("insufficient"))
    first = v.conversations.where("turn = 0")
    part = F.substring("text", 2, 40)
    e = first.select(F.col("conv_id").alias("answer_id"), F.when(F.col("conv_id") % 7 == 0, -1).otherwise(F.col("conv_id")).alias("source_id"), F.when(F.col("conv_id") % 5 == 0, "ab c").when(F.col("conv_id") % 4 == 0, F.concat(part, F.lit("#"))).otherwise(part).alias("quote"))
    return answer_faults(a, e, first.select(F.col("conv_id").alias("source_id"), "text"))


@query("", """select c.conv_id, c.turn, substr(p.text, 1, 500) as question, substr(c.text, 1, 1500) as answer from conversations c join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1 where c.role <> 'user' and p.role = 'user'""")
def i23_follow_up_context(v):
    c, p = v.conversations.alias("c"), v.conversations.alias("p")
    j = c.join(p, (F.col("c.conv_id") == F.col("p.conv_id")) & (F.col("p.turn") == F.col("c.turn") - 1)).where("c.role <> 'user' and p.role = 'user'")
    return j.select("c.conv_id", "c.turn", F.substring("p.text", 1, 500).alias("question"), F.substring("c.text", 1, 1500).alias("answer"))


@query("", "select doc_id, 'According to ' || source || ': ' || substr(text, 1, 100) as answer from documents")
def i24_extractive_answer(v):
    return v.documents.select("doc_id", F.concat(F.lit("According to "), "source", F.lit(": "), F.substring("text", 1, 100)).alias("answer"))


@query("tag_groups tags document_tags", """
select g.group_id, g.name, count(distinct t.tag_id) as tags, count(distinct x.doc_id) as docs, coalesce(string_agg(distinct t.tag_id, ',' order by t.tag_id), '') as members
from tag_groups g left join tags t on t.group_id = g.group_id left join document_tags x on x.tag_id = t.tag_id group by 1, 2""")
def i25_catalogue(v):
    j = v.tag_groups.join(v.tags, "group_id", "left").join(v.document_tags, "tag_id", "left")
    return j.groupBy("group_id", "name").agg(F.count_distinct("tag_id").alias("tags"), F.count_distinct("doc_id").alias("docs"), F.array_join(F.array_sort(F.collect_set("tag_id")), ",").alias("members"))


@query("", "select source, doc_id // 1000 as part, string_agg('- ' || doc_id || ' (' || lang || ')', chr(10) order by doc_id) as briefing from documents group by 1, 2")
def i26_briefing(v):
    """A source's documents as lists of up to a thousand numbers each, so that no row grows with the source."""
    line = F.concat(F.lit("- "), F.col("doc_id").cast("string"), F.lit(" ("), "lang", F.lit(")"))
    g = v.documents.groupBy("source", F.expr("doc_id div 1000").alias("part")).agg(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("l")))).alias("r"))
    return g.select("source", "part", F.array_join(F.transform("r", lambda x: x["l"]), "\n").alias("briefing"))


@query("blocks", """with seen as (select doc_id, pos, sha256(case when pos % 6 = 0 then text || '!' else text end) as h from blocks)
select s.doc_id, s.pos, case when b.text is null then 'deleted' when sha256(b.text) <> s.h then 'changed' else 'current' end as state from seen s left join (select * from blocks where doc_id % 9 <> 4) b on b.doc_id = s.doc_id and b.pos = s.pos""")
def i27_source_state(v):
    seen = v.blocks.select("doc_id", "pos", F.sha2(F.when(F.col("pos") % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    j = seen.join(v.blocks.where("doc_id % 9 <> 4"), ["doc_id", "pos"], "left")
    return j.select("doc_id", "pos", F.when(F.col("text").isNull(), "deleted").when(F.sha2("text", 256) != F.col("h"), "changed").otherwise("current").alias("state"))


# --- J -------------------------------------------------------------------------------------------------------------
@query("blocks lines", """with xs as (select doc_id, page, x, row_number() over (partition by doc_id, page order by x) - 1 as col_no, lead(x) over (partition by doc_id, page order by x) - x as w from (select distinct doc_id, page, x from lines)),
ys as (select doc_id, page, y, row_number() over (partition by doc_id, page order by y) - 1 as row_no, lead(y) over (partition by doc_id, page order by y) - y as h from (select distinct doc_id, page, y from lines where pos % 4 = 0))
select xs.doc_id, xs.page, cast(row_no as integer) as row_no, cast(col_no as integer) as col_no, x, y, w, h from xs join ys on xs.doc_id = ys.doc_id and xs.page = ys.page where w is not null and h is not null""")
def j1_cell_lattice(v):
    return layout.lattice(v.lines.select("doc_id", "page", "x"), v.lines.where("pos % 4 = 0").select("doc_id", "page", "y"))


@query("blocks lines cells", f"""with a as (select l.doc_id, l.page, l.pos, l.text, c.row_no, c.col_no from lines l join cells c on l.doc_id = c.doc_id and l.page = c.page and l.x + l.w / 2.0 between c.x and c.x + c.w and l.y + l.h / 2.0 between c.y and c.y + c.h)
select doc_id, page, row_no, col_no, string_agg(substr(text, 1, 8), '/' order by pos) as text, count(*) as n from a group by 1, 2, 3, 4""")
def j3_cell_texts(v):
    hit = layout.lines_in_cells(v.lines, v.cells).join(v.lines.select("doc_id", "pos", F.substring("text", 1, 8).alias("t")), ["doc_id", "pos"])
    g = hit.groupBy("doc_id", "page", "row_no", "col_no").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("r"))
    return g.select("doc_id", "page", "row_no", "col_no", F.array_join(F.transform("r", lambda x: x["t"]), "/").alias("text"), F.size("r").cast("long").alias("n"))


@query("blocks lines cells", """select c.doc_id, c.page, count(*) as cells, count(distinct row_no) as rows, count(distinct col_no) as cols, min(x) as x0, min(y) as y0, max(x + w) as x1, max(y + h) as y1 from cells c group by 1, 2""")
def j2_table_regions(v):
    return v.cells.groupBy("doc_id", "page").agg(F.count("*").alias("cells"), F.count_distinct("row_no").alias("rows"), F.count_distinct("col_no").alias("cols"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))


@query("blocks lines cells", """select c.doc_id, c.page, c.row_no, c.col_no, coalesce(bool_or(abs(l.x - c.x) <= 40), false) as left_side, coalesce(bool_or(abs(l.x + l.w - (c.x + c.w)) <= 40), false) as right_side, coalesce(bool_or(abs(l.y - c.y) <= 20), false) as top_side, coalesce(bool_or(abs(l.y + l.h - (c.y + c.h)) <= 20), false) as bottom_side
from cells c left join lines l on l.doc_id = c.doc_id and l.page = c.page and l.x + l.w / 2.0 between c.x and c.x + c.w and l.y + l.h / 2.0 between c.y and c.y + c.h group by 1, 2, 3, 4""")
def j4_border_sides(v):
    l, c = v.lines.alias("l"), v.cells.alias("c")
    from papyra.functions.geometry import centre_in

    j = c.join(l, layout.on_page("l.", "c.") & centre_in("l.", "c."), "left")
    side = lambda e, n: F.coalesce(F.bool_or(F.abs(F.expr(e)) <= n), F.lit(False))
    return j.groupBy("c.doc_id", "c.page", "c.row_no", "c.col_no").agg(side("l.x - c.x", 40).alias("left_side"), side("l.x + l.w - (c.x + c.w)", 40).alias("right_side"), side("l.y - c.y", 20).alias("top_side"), side("l.y + l.h - (c.y + c.h)", 20).alias("bottom_side"))


@query("blocks lines", """with k as (select *, case
  when (y < 0.06 * 960 or y + h > 0.94 * 960) and regexp_matches(trim(text), '^[-– ]*[0-9]{1,4}[-– ]*$') then 'page_number'
  when y < 0.06 * 960 and length(trim(text)) < 40 then 'header' when y + h > 0.94 * 960 and length(trim(text)) < 40 then 'footer'
  when length(trim(text)) < 25 and not regexp_matches(trim(text), '[.!?]$') then 'heading' else 'body' end as kind from lines)
select doc_id, page, string_agg(cast(pos as varchar), ',' order by case when x + w / 2.0 <= 550 then 0 else 1 end, y, x, pos) as body_order from k where kind in ('heading', 'body') group by 1, 2""")
def j5_page_layout(v):
    body = layout.classified(v.lines).where("kind in ('heading', 'body')").withColumn("side", F.when(F.col("x") + F.col("w") / 2 <= 550, 0).otherwise(1))
    g = body.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("side", "y", "x", "pos"))).alias("r"))
    return g.select("doc_id", "page", F.array_join(F.transform("r", lambda r: r["pos"].cast("string")), ",").alias("body_order"))


@query("blocks lines", "select doc_id, pos, case when length(text) <= 30 and w < 300 then 30 when length(text) <= 50 then 50 else 100 end as recogniser from lines")
def j17_recogniser_route(v):
    return v.lines.select("doc_id", "pos", F.when((F.length("text") <= 30) & (F.col("w") < 300), 30).when(F.length("text") <= 50, 50).otherwise(100).alias("recogniser"))


# --- K, L ----------------------------------------------------------------------------------------------------------
@query("", "select doc_id, source, 'old' as version from documents where doc_id % 3 <> 0 union all select doc_id, upper(source), 'new' from documents where doc_id % 3 = 0")
def k1_upsert(v):
    old = v.documents.select("doc_id", "source", F.lit("old").alias("version"))
    new = v.documents.where("doc_id % 3 = 0").select("doc_id", F.upper("source").alias("source"), F.lit("new").alias("version"))
    return state.upserted(old, new, "doc_id")


@query("tags", "select w.name from (select unnest(['SRC1', 'fresh', 'Good']) as name) w where lower(w.name) in (select lower(tag_id) from tags)")
def k3_name_conflicts(v):
    return state.name_conflicts(v.tags.withColumnRenamed("tag_id", "name"), v.spark.createDataFrame([("SRC1",), ("fresh",), ("Good",)], "name string"))


@query("tags", "select tag_id, case when group_id = 'g1' then null else group_id end as group_id from tags")
def k3d_delete_group(v):
    return v.tags.select("tag_id", F.when(~F.col("group_id").eqNullSafe("g1"), F.col("group_id")).alias("group_id"))


@query("tags tag_groups", "select g.group_id, g.name, string_agg(t.tag_id, ',' order by t.tag_id) as tags from tag_groups g left join tags t on t.group_id = g.group_id group by 1, 2 union all select null, 'unassigned', string_agg(tag_id, ',' order by tag_id) from tags where group_id is null")
def k3e_list_groups(v):
    names = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_list(c)), ","), F.lit(""))
    inside = v.tag_groups.join(v.tags, "group_id", "left").groupBy("group_id", "name").agg(names("tag_id").alias("tags"))
    return inside.union(v.tags.where("group_id is null").agg(names("tag_id").alias("tags")).select(F.lit(None).cast("string"), F.lit("unassigned"), "tags"))


@query("document_tags", "select d.doc_id, t.tag_id from (select doc_id from documents where doc_id % 6 = 0) d cross join (select unnest(['src2', 'good', 'extra']) as tag_id) t where not exists (select 1 from document_tags x where x.doc_id = d.doc_id and x.tag_id = t.tag_id)")
def k4_bulk_assignment(v):
    return state.assigned(v.documents.where("doc_id % 6 = 0"), ["src2", "good", "extra"], v.document_tags)


@query("document_tags", "select doc_id, tag_id from document_tags where not (tag_id = 'good' and doc_id % 4 = 0)")
def k4b_bulk_removal(v):
    return v.document_tags.join(v.documents.where("doc_id % 4 = 0").select("doc_id", F.lit("good").alias("tag_id")), ["doc_id", "tag_id"], "left_anti")


@query("document_tags tags", "select t.tag_id, case when t.tag_id in (select tag_id from document_tags where doc_id % 97 = 1) then 'g3' else t.group_id end as group_id from tags t")
def k4c_regroup(v):
    chosen = v.document_tags.where("doc_id % 97 = 1").select("tag_id").distinct().withColumn("hit", F.lit(True))
    return v.tags.join(chosen, "tag_id", "left").select("tag_id", F.when(F.col("hit"), "g3").otherwise(F.col("group_id")).alias("group_id"))


@query("blocks", "select doc_id, pos from blocks where doc_id not in (select doc_id from documents where source = 'src0')")
def k5_cascade_delete(v):
    return state.cascade(v.blocks.select("doc_id", "pos"), v.documents.where("source = 'src0'"), "doc_id")


@query("", "select user_id, max_by(event_type, (ts, event_id)) as state, max(ts) as ts from events group by user_id")
def k6_latest_version(v):
    return state.latest(v.events.select("user_id", "ts", "event_id", F.col("event_type").alias("state")), "user_id", ["ts", "event_id"]).select("user_id", "state", "ts")


@query("", """select n.doc_id, case when s.doc_id is null then 'created' when s.lang = n.lang then 'returned' else 'conflict' end as result
from (select doc_id, case when doc_id % 10 = 0 then 'xx' else lang end as lang from documents where doc_id % 2 = 0) n left join (select doc_id, lang from documents where doc_id % 3 = 0) s on s.doc_id = n.doc_id""")
def k7_idempotent_create(v):
    n = v.documents.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "xx").otherwise(F.col("lang")).alias("asked"))
    s = v.documents.where("doc_id % 3 = 0").select("doc_id", "lang", F.lit(True).alias("known"))
    return n.join(s, "doc_id", "left").select("doc_id", F.when(F.col("known").isNull(), "created").when(F.col("lang") == F.col("asked"), "returned").otherwise("conflict").alias("result"))


@query("jobs", "select event_id, case when state in ('queued', 'building') then 'paused' else state end as state from jobs")
def k8_conditional_transition(v):
    return state.changed_state(v.jobs, ["queued", "building"], "paused").select("event_id", "state")


@query("jobs", "select event_id, case when state in ('building') then 'interrupted' else state end as state from jobs")
def k9_restart_recovery(v):
    return state.changed_state(v.jobs, ["building"], "interrupted").select("event_id", "state")


@query("jobs", "with w as (select *, row_number() over (partition by doc_id order by event_id) as r from jobs where state in ('queued', 'building')) select event_id, doc_id from w where r = 1 order by event_id limit 3")
def k10_admission(v):
    return state.admissions(v.jobs, ["queued", "building"]).select("event_id", "doc_id")


@query("", """select a.doc_id, min(b.doc_id) as found from documents a join documents b on b.doc_id < a.doc_id and (b.text = a.text or (b.source = a.source and b.n_chars = a.n_chars and b.lang = a.lang)) group by 1""")
def k13_unchanged_lookup(v):
    d = v.documents.select("doc_id", F.sha2("text", 256).alias("h"), F.concat_ws("/", "source", "n_chars", "lang").alias("p"))
    out = None
    for key in ("h", "p"):
        b = d.select(F.col("doc_id").alias("found"), key)
        first = b.groupBy(key).agg(F.min("found").alias("found"))
        hit = d.join(first, key).where("found < doc_id").select("doc_id", "found")
        out = hit if out is None else out.union(hit)
    return out.groupBy("doc_id").agg(F.min("found").alias("found"))


@query("blocks", """select doc_id, pos, sha256(text) as chunk_id from blocks where doc_id % 2 = 0 or sha256(text) in (select sha256(text) from blocks where doc_id % 2 = 0)""")
def l1_incremental_index(v):
    from papyra.streaming.incremental import index_batch

    rows = v.blocks.select("doc_id", "pos", F.sha2("text", 256).alias("chunk_id"))
    index = rows.where("doc_id % 2 = 0")
    known = index.select("chunk_id").distinct()
    return index_batch(index, rows.where("doc_id % 2 <> 0").join(known, "chunk_id", "left_semi"), "doc_id").select("doc_id", "pos", "chunk_id")


@query("jobs", "select doc_id, max_by(state, (ts, event_id)) as state from jobs group by doc_id")
def l2_state_machine(v):
    return state.latest(v.jobs, "doc_id", ["ts", "event_id"]).select("doc_id", "state")


@query("blocks", "select doc_id, pos, text from blocks where doc_id % 5 <> 0 union all select doc_id, pos, '#' || text from blocks where doc_id % 5 = 0")
def l5_trigger_maintenance(v):
    from papyra.streaming.incremental import replace_keys

    changed = v.blocks.where("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("#"), "text"))
    return replace_keys(v.blocks, changed, ["doc_id", "pos"])


@query("blocks", "select doc_id, pos from blocks where doc_id not in (select doc_id from labels where toxic = 1)")
def l6_deletion_propagation(v):
    return state.cascade(v.blocks.select("doc_id", "pos"), v.labels.where("toxic = 1"), "doc_id")


# --- extensions ----------------------------------------------------------------------------------------------------
@query("", "select time_bucket(interval '1 day', ts) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def x1_tumbling_window(v):
    w = v.events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("", "select n_name, l_returnflag, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where l_shipdate >= timestamp '1995-01-01' group by 1, 2")
def x2_star_join(v):
    j = v.lineitem.where("l_shipdate >= timestamp_ntz '1995-01-01'").join(v.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(v.customer, F.col("c_custkey") == F.col("o_custkey")).join(v.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy("n_name", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
