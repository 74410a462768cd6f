"""Scalar functions (SURVEY H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import geometry as G
from papyra.functions import text as T
from papyra.functions import unicode as U
from papyra.plans.registry import query


@query("blocks", "select doc_id, pos, lower(text) as low, instr(text, 'the') as at, substr(text, 2, 10) as part, length(text) as n, trim(text) as trimmed, greatest(pos, 5) as top from blocks")
def h1_basic_scalars(v):
    return v.blocks.select("doc_id", "pos", F.lower("text").alias("low"), F.instr("text", "the").alias("at"), F.substring("text", 2, 10).alias("part"), F.length("text").alias("n"), F.trim("text").alias("trimmed"), F.greatest("pos", F.lit(5)).alias("top"))


@query("blocks", """
with a as (select *, instr(lower(text), 'the') as hit from blocks)
select doc_id, pos, case when hit > 0 then substr(text, greatest(1, hit - 40), hit - greatest(1, hit - 40)) || '<mark>' || substr(text, hit, 3) || '</mark>' || substr(text, hit + 3, 40) else substr(text, 1, 80) end as snippet from a""")
def h2_snippet(v):
    return v.blocks.select("doc_id", "pos", T.snippet(F.col("text"), "the").alias("snippet"))


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("", f"select page_id, replace(replace({_ESC.format('html')}, '&lt;mark&gt;', '<mark>'), '&lt;/mark&gt;', '</mark>') as safe from pages")
def h3_sanitised_snippet(v):
    return v.pages.select("page_id", T.marked_only(F.col("html")).alias("safe"))


@query("", f"select page_id, {_ESC.format('html')} as escaped from pages")
def h4_html_escape(v):
    return v.pages.select("page_id", T.html_escaped(F.col("html")).alias("escaped"))


@query("blocks", "select doc_id, pos, array_to_string(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_.\\-]*'), ' ') as terms from blocks")
def h5_term_runs(v):
    return v.blocks.select("doc_id", "pos", F.array_join(T.term_runs(F.col("text")), " ").alias("terms"))


@query("", "select doc_id, case when len(regexp_extract_all(text, '[A-Za-z]')) >= 20 and len(regexp_extract_all(text, '[A-Za-z]')) > 4 * len(regexp_extract_all(text, '[\\x{3040}-\\x{30ff}\\x{4e00}-\\x{9fff}]')) then 'en' else 'ja' end as lane from documents")
def h6_language_lane(v):
    return v.documents.select("doc_id", T.lane(F.col("text")).alias("lane"))


@query("", "select doc_id, cast((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 as integer) as n from documents")
def h7_occurrences(v):
    return v.documents.select("doc_id", T.occurrences(F.lower("text"), "the").alias("n"))


@query("", "select doc_id, round(ln(1 + 1000.0 / (1 + n_chars)), 9) as w, round(ln(1 + cast(n_chars as double)), 9) as l from documents")
def h8_log_weights(v):
    return v.documents.select("doc_id", F.round(F.log(1 + 1000.0 / (1 + F.col("n_chars"))), 9).alias("w"), F.round(F.log1p(F.col("n_chars").cast("double")), 9).alias("l"))


@query("blocks", "select doc_id, pos, sha256(text) as hash from blocks")
def h9_sha256(v):
    return v.blocks.select("doc_id", "pos", F.sha2("text", 256).alias("hash"))


@query("", "select event_id, cast(json_extract(props, '$.k') as integer) as k from events")
def h10_json_field(v):
    return v.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("blocks", "select doc_id, pos, regexp_replace(text, '\\s+', '', 'g') as key from blocks")
def h11_spaceless_key(v):
    return v.blocks.select("doc_id", "pos", T.plain_key(F.col("text")).alias("key"))


@query("", """
with q as (select item_id, regexp_replace(text, '\\s+', '', 'g') as k from benchmark), d as (select doc_id, regexp_replace(text, '\\s+', '', 'g') as k from documents)
select q.item_id, d.doc_id from q join d on contains(d.k, q.k) where length(q.k) >= 8""")
def h12_quote_in_source(v):
    from papyra.operators.proofs import quotes_in_sources

    quotes = v.benchmark.select("item_id", F.col("text").alias("quote"))
    return quotes_in_sources(quotes, v.documents.select("doc_id", "text")).select("item_id", "doc_id")


@query("", "select page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '^.*[/\\\\]', ''), '\\.[^.]*$', ''), '[^\\p{L}\\p{N}]', '', 'g')) as key from pages")
def h13_file_key(v):
    return v.pages.select("page_id", T.file_key(F.col("url")).alias("key"))


_ACCENTS = dict(zip("éèêàüöä", "eeeauoa", strict=True))
_FORMS = U.compatibility_ideographs() | _ACCENTS


@query("", f"select doc_id, translate(text, '{''.join(_FORMS)}', '{''.join(_FORMS.values())}') as plain from documents")
def h15_character_map(v):
    """The table is the caller's; the driver's texts are Latin, so that here it holds accents."""
    return v.documents.select("doc_id", U.new_forms(F.col("text"), _ACCENTS).alias("plain"))


@query("", "select doc_id, length(regexp_replace(text, '\\s+', '', 'g')) > 0 and len(regexp_extract_all(text, '[A-Za-z0-9]')) / cast(length(regexp_replace(text, '\\s+', '', 'g')) as double) >= 0.9 as latin from documents")
def h19_mostly_latin(v):
    return v.documents.select("doc_id", T.mostly_latin(F.col("text"), 0.9).alias("latin"))


@query("", "select doc_id, replace(replace(text, 'tion', 'TION'), 'the', 'THE') as text from documents")
def h21_exact_rules(v):
    rules = [{"pattern": "the", "replacement": "THE", "type": "exact"}, {"pattern": "tion", "replacement": "TION"}, {"pattern": "zzz", "replacement": "!", "active": False}]
    return v.documents.select("doc_id", T.apply_rules(F.col("text"), rules).alias("text"))


@query("blocks", "select doc_id, pos, cast(2 * length(text) - len(regexp_extract_all(text, '[\\x00-\\x7f]')) as integer) as weight from blocks")
def h22_display_weight(v):
    return v.blocks.select("doc_id", "pos", T.display_weight(F.col("text")).alias("weight"))


@query("", r"select doc_id, regexp_replace(regexp_replace(text, '([A-Za-z])-\n([a-z])', '\1\2', 'g'), '([^\n])\n(?:([^\n])|\z)', '\1 \2', 'g') as text from documents")
def h25_unwrap(v):
    return v.documents.select("doc_id", T.unwrapped(F.col("text")).alias("text"))


@query("blocks", """
with p as (select a.doc_id, a.pos, substr(a.text, 1, 60) as x, substr(a.text, 41, 60) as y from blocks a where length(text) >= 60),
s as (select *, (select max(n) from generate_series(8, 60) g(n) where n <= least(length(x), length(y)) and right(x, cast(n as integer)) = left(y, cast(n as integer))) as n from p)
select doc_id, pos, x || case when n is null then y else substr(y, cast(n as integer) + 1) end as joined from s""")
def h26_overlap_join(v):
    p = v.blocks.where("length(text) >= 60").select("doc_id", "pos", F.substring("text", 1, 60).alias("x"), F.substring("text", 41, 60).alias("y"))
    return p.select("doc_id", "pos", T.overlap_join(F.col("x"), F.col("y")).alias("joined"))


@query("blocks", "select doc_id, pos, regexp_replace(regexp_replace('# [P3]' || text || '[^12]', '\\[P\\d+\\]', '', 'g'), '\\[\\^?(?:note|fn)?\\d+\\]', '', 'g') as t from blocks")
def h27_logical_text(v):
    raw = F.concat(F.lit("# [P3]"), "text", F.lit("[^12]"))
    return v.blocks.select("doc_id", "pos", F.regexp_replace(F.regexp_replace(raw, r"\[P\d+\]", ""), r"\[\^?(?:note|fn)?\d+\]", "").alias("t"))


@query("", "select doc_id, regexp_replace(translate('in １９' || (doc_id % 90 + 10) || '年', '０１２３４５６７８９', '0123456789'), '([12]) ?(\\d) ?(\\d) ?(\\d)', '\\1\\2\\3\\4', 'g') as t from documents")
def h29_year_token(v):
    return v.documents.select("doc_id", T.year_token(F.concat(F.lit("in １９"), (F.col("doc_id") % 90 + 10).cast("string"), F.lit("年"))).alias("t"))


@query("blocks lines cells", """
with p as (select l.doc_id, l.pos, c.row_no, c.col_no, l.w * l.h as la, c.w * c.h as ca, greatest(0, least(l.x + l.w, c.x + c.w) - greatest(l.x, c.x)) * greatest(0, least(l.y + l.h, c.y + c.h) - greatest(l.y, c.y)) as b
 from lines l join cells c on l.doc_id = c.doc_id and l.page = c.page where c.row_no = 0)
select doc_id, pos, row_no, col_no, round(greatest(b / cast(greatest(1, la + ca - b) as double), 0.85 * b / cast(greatest(1, least(la, ca)) as double)), 6) as score from p where b > 0""")
def h31_iou(v):
    from papyra.operators.layout import on_page

    j = v.lines.alias("l").join(v.cells.where("row_no = 0").alias("c"), on_page("l.", "c.") & (G.overlap_area("l.", "c.") > 0))
    return j.select("l.doc_id", "l.pos", "c.row_no", "c.col_no", F.round(G.iou_or_part("l.", "c."), 6).alias("score"))


@query("blocks lines", "select doc_id, pos, case when h > 1.5 * w then 'vertical' when w > 1.5 * h then 'horizontal' else 'square' end as orientation from lines")
def h32_orientation(v):
    return v.lines.select("doc_id", "pos", G.orientation(F.col("w"), F.col("h")).alias("orientation"))


@query("blocks", """
with t as (select doc_id, pos, case pos % 5 when 0 then 'Chapter ' || pos || ' ' || text when 1 then 'IV. ' || text when 2 then (pos % 7) || '.2 ' || text when 3 then '第三章 ' || text else text end as text from blocks)
select doc_id, pos from t where length(text) <= 60 and regexp_matches(text, '^(第[一二三四五六七八九十百0-9]+[章節部編]|\\d+(\\.\\d+)*[. ]\\S|[IVX]+\\. |Chapter \\d+|Section \\d+)') and not regexp_matches(text, '[。．.!?]$')""")
def h35_heading_patterns(v):
    """Blocks with headings' openings put before four of five."""
    n = F.col("pos") % 5
    text = F.when(n == 0, F.concat(F.lit("Chapter "), "pos", F.lit(" "), "text")).when(n == 1, F.concat(F.lit("IV. "), "text")).when(n == 2, F.concat(F.col("pos") % 7, F.lit(".2 "), "text")).when(n == 3, F.concat(F.lit("第三章 "), "text")).otherwise(F.col("text"))
    return v.blocks.select("doc_id", "pos", text.alias("text")).where(T.heading_like(F.col("text"))).select("doc_id", "pos")


@query("blocks lines", "select doc_id, pos, round(0.8 * x - 0.1 * y + 3, 6) as px, round(0.1 * x + 0.9 * y - 2, 6) as py from lines")
def h36_affine(v):
    x, y = F.col("x"), F.col("y")
    return v.lines.select("doc_id", "pos", F.round(0.8 * x - 0.1 * y + 3, 6).alias("px"), F.round(0.1 * x + 0.9 * y - 2, 6).alias("py"))


@query("blocks lines", "select doc_id, pos, cast(least(999, greatest(0, x * 1000 // 1000)) as integer) as nx, cast(least(999, greatest(0, floor(y * 1000 / 960.0))) as integer) as ny from lines")
def h37_normalised_box(v):
    return v.lines.select("doc_id", "pos", G.scaled(F.col("x"), F.lit(1000)).alias("nx"), G.scaled(F.col("y"), F.lit(960)).alias("ny"))


@query("blocks lines", "select a.doc_id, a.pos, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) as shared from lines a join lines b on a.doc_id = b.doc_id and a.page = b.page and b.pos = a.pos + 1")
def h38_interval_overlap(v):
    a, b = v.lines.alias("a"), v.lines.alias("b")
    from papyra.operators.layout import on_page

    shared = G.overlap_1d(F.col("a.x"), F.col("a.x") + F.col("a.w"), F.col("b.x"), F.col("b.x") + F.col("b.w"))
    return a.join(b, on_page("a.", "b.") & (F.col("b.pos") == F.col("a.pos") + 1)).select("a.doc_id", "a.pos", shared.alias("shared"))


@query("", "select page_id, regexp_replace(url, '^https?://([^/]+)/.*$', '\\1') as host, url like 'https://%' as secure from pages")
def h39_url_parts(v):
    return v.pages.select("page_id", F.regexp_replace("url", "^https?://([^/]+)/.*$", "$1").alias("host"), F.col("url").like("https://%").alias("secure"))


@query("", "select page_id, substr(regexp_replace(regexp_replace(url, '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '[. ]+$', ''), 1, 120) as stem from pages")
def h41_safe_stem(v):
    return v.pages.select("page_id", T.safe_stem(F.col("url")).alias("stem"))


@query("", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso from events")
def h42_iso_time(v):
    return v.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("", "select doc_id, '| ' || replace(source, '|', '\\|') || ' | ' || lang || ' | ' || replace(replace(substr(text, 1, 30), '|', '\\|'), chr(10), '<br>') || ' |' as row from documents")
def h45_markdown_row(v):
    return v.documents.select("doc_id", T.markdown_row(F.array("source", "lang", F.substring("text", 1, 30))).alias("row"))
