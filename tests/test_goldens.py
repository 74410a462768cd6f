"""Operators that SQL cannot say: small tables written by hand."""

import io
import math
import random
import re
import time
import unicodedata
import zipfile
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.functions import unicode as U
from papyra.operators import evidence, hybrid, layout, pages, retrieval
from papyra.operators.dedup import similar_names
from papyra.plans import q_more, q_retrieval
from papyra.sources import archives, manifest
from papyra.sources import pages as P
from papyra.sources import sinks


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("r")).first()[0]


@pytest.mark.parametrize("question,want", [
    ("「海軍 の歴史」と コンピューター について IBM-360 とは the ibm-360", ["海軍 の歴史", "コンピューター", "IBM-360", "the"]), ("資料の比較「a\nb」ヴァイオリン", ["a", "b", "ヴァイオリン"]),
    ("", []), ("ひらがなだけ", []), ('"two words" and Two', ["two words", "and", "Two"]),
])
def test_query_terms(question, want):
    assert retrieval.query_terms(question) == want


def test_query_terms_limit():
    assert len(retrieval.query_terms(" ".join(f"w{i}" for i in range(40)))) == 16


@pytest.mark.parametrize("fn,text,want", [
    (T.cjk_tight, "日 本 語 。 abc def", "日本語。 abc def"),
    (T.unlooped, "ああああああ", "あ"), (T.unlooped, "これはこれはこれはこれは終わり", "これは終わり"), (T.unlooped, "1000000 0.3333333", "1000000 0.3333333"), (T.unlooped, "1, 2, 3, 4", "1, 2, 3, 4"),
    (T.symbol_loop, "……………………………", True), (T.symbol_loop, "text … more", False),
    (T.unwrapped, "an inter-\nesting line\nand more\n\nnew", "an interesting line and more\n\nnew"),
    (T.year_token, "１ ９ ８ ４ 年と 2 0 2 0 年", "1984 年と 2020 年"),
    (T.safe_stem, "CON", "_CON"), (T.safe_stem, 'a<b>:"c"/d. ', "a_b___c__d"), (T.safe_stem, "...", "document"),
    (T.file_key, "C:\\x\\My Report-Final.v2.PDF", "myreportfinalv2"), (T.lane, "あいうえお ABC", "ja"), (T.mostly_latin, "", False),
    (T.logical_text, "# 見出し\n本文[P3]です[^12]。\x07", "見出し\n本文です。"),
    (T.marked_only, "<b>x</b> <mark>y</mark>", "&lt;b&gt;x&lt;/b&gt; <mark>y</mark>"),
])
def test_text(spark, fn, text, want):
    assert one(spark, fn, text) == want


@pytest.mark.parametrize("text,want", [
    (None, None), ("", ""), ("  静かな 夜 ", "静かな 夜"),
    ("本ああああ棚", "本あ棚"), ("三三三三年", "三三三三年"), ("1000000", "1000000"),
    ("前書き！！！！！後は消える\n次", "前書き"), ("年一一一一一！", "年一一一一一！"),
    ("これはこれはこれはこれは終わり", "これは終わり"), ("第1第1第1です", "第1第1第1です"), ("あ1xyxyxy1xyxyxy1xyxyxyあ", "あ1xyxyxy1xyxyxy1xyxyxyあ"),
    ("だがプーチンは、だがプーチンは、来た", "だがプーチンは、来た"),
    ("山 the the the the end", "山 the end"), ("山 " + "characteristically " * 4 + "end", "山"), ("山 v1 v1 v1 v1 終", "山 v1 v1 v1 v1 終"),
    ("[田中 2005al. 参照", "[田中 2005a]. 参照"), ("[田中 1997l. 参照", "[田中 1997]. 参照"),
    ("値0.000.0です", "値です"), ("値 3.5 です", "値  です"), ("{集合}$", "集合"),
    ("( 0 ( - ( - ( ) ( - ( ) ( - (", ""), ("12) 項目", "12) 項目"), ("12項目", "項目"), ("--項目", "項目"), ("項目12", "項目"),
    ("終わり...次", "終わり。次"), ("noise and more noise", ""), ("short", "short"), ("日本 and more noise", "日本 and more noise"),
])
def test_clean_line(spark, text, want):
    assert one(spark, T.clean_line, text) == want


def test_clean_line_keeps(spark):
    assert one(spark, lambda c: T.clean_line(c, keep_edge_numbers=True), "12項目34") == "12項目34"
    assert one(spark, lambda c: T.clean_line(c, drop_latin_noise=False), "noise and more noise") == "noise and more noise"


@pytest.mark.parametrize("fn,text,want", [
    (T.clean_read, "本！！！棚", "本！棚"), (T.clean_read, "一一一年 555", "一一一年 555"), (T.clean_read, "1 -- 22222 ----- x", "1 -- 22222 - x"),
    (T.clean_read, "山 the the the end", "山"), (T.clean_read, "山 v1 v1 v1 終", "山 v1 v1 v1 終"), (T.clean_read, "どうもどうもどうも終", "どうも終"), (T.clean_read, "ababab1ababab1ababab1x", "ababab1ababab1ababab1x"), (T.clean_read, "2005al.", "2005a]."), (T.clean_read, None, None),
    (T.clean_region, "頁 00000 後\n次", "頁 00000 後\n次"), (T.clean_region, "頁 00000 後", "頁"), (T.clean_region, "山 v1 v1 v1 v1 終", "山"), (T.clean_region, "1997l. x", "1997]. x"), (T.clean_region, "", ""),
])
def test_clean_variants(spark, fn, text, want):
    assert one(spark, fn, text) == want


def test_new_forms(spark):
    new = lambda c: U.new_forms(c, {"國": "国", "海": "海", "欄": "欄"})
    assert one(spark, new, "國と\uf91d\ufa45と\uf95d") == "国と欄海と" + unicodedata.normalize("NFKC", "\uf95d")
    assert one(spark, new, None) is None and one(spark, new, "") == ""


def test_joined_cell(spark):
    r = spark.sql("select array('東京','都','ABC','def','5','円') as p").select(T.joined_cell(F.col("p"))).first()[0]
    assert r == "東京都ABC def 5円"


def test_rules(spark):
    rules = [{"pattern": "日本", "replacement": "JP"}, {"pattern": "日本海", "replacement": "JS"}, {"pattern": r"(\d)号", "replacement": "No.$1", "type": "regex"}, {"pattern": "x", "replacement": "y", "active": False}]
    assert one(spark, lambda c: T.apply_rules(c, rules), "日本海と日本の3号x") == "JSとJPのNo.3x"
    assert [r["pattern"] for r in P.dictionary_rules('{"exact": {"a": "b", "abc": "d"}, "rules": [{"pattern": "zz", "active": false}]}')] == ["abc", "a"]


def page(rows):
    return pd.DataFrame([dict(zip(("pos", "x", "y", "w", "h", "text", "confidence", "pass_no"), (*r, *("", 1.0, 0)[len(r) - 5 :]), strict=True)) for r in rows])


def test_reading_orders():
    columns = page([(0, 100, 10, 20, 200), (1, 200, 10, 20, 200), (2, 202, 300, 20, 100), (3, 100, 300, 20, 100)])
    assert pages.vertical_order(columns)["pos"].tolist() == [1, 2, 0, 3]
    rows = page([(0, 300, 12, 50, 20), (1, 10, 10, 50, 20), (2, 10, 60, 50, 20)])
    assert pages.horizontal_order(rows)["pos"].tolist() == [1, 0, 2] == pages.margin_order(rows)["pos"].tolist()
    two = page([(0, 0, 0, 400, 20), (1, 0, 40, 180, 20), (2, 220, 40, 180, 20), (3, 0, 64, 180, 20), (4, 220, 64, 180, 20)])
    assert pages.xy_cut(two)["pos"].tolist() == [0, 1, 3, 2, 4]
    zig = page([(0, 0, 0, 10, 10), (1, 0, 200, 10, 10), (2, 0, 100, 10, 10), (3, 0, 300, 10, 10)]).assign(reading_order=[1, 2, 3, 4])
    assert pages.smoothed_order(zig)["pos"].tolist() == [0, 2, 1, 3]


def test_duplicate_reads():
    two = page([(0, 0, 0, 100, 20, "hello world", 0.5, 0), (1, 2, 1, 100, 20, "hello world", 0.9, 1), (2, 0, 60, 100, 20, "next", 0.8, 0)])
    assert pages.adjacent_deduplicated(two)["pos"].tolist() == [1, 2]
    assert pages.suppressed(two)["pos"].tolist() == [1, 2]
    assert pages.fused_passes(two)["text"].tolist() == ["hello world", "next"]
    assert pages.same_read("abcdefgh", "xx abcdezgh yy") and not pages.same_read("abcdefgh", "zzzzzzzzzz")


def test_groups():
    p = page([(0, 0, 0, 50, 10), (1, 0, 12, 50, 10), (2, 0, 80, 50, 10), (3, 52, 80, 50, 10)])
    assert pages.band_groups(p)["band"].tolist() == [0, 0, 1, 1]
    assert pages.seed_groups(p)["seed_group"].tolist() == [0, 1, 2, 2]
    assert pages.clusters([0, 10, 25, 100], 20) == [0, 0, 0, 1]


def test_quotes():
    text = "あ" * 100 + "。" + "い" * 400 + "終わり"
    parts = pages.split_quotes(text)
    assert "".join(parts) == text and len(parts[0]) == 101 and all(len(p) <= 408 for p in parts)
    assert pages.realigned("helo wOrld", ["hello ", "world"]) == ["helo ", "wOrld"] and pages.realigned("", ["a"]) == [""]
    assert pages.in_polygon(1, 1, [(0, 0), (2, 0), (2, 2), (0, 2)]) and not pages.in_polygon(3, 1, [(0, 0), (2, 0), (2, 2), (0, 2)])


def test_evidence_windows():
    text = "x" * 2000 + "needle" + "y" * 2000 + "needle"
    found = evidence.evidence_windows(text, [("needle", 2.0, [])])
    assert 1 <= len(found) <= 3 and all("needle" in text[a:b] for a, b in found)
    assert evidence.evidence_windows("", [("needle", 2.0, [])]) == []
    # the last window is short: half of the shorter one counts
    assert evidence.evidence_windows("a" * 300 + "needle", [("needle", 1.0, [])]) == [(0, 306)]


@pytest.mark.parametrize("seed", range(6))
def test_evidence_windows_against_a_plain_loop(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["naval ", "NAVY ", "fleet ", "活動 ", "x" * r.randint(1, 300) + " "]) for _ in range(60))
    groups = [("naval", 2.0, ["navy"]), ("fleet", 1.0, []), ("活動", 0.3, [])]
    low, starts = text.lower(), set()
    for w in ("naval", "navy", "fleet"):
        for p in [m.start() for m in re.finditer(w, low)][:64]:
            starts |= {max(0, p - 240), max(0, p - 880)}

    def value(a):
        part = low[a : a + 1000]
        return sum(g[1] * (1 if g[0] in part else 0.85 if any(x in part for x in g[2]) else 0) for g in groups)

    want = []
    for a in sorted(starts, key=lambda a: (-value(a), a)):
        b = min(len(text), a + 1000)
        shared = [max(0, min(b, d) - max(a, c)) / min(b - a, d - c) for c, d in want]
        if len(want) < 3 and max(shared, default=0) < 0.5:
            want.append((a, b))
    assert evidence.evidence_windows(text, groups) == want


def argmax_choice(rows, limit, per_doc, per_section, slot, share):
    """The choice by its definition: the worth of every row, again for every place."""
    rest, out = list(range(len(rows))), []
    while rest and len(out) < limit:
        value = {i: rows[i]["relevance"] / (1 + per_doc * sum(rows[j]["doc_id"] == rows[i]["doc_id"] for j in out) + per_section * sum((rows[j]["doc_id"], rows[j]["section"]) == (rows[i]["doc_id"], rows[i]["section"]) for j in out)) for i in rest}
        order = sorted(rest, key=lambda i: (-value[i], i))
        if slot and len(out) % slot == slot - 1:
            order = [i for i in order if rows[i]["lane"] == "en" and value[i] >= share * value[order[0]]][:1] or order
        rest.remove(order[0])
        if all(evidence.shared_part(rows[order[0]], rows[j]) < 0.5 for j in out):
            out.append(order[0])
    return out


@pytest.mark.parametrize("seed", range(8))
def test_greedy_against_a_plain_loop(seed):
    r = random.Random(seed)
    rows = [{"doc_id": r.randrange(5), "section": r.choice("ab"), "lane": r.choice(["en", "ja"]), "block": r.randrange(12), "start": (a := r.randrange(80)), "end": a + 40, "relevance": r.choice([r.random(), 0.5])} for _ in range(120)]
    got = evidence.greedy(rows, 32, 0.04, 0.30, 4, 0.85, evidence.half_shared)
    assert got == argmax_choice(rows, 32, 0.04, 0.30, 4, 0.85)
    assert evidence.greedy(rows, 50, 0.12) == argmax_choice([{**x, "block": i} for i, x in enumerate(rows)], 50, 0.12, 0, 0, 1)


def test_diversified(spark):
    rows = [("q", d, i, s) for i, (d, s) in enumerate([("a", 1.0), ("a", 0.99), ("b", 0.9), ("a", 0.95), ("c", 0.5)])]
    got = retrieval.diversified(spark.createDataFrame(rows, "query_id string, doc_id string, item int, score double"), 4).orderBy("place").collect()
    assert [r.item for r in got] == [0, 2, 1, 3]


def hot_orders(spark):
    """One customer holds the 600 dearest orders."""
    rows = [(i, 1 if i < 600 else i % 50 + 2, "OF"[i % 2], 2000.0 - i, "1-URGENT") for i in range(1000)]
    return SimpleNamespace(orders=spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"))


def test_diversified_hot_document(spark):
    v = hot_orders(spark)
    left, used, want = [(r.o_totalprice, r.o_orderkey, r.o_custkey) for r in v.orders.collect()], {}, []
    while len(want) < 32:
        best = min(left, key=lambda r: (-r[0] / (1 + 0.12 * used.get(r[2], 0)), r[1]))
        left.remove(best)
        want.append(best[1])
        used[best[2]] = used.get(best[2], 0) + 1
    got = q_retrieval.i8_diversified_pick(v).orderBy("place").collect()
    assert [r.item for r in got] == want and len(used) > 1


def test_final_greedy_hot_document(spark):
    v = hot_orders(spark)
    rows = [{"doc_id": r.o_custkey, "section": r.o_orderstatus, "block": r.o_orderkey, "start": 0, "end": 100, "lane": "ja" if r.o_orderkey % 2 else "en", "relevance": r.o_totalprice} for r in v.orders.collect()]
    rows.sort(key=lambda c: (-c["relevance"], c["doc_id"], c["block"]))
    want = [rows[i] for i in argmax_choice(rows, 32, 0.04, 0.30, 4, 0.85)]
    got = q_more.i14_final_greedy(v).orderBy("place").collect()
    assert [r.block for r in got] == [c["block"] for c in want] and len({c["doc_id"] for c in want}) > 1


def test_dense_top_k_in_blocks(spark):
    rows = [(i, i % 7, "ab"[i % 2], [float(i % 13), float(i % 5), 1.0]) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, lane string, vector array<float>")
    queries = chunks.selectExpr("chunk_id as query_id", "vector as q")
    one, many = retrieval.dense_top_k(chunks, queries, 3), retrieval.dense_top_k(chunks, queries, 3, most_queries=7)
    assert one.count() == 60 * 2 * 3 and sorted(one.collect()) == sorted(many.collect())


def test_citations_and_contexts_of_all_hits(spark):
    v = SimpleNamespace(blocks=spark.range(2100).selectExpr("id div 10 as doc_id", "cast(id % 10 as int) as pos", "'License ' || id as text"))
    assert q_retrieval.i19_citations(v).count() == q_more.i18_context_expansion(v).count() == 2100


def test_folded_key_of_a_whole_text(spark):
    v = SimpleNamespace(documents=spark.createDataFrame([(1, "x" * 300 + "a"), (2, "x" * 300 + "b")], "doc_id long, text string"))
    assert q_more.h30_folded_key(v).select("key").distinct().count() == 2


def test_similar_names(spark):
    f = spark.createDataFrame([(1, "annualreport2020final"), (2, "short")], "file_no long, key string")
    d = spark.createDataFrame([(10, "annualreport2020fina1"), (11, "annualreport1999draft"), (12, "short")], "doc_id long, key string")
    assert [(r.file_no, r.doc_id) for r in similar_names(f, d).collect()] == [(1, 10)]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def docx():
    body = (
        '<w:p><w:pPr><w:pStyle w:val="Mine"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>'
        '<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t xml:space="preserve"> &amp; plain</w:t></w:r><w:r><w:footnoteReference w:id="2"/></w:r></w:p>'
        "<w:p><mc:AlternateContent><mc:Choice><w:r><w:t>box</w:t></w:r></mc:Choice><mc:Fallback><w:r><w:t>old</w:t></w:r></mc:Fallback></mc:AlternateContent></w:p>"
        '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc></w:tr>'
        '<w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr>'
        "<w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    )
    styles = f'<w:styles {W}><w:style w:styleId="Mine"><w:basedOn w:val="H1"/></w:style><w:style w:styleId="H1"><w:name w:val="heading 1"/><w:basedOn w:val="Mine"/></w:style></w:styles>'
    notes = f'<w:footnotes {W}><w:footnote w:id="0" w:type="separator"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>a note</w:t></w:r></w:p></w:footnote><w:footnote w:id="3"><w:p><w:r><w:t>unused</w:t></w:r></w:p></w:footnote></w:footnotes>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", styles)
        z.writestr("word/footnotes.xml", notes)
    return out.getvalue()


def test_docx_links_and_marks():
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    cell = lambda t, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr><w:p>{run(t)}</w:p><w:p>{run('+')}</w:p></w:tc>"
    merge = '<w:gridSpan w:val="2"/><w:vMerge/>'
    body = (
        f'<w:p><w:pPr><w:pStyle w:val="T"/></w:pPr>{run("Name")}</w:p><w:p><w:pPr><w:pStyle w:val="見出し 8"/></w:pPr>{run("Deep")}</w:p>'
        f'<w:p><w:pPr><w:pStyle w:val="T"/><w:outlineLvl w:val="9"/></w:pPr>{run("Body")}</w:p><w:p><w:pPr><w:pStyle w:val="Plain"/></w:pPr>{run("Text")}</w:p>'
        f'<w:p><w:bookmarkStart w:id="1" w:name="_GoBack"/><w:bookmarkStart w:id="2" w:name="here"/><w:hyperlink r:id="x">{run("out")}</w:hyperlink>'
        f'<w:hyperlink w:anchor="here">{run("in")}</w:hyperlink><w:fldSimple w:instr=" HYPERLINK &quot;http://f/&quot; ">{run("field")}</w:fldSimple>'
        f'<w:fldSimple w:instr="PAGE">{run("7")}</w:fldSimple><w:r><w:sym w:char="00A7"/><w:sym w:char="D800"/><w:sym w:char="x"/></w:r></w:p>'
        f"<w:tbl><w:tr>{cell('a', merge.replace('/><w:vMerge/', '/><w:vMerge w:val=\"restart\"/'))}{cell('b')}</w:tr><w:tr>{cell('', merge)}{cell('c')}</w:tr>"
        f"<w:tr>{cell('d', '<w:vMerge/>')}{cell('e')}{cell('f')}</w:tr></w:tbl>"
    )
    styles = '<w:style w:styleId="T"><w:name w:val="Title"/></w:style><w:style w:styleId="見出し 8"/><w:style w:styleId="Plain"><w:basedOn w:val="T"/><w:pPr><w:outlineLvl w:val="9"/></w:pPr></w:style>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W} {r}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="x" Target="http://o/?a&amp;b"/></Relationships>')
    rows = archives.blocks_of("x.docx", out.getvalue())
    assert [r[2:5] for r in rows] == [("heading", 1, "Name"), ("heading", 6, "Deep"), ("paragraph", None, "Body"), ("paragraph", None, "Text"), ("paragraph", None, "outinfield7§"), ("table", None, "a +\t\tb +\n\t\tc +\nd +\te +\tf +")]
    assert rows[4][5] == '<span id="here"></span><a href="http://o/?a&amp;b">out</a><a href="#here">in</a><a href="http://f/">field</a>7§'
    assert [tuple(c.values()) for c in rows[5][8]] == [(0, 0, 2, 2), (0, 2, 1, 1), (1, 2, 1, 1), (2, 0, 1, 1), (2, 1, 1, 1), (2, 2, 1, 1)]


def test_archives(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx())
    (tmp_path / "b.odt").write_bytes(archives.odt_bytes([("heading", 2, "H & M"), ("paragraph", None, "text")]))
    (tmp_path / "c.docx").write_bytes(b"no archive")
    (tmp_path / "d.docx").write_bytes(archives.docx_bytes([("heading", 3, "Deep"), ("paragraph", None, "x < y")]))
    rows = archives.read_archives(spark, str(tmp_path)).orderBy("path", "pos").collect()
    got = {n: [(r.kind, r.level, r.text) for r in rows if r.path.endswith(n)] for n in ("a.docx", "b.odt", "c.docx", "d.docx")}
    assert got["a.docx"] == [("heading", 1, "Title"), ("paragraph", None, "bold & plain【脚注2】"), ("paragraph", None, "box"), ("table", None, "wide\t\na\tb\n\tc"), ("note", None, "a note")]
    assert next(r.html for r in rows if r.text == "bold & plain【脚注2】").startswith("<strong>bold</strong> &amp; plain")
    assert next(r.grid for r in rows if r.kind == "table") == [["wide", ""], ["a", "b"], ["", "c"]]
    assert next([tuple(c) for c in r.spans] for r in rows if r.kind == "table") == [(0, 0, 1, 2), (1, 0, 2, 1), (1, 1, 1, 1), (2, 1, 1, 1)]
    assert got["b.odt"] == [("heading", 2, "H & M"), ("paragraph", None, "text")] and got["c.docx"] == [("error", None, "not a zip archive")] and got["d.docx"] == [("heading", 3, "Deep"), ("paragraph", None, "x < y")]
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r.path[-6:]: r.fault for r in P.guarded(files).collect()} == {"a.docx": None, "/b.odt": None, "c.docx": "first bytes", "d.docx": None}
    assert archives.zip_fault(docx(), most=10) == "expands beyond the limit"


def test_manifest(spark, tmp_path):
    (tmp_path / "t" / "s").mkdir(parents=True)
    (tmp_path / "t" / "s" / "x.txt").write_text("abc")
    rows = manifest.read_tree(spark, str(tmp_path / "t"))
    assert [(r.path, r.size) for r in rows.collect()] == [("s/x.txt", 3)] and manifest.faults(rows, rows).count() == 0
    assert manifest.faults(rows.withColumn("size", F.lit(4).cast("long")), rows).first().fault == "changed"


def test_pages(spark, tmp_path):
    body = '{"page_number": %s, "ocr_lines": [{"x": 1, "y": 2, "w": 3, "h": 4, "text": "t", "confidence": 0.9}], "footnotes": [{"text": "n"}, {"id": "k", "text": "m"}], "figures": [{"id": "f", "path": "p"}]}'
    for b, p, n in (("b1", "page_001", "null"), ("b1", "page_002", "7"), ("b2", "page_1", "1")):
        d = tmp_path / b / p
        d.mkdir(parents=True)
        (d / "page_data.json").write_text(body % n)
    got = P.read_batches(spark, str(tmp_path))
    assert sorted((r.batch, r.page) for r in got.collect()) == [("b1", 1), ("b1", 7), ("b2", 1)]
    assert P.page_lines(got).count() == 3 and P.page_figures(got, 2).count() == 1
    assert sorted({r.note_id for r in P.footnote_catalogue(got).where("batch = 'b2'").collect()}) == ["k", "note-1-1"]
    P.write_pages(got.drop("path"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


@pytest.mark.parametrize("text", [
    '{"contents": [[{"boundingBox": [[1,2],[4,2],[4,6],[1,6]], "text": "a"}]]}', '[{"x": 1, "y": 2, "w": 3, "h": 4, "text": "a"}]',
    '{"results": [{"bbox": [1, 2, 4, 6], "text": "a"}]}', '{"blocks": [{"x": 1, "y": 2, "width": 3, "height": 4, "text": "a"}]}', '{"x": 1, "y": 2, "w": 3, "h": 4, "text": "a"}',
])
def test_recognised_lines(spark, text):
    r = one(spark, P.recognised_lines, text)
    assert [(x.x, x.y, x.w, x.h, x.text) for x in r] == [(1, 2, 3, 4, "a")]


def test_layout_xml(spark, tmp_path):
    (tmp_path / "l.xml").write_text('<OCRDATASET><PAGE IMAGENAME="p1"><LINE X="1" Y="2" WIDTH="3" HEIGHT="4" STRING="a" ORDER="5"/><LINE X="1" Y="9" WIDTH="3" HEIGHT="4" STRING="b"/></PAGE></OCRDATASET>')
    assert [(r.page, r.pos, r.x, r.text) for r in P.read_layout_xml(spark, str(tmp_path / "l.xml")).orderBy("y").collect()] == [("p1", 5, 1, "a"), ("p1", 1, 1, "b")]


def test_sinks(spark, tmp_path):
    b = spark.createDataFrame([(1, 0, "T"), (1, 1, "a < b")], "doc_id long, pos int, text string")
    h = spark.createDataFrame([(1, 0, 2)], "doc_id long, pos int, level int")
    assert sinks.documents_of(sinks.markdown_lines(b, h), "md").first().md == "## T\n\na < b"
    assert sinks.documents_of(sinks.html_lines(b, h), "html", "\n").first().html == "<h2>T</h2>\n<p>a &lt; b</p>"
    sinks.write_markdown(b, h, str(tmp_path / "md"))
    f = archives.exported(b.withColumn("kind", F.lit("paragraph")).withColumn("level", F.lit(None).cast("int"))).first()
    assert [r[4] for r in archives.blocks_of("x.odt", bytes(f.content))] == ["T", "a < b"]


def test_paragraph_hyphens(spark):
    rows = [(1, 0, 0, "an inter-"), (1, 1, 1, "esting page"), (1, 2, 1, "new one.")]
    got = layout.paragraphs(spark.createDataFrame(rows, "doc_id long, pos int, page int, text string")).orderBy("para").collect()
    assert [r.text for r in got] == ["an interesting page", "new one."]


def test_context_stays_on_its_page_and_section(spark):
    rows = [(1, i, f"{i}" * 200, i // 6, "s" if i < 9 else "t") for i in range(14)]
    b = spark.createDataFrame(rows, "doc_id long, pos int, text string, page int, section string")
    hits = spark.createDataFrame([(1, p, 10, 20) for p in (0, 5, 6, 8, 9)], "doc_id long, pos int, start int, end int")
    got = {r.pos: [s.pos for s in r.segments] for r in evidence.expanded(b, hits).collect()}
    assert got == {0: [0, 1, 2, 3, 4, 5], 5: [2, 3, 4, 5], 6: [6, 7, 8], 8: [6, 7, 8], 9: [9, 10, 11]}
    quote, segments, prefix, suffix = evidence.in_context([], "一文目。二文目" + "あ" * 700 + "。針" + "い" * 2500 + "。終", [], 708, 709)
    assert quote.startswith("二文目") is False and "針" in quote and prefix and suffix and segments[0][0] == 0 and segments[0][2] - segments[0][1] == len(quote)


def corpus(spark):
    long = "海 " * 800
    rows = [
        (1, 0, "スーパーコンピューターの利用", "a"), (1, 1, long + "コンピューターの歴史を述べる。" + long, "a"), (1, 2, "ほかの話", "b"),
        (2, 0, "ここでコンピューター、そして歴史。", "a"), (2, 1, "歴史だけ", "a"), (3, 0, "nothing", "a"), (4, 0, "The computer history of the navy is told here in plain words.", "a"),
    ]
    return spark.createDataFrame(rows, "doc_id long, pos int, text string, section string")


def test_search(spark):
    b = corpus(spark)
    groups = hybrid.lexical_groups(b, "スーパーコンピューターの歴史と利用", 4)
    assert [(t, a) for t, _, a in groups] == [("スーパーコンピューター", ["コンピューター"]), ("歴史", []), ("利用", [])]
    weight = {t: w for t, w, _ in groups}
    assert abs(weight["利用"] - 0.12 * math.log(1 + 5 / 2)) < 1e-9 and abs(weight["歴史"] - math.log(1 + 5 / 3)) < 1e-9
    assert hybrid.lexical_groups(b, "「スーパーコンピューター」", 4)[0][2] == []
    found = hybrid.search(b, "スーパーコンピューターの歴史", 4).orderBy("place").collect()
    assert {r.doc_id for r in found} == {1, 2} and all("歴史" in r.quote or "コンピューター" in r.quote for r in found)
    deep = [r for r in found if r.doc_id == 1 and r.block == 1]
    assert deep and all(r.start > 0 for r in deep)  # a hit after the first thousand characters is cited where it stands
    semantic = spark.createDataFrame([(4, 0, 0, 20, 1, "en"), (2, 0, 0, 5, 2, "ja")], "doc_id long, block int, start int, end int, rank int, lane string")
    both = hybrid.search(b, "スーパーコンピューターの歴史", 4, semantic, english=["computer history"], extra=["computer", "history"]).collect()
    assert {r.doc_id for r in both} == {1, 2, 4}
    one, two = ({(r.doc_id, r.block): r.relevance for r in x} for x in (found, both))
    assert two[(2, 0)] > one[(2, 0)]  # found by both
    changed = b.withColumn("text", F.when(F.col("doc_id") == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    assert {r.doc_id for r in hybrid.search(b, "スーパーコンピューターの歴史", 4, current=changed).collect()} == {1}
    assert hybrid.search(b, "", 4).count() == 0


def test_hybrid_search_choice_is_the_plain_one(spark, monkeypatch):
    """The registered query against the choice by definition over the same judged candidates."""
    from papyra.plans.views import Views

    seen = []
    real = hybrid.pick_evidence
    monkeypatch.setattr(hybrid, "pick_evidence", lambda c, limit=32: (seen.append(c), real(c, limit))[1])
    got = q_more.i5_hybrid_search(Views(spark, "/root/testdata/sf0.001")).orderBy("place").collect()
    rows = [r.asDict() for r in seen[0].collect()]
    rows.sort(key=lambda c: (-c["relevance"], c["doc_id"], c["block"], c["start"]))
    want = [rows[i] for i in argmax_choice(rows, 32, 0.04, 0.30, 4, 0.85)]
    assert [(r.doc_id, r.block, r.start) for r in got] == [(c["doc_id"], c["block"], c["start"]) for c in want] and len(got) > 3


def test_related_terms(spark):
    rows = [(d, p, f"海軍の艦隊司令部と連合艦隊 三月十五日 {'造船業界' if d < 3 else ''}") for d in range(4) for p in range(2)]
    b = spark.createDataFrame(rows, "doc_id long, pos int, text string")
    got = hybrid.related_terms(b, [("海軍", 2.0, []), ("司令", 1.0, [])], 4)
    assert "造船業界" in got and not any("三月" in t for t in got) and len(got) <= 3


def _name_ratio(a, b):
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


def test_similar_names_against_all_pairs(spark):
    r = random.Random(4)
    names = [f"customer#{r.randrange(3000):09d}"[: r.choice([16, 17, 18])] for _ in range(60)]
    for n in list(names[:20]):
        k = r.randrange(len(n))
        names += [n[:k] + n[k + 1 :], n[:k] + "x" + n[k:], n[:k] + "xy" + n[k:]]
    names += ["the quarterly report of the naval office of 1911", "the quarterly report of the naval office of 1912", "short", "reports1", "reports1"]
    df = spark.createDataFrame(list(enumerate(names)), "n long, key string")
    got = {(x.file_no, x.doc_id) for x in similar_names(df.withColumnRenamed("n", "file_no"), df.withColumnRenamed("n", "doc_id")).collect()}
    want = {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if min(len(a), len(b)) >= 8 and _name_ratio(a, b) >= 0.94}
    assert got == want and len(want) > 2 * len(names)


def test_clusters_and_thinning_against_plain_loops(spark):
    r = random.Random(2)
    rows = [(d, p, d % 2, r.randrange(400), r.randrange(900)) for d in range(6) for p in range(r.randint(1, 30))]
    df = spark.createDataFrame(rows, "doc_id long, pos int, page int, x int, y int")
    means, kept = set(), set()
    for d in range(6):
        page = d % 2
        clusters = []
        for x in sorted(row[3] for row in rows if row[0] == d):
            if clusters and abs(x - sum(clusters[-1]) / len(clusters[-1])) <= 40:
                clusters[-1].append(x)
            else:
                clusters.append([x])
        means |= {(d, page, i, round(sum(c) / len(c), 6), len(c)) for i, c in enumerate(clusters)}
        last = None
        for y in sorted(row[4] for row in rows if row[0] == d):
            if last is None or y - last > 60:
                kept.add((d, page, y))
                last = y
    got = layout.running_mean_clusters(df, "x", 40).select("doc_id", "page", "cluster", F.round("mean", 6), "members").collect()
    assert {tuple(x) for x in got} == means
    assert {tuple(x) for x in layout.thinned(df, "y", 60).select("doc_id", "page", "y").collect()} == kept


def test_section_paths_of_any_depth(spark):
    levels = [1, 2, 3, 4, 5, 3, 2, 6, 1, 4, 2]
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(levels)], "doc_id long, pos int, level int")
    got = {x.pos: x.path for x in layout.section_paths(df).collect()}
    assert got == {0: "0", 1: "0/1", 2: "0/1/2", 3: "0/1/2/3", 4: "0/1/2/3/4", 5: "0/1/5", 6: "0/6", 7: "0/6/7", 8: "8", 9: "8/9", 10: "8/10"}


def test_peaks(spark):
    ink = [5, 9, 9, 2, 30, 31, 4, 4, 40, 3, 3, 3, 3, 3, 3, 3, 3, 12]
    df = spark.createDataFrame([(1, 0, i, v) for i, v in enumerate(ink)], "doc_id long, page int, at int, ink int")
    assert sorted((r["at"], r["ink"]) for r in layout.peaks(df, "at", "ink", 8.0, 1).collect()) == [(1, 9), (5, 31), (8, 40), (17, 12)]
    assert sorted(r["at"] for r in layout.peaks(df, "at", "ink", 8.0, 7).collect()) == [1, 8, 17]


def test_similar_names_of_a_series_are_not_broadcast(spark):
    """What keys are cut to is merged, however small the tables look; repeated names are compared once."""
    f = spark.range(40).selectExpr("id as file_no", "concat('customer#', lpad(id % 20, 9, '0')) as key")
    got = similar_names(f, f.withColumnRenamed("file_no", "doc_id"))
    assert not re.search(r"BroadcastHashJoin \[[^\]]*(part|piece)#", got._jdf.queryExecution().executedPlan().toString())
    names = [f"customer#{i % 20:09d}" for i in range(40)]
    want = sorted((i, j) for i, a in enumerate(names) for j, b in enumerate(names) if _name_ratio(a, b) >= 0.94)
    assert sorted((x.file_no, x.doc_id) for x in got.collect()) == want


def test_text_functions_work_once_over_long_texts(spark):
    """The work grows with the text: no pattern looks at the rest of a line from each place, no step is worked out again for
    each use of its result."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(6)) for _ in range(40_000)]
    df = spark.createDataFrame([(" ".join(words) + " ab ab ab ab",)], "text string")
    began = time.monotonic()
    got = df.select(F.array_join(T.distinct_folded(F.split("text", " "), 16), " ").alias("t"), T.unlooped(F.col("text")).alias("u")).first()
    assert got.t == " ".join(list(dict.fromkeys(words))[:16]) and got.u.startswith(words[0]) and got.u.endswith(" ab") and not got.u.endswith("ab ab")
    assert time.monotonic() - began < 25
    assert df.select(T.clean_line(F.col("text")))._jdf.queryExecution().analyzed().toString().count("regexp_replace(") < 40


def test_pages_are_streamed_not_handed_over_one_by_one(spark):
    """Pages of any length over small batches, a null document among them; only the needed columns are shuffled."""
    r = random.Random(5)
    rows = [(d, p, k, k % 2 * 500, 24 * k, r.randrange(100, 480), 20, "text") for d in (None, 1, 2, 3) for p in range(3) for k in range(r.choice([1, 7, 60]))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, page int, pos int, x int, y int, w int, h int, text string").repartition(3)
    out = pages.per_page(df, pages.xy_cut, "doc_id long, page int, pos int, reading_order int", ("x", "y", "w", "h"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "text" not in plan.split("Exchange")[0]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = sorted((x.doc_id or -1, x.page, x.reading_order, x.pos) for x in out.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    frame = pd.DataFrame(rows, columns=df.columns).fillna({"doc_id": -1}).sort_values("pos")
    want = sorted((int(d), p, o.reading_order, o.pos) for (d, p), g in frame.groupby(["doc_id", "page"]) for o in pages.xy_cut(g).itertuples())
    assert got == want and len(got) == len(rows)


def test_dense_top_k_scores_in_arrays(spark):
    """All pairs against a plain cross join: equal vectors, near scores, and vectors that have no usual score."""
    r = random.Random(6)
    vectors = [[r.choice([0.1, 0.25, 0.7, -0.3]) for _ in range(4)] for _ in range(150)] + [[0.7, 0.7, 0.7, 0.7]] * 40
    vectors += [None, [0.1, 0.2], [0.1, None, 0.3, 0.4], [float("nan"), 0.1, 0.2, 0.3], [float("inf"), 0.1, 0.2, 0.3], []]
    chunks = spark.createDataFrame([(i, i % 7, "ab"[i % 2], v) for i, v in enumerate(vectors)], "chunk_id long, doc_id long, lane string, vector array<float>")
    queries = chunks.where("chunk_id % 9 = 0 or chunk_id >= 190").selectExpr("chunk_id as query_id", "vector as q")
    got = retrieval.dense_top_k(chunks, queries, 5)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    scored = chunks.crossJoin(queries).select("query_id", "lane", "chunk_id", "doc_id", F.round(retrieval.dot(F.col("q"), F.col("vector")), 6).alias("score"))
    want = scored.withColumn("language_rank", F.expr("row_number() over (partition by query_id, lane order by score desc, chunk_id)")).where("language_rank <= 5")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == queries.count() * 10


def test_contexts_of_a_long_document_in_one_shuffle(spark):
    """Contexts against in_context over whole lists, for all blocks of a document of many pages; texts are shuffled without their
    neighbours."""
    r = random.Random(9)
    rows = [(d, 2 * i, i // r.choice([40, 40, 7]), "w" * r.choice([5, 60, 300]) + ". ") for d, n in ((1, 900), (2, 1), (3, 30)) for i in range(n)]
    b = spark.createDataFrame(rows, "doc_id long, pos int, page int, text string")
    hits = b.where("doc_id < 3").select("doc_id", "pos", F.lit(1).alias("start"), F.length("text").alias("end"), F.array(F.lit("x")).alias("kept"))
    out = evidence.expanded(b, hits.union(hits.where("pos = 50")))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((x.doc_id, x.pos, x.quote, [tuple(s) for s in x.segments], x.prefix, x.suffix, x.kept) for x in out.collect())
    want = []
    for d in (1, 2):
        of = [x for x in rows if x[0] == d]
        for i, (_, pos, page, text) in enumerate(of):
            a = e = i
            while a > max(0, i - 13) and of[a - 1][2] == page:
                a -= 1
            while e + 1 < min(len(of), i + 14) and of[e + 1][2] == page:
                e += 1
            q, s, p, n = evidence.in_context([x[3] for x in of[a:i]], text, [x[3] for x in of[i + 1 : e + 1]], 1, len(text))
            want += [(d, pos, q, [(of[i + k][1], x, y) for k, x, y in s], p, n, ["x"])] * (2 if pos == 50 else 1)
    assert got == sorted(want) and len(got) == 902
