import pytest
from pyspark.sql import functions as F

from papyra import plugins
from papyra.functions import paragraphs as P
from papyra.functions.unicode import folded_key, nfkc, restyled
from papyra.operators import evidence, hybrid, reconcile
from papyra.sources import export


def test_protocols():
    assert isinstance(plugins.LexicalRetriever(), plugins.EvidenceRetriever)
    assert isinstance(plugins.HashedWords(), plugins.EmbeddingProvider)
    assert isinstance(plugins.MarkdownImporter(), plugins.Importer)


def test_embedding_provider(spark):
    docs = spark.createDataFrame([(1, "a b " * 600), (2, ""), (3, None)], "doc_id long, text string")
    rows = plugins.embedded_chunks(docs, plugins.HashedWords(16)).collect()
    assert {r.doc_id for r in rows} == {1} and len(rows) == 3 and len({r.chunk_id for r in rows}) == 3
    assert all(abs(sum(x * x for x in r.vector) - 1) < 1e-5 for r in rows)


def test_importer(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\nfirst\nline\n\n- x\n  - y\n\nlast")
    (tmp_path / "b.bin").write_bytes(b"\x00")
    rows = plugins.imported(spark.read.format("binaryFile").load(str(tmp_path)), [plugins.MarkdownImporter()]).orderBy("pos").collect()
    assert [(r.kind, r.level, r.text) for r in rows] == [("heading", 1, "T"), ("paragraph", None, "first line"), ("list", 0, "x"), ("list", 1, "y"), ("paragraph", None, "last")]


def test_expansion():
    class Fixed:
        def expand(self, question):
            return {"english": ["navy", "fleet", "third"], "terms": ["海軍", "艦隊"]}

    assert plugins.expanded("海軍", Fixed()) == ["海軍", "navy", "fleet", "艦隊"] and plugins.expanded("q", None) == ["q"]


def test_retriever(spark):
    b = spark.createDataFrame([(1, 0, "the Apache license"), (1, 1, "other"), (2, 0, "a license here, a license there"), (3, 0, "nothing")], "doc_id long, pos int, text string")
    got = plugins.LexicalRetriever().search(b, "Apache license").collect()
    assert [(r.doc_id, r.block) for r in got] == [(1, 0), (2, 0)]
    assert plugins.LexicalRetriever().search(b, "").count() == 0


def test_greedy_pick():
    row = lambda i, d, lane, r, s=0: {"doc_id": d, "section": "", "block": i, "start": s, "end": s + 100, "lane": lane, "relevance": r}
    rows = [row(1, 1, "ja", 1.0), row(2, 2, "ja", 0.9), row(3, 3, "ja", 0.8), row(4, 4, "ja", 0.7), row(5, 5, "en", 0.62), row(1, 1, "ja", 0.95, 40)]
    got = evidence.greedy(rows, 5, hybrid.DOC_WEIGHT, hybrid.SECTION_WEIGHT, hybrid.ENGLISH_SLOT, hybrid.ENGLISH_SHARE, evidence.half_shared)
    assert [rows[i]["block"] for i in got] == [1, 2, 3, 5, 4]


def test_aliases():
    assert hybrid.alias_candidates("コンピューター") == ["ピューター", "ューター", "ーター", "コンピュー", "コンピュ", "コンピ"]
    assert hybrid.alias_candidates("漢字") == []


def test_context_expansion(spark):
    b = spark.createDataFrame([(1, i, str(i) * 300) for i in range(9)], "doc_id long, pos int, text string")
    r = evidence.expanded(b, spark.createDataFrame([(1, 4, 0, 300)], "doc_id long, pos int, start int, end int")).first()
    # three blocks make 650 characters before, four 1,100 after; cut to 650 before the hit, moved to a block's beginning
    assert [s.pos for s in r.segments] == [2, 3, 4, 5, 6, 7, 8] and r.quote.startswith("2" * 300 + "\n3") and not r.suffix and r.prefix


def test_fusion(spark):
    s = "doc_id long, block int, start int, end int, rank int, lane string"
    a = spark.createDataFrame([(1, 0, 0, 100, 1, "ja"), (2, 0, 0, 100, 2, "ja")], s)
    b = spark.createDataFrame([(1, 0, 20, 120, 3, "en")], s)
    got = {(r.doc_id, r.start): round(r.fusion, 6) for r in hybrid.fused(a, b).collect()}
    assert got == {(1, 20): round(1 / 63 + 1 / 61, 6), (2, 0): round(1 / 62, 6)}


@pytest.mark.parametrize("lines,want", [
    (["これは長い行でありまして", "まだ続きますので、", "終わりです。", "　次の段落。"], ["これは長い行でありましてまだ続きますので、終わりです。", "次の段落。"]),
    (["an inter-", "esting line of", "text", "", "new"], ["an interesting line of text", "new"]),
    (["・one", "・two"], ["・one", "・two"]), ([], []),
])
def test_paragraphs(lines, want):
    assert P.paragraphs(lines) == want


def test_rewriting():
    assert P.rewritten_paths('<img src="/old/a.png"><a href=\'/old/b\'>/old/c', "/old/", "/n/") == '<img src="/n/a.png"><a href=\'/n/b\'>/old/c'
    assert P.rewritten_json('{"a": {"path": "/old/x", "t": "/old/y"}, "path": ["/old/z"]}', {"path"}, "/old", "") == '{"a": {"path": "/x", "t": "/old/y"}, "path": ["/z"]}'
    assert P.rewritten_json("no json", {"path"}, "a", "b") == "no json"
    assert P.without_garbage_prefix("●※ 本文") == "本文" and P.without_garbage_prefix("---") == "---"
    assert P.shares([2, 2, 1, 1], [4], "東京ab") == ["東京", "ab"]
    assert restyled('<p class="a" style="x">t &amp; u</p><br/>', {"p": "margin:0"}) == '<p class="a" style="margin:0">t &amp; u</p><br/>'


def test_unicode(spark):
    r = spark.createDataFrame([("ＡＢ－ｃ １",)], "t string").select(nfkc("t").alias("n"), folded_key(F.col("t")).alias("k")).first()
    assert r.n == "AB-c 1" and r.k == "ab-c1"


def test_export(spark):
    pages = spark.createDataFrame([(1, 1, "one\nstarts here"), (1, 2, "goes on.\ntwo."), (1, 3, "three")], "doc_id long, page int, body string")
    got = [r.text for r in export.export_rows(export.chosen_pages(pages, first=1, last=2)).orderBy("para").collect()]
    assert got == ["one", "starts here goes on.", "two."]
    e = spark.createDataFrame([(2, "new"), (9, "only")], "page int, body string")
    assert sorted((r.page, r.body[:4]) for r in export.merged_versions(e, pages.select("page", "body")).collect()) == [(1, "one\n"), (2, "new"), (3, "thre"), (9, "only")]
    assert export.chosen_pages(pages, single=2).count() == 1 and export.chosen_pages(pages, listed=[1, 3]).count() == 2


def test_quotes_both_ways(spark):
    from papyra.operators.proofs import quotes_in_sources

    q = spark.createDataFrame([(1, "quick  brown fox"), (2, "short"), (3, "brownfoxjumps")], "item_id long, quote string")
    s = spark.createDataFrame([(7, "the quick brown\nfox jumps"), (8, None), (9, "")], "doc_id long, text string")
    for most in (10, 0):
        assert sorted((r.item_id, r.doc_id) for r in quotes_in_sources(q, s, most=most).collect()) == [(1, 7), (3, 7)]


def test_migration(spark):
    r = reconcile.migrated(spark.createDataFrame([("/data/a",), ("b",)], "p string"), "p", "^/data/").orderBy("p").collect()
    assert [(x.new, x.changed) for x in r] == [("a", True), ("b", False)]
