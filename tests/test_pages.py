import re

import pytest
from pyspark.sql import functions as F

from notewright.functions import html as H
from notewright.operators import pages as P
from notewright.sources import readers, writers


def one(spark, html, column):
    return spark.createDataFrame([(html,)], "html string").select(column).first()[0]


def test_inner_text(spark):
    html = "<head><title>t</title></head><body><!-- c --><script>x<y</script>A&amp;B<br>C <b>d</b>\n e<p>one</p><p>two<div>three</div>&lt;p&gt;"
    assert one(spark, html, H.inner_text(H.canonical("html"))) == "A&B\nC d e\n\none\n\ntwo\n\nthree\n<p>"


@pytest.mark.parametrize("html,selector,expected", [
    ('<div class="a x"><div>1</div><div><div>2</div></div></div><div class="x">3</div>', ".x", ["<div>1</div><div><div>2</div></div>", "3"]),
    ('<DIV CLASS="x">1</DIV>', ".x", ["1"]),
    ('<div class="X">1</div><div class="xx">2</div><div data-class="x">3</div>', ".x", []),
    ('<div class="my-title-x">1</div>', '[class*="title"]', ["1"]),
    ('<div class="content"><p>1<p>2</p></div><p>3</p>', ".content p", ["1", "2"]),
    ("<header><h1>1</h1></header><h1>2</h1>", "header h1", ["1"]),
    ('<div class="x"><div>open</div>', ".x", ["<div>open</div>"]),
    ("<div class=x>" + "<div>" * 6 + "deep" + "</div>" * 6 + "tail</div>after", ".x", ["<div>" * 6 + "deep" + "</div>" * 6 + "tail"]),
    ('<div class="x" data-x="a>b">1 &eacute;&#945;&#x3b2;&ndash;</div>', ".x", ["1 éαβ–"]),
    ("<ul><li class=x>1<li class=x>2<ul><li>3</ul></ul>", ".x", ["1", "2<ul><li>3</li></ul>"]),
])
def test_select(spark, html, selector, expected):
    got = one(spark, html, H.select_all(H.canonical("html"), selector))
    assert [re.sub(r' _d="\d+"', "", g) for g in got] == expected


def test_long_pages_need_no_deep_stack(spark):
    inside = "<p>text</p>" * 60_000 + "<div>" + "word " * 100_000 + "</div>"
    got = one(spark, f'<div class="content">{inside}</div>', F.length(F.regexp_replace(H.select_first(H.canonical("html"), ".content"), r' _d="\d+"', "")))
    assert got == len(inside)


def test_unquoted_links_and_signs_in_attributes(spark):
    html = "<a href=/x.pdf title='a>b'>one &amp; two</a><a href=\"/y?a=1&amp;b=2\" onclick=go()>x</a>"
    got = one(spark, html, H.anchors(H.canonical("html")))
    assert [(g.href, g.onclick, g.text) for g in got] == [("/x.pdf", None, "one & two"), ("/y?a=1&b=2", "go()", "x")]
    once = one(spark, html, H.canonical("html"))
    assert one(spark, once, H.canonical("html")) == once


def test_title_chain(spark):
    def title(html):
        return one(spark, html, H.page_title("html"))

    assert title("<h1>short</h1><div class='title'>Long enough</div>") == "Long enough"
    assert title("<h1> A proper title </h1>") == "A proper title"
    assert title('<meta content=" By meta " name="citation_title">') == "By meta"
    assert title('<meta property="og:title" content="o"><meta name="citation_title" content="c">') == "o"
    assert title("<p>x</p>") == "未找到题目"


def test_abstract_chains(spark):
    long = "sentence " * 8
    assert one(spark, f"<div class='abstract'>short</div><div class='abstract'>{long}</div>", H.page_abstract("html", "site1")) == long.strip()
    assert one(spark, "<div>x</div><div>本文摘要：一二三四五六七八</div>", H.page_abstract("html", "site1")) == "本文摘要：一二三四五六七八"
    assert one(spark, "<div>摘要</div>", H.page_abstract("html", "site1")) == "未找到摘要"
    assert one(spark, f"<p>x</p><p>abstract: {long}</p><p>y</p>", H.page_abstract("html", "site2")) == long.strip()
    assert one(spark, f'<meta name="description" content="{long}">', H.page_abstract("html", "site2")) == long.strip()
    body = "字" * 600
    assert one(spark, f"<article>{body}</article>", H.page_abstract("html", "site2")) == body[:500] + "..."
    assert one(spark, "<article>x</article>", H.page_abstract("html", "site2")) == "未找到摘要"


@pytest.mark.parametrize("href,variant,expected", [
    ("/x", "results", "https://rs.yiigle.com/x"), ("x", "results", "https://rs.yiigle.com/x"), ("//h/x", "results", "https://h/x"),
    ("//h/x", "results_legacy", "https://rs.yiigle.com//h/x"), ("http://h/x", "results_legacy", "http://h/x"),
    ("h.com/x", "direct", "https://h.com/x"), ("/x", "direct", "https://www.yiigle.com/x"),
    ("/x", "page", "https://p/d/x"), ("x", "page", "https://p/d/x"), ("x", "detail", "https://www.yiigle.com/x"),
    ("x", "detail_legacy", "https://www.yiigle.comx"),
])
def test_resolve(spark, href, variant, expected):
    assert one(spark, "x", H.resolve_url(F.lit(href), F.lit("https://p/d/"), variant)) == expected


def test_no_results(spark):
    assert one(spark, "<p>未找到</p>", H.has_results("html")) is False
    assert one(spark, "<p>NO results</p>", H.has_results("html")) is False
    assert one(spark, '<p class="x empty-result"></p>', H.has_results("html")) is False
    assert one(spark, '<p class="x-empty-result"></p>', H.has_results("html")) is True
    assert one(spark, "<p>0 条结果</p>", H.has_results("html", "site2")) is False
    assert one(spark, "<p>0 条结果</p>", H.has_results("html", "site2", legacy=True)) is True


def test_payloads(spark):
    df = spark.createDataFrame(
        [(1, b"%PDF-1", None), (2, b"x%PDF", "text/html"), (3, b"x", "Application/PDF"), (4, b"x" * 2001, None), (5, b"x" * 2000, None), (6, None, None)],
        "i int, content binary, content_type string",
    )
    assert [r["i"] for r in df.where(H.is_pdf("content", "content_type")).orderBy("i").collect()] == [1, 3, 4]


def test_best_pdf_takes_the_first_valid_candidate(spark):
    pages = spark.createDataFrame([(1, "https://p", '<a href="/a.pdf">x</a><a href="//h/b.PDF">y</a><iframe src="/c.pdf"></iframe>'), (2, "https://q", "<a>x</a>")],
                                  "page_id bigint, url string, html string")
    found = P.pdf_candidates(pages)
    assert [(r["href"], r["kind"]) for r in found.orderBy("pos").collect()] == [("/a.pdf", "link"), ("//h/b.PDF", "link"), ("/c.pdf", "frame")]
    payloads = spark.createDataFrame([("https://p/a.pdf", b"<html>", "text/html"), ("https://h/b.PDF", b"%PDF", None), ("https://p/c.pdf", b"%PDF", None)],
                                     "url string, content binary, content_type string")
    assert [tuple(r) for r in P.best_pdf(found, payloads).collect()] == [(1, "https://h/b.PDF")]


def test_results_fall_back_to_plain_links(spark):
    pages = spark.createDataFrame(
        [(1, '<a href="/1">搜索全部的文献内容列表</a><a href="/2">A content link</a><a>Another content link</a><a href="/4">A third content link</a>'),
         (2, '<div class="result-item"><a href="/x">tiny</a></div><div class="list-item">Enough plain text here</div>')],
        "page_id bigint, html string",
    )
    got = [tuple(r) for r in P.top_results(pages).orderBy("page_id", "pos").select("page_id", "title", "href").collect()]
    assert got == [(1, "A content link", "/2"), (1, "Another content link", ""), (2, "Enough plain text here", "")]


def test_crawl_results_and_summary(spark):
    diseases = spark.createDataFrame([(1, "甲"), (2, "乙"), (3, "丙")], "disease_id bigint, disease string")
    links = spark.createDataFrame([(1, i, "甲", f"u{i}", f"t{i}") for i in range(5)] + [(2, 0, "乙", "v", None)],
                                  "disease_id bigint, pos int, disease string, url string, title string")
    details = spark.createDataFrame(
        [(1, 0, "T0", "A0", "d0", "f.pdf", None), (1, 1, "未找到题目", "A1", "d1", None, None), (2, 0, None, None, None, None, "x" * 300)],
        "disease_id bigint, pos int, title string, abstract string, url string, pdf_file string, error string",
    )
    resolved = P.resolve_details(links, details)
    results = P.crawl_results(diseases, resolved, spark.createDataFrame([(3, False, "Timeout")], "disease_id bigint, has_results boolean, error string"))
    got = {r["disease"]: r for r in results.collect()}
    assert [(d["url"], d["title"]) for d in got["甲"]["details"]] == [("d0", "T0"), ("d1", "t1")]
    assert [d["title"] for d in got["乙"]["details"]] == ["untitled"]
    assert (got["丙"]["has_results"], got["丙"]["details"], got["丙"]["error"]) == (False, [], "Timeout")
    assert tuple(P.crawl_summary(results).first()) == (3, 2, 3, 3, 1, 1)
    good, bad = P.split_errors(resolved)
    assert good.count() == 2 and {len(r["error"]) for r in bad.where("disease = '乙'").collect()} == {200}


def test_first_results_trims_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("disease_id"), F.col("id").alias("pos"))
    top = P.first_results(df)
    assert sorted(r["pos"] for r in top.collect()) == [0, 1, 2, 3, 4, 5]
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_article_files(spark, tmp_path):
    df = spark.createDataFrame([(3, "a/b病", "A title", "未找到摘要"), (4, "乙", "B", "text")], "disease_id bigint, disease string, title string, abstract string")
    files = P.article_files(df, F.lit(1), F.lit(2), P.article_text("site1", "title", "abstract"))
    got = {r["disease_key"]: (r["file"], r["text"]) for r in files.collect()}
    assert got == {"3_a_b病": ("a_b病_A_title.txt", "题目: A title\n"), "4_乙": ("乙_B.txt", "题目: B\n\n摘要: text\n")}
    writers.write_articles(files, str(tmp_path / "out"))
    back = readers.read_articles(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in back.collect()} == {(1, 2, k, f, t) for k, (f, t) in got.items()}


def test_links_of_the_search_page_come_last(spark):
    search = spark.createDataFrame(
        [(1, '<div class="s_searchResult_li_button_r"><a href="/s0.pdf">PDF</a><a>-</a></div><div class="s_searchResult_li_button_r"><a href="//h/s1.pdf">PDF</a></div>')],
        "page_id bigint, html string",
    )
    buttons = P.search_page_pdfs(search)
    assert [(r["pos"], r["url"]) for r in buttons.orderBy("pos").collect()] == [(0, "https://www.yiigle.com/s0.pdf"), (2, "https://h/s1.pdf")]
    detail = spark.createDataFrame([(1, "https://p", '<a href="/a.pdf">x</a>')], "page_id bigint, url string, html string")
    found = P.pdf_candidates(detail).select("page_id", "pos", "url").unionByName(buttons.select("page_id", (F.col("pos") + 1_000_000).alias("pos"), "url"))
    kind = "url string, content binary, content_type string"
    both = spark.createDataFrame([("https://p/a.pdf", b"%PDF", None), ("https://www.yiigle.com/s0.pdf", b"%PDF", None)], kind)
    assert P.best_pdf(found, both).first()["pdf_url"] == "https://p/a.pdf"
    assert P.best_pdf(found, both.where("url like '%s0%'")).first()["pdf_url"] == "https://www.yiigle.com/s0.pdf"


def test_an_address_most_pages_link_to(spark):
    found = spark.range(3000).select(F.col("id").alias("page_id"), F.lit(0).alias("pos"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("url"))
    payloads = spark.createDataFrame([("hot", b"%PDF", None), ("3", b"%PDF", None), ("6", b"no", "text/html")], "url string, content binary, content_type string")
    assert P.best_pdf(found, payloads).count() == 2001


def test_crawl_results_keep_as_many_as_asked_for(spark):
    diseases = spark.createDataFrame([(3, "x")], "disease_id bigint, disease string")
    details = spark.createDataFrame([(3, i, "x", f"u{i}", f"t{i}", None) for i in range(5)],
                                    "disease_id bigint, pos int, disease string, url string, title string, pdf_file string")
    for n in (2, 5):
        assert len(P.crawl_results(diseases, details, max_results=n).first().details) == n
