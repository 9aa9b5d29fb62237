"""Queries on fetched pages, links and crawl results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright import fixed_values as V
from notewright.functions import html as H
from notewright.functions.text import longer
from notewright.operators import pages as P
from notewright.plans.registry import q, query, sql_anchors, sql_attr, sql_disease_name, sql_safe_name, sql_text, sql_trim
from notewright.plans.views import Inputs
from notewright.sources import readers, writers

# ---- oracle fragments --------------------------------------------------------------------------

# The views only use these elements, so plain patterns without nesting are enough here.
H1 = r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"
ARTICLE_TITLE = r'(?is)<div class="lead article-title">(.*?)</div>'
ANY_TITLE = r'(?is)<(?:div|span) class="[^"]*title[^"]*">(.*?)</(?:div|span)>'
ABSTRACT_DIV = r'(?is)<div class="abstract">(.*?)</div>'
SUMMARY_DIV = r'(?is)<div class="summary">(.*?)</div>'
ARTICLE = r"(?is)<article\b[^>]*>(.*?)</article\s*>"


def first_text(pattern: str) -> str:
    return sql_text(f"regexp_extract(html, {q(pattern)}, 1)")


def over(x: str, n: int) -> str:
    return f"list_filter([{x}], lambda v: length(v) > {n})[1]"


def metas(*names: str) -> str:
    tags = "regexp_extract_all(html, '(?is)<meta\\b[^>]*>')"
    wanted = ", ".join(q(n) for n in names)
    kept = f"list_filter({tags}, lambda m: coalesce({sql_attr('m', 'name')}, {sql_attr('m', 'property')}, '') in ({wanted}))"
    return f"list_filter(list_transform({kept}, lambda m: {sql_attr('m', 'content')}), lambda c: c is not null)"


TITLE = f"""coalesce({over(first_text(H1), 5)}, {over(first_text(ARTICLE_TITLE), 5)}, {over(first_text(ANY_TITLE), 5)},
  {sql_trim(metas('citation_title', 'og:title') + '[1]')}, '未找到题目')"""


def all_over(pattern: str, n: int) -> str:
    texts = f"list_transform(regexp_extract_all(html, {q(pattern)}, 1), lambda e: {sql_text('e')})"
    return f"list_filter({texts}, lambda v: length(v) > {n})[1]"


ABSTRACT1 = f"""coalesce({all_over(ABSTRACT_DIV, 50)}, {all_over(SUMMARY_DIV, 50)},
  {sql_trim(f"list_filter(string_split({sql_text('html')}, chr(10)), lambda s: contains(s, '摘要') and length(s) > 10)[1]")}, '未找到摘要')"""


def keyword(word: str) -> str:
    found = f"regexp_extract_all({sql_text('html')}, {q(rf'(?is){word}[\s:：]*(.+?)(?:\n\n|$)')}, 1)"
    return f"list_filter(list_transform({found}, lambda x: {sql_trim('x')}), lambda x: length(x) > 50)[1]"


MAIN = f"list_transform(list_filter([{first_text(ARTICLE)}], lambda v: length(v) > 100), lambda v: case when length(v) > 500 then concat(substring(v, 1, 500), '...') else v end)[1]"
ABSTRACT2 = f"""coalesce({keyword('ABSTRACT')}, {keyword('摘要')}, {over(first_text(ABSTRACT_DIV), 50)}, {over(first_text(SUMMARY_DIV), 50)},
  {sql_trim(f"list_filter({metas('citation_abstract', 'description', 'og:description')}, lambda c: length(c) > 50)[1]")}, {MAIN}, '未找到摘要')"""


def resolved(h: str, variant: str, base: str = "url") -> str:
    x, a, b = sql_trim(h), "'https://rs.yiigle.com'", "'https://www.yiigle.com'"
    https = f"when starts_with({x}, '//') then concat('https:', {x}) when starts_with({x}, 'http') then {x}"
    return {
        "results_legacy": f"case when starts_with({x}, 'http') then {x} when starts_with({x}, '/') then concat({a}, {x}) else concat({a}, '/', {x}) end",
        "results": f"case {https} else concat({a}, '/', ltrim({x}, '/')) end",
        "direct": f"case {https} when starts_with({x}, '/') then concat({b}, {x}) else concat('https://', {x}) end",
        "detail": f"case {https} else concat({b}, '/', ltrim({x}, '/')) end",
        "detail_legacy": f"case {https} else concat({b}, {x}) end",
        "page": f"case {https} else concat(rtrim({base}, '/'), '/', ltrim({x}, '/')) end",
    }[variant]


# ---- page fields ------------------------------------------------------------------------------------


@query("c01_title", f"select page_id, {TITLE} as title from v_pages_full")
def c01(t: Inputs):
    return t("v_pages_full").select("page_id", H.page_title("html").alias("title"))


@query("c01_heading_title", f"select page_id, coalesce(nullif(substring({first_text(H1)}, 1, 200), ''), case when page_id % 4 = 1 then url end, 'untitled') as title from v_pages_full")
def c01_heading(t: Inputs):
    result_title = F.when(F.col("page_id") % 4 == 1, F.col("url"))
    return t("v_pages_full").select("page_id", H.heading_title("html", result_title).alias("title"))


@query("c02_abstract_site1", f"select page_id, {ABSTRACT1} as abstract from v_pages_full")
def c02(t: Inputs):
    return t("v_pages_full").select("page_id", H.page_abstract("html", "site1").alias("abstract"))


@query("c03_abstract_site2", f"select page_id, {ABSTRACT2} as abstract from v_pages_full")
def c03(t: Inputs):
    return t("v_pages_full").select("page_id", H.page_abstract("html", "site2").alias("abstract"))


NO_RESULTS = f"""(contains(txt, '未找到') or contains(txt, '无结果') or contains(txt, '没有找到') or contains(txt, 'no results') or contains(txt, '暂无数据')
  or contains(html, 'class="box no-data"'))"""


@query("f09_has_results", f"""select page_id, not {NO_RESULTS} as site1, not (contains(txt, '没有找到') or contains(txt, '未找到') or contains(txt, '无结果') or contains(txt, '0 条结果')) as site2,
  true as site2_legacy from (select page_id, html, lower({sql_text('html')}) as txt from v_pages_full) x""")
def f09(t: Inputs):
    return t("v_pages_full").select(
        "page_id", H.has_results("html", "site1").alias("site1"), H.has_results("html", "site2").alias("site2"),
        H.has_results("html", "site2", legacy=True).alias("site2_legacy"),
    )


@query("f10_pdf_payload", "select doc_id, starts_with(body, '%PDF') or contains(lower(coalesce(content_type, '')), 'pdf') or strlen(body) > 2000 as is_pdf from v_payloads")
def f10(t: Inputs):
    return t("v_payloads").select("doc_id", H.is_pdf(F.encode("body", "UTF-8"), "content_type").alias("is_pdf"))


@query("f12_minimum_length", f"select page_id, {over(first_text(H1), 5)} as title, {over(first_text(ABSTRACT_DIV), 50)} as abstract from v_pages_full")
def f12(t: Inputs):
    return t("v_pages_full").select(
        "page_id", H.inner_text(H.select_first(H.canonical("html"), "h1")).alias("a"), H.inner_text(H.select_first(H.canonical("html"), ".abstract")).alias("b")
    ).select("page_id", longer("a", V.LENGTHS["title"]).alias("title"), longer("b", V.LENGTHS["abstract"]).alias("abstract"))


# ---- results and links ------------------------------------------------------------------------------------

ITEM = r'(?is)<div class="w_search_item(?: big)?">(.*?)</div>'
ITEMS1 = f"""i as (select page_id, z[1] as pos, z[2] as item from (select page_id, unnest(list_zip(range(2), regexp_extract_all(html, {q(ITEM)}, 1)[1:2])) as z from v_search_pages) y where z[2] is not null),
  r as (select page_id, pos, case when contains(item, '<h1>') then {sql_trim(f"substring({sql_text('''regexp_extract(item, '(?is)<h1>(.*?)</h1>', 1)''')}, 1, 150)")}
    else concat('结果_', cast(pos + 1 as varchar)) end as title,
    list_filter({sql_anchors('item')}, lambda a: contains(coalesce(a.href, ''), 'cmaid'))[1].href as href from i)"""


@query("c04_search_results", f"with {ITEMS1} select page_id, pos, title, {resolved('href', 'results')} as url from r where href is not null")
def c04(t: Inputs):
    return P.search_results(t("v_search_pages")).withColumn("pos", F.col("pos").cast("bigint"))


LI = r'(?is)<div class="s_searchResult_li">(.*?)</div>'
LIST_ITEM = r'(?is)<div class="list-item">(.*?)</div>'
MY_ITEM = r'(?is)<div class="(?:my-items|w_search_item(?: big)?)">(.*?)</div>'


def linked(items: str) -> str:
    """Results of the first two items: by their first link, or by their own text where they have none."""
    link, target = f"{sql_anchors('i')}[1]", r"href = ''([^'']+)''"
    by_link = f"""{{'title': {link}.text, 'href': coalesce({link}.href, nullif(regexp_extract({link}.onclick, '{target}', 1), ''), '')}}"""
    by_text = f"{{'title': {sql_text('i')}, 'href': ''}}"
    one = f"""case when contains(i, '<a') then case when length({link}.text) > 5 then {by_link} end
      when length({sql_text('i')}) > 10 then {by_text} end"""
    return f"list_filter(list_transform({items}[1:2], lambda i: {one}), lambda r: r is not null)"


GENERIC = f"""list_transform(list_filter({sql_anchors('html')}[1:50], lambda a: length(a.text) between 10 and 200 and not contains(a.text, '搜索') and not contains(a.text, '登录')
  and not contains(a.text, '注册') and not contains(a.text, '首页'))[1:2], lambda a: {{'title': a.text, 'href': coalesce(a.href, '')}})"""
FOUND = f"""case when len(l1) > 0 then l1 when len(l2) > 0 then l2 when len(l3) > 0 then l3 else null end"""
TOP = f"""e as (select page_id, html, {linked(f"regexp_extract_all(html, {q(LI)}, 1)")} as l1, {linked(f"regexp_extract_all(html, {q(LIST_ITEM)}, 1)")} as l2,
    {linked(f"list_filter(regexp_extract_all(html, {q(MY_ITEM)}, 1), lambda i: contains(i, '<a'))")} as l3 from v_search_pages)"""


def top_rows(source: str) -> str:
    return f"""select page_id, z[1] as pos, z[2].title as title, z[2].href as href from
      (select page_id, unnest(list_zip(range(len(f)), f)) as z from (select page_id, {source} as f from e) a) b"""


@query("c05_listed_results", f"with {TOP} {top_rows(FOUND)}")
def c05(t: Inputs):
    rows = t("v_search_pages").select("page_id", F.posexplode(P.listed_results("html")).alias("pos", "r"))
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), "r.title", "r.href")


@query("c06_generic_links", f"with e as (select page_id, html from v_search_pages) {top_rows(GENERIC)}")
def c06(t: Inputs):
    rows = t("v_search_pages").select("page_id", F.posexplode(P.generic_results("html")).alias("pos", "r"))
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), "r.title", "r.href")


@query("f11_content_links", f"""select page_id, z.href as href, z.text as text from (select page_id, unnest(list_filter({sql_anchors('html')}[1:50], lambda a: length(a.text) between 10 and 200)) as z from pages) y""")
def f11(t: Inputs):
    links = F.filter(F.slice(H.anchors(H.canonical("html")), 1, V.LINK_SCAN), lambda a: H.is_content_link(a["text"]))
    return t("pages").select("page_id", F.explode(links).alias("a")).select("page_id", "a.href", "a.text")


@query("c05_top_results", f"with {TOP} {top_rows(f'coalesce({FOUND}, {GENERIC})')}")
def c05_top(t: Inputs):
    return P.top_results(t("v_search_pages")).select("page_id", F.col("pos").cast("bigint").alias("pos"), "title", "href")


@query("c05_titled_results", f"""select page_id, z[1] as pos, case when contains(z[2], '_title') then {sql_text("regexp_extract(z[2], '(?is)<p class=.s_searchResult_li_title.>(.*?)</p>', 1)")} else concat('Result ', cast(z[1] + 1 as varchar)) end as title,
  {sql_text('z[2]')} as text from (select page_id, unnest(list_zip(range(2), regexp_extract_all(html, {q(LI)}, 1)[1:2])) as z from v_search_pages) y where z[2] is not null""")
def c05_titled(t: Inputs):
    return P.titled_results(t("v_search_pages")).withColumn("pos", F.col("pos").cast("bigint"))


@query("c07_search_page_pdfs", f"""select page_id, cast(0 as bigint) as pos, {resolved('href', 'detail')} as url from (
  select page_id, regexp_extract(html, 'button_r"><a href="([^"]*)"', 1) as href from v_search_pages where contains(html, 'button_r')) b""")
def c07_search(t: Inputs):
    return P.search_page_pdfs(t("v_search_pages")).select("page_id", F.col("pos").cast("bigint").alias("pos"), "url")


ALL_LINKS = f"a as (select page_id, url, unnest({sql_anchors('html')}) as a from v_pages_full)"


@query("c07_pdf_links", f"""with {ALL_LINKS} select page_id, 'any case' as kind, a.href as href from a where contains(lower(a.href), '.pdf')
  union all select page_id, 'by text', a.href from a where a.href is not null and (contains(a.href, '.pdf') or contains(lower(a.text), 'pdf') or contains(lower(a.text), 'download'))
  union all select page_id, 'frame', regexp_extract(html, '<iframe src="([^"]*)"', 1) from v_pages_full where contains(html, '<iframe')""")
def c07(t: Inputs):
    pages = t("v_pages_full")
    kinds = {"any case": H.pdf_links("html"), "by text": H.pdf_links("html", by_text=True), "frame": H.frame_pdf_links("html")}

    def named(kind: str):
        return lambda h: F.struct(F.lit(kind).alias("kind"), h.alias("href"))

    each = F.concat(*[F.transform(links, named(kind)) for kind, links in kinds.items()])
    return pages.select("page_id", F.explode(each).alias("c")).select("page_id", "c.kind", "c.href")


VARIANTS = ("results", "results_legacy", "direct", "page", "detail", "detail_legacy")


@query("c08_resolved_urls", f"with {ALL_LINKS} select page_id, a.href as href, {', '.join(resolved('a.href', v) + f' as {v}' for v in VARIANTS)} from a where a.href is not null")
def c08(t: Inputs):
    links = t("v_pages_full").select("page_id", "url", F.explode(H.anchors(H.canonical("html"))).alias("a")).where(F.col("a.href").isNotNull())
    return links.select("page_id", "a.href", *[H.resolve_url("a.href", "url", v).alias(v) for v in VARIANTS])


CANDIDATES = f"""cand as (select page_id, z[1] as pos, {resolved('z[2]', 'page')} as pdf_url from (select page_id, url, unnest(list_zip(range(len(c)), c)) as z from
    (select page_id, url, list_concat(list_filter(list_transform({sql_anchors('html')}, lambda a: a.href), lambda h: contains(lower(coalesce(h, '')), '.pdf')),
      list_filter([regexp_extract(html, '<iframe src="([^"]*)"', 1)], lambda h: h <> '')) as c from v_pages_full) x) y)"""


@query("c09_best_pdf", f"with {CANDIDATES} select page_id, arg_min(pdf_url, pos) as pdf_url from cand where length(pdf_url) % 3 <> 0 group by page_id")
def c09(t: Inputs):
    """Payloads stand in for fetched files: by the length of the address they are PDFs by their first bytes, by type, or not at all."""
    found = P.pdf_candidates(t("v_pages_full"))
    n = F.length("url") % 3
    payloads = found.select("url").distinct().select(
        "url", F.when(n == 1, F.encode(F.lit("%PDF-1.4"), "UTF-8")).otherwise(F.encode(F.lit("<html>"), "UTF-8")).alias("content"),
        F.when(n == 2, F.lit("application/PDF")).otherwise(F.lit("text/html")).alias("content_type"),
    )
    return P.best_pdf(found, payloads)


# ---- crawl results --------------------------------------------------------------------------------------------

DISEASES = f"dis as (select id, {sql_disease_name('line')} as disease from v_disease_raw where {sql_trim('line')} <> '')"
RESULTS = f"""{ITEMS1}, {DISEASES},
  lk as (select page_id + 1 as disease_id, pos, title, {resolved('href', 'results')} as url from r where href is not null),
  det as (select page_id + 1 as disease_id, {TITLE} as title, {ABSTRACT1} as abstract, case when page_id % 5 = 0 then 'TimeoutError' end as error,
    case when page_id % 3 = 0 then concat('/files/', cast(page_id as varchar), '.pdf') end as pdf_file, url from v_pages_full),
  j as (select d.id as disease_id, l.pos, d.disease, case when x.title is not null and x.error is null then x.url else l.url end as url,
    case when x.title is not null and x.error is null and x.title <> '未找到题目' then x.title else coalesce(l.title, 'untitled') end as title,
    case when x.error is null then x.abstract end as abstract, case when x.error is null then x.pdf_file end as pdf_file,
    case when x.title is null or x.error is not null then coalesce(x.error, '无法访问详情页') end as error
    from lk l join dis d on d.id = l.disease_id left join det x on x.disease_id = l.disease_id and l.pos = 0),
  c as (select d.id, d.disease, count(j.pos) as result_count, string_agg(j.title, '|' order by j.pos) as titles,
    count(j.pdf_file) as n_pdf from dis d left join j on j.disease_id = d.id group by 1, 2)"""


def diseases(t: Inputs) -> DataFrame:
    return readers.parse_diseases(t("v_disease_raw")).select("id", F.col("name").alias("disease"))


def details(t: Inputs) -> DataFrame:
    """Result links of page n belong to disease n + 1; only the first one has a fetched detail page."""
    links = P.search_results(t("v_search_pages")).withColumn("disease_id", F.col("page_id") + 1)
    named = diseases(t).select(F.col("id").alias("disease_id"), "disease")
    links = links.join(named, "disease_id").select("disease_id", "pos", "disease", "url", "title")
    fetched = P.articles(t("v_pages_full"), "site1").select(
        (F.col("page_id") + 1).alias("disease_id"), F.lit(0).alias("pos"), "title", "abstract", "url",
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/files/"), F.col("page_id").cast("string"), F.lit(".pdf"))).alias("pdf_file"),
        F.when(F.col("page_id") % 5 == 0, F.lit("TimeoutError")).alias("error"),
    )
    return P.resolve_details(links, fetched)


def results(t: Inputs) -> DataFrame:
    named = diseases(t).withColumnRenamed("id", "disease_id")
    return P.crawl_results(named, details(t)).withColumnRenamed("disease_id", "id")


@query("c12_crawl_results", f"with {RESULTS} select id, disease, result_count > 0 as has_results, result_count, coalesce(titles, '') as titles from c")
def c12(t: Inputs):
    titles = F.array_join(F.transform("details", lambda d: d["title"]), "|")
    return results(t).select("id", "disease", "has_results", "result_count", titles.alias("titles"))


@query("c13_fallback_details", f"with {RESULTS} select disease_id, pos, url, title, abstract, pdf_file from j")
def c13(t: Inputs):
    return details(t).select("disease_id", F.col("pos").cast("bigint").alias("pos"), "url", "title", "abstract", "pdf_file")


@query("c14_failed_items", f"with {RESULTS} select disease, error, count(*) as n from j where error is not null group by 1, 2")
def c14(t: Inputs):
    good, bad = P.split_errors(details(t))
    return bad.groupBy("disease", "error").agg(F.count(F.lit(1)).alias("n"))


@query("w03_first_results", f"select doc_id, source from (select doc_id, source, row_number() over (partition by source order by doc_id) as rn from documents) w where rn <= 2")
def w03(t: Inputs):
    return P.first_results(t("documents").select("doc_id", "source"), "source", "doc_id")


@query("w04_result_positions", f"""select page_id, z[1] as pos, z[2].href as href from (select page_id, unnest(list_zip(range(len(a)), a)) as z from (select page_id, {sql_anchors('html')} as a from pages) x) y""")
def w04(t: Inputs):
    rows = t("pages").select("page_id", F.posexplode(H.anchors(H.canonical("html"))).alias("pos", "a"))
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), "a.href")


NOISY = f"""(select page_id, concat(substring(url, 1, cast(8 + page_id % 200 as int)), case page_id % {len(V.LINK_NOISE) + 1} {" ".join(f"when {i} then {q(w)}" for i, w in enumerate(V.LINK_NOISE))} else ' title' end) as text from pages)"""


@query("f11_noise_links", f"""select page_id, length(text) between {V.LINK_TEXT_BAND[0]} and {V.LINK_TEXT_BAND[1]} and {" and ".join(f"not contains(text, {q(w)})" for w in V.LINK_NOISE)} as kept from {NOISY} x""")
def f11_noise(t: Inputs):
    """Link texts of which most hold one of the words of site navigation."""
    noise = F.element_at(F.lit([*V.LINK_NOISE, " title"]), (F.col("page_id") % (len(V.LINK_NOISE) + 1) + 1).cast("int"))
    text = F.concat(F.substring(F.col("url"), F.lit(1), (8 + F.col("page_id") % 200).cast("int")), noise)
    return t("pages").select("page_id", H.is_content_link(text).alias("kept"))


SEARCHED = f"""{RESULTS}, s as (select page_id + 1 as disease_id, case when page_id % 7 = 0 then false when page_id % 4 = 3 then true end as has, case when page_id % 7 = 0 then 'TimeoutError: search' end as error from pages),
  cs as (select c.id, c.disease, s.error, case when s.error is null then c.result_count else 0 end as result_count, case when s.error is null then c.titles end as titles,
    case when s.error is null then c.n_pdf else 0 end as n_pdf, coalesce(s.has, c.result_count > 0) as has_results from c left join s on s.disease_id = c.id)"""


def searched_results(t: Inputs) -> DataFrame:
    """Results where some searches failed: those have an error and no details, the rest carry on. Every fourth page says itself that it has results."""
    n = F.col("page_id")
    error = F.when(n % 7 == 0, F.lit("TimeoutError: search"))
    searches = t("pages").select((n + 1).alias("disease_id"), F.when(error.isNotNull(), F.lit(False)).when(n % 4 == 3, F.lit(True)).alias("has_results"), error.alias("error"))
    found = details(t).join(searches.where(F.col("error").isNotNull()), "disease_id", "left_anti")
    named = diseases(t).withColumnRenamed("id", "disease_id")
    return P.crawl_results(named, found, searches).withColumnRenamed("disease_id", "id")


@query("c12_failed_searches", f"with {SEARCHED} select id, disease, has_results, result_count, coalesce(titles, '') as titles, error from cs")
def c12_failed(t: Inputs):
    titles = F.array_join(F.transform("details", lambda d: d["title"]), "|")
    return searched_results(t).select("id", "disease", "has_results", "result_count", titles.alias("titles"), "error")


@query("a14_crawl_summary", f"""with {SEARCHED} select count(*) as diseases, count(*) filter (has_results) as with_results, cast(sum(result_count) as bigint) as n_details,
  cast(sum(result_count) as bigint) as n_text, cast(sum(n_pdf) as bigint) as n_pdf, count(error) as n_errors from cs""")
def a14(t: Inputs):
    return P.crawl_summary(searched_results(t))


@query("k05_result_rows", f"with {RESULTS} select id, disease, result_count as n, coalesce(titles, '') as titles from c")
def k05(t: Inputs):
    """The results as written to CSV and read back, the nested details parsed again."""
    folder = t.scratch("results_csv")
    writers.write_results(results(t), folder)
    back = t.spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema("disease string, id bigint, details string").csv(folder)
    parsed = F.from_json("details", "array<struct<pos:int,title:string>>")
    return back.select("id", F.coalesce("disease", F.lit("")).alias("disease"), F.size(parsed).cast("bigint").alias("n"),
                       F.array_join(F.transform(parsed, lambda d: d["title"]), "|").alias("titles"))


ERROR_TEXT = "case when page_id % 2 = 0 then repeat(url, 10) else 'TimeoutError: page' end"


@query("k07_article_texts", f"""with p as (select page_id, url, {TITLE} as title, {ABSTRACT1} as abstract from v_pages_full)
  select page_id, concat('题目: ', title, chr(10), case when abstract <> '未找到摘要' then concat(chr(10), '摘要: ', abstract, chr(10)) else '' end) as site1,
  concat('题目: ', title, chr(10)) as title_only,
  concat('疾病名称: D', cast(page_id as varchar), chr(10), '疾病ID: ', cast(page_id as varchar), chr(10), '题目: ', title, chr(10), '摘要: ', abstract, chr(10), '来源URL: ', url, chr(10), '提取时间: 2024-01-02 03:04:05', chr(10)) as site2,
  concat('疾病名称: D', cast(page_id as varchar), chr(10), '疾病ID: ', cast(page_id as varchar), chr(10), '题目: ', title, chr(10), '状态: 无法访问详情页', chr(10), '错误: ', substring({ERROR_TEXT}, 1, 200), chr(10)) as failed from p""")
def k07(t: Inputs):
    found = P.articles(t("v_pages_full"), "site1")
    disease = F.concat(F.lit("D"), F.col("page_id").cast("string"))
    error = F.when(F.col("page_id") % 2 == 0, F.repeat("url", 10)).otherwise(F.lit("TimeoutError: page"))
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    return found.select(
        "page_id", P.article_text("site1", "title", "abstract").alias("site1"), P.article_text("site1", "title", F.lit("")).alias("title_only"),
        P.article_text("site2", "title", "abstract", disease, "page_id", "url", at).alias("site2"),
        P.article_text("failed", "title", disease=disease, disease_id="page_id", error=error).alias("failed"),
    )


@query("k07_article_files", f"""with {RESULTS}, o as (select *, case when abstract is not null and abstract <> '未找到摘要' then concat(chr(10), '摘要: ', abstract, chr(10)) else '' end as tail from j)
  select disease_id % 3 as part, 1 as website, concat(cast(disease_id as varchar), '_', {sql_safe_name('disease')}) as disease_key,
  concat({sql_safe_name('disease')}, '_', {sql_safe_name("replace(title, ' ', '_')")}, '.txt') as file, concat('题目: ', title, chr(10), tail) as text from o""")
def k07_files(t: Inputs):
    """The articles as written to their folders and read back."""
    text, folder = P.article_text("site1", "title", "abstract"), t.scratch("articles")
    writers.write_articles(P.article_files(details(t), F.col("disease_id") % 3, F.lit(1), text), folder)
    return readers.read_articles(t.spark, folder)


@query("k07_basic_files", f"""with {RESULTS} select concat(cast(disease_id as varchar), '_', {sql_safe_name('disease')}) as disease_key,
  concat(cast(disease_id as varchar), '_', {sql_safe_name('disease')}, '_', {sql_safe_name('title')}, '_basic.txt') as file,
  concat('疾病名称: ', disease, chr(10), '疾病ID: ', cast(disease_id as varchar), chr(10), '题目: ', title, chr(10), '状态: 无法访问详情页', chr(10), '错误: ', substring(error, 1, 200), chr(10)) as text
  from j where error is not null""")
def k07_basic(t: Inputs):
    """The files of failed pages as written and read back."""
    failed = details(t).where(F.col("error").isNotNull())
    text = P.article_text("failed", "title", disease="disease", disease_id="disease_id", error="error")
    folder = t.scratch("articles-basic")
    writers.write_articles(P.article_files(failed, F.lit(1), F.lit(2), text, "site2", "_basic.txt"), folder)
    return readers.read_articles(t.spark, folder).select("disease_key", "file", "text")
