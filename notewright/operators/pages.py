"""Fetched pages: articles, result lists, PDF choice and per-disease results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright import fixed_values as V
from notewright.functions import html as H
from notewright.functions.text import article_file, col, disease_key, preview, trim_u
from notewright.operators.scaling import salted_join

RESULT_TYPE = "array<struct<title:string,href:string,text:string>>"


def articles(pages: DataFrame, site: str = "site2", html: str = "html") -> DataFrame:
    """Title and abstract of detail pages; the page itself is dropped."""
    return pages.withColumn("title", H.page_title(html)).withColumn("abstract", H.page_abstract(html, site)).drop(html)


def search_results(pages: DataFrame, max_results: int = V.RESULTS_PER_DISEASE, key: str = "page_id",
                   html: str = "html") -> DataFrame:
    """Result items of site-1 search pages: title and full-text link; items without a link are dropped."""
    items = F.slice(H.select_all(H.canonical(html), f".{V.RESULT_ITEM_CLASS}"), 1, max_results)
    rows = pages.select(key, F.posexplode(items).alias("pos", "_item"))
    n = V.LENGTHS["result_title"]
    heads = F.concat(H.select_all("_item", "h1 a"), H.select_all("_item", "h1"))
    head = trim_u(F.substring(H.inner_text(F.try_element_at(heads, F.lit(1))), 1, n))
    title = F.coalesce(head, F.concat(F.lit("结果_"), (F.col("pos") + 1).cast("string")))
    marked = F.filter(H.anchors("_item"), lambda a: F.contains(a["href"], F.lit(V.RESULT_LINK_MARK)))
    href = F.try_element_at(marked, F.lit(1)).getField("href")
    return rows.select(key, "pos", title.alias("title"), href.alias("href")).where(F.col("href").isNotNull()).select(
        key, "pos", "title", H.resolve_url("href", variant="results").alias("url")
    )


def _item_result(item: Column) -> Column:
    """Result of one list item: its first link if that has enough text, else its own text; null if neither."""
    link = F.try_element_at(H.anchors(item), F.lit(1))
    text = H.inner_text(item)
    by_link = F.struct(
        link["text"].alias("title"),
        F.coalesce(link["href"], H.onclick_target(link["onclick"]), F.lit("")).alias("href"),
        link["text"].alias("text"),
    )
    by_text = F.struct(text.alias("title"), F.lit("").alias("href"), text.alias("text"))
    return F.when(link.isNotNull(), F.when(F.length(link["text"]) > V.LENGTHS["title"], by_link)).otherwise(
        F.when(F.length(text) > V.LENGTHS["item"], by_text)
    )


def listed_results(html: Column | str, max_results: int = V.RESULTS_PER_DISEASE) -> Column:
    """Results from the first container selector that yields any; null when none does."""
    html = H.canonical(html)
    per_selector = []
    for selector in V.RESULT_SELECTORS:
        items = H.select_all(html, selector)
        if selector == V.RESULT_SELECTORS[-1]:
            items = F.filter(items, lambda i: F.regexp_like(i, F.lit(r"(?i)<a\b")))
        found = F.transform(F.slice(items, 1, max_results), _item_result)
        per_selector.append(F.array_compact(found).cast(RESULT_TYPE))
    return F.try_element_at(F.filter(F.array(*per_selector), lambda r: F.size(r) > 0), F.lit(1))


def generic_results(html: Column | str, max_results: int = V.RESULTS_PER_DISEASE) -> Column:
    """Results from the page's first 50 links, navigation left out."""
    links = F.filter(F.slice(H.anchors(H.canonical(html)), 1, V.LINK_SCAN), lambda a: H.is_content_link(a["text"]))
    return F.transform(
        F.slice(links, 1, max_results),
        lambda a: F.struct(a["text"].alias("title"), F.coalesce(a["href"], F.lit("")).alias("href"), a["text"].alias("text")),
    ).cast(RESULT_TYPE)


def top_results(pages: DataFrame, max_results: int = V.RESULTS_PER_DISEASE, key: str = "page_id",
                html: str = "html") -> DataFrame:
    """Results of site-2 search pages, with the generic links where no container fits."""
    found = F.coalesce(listed_results(html, max_results), generic_results(html, max_results))
    return pages.select(key, F.posexplode(found).alias("pos", "_r")).select(key, "pos", "_r.title", "_r.href", "_r.text")


def titled_results(pages: DataFrame, max_results: int = V.RESULTS_PER_DISEASE, key: str = "page_id",
                   html: str = "html") -> DataFrame:
    """Result items with their title link, a numbered title where there is none, and their whole text."""
    items = F.slice(H.select_all(H.canonical(html), V.RESULT_SELECTORS[0]), 1, max_results)
    rows = pages.select(key, F.posexplode(items).alias("pos", "_item"))
    heads = F.try_element_at(H.select_all("_item", f"{V.RESULT_TITLE_SELECTOR} a"), F.lit(1))
    numbered = F.concat(F.lit("Result "), (F.col("pos") + 1).cast("string"))
    return rows.select(key, "pos", F.coalesce(H.inner_text(heads), numbered).alias("title"), H.inner_text("_item").alias("text"))


def first_results(links: DataFrame, by: str = "disease_id", pos: str = "pos", n: int = V.RESULTS_PER_DISEASE) -> DataFrame:
    """The first n rows per key; Spark trims each key to n rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(pos))
    return links.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def pdf_candidates(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Possible PDF addresses of each page, in the order they are tried: links, then frames."""
    found = F.concat(
        F.transform(H.pdf_links(html), lambda h: F.struct(h.alias("href"), F.lit("link").alias("kind"))),
        F.transform(H.frame_pdf_links(html), lambda h: F.struct(h.alias("href"), F.lit("frame").alias("kind"))),
    )
    return pages.select(key, url, F.posexplode(found).alias("pos", "_c")).select(
        key, "pos", "_c.href", "_c.kind", H.resolve_url("_c.href", url, "page").alias("url")
    )


def search_page_pdfs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The PDF button of each result on a search page: link ``pos`` belongs to result ``pos``."""
    links = F.flatten(F.transform(H.select_all(H.canonical(html), V.RESULT_BUTTON_SELECTOR), H.anchors))
    rows = pages.select(key, F.posexplode(links).alias("pos", "_a")).where(F.col("_a.href").isNotNull())
    return rows.select(key, "pos", F.col("_a.href").alias("href"), H.resolve_url("_a.href", variant="detail").alias("url"))


def best_pdf(candidates: DataFrame, payloads: DataFrame, key: str = "page_id") -> DataFrame:
    """The first candidate of each page, by ``pos``, whose fetched payload is a PDF.

    Links of the search page come last when they are added with a higher ``pos``.

    Only the addresses of valid payloads take part in the join, not their contents; an
    address that very many pages link to is spread over tasks.
    """
    valid = payloads.where(H.is_pdf("content", "content_type")).select("url").distinct()
    return salted_join(candidates, valid, ["url"], [key, "pos"]).groupBy(key).agg(F.min_by("url", "pos").alias("pdf_url"))


def resolve_details(links: DataFrame, details: DataFrame, on: tuple[str, ...] = ("disease_id", "pos")) -> DataFrame:
    """One detail per link; where the detail page failed, the link's own title stands in.

    ``details`` holds title, abstract, url, pdf_file and error.
    """
    d = details.select(*on, *[F.col(c).alias(f"_{c}") for c in ("title", "abstract", "url", "pdf_file", "error")])
    joined = links.join(d, list(on), "left")
    reached = F.col("_title").isNotNull() & F.col("_error").isNull()
    return joined.select(
        *on, "disease",
        F.coalesce(F.when(reached, F.col("_url")), F.col("url")).alias("url"),
        F.coalesce(F.when(reached & (F.col("_title") != V.MISSING_TITLE), F.col("_title")), F.col("title"), F.lit(V.UNTITLED)).alias("title"),
        F.when(reached, F.col("_abstract")).alias("abstract"),
        F.when(reached, F.col("_pdf_file")).alias("pdf_file"),
        F.when(~reached, F.coalesce(F.col("_error"), F.lit(V.DETAIL_UNREACHABLE))).alias("error"),
    )


def crawl_results(diseases: DataFrame, details: DataFrame, searches: DataFrame | None = None,
                  max_results: int = V.RESULTS_PER_DISEASE) -> DataFrame:
    """One record per disease: result count, whether the search had results, details and error.

    Details are cut to the first ``max_results`` per disease before they are collected, so a
    record's list never holds more than that many entries. ``searches`` optionally holds
    disease_id, has_results and error of the search itself.
    """
    entry = F.struct("pos", "url", "title", "disease", "txt_file", "pdf_file")
    kept = first_results(details, n=max_results).withColumn("txt_file", article_file("disease", "title"))
    per = kept.groupBy("disease_id").agg(
        F.count(F.lit(1)).alias("result_count"), F.array_sort(F.collect_list(entry)).alias("details")
    )
    out = diseases.join(per, "disease_id", "left")
    has = F.col("result_count").isNotNull()
    error = F.lit(None).cast("string")
    if searches is not None:
        s = searches.select("disease_id", F.col("has_results").alias("_has"), F.col("error").alias("_search_error"))
        out = out.join(s, "disease_id", "left")
        has = F.coalesce("_has", has)
        error = F.col("_search_error")
    kinds = "array<struct<pos:int,url:string,title:string,disease:string,txt_file:string,pdf_file:string>>"
    return out.select(
        *diseases.columns, has.alias("has_results"),
        F.coalesce("result_count", F.lit(0)).cast("bigint").alias("result_count"),
        F.coalesce(F.col("details").cast(kinds), F.array().cast(kinds)).alias("details"),
        error.alias("error"),
    )


def crawl_summary(results: DataFrame) -> DataFrame:
    """Totals over disease records; list fields are counted inside their row."""
    filled = lambda name: F.size(F.filter("details", lambda d: F.coalesce(d[name], F.lit("")) != ""))
    return results.agg(
        F.count(F.lit(1)).alias("diseases"),
        F.coalesce(F.sum(F.col("has_results").cast("bigint")), F.lit(0)).alias("with_results"),
        F.coalesce(F.sum(F.size("details")), F.lit(0)).alias("n_details"),
        F.coalesce(F.sum(filled("txt_file")), F.lit(0)).alias("n_text"),
        F.coalesce(F.sum(filled("pdf_file")), F.lit(0)).alias("n_pdf"),
        F.count("error").alias("n_errors"),
    )


def split_errors(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and error rows ``(disease, error)``; one failed item does not stop the rest."""
    good = results.where(F.col("error").isNull())
    bad = results.where(F.col("error").isNotNull()).select("disease", F.substring("error", 1, V.LENGTHS["error"]).alias("error"))
    return good, bad


# ---- article text ------------------------------------------------------------------------------


def article_text(layout: str, title: Column | str, abstract: Column | str | None = None, disease: Column | str | None = None,
                 disease_id: Column | str | None = None, url: Column | str | None = None,
                 fetched_at: Column | None = None, error: Column | str | None = None) -> Column:
    """Text of an article file.

    ``site1``: title and abstract, or the title alone when there is no abstract;
    ``site2``: six labelled lines; ``failed``: the record of an unreachable detail page.
    """
    label = V.ARTICLE_LABELS

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(label[name]), F.coalesce(col(value).cast("string"), F.lit("")), F.lit("\n"))

    if layout == "site1":
        a = F.col("abstract") if abstract is None else col(abstract)
        has = F.coalesce((a != "") & (a != V.MISSING_ABSTRACT), F.lit(False))
        return F.concat(line("title", title), F.when(has, F.concat(F.lit("\n"), line("abstract", a))).otherwise(F.lit("")))
    head = [line("disease", disease), line("disease_id", disease_id), line("title", title)]
    if layout == "site2":
        return F.concat(*head, line("abstract", abstract), line("url", url), line("time", F.date_format(fetched_at, V.TIME_FORMAT)))
    return F.concat(*head, line("status", F.lit(V.DETAIL_UNREACHABLE)), line("error", F.substring(col(error), 1, V.LENGTHS["error"])))


def article_files(found: DataFrame, part: Column, website: Column, text: Column, site: str = "site1",
                  suffix: str = ".txt") -> DataFrame:
    """Folder key, file name and text of every article; files of failed pages end in ``_basic.txt``."""
    with_id = None if site == "site1" else "disease_id"
    return found.select(
        part.alias("part"), website.alias("website"), disease_key("disease_id", "disease").alias("disease_key"),
        article_file("disease", "title", with_id, suffix).alias("file"), text.alias("text"),
    )


def abstract_preview(abstract: Column | str) -> Column:
    return preview(abstract, V.LENGTHS["preview"])
