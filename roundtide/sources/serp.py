"""Stored search results: provider JSON, result-page HTML, redirects, provider order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundtide.functions.text import collapse, unescape_html
from roundtide.functions.urls import is_web_url, unwrap_redirect, url_host

# --- fixed values: provider field names and result markup --------------------
PROVIDER_KEYS = {
    "brave": ("$.web.results", "title", "url", "description"),
    "bing": ("$.webPages.value", "name", "url", "snippet"),
    "serpapi": ("$.organic_results", "title", "link", "snippet"),
}
RESULT_BLOCK = r"(?s)<li class=\"b_algo\".*?</li>"
RESULT_ANCHOR = r"(?s)<h2[^>]*>\s*<a[^>]+href=\"([^\"]+)\"[^>]*>(.*?)</a>"
RESULT_SNIPPET = r"(?s)<p[^>]*>(.*?)</p>"


def _first_n(rows: DataFrame, limit: int | None) -> DataFrame:
    """Ranked rows per keyword; a ``limit`` becomes a group limit that trims map-side."""
    w = Window.partitionBy("keyword").orderBy("ord")
    return (
        rows.withColumn("rank", F.row_number().over(w))
        .where(F.lit(True) if limit is None else F.col("rank") <= limit)
        .select("keyword", "rank", "title", "url", "snippet")
    )


def ingest_json(payloads: DataFrame, limit: int | None = None) -> DataFrame:
    """(keyword, provider, payload JSON) -> ranked results, whatever the provider's field names."""
    item = "array<struct<title:string,name:string,url:string,link:string,description:string,snippet:string>>"

    rows, title, url, snippet = F.lit(None).cast("string"), F.lit(""), F.lit(""), F.lit("")
    for provider, (path, t, u, s) in PROVIDER_KEYS.items():
        here = F.col("provider") == provider
        rows = F.when(here, F.get_json_object("payload", path)).otherwise(rows)
        title = F.when(here, F.col(f"r.{t}")).otherwise(title)
        url = F.when(here, F.col(f"r.{u}")).otherwise(url)
        snippet = F.when(here, F.col(f"r.{s}")).otherwise(snippet)
    exploded = payloads.select(
        "keyword", "provider", F.posexplode(F.from_json(rows, item)).alias("ord", "r")
    )
    clean = exploded.select(
        "keyword",
        "ord",
        collapse(F.coalesce(title, F.lit(""))).alias("title"),
        url.alias("url"),
        collapse(F.coalesce(snippet, F.lit(""))).alias("snippet"),
    ).where(is_web_url(F.col("url")))
    return _first_n(clean, limit)


def _untagged(markup):
    return collapse(F.regexp_replace(unescape_html(markup), r"<[^>]+>", " "))


def ingest_html(result_pages: DataFrame, own_host: str = "bing.com", limit: int | None = None) -> DataFrame:
    """(keyword, html) of list-block result pages -> ranked results, own host dropped, first URL wins."""
    blocks = result_pages.select(
        "keyword", F.posexplode(F.regexp_extract_all("html", F.lit(RESULT_BLOCK), F.lit(0))).alias("ord", "block")
    )
    rows = blocks.select(
        "keyword",
        "ord",
        unwrap_redirect(F.regexp_extract("block", RESULT_ANCHOR, 1)).alias("url"),
        _untagged(F.regexp_extract("block", RESULT_ANCHOR, 2)).alias("title"),
        _untagged(F.regexp_extract("block", RESULT_SNIPPET, 1)).alias("snippet"),
    ).where((F.col("title") != "") & is_web_url(F.col("url")) & ~url_host(F.col("url")).endswith(own_host))
    first = rows.groupBy("keyword", "url").agg(F.min(F.struct("ord", "title", "snippet")).alias("f"))
    return _first_n(first.select("keyword", "url", "f.*"), limit)


def ingest_link_results(links: DataFrame, limit: int | None = None) -> DataFrame:
    """(keyword, ord, label, url) links of a redirecting result page -> ranked results."""
    wrapped = links.where(F.contains("url", F.lit("uddg=")) | F.contains("url", F.lit("duckduckgo.com/l/")))
    rows = wrapped.select(
        "keyword", "ord", F.col("label").alias("title"), unwrap_redirect(F.col("url")).alias("url"), F.lit("").alias("snippet")
    ).where(F.col("url").startswith("http"))
    return _first_n(rows, limit)


def prefer_sources(*sources: DataFrame) -> DataFrame:
    """Per keyword, all rows of the first source that has any (earlier arguments win)."""
    tagged = [df.withColumn("prio", F.lit(i)) for i, df in enumerate(sources)]
    rows = tagged[0]
    for df in tagged[1:]:
        rows = rows.unionByName(df)
    best = rows.groupBy("keyword").agg(F.min("prio").alias("prio"))
    return rows.join(best, ["keyword", "prio"], "left_semi")
