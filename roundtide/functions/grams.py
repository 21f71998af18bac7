"""Character bigrams and keyword relevance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roundtide import dims
from roundtide.functions.text import any_contains, bind, collapse
from roundtide.functions.urls import is_ticket_url, url_host

# --- fixed values: characters ignored by bigrams ----------------------------
IGNORED = r"(?U)[\s　〜～・！？、。「」『』【】（）()\"'’”|/\\\-]+"
LATIN_KEYWORD = r"^[a-z0-9 ._'\-]+$"


def squeezed(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), IGNORED, "")


def bigrams(value: Column) -> Column:
    """Distinct bigrams in one linear pass (a look-ahead captures the pair)."""
    return F.array_distinct(F.regexp_extract_all(squeezed(value), F.lit(r"(?s)(?=(..))."), F.lit(1)))


def overlap_of(keyword_grams: Column, text_grams: Column) -> Column:
    n = F.size(keyword_grams)
    shared = F.size(F.array_intersect(keyword_grams, text_grams))
    return F.when(n == 0, F.lit(0.0)).otherwise(shared / n)


def keyword_overlap(keyword: Column, text: Column) -> Column:
    """Share of the keyword's bigrams in the text; the text is squeezed once and searched for each."""
    return bind(
        F.struct(bigrams(keyword).alias("grams"), squeezed(text).alias("text")),
        lambda x: F.when(F.size(x["grams"]) == 0, F.lit(0.0)).otherwise(
            F.size(F.filter(x["grams"], lambda g: F.contains(x["text"], g))) / F.size(x["grams"])
        ),
    )


def keyword_matches(keyword: Column, text: Column) -> Column:
    """Substring, else a token of three or more characters, else bigram overlap (non-Latin)."""
    kw, haystack = F.lower(collapse(keyword)), F.lower(collapse(text))
    token_hit = F.exists(F.split(kw, " "), lambda t: (F.length(t) >= 3) & F.contains(haystack, t))
    return (
        F.when(kw == "", F.lit(False))
        .when(F.contains(haystack, kw), F.lit(True))
        .when(token_hit, F.lit(True))
        .when(kw.rlike(LATIN_KEYWORD), F.lit(False))
        .otherwise(keyword_overlap(keyword, text) >= dims.MIN_KEYWORD_OVERLAP)
    )


def page_matches(keyword: Column, title: Column, text: Column, intro_chars: int | None = None) -> Column:
    """Match on title and text; ``intro_chars`` restricts it to the start of the text."""
    intro = text if intro_chars is None else F.substring(text, 1, intro_chars)
    return keyword_matches(keyword, F.concat(title, F.lit(" "), intro))


def official_score(title: Column, url: Column, snippet: Column, keyword: Column) -> Column:
    host = url_host(url)
    title_snippet = F.concat_ws(" ", title, snippet)
    text = F.lower(F.concat_ws(" ", title, snippet, url))
    tokens = F.split(F.lower(collapse(keyword)), " ")
    token_score = 2.0 * F.size(F.filter(tokens, lambda t: (F.length(t) >= 3) & F.contains(text, t)))
    noisy = any_contains(host, dims.NOISY_HOSTS)
    trusted = any_contains(host, dims.OFFICIAL_HOSTS)
    relevant = keyword_matches(keyword, title_snippet) | (token_score > 0)

    def points(flag: Column, value: float) -> Column:
        return F.when(flag, F.lit(value)).otherwise(F.lit(0.0))

    full = (
        points(noisy, -20.0)
        + points(is_ticket_url(url), -5.0)
        + points(any_contains(text, dims.OFFICIAL_HINTS), 10.0)
        + 30.0 * keyword_overlap(keyword, title_snippet)
        + token_score
        + points(trusted, 6.0)
        + points(host.endswith(".co.jp") | host.endswith(".or.jp"), 4.0)
        + points(any_contains(url, ("news", "live", "stage")), 3.0)
    )
    return F.when(~trusted & ~relevant, points(noisy, -20.0)).otherwise(full)
