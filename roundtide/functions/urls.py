"""URL classification as column expressions (all codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roundtide import dims
from roundtide.functions.text import any_contains, collapse, first_listed, lookup, present

_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"
HOST_PART = _SCHEME + r"//([^/?#]*)"


def url_host(url: Column) -> Column:
    netloc = F.lower(F.regexp_extract(url, HOST_PART, 1))
    return F.regexp_replace(netloc, r"^www\.", "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)


def url_fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def is_web_url(url: Column) -> Column:
    return F.coalesce(url, F.lit("")).rlike(r"^(?i:https?)://[^/?#]+")


def is_noisy_url(url: Column) -> Column:
    return any_contains(url_host(F.coalesce(url, F.lit(""))), dims.NOISY_HOSTS)


def is_noisy_host_strict(url: Column) -> Column:
    """Suffix match on host labels, for callers that want ``box.com`` kept."""
    host = url_host(F.coalesce(url, F.lit("")))
    hits = [(host == h) | host.endswith("." + h) for h in dims.NOISY_HOSTS]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return out


def is_ticket_url(url: Column) -> Column:
    hosts = [h for fragments in dims.TICKET_PLATFORMS.values() for h in fragments]
    return any_contains(url_host(url), hosts)


def platform_of_host(host: Column) -> Column:
    """``platform_name`` of a host column by plain substring tests; the host is named often, so bring it as a column of its own."""
    known = F.lit(None).cast("string")
    for name, fragments in reversed(dims.TICKET_PLATFORMS.items()):
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | F.contains(host, F.lit(fragment))
        known = F.when(hit, name).otherwise(known)
    return F.coalesce(known, present(host), F.lit("unknown"))


def platform_name(url: Column) -> Column:
    """First platform in dictionary order whose host fragment occurs, else the host."""
    host = url_host(url)
    by_fragment = {f: name for name, fragments in dims.TICKET_PLATFORMS.items() for f in fragments}
    fragment = first_listed(host, dims.TICKET_PLATFORMS.values())
    return F.coalesce(lookup(by_fragment, fragment), present(host), F.lit("unknown"))


def is_portal_search_url(url: Column) -> Column:
    host, path = url_host(url), F.lower(url_path(url))
    return (
        ((host == "t.pia.jp") & path.endswith("/search_all.do"))
        | ((host == "eplus.jp") & path.startswith("/sf/search"))
        | ((host == "l-tike.com") & path.startswith("/search/"))
    )


def is_stage_schedule_url(url: Column) -> Column:
    return (url_host(url) == dims.GENERIC_INFO_HOST) & (url_path(url) == dims.STAGE_SCHEDULE_PATH)


def is_generic_ticket_info_url(url: Column) -> Column:
    path = F.regexp_replace(url_path(url), "/+$", "")
    return (url_host(url) == dims.GENERIC_INFO_HOST) & (
        path.isin(*dims.GENERIC_INFO_PATHS) | path.startswith("/tickets_guide/")
    )


def is_actionable_ticket_link(url: Column, label: Column) -> Column:
    haystack = F.lower(F.concat(F.coalesce(label, F.lit("")), F.lit(" "), url))
    on_official = url_host(url).isin(*dims.OFFICIAL_HOSTS) & (
        F.lower(url_fragment(url)).isin("schedule", "ticket", "tickets")
        | F.contains(F.lower(url_path(url)), F.lit("/stage/"))
    )
    return (
        ~is_noisy_url(url)
        & ~is_generic_ticket_info_url(url)
        & ~any_contains(haystack, ("hoken", "insurance"))
        & ~on_official
        & is_ticket_url(url)
    )


def provenance(url: Column, label: Column) -> Column:
    platform = platform_name(url)
    haystack = F.lower(F.concat(F.coalesce(label, F.lit("")), F.lit(" "), url))
    return (
        F.when(platform.isin(*dims.TICKET_PLATFORMS), "ticket_primary")
        .when(any_contains(haystack, dims.OFFICIAL_HINTS), "official")
        .when(platform == "unknown", "low_confidence")
        .otherwise("manual_public")
    )


def platform_confidence(platform: Column) -> Column:
    return (
        F.when(platform.isin(*dims.TICKET_PLATFORMS), 90)
        .when(platform.isin("official", "manual"), 70)
        .otherwise(50)
    )


def link_confidence(url: Column, label: Column) -> Column:
    haystack = F.lower(F.concat(F.coalesce(label, F.lit("")), F.lit(" "), url))
    return (
        F.when(is_actionable_ticket_link(url, label), 90)
        .when(any_contains(haystack, dims.TICKET_LINK_HINTS), 60)
        .otherwise(40)
    )


def resolve_link(base: Column, href: Column) -> Column:
    """Relative link resolution: scheme, ``//``, ``/``, ``?``, ``#`` and path-relative forms."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    no_fragment = F.regexp_replace(base, "#.*$", "")
    no_query = F.regexp_replace(base, r"[?#].*$", "")
    base_dir = F.when(url_path(base) == "", F.concat(origin, F.lit("/"))).otherwise(
        F.regexp_extract(no_query, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*.*/)", 1)
    )
    joined = (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(no_query, href))
        .when(href.startswith("#"), F.concat(no_fragment, href))
        .otherwise(F.concat(base_dir, href))
    )
    return F.when(
        joined.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://") & joined.rlike(r"/\.{1,2}(?:/|$|[?#])"),
        _without_dot_segments(joined),
    ).otherwise(joined)


def _without_dot_segments(url: Column) -> Column:
    """Fold ``.`` and ``..`` path segments left to right."""
    origin = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)
    path = url_path(url)
    tail = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    # A trailing "." or ".." leaves a directory, so it contributes an empty last segment.
    segments = F.when(path.rlike(r"/\.{1,2}$"), F.concat(segments, F.array(F.lit("")))).otherwise(segments)
    kept = F.aggregate(
        segments,
        F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(origin, F.lit("/"), F.array_join(kept, "/"), tail)


def unwrap_redirect(url: Column) -> Column:
    """Target behind a ``uddg=`` or base64url ``u=a1..`` redirect, else the URL itself."""
    query = F.regexp_extract(F.replace(url, F.lit("&amp;"), F.lit("&")), r"\?([^#]*)", 1)
    uddg = F.regexp_extract(query, r"(?:^|&)uddg=([^&]+)", 1)
    packed = F.regexp_extract(query, r"(?:^|&)u=a1([^&]*)", 1)
    body = F.rpad(
        F.translate(packed, "-_", "+/"),
        F.ceil(F.length(packed) / 4).cast("int") * 4,
        F.lit("="),
    )
    decoded = F.try_to_binary(body, F.lit("base64"))
    return (
        F.when(uddg != "", F.try_url_decode(uddg))
        .when(packed != "", F.coalesce(F.decode(decoded, "utf-8"), url))
        .otherwise(url)
    )


def portal_search_links(keyword: Column) -> Column:
    """Three portal searches as an array of (label, url)."""
    plus = F.replace(F.replace(F.url_encode(keyword), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    percent = F.replace(F.replace(plus, F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    rows = (
        ("Pia search", F.concat(F.lit("https://t.pia.jp/pia/search_all.do?kw="), plus)),
        ("eplus search", F.concat(F.lit("https://eplus.jp/sf/search?block=true&keyword="), plus)),
        ("Lawson Ticket search", F.concat(F.lit("https://l-tike.com/search/?keyword="), percent)),
    )
    return F.array(*[F.struct(F.lit(label).alias("label"), url.alias("url")) for label, url in rows])
