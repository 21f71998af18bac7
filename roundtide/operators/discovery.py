"""End-to-end discovery: ranked results -> pages -> facts and rounds -> blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundtide import dims
from roundtide.functions.grams import keyword_matches, page_matches
from roundtide.functions.text import any_contains, collapse, empty_array, present, stable_key
from roundtide.functions.urls import (
    is_noisy_url,
    is_portal_search_url,
    is_stage_schedule_url,
    portal_search_links,
)
from roundtide.operators.extraction import (
    collect_facts,
    page_facts,
    page_rounds,
    scrub_performance_windows,
    tour_dates,
    tour_venue,
    venues,
)
from roundtide.operators.joins import by_shuffle, salted_join
from roundtide.operators.ranking import choose_official
from roundtide.operators.rounds import dedupe_rounds, normalize_rounds
from roundtide.sources.tables import written


def follow_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Link rows joined to the stored page they point at.

    Portal searches are skipped; a link without a stored page is dead and drops out. A page that very
    many links point at is copied, and its links are dealt over the copies.
    """
    wanted = links.where(~is_portal_search_url(F.col("url"))).distinct()
    return salted_join(wanted, pages, "url")


def schedule_pages(links: DataFrame, pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Stored live/tour/schedule pages linked from a page, all or the first ``limit`` per page.

    ``links`` is (page_id, page_url, pos, label, url).
    """
    hay = F.lower(F.concat_ws(" ", "label", "url"))
    wanted = links.where(
        any_contains(hay, dims.SCHEDULE_LINK_HINTS) & (F.col("url") != F.col("page_url")) & ~is_noisy_url(F.col("url"))
    )
    first = wanted.groupBy("page_id", "url").agg(F.min("pos").alias("pos"))
    found = salted_join(first, pages.withColumnRenamed("page_id", "to_page_id"), "url")
    if limit is None:
        return found
    w = Window.partitionBy("page_id").orderBy("pos")
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).drop("rn")


def curated_first(sources: DataFrame, found: DataFrame) -> DataFrame:
    """Public curated sources win over discovered pages of the same watch; private notes are never read."""
    public = sources.where(~F.col("private_note") & ~F.col("muted")).select("watch_id", "url")
    rest = found.join(public.select("watch_id"), "watch_id", "left_anti").select("watch_id", "url")
    return public.withColumn("curated", F.lit(True)).unionByName(rest.withColumn("curated", F.lit(False)))


def merge_links(found: DataFrame, manual: DataFrame) -> DataFrame:
    """Found links plus manual ones with a new URL."""
    extra = manual.select("watch_id", "url").distinct().join(found.select("watch_id", "url"), ["watch_id", "url"], "left_anti")
    return found.select("watch_id", "url", F.lit("found").alias("origin")).unionByName(
        extra.withColumn("origin", F.lit("manual"))
    )


def artist_fallback(artists: DataFrame, shows: DataFrame) -> DataFrame:
    """A portal-search event for artists without any show."""
    bare = artists.join(shows.select("watch_id"), "watch_id", "left_anti")
    return bare.select(
        "watch_id",
        "keyword",
        F.concat(F.col("keyword"), F.lit(" ticket search")).alias("title"),
        portal_search_links(F.col("keyword"))[0]["url"].alias("official_url"),
        F.lit("No upcoming shows found yet; trusted ticket portal searches for this artist.").alias("summary"),
    )


def official_pages(results: DataFrame, parsed: DataFrame, limit: int | None = 3, intro_chars: int | None = None) -> DataFrame:
    """Best results per keyword (top-k, or all with ``None``) that have a stored page matching the keyword."""
    chosen = choose_official(results, limit).select("keyword", "url", "place")
    joined = chosen.join(by_shuffle(parsed), "url")
    return joined.where(page_matches(F.col("keyword"), F.coalesce("title", F.lit("")), F.col("text"), intro_chars))


def event_blocks(owned: DataFrame, parsed: DataFrame, as_of: Column, scope: str = "keyword") -> dict[str, DataFrame]:
    """Facts, header and rounds of every owner of ordered pages.

    ``owned`` is parsed pages with the owner column ``scope`` and an ordinal ``place``. Each
    distinct page is extracted once, whoever shares it. Facts stay in long form. Runs jobs: the
    per-page facts go through a written table.
    """
    # Facts feed the header, the links and the rounds: written once, not recomputed per use.
    facts = written(page_facts(owned), "page_facts")
    long = written(collect_facts(facts, [scope], "place"), "facts")
    owned = facts
    head = facts.groupBy(scope).agg(F.min(F.struct("place", "url", "title", "summary")).alias("h")).select(
        scope,
        F.col("h.url").alias("official_url"),
        F.coalesce(present(F.col("h.title")), F.col(scope).cast("string")).alias("title"),
        F.col("h.summary").alias("summary"),
    )
    links = long.where(F.col("kind") == "ticket_links").select(scope, F.col("value").alias("url"), "label")
    linked = follow_links(links.select(scope, "url"), parsed.select("page_id", "url", "text"))
    base = owned.select(scope, "url", F.struct(F.lit(0).alias("lane"), F.col("place").cast("bigint").alias("n")).alias("lane"))
    extra = linked.select(scope, "url", F.struct(F.lit(1).alias("lane"), F.col("page_id").alias("n")).alias("lane"))
    owners = base.unionByName(extra).groupBy(scope, "url").agg(F.min("lane").alias("lane"))
    texts = parsed.select("page_id", "url", "text").join(by_shuffle(owners.select("url").distinct()), "url", "left_semi")
    rounds = owners.join(by_shuffle(page_rounds(texts, as_of)), "url")
    dates = (
        long.where(F.col("kind") == "event_dates").groupBy(scope).agg(F.collect_set("value").alias("event_dates"))
    )
    scrubbed = scrub_performance_windows(rounds.join(by_shuffle(dates), scope, "left"), as_of).drop("event_dates")
    final = dedupe_rounds(normalize_rounds(scrubbed, as_of), [scope], ["lane", "round_ord"])
    return {"header": head, "facts": long, "links": links, "rounds": final}


def with_portal_links(keywords: DataFrame, links: DataFrame) -> DataFrame:
    """Ticket links plus portal searches for the keywords that have none."""
    bare = keywords.join(by_shuffle(links.select("keyword")), "keyword", "left_anti")
    portal = bare.select("keyword", F.inline(portal_search_links(F.col("keyword")))).select("keyword", "url", "label")
    return links.unionByName(portal)


def build_blocks(
    results: DataFrame, parsed: DataFrame, as_of: Column, limit: int | None = 3, intro_chars: int | None = None
) -> dict[str, DataFrame]:
    """Keyword search over a stored corpus; portal searches stand in when no ticket link is found."""
    owned = official_pages(results, parsed, limit, intro_chars)
    blocks = event_blocks(owned, parsed, as_of)
    keywords = results.select("keyword").distinct()
    blocks["links"] = with_portal_links(keywords, blocks["links"])
    missing = keywords.join(by_shuffle(blocks["header"].select("keyword")), "keyword", "left_anti").select(
        "keyword", F.lit(None).cast("string").alias("official_url"), F.col("keyword").alias("title"),
        F.lit(None).cast("string").alias("summary"),
    )
    blocks["header"] = blocks["header"].unionByName(missing)
    return blocks


def build_exact(requests: DataFrame, parsed: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """Blocks of exactly named pages: (keyword, url, snippet); the snippet stands in for a missing summary."""
    owned = requests.select("keyword", "url").join(by_shuffle(parsed), "url").withColumn("place", F.lit(1))
    blocks = event_blocks(owned, parsed, as_of)
    hint = requests.groupBy("keyword").agg(F.min("snippet").alias("snippet"))
    blocks["header"] = blocks["header"].join(by_shuffle(hint), "keyword", "left").withColumn(
        "summary", F.coalesce("summary", present(F.col("snippet")))
    ).drop("snippet")
    blocks["links"] = with_portal_links(requests.select("keyword").distinct(), blocks["links"])
    return blocks


def watch_blocks(
    watches: DataFrame, sources: DataFrame, results: DataFrame, parsed: DataFrame, as_of: Column
) -> dict[str, DataFrame]:
    """Event lane for all watches: curated public pages (and the stage schedules they link), else search."""
    live = watches.select("watch_id", "keyword")
    curated = sources.where(~F.col("private_note") & ~F.col("muted")).join(live.select("watch_id"), "watch_id", "left_semi")
    own = curated.select("watch_id", F.col("source_id").alias("place"), "url").join(by_shuffle(parsed), "url")
    stage = own.select("watch_id", "place", F.explode("links").alias("l")).where(is_stage_schedule_url(F.col("l.url")))
    linked = stage.select("watch_id", "place", F.col("l.url").alias("url")).join(by_shuffle(parsed), "url")
    searched = live.join(by_shuffle(own.select("watch_id")), "watch_id", "left_anti")
    found = official_pages(results.join(by_shuffle(searched.select("keyword")), "keyword", "left_semi"), parsed).join(
        by_shuffle(searched), "keyword"
    )
    columns = ["watch_id", "place", *parsed.columns]
    owned = (
        own.select(*columns)
        .unionByName(linked.select(*columns))
        .unionByName(found.select("watch_id", F.col("place").cast("bigint").alias("place"), *parsed.columns))
    )
    first = owned.groupBy("watch_id", "url").agg(F.min("place").alias("place"))
    unique = first.join(by_shuffle(parsed), "url")
    blocks = event_blocks(unique, parsed, as_of, scope="watch_id")
    manual = sources.where(~F.col("muted")).select("watch_id", "url")
    blocks["all_links"] = merge_links(blocks["links"].select("watch_id", "url"), manual)
    return blocks


def detail_links(shows: DataFrame, links: DataFrame) -> DataFrame:
    """First link of the show's page whose label names the show (title and label match either way)."""
    title, label = collapse(F.col("title")), collapse(F.col("label"))
    usable = links.where(
        ~is_noisy_url(F.col("url"))
        & (F.col("url") != F.col("page_url"))
        & (F.length(label) >= 4)
        & ~any_contains(F.lower("url"), dims.DETAIL_LINK_SKIPS)
    ).select("page_id", "pos", label.alias("label"), F.col("url").alias("detail_url"))
    bare = shows.where((F.col("venue") == "") & (F.length(title) >= 4)).select("page_id", "date", "title")
    pairs = bare.join(usable, "page_id").where(
        keyword_matches(F.col("title"), F.col("label")) | keyword_matches(F.col("label"), F.col("title"))
    )
    return pairs.groupBy("page_id", "date", "title").agg(F.min(F.struct("pos", "detail_url")).alias("d")).select(
        "page_id", "date", "title", "d.detail_url"
    )


def page_venue(text: Column, intro_chars: int | None = None) -> Column:
    """First venue of a detail page, else a place it names (near its start with ``intro_chars``)."""
    intro = text if intro_chars is None else F.substring(text, 1, intro_chars)
    return F.coalesce(F.try_element_at(venues(text), F.lit(1)), present(tour_venue(intro)), F.lit(""))


def enrich_venues(shows: DataFrame, parsed: DataFrame, links: DataFrame, per_owner: list[str], limit: int | None = None) -> DataFrame:
    """Fill missing show venues from detail pages, with ``limit`` only that many look-ups per owner."""
    wanted = detail_links(shows, links)
    w = Window.partitionBy(*per_owner).orderBy("page_id", "date", "title")
    capped = wanted.join(shows.select("page_id", *[c for c in per_owner if c != "page_id"]).distinct(), "page_id")
    if limit is not None:
        capped = capped.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)
    found = capped.join(
        parsed.select(F.col("url").alias("detail_url"), "text"), "detail_url"
    ).select(*per_owner, "page_id", "date", "title", page_venue(F.col("text")).alias("detail_venue"))
    keys = list(dict.fromkeys([*per_owner, "page_id", "date", "title"]))
    return shows.join(found.select(*keys, "detail_venue"), keys, "left").withColumn(
        "venue", F.when(F.col("venue") != "", F.col("venue")).otherwise(F.coalesce("detail_venue", F.lit("")))
    ).drop("detail_venue")


def artist_shows(owned: DataFrame, parsed: DataFrame, links: DataFrame, as_of: Column) -> DataFrame:
    """Shows of artists: schedule pages of the artist's pages, else those pages themselves.

    ``owned`` is (keyword, page_id, place). Ended shows drop out, the first of equal (date,
    title) wins per artist, and every show gets its own URL fragment.
    """
    sched = schedule_pages(links, parsed.select("page_id", "url"))
    hop = owned.join(sched.select("page_id", "to_page_id", "pos"), "page_id", "left")
    lanes = hop.select(
        "keyword", "place", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("to_page_id", "page_id").alias("page_id")
    )
    once = lanes.groupBy("keyword", "page_id").agg(F.min(F.struct("place", "pos")).alias("at"))
    targets = parsed.join(once.select("page_id").distinct(), "page_id", "left_semi")
    entries = tour_dates(targets, as_of).where(~F.col("ended")).withColumnRenamed("pos", "entry_pos")
    shows = once.join(entries, "page_id")
    first = shows.groupBy("keyword", "date", "title").agg(
        F.min(F.struct("at", "entry_pos", "page_id", "url", "date_text", "venue")).alias("f")
    ).select("keyword", "date", "title", "f.page_id", "f.url", "f.date_text", "f.venue")
    rich = enrich_venues(first, parsed, links, ["keyword"])
    day = F.col("date")
    tail = F.substring(stable_key(F.concat(day, F.lit("|"), F.coalesce(present(F.col("title")), F.col("venue")))), 1, 6)
    return rich.select(
        "keyword",
        "date",
        "title",
        "venue",
        F.concat(F.col("url"), F.lit("#"), F.replace(day, F.lit("-"), F.lit("")), F.lit("-"), tail).alias("official_url"),
        F.concat_ws(" ", present(F.col("date_text")), present(F.col("title")), present(F.col("venue"))).alias("summary"),
        F.array(F.coalesce(present(F.col("date_text")), day)).alias("event_dates"),
        F.when(F.col("venue") != "", F.array("venue")).otherwise(empty_array()).alias("venues"),
    )


def blocks_to_batch(blocks: dict[str, DataFrame], watches: DataFrame, scope: str = "keyword") -> dict[str, DataFrame]:
    """Blocks of keywords or watches as one save batch; events are keyed by (watch, page), ids are stable hashes."""
    long = blocks["facts"]

    def values(kind: str) -> DataFrame:
        picked = long.where(F.col("kind") == kind)
        return picked.groupBy(scope).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("first", "value"))), lambda x: x["value"]).alias(kind)
        )

    url = F.coalesce("official_url", F.concat(F.lit("keyword:"), F.col("keyword")))
    events = (
        blocks["header"]
        .join(watches.select("watch_id", "keyword"), scope)
        .join(values("event_dates"), scope, "left")
        .join(values("venues"), scope, "left")
        .withColumn("official_url", url)
        .select(
            stable_key(F.concat_ws("|", F.col("watch_id").cast("string"), F.col("official_url"))).alias("event_id"),
            "watch_id", "keyword", F.coalesce("title", "keyword").alias("title"), "official_url", "summary",
            F.coalesce("event_dates", empty_array()).alias("event_dates"),
            F.coalesce("venues", empty_array()).alias("venues"),
        )
    )
    ids = events.select(scope, "event_id")
    return {
        "events": events.drop("keyword"),
        "links": blocks["links"].join(ids, scope).select("event_id", "url", "label"),
        "rounds": blocks["rounds"].drop("lane", "round_ord", "page_id", "status", "round_key").join(ids, scope).drop(scope),
    }
