"""Keyed table maintenance: upserts, change rows, scoped pruning, cleanup, one-batch apply.

Nothing is updated in place: each operator reads an old snapshot, joins the batch on the key
and returns the next version, which ``sources.tables`` publishes under a new path. All joins
are equi-joins on the table key, so state bucketed by that key joins without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundtide import dims
from roundtide.functions.text import collapse, joined_key, present, round_name_key
from roundtide.functions.urls import (
    is_actionable_ticket_link,
    is_portal_search_url,
    is_web_url,
    link_confidence,
    platform_confidence,
    platform_name,
    provenance,
)

ROUND_ID = ["event_id", "round_key"]


# --- generic pieces -----------------------------------------------------------------

def latest_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row per key by ``order``; a grouped max, so duplicates shrink before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_l")).select(*keys, *[f"_l.{c}" for c in rest])


def one_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the last by ``ord`` where there is such a column, else the greatest row."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    ranked = sorted(rest, key=lambda c: c != "ord")
    return rows.groupBy(*keys).agg(F.max(F.struct(*ranked)).alias("_l")).select(*keys, *[f"_l.{c}" for c in rest])


def stable_id(*parts: Column) -> Column:
    """A positive id of 60 bits from the natural key."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], kept: tuple[str, ...] = ()) -> DataFrame:
    """Next version of ``old``: new rows win, columns in ``kept`` keep their old value.

    The batch may repeat a key; its last row counts. Adds ``is_new`` (key not seen before) and
    ``touched`` (key in the batch).
    """
    new = one_per_key(new, keys)
    o, n = old.withColumn("_o", F.lit(True)), new.withColumn("_n", F.lit(True))
    joined = o.alias("o").join(n.alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    out = []
    for c in old.columns:
        if c in keys:
            value = F.coalesce(f"o.{c}", f"n.{c}")
        elif c not in new.columns:
            value = F.col(f"o.{c}")
        elif c in kept:
            value = F.coalesce(f"o.{c}", f"n.{c}")
        else:
            value = F.when(F.col("n._n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        out.append(value.alias(c))
    return joined.select(*out, F.col("o._o").isNull().alias("is_new"), F.col("n._n").isNotNull().alias("touched"))


# --- watches, sources, subscriptions --------------------------------------------------

def upsert_watches(watches: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Add watches by keyword.

    ``requests`` is (ord, keyword, explicit, kind, tags, preferred_regions, preferred_venues,
    alert_preferences). Explicit requests overwrite preferences and unmute; implicit ones only
    create a default watch or touch ``updated_at``. Of several explicit requests the last wins.
    """
    fields = ["kind", "tags", "preferred_regions", "preferred_venues", "alert_preferences"]
    asked = requests.groupBy("keyword").agg(
        F.max(F.when(F.col("explicit"), F.struct("ord", *fields))).alias("r")
    ).withColumn("_n", F.lit(True))
    w = watches.withColumn("_o", F.lit(True)).alias("w")
    j = w.join(asked.alias("n"), "keyword", "full_outer")
    default = {
        "kind": F.lit("event"), "tags": F.lit(""), "preferred_regions": F.lit(""),
        "preferred_venues": F.lit(""), "alert_preferences": F.lit(",".join(dims.ALERT_TYPES)),
    }
    explicit = F.col("n.r").isNotNull()
    picked = {
        c: F.when(explicit, F.col(f"n.r.{c}")).when(F.col("w._o"), F.col(f"w.{c}")).otherwise(default[c]) for c in fields
    }
    shaped = ("watch_id", "keyword", *fields, "muted", "updated_at", "created_at")
    return j.select(
        F.coalesce("w.watch_id", stable_id(F.col("keyword"))).alias("watch_id"),
        "keyword",
        *[picked[c].alias(c) for c in fields],
        *[F.col(f"w.{c}").alias(c) for c in watches.columns if c not in shaped],
        F.when(explicit, F.lit(False)).otherwise(F.coalesce("w.muted", F.lit(False))).alias("muted"),
        F.when(F.col("n._n"), now).otherwise(F.col("w.updated_at")).alias("updated_at"),
        F.coalesce("w.created_at", now).alias("created_at"),
        F.col("w._o").isNull().alias("is_new"),
    )


def subscribe_users(user_watches: DataFrame, requests: DataFrame) -> DataFrame:
    """Insert-or-ignore of (user_id, watch_id) pairs."""
    return user_watches.select("user_id", "watch_id").unionByName(requests.select("user_id", "watch_id")).distinct()


def resolve_watch(requests: DataFrame, watches: DataFrame) -> DataFrame:
    """Attach ``watch_id`` to rows with an ``identifier`` (digits name an id, else a keyword)."""
    digits = F.col("identifier").rlike("^[0-9]+$")
    ids = watches.select("watch_id", "keyword")
    by_id = requests.where(digits).withColumn("watch_id", F.col("identifier").try_cast("bigint")).join(
        ids.select("watch_id"), "watch_id", "left_semi"
    )
    by_keyword = requests.where(~digits).join(
        ids.withColumnRenamed("keyword", "identifier"), "identifier"
    )
    return by_id.unionByName(by_keyword)


def apply_mutes(watches: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Soft mute / unmute by id or keyword; ``requests`` is (ord, identifier, muted, only_if_changed).

    Adds ``changed``: the request touched the row.
    """
    wanted = latest_per_key(
        resolve_watch(requests, watches).select("watch_id", "ord", F.col("muted").alias("want"), "only_if_changed"), ["watch_id"], "ord"
    )
    j = watches.join(wanted, "watch_id", "left")
    changed = F.col("want").isNotNull() & (~F.col("only_if_changed") | (F.col("want") != F.col("muted")))
    return j.select(
        *[c for c in watches.columns if c not in ("muted", "updated_at")],
        F.when(changed, F.col("want")).otherwise(F.col("muted")).alias("muted"),
        F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at"),
        changed.alias("changed"),
    )


def mute_sources(sources: DataFrame, requests: DataFrame, only_if_changed: bool = False) -> DataFrame:
    """Mute / unmute curated sources by id or URL; adds ``changed``."""
    digits = F.col("identifier").rlike("^[0-9]+$")
    order = F.col("ord") if "ord" in requests.columns else F.lit(0)
    asked = F.struct(order.alias("ord"), F.col("muted").alias("muted"))
    by_id = requests.where(digits).groupBy(F.col("identifier").try_cast("bigint").alias("source_id")).agg(F.max(asked).alias("w1"))
    by_url = requests.where(~digits).groupBy(F.col("identifier").alias("url")).agg(F.max(asked).alias("w2"))
    j = sources.join(by_id, "source_id", "left").join(by_url, "url", "left")
    want = F.greatest("w1", "w2")["muted"]  # the last request counts, by id or by URL
    changed = want.isNotNull() & ((want != F.col("muted")) if only_if_changed else F.lit(True))
    return j.select(
        *[c for c in sources.columns if c != "muted"],
        F.when(changed, want).otherwise(F.col("muted")).alias("muted"),
        changed.alias("changed"),
    )


def mark_checked(watches: DataFrame, checked: DataFrame, now: Column) -> DataFrame:
    """Stamp ``last_checked_at`` on the watches of a run."""
    hit = checked.select("watch_id").distinct().withColumn("_hit", F.lit(True))
    return watches.join(hit, "watch_id", "left").select(
        *[c for c in watches.columns if c != "last_checked_at"],
        F.when(F.col("_hit"), now).otherwise(F.col("last_checked_at")).alias("last_checked_at"),
    )


def load_watch_sources(raw: DataFrame) -> DataFrame:
    """Row defaults: NULL label -> URL, no platform -> derived, 0 confidence -> 70."""
    return raw.withColumns(
        {
            "label": F.coalesce(present(F.col("label")), F.col("url")),
            "platform": F.coalesce(present(F.col("platform")), platform_name(F.col("url"))),
            "confidence": F.coalesce(F.nullif(F.col("confidence"), F.lit(0)), F.lit(70)),
        }
    )


def upsert_sources(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """Add curated sources; ``requests`` is (ord, watch_id, url, label, private_note)."""
    url = collapse(F.col("url"))
    rows = requests.withColumn("url", url).where(F.col("url") != "")
    platform = F.when(F.col("private_note"), "manual").otherwise(platform_name(F.col("url")))
    shaped = rows.withColumns(
        {
            "label": F.coalesce(present(F.col("label")), F.col("url")),
            "platform": platform,
            "confidence": F.when(F.col("private_note"), 40).otherwise(platform_confidence(platform)),
            "muted": F.lit(False),
        }
    )
    out = upsert(sources, shaped, ["watch_id", "url"])
    if "source_id" not in out.columns:
        return out
    return out.withColumn("source_id", F.coalesce("source_id", stable_id(F.col("watch_id"), F.col("url"))))


def upsert_subscriptions(subscriptions: DataFrame, requests: DataFrame) -> DataFrame:
    """Add subscriptions on (watch, scope, location, round); re-adding enables them again."""
    keys = ["watch_id", "scope", "location", "round_key"]
    valid = requests.where(F.col("scope").isin(*dims.SCOPES)).withColumn("enabled", F.lit(True))
    out = upsert(subscriptions, valid, keys, kept=("subscription_id",))
    return out.withColumn("subscription_id", F.coalesce("subscription_id", stable_id(*map(F.col, keys))))


def list_subscriptions(subscriptions: DataFrame, watch_id: int | None = None, include_disabled: bool = True) -> DataFrame:
    """Subscriptions by id, of one watch or all, with or without the disabled ones."""
    out = subscriptions if watch_id is None else subscriptions.where(F.col("watch_id") == watch_id)
    return (out if include_disabled else out.where("enabled")).orderBy("subscription_id")


def enable_subscriptions(subscriptions: DataFrame, requests: DataFrame) -> DataFrame:
    """Switch subscriptions on or off; of several requests the last by ``ord`` counts."""
    order = F.col("ord") if "ord" in requests.columns else F.lit(0)
    want = requests.groupBy("subscription_id").agg(F.max(F.struct(order.alias("ord"), "enabled")).alias("w")).select(
        "subscription_id", F.col("w.enabled").alias("want")
    )
    return subscriptions.join(want, "subscription_id", "left").withColumn(
        "enabled", F.coalesce("want", "enabled")
    ).drop("want")


def remove_subscriptions(subscriptions: DataFrame, ids: DataFrame) -> DataFrame:
    return subscriptions.join(ids.select("subscription_id"), "subscription_id", "left_anti")


# --- events ---------------------------------------------------------------------------

def event_identity() -> Column:
    """Identity hash of an event: title, first two venues, first two dates, page."""
    return joined_key(
        round_name_key(F.coalesce(present(F.col("title")), F.lit(""))),
        round_name_key(F.array_join(F.slice("venues", 1, 2), " ")),
        round_name_key(F.array_join(F.slice("event_dates", 1, 2), " ")),
        F.col("official_url"),
    )


def event_status(events: DataFrame, rounds: DataFrame, links: DataFrame) -> DataFrame:
    """(event_id, status): rounds decide first, then actionable links, then the page."""
    by_round = rounds.groupBy("event_id").agg(
        F.max(F.col("status").isin("open", "closing_soon")).alias("is_open")
    )
    by_link = (
        links.where(is_actionable_ticket_link(F.col("url"), F.col("label"))).select("event_id").distinct().withColumn("linked", F.lit(True))
    )
    return (
        events.select("event_id", "official_url")
        .join(by_round, "event_id", "left")
        .join(by_link, "event_id", "left")
        .select(
            "event_id",
            F.when(F.col("is_open"), "lottery_open")
            .when(F.col("is_open").isNotNull(), "lottery_found")
            .when(F.col("linked"), "ticket_links_found")
            .when(F.col("official_url").isNotNull() & ~F.col("official_url").startswith("keyword:"), "official_found")
            .otherwise("watching")
            .alias("status"),
        )
    )


def upsert_events(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Events on (watch, URL); the id of a known event is kept."""
    return upsert(old, batch, ["watch_id", "official_url"], kept=("event_id", "created_at"))


def stale_fallbacks(events: DataFrame, saved: DataFrame) -> DataFrame:
    """Fallback events made obsolete by real pages saved in this batch.

    A web page retires its watch's ``keyword:`` events; a page that is no portal search also
    retires portal-search events. Rows saved in the same batch stay.
    """
    url = F.col("official_url")
    pages = saved.where(is_web_url(url)).groupBy("watch_id").agg(
        F.max(~is_portal_search_url(url)).alias("real_page")
    )
    fallback = events.where(url.startswith("keyword:") | is_portal_search_url(url))
    return (
        fallback.join(pages, "watch_id")
        .where(url.startswith("keyword:") | F.col("real_page"))
        .join(saved.select("watch_id", "official_url"), ["watch_id", "official_url"], "left_anti")
        .select("event_id", "watch_id", "official_url")
    )


def drop_events(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("event_id"), "event_id", "left_anti")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent (NULL-safe, unlike NOT IN)."""
    return child.join(parent.select(key), key, "left_anti")


# --- links and rounds -------------------------------------------------------------------

def shape_links(links: DataFrame) -> DataFrame:
    """Actionable links with platform, confidence and provenance."""
    u, label = F.col("url"), F.col("label")
    return links.where(is_actionable_ticket_link(u, label)).select(
        "event_id",
        "url",
        "label",
        platform_name(u).alias("platform"),
        link_confidence(u, label).alias("confidence"),
        provenance(u, label).alias("provenance"),
    )


def upsert_links(old: DataFrame, links: DataFrame) -> DataFrame:
    return upsert(old, shape_links(links), ["event_id", "url"])


def change_fields() -> dict[str, Column]:
    """The eight compared fields, window and payment taken from the normalised columns."""
    c = F.coalesce
    return {
        "lottery_start": c("application_start_at", "lottery_start"),
        "lottery_end": c("application_end_at", "lottery_end"),
        "results_date": F.col("results_date"),
        "general_sale_date": F.col("general_sale_date"),
        "payment_deadline": c("payment_end_at", "payment_deadline"),
        "payment_start_at": F.col("payment_start_at"),
        "trade_start_at": F.col("trade_start_at"),
        "trade_end_at": F.col("trade_end_at"),
    }


def round_changes(old: DataFrame, batch: DataFrame) -> DataFrame:
    """New-round rows and one row per changed field, from one join on the round key."""
    fields = change_fields()
    values = [v.alias(k) for k, v in fields.items()]
    days = [f.name for f, g in zip(old.select(*values).schema, batch.select(*values).schema) if f.dataType == g.dataType == T.DateType()]
    values = [v.alias(k) if k in days else v.cast("string").alias(k) for k, v in fields.items()]  # days cross the join as numbers
    before = old.select(*ROUND_ID, F.struct(*values).alias("o"))
    after = batch.select(*ROUND_ID, "name", "url", F.struct(*values).alias("n"))
    differs = F.col("o").isNull()
    for f in fields:
        differs = differs | ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}"))
    joined = after.join(before, ROUND_ID, "left").where(differs)
    changes = F.array(
        F.struct(F.lit("new_lottery_round").alias("type"), F.lit(None).cast("string").alias("field"),
                 F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"),
                 F.col("o").isNull().alias("hit")),
        *[
            F.struct(F.lit("ticket_field_changed").alias("type"), F.lit(f).alias("field"),
                     F.coalesce(F.col(f"o.{f}").cast("string"), F.lit("")).alias("old"), F.coalesce(F.col(f"n.{f}").cast("string"), F.lit("")).alias("new"),
                     (F.col("o").isNotNull() & ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}"))).alias("hit"))
            for f in fields
        ],
    )
    return (
        joined.select(*ROUND_ID, "name", "url", F.inline(changes))
        .where("hit")
        .select("event_id", "round_key", "type", F.col("name").alias("round"), "field", "old", "new", "url")
    )


def prune_rounds(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored rounds gone from this save, only on (event, platform) pairs present in it.

    A platform that yields nothing keeps its last good rounds.
    """
    platform = F.coalesce("platform", "source", F.lit(""))
    seen = batch.select("event_id", platform.alias("_p")).distinct()
    return (
        old.withColumn("_p", platform)
        .join(seen, ["event_id", "_p"], "left_semi")
        .join(batch.select(*ROUND_ID), ROUND_ID, "left_anti")
        .drop("_p")
    )


def upsert_rounds(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Next rounds table: batch rows replace or join, vanished ones of seen platforms leave."""
    gone = prune_rounds(old, batch).select(*ROUND_ID)
    kept = old.join(gone, ROUND_ID, "left_anti")
    return upsert(kept, batch.select(*[c for c in batch.columns if c in old.columns]), ROUND_ID)


# --- snapshots ----------------------------------------------------------------------------

SNAPSHOT_ROUND_FIELDS = (
    "round_key", "name", "url", "application_start_at", "application_end_at", "results_date",
    "general_sale_date", "payment_end_at", "confidence", "round_type", "membership_required", "evidence",
)


def snapshots(events: DataFrame, rounds: DataFrame) -> DataFrame:
    """(event_id, snapshot_hash, payload): equal content gives an equal hash.

    Rounds enter as order-free sums of per-row hashes, so no event's rounds are gathered.
    """
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SNAPSHOT_ROUND_FIELDS])
    digest = rounds.groupBy("event_id").agg(
        F.count("*").alias("n"),
        F.bit_xor(row).alias("x"),
        F.sum(row.cast("decimal(38,0)")).alias("s"),
    )
    payload = F.to_json(F.struct("title", "official_url", "summary", "event_dates", "venues"))
    joined = events.join(digest, "event_id", "left")
    return joined.select(
        "event_id",
        joined_key(payload, F.col("n").cast("string"), F.col("x").cast("string"), F.col("s").cast("string")).alias("snapshot_hash"),
        payload.alias("payload"),
    )


def new_snapshots(current: DataFrame, stored: DataFrame) -> DataFrame:
    return current.join(stored.select("event_id", "snapshot_hash"), ["event_id", "snapshot_hash"], "left_anti")


def snapshot_parts(snapshots: DataFrame, rounds: DataFrame, links: DataFrame) -> DataFrame:
    """(event_id, snapshot_hash, part, name, content): the rounds and links of each snapshot, stored beside its payload.

    They stay rows, so a snapshot of an event with very many rounds is no single record; ``content`` is
    JSON of the round's snapshot fields or of the link.
    """
    marks = snapshots.select("event_id", "snapshot_hash")
    fields, link = F.struct(*SNAPSHOT_ROUND_FIELDS).alias("fields"), F.struct("url", "label").alias("link")
    kept_rounds = rounds.select("event_id", F.lit("round").alias("part"), fields)
    kept_links = links.select("event_id", F.lit("link").alias("part"), link)
    parts = marks.join(kept_rounds.unionByName(kept_links, allowMissingColumns=True), "event_id")
    # texts are made after the join, so that none is shuffled
    of_round = F.col("part") == "round"
    name = F.when(of_round, F.col("fields.round_key")).otherwise(F.col("link.url"))
    content = F.when(of_round, F.to_json("fields")).otherwise(F.to_json("link"))
    return parts.select("event_id", "snapshot_hash", "part", name.alias("name"), content.alias("content"))


# --- cleanup --------------------------------------------------------------------------------

WINDOW = ("application_start_at", "application_end_at", "status")


def member_children(rounds: DataFrame, as_of: Column) -> DataFrame:
    """Membership rounds that the evidence of stored rounds prints, in the layout of ``rounds``.

    Adds ``parent`` (the stored round's key), ``member_name`` (the stored name is one of a
    membership itself) and ``canonical`` (the stored name is among the printed ones).
    """
    from roundtide.operators.extraction import split_memberships
    from roundtide.operators.rounds import normalize_rounds

    nothing = F.lit(None).cast("date")
    split = split_memberships(rounds.withColumn("parent", F.col("round_key")), as_of)
    shaped = split.withColumns(
        {
            "canonical": F.col("child.name") == F.col("name"),
            "name": F.col("child.name"),
            "round_number": F.lit(None).cast("int"),
            "lottery_start": F.try_to_date("child.start"),
            "lottery_end": F.try_to_date("child.end"),
            "application_start_at": nothing,
            "application_end_at": nothing,
            **{c: F.when(~F.col("member_name"), F.col(c)) for c in ("payment_start_at", "trade_start_at", "trade_end_at")},
            "payment_end_at": F.when(~F.col("member_name"), F.col("payment_end_at")),
        }
    )
    return normalize_rounds(shaped.drop("child"), as_of).select(*rounds.columns, "parent", "member_name", "canonical")


def cleanup(tables: dict[str, DataFrame], as_of: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """Repair stored state; returns the next tables and (item, n) counts. Idempotent.

    ``tables`` holds watches, events, links, rounds, snapshots, alert_log, watch_sources.
    Links of a stale keyword fallback move to its watch's smallest official event unless that
    event has the URL already. A fallback counts once however many official pages it meets.
    Stored round keys stay: only window and status of a round change. A round whose evidence prints
    membership windows gives way to one round for each; of a round named after a membership, one
    child may bear its name, and then it stays. Runs jobs: the printed children go through written tables.
    """
    from roundtide.operators.extraction import clean_venues
    from roundtide.operators.rounds import normalize_rounds
    from roundtide.sources.tables import written

    events, links, rounds = tables["events"], tables["links"], tables["rounds"]
    url = F.col("official_url")
    official = events.where(url.rlike("^https?://")).groupBy("watch_id").agg(F.min("event_id").alias("target"))
    stale = events.where(url.startswith("keyword:")).join(official, "watch_id").select("event_id", "target")

    rooted = links.join(events.select("event_id"), "event_id", "left_semi")
    usable = rooted.where(is_actionable_ticket_link(F.col("url"), F.coalesce("label", F.lit(""))))
    routed = usable.join(stale, "event_id", "left").withColumn("moved", F.col("target").isNotNull()).withColumn(
        "event_id", F.coalesce("target", "event_id")
    )
    rest = [c for c in links.columns if c not in ("event_id", "url")]
    next_links = (
        routed.groupBy("event_id", "url").agg(F.min(F.struct("moved", *rest)).alias("k")).select("event_id", "url", *[f"k.{c}" for c in rest])
    )
    next_events = drop_events(events, stale)
    cleaned = clean_venues(F.col("venues"))
    dirty_venues = F.size(cleaned) != F.size("venues")

    live_rounds = drop_events(rounds.join(events.select("event_id"), "event_id", "left_semi"), stale)
    named = live_rounds.where(F.col("name") != "Fetch failed")
    was = F.struct(*[F.col(c) for c in named.columns])
    children = written(member_children(named, as_of), "children")  # read from evidence once, used four times
    taken = rounds.join(events.select("event_id"), "event_id", "left_semi").select(*ROUND_ID)
    won = (
        children.join(taken, ROUND_ID, "left_anti")
        .groupBy(*ROUND_ID)
        .agg(F.min(F.struct("parent", *[c for c in named.columns if c not in ROUND_ID])).alias("k"))
        .select(*ROUND_ID, "k.*")
    )
    won = written(won, "won")
    # per stored round: how many children it gained, and whether it leaves
    gained = won.groupBy("event_id", F.col("parent").alias("round_key")).agg(F.count("*").alias("inserted"))
    split = (
        children.groupBy("event_id", F.col("parent").alias("round_key"))
        .agg(F.max("canonical").alias("canonical"), F.max("member_name").alias("member_name"))
        .join(gained, ROUND_ID, "left")
        .select(
            *ROUND_ID,
            F.coalesce("inserted", F.lit(0)).alias("inserted"),
            F.when(F.col("member_name"), ~F.col("canonical")).otherwise(F.col("inserted").isNotNull()).alias("leaves"),
            F.col("member_name"),
        )
    )
    fresh = normalize_rounds(named.withColumn("was", was), as_of)
    window = F.struct("application_start_at", "application_end_at", "status")
    dated = fresh.select("event_id", F.col("was.round_key").alias("round_key"), window.alias("now"), "was").join(split, ROUND_ID, "left")
    moved_dates = ~F.col("now").eqNullSafe(F.struct(*[F.col(f"was.{c}") for c in WINDOW])) & F.coalesce(F.col("inserted") == 0, F.lit(True))
    stay = dated.where(~F.coalesce("leaves", F.lit(False)))
    kept_rounds = stay.select(
        *[
            F.when(moved_dates, F.col(f"now.{c}")).otherwise(F.col(f"was.{c}")).alias(c) if c in WINDOW else F.col(f"was.{c}").alias(c)
            for c in named.columns
        ]
    )
    next_rounds = kept_rounds.unionByName(won.select(*named.columns))

    out = dict(tables)
    out["links"], out["rounds"] = next_links, next_rounds
    out["events"] = next_events.withColumn("venues", cleaned)
    for t in ("snapshots", "alert_log"):
        out[t] = tables[t].join(next_events.select("event_id"), "event_id", "left_semi")
    out["watch_sources"] = tables["watch_sources"].join(tables["watches"].select("watch_id"), "watch_id", "left_semi")

    def removed(name: str, before: DataFrame, after: DataFrame) -> DataFrame:
        a = before.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")
        b = after.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), (-F.col("n")).alias("n"))
        return a.unionByName(b)

    def lost(name: str, table: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        """Rows without a parent, counted in one pass."""
        flagged = table.select(key).join(parents.select(key, F.lit(True).alias("there")), key, "left")
        return flagged.agg(F.count_if(F.col("there").isNull()).alias("n")).select(F.lit(name).alias("item"), "n")

    def counted(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")

    parts = [
        removed("sources", links, next_links),
        removed("ticket_rounds", rounds, named),
        lost("snapshots", tables["snapshots"], next_events, "event_id"),
        lost("alert_log", tables["alert_log"], next_events, "event_id"),
        lost("watch_sources", tables["watch_sources"], tables["watches"], "watch_id"),
        counted("keyword_fallback_events", stale),
        counted("event_venues", next_events.where(dirty_venues)),
        counted("ticket_round_dates", stay.where(moved_dates)),
        split.agg(F.sum(F.col("inserted") + (F.col("leaves") & F.col("member_name")).cast("int")).alias("n")).select(
            F.lit("ticket_round_memberships").alias("item"), F.coalesce("n", F.lit(0)).alias("n")
        ),
    ]
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    return out, counts.groupBy("item").agg(F.sum("n").cast("bigint").alias("n"))


# --- one batch ------------------------------------------------------------------------------

def with_stored_ids(stored: DataFrame, batch: dict[str, DataFrame], ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """The batch under the ids of the events table; ``ids`` are the ids in use, where ``stored`` is a part of it.

    A known (watch, URL) has its stored id; a new one keeps the batch's id if no stored event has it,
    else gets one derived from watch and URL. Rows of one (watch, URL) become one event, the greatest
    row; links and rounds of all its ids follow it.
    """
    key = ["watch_id", "official_url"]
    kind = batch["events"].schema["event_id"].dataType  # a number, or a key as text
    known = stored.select(*key, F.col("event_id").alias("stored_id"))
    taken = (stored if ids is None else ids).select(F.col("event_id").alias("batch_id"), F.lit(True).alias("taken"))
    asked = batch["events"].select(*key, F.col("event_id").alias("batch_id"))
    least = asked.groupBy(*key).agg(F.min("batch_id").alias("least_id"))
    ids = (
        asked.join(least, key)
        .join(known, key, "left")
        .join(taken.withColumnRenamed("batch_id", "least_id"), "least_id", "left")
        .select(
            "batch_id",
            F.coalesce(
                "stored_id", F.when(F.col("taken").isNull(), F.col("least_id")), stable_id(*map(F.col, key)).cast(kind)
            ).alias("event_id"),
        )
        .distinct()
    )

    def moved(rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed("event_id", "batch_id").join(ids, "batch_id", "left").select(
            *[F.coalesce("event_id", "batch_id").alias(c) if c == "event_id" else F.col(c) for c in rows.columns]
        )

    out = {name: moved(rows) if "event_id" in rows.columns else rows for name, rows in batch.items()}
    out["events"] = one_per_key(out["events"], key)
    return out


#: From so many rounds on a batch is dealt and stored by event.
WORTH = 200_000


def apply_batch(
    state: dict[str, DataFrame], batch: dict[str, DataFrame], as_of: Column, now: Column
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Save one batch of events, links and rounds for many watches at once.

    Order of the effects: event upsert, stale fallbacks leave with their children, links,
    rounds with change rows and scoped prune, lifecycle alerts, snapshots. Returns the next
    state and the alert tables ``changes`` (returned only) and ``lifecycle`` (logged). The incoming
    rounds, events, retired fallbacks and merged tables feed several outputs, so they go through written tables.
    """
    from roundtide.operators.alerts import change_alerts, lifecycle_alerts, new_alerts
    from roundtide.operators.joins import fits_together
    from roundtide.operators.rounds import dedupe_rounds, normalize_rounds, one_per_key
    from roundtide.sources.tables import written

    whole = fits_together(batch["rounds"].select("event_id"), "event_id", least=WORTH)
    batch = with_stored_ids(state["events"], batch)
    # dealt by event once: dedupe, key and all later steps on rounds find them in place
    dealt = batch["rounds"].repartition("event_id") if whole else batch["rounds"]
    incoming = normalize_rounds(dealt, as_of)
    rounds_in = written(one_per_key(dedupe_rounds(incoming, ["event_id"], []), ["event_id"]), "rounds_in", by="event_id" if whole else None)
    status = event_status(batch["events"], rounds_in, batch["links"])
    events_in = batch["events"].drop("status").join(status, "event_id").withColumns(
        {"event_key": event_identity(), "updated_at": now}
    )
    events_in = written(events_in, "events_in")
    merged = written(upsert_events(state["events"], events_in), "merged")
    gone = written(stale_fallbacks(state["events"], events_in), "fallbacks")
    links = written(upsert_links(drop_events(state["links"], gone), batch["links"]), "links_merged")
    old_rounds = drop_events(state["rounds"], gone)
    rounds = upsert_rounds(old_rounds, rounds_in)
    titles = merged.select("event_id", "watch_id", F.col("title").alias("event"))
    life = new_alerts(
        lifecycle_alerts(rounds_in.join(titles, "event_id"), as_of), drop_events(state["alert_log"], gone)
    ).withColumn("created_at", now)
    changes = change_alerts(merged, links, round_changes(old_rounds, rounds_in), titles)
    snaps = new_snapshots(snapshots(events_in, rounds_in), state["snapshots"]).withColumn("created_at", now)
    nxt = dict(state)
    nxt["events"] = drop_events(merged.select(*state["events"].columns), gone)
    nxt["links"] = links.select(*state["links"].columns)
    nxt["rounds"] = rounds.select(*state["rounds"].columns)
    nxt["alert_log"] = drop_events(state["alert_log"], gone).unionByName(life.select(*state["alert_log"].columns))
    nxt["snapshots"] = drop_events(state["snapshots"], gone).unionByName(snaps.select(*state["snapshots"].columns))
    return nxt, {"changes": changes, "lifecycle": life}




def normalize_for_state(rounds: DataFrame, as_of: Column) -> DataFrame:
    """Rounds in the column layout of the state table."""
    from roundtide.operators.rounds import normalize_rounds

    return normalize_rounds(rounds, as_of)
