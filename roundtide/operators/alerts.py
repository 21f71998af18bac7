"""Lifecycle and change alerts, once-only logging, preference filter, failure rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundtide import dims
from roundtide.functions.rounds import application_end, application_start, payment_end
from roundtide.functions.text import comma_values, joined_key, present


def lifecycle_alerts(rounds: DataFrame, as_of: Column) -> DataFrame:
    """Up to five dated alerts per round (columns of ``rounds`` plus ``event`` title).

    Each candidate is an array element; non-matching ones never leave the projection. Rounds without
    any go first, by a plain predicate on dates that reaches below joins and scans.
    """
    candidates = (
        ("lottery_opened", "lottery_start", application_start(), 0),
        ("lottery_closing_soon", "lottery_end", application_end(), 2),
        ("results_today", "results_date", F.col("results_date"), 0),
        ("payment_due_soon", "payment_deadline", payment_end(), 1),
        ("general_sale_soon", "general_sale_date", F.col("general_sale_date"), 2),
    )
    near = F.lit(False)
    for _, _, day, reach in candidates:
        near = near | F.date_diff(day, as_of).between(0, reach)
    rounds = rounds.where(near)
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("type"), F.lit(f).alias("field"), day.alias("date"),
                     F.date_diff(day, as_of).alias("days_until"), F.lit(reach).alias("reach"))
            for t, f, day, reach in candidates
        ]
    )
    hits = F.filter(rows, lambda r: r["days_until"].between(F.lit(0), r["reach"]))
    out = rounds.select(
        "event_id", "event", "round_key", F.col("name").alias("round"), "source", "url", F.inline(hits)
    )
    key = joined_key(F.col("type"), F.col("round_key"), F.col("field"), F.col("date").cast("string"))
    payload = F.to_json(F.struct("date", "days_until", "event", "field", "round", "source", "type", "url"))
    return out.drop("reach").withColumns({"alert_key": key, "payload": payload, "alert_type": F.col("type")})


def new_alerts(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """Alerts whose (event, key) is not logged yet; repeats inside the batch collapse too."""
    keys = ["event_id", "alert_key"]
    rest = [c for c in alerts.columns if c not in keys]
    once = alerts.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("a")).select(*keys, "a.*")
    return once.join(log.select(*keys), keys, "left_anti")


def change_alerts(events: DataFrame, links: DataFrame, changes: DataFrame, titles: DataFrame) -> DataFrame:
    """New page, new link, new round and changed field rows in one sparse table.

    ``events`` and ``links`` come from the upserts (``is_new``, ``touched``).
    """
    empty = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    pages = events.where("is_new").where(~F.col("official_url").startswith("keyword:")).select(
        "event_id", F.lit("new_official_page").alias("type"), *empty("round", "field", "old", "new"),
        F.col("official_url").alias("url"),
    )
    fresh = links.where("is_new").select(
        "event_id", F.lit("new_ticket_link").alias("type"), *empty("round", "field", "old", "new"), "url"
    )
    rounds = changes.select("event_id", "type", "round", "field", "old", "new", "url")
    return pages.unionByName(fresh).unionByName(rounds).join(titles, "event_id")


def preference_match(regions: Column, venues: Column, dates: Column, places: Column, summary: Column) -> Column:
    """Any preferred region or venue occurs in dates, venues or summary; none preferred passes."""
    haystack = F.lower(F.concat_ws(" ", F.array_join(dates, " "), F.array_join(places, " "), summary))
    wanted = F.concat(comma_values(regions), comma_values(venues))
    return (F.size(wanted) == 0) | F.exists(wanted, lambda p: F.contains(haystack, p))


def filter_for_watches(alerts: DataFrame, events: DataFrame, watches: DataFrame) -> DataFrame:
    """Apply watch preferences: (event_id, watch_id, type, detail).

    A saved event that misses the preferred region or venue yields one ``watch_filtered`` row;
    otherwise alerts of the allowed types pass. Empty preferences mean the default list.
    """
    judged = events.join(watches, "watch_id").select(
        "event_id",
        "watch_id",
        "keyword",
        comma_values(
            F.coalesce(present(F.col("alert_preferences")), F.lit(",".join(dims.ALERT_TYPES)))
        ).alias("allowed"),
        preference_match(
            F.col("preferred_regions"), F.col("preferred_venues"), F.col("event_dates"), F.col("venues"), F.col("summary")
        ).alias("match"),
    )
    filtered = judged.where(~F.col("match")).select(
        "event_id", "watch_id", F.lit("watch_filtered").alias("type"),
        F.lit("preferred region/venue did not match").alias("detail"),
    )
    passed = (
        alerts.drop("watch_id").join(judged.where("match").select("event_id", "watch_id", "allowed"), "event_id")
        .where(F.array_contains("allowed", F.lower("type")))
        .select("event_id", "watch_id", "type", F.concat_ws("|", "round", "field", "url").alias("detail"))
    )
    return filtered.unionByName(passed)


def watch_failures(watches: DataFrame, errors: DataFrame) -> DataFrame:
    """One ``watch_failed`` row per watch with bad input rows; the others are not affected."""
    worst = errors.groupBy("watch_id").agg(F.min("error").alias("error"), F.count("*").alias("n_errors"))
    return worst.join(watches.select("watch_id", "keyword"), "watch_id").select(
        F.lit("watch_failed").alias("type"), "watch_id", "keyword", "error", "n_errors"
    )
