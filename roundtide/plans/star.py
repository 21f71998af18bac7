"""Driver tables -> canonical tables (watches, events, rounds, links, ...).

Dates move forward 28 years (the calendar repeats), so that printed years start with 20.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundtide import dims
from roundtide.functions.dates import as_date
from roundtide.functions.text import lookup
from roundtide.functions.urls import platform_of_host, url_host
from roundtide.operators.alerts import lifecycle_alerts
from roundtide.operators.joins import fits_together, together
from roundtide.operators.rounds import normalize_rounds
from roundtide.operators.state import load_watch_sources, shape_links

#: HotSpot never compiles a method of more bytes; text and date expressions fused into one method exceed that and run
#: some ten times slower. Beyond this size Spark evaluates the operators one by one, in small methods.
HUGE_METHOD, COMPILED_SIZE, ANY_SIZE = "spark.sql.codegen.hugeMethodLimit", "8000", "65535"
#: Rows dealt by their event meet on (event, round) where they lie, instead of being shuffled again by both.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Shuffle files go when the write or count that made them is over, not when the driver next collects garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
AS_OF = "2026-08-02"
SHIFT_DAYS = 10227
# --- fixed values of the mapping --------------------------------------------
ROUND_NAMES = {
    1: "第1次抽選先行", 2: "FC会員先行", 3: "一般発売", 4: "オフィシャル先行",
    5: "プレオーダー", 6: "公式トレード", 7: "Stage  pass",
}
ROUND_HOSTS = {
    0: "t.pia.jp", 1: "eplus.jp", 2: "l-tike.com", 3: "r-t.jp",
    4: "tickebo.jp", 5: "www.cnplayguide.com", 6: "e-get.jp", 7: "ticket.tv-asahi.co.jp",
}
EVIDENCES = {0: "大阪 公演", 1: "有明アリーナ", 2: "会員限定"}
DEFAULT_PREFERENCES = ",".join(dims.ALERT_TYPES)


def pick(key: Column, table: dict[int, str], default: str) -> Column:
    return F.coalesce(lookup(table, key.cast("int")), F.lit(default))


class Star:
    """Lazy canonical DataFrames over one driver directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self.as_of = as_date(AS_OF)
        if spark.conf.get(HUGE_METHOD, ANY_SIZE) == ANY_SIZE:
            spark.conf.set(HUGE_METHOD, COMPILED_SIZE)
        if spark.conf.get(ALL_KEYS, "true") == "true":
            spark.conf.set(ALL_KEYS, "false")
        if spark.conf.get(FREED, "false") == "false":
            spark.conf.set(FREED, "true")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table whose rows carry heavy text work, over all task slots.

        A table of many splits is read as it lies. Only one that has fewer splits than there are slots
        (a few row groups) is dealt out first; its size bounds what that moves.
        """
        df, slots = self.table(name), self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)

    @cached_property
    def watches(self) -> DataFrame:
        k = F.col("c_custkey")
        region = F.lower("n_name")
        return (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                k.alias("watch_id"),
                F.col("c_name").alias("keyword"),
                F.when(k % 3 == 0, "artist").otherwise("event").alias("kind"),
                F.lower("c_mktsegment").alias("tags"),
                F.when(k % 8 == 0, F.concat(region, F.lit(" , Tokyo")))
                .when(k % 4 == 0, region)
                .otherwise("")
                .alias("preferred_regions"),
                F.when(k % 6 == 0, F.concat(F.lit("Hall "), (k % 50).cast("string"))).otherwise("").alias("preferred_venues"),
                F.when(k % 5 == 0, "")
                .when(k % 7 == 0, "Lottery_Opened, results_today ,")
                .otherwise(DEFAULT_PREFERENCES)
                .alias("alert_preferences"),
                (k % 10 == 0).alias("muted"),
            )
        )

    @cached_property
    def order_lines(self) -> DataFrame:
        """The columns of lineitem that make rounds and links."""
        ship_day, quantity = F.col("l_shipdate").cast("date"), F.col("l_quantity").cast("int")
        return self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", quantity.alias("quantity"), ship_day.alias("day"))

    @cached_property
    def whole_orders(self) -> bool:
        """Whether no order has too many lines for one task."""
        return fits_together(self.order_lines, "l_orderkey")

    @cached_property
    def lines(self) -> DataFrame:
        """The lines of an order together."""
        return self.order_lines.repartition("l_orderkey") if self.whole_orders else self.order_lines

    @cached_property
    def events(self) -> DataFrame:
        return self._events(self.table("orders"))

    @cached_property
    def events_dealt(self) -> DataFrame:
        """The events, dealt by their id before their texts are made; for joins with rounds and links."""
        return self._events(together(self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"), "o_orderkey"))

    def _events(self, orders: DataFrame) -> DataFrame:
        k, w = F.col("o_orderkey"), F.col("o_custkey")
        s = lambda c: c.cast("string")
        day = F.date_add(F.col("o_orderdate").cast("date"), SHIFT_DAYS)
        first, second = s(F.date_add(day, 30)), s(F.date_add(day, 60))
        hall = F.concat(F.lit("hall "), s(k % 50))
        none = F.expr("cast(array() as array<string>)")
        return orders.select(
            k.alias("event_id"),
            w.alias("watch_id"),
            F.when(k % 13 == 0, F.concat(F.lit("Live Tour "), s(k))).otherwise(F.concat(F.lit("Order "), s(k))).alias("title"),
            F.when(k % 20 == 0, F.concat(F.lit("keyword:watch-"), s(w), F.lit("-"), s(k)))
            .when(k % 20 == 7, F.concat(F.lit("https://t.pia.jp/pia/search_all.do?kw="), s(k)))
            .otherwise(F.concat(F.lit("https://stage"), s(k % 97), F.lit(".example.com/e/"), s(k)))
            .alias("official_url"),
            F.when(k % 9 != 0, F.concat(F.col("o_orderpriority"), F.lit(" at nation_"), s(k % 25))).alias("summary"),
            F.when(k % 4 == 0, none).when(k % 4 == 1, F.array(first)).otherwise(F.array(first, second)).alias("event_dates"),
            F.when(k % 5 == 0, none)
            .when(k % 5 == 1, F.array(F.concat(F.lit("御園座 "), s(k % 13))))
            .when(k % 5 == 2, F.array(F.concat(F.lit("梅田 "), hall), hall))
            .when(k % 5 == 3, F.array(F.concat(F.lit("チケット受付 "), hall), hall))
            .otherwise(F.array(hall, F.lit("博多座"), F.lit("EXシアター有明"), F.concat(F.lit("annex "), hall)))
            .alias("venues"),
            F.timestamp_add("SECOND", k % 86400, F.date_add(day, 0).cast("timestamp")).alias("updated_at"),
        )

    @cached_property
    def raw_rounds(self) -> DataFrame:
        return self.rounds_of(self.lines)

    def rounds_of(self, lines: DataFrame) -> DataFrame:
        """In-flight rounds: every lineitem row is one. Columns besides those of ``order_lines``, set by the order, are kept.

        Order and line repeat, so a round's page names part, supplier, quantity and day as well, and
        rows equal in all of these are told apart by a running number.
        """
        kept = [c for c in lines.columns if c not in self.order_lines.columns]
        counted = lines.groupBy(*lines.columns).agg(F.count("*").cast("int").alias("n"))
        picked = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), "n")))
        ship = F.date_add("day", SHIFT_DAYS)
        end = F.date_add(ship, F.col("quantity"))
        part, supp, order, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")
        nodate = F.lit(None).cast("date")
        path = F.concat(F.lit("/e/"), F.concat_ws("/", *[c.cast("string") for c in (order, line, part, supp, F.col("quantity"), F.col("day"), F.col("copy"))]))
        url = F.concat(
            F.lit("https://"), F.when(supp % 29 == 0, "x.com").otherwise(pick(supp % 8, ROUND_HOSTS, "")), path
        )
        rows = picked.select(
            *kept,
            order.alias("event_id"),
            line.alias("line"),
            part.alias("part"),
            url.alias("url"),
            pick(line, ROUND_NAMES, "Stage  pass").alias("name"),
            F.when(part % 7 != 0, ship).alias("lottery_start"),
            F.when(part % 11 != 0, end).alias("lottery_end"),
            F.when(part % 5 != 0, F.date_add(end, 3)).alias("results_date"),
            F.when(part % 2 != 0, F.date_add(end, 10)).alias("general_sale_date"),
            F.when(part % 3 != 0, F.date_add(end, 6)).alias("payment_deadline"),
            pick(part % 6, EVIDENCES, "").alias("evidence"),
            F.when(supp % 3 == 0, 0).otherwise(50).alias("confidence"),
        )
        extra = {
            c: nodate
            for c in (
                "application_start_at", "application_end_at", "payment_start_at", "payment_end_at",
                "trade_start_at", "trade_end_at",
            )
        }
        return rows.withColumn("host", url_host(F.col("url"))).withColumns(
            {
                **extra,
                "source": platform_of_host(F.col("host")),
                "platform": F.lit(None).cast("string"),
                "round_number": F.lit(None).cast("int"),
                "round_type": F.lit("unknown"),
                "membership_required": F.lit("unknown"),
            }
        ).drop("host")

    @cached_property
    def rounds(self) -> DataFrame:
        return normalize_rounds(self.raw_rounds, self.as_of, parse_evidence=False)

    @cached_property
    def event_links(self) -> DataFrame:
        """Distinct (event, supplier) pairs as links; a quarter of them is actionable per shape."""
        k, s = F.col("l_orderkey"), F.col("l_suppkey")
        tail = F.concat(k.cast("string"), F.lit("/"), s.cast("string"))
        pairs = self.lines.select("l_orderkey", "l_suppkey").distinct()
        return pairs.select(
            k.alias("event_id"),
            F.when(s % 4 == 1, F.concat(F.lit("https://eplus.jp/hoken/"), tail))
            .when(s % 4 == 2, F.lit("https://www.shiki.jp/tickets/"))
            .when(s % 4 == 3, F.concat(F.lit("https://stage.co.jp/stage/"), tail))
            .otherwise(F.concat(F.lit("https://"), pick((s / 4).cast("int") % 8, ROUND_HOSTS, ""), F.lit("/t/"), tail))
            .alias("url"),
            F.concat(F.lit("Ticket "), s.cast("string")).alias("label"),
        ).groupBy("event_id", "url").agg(F.min("label").alias("label"))

    @cached_property
    def raw_watch_sources(self) -> DataFrame:
        p = F.col("page_id")
        return self.table("pages").select(
            p.alias("source_id"),
            p.alias("watch_id"),
            "url",
            F.when(p % 5 != 0, F.concat(F.lit("Source "), p.cast("string"))).alias("label"),
            F.when(p % 4 == 0, "").otherwise("manual").alias("platform"),
            F.when(p % 3 == 0, 0).otherwise(60).alias("confidence"),
            (p % 6 == 0).alias("private_note"),
            (p % 9 == 0).alias("muted"),
        )

    @cached_property
    def user_watches(self) -> DataFrame:
        return (
            self.table("events")
            .select("user_id", F.floor(F.col("event_id") * 15 / 100).cast("bigint").alias("watch_id"))
            .distinct()
        )

    @cached_property
    def subscriptions(self) -> DataFrame:
        """One subscription per watch; a round-scoped one follows the watch's smallest round key."""
        k = F.col("watch_id")
        chosen = (
            self.rounds.join(self.events.select("event_id", "watch_id"), "event_id")
            .groupBy("watch_id")
            .agg(F.min("round_key").alias("chosen_key"))
        )
        scope = (
            F.when(k % 4 == 0, "artist_all").when(k % 4 == 1, "event_all").when(k % 4 == 2, "event_location").otherwise("round")
        )
        return (
            self.watches.join(chosen, "watch_id", "left")
            .select(
                k.alias("subscription_id"),
                "watch_id",
                scope.alias("scope"),
                F.when(k % 8 == 2, "大阪").when(k % 8 == 6, "東京").otherwise("").alias("location"),
                F.when(k % 4 == 3, F.coalesce("chosen_key", F.lit(""))).otherwise("").alias("round_key"),
                F.when(k % 2 == 0, "feed").otherwise("feed,push").alias("channels"),
                F.when(k % 3 == 0, "7, 1,0,x,1").when(k % 3 == 1, "3").otherwise("").alias("lead_days"),
                (k % 11 != 0).alias("enabled"),
            )
        )

    # --- yesterday's state and today's batch, by deterministic perturbation ------------

    @cached_property
    def watch_sources(self) -> DataFrame:
        return load_watch_sources(self.raw_watch_sources)

    @cached_property
    def prev_rounds(self) -> DataFrame:
        h = F.col("event_id") + F.col("line")
        later = lambda c: F.when(h % 7 == 0, F.date_add(c, 2)).otherwise(F.col(c)).alias(c)
        return self.rounds.where(h % 11 != 0).select(
            *[
                later(c) if c in ("lottery_end", "application_end_at")
                else F.when(h % 13 != 0, F.col(c)).alias(c) if c == "results_date"
                else F.col(c)
                for c in self.rounds.columns
            ]
        )

    @cached_property
    def batch_rounds(self) -> DataFrame:
        h = F.col("event_id") + F.col("line")
        return self.rounds.where((h % 17 != 0) & ~((F.col("event_id") % 10 == 3) & (F.col("platform") == "pia")))

    @cached_property
    def prev_events(self) -> DataFrame:
        k = F.col("event_id")
        return self.events.where(k % 11 != 0).withColumn(
            "title", F.when(k % 6 == 0, F.concat(F.lit("Old "), F.col("title"))).otherwise(F.col("title"))
        )

    @cached_property
    def batch_events(self) -> DataFrame:
        return self.events.where(F.col("event_id") % 17 != 0)

    @cached_property
    def prev_links(self) -> DataFrame:
        return shape_links(self.event_links.where(F.col("event_id") % 9 != 0))

    @cached_property
    def batch_links(self) -> DataFrame:
        return self.event_links.where(F.col("event_id") % 17 != 0)

    def alerts_at(self, as_of: Column) -> DataFrame:
        titles = self.events.select("event_id", F.col("title").alias("event"))
        return lifecycle_alerts(self.rounds.join(titles, "event_id"), as_of)

    @cached_property
    def alert_log(self) -> DataFrame:
        """Alerts logged on each of the last two days, once each, stamped with the first day."""
        seen = self.alerts_at(F.date_sub(self.as_of, 2)).withColumn("created_at", F.date_sub(self.as_of, 2).cast("timestamp"))
        more = self.alerts_at(F.date_sub(self.as_of, 1)).withColumn("created_at", F.date_sub(self.as_of, 1).cast("timestamp"))
        keys = ["event_id", "alert_key"]
        return seen.unionByName(more).groupBy(*keys).agg(
            F.min(F.struct("created_at", "alert_type", "payload")).alias("a")
        ).select(*keys, "a.alert_type", "a.payload", "a.created_at")
