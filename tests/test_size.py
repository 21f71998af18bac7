"""Steps whose cost must not grow beyond their input."""

from pyspark.sql import functions as F

from roundtide.operators import discovery as dc


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_never_collected_for_a_broadcast(spark):
    """However small the planner takes generated texts for: a join of results and pages is a shuffle."""
    key = F.col("id").cast("string")
    url = F.concat(F.lit("https://stage.example.com/"), key)
    text = F.concat(F.lit("Musical "), key)
    results = spark.range(50).select(text.alias("keyword"), F.lit(1).alias("rank"), F.concat(text, F.lit(" 公式")).alias("title"), url.alias("url"), F.lit("").alias("snippet"))
    pages = spark.range(50).select(F.col("id").alias("page_id"), url.alias("url"), text.alias("title"), text.alias("text"))
    owned = dc.official_pages(results, pages)
    assert "BroadcastExchange" not in plan(owned)
    assert owned.count() == 50
    header = owned.select("keyword").limit(20)
    bare = dc.with_portal_links(results.select("keyword"), header.select("keyword", F.lit("u").alias("url"), F.lit("l").alias("label")))
    assert "BroadcastExchange" not in plan(bare)
    assert bare.where("label <> 'l'").select("keyword").distinct().count() == 30
