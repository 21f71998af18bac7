"""Extraction rules on small literal texts."""

import datetime as dt

from pyspark.sql import functions as F

from roundtide.functions import dates as d
from roundtide.functions import rounds as r
from roundtide.functions.text import string_array
from roundtide.operators import extraction as ex

def as_of():
    return d.as_date("2026-06-13")
LINKS = "array<struct<label:string,url:string>>"


def pages(spark, *texts, url="https://stage.example.com/p"):
    rows = [(i, f"{url}{i}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "page_id bigint, url string, text string").withColumn("title", F.lit("t")).withColumn(
        "links", F.expr(f"cast(array() as {LINKS})")
    )


def one(spark, expr, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("v")).first()["v"]


def test_lottery_block_dates(spark):
    text = "抽選先行 受付期間 2026年6月10日12:00～6月18日 抽選結果 6月22日 入金期間 6月22日～6月25日 " + "・" * 80 + "一般発売 7月4日"
    rows = {x["name"]: x for x in ex.extract_rounds(pages(spark, text), as_of()).collect()}
    x = rows["抽選先行"]
    assert (x.lottery_start, x.lottery_end) == (dt.date(2026, 6, 10), dt.date(2026, 6, 18))
    assert (x.results_date, x.payment_start_at, x.payment_deadline) == (
        dt.date(2026, 6, 22), dt.date(2026, 6, 22), dt.date(2026, 6, 25),
    )
    assert rows["一般発売"].general_sale_date == dt.date(2026, 7, 4)
    assert rows["一般発売"].lottery_start is None


def test_year_from_heading(spark):
    text = "【一般前売開始】2025年4月5日 先着先行 3月18日～3月21日"
    rows = ex.extract_rounds(pages(spark, text), as_of()).where("name = '先着先行'").collect()
    assert [(x.lottery_start, x.lottery_end) for x in rows] == [(dt.date(2025, 3, 18), dt.date(2025, 3, 21))]


def test_prose_without_label_or_date_is_no_round(spark):
    assert ex.extract_rounds(pages(spark, "抽選販売に関する規約です。", "お知らせ 2026年6月1日"), as_of()).count() == 0


def test_membership_windows(spark):
    text = "先着先行 ゴールド会員：2026年2月28日～3月15日 レギュラー会員：2026年3月1日～3月15日"
    rows = ex.extract_rounds(pages(spark, text), as_of()).collect()
    assert {(x.name, str(x.lottery_start), str(x.lottery_end)) for x in rows} == {
        ("先着先行 / ゴールド会員", "2026-02-28", "2026-03-15"),
        ("先着先行 / レギュラー会員", "2026-03-01", "2026-03-15"),
    }


def test_split_memberships_of_stored_rounds(spark):
    rows = spark.createDataFrame(
        [("先着先行", "ゴールド会員：2026年2月28日～3月15日"), ("抽選先行", "ゴールド会員：2026年2月28日～3月15日")], "name string, evidence string"
    )
    got = ex.split_memberships(rows, as_of()).select("name", "child.name").collect()
    assert [tuple(x) for x in got] == [("先着先行", "先着先行 / ゴールド会員")]


def test_evidence_fills_the_window(spark):
    from roundtide.operators.rounds import normalize_rounds

    base = ex.extract_rounds(pages(spark, "抽選先行 受付期間 2026年6月10日～6月12日"), as_of())
    bare = base.withColumns({"lottery_start": F.lit(None).cast("date"), "lottery_end": F.lit(None).cast("date")})
    x = normalize_rounds(bare, as_of()).first()
    assert (str(x.application_start_at), str(x.application_end_at), x.status) == ("2026-06-10", "2026-06-12", "closed")


def test_offsets_count_code_points(spark):
    got = one(spark, d.occurrences(F.col("t"), F.lit("先行")), "😀先行a先行")
    assert got == [1, 4]


def test_range_forms(spark):
    f = lambda t: tuple(one(spark, d.date_range(F.col("t"), F.lit(None).cast("int"), as_of()), t))
    assert f("2026年6月1日(月)〜6月4日") == ("2026-06-01", "2026-06-04")
    assert f("6/1 から 6/4") == ("2026-06-01", "2026-06-04")
    assert f("1月5日") == ("2026-01-05", None)
    assert f("なし") == (None, None)


def test_year_guess_rolls_over(spark):
    assert one(spark, d.normalize_date(F.col("t"), F.lit(None).cast("int"), d.as_date("2026-12-01")), "1月5日") == "2027-01-05"
    assert one(spark, d.normalize_date(F.col("t"), F.lit(None).cast("int"), as_of()), "2月30日") is None


def test_round_name_prefers_specific_label_before_date(spark):
    assert one(spark, r.round_name(F.col("t")), "追加公演・抽選先行 2026年6月1日 先着先行") == "追加公演・抽選先行"
    assert one(spark, r.round_name(F.col("t")), "何もない") is None


def test_venue_rules_and_prices(spark):
    assert one(spark, ex.venues(F.col("t")), "会 場 EXシアター有明(東京)チケット抽選先行") == ["EXシアター有明(東京)"]
    assert one(spark, ex.ticket_rules(F.col("t")), "※転売禁止。なお、確認します。関係ない。") == ["※転売禁止 なお、確認します"]
    assert one(spark, ex.ticket_prices(F.col("t")), "S席：9,000円 A席：5,000円※税込") == ["S席：9,000円", "A席：5,000円"]


def test_label_windows_match_brute_force(spark):
    text = "aTiONb" * 30 + "tion" + "c" * 120
    got = one(spark, d.nearby_phrases(F.col("t"), string_array(("tion",)), 90, 1000), text)
    want, low, at = [], text.lower(), 0
    while (at := low.find("tion", at)) >= 0:
        w = text[max(0, at - 30) : at + 4 + 90]
        want += [] if w in want else [w]
        at += 4
    assert got == want
