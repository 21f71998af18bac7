"""Windows of texts: patterns that match, their order, dates as text, and how the reading is dealt out."""

import contextlib
import io

from pyspark.sql import functions as F

from roundtide import dims
from roundtide.functions import dates as dt
from roundtide.functions import rounds as rd
from roundtide.functions.text import string_array
from roundtide.operators import extraction as ex

TEXTS = [
    "第2次抽選先行 受付期間 2026年1月5日 ～ 1月9日 抽選結果 1/12 一般発売 2026/2/1",
    "fc先行 Fc 先行 入金 3月4日 🎫🎫 当落 3/9 発売日 2026-04-01",
    "ぴあ 先行" + "あ" * 600 + "一般発売 一般発売 13月40日",
    "何もない", "",
]


def test_patterns_as_text_give_the_windows_of_all_patterns(spark):
    names = [*dims.ROUND_LABEL_PATTERNS, *dims.ROUND_EXTRA_PATTERNS, *dims.ROUND_CONTEXT_HINTS, "FC"]
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select(dt.pattern_windows(F.col("t"), names, 60, 220).alias("a"), dt.pattern_windows(F.col("t"), string_array(names), 60, 220).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and len(got[2].a) > 1
    tried = df.select(dt.occurring(F.col("t"), ["一般発売", "fc", "一般発売", r"第\s*\d"]).alias("p")).collect()
    assert [r.p for r in tried] == [["一般発売", r"第\s*\d"], ["fc"], ["一般発売"], [], []]


def test_dates_of_odd_parts(spark):
    days = ["2026-02-30", "0000-01-01", "2026-12-31", " 2026-1-1", "2024-02-29T10", None]
    df = spark.createDataFrame([(d,) for d in days], "d string")
    assert [str(r[0]) for r in df.select(dt.iso_date(F.col("d"))).collect()] == ["None", "None", "2026-12-31", "None", "2024-02-29", "None"]
    tokens = spark.createDataFrame([("2026年1月5日",), ("0/0",), ("２月３０日",), ("3/4",)], "t string")
    got = [r[0] for r in tokens.select(dt.token_iso(F.col("t"), F.lit(None).cast("int"), dt.as_date("2026-08-02"))).collect()]
    assert got == ["2026-01-05", None, None, "2026-03-04"]


def test_name_without_any_date(spark):
    df = spark.createDataFrame([("🎫 先行抽選 のち 一般発売",), ("一般発売 1/2 先着先行",)], "t string")
    assert [r[0] for r in df.select(rd.round_name(F.col("t"))).collect()] == ["一般発売", "一般発売"]


def test_windows_are_read_by_a_given_number_of_tasks(spark):
    pages = spark.createDataFrame([(1, "https://eplus.jp/1", TEXTS[0])], "page_id long, url string, text string")
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        ex.extract_rounds(pages, dt.as_date("2026-08-02")).explain()
    assert "REPARTITION_BY_NUM" in said.getvalue()
