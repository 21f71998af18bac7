import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F
from roundtide.llm import warc

PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, "<p>ünï\r\n\r\nWARC/1.1\r\n</p>"), (4, "http://a/4", None),
    (5, "http://a/5", ""), (6, "http://a\r\nX: y", "x" * 200_000), (None, "http://n", "<p>own</p>"), (7, "u", "<p>same</p>"), (7, "u", "<p>same</p>"),
]


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.fixture(scope="module", params=["gzip", "none"])
def archive(spark, tmp_path_factory, request):
    path = str(tmp_path_factory.mktemp("warc") / "out")
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' as sha", "1 as n", "2 as first")
    warc.write_warc(df, path, compression=request.param)
    return path


def test_round_trip(spark, archive):
    got = sorted(map(tuple, warc.page_records(warc.read_warc(spark, archive)).collect()), key=str)
    last = {}
    for i, _, h in PAGES:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    expected = []
    for i, _, h in PAGES:
        first = last.get(h or "", i)
        expected.append((i, len((h or "").encode()), sha(h), "response" if first == i else "revisit", None if first == i else first))
    assert got == sorted(expected, key=str)


def test_payload_and_headers(spark, archive):
    rows = warc.read_warc(spark, archive).where("record_type = 'response'").collect()
    by_id = {r["record_id"]: r for r in rows}
    assert bytes(by_id["3"]["payload"]).decode() == PAGES[2][2]
    assert by_id["6"]["target_uri"] == "http://a X: y" and by_id["3"]["target_uri"] is None
    assert all(r["payload"] is None for r in warc.read_warc(spark, archive, payload=False).collect())


def test_filters_reach_the_reader(spark, archive):
    df = warc.read_warc(spark, archive).where((F.col("record_type") == "revisit") & F.col("refers_to").isin("7", "5"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "") or "isin" not in plan
    assert {r["record_id"] for r in df.collect()} == {"1", "2", "4"}
    assert warc.read_warc(spark, archive).where("http_length > 100000").count() == 1


def test_unwanted_payloads_are_not_read(spark, tmp_path):
    import pyarrow.fs as pafs

    archive = str(tmp_path / "plain")
    warc.write_warc(spark.createDataFrame(PAGES, "page_id long, url string, html string"), archive, compression="none")
    reader = warc.WarcReader(None, {"path": archive})
    list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")]))
    asked = []

    class Watched:
        def __init__(self, f):
            self.f = f

        def read_at(self, n, at):
            asked.append(n)
            return self.f.read_at(n, at)

    for part in reader.partitions():
        for path, size in part.files:
            with pafs.LocalFileSystem().open_input_file(path) as f:
                assert all(r[1] == "revisit" for r in reader.records(Watched(f), size, path))
    assert max(asked) <= 1 << 20


def test_small_payloads_stay_responses(spark, tmp_path):
    df = spark.createDataFrame(PAGES[:2], "page_id long, url string, html string")
    warc.write_warc(df, str(tmp_path / "w"), min_bytes=100)
    assert {r["record_type"] for r in warc.read_warc(spark, str(tmp_path / "w")).collect()} == {"response"}


def test_empty_and_damaged(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(none, str(tmp_path / "e"))
    assert warc.page_records(warc.read_warc(spark, str(tmp_path / "e"))).count() == 0
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n")
    with pytest.raises(Exception, match="no whole record at byte 0"):
        warc.read_warc(spark, str(tmp_path / "d")).collect()
    (tmp_path / "z").mkdir()
    whole = gzip.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nwhole\r\n\r\n")
    (tmp_path / "z" / "a.warc.gz").write_bytes(whole + whole)  # one member a record
    assert warc.read_warc(spark, str(tmp_path / "z")).count() == 2
    (tmp_path / "z" / "b.warc.gz").write_bytes(whole + gzip.compress(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort"))
    with pytest.raises(Exception, match="ends early"):
        warc.read_warc(spark, str(tmp_path / "z")).collect()
