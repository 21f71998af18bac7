"""WARC archives: written by Spark, read by a Python data source.

Writing: records of one payload group share a digest; the largest id of a group is the response, the
others are revisit records without payload that name it. Records are lines of a text table whose
line separator is the two CRLFs that end a WARC record, so Spark's committed writer makes the
archives on any file system, and a lost executor's part is written again. Archives are gzip files unless told otherwise.

Reading: the data source lists the files, deals them out as partitions by size, accepts filters on
record type and other headers, parses the header block first and passes over the payload of records
that are filtered out: by seeking, or in a gzip stream by inflating without keeping.

Edge cases: null html is an empty payload; a null id or url becomes an empty header value and reads
back as null; rows that repeat an id with one payload are both written, one of them as response only
where it holds the group's largest id; an empty table gives an empty folder that reads as no rows;
damaged files raise with their name and offset.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

from roundtide.llm.common import map_columns

#: Bytes of archive in a partition; a single larger file is a partition of its own.
PARTITION_BYTES = 64 << 20
#: Records in one archive at most.
RECORDS_PER_FILE = 4000
COLUMNS = (
    "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, "
    "http_length long, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _file_system(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Inflated:
    """Forward reads from a gzip stream of one or more members; what lies between reads is inflated and let go."""

    def __init__(self, f):
        self.f, self.at, self.left = f, 0, b""
        self.stream = zlib.decompressobj(31)
        self.ended = False

    def more(self) -> bytes:
        while not self.ended:
            if self.stream.eof:
                packed = self.stream.unused_data or self.f.read(1 << 18)
                self.stream = zlib.decompressobj(31)
            else:
                packed = self.stream.unconsumed_tail or self.f.read(1 << 18)
            if not packed:
                self.ended = True
                break
            out = self.stream.decompress(packed, 1 << 20)
            if out:
                return out
        return b""

    def read_at(self, n: int, at: int) -> bytes:
        parts, got = [], 0
        while got < n:
            piece = self.left or self.more()
            if not piece:
                break
            skip = min(len(piece), max(0, at - self.at))
            take = piece[skip : skip + n - got] if self.at + skip >= at else b""
            self.left = piece[skip + len(take) :]
            self.at += skip + len(take)
            if take:
                parts.append(take)
                got += len(take)
        if at > self.at:
            raise EOFError
        return b"".join(parts)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WarcReader(DataSourceReader):
    """Plans file partitions, takes header filters, reads headers before payloads."""

    def __init__(self, schema, options):
        self.path = options["path"]
        self.with_payload = str(options.get("payload", "true")).lower() == "true"
        self.filters: list[tuple[str, list[str] | None]] = []

    def pushFilters(self, filters):
        """Equality and membership on header columns are applied here; the rest goes back to Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in ("record_type", "record_id", "target_uri", "payload_digest", "refers_to"):
                if isinstance(f, EqualTo):
                    self.filters.append((name, [f.value]))
                    continue
                if isinstance(f, In):
                    self.filters.append((name, list(f.value)))
                    continue
                if isinstance(f, IsNotNull):
                    self.filters.append((name, None))
                    continue
            yield f

    def partitions(self):
        system, root = _file_system(self.path)
        found = system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.size and f.base_name[0] not in "._")
        parts: list[Files] = []
        room = 0
        for path, size in files:
            if not parts or size > room:
                parts.append(Files([]))
                room = PARTITION_BYTES
            parts[-1].files.append((path, size))
            room -= size
        return parts or [Files([])]

    def wanted(self, row: dict) -> bool:
        return all(row[c] is not None if v is None else row[c] in v for c, v in self.filters)

    def read(self, partition):
        system, _ = _file_system(self.path)
        for path, size in partition.files:
            with system.open_input_file(path) as f:
                if path.endswith(".gz"):
                    yield from self.records(Inflated(f), None, path)
                else:
                    yield from self.records(f, size, path)

    def records(self, f, size: int | None, path: str):
        """Records in order; the size is unknown (None) for a compressed stream, which only moves forward."""
        at, buffer = 0, b""  # buffer holds the file's bytes from `at` on
        while size is None or at < size:
            try:
                head = self.until(f, at, buffer)
            except EOFError:
                raise ValueError(f"{path}: the record before byte {at} ends early") from None
            if head == b"":
                return
            if head is None:
                raise ValueError(f"{path}: no header block at byte {at}")
            block, buffer = head
            headers = parse_headers(block)
            length = int(headers.get("content-length", -1))
            start = len(block)
            if not block.startswith(b"WARC/1.") or length < 0 or size is not None and at + start + length > size:
                raise ValueError(f"{path}: no whole record at byte {at}")
            row = {
                "record_id": headers.get("warc-record-id", "").removeprefix("<urn:page:").removesuffix(">") or None,
                "record_type": headers.get("warc-type"),
                "target_uri": headers.get("warc-target-uri") or None,
                "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                "refers_to": headers.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">") or None,
            }
            if self.wanted(row):
                while len(buffer) < start + length:
                    more = f.read_at(max(1 << 20, start + length - len(buffer)), at + len(buffer))
                    if not more:
                        raise ValueError(f"{path}: record at byte {at} ends early")
                    buffer += more
                http, payload = split_http(buffer[start : start + length])
                stated = int(http.get("content-length", len(payload)))
                is_full = row["record_type"] == "response" and self.with_payload
                yield (*row.values(), stated, payload if is_full else None)
            ahead = start + length + 4
            at, buffer = at + ahead, buffer[ahead:] if len(buffer) > ahead else b""

    @staticmethod
    def until(f, at: int, buffer: bytes):
        """The header block at ``at``, blank line included, and the buffer that holds it; b"" at the end."""
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            more = f.read_at(1 << 16, at + len(buffer))
            if not more:
                return None if buffer else b""
            buffer += more
        return buffer[: end + 4], buffer


def parse_headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    return parse_headers(head), payload


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)``; option ``payload=false`` leaves payloads undecoded."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return COLUMNS

    def reader(self, schema):
        return WarcReader(schema, self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def record_text(page_id, url, html: str, digest: str, n: int, kind: str, refers) -> str:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
    extra = "" if refers is None else (
        f"WARC-Refers-To: <urn:page:{refers}>\r\n"
        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
    )
    body = http if kind == "revisit" else http + html
    size = len(body.encode("utf-8", "surrogatepass"))
    uri = "" if url is None else " ".join(url.split())
    return (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\n"
        f"WARC-Target-URI: {uri}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:{digest}\r\n{extra}"
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {size}\r\n\r\n{body}"
    )


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "gzip") -> None:
    """One record a page; of equal payloads of ``min_bytes`` or more the largest id is the response.

    ``compression`` is gzip or none.
    """
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
        F.coalesce(pages["html"], F.lit("")).alias("html"),
    )
    raw = F.col("html").cast("binary")
    marked = rows.withColumn("sha", F.unhex(F.sha1(raw))).withColumn("n", F.octet_length("html").cast("long"))
    groups = marked.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
    shared = groups.where("copies > 1 and first is not null").select("sha", "first")
    joined = marked.join(shared, "sha", "left").withColumn(
        "refers", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    )

    def make():
        def step(ids, url, html, sha, n, refers):
            return [[
                record_text(i, u, h, base64.b32encode(s).decode(), size, "response" if r is None else "revisit", r)
                for i, u, h, s, size, r in zip(ids, url, html, sha, n, refers)
            ]]

        return step

    records = map_columns(joined.select("page_id", "url", "html", "sha", "n", "refers"), make, "value string", chunk=64)
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path, compression=compression)


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; digests of payloads are computed anew."""

    def make():
        def step(record_id, kind, digest, refers, length, payload):
            n = [len(p) if p is not None else size for p, size in zip(payload, length)]
            d = [base32_sha1(p) if p is not None else x for p, x in zip(payload, digest)]
            as_id = lambda x: None if x is None else int(x)
            return [list(map(as_id, record_id)), n, d, kind, list(map(as_id, refers))]

        return step

    wanted = records.select("record_id", "record_type", "payload_digest", "refers_to", "http_length", "payload")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return map_columns(wanted, make, schema, chunk=64)
