"""WARC archives with revisits, and an index of their captures merged from sorted runs.

Writing: a record per page, in archives that Spark's own writer commits (gzip, so any store that
Spark writes to will do). Of equal payloads of LEAST_BYTES or more, the page with the smallest id is
a response; the others are revisit records without a block that name it. Reading: archives are
parsed record by record by their Content-Length; payload digests are computed anew and must agree.

Index: the captures of an archive, sorted by URL key and time, are a run. All runs are dealt by
range of (URL key, time, id) - a URL with a third of all captures is parted by time - and each range
merges its slices of the runs with a loser tree. Ranges follow one another, so the whole is ordered.

Defined results: a null html is an empty payload; a null url has no target URI and the empty key;
line breaks in urls are escaped; a null page_id is a record without a number; repeated page_ids are
records each, those equal in payload to the first response of their id are responses too; payloads
of any length are written whole, long ones fewer to an archive; captures of equal key and time are
ordered by id, those without one first; a null time is left out; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_dir, written

#: Smaller payloads are always written in full.
LEAST_BYTES = 100
#: Records in an archive at most, of pages of up to PAGE_BYTES; of pages up to 4, 16, ... times as long a 4th, a 16th, ...
ARCHIVE_RECORDS, PAGE_BYTES = 4_096, 1 << 16
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Capture times of pages, which have none: STEP_SECONDS apart in the order of their ids modulo SPAN.
START, STEP_SECONDS, SPAN = 1_704_067_200, 600, 100_000_000


def records(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, at) -> record, the text of a WARC record without the closing line breaks, and the payload's bytes."""
    pages = pages.select("page_id", "url", "at", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("bytes", F.octet_length("html")).withColumn("digest", F.sha2("html", 256))
    shared = written(
        pages.where((F.col("bytes") >= LEAST_BYTES) & F.col("page_id").isNotNull())
        .groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"),
        "responses",
    )
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    day = F.to_utc_timestamp(F.timestamp_seconds("at"), F.current_timezone())
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    # repeats of the first page itself are responses
    again = F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first"))
    return pages.join(shared, "digest", "left").select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.when(again, "revisit").otherwise("response")),
            line("WARC-Record-ID", urn("page_id")),
            line("WARC-Date", F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
            line("WARC-Target-URI", url),
            line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            line("WARC-Payload-Length", F.col("bytes").cast("string")),  # an extension field
            F.when(again, F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", urn("first")))).otherwise(F.lit("")),
            line("Content-Type", F.lit("text/html;charset=utf-8")),
            line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
            F.lit("\r\n"),
            F.when(again, F.lit("")).otherwise(F.col("html")),
        ).alias("record"),
        "bytes",
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of at most ARCHIVE_RECORDS * PAGE_BYTES bytes, or of one page."""
    size = lambda c: F.greatest(F.lit(0), F.ceil(F.log(c / F.lit(PAGE_BYTES)) / F.log(F.lit(4.0)))).cast("int")
    longest = pages.agg(F.max(F.octet_length("html")).alias("bytes")).select(size(F.greatest("bytes", F.lit(1)))).first()[0] or 0
    found = records(pages)
    for k in range(longest + 1):  # mostly one: a size is four times the one before
        kind = found.where(size(F.greatest("bytes", F.lit(1))) == k) if longest else found
        kind.select("record").write.mode("append").option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", max(1, ARCHIVE_RECORDS >> (2 * k))).text(path)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields (names in lower case) and the block of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("a record is cut short")
        yield fields, block


def url_key(url: str) -> str:
    """Host labels from the right, then path and query: ``com,example)/a?b``; all in lower case, without www."""
    try:
        parts = urlsplit(url.strip().lower())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.strip().lower()
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


_CAPTURE = "run string, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_COLUMNS = [c.split()[0] for c in _CAPTURE.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = dict(zip(_COLUMNS, zip(*rows, strict=True), strict=True))
    whole = ("page_id", "refers_to")  # integers of any size beside missing ones
    return pd.DataFrame({c: pd.array(x, dtype="Int64") if c in whole else list(x) for c, x in columns.items()})


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch.path, batch.content, strict=True):
            rows = []
            for fields, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))):
                said = fields["warc-payload-digest"].removeprefix("sha256:")
                size = int(fields["warc-payload-length"])
                if fields["warc-type"] == "response":
                    digest, size = hashlib.sha256(block).hexdigest(), len(block)
                    if digest != said:
                        raise ValueError(f"{path}: the digest of {fields['warc-record-id']} does not agree")
                rows.append((path, url_key(fields.get("warc-target-uri", "")) if "warc-target-uri" in fields else "", fields.get("warc-date", ""), _page(fields["warc-record-id"]), size, said, fields["warc-type"], _page(fields.get("warc-refers-to"))))
            rows.sort(key=_order)
            if rows:
                yield _frame(rows)


def _order(row: tuple) -> tuple:
    return row[1], row[2], row[3] is not None, row[3] or 0


class LoserTree:
    """Merges sorted runs: the root holds the winner, each inner node the loser of its match, so the
    next row takes one match per level on the way from its run's leaf."""

    def __init__(self, runs: list[Iterator[tuple]], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.head: list[tuple | None] = [None] * self.k  # key and row; None: at its end
        for i in range(self.k):
            self._advance(i)
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._enter(i)

    def _advance(self, i: int) -> None:
        row = next(self.runs[i], None)
        self.head[i] = None if row is None else (self.key(row), i, row)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.head[i], self.head[j]
        return a is not None and (b is None or a[:2] < b[:2])

    def _enter(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # waits here for the match
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        if not self.k:
            return
        while (head := self.head[self.losers[0]]) is not None:
            yield head[2]
            i = self.losers[0]
            self._advance(i)
            node = (i + self.k) // 2
            while node > 0:
                other = self.losers[node]
                if self._beats(other, i):
                    self.losers[node], i = i, other
                node //= 2
            self.losers[0] = i


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: its slices of the runs, merged."""
    runs: dict[str, list[tuple]] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        for row in zip(*(batch.column(c).to_pylist() for c in _COLUMNS), strict=True):
            runs.setdefault(row[0], []).append(row)
    # a shuffle may hand over a run's blocks in any order
    for name in sorted(runs):
        runs[name].sort(key=_order)
    out: list[tuple] = []
    for row in LoserTree([iter(runs[name]) for name in sorted(runs)], _order):
        out.append(row)
        if len(out) == 10_000:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema)
            out = []
    if out:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema)


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """The captures of the archives under path, in order of URL key, time and id over all partitions."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    runs = written(files.mapInPandas(_runs, _CAPTURE), "runs")
    return runs.select(*_COLUMNS).repartitionByRange("url_key", "captured", "page_id").mapInArrow(_merged, _CAPTURE)


def op1_warc_external_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").withColumn("at", F.lit(START) + F.pmod("page_id", F.lit(SPAN)) * STEP_SECONDS)
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return capture_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


OP1_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (
  SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest),
k AS (
  SELECT page_id, lower(url) AS url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host FROM pages)
SELECT d.page_id, d.payload_bytes::BIGINT AS payload_bytes, d.payload_digest,
       CASE WHEN f.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to,
       array_to_string(list_reverse(string_split(regexp_replace(k.host, '^www[.]', ''), '.')), ',') || ')'
         || coalesce(nullif(regexp_extract(k.url, '^[^:]+://[^/?#]+(/[^?#]*)', 1), ''), '/')
         || regexp_extract(k.url, '^[^?#]*([?][^#]+)', 1) AS url_key,
       strftime(to_timestamp(1704067200 + (d.page_id % 100000000 + 100000000) % 100000000 * 600) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM d JOIN k ON d.page_id = k.page_id LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
"""
