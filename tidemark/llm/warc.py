"""WARC archives: write captures, read them back, merge their index."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import partitions_for
from tidemark.scratch import materialize, scratch_path

# Fixed values of the archive format.
VERSION = "WARC/1.1"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 100
RECORDS_PER_FILE = 2000
ROWS_PER_MERGE = 50_000

CAPTURE_SCHEMA = T.StructType([
    T.StructField("url_key", T.StringType()), T.StructField("captured_at", T.StringType()),
    T.StructField("page_id", T.LongType()), T.StructField("run", T.StringType()),
    T.StructField("position", T.LongType()), T.StructField("offset", T.LongType()),
    T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType())])
KEY = ["url_key", "captured_at", "page_id", "run", "position"]


def _urn(c: Column) -> Column:
    return F.concat(F.lit("<urn:capture:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line; nothing when the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Add payload, its size and digest, and the first page with the same payload.

    Only digests seen twice or more enter the join, so it stays far below the
    input; a payload shared by a third of all pages is one row on that side.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        "page_id", "url", "captured_at", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"))
    large = F.col("payload_bytes") >= min_bytes
    firsts = (rows.where(large).groupBy("payload_digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1").select(F.col("payload_digest").alias("key"), "first"))
    keyed = rows.withColumn("key", F.when(large, F.col("payload_digest")))
    joined = keyed.join(firsts, "key", "left").drop("key")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first")


def record_text(rows: DataFrame) -> Column:
    """One record without its closing line breaks, which the writer adds."""
    revisit = F.col("refers_to").isNotNull()
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    date = F.date_format(F.to_utc_timestamp("captured_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    body_bytes = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", _urn(F.col("page_id"))), _header("WARC-Target-URI", url),
        _header("WARC-Date", F.coalesce(date, F.lit("1970-01-01T00:00:00Z"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _header("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to")))),
        _header("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", body_bytes.cast("string")), F.lit("\r\n"),
        http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))


def write_archives(
    pages: DataFrame, path: str, *, min_bytes: int = MIN_REVISIT_BYTES, records_per_file: int = RECORDS_PER_FILE
) -> None:
    """Write one record per page to gzip archives under ``path``.

    ``pages`` has page_id, url, html and optionally captured_at (timestamp).
    Null html is an empty payload; a null url leaves its header out; line
    breaks in a url are percent-encoded. Of equal payloads of ``min_bytes`` or
    more, the smallest page_id is a response and the others revisit it; rows
    that repeat that id are all responses, and a null id never is the first.
    """
    if "captured_at" not in pages.columns:
        pages = pages.withColumn("captured_at", F.lit(None).cast("timestamp"))
    marked = with_revisits(pages, min_bytes)
    (marked.select(record_text(marked).alias("value")).write.option("lineSep", RECORD_END)
     .option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def surt(url: str | None) -> str:
    """Sort-friendly url: reversed lower-case host, then the rest."""
    host, rest = re.match(r"(?s)(?:[^:/?#]*://)?([^/?#]*)(.*)", url or "").groups()
    return ",".join(reversed(host.lower().split("."))) + ")" + rest


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of every record; framing by Content-Length only."""
    offset = 0
    while line := stream.readline():
        size, headers = len(line), {}
        if line.rstrip() != VERSION.encode():
            raise ValueError(f"no record at byte {offset}")
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(": ")
            headers[name] = value.removesuffix("\r\n")
            size += len(line)
        block = stream.read(length := int(headers["Content-Length"]))
        end = stream.read(len(RECORD_END))
        if len(block) < length or end != RECORD_END.encode():
            raise ValueError(f"cut record at byte {offset}")
        yield offset, headers, block
        offset += size + len(line) + length + len(end)


def _capture_id(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:capture:").removesuffix(">")
    return int(text) if text not in ("", "none") else None


def _capture(offset: int, headers: dict[str, str], block: bytes) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    said = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    kind, url = headers["WARC-Type"], headers.get("WARC-Target-URI")
    if kind == "response":
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        if digest != said:
            raise ValueError(f"payload differs from its digest at byte {offset}")
    else:
        digest, size = said, int(re.search(rb"(?i)content-length: (\d+)", head)[1])
    return {
        "url_key": surt(url), "captured_at": headers["WARC-Date"], "page_id": _capture_id(headers["WARC-Record-ID"]),
        "offset": offset, "url": url, "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": _capture_id(headers.get("WARC-Refers-To"))}


def _order(c: dict) -> tuple:
    """Null ids first, as Spark sorts them."""
    return c["url_key"], c["captured_at"], c["page_id"] is not None, c["page_id"] or 0, c["run"], c["position"]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One locally sorted run of captures per archive file, numbered by ``position``.

    Records are read one at a time from the decompressing stream.
    """
    to = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in CAPTURE_SCHEMA])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                run = name.as_py().rpartition("/")[2]
                with gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())) as stream:
                    found = [_capture(*record) | {"run": run, "position": 0}
                             for record in parse_records(io.BufferedReader(stream, 1 << 16))]
                found.sort(key=lambda c: (*_order(c)[:4], c["offset"]))
                for i, capture in enumerate(found):
                    capture["position"] = i
                yield pa.RecordBatch.from_pylist(found, to)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(runs, CAPTURE_SCHEMA)


class LoserTree:
    """K-way merge: inner nodes keep the loser of their match, the root the winner.

    Taking the smallest head and refilling its run costs one match a level.
    """

    def __init__(self, runs: list[Iterable], key):
        self.key, self.runs = key, [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * len(runs)
        self.winner = self._build(1) if runs else -1

    def _before(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[a] is not None
        return self.keys[a] <= self.keys[b]

    def _build(self, node: int) -> int:
        k = len(self.runs)
        if node >= k:  # a leaf
            return node - k
        left, right = self._build(2 * node), self._build(2 * node + 1)
        winner, self.losers[node] = (left, right) if self._before(left, right) else (right, left)
        return winner

    def __iter__(self) -> Iterator:
        while self.winner >= 0 and self.keys[self.winner] is not None:
            at = self.winner
            yield self.heads[at]
            self.heads[at] = head = next(self.runs[at], None)
            self.keys[at] = None if head is None else self.key(head)
            node = (at + len(self.runs)) // 2
            while node:
                if self._before(self.losers[node], at):
                    at, self.losers[node] = self.losers[node], at
                node //= 2
            self.winner = at


def merge_runs(runs: DataFrame, rows_per_task: int = ROWS_PER_MERGE) -> DataFrame:
    """Globally ordered capture histories: by url key, time, page and place.

    Range partitions cut the key space; the key ends in (run, position), so even
    one url with a third of all captures is cut. Each task merges the parts of
    all runs that fall into its range with a loser tree.
    """
    stored = materialize(runs, "runs")
    parts = partitions_for(stored.sparkSession, stored.count(), rows_per_task)
    names = stored.columns

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_run: dict[str, list[dict]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for row in batch.to_pylist():
                by_run.setdefault(row["run"], []).append(row)
        if not by_run:
            return
        for rows in by_run.values():
            rows.sort(key=lambda c: c["position"])  # a run's order, which the exchange may have cut
        merged = list(LoserTree(list(by_run.values()), _order))
        for i in range(0, len(merged), 10_000):
            yield pa.RecordBatch.from_pylist(merged[i:i + 10_000], schema)

    return stored.repartitionByRange(parts, *KEY).select(*names).mapInArrow(merge, stored.schema)


def capture_histories(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write archives, read them back, merge their runs into one ordered index.

    Columns of ``CAPTURE_SCHEMA``: one row per page, in global order from
    partition to partition. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archives")
    write_archives(pages, path, **options)
    return merge_runs(read_runs(spark, path))
