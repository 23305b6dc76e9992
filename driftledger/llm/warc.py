"""WARC archives of pages, read back, and the merged index of their captures.

Archives are plain WARC 1.0 files in the shared folder, written by Spark's text
writer with the record end as its line end.  The captures of an archive, sorted
where it is read, are a run; runs are cut at common range bounds, and each range
merges its pieces of all runs with a loser tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import partial
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import folder, prepare, stored

#: Bytes that one archive holds at most, if no record alone is larger.
ARCHIVE_BYTES = 16 << 20
#: Index rows that one merging task holds, about.
RANGE_ROWS = 200_000
#: Time of the capture with page_id 0, seconds; later ids follow by a second each.
EPOCH = 1_700_000_000

CAPTURE = "page_id long, url string, url_key string, captured_at string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long, record_bytes long, run_at long"


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string's UTF-8 or of binary."""
    digits = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with what their records say: payload, digest, record type and reference.

    Of payloads that are equal and have ``least_bytes`` or more, that of the
    smallest ``page_id`` is a response and the others revisit it; rows that repeat
    the smallest ``page_id`` and rows without one are responses too.
    """
    prepare(pages.sparkSession)
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"))
    first = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Written first, so that the join can split a payload that very many pages share.
    first = stored(first.select("payload_digest", "first"), "first-captures")
    revisit = F.col("first") < F.col("page_id")
    return rows.join(first, "payload_digest", "left").withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first")


def _archived(batches: Iterator[pa.RecordBatch], archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Records with the number of their archive: a new one where the running sum of bytes would pass ``archive_bytes``."""
    number, total = 0, 0
    for batch in batches:
        numbers = []
        for size in pc.binary_length(batch.column("value")).to_pylist():
            if total and total + size + 4 > archive_bytes:
                number, total = number + 1, 0
            total += size + 4
            numbers.append(number)
        yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(numbers, pa.int32())], names=["value", "archive"])


def write_archives(rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One record for each row of ``captures``, in archives below ``path``.

    Each task fills archives of its own, one after the other; a record that is
    larger than an archive has one alone.
    """
    clean = lambda c: F.regexp_replace(c.cast("string"), r"[\r\n]", "")
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col("page_id"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit("\r\n\r\n"))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    uri = lambda c: F.concat(F.lit("<urn:page:"), c, F.lit(">\r\n"))
    optional = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Date: "), date, F.lit("\r\n"),
        optional("WARC-Record-ID", uri(F.col("page_id"))),
        optional("WARC-Target-URI", F.concat(clean(F.col("url")), F.lit("\r\n"))),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit("\r\n"),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n")).otherwise(F.lit("")),
        optional("WARC-Refers-To", uri(F.col("refers_to"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit("\r\n\r\n"), block,
    )
    # A record ends with two line ends, the second pair is the writer's line separator.
    records = rows.select(record.alias("value")).mapInArrow(partial(_archived, archive_bytes=archive_bytes), "value string, archive int")
    records.write.partitionBy("archive").option("lineSep", "\r\n\r\n").text(path)


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: host labels reversed, no scheme, ``www`` or fragment."""
    try:
        parts = urlsplit(url)
        host = re.sub(r"^www\d*\.", "", (parts.hostname or "").lower())
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}{port}){(parts.path or '/').lower()}" + (f"?{parts.query.lower()}" if parts.query else "")


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers, block, offset and length of each record."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        start, size = end + 4, int(headers["Content-Length"])
        if not lines[0].startswith("WARC/") or content[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"no WARC record at {at}")
        yield headers, content[start : start + size], at, start + size + 4 - at
        at = start + size + 4


def _number(uri: str | None) -> int | None:
    return int(uri.removeprefix("<urn:page:").rstrip(">")) if uri else None


def _order(row: tuple) -> tuple:
    """The order of captures: URL key, time, id (none first), then archive and offset."""
    return row[2], row[3], row[0] is not None, row[0] or 0, row[8], row[9]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, from the archives alone; each payload is checked against its digest.

    The captures of an archive are a run: sorted by URL key, time and id, ``run_at`` is their place.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                archive = "/".join(batch.column("path")[k].as_py().rsplit("/", 2)[1:])
                out = []
                for headers, block, offset, size in parse_archive(batch.column("content")[k].as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = int(head.decode().rsplit("Content-Length: ", 1)[1])
                    kind = headers["WARC-Type"]
                    if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"payload and digest differ in {archive} at {offset}")
                    url = headers.get("WARC-Target-URI")
                    out.append((_number(headers.get("WARC-Record-ID")), url, url_key(url or ""), headers["WARC-Date"], length, digest, kind, _number(headers.get("WARC-Refers-To")), archive, offset, size))
                out = [(*row, at) for at, row in enumerate(sorted(out, key=_order))]
                names, kinds = zip(*(x.split() for x in CAPTURE.split(", ")), strict=True)
                columns = zip(*out, strict=True) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t == "long" else pa.string()) for c, t in zip(columns, kinds, strict=True)], names=list(names))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, CAPTURE)


def loser_tree(runs: list[Iterator]) -> Iterator:
    """Merge sorted iterators: each inner node keeps the loser of its match, the winner goes up."""
    k, done = len(runs), object()
    heads = [next(r, done) for r in runs]

    def beats(a: int, b: int) -> bool:
        if heads[a] is done or heads[b] is done:
            return heads[b] is done and (heads[a] is not done or a < b)
        return (heads[a], a) < (heads[b], b)

    losers, winner = [-1] * k, -1
    for leaf in range(k):
        player, node = leaf, (leaf + k) // 2
        while node and losers[node] != -1:
            if beats(losers[node], player):
                losers[node], player = player, losers[node]
            node //= 2
        if node:
            losers[node] = player
        else:
            winner = player
    while k and heads[winner] is not done:
        yield heads[winner]
        heads[winner] = next(runs[winner], done)
        player, node = winner, (winner + k) // 2
        while node:
            if beats(losers[node], player):
                losers[node], player = player, losers[node]
            node //= 2
        winner = player


def _run(table: pa.Table, lo: int, hi: int) -> Iterator[tuple]:
    """The order of each row of a run's piece and its place in the table, a few rows at a time."""
    for at in range(lo, hi, 256):
        rows = table.slice(at, min(256, hi - at))
        columns = (rows.column(c).to_pylist() for c in ("url_key", "captured_at", "page_id", "archive", "record_offset"))
        for k, (key, time, page, archive, offset) in enumerate(zip(*columns, strict=True)):
            yield key, time, page is not None, page or 0, archive, offset, at + k


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows, by archive and place in its run -> the rows in order."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found)
    archives = table.column("archive").combine_chunks()
    starts = [0, *(1 + i for i in pc.indices_nonzero(pc.not_equal(archives[1:], archives[:-1])).to_pylist())]
    merged = loser_tree([_run(table, a, b) for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True)])
    while places := [row[-1] for row in islice(merged, 10_000)]:
        yield from table.take(pa.array(places, pa.int64())).to_batches()


def merged_index(records: DataFrame) -> DataFrame:
    """Captures of all archives in one order: ``url_key``, ``captured_at``, ``page_id``.

    Ranges of that whole key go to tasks, so one URL of very many captures is
    split as well; there are as many that each holds about ``RANGE_ROWS`` index
    rows.  Each merges its pieces of all runs.  Rows of later partitions sort after those of earlier ones.
    """
    runs = stored(records, "capture-runs")
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    ranged = runs.repartitionByRange(ranges, "url_key", "captured_at", "page_id", "archive", "record_offset")
    return ranged.sortWithinPartitions("archive", "run_at").mapInArrow(_merge, CAPTURE)


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives, read them back and return the merged index.

    Null html is an empty payload; a null url has no target and an empty key; an
    empty table gives no rows; repeated rows have a record each; other columns
    are ignored.
    """
    spark = pages.sparkSession
    path = folder(spark, "warc")
    rows = captures(pages, least_bytes)
    write_archives(rows, path)
    return merged_index(read_archives(spark, path))


#: DuckDB SQL for the columns that the contract names.
SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::INT >> ((3 - i % 4) * 5)::INT) & 31) + 1, 1)), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM f"""
