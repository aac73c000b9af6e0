"""WARC archives: write captures as request, response or revisit, and metadata; assemble them again."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, spread_join, stage_table

EOL = "\r\n"
FILE_BYTES, LARGE = 16 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, warc_date string, "
    "payload_digest string, payload_bytes long, page_id long, fields map<string,string>, payload string"
)


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary or string column, in built-in functions only."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column | str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """Header lines (a null value leaves its line out), an empty line and the block."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind))]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(EOL, *lines), F.lit(EOL + EOL), block)


def _captures(src: DataFrame, min_revisit_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Responses with their html, and revisits with the response that each names.

    Rows are known by (p, url, digest, size) and the number of their copy, so nothing depends on
    the order in which a row is read, and a task that runs again gives the same ids.  Each payload
    of ``min_revisit_bytes`` or more is aggregated before it is shuffled; of its other rows only the small
    columns are, dealt by ``spread_join`` where one payload has very many.
    """
    key = ["digest", "size"]
    big, tiny = src.filter(F.col("size") >= min_revisit_bytes), src.filter(F.col("size") < min_revisit_bytes)
    small = big.groupBy(*key, "p", "url").agg(F.count("*").alias("copies"))
    payloads = small.groupBy(*key).agg(F.max(F.struct("p", "url")).alias("last"), F.count("*").alias("rows"), F.sum("copies").alias("m"))
    payloads = stage_table(payloads, "payloads")
    first = big.groupBy(*key).agg(F.max(F.struct("p", "url", "html")).alias("r")).select(*key, "r.p", "r.url", "r.html")
    rest = tiny.groupBy(*key, "p", "url").agg(F.max("html").alias("html"), F.count("*").alias("copies"))
    rest = rest.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1))).drop("copies")
    again = spread_join(small, payloads.filter("m > 1").select(*key, "last", "rows"), key, "rows")
    own = F.col("last") == F.struct("p", "url")
    last = F.col("copies").cast("int") - F.when(own, 1).otherwise(0)
    again = again.filter(last > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), last))).select(*key, "p", "url", "copy", F.col("last.p").alias("lp"), F.col("last.url").alias("lu"))
    return first.withColumn("copy", F.lit(0)).unionByName(rest), again


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> str:
    """Write one request, one response or revisit and one metadata record a row of ``pages``.

    ``pages`` has page_id, url and html; a null html is an empty payload and a null url an empty
    target.  Of rows with equal payloads of at least ``min_revisit_bytes`` bytes the one with
    the largest page_id (of equals the largest url, of repeated rows any) is the response and the others revisit it.  The files are
    gzip streams of records; repeated rows have records of their own.

    Files hold about ``FILE_BYTES``: payloads up to ``LARGE`` are dealt by their digests and cut by the mean
    size, and those above are written by classes of size, each with a number of records a file that fits its largest.
    """
    src = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(-(1 << 63))).alias("p"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\r\n]", "%0A").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    src = src.withColumns({"digest": base32_sha1(F.col("html")), "size": F.octet_length("html").cast("long")})
    first, again = _captures(src, min_revisit_bytes)
    usual = F.when(F.col("size") <= LARGE, F.col("size"))
    n, total, classes = src.agg(F.count(usual), F.coalesce(F.sum(usual), F.lit(0)), F.collect_set(F.when(F.col("size") > LARGE, _size_class()))).first()
    again = again.withColumn("html", F.lit(""))
    some = first.filter(F.col("size") <= LARGE).withColumns({"lp": F.lit(None).cast("long"), "lu": F.lit(None).cast("string")}).unionByName(again)
    _write(some, path, max(1, int(FILE_BYTES // (1024 + total / max(1, n)))), "overwrite")
    for k in sorted(classes):
        part = first.filter((F.col("size") > LARGE) & (_size_class() == k)).withColumns({"lp": F.lit(None).cast("long"), "lu": F.lit(None).cast("string")})
        _write(part, path, max(1, FILE_BYTES // (LARGE * 4 ** (k + 1))), "append")
    return path


def _size_class():
    """0 for payloads of more than ``LARGE`` and less than four times that, 1 for the next factor of four, and so on."""
    return F.floor(F.log2(F.col("size") / F.lit(LARGE)) / 2).cast("int")


def _write(x: DataFrame, path: str, each: int, mode: str) -> None:
    """Append the records of captures (digest, size, p, url, html, copy, lp, lu) to the archives."""
    own, kept = _urn(F.lit("response"), "p", "url", "digest", "copy"), _urn(F.lit("response"), "lp", "lu", "digest", F.lit(0))
    revisit = F.col("lp").isNotNull()
    page = F.when(F.col("p") != -(1 << 63), F.col("p").cast("string"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("size").cast("string"), F.lit(EOL + EOL))
    date, target = ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    rest = F.regexp_extract("url", "://[^/?#]*([^#]*)", 1)
    request = _record(
        "request",
        [("WARC-Record-ID", _urn(F.lit("request"), own)), ("WARC-Concurrent-To", own), date, target, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest)), F.lit(f" HTTP/1.1{EOL}Host: "), host, F.lit(EOL + EOL)),
    )
    response = _record(
        F.when(revisit, "revisit").otherwise("response"),
        [
            ("WARC-Record-ID", own), date, target, digest,
            ("WARC-Profile", F.when(revisit, PROFILE)), ("WARC-Refers-To", F.when(revisit, kept)),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, "html")),
    )
    metadata = _record(
        "metadata",
        [("WARC-Record-ID", _urn(F.lit("metadata"), own)), ("WARC-Concurrent-To", own), date, target, ("Content-Type", F.lit("application/warc-fields"))],
        F.coalesce(F.concat(F.lit("page-id: "), page, F.lit(EOL)), F.lit("")),
    )
    (
        x.select(F.concat_ws(EOL + EOL, request, response, metadata).alias("value"))
        .write.mode(mode).option("lineSep", EOL + EOL).option("compression", "gzip").option("maxRecordsPerFile", each)
        .text(path)
    )


def _members(data: bytes) -> bytes:
    """All gzip members of ``data``."""
    out, rest = [], data
    while rest:
        d = zlib.decompressobj(31)
        out.append(d.decompress(rest) + d.flush())
        rest = d.unused_data
    return b"".join(out)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(headers by lower-case name, block) of each record, cut by Content-Length alone."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            break
        first, *lines = data[at:end].decode("utf-8").split(EOL)
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record at byte {at}")
        headers = {}
        for line in lines:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        n = int(headers["content-length"])
        yield headers, view[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row a record of the archives under ``path``.

    The payload of a response is hashed again and a digest that disagrees with its header is an error;
    ``payload=False`` leaves the text itself out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split(" ")[0] for f in RECORD.replace("map<string,string>", "map").split(",")]
        kinds = [pa.string()] * 7 + [pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string()]
        for batch in batches:
            for value in batch.column(0):
                rows, held = [], 0
                for h, block in parse_records(_members(value.as_py())):
                    digest, size, page, fields, body = None, None, None, None, None
                    kind = h["warc-type"]
                    if kind in ("response", "revisit"):
                        raw = bytes(block)
                        head, _, content = raw.partition(b"\r\n\r\n")
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response":
                            size = len(content)
                            if base64.b32encode(hashlib.sha1(content).digest()).decode() != digest:
                                raise ValueError(f"payload digest of {h['warc-record-id']} disagrees")
                            body = content.decode("utf-8") if payload else None
                        else:
                            size = int(head.lower().rpartition(b"content-length:")[2].split(b"\r\n")[0])
                    elif kind == "metadata":
                        lines = [line.partition(":") for line in bytes(block).decode("utf-8").split(EOL) if line]
                        fields = [(a.strip(), b.strip()) for a, _, b in lines]
                        page = next((int(b) for a, b in fields if a == "page-id"), None)
                    rows.append((h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), digest, size, page, fields, body))
                    held += len(block)
                    if held > 1 << 22 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: the records joined through their concurrent-to identifiers.

    A response or revisit is its capture's centre; requests and metadata name it.  Records whose
    centre is missing still make a row, with a null response.  A revisit's ``refers_to`` becomes
    the page_id of the response that it names, where that is in the archives.
    """
    def part(*kinds: str) -> Column:
        fields = ["record_id", "record_type", "target_uri", "warc_date", "payload_digest", "payload_bytes", "refers_to", "payload"]
        fields = fields[:4] if "request" in kinds else fields
        fields = [*fields[:4], "page_id", "fields"] if "metadata" in kinds else fields
        return F.first(F.when(F.col("record_type").isin(*kinds), F.struct(*fields)), ignorenulls=True)

    captures = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        part("request").alias("request"), part("response", "revisit").alias("response"), part("metadata").alias("metadata")
    )
    # ids of captures that are referred to, from the small columns only
    pages = records.filter("record_type = 'metadata'").select(F.col("concurrent_to").alias("_to"), F.col("page_id").alias("refers_to"))
    return (
        captures.withColumns({"page_id": F.col("metadata.page_id"), "_ref": F.col("response.refers_to")})
        .join(pages.withColumnRenamed("_to", "_ref"), "_ref", "left")
        .select("capture_id", "page_id", "request", "response", "metadata", "refers_to")
    )


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0, payload: bool = True) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and return the captures read back.

    An empty table makes no archives and no rows; extra columns of ``pages`` are left aside.
    """
    spark = pages.sparkSession
    path = write_archives(pages, new_path(spark, "warc"), min_revisit_bytes)
    return assemble(read_archives(spark, path, payload))


SQL = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
e AS (
  SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(x, 1 + 10 * (k // 8), 10))::BIGINT) >> (35 - 5 * (k % 8))) & 31)::INT, 1) for k in range(32)], '') AS payload_digest
  FROM d),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS m FROM e)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> m THEN m END AS refers_to FROM f
"""
