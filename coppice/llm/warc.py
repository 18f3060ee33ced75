"""WARC archives: writing them, and normalising monolithic gzip ones.

Spark's text writer makes each archive as one gzip stream over many records. The
normaliser inflates such a stream once, front to back in bounded memory, rewrites
every record as a gzip member of its own and gives a row per record for the
sidecar index (archive, offset, length, headers), which is written as Parquet
beside the archives. A record is then read with one seek.

Tasks write their archive under a temporary name and rename it when it is whole,
so a repeated task replaces its own output. Reading back checks every payload against its
digest and every revisit against a response of that page and digest.

Defined results: a null html is an empty payload; a null url gives no
WARC-Target-URI; of payloads of at least ``MIN_BYTES`` bytes, the page with the
smallest page_id (not null, if any has one) is the response and rows with that
same page_id stay responses too; rows are returned one for one; an empty table
gives no archive and an empty result; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import unquote_plus

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.plans.storage import materialize, new_path, table

MIN_BYTES = 100
#: Repeated digests are broadcast up to this number (100 bytes each), and joined by a shuffle beyond it.
BROADCAST_ROWS = 50_000
RECORDS_PER_ARCHIVE = 20_000
CHUNK = 1 << 20
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset bigint, length bigint, record_id string, record_type string"


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI as Spark writes it."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def typed(pages: DataFrame) -> DataFrame:
    """Pages with payload, its size and digest, and the response that it repeats, if any."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long"))
    digest = F.sha2(F.col("payload").cast("binary"), 256)
    repeated = materialize(
        rows.where(F.col("size") >= MIN_BYTES)
        .groupBy(digest.alias("digest"))
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first_id"),
        "repeated-payloads",
    )
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    joined = rows.withColumn("digest", digest).join(repeated, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return joined.withColumn("refers_to", F.when(revisit & (F.col("size") >= MIN_BYTES), F.col("first_id")))


def record(rows: DataFrame) -> DataFrame:
    """The text of each page's WARC record, without its last line end."""
    again = F.col("refers_to").isNotNull()
    urn = lambda c: F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(c.cast("string")), F.lit(">")), F.lit("<urn:page>"))
    own = F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    length = F.lit(len(HTTP_HEAD)) + F.when(again, 0).otherwise(F.col("size"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        field("WARC-Record-ID", own),
        F.lit(f"WARC-Date: {datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}"),
        field("X-Page", urn(F.col("page_id"))),
        field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        field("X-Payload-Length", F.col("size").cast("string")),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(again, field("X-Refers-To-Page", urn(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        field("Content-Length", length.cast("string")),
    )
    body = F.when(again, F.lit("")).otherwise(F.col("payload"))
    return rows.select(F.concat(head, F.lit("\r\n\r\n" + HTTP_HEAD), body, F.lit("\r\n")).alias("value"))


def write_monolithic(pages: DataFrame, path: str) -> None:
    """Archives of many records each, every one a single gzip stream."""
    (
        record(typed(pages)).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
        .option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(path)
    )


def inflated(source) -> Iterator[bytes]:
    """Chunks of a gzip stream of one or more members."""
    stream = zlib.decompressobj(31)
    while chunk := source.read(CHUNK):
        while chunk:
            yield stream.decompress(chunk)
            chunk = stream.unused_data
            if stream.eof:
                stream = zlib.decompressobj(31)


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record with its two line ends) in file order; holds one record at a time."""
    buffer, at, more = bytearray(), 0, True

    def fill() -> bool:
        nonlocal buffer, at
        if (chunk := next(chunks, None)) is None:
            return False
        if at:
            del buffer[:at]
            at = 0
        buffer += chunk
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0 and (more := fill()):
            pass
        if end < 0:
            if bytes(buffer[at:]).strip():
                raise ValueError("archive ends inside a record's headers")
            return
        fields = headers(bytes(buffer[at:end]))
        size = end + 4 + int(fields["content-length"]) + 4 - at
        while len(buffer) - at < size and (more := fill()):
            pass
        if len(buffer) - at < size:
            raise ValueError("archive ends inside a record")
        yield fields, bytes(buffer[at : at + size])
        at += size


def _normalise(target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = located(uri)
                name = uri.rsplit("/", 1)[1].split(".")[0]
                out_store, out = located(f"{target}/{name}.warc.gz")
                part, rows, offset = f"{out}.{uuid.uuid4().hex}", [], 0
                with store.open_input_stream(path, compression=None) as source, out_store.open_output_stream(part, compression=None) as sink:
                    for fields, whole in records(inflated(source)):
                        member = gzip.compress(whole, compresslevel=1, mtime=0)
                        sink.write(member)
                        rows.append((offset, len(member), fields.get("warc-record-id"), fields.get("warc-type")))
                        offset += len(member)
                out_store.move(part, out)
                for begin in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[begin : begin + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{target}/{name}.warc.gz"] * len(cols[0]), pa.string()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())],
                        names=["archive", "offset", "length", "record_id", "record_type"],
                    )

    return run


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite the archives under source into target, one gzip member a record; the index as a DataFrame.

    The index is also written beside the archives, in target/index.
    """
    store, path = located(target)
    store.create_dir(path, recursive=True)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    archives.mapInArrow(_normalise(target), INDEX).write.parquet(f"{target}/index")
    return spark.read.schema(INDEX).parquet(f"{target}/index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, source = None, None
    for batch in batches:
        out = []
        for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if archive != name:
                store, path = located(archive)
                name, source = archive, store.open_input_file(path)
            source.seek(offset)
            (fields, whole), *_ = records(iter([gzip.decompress(source.read(length))]))
            block = whole[whole.index(b"\r\n\r\n") + 4 : -4]
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
            if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"{archive} at {offset}: the payload does not match its digest")
            page = lambda urn: unquote_plus(urn[len("<urn:page:") : -1]) if ":page:" in urn else None
            size = len(payload) if kind == "response" else int(fields["x-payload-length"])
            out.append((page(fields["x-page"]), size, digest, kind, page(fields["x-refers-to-page"]) if kind == "revisit" else None))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
            names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        )


def read_records(index: DataFrame, page_type: str = "bigint") -> DataFrame:
    """Every record that the index names, read by its offset and checked against its digest."""
    read = index.select("archive", "offset", "length").mapInArrow(
        _read, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
    )
    return read.withColumns({c: F.col(c).cast(page_type) for c in ("page_id", "refers_to")})


def broken_references(rows: DataFrame) -> DataFrame:
    """(refers_to, payload_digest) of revisits whose response is not there or has another payload."""
    again = rows.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    there = rows.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest")
    return again.join(there, ["refers_to", "payload_digest"], "left_anti")


def round_trip(pages: DataFrame) -> DataFrame:
    """The pages' records, as they are read back from normalised archives; every revisit's response has been found."""
    spark = pages.sparkSession
    source, target = new_path(spark, "warc-monolithic"), new_path(spark, "warc")
    write_monolithic(pages, source)
    rows = materialize(read_records(normalise(spark, source, target), pages.schema["page_id"].dataType.simpleString()), "warc-records")
    if broken := broken_references(rows).first():
        raise ValueError(f"no response of page {broken['refers_to']} has the payload {broken['payload_digest']}")
    return rows


def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


OP6_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p
  WHERE payload_bytes >= {MIN_BYTES} GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id OR p.payload_bytes < {MIN_BYTES}
            THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id OR p.payload_bytes < {MIN_BYTES}
            THEN NULL ELSE f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
