"""WARC archives: writing captures with revisits, and assembling them again from their records.

A capture is three records: the response (or a revisit that stands for an equal
payload), and a request and a metadata record that name it in WARC-Concurrent-To.
Every record is a gzip member of its own.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inodelake.llm.stores import write_file
from inodelake.runtime import shared_folder, table, written

#: Payloads of fewer bytes are always stored, never a revisit.
LEAST_REVISIT = 100
#: Up to so many revisits, their numbers are broadcast to the pages; more are merged with them.
BROADCAST = 500_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "type string, record_id string, concurrent_to string, refers_to string, uri string, digest string, payload_bytes long, payload binary, fields map<string,string>"


def record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    """One record as a gzip member; headers that are None are left out, line breaks in a value become spaces."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers.items() if v is not None]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def record_id(key: str) -> str:
    h = hashlib.md5(key.encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def capture(row: int, page_id: int | None, url: str | None, payload: bytes, digest: str, first_row: int | None, first_id: int | None) -> bytes:
    """The records of one capture; first_row and first_id name the capture that holds an equal payload."""
    main = record_id(f"main {row}")
    about = {"WARC-Record-ID": main, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first_row is None:
        out = record("response", about, http + payload)
    else:
        out = record("revisit", about | {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(f"main {first_row}")}, http)
    with_main = lambda n: {"WARC-Record-ID": record_id(f"{n} {row}"), "WARC-Target-URI": url, "WARC-Concurrent-To": main}
    out += record("request", with_main("request") | {"Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.1\r\nAccept: text/html\r\n\r\n")
    fields = "".join(f"{k}: {v}\r\n" for k, v in (("pageId", page_id), ("refersToPageId", first_id)) if v is not None)
    return out + record("metadata", with_main("metadata") | {"Content-Type": "application/warc-fields"}, fields.encode())


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, size: int = 64 << 20) -> DataFrame:
    """Write a capture per row of ``pages`` (page_id, url, html) below ``folder``; returns the manifest (stamp, captures, file).

    Payload: the html in UTF-8, null as empty, of any length. Of rows with equal payloads of
    ``least`` bytes or more, the one with the smallest page_id (null last; of
    repeated rows, the first) is the response and the others revisit it. Rows
    without url or page_id are written without those fields; an empty table
    gives no file; other columns are ignored, whatever their names. A task starts a new file after ``size`` bytes.

    Rows are numbered in a written copy. Digests alone are shuffled to find equal payloads. The manifest names the
    files of tasks that ended well; files that a lost or repeated attempt left behind have another ``stamp``.
    """
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"))
    rows = written(rows.withColumn("digest", F.sha2("payload", 256)), "pages")
    keys = rows.where(F.octet_length("payload") >= least).select("digest", F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row").alias("rank"))
    firsts = written(keys.groupBy("digest").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("of"), "first"), "firsts")
    again = keys.join(firsts, F.col("digest") == F.col("of")).where("rank.row <> first.row")
    again = written(again.select(F.col("rank.row").alias("again"), F.col("first.row").alias("first_row"), F.col("first.page_id").alias("first_id")), "revisits")
    few = again.limit(BROADCAST + 1).count() <= BROADCAST
    joined = rows.join(F.broadcast(again) if few else again.hint("merge"), F.col("row") == F.col("again"), "left")
    joined = joined.select("row", "page_id", "url", "payload", "digest", "first_row", "first_id")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        made: list[tuple] = []

        def close() -> None:
            nonlocal n
            stamp = uuid.uuid4().int >> 65
            made.append((stamp, len(held), write_file(folder, f"part-{part:06d}-{stamp:016x}.warc.gz", b"".join(held))))
            n = 0
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for values in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    held.append(capture(*values))
                    n += len(held[-1])
                    if n >= size:
                        close()
        if held:
            close()
        cols = list(zip(*made, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["stamp", "captures", "file"])

    return written(joined.mapInArrow(write, "stamp long, captures long, file string"), "manifest")


def members(raw: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The contents of the gzip members of an archive, which is read in steps so that what follows a member is not copied each time."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        d = zlib.decompressobj(31)
        parts = []
        while not d.eof:
            if at >= len(raw):
                raise EOFError("the last record is cut off")
            parts.append(d.decompress(view[at : at + step]))
            at += min(step, len(raw) - at)
        at -= len(d.unused_data)
        yield b"".join(parts)


def parse(raw: bytes, with_payload: bool) -> tuple:
    """A row of RECORD."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    fields: dict[str, str] = {}
    payload, n, digest = None, None, None
    if h["warc-type"] in ("response", "revisit"):
        http, _, body = block.partition(b"\r\n\r\n")
        stated = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
        n, digest = int(stated["content-length"]), h["warc-payload-digest"].removeprefix("sha256:")
        if h["warc-type"] == "response":
            if len(body) != n or hashlib.sha256(body).hexdigest() != digest:
                raise ValueError(f"damaged payload in {h['warc-record-id']}")
            payload = body if with_payload else None
    elif h["warc-type"] == "metadata":
        fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if x)
    return h["warc-type"], h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), digest, n, payload, list(fields.items())


def read_records(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """A row per record of the archives in ``folder`` that ``manifest`` names; payloads, checked against their digests, only if asked for."""
    spark = manifest.sparkSession
    if not manifest.take(1):
        return spark.createDataFrame([], RECORD)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string())]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for raw in batch.column(0):
                rows = []

                def out() -> pa.RecordBatch:
                    cols = zip(*rows, strict=True)  # noqa: B023
                    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

                for one in members(raw.as_buffer().to_pybytes()):
                    rows.append(parse(one, with_payload))
                    if len(rows) == 500:
                        yield out()
                        rows = []
                if rows:
                    yield out()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    stamp = F.conv(F.regexp_extract("path", "-([0-9a-f]{16})[.]warc[.]gz$", 1), 16, 10).cast("long")
    # a row for each file: Spark broadcasts them while they are few
    files = files.withColumn("stamp", stamp).join(manifest.select("stamp"), "stamp", "left_semi")
    return files.select("content").mapInArrow(read, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, main, request, metadata.

    Requests and metadata are joined to the main record (response or revisit) whose identifier they name in
    WARC-Concurrent-To. A capture without request or metadata has null there; records that name no main record in the
    archives are left out. Where identifiers clash - several main records with one, or several requests or metadata
    of one main record - the smallest by identifier, address, digest, size and fields stands for all. Null
    identifiers name nothing; an empty table gives no rows.
    """
    names = ("type", "record_id", "refers_to", "uri", "digest", "payload_bytes", "payload", "fields")
    order = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("record_id", "uri", "digest", "payload_bytes")], F.coalesce(F.to_json("fields"), F.lit("")))

    def one(name: str, key: str, *kinds: str) -> DataFrame:
        own = records.where(F.col("type").isin(*kinds) & F.col(key).isNotNull())
        return own.groupBy(F.col(key).alias(f"of_{name}")).agg(F.min_by(F.struct(*names), order).alias(name))

    out = one("main", "record_id", "response", "revisit")
    for name in ("request", "metadata"):
        out = out.join(one(name, "concurrent_to", name), F.col("of_main") == F.col(f"of_{name}"), "left")
    return out.select(F.col("of_main").alias("record_id"), "main", "request", "metadata")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Every page, written as WARC records and assembled again from the archives."""
    folder = f"{shared_folder(spark)}/warc"
    records = read_records(write_archives(table(spark, sf_dir, "pages"), folder), folder)
    fields = F.col("metadata.fields")
    return captures(records).select(
        fields["pageId"].cast("long").alias("page_id"),
        F.col("main.payload_bytes").alias("payload_bytes"),
        F.col("main.digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        fields["refersToPageId"].cast("long").alias("refers_to"),
    )


OP8_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM p LEFT JOIN firsts USING (payload_digest)
"""
