"""Operator 5: WARC archives written and read as a chunked record table.

A payload travels as rows (record, chunk number, bytes) of at most CHUNK bytes, both on its way into an archive and out
of it, so that no task holds a whole record. Each task streams its rows into one gzip member for each record of an
archive of its own, under a name of its own in the shared folder; a table of the archives that tasks have finished is
what counts, so that a task that runs twice leaves an unread file only, with the same record ids: these follow from page
id and payload. Writer and reader hash as they go. Each chunk row that is read carries the digest of the payload so
far, the last one that of all of it, which must agree with the record's header; so must the chunks that are written.
An address stands in WARC-Target-URI, escaped where a header cannot hold it, and beside it as it was.

Of records with equal payloads of at least MIN_REVISIT bytes, that with the smallest id is a response and the others
are revisits of it, without a payload but with its digest and length in their header.

Defined cases: a null payload is empty; a null address is left out; a null id is left out and read back as null, and
is a revisit where a record with an id has the same payload, else a response; rows that share the smallest id are all
responses, with one record id; an archive that ends early or was changed raises an error; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import load, new_path, written

CHUNK = 1 << 18
MIN_REVISIT = 100
#: Rows given to Spark at once by the reader; each has CHUNK bytes at most.
ROWS = 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
NAMESPACE = uuid.UUID(int=5)  # of record ids
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_TABLE = "page_id long, url string, record_type string, refers_to long, payload_bytes long, chunk int, body binary, digest_so_far string, payload_digest string, last boolean"


def chunk_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """What the writer takes: rows of a record stand together, by ascending chunk number."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    long_ones = rows.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = long_ones.where("n > 1 and first is not null").select(F.col("digest").alias("_digest"), F.col("bytes").alias("_bytes"), "first")
    rows = rows.join(first, (F.col("digest") == F.col("_digest")) & (F.col("bytes") == F.col("_bytes")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", F.when(revisit, F.col("first")).alias("refers_to"), "digest", "bytes", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"))
    last = F.greatest(F.ceil(F.octet_length("payload") / F.lit(chunk)).cast("int") - 1, F.lit(0))
    each = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    return each.select("page_id", "url", "refers_to", "digest", "bytes", "chunk", F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("body"))


def record_id(page_id: int | None, digest: str) -> str:
    """The record of a page and payload has one id, whichever task writes it, however often."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {digest}')}>"


def header(row: dict) -> bytes:
    """The header of a record, up to where its payload starts."""
    revisit = row["refers_to"] is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(row['page_id'], row['digest'])}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{row['digest']}", f"X-Payload-Length: {row['bytes']}"]
    if row["page_id"] is not None:
        lines.append(f"X-Page-Id: {row['page_id']}")
    if row["url"] is not None:
        # a header's line holds no control or wide characters: the address as it was stands beside it, as JSON
        lines += ["WARC-Target-URI: " + quote(row["url"], safe=":/?#[]@!$&'()*+,;=%", errors="surrogatepass"), "X-Page-Url: " + json.dumps(row["url"])]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(row['refers_to'], row['digest'])}", f"X-Refers-To-Page: {row['refers_to']}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(HTTP) + (0 if revisit else row['bytes'])}"]
    return "\r\n".join([*lines, "", ""]).encode() + HTTP


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write chunk_rows() to archives in folder; gives the table of archives: path, records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, path = fs.FileSystem.from_uri(folder)
        path, records, out, member, ended = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, None, None, None

        def end() -> None:
            """Close the open record, if its chunks add up to the payload that its header names."""
            if member is None:
                return
            digest, wanted = ended
            if wanted and digest.hexdigest() != wanted:
                raise ValueError(f"chunks are missing before record {records + 1}")
            out.write(member.compress(b"\r\n\r\n") + member.flush())

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if out is None:
                    place.create_dir(path.rpartition("/")[0], recursive=True)
                    out = place.open_output_stream(path)
                if row["chunk"] == 0:
                    end()
                    ended = hashlib.sha256(), None if row["refers_to"] is not None else row["digest"]
                    member, records = zlib.compressobj(1, wbits=31), records + 1
                    out.write(member.compress(header(row)))
                ended[0].update(row["body"])
                out.write(member.compress(row["body"]))
        if out is not None:
            end()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]]), pa.array([records], pa.int64())], names=["path", "records"])

    return written(rows.mapInArrow(write, "path string, records long"), "archives")


def records_of(stream: io.BufferedReader, chunk: int) -> Iterator[tuple]:
    """Rows of the chunk table, of the archive in stream."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        left = int(fields["content-length"]) - len(HTTP)
        if stream.read(len(HTTP)) != HTTP:
            raise ValueError("a block of another kind")
        revisit, page = fields["warc-type"] == "revisit", fields.get("x-page-id")
        refers_to = int(fields["x-refers-to-page"]) if revisit else None
        url = json.loads(fields["x-page-url"]) if "x-page-url" in fields else fields.get("warc-target-uri")
        digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
        so_far, number = hashlib.sha256(), 0
        while True:
            body = stream.read(min(chunk, left))
            so_far.update(body)
            left -= len(body)
            if left and not body or not left and not revisit and so_far.hexdigest() != digest:
                raise ValueError(f"record {page} is damaged")
            yield None if page is None else int(page), url, fields["warc-type"], refers_to, size, number, body, so_far.hexdigest(), digest, not left
            number += 1
            if not left:
                break
        stream.read(4)


def read_archives(archives: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk table (CHUNK_TABLE) of all archives; each is streamed by one task."""
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in CHUNK_TABLE.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(folder)
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with place.open_input_stream(f"{root}/{name}") as raw, gzip.GzipFile(fileobj=raw) as plain:
                    for row in records_of(io.BufferedReader(plain, 1 << 16), chunk):
                        rows.append(row)
                        size += len(row[6]) + 400
                        if size >= ROWS * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return archives.repartition(max(1, archives.count())).mapInArrow(read, CHUNK_TABLE)  # in turn, an archive for each task


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    archives = write_archives(chunk_rows(load(spark, sf_dir, "pages")), folder)
    return read_archives(archives, folder).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
