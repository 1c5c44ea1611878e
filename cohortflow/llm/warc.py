"""WARC writing and reading as a chunked record table.

Every page becomes one WARC/1.1 record in gzip members, one archive per
Spark partition in the shared folder. Archives are read back as rows
(record_id, chunk_no, data, digest so far): a payload is streamed in pieces of
``CHUNK`` bytes through the decompressor, each row carrying the SHA-256 of
the payload up to and including its piece, so neither reading nor digesting
ever holds a whole record. The last chunk's digest is the record's digest. A
response whose bytes differ from its header in length or digest is an error.

Equal payloads of at least ``min_bytes`` are written once: the copy with the
smallest page_id is the response, the others are revisit records which refer
to it and carry no payload, only its digest and length in the header. The
first copy of a digest is found with map-side minima; pages meet it through a
salted key, so a payload shared by a third of all pages is spread out.

Archive names follow the partition number, and a file appears under its name
only when complete (written aside, then renamed), so a task that runs again
after an executor was lost replaces its file by the same content.

Defined results: a null html is an empty payload; a null page_id is written
as an empty id, read back as null, and never leads a group that has a
numbered page; repeated rows with the smallest page_id are all responses;
a payload may hold any text, WARC headers included; an empty table writes
no records and gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.common import materialize, prepare, scratch

CHUNK = 1 << 18
DATE = "2000-01-01T00:00:00Z"       # records are reproducible: no clock is read
CHUNKS = ("record_id string, page_id long, record_type string, refers_to long, payload_bytes long, "
          "chunk_no int, last boolean, chunk_bytes long, digest string, data binary")


# ------------------------------------------------------------------- storage

def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def store_path(path: str) -> str:
    """``file:/a`` and ``/a`` as ``file:///a``; other URIs stay."""
    if path.startswith("file:") and not path.startswith("file://"):
        return "file://" + path[len("file:"):]
    return path if "://" in path else f"file://{path}"


# ------------------------------------------------------------------- writing

def record_types(pages: DataFrame, min_bytes: int = 100, salts: int = 32) -> DataFrame:
    """Adds payload_bytes, payload_digest, refers_to (null for responses) to pages."""
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.octet_length(raw).cast("long").alias("payload_bytes"),
                        F.sha2(raw, 256).alias("payload_digest"))
    groups = (rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
              .filter("copies > 1 and first is not null")
              .select("payload_digest", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")))
    dealt = rows.withColumn("salt", F.pmod(F.hash("page_id"), F.lit(salts)))
    leads = F.col("page_id").eqNullSafe(F.col("first")) | F.col("first").isNull()
    return (dealt.join(groups, ["payload_digest", "salt"], "left")
            .withColumn("refers_to", F.when(~leads, F.col("first")))
            .drop("salt", "first", "copies"))


def _ident(page_id) -> str:
    return "" if page_id is None or pd.isna(page_id) else str(int(page_id))


def _header(r, record_id: str) -> bytes:
    revisit = not pd.isna(r.refers_to)
    url = "".join(r.url.split()) if isinstance(r.url, str) else ""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}",
             f"WARC-Payload-Digest: sha256:{r.payload_digest}", f"X-Page-ID: {_ident(r.page_id)}",
             f"X-Payload-Length: {int(r.payload_bytes)}", "Content-Type: text/html; charset=utf-8"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"X-Refers-To-Page-ID: {int(r.refers_to)}"]
    lines.append(f"Content-Length: {0 if revisit else int(r.payload_bytes)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(typed: DataFrame, folder: str) -> DataFrame:
    """Write one archive per partition of ``typed``; returns (path, n_records), written once."""
    prepare(typed.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        ctx = TaskContext.get()
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/part-{ctx.partitionId():06d}.warc.gz"
        aside = f"{name}.{uuid.uuid4().hex}"
        n = 0
        with store.open_output_stream(aside, compression=None) as out:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    n += 1
                    gz = zlib.compressobj(3, zlib.DEFLATED, 31)
                    seed = f"{_ident(r.page_id)}/{ctx.partitionId()}/{n}"
                    out.write(gz.compress(_header(r, str(uuid.uuid5(uuid.NAMESPACE_URL, seed)))))
                    if pd.isna(r.refers_to) and r.html is not None:
                        for i in range(0, len(r.html), CHUNK):       # pieces of the text, encoded one by one
                            out.write(gz.compress(r.html[i:i + CHUNK].encode()))
                    out.write(gz.compress(b"\r\n\r\n"))
                    out.write(gz.flush())
        if n:
            store.move(aside, name)
            yield pd.DataFrame({"path": [name], "n_records": [n]})
        else:
            store.delete_file(aside)

    cols = typed.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"),
                        "payload_bytes", "payload_digest", "refers_to")
    return materialize(cols.mapInPandas(write, "path string, n_records long"), "warc-files")


# ------------------------------------------------------------------- reading

class _Members:
    """Sequential reader over the gzip members of one archive, a bounded piece at a time."""

    def __init__(self, stream):
        self.stream, self.raw, self.held, self.gz = stream, b"", bytearray(), zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.gz.eof:
            self.raw, self.gz = self.gz.unused_data, zlib.decompressobj(31)
        if self.gz.unconsumed_tail:
            self.raw = self.gz.unconsumed_tail
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
            if not self.raw:
                return False
        piece, self.raw = self.raw, b""
        self.held += self.gz.decompress(piece, CHUNK)
        return True

    def line(self) -> bytes | None:
        while (at := self.held.find(b"\r\n")) < 0:
            if not self._more():
                return None
        out = bytes(self.held[:at])
        del self.held[:at + 2]
        return out

    def piece(self, most: int) -> bytes:
        while len(self.held) < most and self._more():
            pass
        out = bytes(self.held[:most])
        del self.held[:most]
        return out


def chunks_of(stream) -> Iterator[tuple]:
    """Rows of ``CHUNKS`` from one archive stream."""
    reader = _Members(stream)
    while (line := reader.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue                                    # blank lines between records
        head = {}
        while line := reader.line():
            name, _, value = line.partition(b":")
            head[name.decode().lower()] = value.strip().decode()
        left, digest, number, size = int(head["content-length"]), hashlib.sha256(), 0, 0
        page = int(head["x-page-id"]) if head["x-page-id"] else None
        refers = int(head["x-refers-to-page-id"]) if "x-refers-to-page-id" in head else None
        common = (head["warc-record-id"], page, head["warc-type"], refers, int(head["x-payload-length"]))
        while True:
            data = reader.piece(min(CHUNK, left))
            left -= len(data)
            size += len(data)
            digest.update(data)
            shown = (head["warc-payload-digest"].partition(":")[2] if refers is not None
                     else digest.copy().hexdigest())
            if left == 0 and refers is None:
                if size != int(head["x-payload-length"]):
                    raise OSError(f"{size} bytes in record {head['warc-record-id']}, not {head['x-payload-length']}")
                if shown != head["warc-payload-digest"].partition(":")[2]:
                    raise OSError(f"payload of record {head['warc-record-id']} differs from its digest")
            yield (*common, number, left == 0, len(data), shown, data)
            number += 1
            if left == 0:
                break
            if not data:
                raise OSError(f"archive ends inside record {head['warc-record-id']}")


def read_archives(files: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives listed in ``files`` (path), streamed file by file."""
    prepare(files.sparkSession)
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("chunk_no", pa.int32()),
                        ("last", pa.bool_()), ("chunk_bytes", pa.int64()), ("digest", pa.string()),
                        ("data", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, _ = open_store(base)
                with store.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for row in chunks_of(stream):
                        rows.append(row if with_data else (*row[:-1], None))
                        held += row[7]
                        if held >= 16 * CHUNK or len(rows) >= 2000:
                            yield _batch(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, schema)

    base = store_path(scratch(files.sparkSession, "any"))
    n = max(1, files.count())
    return files.select("path").repartition(min(n, 4096), "path").mapInArrow(read, CHUNKS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: the last chunk carries the digest; a response's chunks must add up to its header's length."""
    bad = F.raise_error(F.concat(F.lit("chunks of another length than the header's: "), "record_id")).cast("long")
    added = F.when(F.col("record_type") == "revisit", F.col("payload_bytes")).when(
        F.col("stored_bytes") == F.col("payload_bytes"), F.col("stored_bytes")).otherwise(bad)
    return (chunks.groupBy("record_id", "page_id", "record_type", "refers_to", "payload_bytes")
            .agg(F.sum("chunk_bytes").alias("stored_bytes"),
                 F.max(F.when(F.col("last"), F.col("digest"))).alias("payload_digest"))
            .withColumn("payload_bytes", added))


def archive_pages(spark: SparkSession, pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives and return the chunk table read back."""
    folder = store_path(scratch(spark, "warc"))
    return read_archives(write_archives(record_types(pages, min_bytes), folder))


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
