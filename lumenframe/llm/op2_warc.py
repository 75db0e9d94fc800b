"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC/1.1 records,
and ends with a seek table in a skippable frame (magic 0x184D2A5E; per frame its
compressed and decompressed size; footer magic 0x8F92EAB1), so a reader finds any frame
from the file's end.  ``index`` is a Parquet table that maps a page's id to bundle, frame
and the record's offset within the decompressed frame.

Equal payloads of at least ``least_bytes`` are stored once, with the largest id; the
other pages become revisit records, whose HTTP header still tells the payload's length
and whose WARC headers tell its digest and the record they refer to.

Tasks name their bundles by attempt and report them in the index, which Spark commits
once per task, so a repeated task leaves at most unlisted files.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Files, read_table, shared_folder, written

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEAST_BYTES = 1 << 20, 512 << 20, 1000
FETCH_BYTES = 8 << 20
INDEX = "page_id long, bundle string, frame long, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _line(text: str | None) -> str:
    """A header value: line ends and other controls become blanks."""
    return re.sub(r"[\x00-\x1f\x7f]", " ", text or "")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, payload_bytes: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit's block has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes):
    """(WARC headers, HTTP headers, payload, offset, length) of each record in ``data``."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) for x in lines)
        start = end + 4
        stop = start + int(head["Content-Length"])
        http_end = data.index(b"\r\n\r\n", start, stop)
        http = dict(x.split(": ", 1) for x in data[start:http_end].decode().split("\r\n")[1:])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where it says")
        yield head, http, data[http_end + 4 : stop], at, stop + 4 - at
        at = stop + 4


class BundleWriter:
    """Appends records to frames and frames to bundles; gives index rows."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int):
        import zstandard

        self.files, self.frame_bytes, self.bundle_bytes = Files(f"{folder}/bundles"), frame_bytes, bundle_bytes
        self.compressor = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.file, self.raw, self.size, self.rows = None, [], 0, []

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.file is None:
            self.bundle = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}.warc.zst"
            self.file, self.sizes = self.files.writer(self.bundle), []
        self.rows.append((page_id, self.bundle, len(self.sizes), self.size, len(record)))
        self.raw.append(record)
        self.size += len(record)
        if self.size >= self.frame_bytes:
            self._frame()
            if sum(c for c, _ in self.sizes) >= self.bundle_bytes:
                self.close()

    def _frame(self) -> None:
        if self.raw:
            frame = self.compressor.compress(b"".join(self.raw))
            self.file.write(frame)
            self.sizes.append((len(frame), self.size))
            self.raw, self.size = [], 0

    def close(self) -> None:
        if self.file is not None:
            self._frame()
            table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
            self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
            self.file.close()
            self.file = None


def seek_table(file) -> list[tuple[int, int]]:
    """(offset, compressed size) of each frame, from the end of a seekable bundle."""
    file.seek(0, 2)
    size = file.tell()
    file.seek(size - 9)
    frames, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * frames)
    offset, table = 0, []
    for compressed, _ in struct.iter_unpack("<II", file.read(8 * frames)):
        table.append((offset, compressed))
        offset += compressed
    return table


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


class Archive:
    """A written archive: ``index`` as a DataFrame, ``folder`` with the bundles."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.index = folder, spark.read.schema(INDEX).parquet(f"{folder}/index")

    def records(self, payloads: bool = False) -> DataFrame:
        """All records read from the bundles, frame by frame; digests of responses are checked."""
        folder = self.folder

        def task(batches):
            import zstandard

            files, decompress = Files(f"{folder}/bundles"), zstandard.ZstdDecompressor()
            for batch in batches:
                for bundle in batch.column(0).to_pylist():
                    with files.reader(bundle) as file:
                        for offset, size in seek_table(file):
                            file.seek(offset)
                            rows = []
                            for head, http, payload, _, _ in parse_records(decompress.decompress(file.read(size))):
                                digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                                    raise ValueError(f"{head['WARC-Record-ID']}: the payload differs from its digest")
                                name = head["WARC-Record-ID"][10:-1]
                                refers = head.get("WARC-Refers-To")
                                rows.append((None if name == "none" else int(name), int(http["Content-Length"]), digest, kind, int(refers[10:-1]) if refers else None, head["WARC-Target-URI"], payload if payloads and kind == "response" else None))
                            yield _batch(rows, RECORD)

        names = written(self.index.select("bundle").distinct(), shared_folder(self.index.sparkSession, "bundles"))
        return names.repartition(max(1, names.count())).mapInArrow(task, RECORD)  # names are too small for Spark to tell how much they stand for

    def fetch(self, places: DataFrame) -> DataFrame:
        """The raw records at ``places`` (rows of the index): page_id, record."""
        folder, schema = self.folder, "page_id long, record binary"

        def task(batches):
            import zstandard

            files, decompress, file, now, at = Files(f"{folder}/bundles"), zstandard.ZstdDecompressor(), None, (None, None), []
            for batch in batches:
                rows = []
                for page_id, bundle, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                    if bundle != now[0]:
                        if file is not None:
                            file.close()
                        file = files.reader(bundle)
                        at = seek_table(file)
                    if (bundle, frame) != now:
                        file.seek(at[frame][0])
                        data, now = decompress.decompress(file.read(at[frame][1])), (bundle, frame)
                    rows.append((page_id, data[offset : offset + length]))
                    if sum(len(r) for _, r in rows[-64:]) > FETCH_BYTES or len(rows) >= 1000:
                        yield _batch(rows, schema)
                        rows = []
                yield _batch(rows, schema)
            if file is not None:
                file.close()

        return places.select(*(c.split()[0] for c in INDEX.split(", "))).sortWithinPartitions("bundle", "frame", "offset").mapInArrow(task, schema)


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> Archive:
    """Write a record per row of ``pages`` below ``folder``.

    A null payload is empty; rows with the largest id of their payload are responses even
    if repeated; a payload whose rows all have null ids is stored with each of them; an
    empty table gives an empty archive; other columns are ignored.

    Only digests are grouped.  The join back to the rows may meet one very common digest;
    it is a plain outer join, whose skewed side Spark can split.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.col("payload_bytes") >= least_bytes)
    shared = large.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first_id")).filter((F.col("n") > 1) & F.col("first_id").isNotNull())
    shared = shared.select("digest", "first_id")

    def task(batches):
        writer = BundleWriter(folder, frame_bytes, bundle_bytes)
        for batch in batches:
            for page_id, url, payload, size, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                kind = "revisit" if first is not None and page_id != first else "response"
                writer.add(page_id, record_bytes(page_id, url, payload or b"", size, digest, kind, first))
            if len(writer.rows) >= 10_000:
                yield _batch(writer.rows, INDEX)
                writer.rows = []
        writer.close()
        yield _batch(writer.rows, INDEX)

    known = rows.join(shared, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    index = known.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "digest", "first_id").mapInArrow(task, INDEX)
    written(index, f"{folder}/index")
    return Archive(spark, folder)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write_archive(read_table(spark, sf_dir, "pages"), shared_folder(spark, "op2"))
    return archive.records().select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op2_warc": op2_warc}
ORACLE_SQL = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
s AS (SELECT payload_digest, max(page_id) AS first_id FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN s.first_id IS NOT NULL AND d.page_id IS DISTINCT FROM s.first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN s.first_id IS NOT NULL AND d.page_id IS DISTINCT FROM s.first_id THEN s.first_id END AS refers_to
FROM d LEFT JOIN s USING (payload_digest)
"""
}
