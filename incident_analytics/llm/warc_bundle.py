"""Web archive records in seekable Zstandard bundles.

Every page is one archive record.  A page whose payload (the html in UTF-8)
equals that of a page with a smaller id, and has at least 100 bytes, is written
as a revisit record without a body; all others are response records.

A bundle is a row of independent zstandard frames of a few records each, then a
frame that maps record ids to (frame, offset in the unpacked frame, length), and
last a seek table in a skippable frame (magic 0x184D2A5E, per frame its packed
and unpacked size, then frame count, a descriptor byte and 0x8F92EAB1), so any
zstandard tool unpacks a bundle and a reader fetches one record by unpacking one
frame.

Defined cases: a null html is an empty payload; payloads of under 100 bytes are
never revisits; rows with the same page id and payload are written one by one
and judged alike (the smallest id's rows are responses); a row with a null page
id is a response and no page revisits it; null urls become ``about:blank``; an
empty table writes no bundle; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from incident_analytics.llm.files import create, new_name, open_random
from incident_analytics.session import materialize, scratch_path

LEAST_BYTES = 100
FRAME_BYTES = 1 << 19
LEVEL = 6
SLICE = 64
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
EPOCH = "1970-01-01T00:00:00Z"
MANIFEST = StructType([StructField("path", StringType()), StructField("n_records", LongType()),
                       StructField("n_frames", LongType()), StructField("n_bytes", LongType())])
RECORDS = StructType([
    StructField("page_id", LongType()), StructField("record_type", StringType()),
    StructField("refers_to", LongType()), StructField("payload_bytes", LongType()),
    StructField("payload_digest", StringType()), StructField("path", StringType()),
    StructField("frame", IntegerType()), StructField("offset", LongType()),
    StructField("length", LongType())])


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def archive_record(page_id: int | None, url: str | None, html: str | None, revisits: bool,
                   refers_to: int | None) -> bytes:
    """One WARC/1.1 record with its header lines, body and closing blank lines."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    target = " ".join((url or "about:blank").split()) or "about:blank"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}",
            f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {EPOCH}",
            f"WARC-Target-URI: {target}",
            f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if revisits:
        head += [f"WARC-Refers-To: {record_name(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        body += payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (the body after the HTTP head) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    fields = dict(line.split(": ", 1) for line in lines)
    body = rest[:int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


class BundleWriter:
    """Groups records into frames; holds one frame and the record map."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES) -> None:
        self.out, self.frame_bytes = out, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.open = io.BytesIO()
        self.frames: list[tuple[int, int]] = []
        self.map: list[tuple[int, int, int, int, int]] = []
        self.n_bytes = 0

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.open.tell() and self.open.tell() + len(record) > self.frame_bytes:
            self._flush()
        self.map.append((page_id or 0, page_id is not None, len(self.frames), self.open.tell(),
                         len(record)))
        self.open.write(record)

    def _frame(self, data: bytes) -> None:
        packed = self.pack.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data)))
        self.n_bytes += len(packed)

    def _flush(self) -> None:
        self._frame(self.open.getvalue())
        self.open = io.BytesIO()

    def close(self) -> None:
        if self.open.tell():
            self._flush()
        self._frame(np.array(self.map, "<i8").tobytes())
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.n_bytes += 8 + len(table)


class BundleReader:
    """Finds records through the seek table and the record map; unpacks a frame at a time."""

    def __init__(self, source) -> None:
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the file")
        source.seek(size - 9 - 8 * count)
        sizes = np.frombuffer(source.read(8 * count), "<u4").reshape(-1, 2).astype(np.int64)
        self.packed, self.at = sizes[:, 0], np.cumsum(sizes[:, 0]) - sizes[:, 0]
        self.n_frames = count - 1
        self.map = np.frombuffer(self.frame(count - 1), "<i8").reshape(-1, 5)

    def frame(self, k: int) -> bytes:
        self.source.seek(int(self.at[k]))
        return self.unpack.decompress(self.source.read(int(self.packed[k])))

    def record(self, page_id: int) -> bytes | None:
        """The first record of a page: one look into the map, one frame unpacked."""
        found = np.flatnonzero((self.map[:, 0] == page_id) & (self.map[:, 1] == 1))
        if not len(found):
            return None
        _, _, k, offset, length = self.map[found[0]].tolist()
        return self.frame(k)[offset:offset + length]

    def records(self) -> Iterator[tuple[int | None, int, int, bytes]]:
        """(page id, frame, offset, record) in file order, one frame in memory at a time."""
        now, data = -1, b""
        for page_id, known, k, offset, length in self.map.tolist():
            if k != now:
                now, data = k, self.frame(k)
            yield page_id if known else None, k, offset, data[offset:offset + length]


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page id, digest) of every page to be written as a revisit, with the page it refers to."""
    payload = F.coalesce(html_col, F.lit("")).cast("binary")
    digests = pages.where(F.col(id_col).isNotNull() & (F.octet_length(html_col) >= LEAST_BYTES)) \
        .select(F.col(id_col).alias("page_id"), F.sha2(payload, 256).alias("digest"))
    shared = (digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"),
                                            F.max("page_id").alias("last"))
              .where("refers_to <> last").drop("last"))
    return digests.join(shared, "digest").where("page_id <> refers_to").distinct()


def write_bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write the records of ``pages`` in ascending id order per bundle; returns the committed manifest."""
    folder = scratch_path(pages.sparkSession, "warc-bundles")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"))
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    judged = (rows.withColumn("digest", digest)
              .join(revisits(rows), ["page_id", "digest"], "left")
              .select("page_id", "url", "html", F.col("refers_to").isNotNull().alias("revisits"),
                      "refers_to").sortWithinPartitions("page_id"))
    arrow = to_arrow_schema(MANIFEST)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        path = new_name(folder, ".warc.zst")
        with create(path) as out:
            writer = BundleWriter(out, frame_bytes)
            batch = first
            while batch is not None:
                for start in range(0, batch.num_rows, SLICE):
                    for row in zip(*(c.to_pylist() for c in batch.slice(start, SLICE).columns)):
                        writer.add(row[0], archive_record(*row))
                batch = next(batches, None)
            writer.close()
        yield pa.RecordBatch.from_pylist([{
            "path": path, "n_records": len(writer.map), "n_frames": len(writer.frames) - 1,
            "n_bytes": writer.n_bytes}], schema=arrow)

    return materialize(judged.mapInArrow(written, MANIFEST), "warc-manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """A row per record of the bundles, as read from the files; a revisit has no payload of its own."""
    arrow = to_arrow_schema(RECORDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_random(path) as source:
                    found = []
                    for page_id, frame, offset, raw in BundleReader(source).records():
                        fields, payload = parse_record(raw)
                        own = fields["WARC-Type"] == "response"
                        found.append({
                            "page_id": page_of(fields["WARC-Record-ID"]),
                            "record_type": fields["WARC-Type"], "path": path, "frame": frame,
                            "refers_to": None if own else page_of(fields["WARC-Refers-To"]),
                            "payload_bytes": len(payload) if own else None,
                            "payload_digest": hashlib.sha256(payload).hexdigest() if own
                            else fields["WARC-Payload-Digest"].removeprefix("sha256:"),
                            "offset": offset, "length": len(raw)})
                        if len(found) == 4096:
                            yield pa.RecordBatch.from_pylist(found, schema=arrow)
                            found = []
                    yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(read, RECORDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Fill the payload size of revisits from the response record they refer to.

    Response sizes are joined by (page id, digest) after a map-side combine; a
    much-revisited page is one row on that side.
    """
    sizes = (records.where("record_type = 'response' AND page_id IS NOT NULL")
             .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
             .agg(F.max("payload_bytes").alias("full_bytes")))
    own = records.where("record_type = 'response'")
    again = (records.where("record_type = 'revisit'").join(sizes, ["refers_to", "payload_digest"])
             .withColumn("payload_bytes", F.col("full_bytes")).drop("full_bytes"))
    return own.unionByName(again)


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= {LEAST_BYTES} GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {LEAST_BYTES} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST_BYTES} AND page_id > first THEN first END AS refers_to
FROM d LEFT JOIN f USING (digest)
"""
