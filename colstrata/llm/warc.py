"""Seekable Zstandard bundles of WARC records.

A bundle is a run of independent Zstandard frames, each holding whole records,
then a seek table in a skippable frame as in the public seekable format, so any
Zstandard reader can unpack it all and a seeking reader one frame alone. A row of
the result is one bundle with the map from its record ids to frame and offset
inside the frame.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
BUNDLE_SCHEMA = "bundle_id string, data binary, n_frames int, n_records int, raw_bytes bigint, index array<struct<record_id:bigint,frame:int,offset:bigint,length:bigint>>"


def warc_record(record_id: int | None, url: str | None, body: str | None, date: str, place: str = "") -> bytes:
    """One response record with its HTTP block; a null url or body is left empty and marked so. Its name is drawn from all of it and its place."""
    raw = (body or "").encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(raw) + raw
    clean = "".join(c for c in url or "" if c not in "\r\n")
    name = f"{place}|{'' if record_id is None else record_id}|{clean}|{hashlib.sha256(raw).hexdigest()}"
    lines = [
        "WARC/1.1",
        "WARC-Type: response",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {clean}")
    if body is None:
        lines.append("WARC-Truncated: unspecified")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The headers and the body of a record made by warc_record()."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http = rest[: int(headers["Content-Length"])]
    body = http.partition(b"\r\n\r\n")[2].decode("utf-8", "surrogatepass")
    return {"headers": headers, "url": headers.get("WARC-Target-URI"), "body": None if "WARC-Truncated" in headers else body}


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame with compressed and raw size of each frame."""
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """Start, compressed and raw size of each frame, from the last bytes of a bundle."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    out, at = [], 0
    for c, d in struct.iter_unpack("<II", data[-9 - 8 * n : -9]):
        out.append((at, c, d))
        at += c
    return out


def read_frame(data: bytes, frame: int) -> bytes:
    """One frame unpacked, reading nothing else but the seek table."""
    import zstandard

    at, size, raw = read_seek_table(data)[frame]
    return zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=raw)


class _Bundle:
    def __init__(self, level: int):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        self.data, self.sizes, self.index, self.open, self.raw = bytearray(), [], [], bytearray(), 0

    def add(self, record_id: int | None, record: bytes, frame_bytes: int) -> None:
        if self.open and len(self.open) + len(record) > frame_bytes:
            self.close_frame()
        self.index.append({"record_id": record_id, "frame": len(self.sizes), "offset": len(self.open), "length": len(record)})
        self.open += record

    def close_frame(self) -> None:
        if self.open:
            packed = self.pack(bytes(self.open))
            self.sizes.append((len(packed), len(self.open)))
            self.raw += len(self.open)
            self.data += packed
            self.open = bytearray()

    def row(self, name: str) -> dict:
        self.close_frame()
        return {"bundle_id": name, "data": bytes(self.data) + seek_table(self.sizes), "n_frames": len(self.sizes), "n_records": len(self.index), "raw_bytes": self.raw, "index": self.index}


def write_bundles(pages: DataFrame, record_id: str = "page_id", url: str = "url", body: str = "html", frame_bytes: int = 256 << 10, bundle_bytes: int = 16 << 20, level: int = 6, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One row for each bundle: its bytes and the place of each record.

    Records stay in the partition they are read in, so nothing is shuffled; a
    frame holds about frame_bytes of records and a bundle is closed at
    bundle_bytes of them. A bundle's id is a digest of its bytes, so a task that
    runs again writes the same.

    Nulls: a record without id is stored and indexed under null; a null url has
    no target line; a null body is stored empty and marked, and read back as
    null. A record longer than a frame has a frame of its own. Repeated rows are
    stored each, and no two records of a table share a WARC-Record-ID, as its
    name holds the partition and the place in it. All have the one given date. An empty table gives no bundle. Other columns are not stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("bundle_id", pa.string()), ("data", pa.binary()), ("n_frames", pa.int32()), ("n_records", pa.int32()), ("raw_bytes", pa.int64()), ("index", pa.list_(pa.struct([("record_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))]
        )

        def out(b: _Bundle) -> pa.RecordBatch:
            row = b.row("")
            return pa.RecordBatch.from_pylist([row | {"bundle_id": hashlib.sha256(row["data"]).hexdigest()[:24]}], schema)

        b, part, n = _Bundle(level), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, u, h in zip(*(batch.column(k).to_pylist() for k in range(3))):
                b.add(i, warc_record(i, u, h, date, f"{part}/{n}"), frame_bytes)
                n += 1
                if b.raw + len(b.open) >= bundle_bytes:
                    yield out(b)
                    b = _Bundle(level)
        if b.index:
            yield out(b)

    picked = pages.select(F.col(f"`{record_id}`").cast("bigint").alias("i"), F.col(f"`{url}`").cast("string").alias("u"), F.col(f"`{body}`").cast("string").alias("b"))
    return picked.mapInArrow(run, BUNDLE_SCHEMA)


def locate(bundles: DataFrame) -> DataFrame:
    """record_id, bundle_id, frame, offset and length: the index as a table, without the bytes."""
    return bundles.select("bundle_id", F.explode("index").alias("x")).select("x.record_id", "bundle_id", "x.frame", "x.offset", "x.length")


def read_records(bundles: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """record_id, url and body of the records, or of those whose id is in the one column of `ids`.

    Only the frames that hold a wanted record are unpacked.
    """
    if ids is not None:
        wanted = ids.select(F.col(f"`{ids.columns[0]}`").alias("w")).distinct()
        hits = bundles.select("bundle_id", F.posexplode("index").alias("p", "x")).join(wanted, F.col("x.record_id") == F.col("w"), "left_semi").groupBy("bundle_id").agg(F.sort_array(F.collect_list("p")).alias("wanted"))
        bundles = bundles.join(hits, "bundle_id")
    else:
        bundles = bundles.withColumn("wanted", F.transform("index", lambda _, i: i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, index, wanted in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows, frame, raw = [], -1, b""
                for w in wanted:
                    x = index[w]
                    if x["frame"] != frame:
                        frame, raw = x["frame"], read_frame(data, x["frame"])
                    r = parse_record(raw[x["offset"] : x["offset"] + x["length"]])
                    rows.append({"record_id": x["record_id"], "url": r["url"], "body": r["body"]})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("record_id", pa.int64()), ("url", pa.string()), ("body", pa.string())]))

    return bundles.select("data", "index", "wanted").mapInArrow(run, "record_id bigint, url string, body string")


def write_files(bundles: DataFrame, folder: str) -> DataFrame:
    """bundle_id, path and bytes: each bundle as a file of its own in a folder that all executors have mounted.

    A file gets its name when it is whole, so a task that runs again leaves no
    part of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = os.path.join(folder, f"{name}.warc.zst")
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, path)
                rows.append({"bundle_id": name, "path": path, "bytes": len(data)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("bundle_id", pa.string()), ("path", pa.string()), ("bytes", pa.int64())]))

    return bundles.select("bundle_id", "data").mapInArrow(run, "bundle_id string, path string, bytes bigint")


def read_at(path: str, frame: int, offset: int, length: int) -> dict:
    """One record of a bundle's file, by seeking: its table and one frame are read."""
    import zstandard

    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        f.seek(end - 9)
        n = struct.unpack("<I", f.read(4))[0]
        f.seek(end - 9 - 8 * n)
        at, size, raw = read_seek_table(f.read(8 * n + 9))[frame]
        f.seek(at)
        data = zstandard.ZstdDecompressor().decompress(f.read(size), max_output_size=raw)
    return parse_record(data[offset : offset + length])
