"""Seekable Zstandard bundles of WARC records.

Records are grouped into frames of about FRAME bytes, each an independent Zstandard frame; frames into bundles of about
BUNDLE bytes. A bundle ends with a skippable frame that holds the seek table of the public seekable format: compressed
and decompressed size and checksum of each frame, their number, a descriptor, a magic number. The index maps each
record to its frame and the offset within that frame once decompressed, so one record needs one frame.

Bundles are made where the rows lie, without a shuffle, and written nowhere else; a lost task is made again alike.

Defined results. A record never spans frames; a record longer than a frame has one of its own. Null or repeated ids are
recorded as they are, one index entry a row; each row's record has a WARC-Record-ID of its own. A null url or html is
kept apart from an empty one by a header. WARC-Date is of the column that `date` names (a timestamp or text), and where
that is null or not given the time `when`, by default that of the call. Ids of whole numbers come as bigint, all others
as strings. Other columns are ignored. An empty table gives no bundles.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_type

FRAME, BUNDLE, LEVEL = 256 << 10, 16 << 20, 3
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1


def schema(kind: str) -> str:
    index = f"array<struct<page_id: {kind}, frame: int, frame_start: bigint, record_offset: bigint, length: bigint>>"
    return f"bundle string, payload binary, n_frames int, n_records bigint, raw_bytes bigint, records {index}"


def record(page_id: int | str | None, url: str | None, html: str | None, date: str, place: str) -> bytes:
    """place: what tells this row from all others of the run."""
    body = (html or "").encode()
    digest = hashlib.sha1(body)
    own = uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([place, page_id, url, digest.hexdigest()]))
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{own}>", f"WARC-Date: {date}", f"WARC-Block-Digest: sha1:{base64.b32encode(digest.digest()).decode()}", "Content-Type: text/html"]
    if page_id is not None:
        head.append(f"X-Page-ID-JSON: {json.dumps(page_id)}")
    if url is not None:
        plain = url.isprintable() and url.strip() == url
        head.append(f"WARC-Target-URI: {url}" if plain else f"X-Target-URI-JSON: {json.dumps(url)}")
    if html is None:
        head.append("X-Null-Block: true")
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | str | None, str | None, str | None]:
    head, _, rest = data.partition(b"\r\n\r\n")
    field = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    url = json.loads(field["X-Target-URI-JSON"]) if "X-Target-URI-JSON" in field else field.get("WARC-Target-URI")
    return json.loads(field.get("X-Page-ID-JSON", "null")), url, None if "X-Null-Block" in field else rest[: int(field["Content-Length"])].decode()


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """frames: compressed size, decompressed size and checksum of each."""
    body = b"".join(struct.pack("<III", *f) for f in frames) + struct.pack("<IBI", len(frames), 0x80, FOOTER)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(payload: bytes) -> list[tuple[int, int, int, int]]:
    """Start, compressed size, decompressed size and checksum of each frame, from the footer alone."""
    n, _, magic = struct.unpack("<IBI", payload[-9:])
    if magic != FOOTER:
        raise ValueError("no seek table")
    out, at = [], 0
    for size, raw, check in struct.iter_unpack("<III", payload[-9 - 12 * n : -9]):
        out.append((at, size, raw, check))
        at += size
    return out


def bundles(pages: DataFrame, frame: int = FRAME, bundle: int = BUNDLE, level: int = LEVEL, date: str | None = None, when: str | None = None) -> DataFrame:
    """One row a bundle: its bytes and the index of its records."""
    when = when or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    kind = "bigint" if key_type(pages, "page_id") == "bigint" else "string"
    entry = pa.struct([("page_id", pa.int64() if kind == "bigint" else pa.string()), ("frame", pa.int32()), ("frame_start", pa.int64()), ("record_offset", pa.int64()), ("length", pa.int64())])
    arrow = pa.schema([("bundle", pa.string()), ("payload", pa.binary()), ("n_frames", pa.int32()), ("n_records", pa.int64()), ("raw_bytes", pa.int64()), ("records", pa.list_(entry))])

    def pack(batches):
        import xxhash
        import zstandard

        comp = zstandard.ZstdCompressor(level=level, write_content_size=True)
        part, made = TaskContext.get().partitionId(), 0
        buf, raw, frames, blobs, records, size = [], 0, [], [], [], 0

        def close_frame():
            nonlocal buf, raw, size
            if buf:
                data = b"".join(buf)
                blobs.append(comp.compress(data))
                frames.append((len(blobs[-1]), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
                size += len(blobs[-1])
                buf, raw = [], 0

        def close_bundle():
            nonlocal frames, blobs, records, size, made
            close_frame()
            row = {"bundle": f"{part:06d}-{made:06d}", "payload": b"".join(blobs) + seek_table(frames), "n_frames": len(frames), "n_records": len(records), "raw_bytes": sum(f[1] for f in frames), "records": records}
            frames, blobs, records, size, made = [], [], [], 0, made + 1
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for b in batches:
            for i, url, html, at in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "date"))):
                data = record(i, url, html, at, f"{part}/{made}/{len(records)}")
                if raw and raw + len(data) > frame:
                    close_frame()
                if size >= bundle:
                    yield close_bundle()
                records.append({"page_id": i, "frame": len(frames), "frame_start": size, "record_offset": raw, "length": len(data)})
                buf.append(data)
                raw += len(data)
        if records:
            yield close_bundle()

    text = F.lit(when)
    if date:
        zone = pages.sparkSession.conf.get("spark.sql.session.timeZone")
        stamp = F.date_format(F.to_utc_timestamp(F.col(date), zone), "yyyy-MM-dd'T'HH:mm:ss'Z'") if pages.select(date).dtypes[0][1].startswith("timestamp") else F.col(date).cast("string")
        text = F.coalesce(stamp, text)
    return pages.select(F.col("page_id").cast(kind).alias("page_id"), "url", "html", text.alias("date")).mapInArrow(pack, schema(kind))


def index(made: DataFrame) -> DataFrame:
    """One row a record: page_id, bundle, frame, its start, the record's offset in the frame and length."""
    return made.select("bundle", F.inline("records"))


def fetch(made: DataFrame, page_ids: list[int | str]) -> DataFrame:
    """The records of the given ids, each read by decompressing its frame alone."""
    kind = made.select(F.inline("records")).dtypes[0][1]

    def read(batches):
        import zstandard

        d = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for payload, records in zip(b.column("payload"), b.column("records").to_pylist()):
                payload, frames = payload.as_buffer().to_pybytes(), {}
                table = read_seek_table(payload)
                for r in records:
                    f = r["frame"]
                    if f not in frames:
                        at, size, raw, _ = table[f]
                        frames = {f: d.decompress(payload[at : at + size], max_output_size=raw)}
                    rows.append(parse(frames[f][r["record_offset"] : r["record_offset"] + r["length"]]))
            ids, urls, htmls = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64() if kind == "bigint" else pa.string()), pa.array(urls, pa.string()), pa.array(htmls, pa.string())], ["page_id", "url", "html"])

    hit = F.filter("records", lambda r: r["page_id"].isin(*set(page_ids)))
    return made.select("payload", hit.alias("records")).filter(F.size("records") > 0).mapInArrow(read, f"page_id {kind}, url string, html string")
