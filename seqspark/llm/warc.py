"""WARC archives as seekable Zstandard bundles.

Pages become WARC records; records are grouped into independent Zstandard frames, frames into
bundles.  Each bundle ends with a footer seek table (a skippable frame that lists each frame's
compressed and plain size), so a reader can start at any frame, and comes with a map from record
identifiers to (frame, offset inside the frame's plain bytes, length).  Spark writes the bundles as
binary rows below the cluster's shared folder, so its commit protocol covers lost executors and any
store will do; ``export_bundles`` writes them as plain ``.warc.zst`` files.

Of records with equal payloads of at least ``min_payload`` bytes, the one with the smallest page_id
is a response, the others are revisits of it; smaller ones are all responses.  A record's identifier
follows from its row (page_id, payload digest, hash of the url, number among equal rows), so a revisit
names a record that the map lists.

Defined results: a null html is the empty payload; rows that repeat the smallest page_id with the
same payload are responses too (revisits name the one with the smallest hash of its url); a null page_id
is never the smallest unless all are null, and then all are responses; page_ids may be numbers or text;
urls may be null or of any length; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from seqspark.llm.components import stored

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20
#: Digests of repeated payloads, and repeated page_ids, up to this number are broadcast (under 100 MB); more are joined by digest or page_id.
BROADCAST_ROWS = 1_000_000
# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

BUNDLE_SCHEMA = "bundle string, content binary, records array<struct<record_id: string, frame: int, offset: int, length: int>>"
RECORD_SCHEMA = "record_id string, page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, bundle string, frame int, offset int"


def _record_id(page_id: str | None, digest: str, url_key: str, tie: int) -> str:
    return f"<urn:page:{'-' if page_id is None else '=' + quote(page_id, safe='')}:{digest}:{url_key}:{tie}>"


def _page_of(record_id: str) -> str | None:
    page = record_id.strip("<>").split(":")[2]
    return unquote(page[1:]) if page[0] == "=" else None


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; a revisit has no body, but the full payload's digest and length."""
    kind, body = ("response", payload) if refers_to is None else ("revisit", b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"]),
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        *([] if refers_to is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]),
        "Content-Type: text/html",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, body and end of the record at ``at``."""
    size = 4096
    while (stop := bytes(data[at : at + size]).find(b"\r\n\r\n")) < 0:
        if at + size >= len(data):
            raise ValueError("a record's header has no end")
        size *= 4
    head = dict(line.split(": ", 1) for line in bytes(data[at : at + stop]).decode().split("\r\n")[1:])
    begin = at + stop + 4
    end = begin + int(head["Content-Length"])
    return head, bytes(data[begin:end]), end + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer: one entry for each frame, then the number of frames, a descriptor and the magic number."""
    body = b"".join(struct.pack("<II", c, p) for c, p in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frame_offsets(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, read from the end of a bundle."""
    n, _, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    entries = [struct.unpack_from("<II", content, len(content) - 9 - 8 * (n - i)) for i in range(n)]
    out, at = [], 0
    for c, p in entries:
        out.append((at, c, p))
        at += c
    return out


def read_frame(content: bytes, frame: int) -> bytes:
    """The plain bytes of one frame; no other frame is touched."""
    at, size, plain = frame_offsets(content)[frame]
    return zstandard.ZstdDecompressor().decompress(content[at : at + size], max_output_size=max(plain, 1))


def _bundles(frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        packer = zstandard.ZstdCompressor(level=3)
        made = 0
        content, sizes, places, plain = bytearray(), [], [], bytearray()

        def end_frame() -> None:
            nonlocal plain
            if plain:
                packed = packer.compress(bytes(plain))
                sizes.append((len(packed), len(plain)))
                content.extend(packed)
                plain = bytearray()

        def end_bundle() -> pa.RecordBatch:
            nonlocal content, sizes, places, made
            end_frame()
            out = pa.RecordBatch.from_pylist([{"bundle": f"bundle-{part:06d}-{made:06d}.warc.zst", "content": bytes(content) + seek_table(sizes), "records": places}], schema=_ARROW)
            content, sizes, places = bytearray(), [], []
            made += 1
            return out

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "url_key", "tie", "revisit", "first_id", "first_key")]
            for html, page_id, url, url_key, tie, revisit, first_id, first_key in zip(batch.column("html"), *columns, strict=True):
                payload = html.as_buffer().to_pybytes()
                digest = payload_digest(payload)
                me = _record_id(page_id, digest, url_key, tie)
                data = record_bytes(me, url, payload, _record_id(first_id, digest, first_key, 0) if revisit else None)
                places.append({"record_id": me, "frame": len(sizes), "offset": len(plain), "length": len(data)})
                plain += data
                if len(plain) >= frame_bytes:
                    end_frame()
                if len(content) >= bundle_bytes:
                    yield end_bundle()
        if places:
            yield end_bundle()

    return run


_ARROW = pa.schema([("bundle", pa.string()), ("content", pa.binary()), ("records", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])))])


def write_bundles(pages: DataFrame, min_payload: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Bundles of ``pages(page_id, url, html)``, written to the shared folder: bundle, content, records."""
    url_key = F.lower(F.hex(F.xxhash64("url")))
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1("html")).withColumn("url_key", url_key)
    # equal rows are numbered: rows of a repeated page_id become one for each page_id, url and payload, and as many again
    repeated = _sized(stored(pages.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("page_id").alias("again")), "repeated-ids"))
    same = pages["page_id"].eqNullSafe(repeated["again"])
    lone = pages.join(repeated, same, "left_anti").withColumn("tie", F.lit(0).cast("long"))
    several = pages.join(repeated, same, "left_semi").groupBy("page_id", "url", "digest", "url_key").agg(F.min("html").alias("html"), F.count("*").alias("n"))
    several = several.select("page_id", "url", "html", "digest", "url_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("tie"))
    rows = lone.unionByName(several)

    held = F.octet_length("html") >= min_payload
    least = F.min(F.struct(F.col("page_id").isNull(), "page_id", "url_key"))
    first = pages.where(held).groupBy("digest").agg(least.alias("first"), F.count("*").alias("n")).where("n > 1")
    first = _sized(stored(first.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url_key").alias("first_key")), "repeated-payloads"))
    rows = rows.withColumn("digest", F.when(held, F.col("digest"))).join(first, "digest", "left")
    text = lambda c: F.col(c).cast("string").alias(c)
    revisit = F.col("first_key").isNotNull() & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.select(text("page_id"), "url", F.col("html").cast("binary").alias("html"), "url_key", "tie", revisit.alias("revisit"), text("first_id"), "first_key")
    return stored(rows.mapInArrow(_bundles(frame_bytes, bundle_bytes), BUNDLE_SCHEMA), "warc")


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int32())])
    for batch in batches:
        for name, content in zip(batch.column("bundle").to_pylist(), batch.column("content"), strict=True):
            content = content.as_buffer().to_pybytes()
            unpack = zstandard.ZstdDecompressor()
            for n, (at, size, plain) in enumerate(frame_offsets(content)):
                data = memoryview(unpack.decompress(content[at : at + size], max_output_size=max(plain, 1)))
                place, rows = 0, []
                while place < len(data):
                    head, body, end = parse_record(data, place)
                    refers = head.get("WARC-Refers-To")
                    kind = head["WARC-Type"]
                    digest = payload_digest(body) if kind == "response" else head["WARC-Payload-Digest"].removeprefix("sha1:")
                    rows.append((head["WARC-Record-ID"], _page_of(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, refers and _page_of(refers), len(body) if kind == "response" else int(head["X-Payload-Length"]), digest, body, name, n, place))
                    place = end
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_bundles(bundles: DataFrame, page_type: str = "long") -> DataFrame:
    """Every record of the bundles, frame by frame; responses' digests are computed from what was read.  ``page_type`` is the type of the page_ids that were written."""
    rows = bundles.select("bundle", "content").mapInArrow(_records, RECORD_SCHEMA)
    return rows.withColumns({c: F.col(c).cast(page_type) for c in ("page_id", "refers_to")})


def record_index(bundles: DataFrame) -> DataFrame:
    """(record_id, bundle, frame, offset, length): where each record stands."""
    return bundles.selectExpr("bundle", "inline(records)").select("record_id", "bundle", "frame", "offset", "length")


def export_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as a file of its own into a folder that all executors share; returns (bundle, bytes)."""

    def run(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, content in zip(batch.column("bundle").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with open(f"{folder}/{name}.part", "wb") as out:
                    out.write(content)
                os.replace(f"{folder}/{name}.part", f"{folder}/{name}")
                yield pa.RecordBatch.from_pylist([{"bundle": name, "bytes": len(content)}])

    return bundles.select("bundle", "content").mapInArrow(run, "bundle string, bytes long")
