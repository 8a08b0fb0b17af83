"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames of about `FRAME_BYTES`. A bundle ends with a seek table in a
skippable frame (compressed and raw size of every frame, frame count, flags, magic number), so that readers
can reach any record by one frame. Each task writes bundles of its own under names that no other attempt
uses; the index of records that Spark commits (bundle, frame, offset in the frame) is the manifest, so files
of lost or repeated attempts are never read.

Of records with equal payloads of at least `MIN_SHARED` bytes the one with the least id is a response, the
others revisit it and hold no payload.

Defined cases: null payload is empty; payloads below `MIN_SHARED` are all responses; repeated rows with the
least id: all rows with that id are responses; a null id is never the response that others refer to; an empty table gives no rows; other columns than id, url and payload are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import read, scratch_path, small_batches, written

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 25
MIN_SHARED = 100
LEVEL = 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame long, frame_at long, frame_bytes long, record_at long, record_bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", packed, raw) for packed, raw in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(content: bytes) -> list[tuple[int, int]]:
    """(compressed, raw) sizes of all frames, from the last bytes of a bundle."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table at the end of the bundle")
    at = len(content) - 9 - 8 * n
    if struct.unpack("<II", content[at - 8 : at]) != (SKIPPABLE, 8 * n + 9):
        raise ValueError("the seek table has a wrong header")
    return [struct.unpack("<II", content[at + 8 * i : at + 8 * i + 8]) for i in range(n)]


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. Names hold the page id; a revisit has no payload."""
    kind, body = ("response", payload) if refers_to is None else ("revisit", b"")
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Target-URI", " ".join(url.split())),
            ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head.append(("WARC-Refers-To", name(refers_to)))
    head.append(("Content-Length", str(len(body))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(start, length, header, payload) of every record in the bytes of a frame."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(head["Content-Length"])
        stop = end + 4 + size
        if raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield at, stop + 4 - at, head, raw[end + 4 : stop]
        at = stop + 4


class _Bundle:
    """One open file: frames go out as they fill; `close` adds the seek table."""

    def __init__(self, folder: str):
        import zstandard

        store, base = fs.FileSystem.from_uri(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        store.create_dir(base, recursive=True)
        self.out = store.open_output_stream(f"{base}/{self.name}", compression=None)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self.frames, self.at, self.raw, self.held, self.index = [], 0, [], 0, []

    def add(self, page_id: int | None, data: bytes) -> None:
        self.index.append([page_id, self.name, len(self.frames), self.at, 0, self.held, len(data)])
        self.raw.append(data)
        self.held += len(data)
        if self.held >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.raw:
            return
        packed = self.zstd.compress(b"".join(self.raw))
        self.out.write(packed)
        for row in self.index[-len(self.raw) :]:
            row[4] = len(packed)
        self.frames.append((len(packed), self.held))
        self.at += len(packed)
        self.raw, self.held = [], 0

    def close(self) -> list[list]:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        return self.index


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null: response).

    Only payloads that occur more than once have a row in the joined table. It is written first, so that the join
    has a plain exchange on both sides and adaptive execution can split a payload that a third of the pages share.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    shared = rows.where(F.length("payload") >= MIN_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = written(shared.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "warc-shared")
    refers = F.when(F.col("page_id").isNull() | (F.col("first") != F.col("page_id")), F.col("first"))
    return rows.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write bundles into `folder` (a URI that all executors reach); returns the committed index of records."""

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        to_batch = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if n == "bundle" else pa.int64()) for n, c in zip(names, zip(*rows))], names)
        bundle = None
        for b in frames:
            for page_id, url, payload, digest, refers in zip(*(b.column(i).to_pylist() for i in range(5))):
                bundle = bundle or _Bundle(folder)
                bundle.add(page_id, record(page_id, url, payload, digest, refers))
                if bundle.at >= BUNDLE_BYTES:
                    yield to_batch(bundle.close())
                    bundle = None
        if bundle:
            yield to_batch(bundle.close())

    return written(with_roles(pages).mapInArrow(write, INDEX), "warc-index")


def read_archives(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """All records of the bundles that the index names, read from the files by their seek tables."""

    def split(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zstd = zstandard.ZstdDecompressor()
        for b in frames:
            for content in b.column(0):
                content, at = content.as_py(), 0
                for packed, raw in read_seek_table(content):
                    rows = []
                    for _, _, head, body in parse(zstd.decompress(content[at : at + packed], max_output_size=raw)):
                        ident = lambda x: None if x in (None, "<urn:page:none>") else int(x[10:-1])
                        kind = head["WARC-Type"]
                        size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and (len(body), hashlib.sha256(body).hexdigest()) != (size, digest):
                            raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
                        rows.append((ident(head["WARC-Record-ID"]), head["WARC-Target-URI"], size, digest, kind, ident(head.get("WARC-Refers-To")), body))
                    at += packed
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                    names = [x.split()[0] for x in RECORDS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    named = files.withColumn("bundle", F.element_at(F.split("path", "/"), -1)).join(index.select("bundle").distinct(), "bundle", "left_semi")
    return named.select("content").mapInArrow(split, RECORDS)


def fetch(spark: SparkSession, folder: str, index: DataFrame, ids: list[int]) -> dict[int, bytes]:
    """Payloads of a few records by their frames alone: one ranged read and one frame each."""
    import zstandard

    store, base = fs.FileSystem.from_uri(folder)
    out = {}
    for r in index.where(F.col("page_id").isin(ids)).collect():
        with store.open_input_file(f"{base}/{r.bundle}") as f:
            f.seek(r.frame_at)
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(f.read(r.frame_bytes))
        out[r.page_id] = next(parse(raw[r.record_at : r.record_at + r.record_bytes]))[3]
    return out


def archive_folder(spark: SparkSession) -> str:
    folder = scratch_path(spark, "llm-warc-files")
    return folder if ":/" in folder else f"file://{folder}"


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    folder = archive_folder(spark)
    index = write_archives(read(spark, sf_dir, "pages", "page_id", "url", "html"), folder)
    if index.isEmpty():
        return spark.createDataFrame([], RECORDS).drop("url", "payload")
    return read_archives(spark, folder, index).drop("url", "payload")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
