"""WARC archives as seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each holding some whole WARC
records, then two skippable frames: the record index (record identifier -> frame,
offset in the frame, length) and, last, the seek table of the public seekable format
(compressed and uncompressed size of each frame, then the frame count and a magic
number). Any Zstandard tool reads the bundle as one stream; a reader of one record
reads the tail, then one frame.

Defined cases: a null payload is an empty one; a null or empty url gives no target
header; characters that would break a header are percent-encoded; of records with
equal payloads all with the smallest id are responses; records without an id revisit
that one, and are responses where no record of the payload has an id; an empty table
gives an empty index. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import open_fs, scratch, shuffle_width, tune

# Fixed values of the public seekable format and of the WARC 1.1 standard.
SKIPPABLE, INDEX_FRAME, SEEK_MAGIC = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A frame is closed once it holds so many bytes or records.
FRAME_BYTES, FRAME_RECORDS = 1 << 20, 512
#: A bundle is closed once its frames take so many bytes.
BUNDLE_BYTES = 256 << 20


def record_id(key: int | None, salt: str = "") -> str:
    return f"urn:x-record:{'none' if key is None else key}{salt}"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def record(key: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record. A revisit keeps the response's HTTP head, whose length is that of the full payload, and no body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(key)}>", f"WARC-Date: {date}"]
    if url:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{sha}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record that starts at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode("ascii").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start, size = stop + 4, int(head["Content-Length"])
    return head, data[start : start + size], start + size + 4


class BundleWriter:
    """Holds one frame and the bundle's tables."""

    def __init__(self, sink, level: int = 3, frame_bytes: int = FRAME_BYTES, frame_records: int = FRAME_RECORDS):
        import zstandard

        self.sink, self.frame_bytes, self.frame_records = sink, frame_bytes, frame_records
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.held: list[bytes] = []
        self.n_held = self.size = 0

    def add(self, rid: str, data: bytes) -> tuple[int, int]:
        if self.held and (self.n_held + len(data) > self.frame_bytes or len(self.held) >= self.frame_records):
            self._flush()
        place = (len(self.frames), self.n_held)
        self.index.append((rid, *place, len(data)))
        self.held.append(data)
        self.n_held += len(data)
        return place

    def _flush(self) -> None:
        frame = self.zstd.compress(b"".join(self.held))
        self.sink.write(frame)
        self.frames.append((len(frame), self.n_held))
        self.size += len(frame)
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        index = self.zstd.compress(json.dumps(self.index).encode())
        self.sink.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        frames = [*self.frames, (len(index) + 8, 0)]
        table = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class BundleReader:
    """Random access by frame or by record identifier."""

    def __init__(self, source):
        self.source, self.size = source, source.size()
        n, _, magic = struct.unpack("<IBI", source.read_at(9, self.size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table: not a seekable bundle, or it was cut short")
        table = source.read_at(8 * n, self.size - 9 - 8 * n)
        self.frames, at = [], 0
        for k in range(n):
            packed, full = struct.unpack_from("<II", table, 8 * k)
            self.frames.append((at, packed, full))
            at += packed
        self.index_at, packed, _ = self.frames.pop()
        self._index = None
        self.index_size = packed

    def frame(self, k: int) -> bytes:
        import zstandard

        at, packed, full = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.source.read_at(packed, at), max_output_size=full)

    @property
    def index(self) -> dict[str, tuple[int, int, int]]:
        import zstandard

        if self._index is None:
            raw = self.source.read_at(self.index_size - 8, self.index_at + 8)
            self._index = {r: (f, o, n) for r, f, o, n in json.loads(zstandard.ZstdDecompressor().decompress(raw))}
        return self._index

    def record(self, rid: str) -> tuple[dict[str, str], bytes]:
        k, offset, _ = self.index[rid]
        head, block, _ = parse(self.frame(k), offset)
        return head, block


def with_roles(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """(k, url, payload, refers_to): refers_to is the response's key for revisits, else null.

    The smallest key per payload is found by a grouped minimum, which is combined before the
    shuffle; the join back has one row per payload on its other side, so a payload that holds
    a third of all pages is split like any skewed join partition.
    """
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("sha", F.sha1("payload"))
    least = rows.groupBy("sha", "size").agg(F.min("k").alias("first"))
    joined = rows.join(least, ["sha", "size"])
    revisit = F.col("first").isNotNull() & (F.col("size") >= min_revisit_bytes) & ~F.col("k").eqNullSafe(F.col("first"))
    return joined.select("k", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"))


INDEX_SCHEMA = "bundle string, record_id string, frame int, offset long, length long"


def write_bundles(roles: DataFrame, out_dir: str, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of :func:`with_roles` as bundles below ``out_dir``; returns the committed index.

    Each attempt of a task writes files with new names; the index names those that count.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_fs(out_dir)
        writer = sink = name = None

        def finish():
            writer.close()
            sink.close()
            return pd.DataFrame([(name, *x) for x in writer.index], columns=["bundle", "record_id", "frame", "offset", "length"])

        for batch in batches:
            for k, url, payload, ref in zip(batch["k"].tolist(), batch["url"].tolist(), batch["payload"].tolist(), batch["refers_to"].tolist(), strict=True):
                if writer is None:
                    fs.create_dir(root)
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                    writer = BundleWriter(sink)
                k, ref = (int(k) if k else None), (int(ref) if ref else None)
                payload = bytes(payload)
                writer.add(record_id(k), record(k, url, payload, digest(payload), ref, ref is not None, date))
                if writer.size > BUNDLE_BYTES:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    text = roles.select(F.coalesce(F.col("k").cast("string"), F.lit("")).alias("k"), F.coalesce("url", F.lit("")).alias("url"), "payload", F.coalesce(F.col("refers_to").cast("string"), F.lit("")).alias("refers_to"))
    made = text.mapInPandas(write, INDEX_SCHEMA)
    made.write.parquet(f"{out_dir}/index")
    return roles.sparkSession.read.schema(made.schema).parquet(f"{out_dir}/index")


#: Bytes of records that a reading task takes on average.
READ_BYTES = 64 << 20
READ_SCHEMA = "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, url string, payload binary"


def read_bundles(spark: SparkSession, out_dir: str, with_payload: bool = True) -> DataFrame:
    """Every record of the committed bundles; tasks are dealt whole frames and read only those.

    The digest of a response is taken from its payload and held against the header's.
    """
    frames = spark.read.schema(INDEX_SCHEMA).parquet(f"{out_dir}/index").groupBy("bundle", "frame").agg(F.sum("length").alias("size"))
    # A row per frame is few bytes for many megabytes to read, so the tasks are counted by what they will read; neighbouring frames stay together.
    size, n = frames.agg(F.sum("size"), F.count("*")).first()
    tasks = max(1, -(-(size or 0) // READ_BYTES), min(n, shuffle_width(spark)))
    frames = frames.select("bundle", "frame").repartitionByRange(tasks, "bundle", "frame")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_fs(out_dir)
        for batch in batches:
            for name, rows in batch.groupby("bundle"):
                with fs.open_input_file(f"{root}/{name}") as source:
                    bundle = BundleReader(source)
                    for k in sorted(rows["frame"]):
                        data, at, out = bundle.frame(k), 0, []
                        while at < len(data):
                            head, block, at = parse(data, at)
                            http, _, payload = block.partition(b"\r\n\r\n")
                            said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                            revisit = head["WARC-Type"] == "revisit"
                            if not revisit and digest(payload) != said:
                                raise ValueError(f"{name}: the payload of {head['WARC-Record-ID']} was changed")
                            size = int(http.rsplit(b"Content-Length: ", 1)[1])
                            out.append((head["WARC-Record-ID"][1:-1], head["WARC-Type"], size, said, head.get("WARC-Refers-To", "<>")[1:-1] or None, head.get("WARC-Target-URI"), payload if with_payload else None))
                        yield pd.DataFrame(out, columns=["record_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "payload"])

    return frames.mapInPandas(read, READ_SCHEMA)


def archive_and_read(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, with_payload: bool = True) -> DataFrame:
    """Write ``pages`` and read the archives back."""
    spark = pages.sparkSession
    tune(spark)
    out = scratch(spark, "warc")
    write_bundles(with_roles(pages, key, url, html, min_revisit_bytes), out)
    return read_bundles(spark, out, with_payload)


def key_of(column):
    """The integer key of a record identifier; null where it has none."""
    part = F.substring_index(column, ":", -1)
    return F.when(part != "none", part.cast("long"))
