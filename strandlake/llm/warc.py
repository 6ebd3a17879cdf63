"""WARC records in seekable Zstandard bundles (operator 2).

Records are grouped into independent Zstandard frames; a bundle ends with the
seek table of the public seekable format (a skippable frame), and an index maps
record identifiers to (bundle, frame, offset in the frame).  Each task writes
bundles of its own, under names no other attempt uses; only bundles that the
index of finished tasks names are ever read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import fresh_path, map_pandas, written

#: Fixed values of the seekable format: skippable frame, end of the seek table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame int, offset long, length long"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the length and the digest of the payload it leaves out."""
    name = lambda x: f"<urn:page:{'none' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:  # control characters would end the line
        head.append("WARC-Target-URI: " + "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block, and the end of the record that begins at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    start, size = end + 4, int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or data[start + size : start + size + 4] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, data[start : start + size], start + size + 4


class BundleWriter:
    def __init__(self, folder: str):
        import zstandard

        self.fs, base = _fs(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.out = self.fs.open_output_stream(f"{base}/{self.name}", compression=None)
        self.zip = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.frame, self.size = bytearray(), 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset in it."""
        if self.frame and len(self.frame) + len(data) > FRAME_BYTES:
            self.flush()
        at = len(self.frame)
        self.frame += data
        return len(self.frames), at

    def flush(self) -> None:
        packed = self.zip.compress(bytes(self.frame))
        self.out.write(packed)
        self.frames.append((len(packed), len(self.frame)))
        self.size += len(packed)
        self.frame = bytearray()

    def close(self) -> None:
        if self.frame:
            self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Bundle:
    """Random access to a bundle by its seek table."""

    def __init__(self, folder: str, name: str):
        import zstandard

        fs, base = _fs(folder)
        self.file = fs.open_input_file(f"{base}/{name}")
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table in {name}")
        self.sizes = list(struct.iter_unpack("<II", self.file.read_at(8 * n, size - 9 - 8 * n)))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.zip = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        packed, size = self.sizes[k]
        return self.zip.decompress(self.file.read_at(packed, self.starts[k]), max_output_size=size)


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of pages whose payload, of ``min_bytes`` at least, a page with a larger id has too.

    Only digests move; a payload that many pages share is one row after the
    partial aggregation, and the join back is one that Spark may split.
    """
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.sha1(text.cast("binary")).alias("sha"), F.octet_length(text).alias("n")).where(F.col("n") >= min_bytes)
    last = rows.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    return rows.join(last, "sha").where("page_id < refers_to").select("page_id", "sha", "refers_to").distinct()


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes a record for every page and returns the written index, one row a record.

    Null html is an empty payload and a null url is left out of the record.
    Rows that repeat the id of a response are responses too; a page without an
    id is always a response.  Other columns are not looked at.
    """
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", text.alias("html"), F.sha1(text.cast("binary")).alias("sha"))
    rows = rows.join(revisits(pages, min_bytes), ["page_id", "sha"], "left").drop("sha")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer: BundleWriter | None = None
        none = lambda x: None if pd.isna(x) else int(x)
        for pdf in batches:
            found = []
            for page_id, url, html, refers in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], strict=True):
                if writer is None:
                    writer = BundleWriter(folder)
                data = record(none(page_id), None if url is None or url != url else url, html.encode(), none(refers))
                found.append((none(page_id), writer.name, *writer.add(data), len(data)))
                if writer.size >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
            out = pd.DataFrame(found, columns=["page_id", "bundle", "frame", "offset", "length"])
            yield out.astype({"page_id": "Int64"})
        if writer:
            writer.close()

    return written(map_pandas(rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to")), run, INDEX), "warc-index")


def read_archive(index: DataFrame, folder: str) -> DataFrame:
    """All records of the indexed bundles, read frame by frame: a row each, with the payload of responses."""
    bundles = index.select("bundle").distinct()
    n = max(1, bundles.count())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["bundle"]:
                bundle = Bundle(folder, name)
                for k in range(len(bundle.sizes)):
                    data, at, found = bundle.frame(k), 0, []
                    while at < len(data):
                        fields, block, at = parse(data, at)
                        found.append(fields_of(fields, block))
                    yield pd.DataFrame(found, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    # By range, not by hash: a task for each bundle, and none that Spark drops as dealt out already.
    return map_pandas(bundles.repartitionByRange(n, "bundle"), run, schema)


def fields_of(fields: dict[str, str], block: bytes) -> tuple:
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(next(line.split(b": ")[1] for line in http.split(b"\r\n") if line.startswith(b"Content-Length")))
    number = lambda x: None if x is None or x == "<urn:page:none>" else int(x[len("<urn:page:") : -1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, kind, number(fields.get("WARC-Refers-To")), payload if kind == "response" else None


def fetch(spark: SparkSession, index: DataFrame, folder: str, page_ids: list[int]) -> DataFrame:
    """The records of some pages, by decompressing just the frames that hold them."""
    wanted = index.where(F.col("page_id").isin(page_ids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, part in pdf.groupby("bundle"):
                bundle = Bundle(folder, name)
                yield pd.DataFrame({"page_id": part["page_id"], "record": [bundle.frame(f)[o : o + n] for f, o, n in zip(part["frame"], part["offset"], part["length"], strict=True)]})

    return map_pandas(wanted, run, "page_id long, record binary")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archive to the shared folder, then reads every record back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archive(write_archive(pages, folder, min_bytes), folder)
