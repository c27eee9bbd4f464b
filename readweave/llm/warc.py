"""Operator 8: WARC files compressed with a Zstandard dictionary that each file carries in a leading skippable frame.

A file (.warc.zst) is a skippable frame with the dictionary, itself compressed, and one Zstandard frame for each record,
so any record is read on its own given its offset and the dictionary.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readweave.llm.files import open_file
from readweave.llm.tables import new_path, stash, table

#: Magic number of the dictionary's skippable frame in .warc.zst files
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
DICTIONARY_BYTES = 64 * 1024
#: Bounds of the dictionary's sample: records, and characters of their pages in all
SAMPLE_RECORDS = 400
SAMPLE_CHARS = 8_000_000
#: A task begins another file when one has this many bytes
FILE_BYTES = 1 << 30


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None, row: int = 0) -> str:
    """A record's own id: `row` tells rows apart that share a page_id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{row}')}>"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None = None, row: int = 0, first_row: int = 0) -> bytes:
    """One WARC/1.1 record. Response and revisit blocks are HTTP messages; a revisit has the header alone, and names the
    record of `first_row`."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    target = "".join(c for c in (url or "about:blank") if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_uri(page_id, row)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Bytes: {len(payload)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers_to, first_row)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; checks its lengths."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:n]


def dictionary_frame(dictionary: bytes) -> bytes:
    """The skippable frame that opens a file."""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary) if dictionary else b""
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from whole records, as they are archived; too few or too small ones give none."""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b""


def frames(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of a file, a frame in memory at a time."""
    head = file.read(8)
    if len(head) < 8:
        return
    magic, n = struct.unpack("<II", head)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    packed = file.read(n)
    extra = {"dict_data": zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed))} if packed else {}
    unzip = zstandard.ZstdDecompressor(**extra).decompressobj(read_across_frames=False)
    parts: list[bytes] = []
    data, inside = b"", False
    while True:
        if not data:
            data = file.read(1 << 20)
            if not data:
                break
        parts.append(unzip.decompress(data))
        inside = not unzip.eof
        if unzip.eof:
            data = unzip.unused_data
            yield parse(b"".join(parts))
            parts = []
            unzip = zstandard.ZstdDecompressor(**extra).decompressobj(read_across_frames=False)
        else:
            data = b""
    if inside:
        raise ValueError("a file that was cut short")


def sample_records(pages: DataFrame, page_id: str, url: str, html: str, *, records: int = SAMPLE_RECORDS, chars: int = SAMPLE_CHARS) -> list[bytes]:
    """Whole response records of up to `records` pages, of `chars` characters in all: those with the smallest hashes of
    their ids, passing over pages that don't fit any more. Of rows that share an id, one at most."""
    some = pages.where(F.col(page_id).isNotNull()).select(F.xxhash64(page_id).alias("h"), F.col(page_id).alias("p"), F.char_length(html).alias("n"))
    ids, left = [], chars
    for r in some.groupBy("h", "p").agg(F.max("n").alias("n")).orderBy("h", "p").limit(records).collect():
        if r["n"] and r["n"] <= left:
            ids.append(r["p"])
            left -= r["n"]
    rows = pages.where(F.col(page_id).isin(ids)).groupBy(F.col(page_id).alias("p")).agg(F.min(F.struct(F.col(html).alias("t"), F.col(url).cast("string").alias("u"))).alias("x")).select("p", "x.*").collect()
    out = []
    for p, t, u in sorted(map(tuple, rows), key=lambda x: x[0]):
        payload = (t or "").encode("utf-8", "surrogatepass")
        out.append(record("response", p, u, payload, digest(payload)))
    return out


def write_warcs(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, level: int = 3, dictionary: bytes | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each page to files under `path`: the manifest (file, records, bytes).

    Each task of the scan compresses its pages as response records, once, and these frames, not the pages, are dealt to
    the files. Of pages with equal payloads (by SHA-1 and length) of at least `least` bytes, the one with the smallest
    page_id stays a response, and the others become revisits of it; smaller payloads all stay responses. Null html is an
    empty payload. A null page_id comes after all others; among rows that share the smallest page_id, one is the response.
    Ids are cast to long. A file ends with the record that brings it to `file_bytes`. The dictionary, unless given, comes
    from whole records of a bounded sample (`sample_records`).
    """
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if dictionary is None:
        dictionary = build_dictionary(sample_records(pages, page_id, url, html))
    rows = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), pages[html].alias("html"))

    def compressor(level: int) -> zstandard.ZstdCompressor:
        extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        return zstandard.ZstdCompressor(level=level, write_content_size=True, **extra)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        squeezer = compressor(level)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                out: list[list] = [[] for _ in range(6)]
                for p, u, h in zip(*(c.to_pylist() for c in batch.slice(a, 256).columns)):
                    payload = (h or "").encode("utf-8", "surrogatepass")
                    sha1 = digest(payload)
                    for c, v in zip(out, (number, p, u, len(payload), sha1, squeezer.compress(record("response", p, u, payload, sha1, row=number)))):
                        c.append(v)
                    number += 1
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["row", "page_id", "url", "size", "sha1", "frame"])

    squeezed = stash(rows.mapInArrow(squeeze, "row long, page_id long, url string, size long, sha1 string, frame binary"), "frames")
    keys = squeezed.select("row", "page_id", "sha1", "size")
    first = keys.where(F.col("size") >= least).groupBy("sha1", "size").agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull(), "page_id", "row")).alias("x")).where("n > 1").select("sha1", "size", F.col("x.page_id").alias("refers_to"), F.col("x.row").alias("first_row"))
    again = keys.join(first, ["sha1", "size"]).where(F.col("row") != F.col("first_row")).select("row", "refers_to", "first_row")
    # equal payloads' frames can differ in their headers only; a revisit drops its frame before the join
    plain = squeezed.join(again, "row", "left").select("row", "page_id", "url", "size", "sha1", F.when(F.col("first_row").isNull(), F.col("frame")).alias("frame"), "refers_to", "first_row")
    dealt = plain.repartition(n, "row").sortWithinPartitions("row")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        squeezer = compressor(level)
        task, name, out = TaskContext.get().partitionId(), "", None
        count = size = 0
        for batch in batches:
            for row, p, u, length, sha1, frame, refers_to, first_row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{path}/{task:06d}-{uuid.uuid4().hex}.warc.zst"
                    out = open_file(name, write=True)
                    opening = dictionary_frame(dictionary)
                    out.write(opening)
                    count, size = 0, len(opening)
                if frame is None:
                    raw = record("revisit", p, u, b"", sha1, refers_to, row, first_row).replace(b"X-Payload-Bytes: 0", b"X-Payload-Bytes: %d" % length, 1)
                    frame = squeezer.compress(raw)
                out.write(frame)
                count, size = count + 1, size + len(frame)
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"file": [name], "records": [count], "bytes": [size]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [count], "bytes": [size]})

    return stash(dealt.mapInArrow(write, "file string, records long, bytes long"), "warcs")


def read_warcs(manifest: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """Records of the files: page_id, payload_bytes, payload_digest, record_type, refers_to. The payload of a response is
    checked against its digest; `with_payload` adds url and the block's payload (null for revisits)."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", url string, payload binary" if with_payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * with_payload
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string(), pa.binary()] * with_payload
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with open_file(name) as file:
                    for headers, block in frames(file):
                        kind, sha1 = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if payload is not None and (digest(payload) != sha1 or len(payload) != int(headers["X-Payload-Bytes"])):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        number = lambda k: int(headers[k]) if headers.get(k) not in (None, "", "None") else None
                        rows.append((number("X-Page-ID"), int(headers["X-Payload-Bytes"]), sha1, kind, number("X-Refers-To-Page-ID"), headers["WARC-Target-URI"], payload)[: len(names)])
                        if len(rows) == (200 if with_payload else 10_000):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return manifest.select("file").repartition(n).mapInArrow(run, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warcs(write_warcs(table(spark, sf_dir, "pages"), new_path(spark, "warc")))


ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
d as (select page_id, strlen(html) as n, html, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(bits[5*i+1:5*i+5], lambda a, b: 2 * a + b)::bigint, 1) for i in range(32)], '') as digest
  from (select *, flatten([[(v >> 3) & 1, (v >> 2) & 1, (v >> 1) & 1, v & 1] for v in [(instr('0123456789abcdef', c) - 1) for c in string_split(hex, '')]]) as bits from p)),
f as (select *, min(page_id) over (partition by html) as lo from d)
select page_id, n::bigint as payload_bytes, digest as payload_digest, case when page_id = lo then 'response' else 'revisit' end as record_type, case when page_id <> lo then lo end as refers_to from f
"""
