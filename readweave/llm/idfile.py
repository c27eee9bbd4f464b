"""Operator 9: token ids in binary files of compressed bit or byte planes with a chunk index.

A file is: magic; blocks of a fixed number of ids (the last may be shorter), each transposed into planes that are
compressed one by one; the document table (ids and lengths, compressed); the index; the index's offset and the magic.
Planes of zeros take no bytes. The index has, for each block, its number of ids, its offset and the size of each plane,
so any range of ids is read from the blocks that hold it.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readweave.llm import text as T
from readweave.llm.encode import encoder
from readweave.llm.files import open_file
from readweave.llm.tables import new_path, stash, table

MAGIC = b"RWIDPLN1"
BLOCK_IDS = 1 << 16
#: A task begins another file when one has this many ids
FILE_IDS = 1 << 26
#: Bytes of text that are encoded at once
TEXT_BYTES = 500_000


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """32 bit planes (bit 0 of all ids first) or 4 byte planes of unsigned 32-bit ids."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if not bits:
        return [np.ascontiguousarray(p).tobytes() for p in raw]
    out = []
    for plane in raw:
        plane = np.ascontiguousarray(plane)
        out += [np.packbits((plane >> b) & 1).tobytes() if plane.any() else b"\0" * ((len(plane) + 7) // 8) for b in range(8)]
    return out


def from_planes(planes: list[bytes | None], n: int) -> np.ndarray:
    """The reverse of to_planes; None stands for a plane of zeros."""
    raw = np.zeros((4, n), np.uint8)
    if len(planes) == 4:
        for i, p in enumerate(planes):
            if p is not None:
                raw[i] = np.frombuffer(p, np.uint8)
    else:
        for i, p in enumerate(planes):
            if p is not None:
                raw[i // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << np.uint8(i % 8)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


class IdWriter:
    """Append documents to a file; memory is bounded by a block, the longest document and the document table."""

    def __init__(self, out: BinaryIO, *, bits: bool = False, level: int = 1, block: int = BLOCK_IDS) -> None:
        self.out, self.bits, self.block = out, bits, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at = out.write(MAGIC)
        self.blocks: list[list[int]] = []
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0
        self.keys, self.lengths, self.null = array("q"), array("q"), bytearray()

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key or 0)
        self.null.append(key is None)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        cut = len(flat) if last else len(flat) // self.block * self.block
        for s in range(0, cut, self.block):
            part = flat[s : min(s + self.block, cut)]
            row = [len(part), self.at]
            for plane in to_planes(part, self.bits):
                data = self.zip.compress(plane) if plane.strip(b"\0") else b""
                self.at += self.out.write(data)
                row.append(len(data))
            self.blocks.append(row)
        self.waiting, self.held = [flat[cut:]], len(flat) - cut

    def close(self) -> None:
        self._flush(True)
        keys, lengths = (np.array(x, "<i8") for x in (self.keys, self.lengths))
        docs = self.zip.compress(bytes(self.null) + keys.tobytes() + lengths.tobytes())
        docs_at = self.at
        self.at += self.out.write(docs)
        index = self.zip.compress(json.dumps({"blocks": self.blocks, "docs": [docs_at, len(docs), len(keys)], "ids": self.total, "block": self.block}).encode())
        self.out.write(index + struct.pack("<QQ", self.at, len(index)) + MAGIC)


class IdReader:
    """Random access to a file's ids through its index."""

    def __init__(self, file: BinaryIO) -> None:
        self.file = file
        size = file.seek(0, io.SEEK_END)
        file.seek(size - 24)
        at, n = struct.unpack("<QQ", file.read(16))
        if file.read(8) != MAGIC:
            raise ValueError("not an id file, or one that was cut short")
        self.zip = zstandard.ZstdDecompressor()
        self.index = json.loads(self.zip.decompress(self._read(at, n)))
        docs_at, size, n = self.index["docs"]
        raw = self.zip.decompress(self._read(docs_at, size)) if n else b""
        self.null = np.frombuffer(raw, np.uint8, n)
        self.keys, self.lengths = np.frombuffer(raw, "<i8", 2 * n, n).reshape(2, n)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> np.ndarray:
        n, at, *sizes = self.index["blocks"][i]
        raw = self._read(at, sum(sizes))
        planes, s = [], 0
        for size in sizes:
            planes.append(self.zip.decompress(raw[s : s + size]) if size else None)
            s += size
        return from_planes(planes, n)

    def read(self, start: int, length: int) -> np.ndarray:
        """ids start..start+length of the whole file."""
        if length <= 0:
            return np.zeros(0, np.uint32)
        size = self.index["block"]
        first = start // size
        got = np.concatenate([self.block(i) for i in range(first, (start + length - 1) // size + 1)])
        return got[start - first * size : start - first * size + length]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, a block in memory at a time."""
        rest, i = np.zeros(0, np.uint32), 0
        for null, key, n in zip(self.null, self.keys, self.lengths):
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.block(i))
                have += len(parts[-1])
                i += 1
            flat = np.concatenate(parts) if len(parts) > 1 else rest
            yield None if null else int(key), flat[:n]
            rest = flat[n:]


def write_ids(docs: DataFrame, vocabulary: str, path: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, bits: bool = False, block: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode all texts into files under `path`, in ascending doc_id order: the manifest (shard, part, file, docs, ids).

    Documents are range-partitioned by doc_id and a hash of the text, so rows that share a doc_id can be split over
    files; null ids come first. A file ends with the document that brings it to `file_ids`, and the task begins another
    part. Each attempt at a task writes a file of its own, and the manifest names the files of the
    attempts that ended well. It is written to the shared folder, which runs the encoding once.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        out = writer = None
        name, part = "", 0
        enc = encoder(vocabulary)

        def close() -> pa.RecordBatch:
            nonlocal writer, part
            writer.close()
            out.close()
            row = {"shard": [shard], "part": [part], "file": [name], "docs": [len(writer.keys)], "ids": [writer.total]}
            writer, part = None, part + 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, to, some in T.slices(T.docs_of(batch.column(1)), TEXT_BYTES):
                ids, edge = enc.slice(some)
                for i in range(to - at):
                    if writer is None:
                        name = f"{path}/{shard:06d}-{part:06d}-{uuid.uuid4().hex}.ids"
                        out = open_file(name, write=True)
                        writer = IdWriter(out, bits=bits, block=block)
                    writer.add(keys[at + i], np.append(ids[edge[i] : edge[i + 1]], np.uint32(end_id)))
                    if writer.total >= file_ids:
                        yield close()
        if writer is not None:
            yield close()

    return stash(rows.mapInArrow(run, "shard long, part long, file string, docs long, ids long"), "manifest")


def read_ids(manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32; `with_ids` adds the ids.

    The running total takes a row for each file, not for each document.
    """
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before).select("file", "before").repartition(n)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        types = [pa.int64()] * 4 + [pa.binary()] * with_ids

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for name, start in zip(*[c.to_pylist() for c in batch.columns]):
                with open_file(name) as file:
                    rows: list[tuple] = []
                    for key, ids in IdReader(file).documents():
                        raw = ids.astype("<u4").tobytes()
                        rows.append((key, start, len(ids), zlib.crc32(raw), raw)[: len(names)])
                        start += len(ids)
                        if len(rows) == (500 if with_ids else 20_000):
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    return files.mapInArrow(run, schema)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "ids"))
    return read_ids(manifest)
