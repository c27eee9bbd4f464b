"""Documents in chunks of bounded size, as rows that carry a compressed Arrow batch; keys dealt from chunks to buckets.

A chunk asks about its distinct keys (hashes of words, n-grams, anchors), each key's bucket answers for the whole corpus,
and the answers return to the chunk in the order of its request. So what is shuffled are packed arrays of distinct keys,
not a row for each word, and a key that a third of the corpus holds costs its bucket one entry a chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from readweave.llm import text as T
from readweave.llm.files import open_file
from readweave.llm.tables import new_path, stash

CHUNK_BYTES = 8_000_000


def pack_rows(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_rows(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def chunked(docs: DataFrame, text: str = "text", most: int = CHUNK_BYTES) -> DataFrame:
    """The table (chunk, file, at, size) of chunks: about `most` bytes of text each, one document at least.

    Each task writes its chunks to a file of its own in the shared folder, and the table names the files of the attempts
    that ended well. It is written once, so a chunk's number and its documents' order hold for all later plans, lost
    executors or not. Later steps read a chunk by its place (`load`); texts are not shuffled.
    """
    place = docs.columns.index(text)
    path = new_path(docs.sparkSession, "chunk-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        name = f"{path}/{uuid.uuid4().hex}.chunks"
        held: list[pa.RecordBatch] = []
        made: list[tuple[int, str, int, int]] = []
        size = at_byte = 0
        out = None

        def put() -> None:
            nonlocal out, at_byte
            out = out or open_file(name, write=True)
            raw = pack_rows(pa.Table.from_batches(held))
            out.write(raw)
            made.append((number + len(made), name, at_byte, len(raw)))
            at_byte += len(raw)

        for batch in batches:
            offsets = T.docs_of(batch.column(place)).offsets
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(offsets, offsets[at] + most - size, "right")) - 1
                to = min(max(to, at if held else at + 1), batch.num_rows)
                if to > at:
                    held.append(batch.slice(at, to - at))
                    size += int(offsets[to] - offsets[at])
                at = to
                if at < batch.num_rows:
                    put()
                    held, size = [], 0
        if held:
            put()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=["chunk", "file", "at", "size"])

    # a task's rows say where a chunk is; dealing them out again spreads the chunks of a large file
    return stash(docs.mapInArrow(run, "chunk long, file string, at long, size long"), "chunks")


def spread(chunks: DataFrame) -> DataFrame:
    """The chunk table with a task's share of rows in each partition."""
    return chunks.repartition(share(chunks))


def share(chunks: DataFrame) -> int:
    """Partitions of steps that go chunk by chunk: two for each chunk, so few tasks have several. A chunk's row is a pointer,
    so its size doesn't tell the work, and adaptive plans would put all chunks into one task."""
    return max(1, 2 * chunks.count())


def load(file: str, at: int, size: int) -> pa.Table:
    with open_file(file) as f:
        f.seek(at)
        return unpack_rows(f.read(size))


def load_row(own: pa.Table) -> pa.Table:
    return load(own["file"][0].as_py(), own["at"][0].as_py(), own["size"][0].as_py())


def words_and_hashes(docs: T.Docs, fold: np.ndarray, which: tuple[int, ...] = (0,), outside: np.ndarray = T.SPACE) -> tuple[list[np.ndarray], np.ndarray]:
    """Word hashes (one array for each function) of a chunk and each document's range of them, slice by slice."""
    parts: list[list[np.ndarray]] = [[] for _ in which]
    counts = [np.zeros(1, np.int64)]
    for _, _, part in T.slices(docs):
        words = T.words_of(part, outside)
        for out, w in zip(parts, which):
            out.append(T.hashes(part, words, fold, w))
        counts.append(np.diff(words.first))
    return [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts], np.cumsum(np.concatenate(counts))


def bucket_cuts(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that deals sorted distinct keys to buckets (keys stay sorted within one), and the buckets' bounds."""
    bucket = (T.mix(keys ^ np.uint64(0x51ED270B7A2F1C3D)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))
