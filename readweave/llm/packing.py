"""Operator 10: pack token ids into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from readweave.llm import text as T
from readweave.llm.encode import encoder
from readweave.llm.tables import table

#: Bytes of text that are encoded at once
TEXT_BYTES = 500_000
#: Windows' worth of a long document that wait to fill other windows
KEPT = 2
Piece = tuple[int, int, int]  # document (number in the block), start, length


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp largest differencing method over `windows` subsets: item numbers of each subset.

    The two partial partitions with the largest spread are merged, the heaviest subset of one with the lightest of the
    other, until one partition is left. A partial partition lists its non-empty subsets from heavy to light; the subsets
    not listed are empty.
    """
    if windows <= 0:
        return []
    heap: list[tuple[int, int, list[tuple[int, list]]]] = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap)[2]
        b = heapq.heappop(heap)[2]
        both = len(a) + len(b) - windows
        if both <= 0:
            merged = a + b
        else:
            keep_a, keep_b = len(a) - both, len(b) - both
            merged = a[:keep_a] + b[:keep_b]
            merged += [(x + y, [p, q]) for (x, p), (y, q) in zip(a[keep_a:], reversed(b[keep_b:]))]
        merged.sort(key=lambda s: -s[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, n, merged))
        n += 1

    def items(tree: list) -> list[int]:
        flat, todo = [], [tree]
        while todo:
            x = todo.pop()
            for y in x:
                (todo if isinstance(y, list) else flat).append(y)
        return flat

    out = [items(tree) for _, tree in heap[0][2]] if heap else []
    return out + [[] for _ in range(windows - len(out))]


def level(windows: list[list[Piece]], capacity: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows, and the pieces of the one that isn't: cuts of the lightest windows fill the others."""
    windows = sorted(windows, key=lambda w: -sum(p[2] for p in w))
    full = sum(p[2] for w in windows for p in w) // capacity
    pool: list[Piece] = [p for w in windows[full:] for p in w]
    for w in windows[:full]:
        over = sum(p[2] for p in w) - capacity
        while over > 0:
            d, s, n = w.pop()
            if n > over:
                w.append((d, s, n - over))
                pool.append((d, s + n - over, over))
                over = 0
            else:
                pool.append((d, s, n))
                over -= n
    for w in windows[:full]:
        room = capacity - sum(p[2] for p in w)
        while room > 0:
            d, s, n = pool.pop()
            if n > room:
                w.append((d, s, room))
                pool.append((d, s + room, n - room))
                room = 0
            else:
                w.append((d, s, n))
                room -= n
    return windows[:full], pool


def partition(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Near-equal windows of whole pieces (each at most `capacity` long), none over the capacity.

    The window count starts at what the pieces need at least (by their tokens, and as a window has room for no more than
    j of those over 1/(j+1) of the capacity) and rises while a window of the differencing exceeds the capacity.
    """
    sizes = [p[2] for p in pieces]
    count = max(-(-sum(sizes) // capacity), *(-(-sum((j + 1) * n > capacity for n in sizes) // j) for j in range(1, 9)))
    parts = differencing(sizes, count)
    while any(sum(sizes[i] for i in part) > capacity for part in parts):
        count += 1
        parts = differencing(sizes, count)
    return [[pieces[i] for i in part] for part in parts]


def full_windows(piece: Piece, capacity: int, keep: int = 0) -> tuple[list[list[Piece]], Piece]:
    """Windows cut from the beginning of a long piece while `keep` windows' worth is left, and what is left of it."""
    d, s, n = piece
    cut = max((n - keep * capacity) // capacity, 0) * capacity
    return [[(d, at, capacity)] for at in range(s, s + cut, capacity)], (d, s + cut, n - cut)


def fill(pieces: list[Piece], long: list[Piece], capacity: int) -> tuple[list[list[Piece]], list[Piece], list[Piece]]:
    """Full windows, the pieces left over (less than a window's worth), and what is left of the long documents.

    The windows are those of `partition`, and the room that it leaves is filled with cuts of `long`, pieces of documents that
    have to be cut anyway; a worse partition would leave more room, and need more windows and cuts. Once they run out,
    `level` closes the windows that have room.
    """
    windows = sorted(partition(pieces, capacity), key=lambda w: -sum(p[2] for p in w))
    supply = list(long)
    for w in windows:
        room = capacity - sum(p[2] for p in w)
        while room and supply:
            d, s, n = supply.pop()
            take = min(room, n)
            w.append((d, s + n - take, take))
            if n > take:
                supply.append((d, s, n - take))
            room -= take
        if room:
            break
    closed = [w for w in windows if sum(p[2] for p in w) == capacity]
    more, pool = level([w for w in windows if sum(p[2] for p in w) < capacity], capacity)
    return closed + more, pool, supply


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """Windows whose lengths are the powers of two in the pieces' total: none needs padding."""
    total = sum(p[2] for p in pieces)
    out, rest = [], list(reversed(pieces))
    for bit in range(total.bit_length() - 1, -1, -1):
        room = total & (1 << bit)
        window: list[Piece] = []
        while room:
            d, s, n = rest.pop()
            if n > room:
                rest.append((d, s + room, n - room))
                n = room
            window.append((d, s, n))
            room -= n
        if window:
            out.append(window)
    return out


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 1, block_tokens: int = 500_000, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in windows of at most `capacity` ids.

    A document's ids are those of its text (null: empty) and `end_id`. A document of up to `capacity` ids stays whole:
    those of a block of about `block_tokens` ids are dealt by `differencing` to near-equal windows, as few as keep each
    within its capacity. Longer documents are cut: into full windows, and into what fills the room that the others leave.
    Where a block has no long documents left, and at the end of a partition, shorter ones are cut too: the last pieces make
    windows whose lengths are powers of two, so no window needs padding. Windows never span partitions: the plan is one
    scan without a shuffle, and a lost task is repeated on its own. Rows with a null or repeated doc_id are packed like
    others; an empty table gives no rows.
    `with_ids` adds each piece's ids as little-endian unsigned 32-bit integers.
    """
    kind = dict(docs.dtypes)[doc_id]
    columns = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    schema = f"doc_id {kind}, {SCHEMA}" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = (TaskContext.get().partitionId() << 33) if TaskContext.get() else 0
        block: dict[int, tuple[object, np.ndarray]] = {}  # documents that still have rests
        short: list[Piece] = []  # whole documents, and pieces that closing windows left over
        long: list[Piece] = []  # what is left of documents over the capacity, a bounded part of each
        held = number = 0

        def rows(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence
            out: list[list] = [[] for _ in range(8)]
            for window in windows:
                at = 0
                for d, s, n in window:
                    key, ids = block[d]
                    raw = ids[s : s + n].tobytes()
                    for c, v in zip(out, (key, s, n, zlib.crc32(raw), len(ids), sequence, at, raw)):
                        c.append(v)
                    at += n
                sequence += 1
            types = [key_type, *[pa.int64()] * 6, pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            most = 8 if with_ids else 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:most], types)], names=names[:most])

        enc = encoder(vocabulary)
        key_type = pa.int64()
        for batch in batches:
            key_type = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            for at, to, part in T.slices(T.docs_of(batch.column(1)), TEXT_BYTES):
                ids, edge = enc.slice(part)
                whole: list[list[Piece]] = []
                for i in range(to - at):
                    own = np.append(ids[edge[i] : edge[i + 1]], np.uint32(end_id)).astype("<u4")
                    block[number] = keys[at + i], own
                    if len(own) <= capacity:
                        short.append((number, 0, len(own)))
                        held += len(own)
                    else:
                        cut, rest = full_windows((number, 0, len(own)), capacity, KEPT)
                        whole += cut
                        long.append(rest)
                    number += 1
                # of long documents, a share of the block waits to fill windows
                while long and sum(p[2] for p in long) > held // 8 + KEPT * capacity:
                    cut, rest = full_windows(long.pop(0), capacity)
                    whole += cut
                    if rest[2]:
                        short.append(rest)
                        held += rest[2]
                if whole:
                    yield rows(whole)
                if held >= block_tokens:
                    windows, short, long = fill(short, long, capacity)
                    yield rows(windows)
                    held = sum(p[2] for p in short)
                block = {d: block[d] for d, _, _ in short + long}
        if short or long:
            windows, short, long = fill(short, long, capacity)
            for piece in long:
                cut, rest = full_windows(piece, capacity)
                windows += cut
                short += [rest] if rest[2] else []
            last, short, _ = fill(short, [], capacity)
            yield rows(windows + last + powers_of_two(short))

    return columns.mapInArrow(run, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
