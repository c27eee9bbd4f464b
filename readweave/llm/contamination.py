"""Operator 1: benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from readweave.llm import text as T
from readweave.llm.chunks import chunked, load
from readweave.llm.tables import bound_batches, table

#: Bins of a one-permutation MinHash sketch: the leading bits of a hash name its bin
BINS = 512
#: Bytes of items whose index a task holds at a time
BLOCK_BYTES = 8_000_000
#: Bytes of documents that wait for the next block's index, where there are several blocks
HELD_BYTES = 32_000_000
_FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_GAPS = "".join(map(chr, [32, *range(9, 14)]))


def shingle_set(text: str, k: int) -> set[tuple[bytes, ...]]:
    """The distinct k-word shingles of a text; a shorter text has its whole sequence as one, one without words none."""
    w = text.translate(_FOLD).encode("utf-8", "surrogatepass").split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def size_class(n: np.ndarray) -> np.ndarray:
    """The smallest power of two not below n: items of one class have a set size between half of it and itself."""
    return np.left_shift(1, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


@dataclass
class Index:
    """Items by size class: the sketch values of each, and the exact shingle sets for the check."""

    ids: list
    sets: list[set[tuple[bytes, ...]]]
    values: dict[int, tuple[np.ndarray, np.ndarray]]  # class: sorted values, their items
    short: dict[tuple[bytes, ...], list[int]]  # items under k words, by their whole sequence
    k: int


def bins_minima(sorted_rows: np.ndarray) -> np.ndarray:
    """Mask of the smallest hash of each bin in rows of ascending hashes."""
    bins = sorted_rows >> np.uint64(64 - BINS.bit_length() + 1)
    first = np.ones(sorted_rows.shape, bool)
    first[:, 1:] = bins[:, 1:] != bins[:, :-1]
    return first


def build(ids: list, texts: list[str], k: int) -> Index:
    docs = T.docs_of(pa.array(texts, pa.large_string()))
    g, first = T.distinct(*T.shingle_hashes(docs, k))
    sets = [shingle_set(t, k) for t in texts]
    classes = size_class(np.diff(first))
    values: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    short: dict[tuple[bytes, ...], list[int]] = {}
    for i, s in enumerate(sets):
        own = g[first[i] : first[i + 1]]
        if not len(own):
            continue
        if len(s) == 1 and len(only := next(iter(s))) < k:
            short.setdefault(only, []).append(i)
            continue
        low = own[bins_minima(own[None])[0]]
        values.setdefault(int(classes[i]), []).append((low, np.full(len(low), i)))
    out = {}
    for c, parts in values.items():
        v, item = (np.concatenate(x) for x in zip(*parts))
        by = np.argsort(v, kind="stable")
        out[c] = v[by], item[by]
    return Index(ids, sets, out, short, k)


def candidates(index: Index, docs: T.Docs) -> np.ndarray:
    """Rows (document, item) of blocks that share a bin's minimum with an item.

    For the items of a size class c, a document's shingles are cut into overlapping blocks of 2c, c apart, so a passage
    of an item's length lies within one block, whose set is at most some four times the item's: the document's own length
    doesn't thin out the similarity. One-permutation sketches are compared bin by bin (bands of one value).
    """
    g, first = T.shingle_hashes(docs, index.k)
    n = np.diff(first)
    out = []
    for c, (values, items) in index.values.items():
        # one shingle is compared by itself, so each place is a block
        width = 2 * c if c > 1 else 1
        blocks = np.where(n > 0, np.maximum(-(-(n - c) // c), 1), 0) if c > 1 else n
        doc = np.repeat(np.arange(len(n)), blocks)
        step = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = first[doc] + step * c
        stop = np.minimum(start + width, first[doc + 1])
        small = np.zeros(1 << 18, bool)
        small[(values & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        most = max(1, 1_000_000 // width)
        for a in range(0, len(doc), most):
            s, e = start[a : a + most], stop[a : a + most]
            at = s[:, None] + np.arange(width)
            rows = np.sort(np.where(at < e[:, None], g[np.minimum(at, len(g) - 1)], np.uint64(2**64 - 1)), axis=1)
            low = bins_minima(rows) & small[(rows & np.uint64((1 << 18) - 1)).astype(np.int64)]
            r, col = np.nonzero(low)
            v = rows[r, col]
            left, right = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
            hits = right - left
            some = np.flatnonzero(hits)
            if len(some):
                d = np.repeat(doc[a + r[some]], hits[some])
                place = np.repeat(left[some] - np.cumsum(hits[some]) + hits[some], hits[some]) + np.arange(int(hits[some].sum()))
                out.append(np.unique(np.stack([d, items[place]], axis=1), axis=0))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def confirm(index: Index, docs: T.Docs, percent: int) -> list[tuple[int, int, int, int]]:
    """(document, item, shingles of the item, shared): exact containment of 100 * shared >= percent * shingles."""
    out = []
    pairs = candidates(index, docs)
    for d in np.unique(pairs[:, 0]):
        own = shingle_set(docs.text(int(d)), index.k)
        for i in pairs[pairs[:, 0] == d, 1].tolist():
            shared = len(index.sets[i] & own)
            if 100 * shared >= percent * len(index.sets[i]):
                out.append((int(d), i, len(index.sets[i]), shared))
    if index.short:
        for d in range(len(docs)):
            own = shingle_set(docs.text(d), index.k)
            for only in own & index.short.keys():
                out += [(d, i, 1, 1) for i in index.short[only]]
    return out


Place = tuple[str, int, int]  # file, offset and size of a block of items


def item_blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> list[Place]:
    """The distinct items in blocks of about `most` bytes (one item at least), as files in the shared folder. To the driver
    come their places: one for each `most` bytes of the benchmark."""
    rows = benchmark.select(benchmark[item_id].alias("i"), benchmark[text].alias("t")).where(F.col("t").isNotNull()).distinct()
    return [(r["file"], r["at"], r["size"]) for r in chunked(rows, "t", most).orderBy("chunk").collect()]


def load_index(place: Place, k: int) -> Index:
    rows = load(*place)
    return build(rows["i"].to_pylist(), rows["t"].to_pylist(), k)


def scan(blocks: list[Place], batches: Iterator[pa.RecordBatch], column: int, k: int, percent: int) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Each batch with its hits (row, item id, shingles of the item, shared). A task reads the documents once; several
    blocks take turns over documents that wait in memory up to a bound, with one block's index at a time."""
    only = load_index(blocks[0], k) if len(blocks) == 1 else None

    def search(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        found: list[list[tuple]] = [[] for _ in held]
        for place in blocks:
            index = only or load_index(place, k)
            for batch, out in zip(held, found):
                for at, _, part in T.slices(T.docs_of(batch.column(column))):
                    out += [(at + d, index.ids[i], n, shared) for d, i, n, shared in confirm(index, part, percent)]
        yield from zip(held, found)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if only or sum(b.nbytes for b in held) >= HELD_BYTES:
            yield from search(held)
            held = []
    if held:
        yield from search(held)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, percent: int = 80, shingle: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs (doc_id, item_id, item_shingles, shared_shingles, containment): documents that hold an item's shingles to
    `percent` % at least.

    One scan of the documents without a shuffle; tasks read the items from the shared folder, in blocks of bounded size. A
    document that holds an item to that part shares no minimum with a probability under 0.0001, for the smallest sets, and
    far less for others. Null or empty texts hold nothing and are held by nothing; an item under `shingle` words is one
    shingle, its whole sequence, which only an equal text has. Repeated documents give repeated pairs; null ids are kept.
    """
    kinds = dict(docs.dtypes)[doc_id], dict(benchmark.dtypes)[item_id]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, item_shingles long, shared_shingles long, containment double"
    bound_batches(docs.sparkSession)
    blocks = item_blocks(benchmark, item_id, item_text, block_bytes)
    kind = to_arrow_type(benchmark.schema[item_id].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, got in scan(blocks, batches, 1, shingle, percent) if blocks else ():
            if got:
                row, item, n, shared = zip(*got)
                n, shared = pa.array(n, pa.int64()), pa.array(shared, pa.int64())
                share = pc.divide(pc.cast(shared, pa.float64()), pc.cast(n, pa.float64()))
                yield pa.RecordBatch.from_arrays([pc.take(batch.column(0), pa.array(row)), pa.array(item, kind), n, shared, share], names=["doc_id", "item_id", "item_shingles", "shared_shingles", "containment"])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, percent: int = 80, shingle: int = 5, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of documents that hold no item, with all their columns (see `contaminated`)."""
    place = docs.columns.index(text)
    bound_batches(docs.sparkSession)
    blocks = item_blocks(benchmark, item_id, item_text, block_bytes)
    if not blocks:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, got in scan(blocks, batches, place, shingle, percent):
            keep = np.ones(batch.num_rows, bool)
            keep[[row for row, *_ in got]] = False
            yield pc.filter(batch, pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SHINGLES = "unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] end)"
ORACLE_SQL = f"""
with d as (select distinct doc_id, {_SHINGLES} as s from (select doc_id, {_WORDS} as w from documents)),
b as (select distinct item_id, {_SHINGLES} as s from (select item_id, {_WORDS} as w from benchmark)),
n as (select item_id, count(*) as item_shingles from b group by 1),
c as (select doc_id, item_id, count(*) as shared_shingles from d join b using (s) group by all)
select doc_id, item_id, item_shingles, shared_shingles, shared_shingles::double / item_shingles as containment from c join n using (item_id) where 100 * shared_shingles >= 80 * item_shingles
"""
