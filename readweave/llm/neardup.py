"""Operator 7: near-duplicate groups by banded MinHash and odd sketches, confirmed on full shingle sets."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readweave.llm import text as T
from readweave.llm.chunks import load, pack_rows
from readweave.llm.files import open_file
from readweave.llm.graph import components
from readweave.llm.tables import new_path, stash, table, unstash

SKETCH_BITS = 512
BAND_ROWS = 5
MISS = 1e-6
BLOCK = 96
NULL_ID = 2**63 - 1
_rng = np.random.default_rng(71)
_MULTIPLIERS = _rng.integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _rng.integers(1, 2**63, 512, dtype=np.uint64)


def bands_for(similarity: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Bands of `rows` samples, so that a pair at the threshold shares none with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps (documents x bits/64 words) of MinHash samples (functions x documents): each sample flips one bit."""
    k, n = samples.shape
    place = (T.mix(samples ^ _SALTS[:k, None]) >> np.uint64(32)).astype(np.int64) % bits
    flat = np.bincount((place + np.arange(n) * bits).ravel(), minlength=n * bits) & 1
    return np.packbits(flat.astype(np.uint8).reshape(n, bits), axis=1).view(np.uint64)


def odd_distance(similarity: float, samples: int, bits: int = SKETCH_BITS, deviations: float = 5.0) -> int:
    """The largest XOR population count at which a pair at the threshold is still expected, with a margin.

    Two sets of samples that differ in a share 1-s of `samples` differ in 2*samples*(1-s) elements, which set
    bits*(1-(1-2/bits)**elements)/2 bits. The share is taken `deviations` standard deviations above the mean.
    """
    share = 1 - similarity + deviations * math.sqrt(similarity * (1 - similarity) / samples)
    odd = bits * (1 - (1 - 2 / bits) ** (2 * samples * min(share, 1))) / 2
    return math.ceil(odd + deviations * math.sqrt(odd * (1 - odd / bits)) / 2)


def minhash(g: np.ndarray, first: np.ndarray, functions: int) -> np.ndarray:
    """functions x documents; documents without shingles get the largest value."""
    out = np.full((functions, len(first) - 1), np.iinfo(np.uint64).max, np.uint64)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        at = first[some]
        buffer = np.empty_like(g)
        for i in range(functions):
            np.multiply(g, _MULTIPLIERS[i], out=buffer)
            out[i, some] = np.minimum.reduceat(buffer, at)
    return out


def sketches(docs: DataFrame, similarity: float, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """One row a document: doc_id (null: NULL_ID), n_shingles, set_a and set_b (a hash of the whole set), bands, sketch."""
    bands = bands_for(similarity)
    functions = bands * BAND_ROWS
    rows = docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(NULL_ID)).alias("doc_id"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, part in T.slices(T.docs_of(batch.column(1))):
                g, first = T.distinct(*T.shingle_hashes(part, shingle))
                samples = minhash(g, first, functions)
                keys = np.zeros((bands, to - at), np.uint64)
                for b in range(bands):
                    acc = np.full(to - at, b, np.uint64)
                    for r in range(BAND_ROWS):
                        acc = T.mix(acc * np.uint64(0x9E3779B97F4A7C15) + samples[b * BAND_ROWS + r])
                    keys[b] = acc
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(T.mix(g ^ np.uint64(s)), dtype=np.uint64)]) for s in (0, 0x1F2E3D4C5B6A7988)]
                a, b = (s[first[1:]] - s[first[:-1]] for s in sums)
                flat = pa.array(T.signed(np.ascontiguousarray(keys.T).ravel()))
                words = odd_sketches(samples)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(words.shape[1] * 8), to - at, [None, pa.py_buffer(np.ascontiguousarray(words))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(np.diff(first)), pa.array(T.signed(a)), pa.array(T.signed(b)), pa.ListArray.from_arrays(pa.array(np.arange(to - at + 1, dtype=np.int32) * bands), flat), raw],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
                )

    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary")


class Forest:
    """Union-find over the members of two blocks, with their sets and sketches."""

    def __init__(self, sets: list[np.ndarray], words: np.ndarray, percent: int, most_odd: int) -> None:
        self.sets, self.words, self.percent, self.most_odd = sets, words, percent, most_odd
        self.sizes = np.array([len(s) for s in sets])
        self.parent = list(range(len(sets)))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def confirmed(self, a: int, b: int) -> bool:
        x, y = self.sets[a], self.sets[b]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both = int((y[at] == x).sum())
        return 100 * both >= self.percent * (len(x) + len(y) - both)

    def link(self, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        """Join members at `left` with members at `right`: the confirmed links that joined two trees.

        Pairs within the sketches' distance are confirmed on the full sets, nearest first; a pair that earlier links
        already join is not needed for the components.
        """
        odd = np.bitwise_count(self.words[left][:, None, :] ^ self.words[right][None, :, :]).sum(-1)
        low, high = (f(self.sizes[left][:, None], self.sizes[right][None, :]) for f in (np.minimum, np.maximum))
        near = (odd <= self.most_odd) & (100 * low >= self.percent * high)
        if left is right:
            near &= left[:, None] < right[None, :]
        i, j = np.nonzero(near)
        out = []
        for n in np.argsort(odd[i, j], kind="stable"):
            a, b = int(left[i[n]]), int(right[j[n]])
            ra, rb = self.root(a), self.root(b)
            if ra != rb and self.confirmed(a, b):
                out.append((a, b))
                self.parent[ra] = rb
        return out


def block_files(members: DataFrame) -> DataFrame:
    """Write each block (node, sketch, shingles) to a file of its task: the table (component, block, file, at, size)."""
    path = new_path(members.sparkSession, "block-files")
    names = ["node", "sketch", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at = f"{path}/{uuid.uuid4().hex}.blocks", None, 0
        held: list[pa.Table] = []
        key = None

        def put() -> pa.RecordBatch:
            nonlocal out, at
            out = out or open_file(name, write=True)
            raw = pack_rows(pa.concat_tables(held))
            out.write(raw)
            at += len(raw)
            return pa.RecordBatch.from_pydict({"component": pa.array([key[0]], pa.int64()), "block": pa.array([key[1]], pa.int32()), "file": [name], "at": pa.array([at - len(raw)], pa.int64()), "size": pa.array([len(raw)], pa.int64())})

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                if held and keys[a] != key:
                    yield put()
                    held = []
                key = keys[a]
                held.append(pa.table(batch.slice(a, b - a)).select(names))
        if held:
            yield put()
        if out is not None:
            out.close()

    dealt = members.select("component", "block", *names).repartition("component", "block").sortWithinPartitions("component", "block")
    return dealt.mapInArrow(run, "component long, block int, file string, at long, size long")


def near_duplicates(docs: DataFrame, *, percent: int = 80, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id is the component's smallest).

    Documents with 100 * intersection >= percent * union of their sets of distinct lower-cased word shingles are linked.
    Documents with equal sets are one class and meet once. Classes that share a MinHash band form candidate clusters, and
    each cluster is compared in blocks of bounded size: odd sketches by XOR population counts, then the full sets. The
    blocks of a large cluster are files, which pairs of blocks are read from in separate tasks, so no cluster is collected,
    members are shuffled once, and what leaves a task is a spanning forest of its links.

    Null or empty texts have no shingles and are linked with nothing; rows of one doc_id count as one document with
    several texts; rows with a null doc_id share the node that comes last and return null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    similarity = percent / 100
    samples = bands_for(similarity) * BAND_ROWS
    most_odd = odd_distance(similarity, samples)
    base = stash(sketches(docs, similarity, doc_id=doc_id, text=text, shingle=shingle), "sketches")
    some = base.where("n_shingles > 0")
    classes = stash(some.groupBy("set_a", "set_b", "n_shingles").agg(F.min_by(F.struct("doc_id", "bands", "sketch"), "doc_id").alias("x")).select("set_a", "set_b", "x.doc_id", "x.bands", "x.sketch"), "classes")
    keys = classes.select(F.explode("bands").alias("band"), "doc_id")
    shared = keys.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high")
    pairs = keys.join(shared, "band").where("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
    clusters = stash(components(pairs, "clusters").join(classes.select(F.col("doc_id").alias("node"), "sketch"), "node"), "cluster-sketches")

    rows = docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(NULL_ID)).alias("node"), docs[text].alias("text"))
    wanted = rows.join(clusters.select("node"), "node", "left_semi")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, part in T.slices(T.docs_of(batch.column(1))):
                g, first = T.distinct(*T.shingle_hashes(part, shingle))
                own = [g[x:y].tobytes() for x, y in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(own, pa.binary())], names=["node", "shingles"])

    full = wanted.mapInArrow(sets_of, "node long, shingles binary")
    size = clusters.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    member = clusters.join(size, "component").join(full, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    member = stash(member.select("component", "blocks", "block", "node", "sketch", "shingles"), "members")

    def forest_of(*tables: pa.Table) -> tuple[np.ndarray, Forest]:
        rows = pa.concat_tables(tables)
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
        words = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(rows.num_rows, -1)
        return rows["node"].to_numpy(), Forest(sets, words, percent, most_odd)

    def named_links(nodes: np.ndarray, got: list[tuple[int, int]]) -> dict[str, pa.Array]:
        return {"a": pa.array([int(nodes[x]) for x, _ in got], pa.int64()), "b": pa.array([int(nodes[y]) for _, y in got], pa.int64())}

    def compare(group: pa.Table) -> pa.Table:
        """The links of a cluster that is one block."""
        nodes, forest = forest_of(group.select(["node", "sketch", "shingles"]))
        everyone = np.arange(len(nodes))
        return pa.table(named_links(nodes, forest.link(everyone, everyone)))

    def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The links of two blocks of a large cluster, or within one, read from the blocks' files."""
        for batch in batches:
            for first, second in zip(*(zip(*(batch.column(c).to_pylist() for c in some)) for some in ((0, 1, 2), (3, 4, 5)))):
                one = load(*first)
                if first == second:
                    nodes, forest = forest_of(one)
                    everyone = np.arange(len(nodes))
                    got = forest.link(everyone, everyone)
                else:
                    nodes, forest = forest_of(one, load(*second))
                    left, right = np.arange(one.num_rows), np.arange(one.num_rows, len(nodes))
                    # links within each block leave the task of that block alone; here they save links across
                    forest.link(left, left)
                    forest.link(right, right)
                    got = forest.link(left, right)
                yield pa.RecordBatch.from_pydict(named_links(nodes, got))

    small = member.where("blocks = 1").groupBy("component").applyInArrow(compare, "a long, b long")
    # a member of a large cluster is written once, to its block's file; pairs of blocks are rows of pointers
    places = stash(block_files(member.where("blocks > 1")), "blocks")
    here, there = (places.select("component", F.col("block").alias(f"{x}_block"), *[F.col(c).alias(f"{x}_{c}") for c in ("file", "at", "size")]) for x in ("one", "two"))
    met = here.join(there, "component").where("one_block <= two_block").select("one_file", "one_at", "one_size", "two_file", "two_at", "two_size")
    links = small.unionByName(met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(compare_blocks, "a long, b long"))
    groups = components(links, "links")
    unstash(member)
    # a document's class, then the class's component
    named = classes.select("set_a", "set_b", F.col("doc_id").alias("class_id")).join(groups, F.col("class_id") == groups["node"], "left")
    named = named.select("set_a", "set_b", F.coalesce("component", "class_id").alias("component"))
    out = base.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    found = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    shown = lambda c: F.when(c != NULL_ID, c)
    return out.select(shown(F.col("doc_id")).alias("doc_id"), "n_shingles", shown(found).alias("component_id"), (F.col("doc_id") == found).alias("kept"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE_SQL = f"""
with recursive w as (select doc_id, {_WORDS} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] end) as s from w),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
e as (select a, b from c join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on r.b = e.a),
m as (select a as doc_id, min(b) as component_id from r group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from m left join n using (doc_id)
"""
