"""Operator 4: exact removal of long repeated word spans, by a sparse De Bruijn graph of token k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readweave.llm import text as T
from readweave.llm.chunks import CHUNK_BYTES, bucket_cuts, chunked, load, load_row, share, spread, words_and_hashes
from readweave.llm.tables import stash, table

WINDOW = 20
EDGE = 8
NULL_ID = 2**63 - 1
#: Spans of a source chunk that are verified at once, about
SPANS = 500


class Graph:
    """A chunk's part of the sparse De Bruijn graph.

    Edges are token k-mers, of which each window keeps the one with the smallest hash, so equal windows keep the same
    edge at the same place. An edge's occurrence stands for a run of consecutive windows.
    """

    def __init__(self, rows: pa.Table, doc_id: str, text: str, window: int) -> None:
        self.docs = T.docs_of(rows[text])
        (self.h,), self.first = words_and_hashes(self.docs, T.SAME)
        self.ids = rows[doc_id].combine_chunks().fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        k = min(EDGE, window)
        edges, _ = T.grams(self.h, self.first, k)
        self.windows, fits = T.grams(self.h, self.first, window)
        start = np.flatnonzero(fits)
        span = window - k + 1
        low = np.zeros(0, np.int64)
        if len(start):
            view = np.lib.stride_tricks.sliding_window_view(edges[: len(self.h) - k + 1], span)
            low = np.concatenate([start[i : i + 200_000] + view[start[i : i + 200_000]].argmin(1) for i in range(0, len(start), 200_000)])
        # runs: consecutive windows of a document with the same edge occurrence
        doc = np.searchsorted(self.first, start, "right") - 1
        new = np.ones(len(start), bool)
        new[1:] = (low[1:] != low[:-1]) | (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        self.run_start = start[at]
        self.run_size = np.diff(np.append(at, len(start)))
        self.run_edge = edges[low[at]]
        self.run_lead = low[at] - start[at]
        self.run_doc = doc[at]


def repeated_spans(chunks: DataFrame, doc_id: str, text: str, window: int) -> DataFrame:
    """Spans (chunk, doc, start, size, source_chunk, source_doc, source_start): `size` windows of a document which start
    earlier at the source, word for word by their hashes."""
    parts = share(chunks)
    nb = max(1, parts // 2)

    def graph(rows: pa.Table) -> Graph:
        return Graph(rows, doc_id, text, window)

    def ask_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, *where in zip(*[c.to_pylist() for c in batch.columns]):
                one, n = np.unique(graph(load(*where)).run_edge, return_counts=True)
                order, cut = bucket_cuts(one, nb)
                one, many = one[order], (n > 1)[order]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(range(nb), pa.int32()), "chunk": pa.array([chunk] * nb, pa.int64()), "edges": pa.array([one[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), "many": pa.array([np.packbits(many[a:b]).tobytes() for a, b in zip(cut, cut[1:])], pa.binary())})

    def repeated(group: pa.Table) -> pa.Table:
        """Which of each chunk's edges have two occurrences in the corpus."""
        asked = [np.frombuffer(x, np.uint64) for x in group["edges"].to_pylist()]
        many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(a)).astype(bool) for x, a in zip(group["many"].to_pylist(), asked)]
        flat = np.concatenate(asked)
        one, where, n = np.unique(flat, return_inverse=True, return_counts=True)
        n[where[np.concatenate(many)]] = 2
        yes = n[where] > 1
        ends = np.cumsum([0, *map(len, asked)])
        return pa.table({"chunk": group["chunk"], "bucket": group["bucket"], "yes": pa.array([np.packbits(yes[a:b]).tobytes() for a, b in zip(ends, ends[1:])], pa.binary())})

    by_bucket = lambda df: df.repartition(parts, "bucket").groupBy("bucket")
    by_chunk = lambda df: df.repartition(parts, "chunk").groupBy("chunk")
    answers = by_bucket(spread(chunks).mapInArrow(ask_edges, "bucket int, chunk long, edges binary, many binary")).applyInArrow(repeated, "chunk long, bucket int, yes binary")

    def runs(own: pa.Table, said: pa.Table) -> pa.Table:
        """A chunk's runs at repeated edges. Of runs alike in a chunk, the earliest ask (several, where rows share an id);
        the others name the first as their source."""
        chunk = own["chunk"][0].as_py()
        g = graph(load_row(own))
        one = np.unique(g.run_edge)
        order, cut = bucket_cuts(one, nb)
        yes = np.zeros(len(one), bool)
        for b, raw in zip(said["bucket"].to_pylist(), said["yes"].to_pylist()):
            yes[order[cut[b] : cut[b + 1]]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=cut[b + 1] - cut[b]).astype(bool)
        keep = np.flatnonzero(yes[np.searchsorted(one, g.run_edge)])
        start, size, edge, lead, doc = g.run_start[keep], g.run_size[keep], g.run_edge[keep], g.run_lead[keep], g.run_doc[keep]
        place, ids = start - g.first[doc], g.ids[doc]
        # a hash of the whole run: the running sum of its windows' hashes by their place in it
        flat = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        step = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        total = np.concatenate([[np.uint64(0)], np.cumsum(T.mix(g.windows[flat] ^ T.mix(step.astype(np.uint64))), dtype=np.uint64)])
        ends = np.cumsum(size)
        alike = T.mix(total[ends] - total[ends - size]) ^ T.mix(edge + (lead * 64 + size).astype(np.uint64))
        by = np.lexsort((doc, place, ids, alike))
        head = np.ones(len(by), bool)
        head[1:] = alike[by][1:] != alike[by][:-1]
        lead_of = np.empty(len(by), np.int64)
        lead_of[by] = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
        later = (ids != ids[lead_of]) | (place != place[lead_of])
        asks = np.flatnonzero(~later)
        order, cut = bucket_cuts(edge[asks], nb)
        asks = asks[order]
        rows = {"bucket": [], "chunk": [], "doc": [], "source": [], "runs": []}
        most = np.iinfo(np.int32).max

        def put(bucket: int, some: np.ndarray, with_source: bool) -> None:
            n = size[some]
            where = np.repeat(start[some] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            src = lead_of[some]
            fields = {"edge": edge[some], "id": ids[some], "doc": doc[some], "place": place[some], "lead": lead[some], "size": n, "source_doc": doc[src] if with_source else doc[some], "source_place": place[src] if with_source else place[some]}
            raw = b"".join(np.ascontiguousarray(v).astype("<i8" if k == "id" else "<u8" if k == "edge" else "<i4").tobytes() for k, v in fields.items())
            rows["bucket"].append(bucket)
            rows["chunk"].append(chunk)
            rows["doc"].append(len(some))
            rows["source"].append(with_source)
            rows["runs"].append(raw if with_source else raw + g.windows[where].tobytes())

        for b in range(nb):
            if cut[b + 1] > cut[b]:
                put(b, asks[cut[b] : cut[b + 1]], False)
        if later.any():
            put(-1 - int(chunk % most), np.flatnonzero(later), True)
        return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "chunk": pa.array(rows["chunk"], pa.int64()), "n": pa.array(rows["doc"], pa.int32()), "local": pa.array(rows["source"], pa.bool_()), "runs": pa.array(rows["runs"], pa.binary())})

    asked = by_chunk(chunks).cogroup(by_chunk(answers)).applyInArrow(runs, "bucket int, chunk long, n int, local boolean, runs binary")

    def sources(group: pa.Table) -> pa.Table:
        """The earliest occurrence of each window of a bucket's edges; consecutive windows with consecutive sources are one path."""
        fields = [("edge", "<u8"), ("id", "<i8"), ("doc", "<i4"), ("place", "<i4"), ("lead", "<i4"), ("size", "<i4"), ("source_doc", "<i4"), ("source_place", "<i4")]
        cols: dict[str, list[np.ndarray]] = {k: [] for k, _ in fields}
        chunk, hashes, out = [], [], []
        for c, n, local, raw in zip(*(group[k].to_pylist() for k in ("chunk", "n", "local", "runs"))):
            at, got = 0, {}
            for k, kind in fields:
                width = int(kind[2]) * n
                got[k] = np.frombuffer(raw, kind, n, at)
                at += width
            if local:
                out.append([np.full(n, c), got["doc"], got["place"], got["size"], np.full(n, c), got["source_doc"], got["source_place"]])
                continue
            chunk.append(np.full(n, c))
            hashes.append(np.frombuffer(raw, np.uint64, offset=at))
            for k in cols:
                cols[k].append(got[k])
        if chunk:
            run = {k: np.concatenate(v).astype(np.uint64 if k == "edge" else np.int64) for k, v in cols.items()}
            run["chunk"] = np.concatenate(chunk)
            w = np.concatenate(hashes)
            of = np.repeat(np.arange(len(run["size"])), run["size"])
            step = np.arange(len(of)) - np.repeat(np.cumsum(run["size"]) - run["size"], run["size"])
            place = run["place"][of] + step
            key = T.mix(w ^ T.mix(run["edge"][of])) + (run["lead"][of] - step).astype(np.uint64)
            by = np.lexsort((run["doc"][of], run["chunk"][of], place, run["id"][of], key))
            head = np.ones(len(by), bool)
            head[1:] = key[by][1:] != key[by][:-1]
            source = np.empty(len(by), np.int64)
            source[by] = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
            later = (run["id"][of] != run["id"][of][source]) | (place != place[source])
            i = np.flatnonzero(later)
            s = source[i]
            new = np.ones(len(i), bool)
            new[1:] = (of[i][1:] != of[i][:-1]) | (i[1:] != i[:-1] + 1) | (of[s][1:] != of[s][:-1]) | (s[1:] != s[:-1] + 1)
            a = np.flatnonzero(new)
            i, s, size = i[a], s[a], np.diff(np.append(a, len(i)))
            out.append([run["chunk"][of[i]], run["doc"][of[i]], place[i], size, run["chunk"][of[s]], run["doc"][of[s]], place[s]])
        names = ["chunk", "doc", "start", "size", "source_chunk", "source_doc", "source_start"]
        cols_out = [np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(7)]
        return pa.table({k: pa.array(v.astype(np.int64)) for k, v in zip(names, cols_out)})

    names = ["chunk", "doc", "start", "size", "source_chunk", "source_doc", "source_start"]
    schema = ", ".join(f"{k} long" for k in names)
    return compacted(by_bucket(asked).applyInArrow(sources, schema), parts)


def compacted(spans: DataFrame, parts: int) -> DataFrame:
    """Join spans end to end where both the document and the source go on.

    A span is an edge from the node (place, source) of its first window to the node behind its last one. A window has one
    source, so no node has two edges in or two out: a node with one of each lies within a path and cancels out, and the
    others are, in turn, the first and the last nodes of paths. One shuffle by chunk serves both steps.
    """
    path = ["chunk", "doc", "source_chunk", "source_doc", "diagonal"]
    edges = spans.repartition(parts, "chunk").withColumn("diagonal", F.col("source_start") - F.col("start"))
    ends = F.array(F.struct(F.col("start").alias("place"), F.lit(1).alias("degree")), F.struct((F.col("start") + F.col("size")).alias("place"), F.lit(-1).alias("degree")))
    nodes = edges.select(*path, F.explode(ends).alias("n")).groupBy(*path, F.col("n.place").alias("place")).agg(F.sum("n.degree").alias("degree")).where("degree <> 0")
    nodes = nodes.withColumn("size", F.lead("place").over(Window.partitionBy(*path).orderBy("place")) - F.col("place")).where("degree > 0")
    return nodes.select("chunk", "doc", F.col("place").alias("start"), "size", "source_chunk", "source_doc", (F.col("place") + F.col("diagonal")).alias("source_start"))


def span_hashes(docs: T.Docs, doc: np.ndarray, start: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes, by the other function, of the words at `start` of documents, `words` of them."""
    (h,), first = words_and_hashes(docs, T.SAME, (1,))
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * T.powers(1, len(h))[:-1], dtype=np.uint64)])
    a = first[doc] + start
    return T.mix((total[a + words] - total[a]) * T.powers(1, len(h), True)[a])


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", digest: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Documents without the words of windows (of `window` consecutive words) that start earlier in the corpus: in a
    document with a smaller doc_id, or earlier in the same one. Windows are judged on the input.

    Rounds between chunks and buckets find the k-mer edges with two occurrences and the source of each window at such an
    edge; Spark counts the degrees of the nodes between runs of windows and compacts nonbranching paths (`compacted`). The
    paths are joined to the chunks that hold their sources, and on to their own, where the hashes of the words at both
    coordinates (by another function) must agree. Ids are cast to long.

    Returns the input's columns with `text` cut: what stays between removed words is unchanged, removed spans leave one
    space. With `digest`: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).
    Null and empty texts have no words. Null doc_ids count as the largest; rows with the same doc_id are one document
    with several texts, of which equal places are not earlier than each other. An empty table gives no rows.
    """
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")) if digest else docs
    key, body = ("doc_id", "text") if digest else (doc_id, text)
    chunks = chunked(rows, body, chunk_bytes)
    spans = stash(repeated_spans(chunks, key, body, window), "spans")

    origin = ["source_chunk", "source_doc", "source_start", "size"]

    def at_source(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not own.num_rows or not asked.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in [*origin, "hash"]})
        words = asked["size"].to_numpy() + window - 1
        these, doc = np.unique(asked["source_doc"].to_numpy(), return_inverse=True)
        some = T.docs_of(load_row(own)[body].take(pa.array(these)))
        h = span_hashes(some, doc, asked["source_start"].to_numpy(), words)
        return pa.table({**{k: asked[k] for k in origin}, "hash": pa.array(T.signed(h))})

    # many copies have one source span: its hash is taken once, and joined to them; a chunk that many have as their source
    # is read by several tasks, each for a bounded share of its spans
    parts = share(chunks)
    asked = spans.select(*origin).distinct()
    shares = asked.groupBy("source_chunk").agg(F.ceil(F.count("*") / F.lit(SPANS)).cast("int").alias("shares"))
    dealt = chunks.join(shares, chunks["chunk"] == shares["source_chunk"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select(*chunks.columns, "share")
    asked = asked.join(shares, "source_chunk").withColumn("share", F.pmod(F.xxhash64("source_doc", "source_start"), F.col("shares")).cast("int")).select(*origin, "share")
    hashed = dealt.repartition(parts, "chunk", "share").groupBy("chunk", "share").cogroup(asked.repartition(parts, "source_chunk", "share").groupBy("source_chunk", "share")).applyInArrow(at_source, ", ".join(f"{k} long" for k in [*origin, "hash"]))
    checked = spans.join(hashed, origin).selectExpr("chunk", "doc", "start", f"size + {window - 1} as words", "hash")

    def cut(own: pa.Table, got: pa.Table) -> pa.Table:
        data = load_row(own)
        parts = T.docs_of(data[body])
        n = len(parts)
        drop: dict[int, list[tuple[int, int]]] = {}
        if got.num_rows:
            doc, start, words = (got[k].to_numpy() for k in ("doc", "start", "words"))
            right = T.signed(span_hashes(parts, doc, start, words)) == got["hash"].to_numpy()
            for d, s, w, ok in zip(doc.tolist(), start.tolist(), words.tolist(), right.tolist()):
                if ok:
                    drop.setdefault(d, []).append((s, s + w))
        counts, removed, out = [], [], []
        for i in range(n):
            raw = parts.data[parts.offsets[i] : parts.offsets[i + 1]].tobytes()
            flags = None
            if digest or i in drop:
                words = raw.split()
                counts.append(len(words))
                if i in drop:
                    keep = np.ones(len(words), bool)
                    for s, e in drop[i]:
                        keep[s:e] = False
                    flags = keep
                removed.append(0 if flags is None else int((~flags).sum()))
            if digest:
                out.append(hashlib.sha256(b" ".join(words if flags is None else compress(words, flags.tolist()))).hexdigest())
            elif flags is not None:
                w = T.words_of(T.Docs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
                out.append(b" ".join(raw[w.start[a] : w.end[b - 1]] for a, b in zip(edge[::2], edge[1::2])).decode())
            else:
                out.append(None)
        if digest:
            return pa.table({"doc_id": data["doc_id"], "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(out, pa.string())})
        mask = pa.array([x is not None for x in out], pa.bool_())
        old = data[body].combine_chunks()
        new = pa.compute.if_else(mask, pa.array(out, old.type), old)
        return data.set_column(data.schema.get_field_index(body), body, new)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" if digest else rows.schema
    return chunks.repartition(parts, "chunk").groupBy("chunk").cogroup(checked.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(cut, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


ORACLE_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, i, array_to_string(w[i:i+19], ' ') as g from (select *, unnest(range(1, len(w) - 18)) as i from w)),
k as (select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from g),
x as (select distinct doc_id, unnest(range(i, i + 20)) as j from k where k > 1),
t as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as j from w),
s as (select t.doc_id, count(x.j) as n_removed, string_agg(word, ' ' order by t.j) filter (x.j is null) as kept from t left join x on t.doc_id = x.doc_id and t.j = x.j group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join s using (doc_id)
"""
