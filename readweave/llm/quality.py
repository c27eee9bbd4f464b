"""Operator 2: quality rules, with a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from readweave.llm import text as T
from readweave.llm.samples import labelled
from readweave.llm.tables import table

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC0, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[list(b".?;:")] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True
FEATURES = 10


@dataclass
class Lines:
    """Lines that have a word, in order; `first` bounds each document's lines, `words` counts words."""

    first: np.ndarray
    words: np.ndarray
    features: np.ndarray


@dataclass
class Counts:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def measure(docs: T.Docs) -> tuple[Counts, Lines]:
    """The rules' counts of each document, and its lines' features."""
    data, n = docs.data, len(docs)
    words = T.words_of(docs)
    h = T.hashes(docs, words)
    n_words = np.diff(words.first)

    def upto(mask: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(mask)])

    points = upto((data & 0xC0) != 0x80)
    per_word = points[words.end] - points[words.start]
    word_chars = np.diff(upto(per_word)[words.first])
    symbols = upto(_SYMBOL[data])
    n_symbols = np.diff(symbols[docs.offsets])
    # words in 5-word windows that the document has twice
    g, fits = T.grams(h, words.first, 5)
    at = np.flatnonzero(fits)
    key = T.mix(g[at] ^ T.mix(words.doc()[at].astype(np.uint64)))
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[times[where] > 1]
    edge = np.zeros(len(h) + 6, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 5, -1)
    repeated = upto(np.cumsum(edge)[: len(h)] > 0)
    n_repeat = np.diff(repeated[words.first])
    # \n-split lines that have a word: as runs of other bytes, each in the document of its start
    lines = T.words_of(docs, _LINE)
    a, b = np.searchsorted(words.start, lines.start), np.searchsorted(words.start, lines.end)
    keep = b > a
    start, end, a, b = lines.start[keep], lines.end[keep], a[keep], b[keep]
    doc = np.searchsorted(docs.offsets, start, "right") - 1
    line_hash = T.mix(T.hashes(docs, T.Words(start, end, lines.first)) ^ T.mix(doc.astype(np.uint64)))
    _, first_at, where = np.unique(line_hash, return_index=True, return_inverse=True)
    dup = first_at[where] != np.arange(len(start))
    n_dup = np.bincount(doc, dup, n).astype(np.int64)
    size = (end - start).astype(float)
    ratio = lambda mask: np.diff(upto(mask)[np.stack([start, end])], axis=0)[0]
    letters = np.maximum(ratio(_LETTER[data]), 1)
    k = (b - a).astype(float)
    close = _CLOSE[data[words.end[b - 1] - 1]] if len(start) else np.zeros(0, bool)
    features = np.stack([
        np.ones(len(start)), np.minimum(10 * (symbols[end] - symbols[start]) / size, 3), np.minimum(10 * ratio(data == 33) / size, 3), 2 * ratio(_UPPER[data]) / letters, np.log1p(k) / 3,
        close.astype(float), dup.astype(float), (repeated[b] - repeated[a]) / k, np.minimum(5 * ratio(_DIGIT[data]) / size, 3), (size / k) / 10,
    ], axis=1)
    return Counts(n_words, word_chars, n_symbols, n_dup, n_repeat), Lines(np.searchsorted(doc, np.arange(n + 1)), b - a, features)


@dataclass
class Crf:
    """Labels 0 boilerplate and 1 content: `emit` (features x 2) and `move` (from x to)."""

    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best label sequence of each document's lines, all documents a step at a time. Ties go to content."""
        scores = features @ self.emit
        n = np.diff(first)
        by = np.argsort(-n, kind="stable")
        longest = int(n[by[0]]) if len(by) else 0
        active = np.searchsorted(-n[by], -np.arange(1, longest + 1), "right")
        out = np.zeros(len(features), np.int8)
        back: list[np.ndarray] = []
        best = np.zeros((0, 2))
        for t in range(longest):
            d = by[: active[t]]
            here = scores[first[d] + t]
            if t:
                ways = best[: active[t], :, None] + self.move[None]
                choice = (ways[:, 1] >= ways[:, 0]).astype(np.int8)
                back.append(choice)
                here = here + np.maximum(ways[:, 0], ways[:, 1])
                best[: active[t]] = here
            else:
                best = here.copy()
        label = (best[:, 1] >= best[:, 0]).astype(np.int8)
        for t in range(longest - 1, -1, -1):
            d = by[: active[t]]
            out[first[d] + t] = label[: active[t]]
            if t:
                label[: active[t]] = back[t - 1][np.arange(active[t]), label[: active[t]]]
        return out


#: Used where no label of either kind is there to learn from: symbols, shouting and repeats speak for boilerplate
PRIOR = Crf(np.array([[0.0, 0.0]] + [[w / 2, -w / 2] for w in (2.0, 2.0, 1.0, -0.5, -0.5, 1.0, 2.0, 0.5, 0.0)]), np.array([[0.5, -0.5], [-0.5, 0.5]]))


def line_limit(n: np.ndarray, most: int) -> int:
    """The largest limit for each document such that min(n, limit) add up to `most` at most (1 at least)."""
    low, high = 1, max(int(n.max(initial=1)), 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if np.minimum(n, mid).sum() <= most else (low, mid - 1)
    return low


def fit_crf(texts: list[str], content: np.ndarray, *, lines: int = 200_000, rounds: int = 100, penalty: float = 1e-3, move_penalty: float = 0.1) -> Crf:
    """Maximise the conditional likelihood of line labels by forward-backward gradients (Adam, fixed rounds).

    All lines take part, up to `lines` in all; beyond, the documents with most lines have as many as fit, spread evenly
    from their first to their last.
    A document's quality label stands for each of its lines. Such labels never change within a document, so transitions
    are held back more than emissions: else lines at a document's ends would decide over all between them.
    """
    if not len(texts) or len(set(content.tolist())) < 2:
        return PRIOR
    docs = T.docs_of(pa.array(texts, pa.large_string()))
    xs, ys = [], []
    for at, to, part in T.slices(docs):
        _, own = measure(part)
        for i in range(to - at):
            f = own.features[own.first[i] : own.first[i + 1]]
            if len(f):
                xs.append(f)
                ys.append(int(content[at + i]))
    if not xs:
        return PRIOR
    limit = line_limit(np.array([len(x) for x in xs]), lines)
    xs = [x if len(x) <= limit else x[np.linspace(0, len(x) - 1, limit).round().astype(np.int64)] for x in xs]
    order = np.argsort([-len(x) for x in xs], kind="stable")
    xs, y = [xs[i] for i in order], np.array([ys[i] for i in order])
    n = np.array([len(x) for x in xs])
    longest = int(n[0])
    # line t of all documents that have one, then line t + 1: documents go from long to short, so a step's are the first ones
    active = np.searchsorted(-n, -np.arange(1, longest + 1), "right")
    at = np.concatenate([[0], np.cumsum(active)])
    doc = np.arange(at[-1]) - np.repeat(at[:-1], active)
    x = np.concatenate(xs)[(np.cumsum(n) - n)[doc] + np.repeat(np.arange(longest), active)]
    steps = [(slice(at[t - 1], at[t - 1] + active[t]), slice(at[t], at[t + 1])) for t in range(1, longest)]
    follows = slice(at[1], None)  # lines that have one before them
    before = np.arange(at[1], at[-1]) - np.repeat(active[:-1], active[1:])
    last_line = at[n - 1] + np.arange(len(xs))
    share = 1 / np.bincount(y, minlength=2)  # both kinds of documents weigh the same
    weight = (share[y] / n / 2)[doc][:, None]
    gold = np.zeros((len(x), 2))
    gold[np.arange(len(x)), y[doc]] = 1
    emit, move = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    moments = [np.zeros_like(p) for p in (emit, emit, move, move)]
    add = np.logaddexp
    for step in range(1, rounds + 1):
        s = x @ emit
        forward, backward = s.copy(), np.zeros_like(s)
        for a, b in steps:
            ways = forward[a, :, None] + move[None]
            forward[b] += add(ways[:, 0], ways[:, 1])
        for a, b in reversed(steps):
            ways = move[None] + (s[b] + backward[b])[:, None]
            backward[a] = add(ways[..., 0], ways[..., 1])
        z = add(forward[last_line, 0], forward[last_line, 1])[doc]
        p = np.exp(forward + backward - z[:, None])
        diff = (gold - p) * weight
        g_emit = x.T @ diff - penalty * emit
        g_move = -move_penalty * move
        if longest > 1:
            pair = np.exp(forward[before, :, None] + move[None] + (s[follows] + backward[follows])[:, None] - z[follows, None, None])
            both = gold[before, :, None] * gold[follows, None]
            g_move = g_move + ((both - pair) * weight[follows, :, None]).sum(0)
        for i, (param, grad) in enumerate(((emit, g_emit), (move, g_move))):
            m, v = moments[2 * i], moments[2 * i + 1]
            m *= 0.9
            m += 0.1 * grad
            v *= 0.999
            v += 0.001 * grad * grad
            param += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(emit, move)


def fit_quality(docs: DataFrame, labels: DataFrame, *, sample: int = 1500, lines: int = 200_000, chars: int = 20_000, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Crf:
    """Fit on at most `sample` documents of each label value, of at most `chars` characters (see `labelled` for which),
    and at most `lines` of their lines in all (see `fit_crf`)."""
    got: pd.DataFrame = labelled(docs, labels, label, {0: sample, 1: sample}, doc_id=doc_id, text=text, chars=chars)
    return fit_crf(got["text"].tolist(), got["label"].to_numpy(), lines=lines)


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judge(part: T.Docs, crf: Crf, least: float) -> dict[str, np.ndarray]:
    counts, lines = measure(part)
    label = crf.viterbi(lines.features, lines.first)
    total = np.concatenate([[0], np.cumsum(lines.words)])[lines.first]
    good = np.concatenate([[0], np.cumsum(lines.words * label)])[lines.first]
    share = np.diff(good) / np.maximum(np.diff(total), 1)
    failed = (counts.n_words < 10) | (100 * counts.n_repeat_words > 20 * counts.n_words)
    return {**vars(counts), "base_failed": failed, "kept": ~failed & (share >= least), "content_share": share}


def quality_rules(docs: DataFrame, crf: Crf, *, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Each document's counts and verdict: kept unless base_failed (under 10 words, or over 20 % of them in repeated
    5-word windows), or unless lines that the field marks as content have a share of at least `least` of its words.

    Null and empty texts have no words and fail. Rows are judged one by one: repeated or null ids don't matter.
    """
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, part in T.slices(T.docs_of(batch.column(1))):
                got = judge(part, crf, least)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *map(pa.array, got.values())], names=["doc_id", *got])

    return rows.mapInArrow(run, f"doc_id {kind}, {VERDICT}")


def keep_quality(docs: DataFrame, crf: Crf, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of kept documents, with all their columns."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [judge(part, crf, least)["kept"] for _, _, part in T.slices(T.docs_of(batch.column(place)))]
            if kept:
                yield pc.filter(batch, pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
