"""Operator 5: toxicity grades by cumulative-link (proportional odds) regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from readweave.llm import text as T
from readweave.llm.samples import labelled
from readweave.llm.tables import table

#: Features: whole words, and their beginnings of these numbers of characters (toxic stems take many endings)
STEMS = (4, 5, 6, 7, 8)
GRADES = 4
#: Least chi-square of a feature: the tests are as many as the sample has features
CHI = 30.0


def features(docs: T.Docs) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For whole words, then each stem length: feature hashes, and the number of the document of each."""
    words = T.words_of(docs, ~T.ALNUM)
    doc = words.doc()
    yield T.hashes(docs, words, T.LOWER), doc
    heads = (docs.data & 0xC0) != 0x80
    char = np.concatenate([[0], np.cumsum(heads)])
    places = np.append(np.flatnonzero(heads), len(docs.data))
    for n in STEMS:
        long = np.flatnonzero(char[words.end] - char[words.start] >= n)
        end = places[char[words.start[long]] + n]
        yield T.mix(T.hashes(docs, T.Words(words.start[long], end, words.first), T.LOWER) + np.uint64(n)), doc[long]


#: Buckets of features in the first pass of a fit
BUCKETS = 1 << 22
#: Bytes of the sample that a fit takes at a time
FIT_SLICE = 500_000


def tallies(docs: T.Docs, known: np.ndarray | None = None, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, count), the features as hashes, or as places in the sorted hashes `known`. `among` marks the
    buckets of features that count."""
    keys, owners = [], []
    if known is not None:
        small = np.zeros(1 << 20, bool)
        small[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    for h, doc in features(docs):
        if known is not None:
            maybe = np.flatnonzero(small[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            h, doc = h[maybe], doc[maybe]
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            hit = known[at] == h if len(known) else np.zeros(len(h), bool)
            h, doc = at[hit].astype(np.uint64), doc[hit]
        if among is not None:
            use = among[(h & np.uint64(BUCKETS - 1)).astype(np.int64)]
            h, doc = h[use], doc[use]
        keys.append(h)
        owners.append(doc)
    h, doc = np.concatenate(keys), np.concatenate(owners)
    by = np.lexsort((h, doc))
    h, doc = h[by], doc[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Ordinal:
    """P(grade > k) = sigmoid(weights . x - thresholds[k]): one weight vector, ascending thresholds."""

    known: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def predict(self, docs: T.Docs) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of any grade above 0."""
        doc, at, n = tallies(docs, self.known)
        score = np.bincount(doc, self.weights[at.astype(np.int64)] * np.log1p(n), len(docs)) if len(self.weights) else np.zeros(len(docs))
        above = _sigmoid(score[:, None] - self.thresholds[None])
        return above.sum(1), above[:, 0]


NEVER = Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.array([30.0, 31.0, 32.0]))


def fit_ordinal(texts: list[str], toxic: np.ndarray, weight: np.ndarray, *, most: int = 4000, rounds: int = 400, penalty: float = 2e-5) -> Ordinal:
    """Choose features by their association with toxic documents, grade the toxic ones, fit weights and thresholds.

    The labels only tell toxic from clean. Grades 1 to 3 are the thirds of the toxic documents by how much speaks for
    toxicity in them: the summed log odds of their features, as the other half of the sample has them, so a document's
    own label doesn't make its grade. Clean documents have grade 0.
    """
    if not len(texts) or len(set(toxic.tolist())) < 2:
        return NEVER
    docs = T.docs_of(pa.array(texts, pa.large_string()))
    y = toxic.astype(bool)
    w = weight / weight.sum()
    pa_, pb = w[y].sum(), w[~y].sum()
    total = len(texts)

    def association(wa: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chi-square of presence against the label, at the labels' own proportions, and which side it speaks for."""
        cross = wa * (pb - wb) - wb * (pa_ - wa)
        seen = wa + wb
        return total * cross**2 / np.maximum(seen * (1 - seen) * pa_ * pb, 1e-12), cross

    # first in buckets of features, in memory that doesn't follow the sample; then the features of likely buckets
    counts = np.zeros((3, BUCKETS), np.float32)
    for at, to, part in T.slices(docs, FIT_SLICE):
        doc, h, _ = tallies(part)
        b = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
        for i, x in enumerate((y.astype(float), w * y, w * ~y)):
            counts[i] += np.bincount(b, x[at:to][doc], BUCKETS)
    chi, cross = association(counts[1], counts[2])
    among = (counts[0] >= 3) & (cross > 0) & (chi > CHI / 4)
    parts = []
    for at, _, part in T.slices(docs, FIT_SLICE):
        doc, h, n = tallies(part, among=among)
        parts.append((doc + at, h, n))
    doc, h, n = (np.concatenate(x) for x in zip(*parts))
    one, where = np.unique(h, return_inverse=True)
    a = np.bincount(where, y[doc], len(one))  # toxic documents with the feature
    wa, wb = (np.bincount(where, (w * m)[doc], len(one)) for m in (y, ~y))
    chi, cross = association(wa, wb)
    pick = np.flatnonzero((a >= 3) & (cross > 0) & (chi > CHI))
    pick = np.sort(pick[np.argsort(-chi[pick], kind="stable")[:most]])
    known = one[pick]
    place = np.full(len(one), -1)
    place[pick] = np.arange(len(pick))
    use = place[where] >= 0
    doc, col, val = doc[use], place[where][use], np.log1p(n[use])

    def log_odds(of: np.ndarray) -> np.ndarray:
        """Smoothed log odds of the features among some of the documents."""
        sides = []
        for side in (y & of, ~y & of):
            seen = np.bincount(col, (w * side)[doc], len(pick))
            sides.append(seen / max(w[side].sum(), 1e-12) + 0.5 / max(side.sum(), 1))
        return np.log(sides[0] / sides[1])

    strong = np.zeros(total)
    half = (np.cumsum(y) * y + np.cumsum(~y) * ~y) % 2 == 0
    for of in (half, ~half):
        strong += np.where(of, np.bincount(doc, val * log_odds(~of)[col], total), 0)
    cuts = np.quantile(strong[y], [1 / 3, 2 / 3])
    grade = np.where(y, 1 + np.searchsorted(cuts, strong), 0)
    # a feature counts by its log odds in the whole sample, so the penalty holds back rare and weak features most
    odds = log_odds(np.ones(total, bool))
    beta, thresholds = fit_links(doc, col, val * odds[col], grade, w, len(pick), rounds=rounds, penalty=penalty)
    return Ordinal(known, beta * odds, thresholds)


def fit_links(doc: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray, w: np.ndarray, features: int, *, rounds: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that maximise the mean log likelihood of grades, less penalty/2 times the squared
    weights. `val` is the value of feature `col` in document `doc`; gradients by Adam, in a fixed number of rounds."""
    total = len(grade)
    beta, theta, gap = np.zeros(features), np.array(2.0), np.zeros(GRADES - 2)
    moments: dict[int, list] = {}
    for step in range(1, rounds + 1):
        cut = theta + np.concatenate([[0], np.cumsum(np.exp(gap))])
        score = np.bincount(doc, beta[col] * val, total)
        up = np.concatenate([np.ones((total, 1)), _sigmoid(score[:, None] - cut[None]), np.zeros((total, 1))], axis=1)
        row = np.arange(total)
        p = np.maximum(up[row, grade] - up[row, grade + 1], 1e-12)
        slope = up * (1 - up)
        g_score = w * (slope[row, grade] - slope[row, grade + 1]) / p
        # a threshold k bounds grade k from above and grade k+1 from below
        g_cut = np.array([(w / p * slope[:, k + 1] * ((grade == k).astype(float) - (grade == k + 1))).sum() for k in range(GRADES - 1)])
        grads = [np.bincount(col, g_score[doc] * val, features) - penalty * beta, g_cut.sum(), np.cumsum(g_cut[::-1])[::-1][1:] * np.exp(gap)]
        moved = []
        for i, (param, grad) in enumerate(zip((beta, theta, gap), grads)):
            m, v = moments.get(i, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            moments[i] = [m, v]
            moved.append(param + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
        beta, theta, gap = moved
    return beta, theta + np.concatenate([[0], np.cumsum(np.exp(gap))])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, toxic_docs: int = 2000, clean_docs: int = 4000, doc_id: str = "doc_id", text: str = "text") -> Ordinal:
    """Fit on at most `toxic_docs` toxic and `clean_docs` clean documents, weighted to the labels' own proportions."""
    got = labelled(docs, labels, "toxic", {1: toxic_docs, 0: clean_docs}, doc_id=doc_id, text=text)
    counts = {r["toxic"]: r["count"] for r in labels.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    y = got["label"].to_numpy()
    have = np.maximum(np.bincount(y, minlength=2), 1) if len(y) else np.ones(2)
    weight = np.array([counts.get(0, 0), counts.get(1, 0)]) / have
    return fit_ordinal(got["text"].tolist(), y, weight[y] if len(y) else np.zeros(0))


def toxicity(docs: DataFrame, model: Ordinal, *, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), p_toxic (probability of a grade above 0), toxic (p_toxic >= least).

    Null and empty texts have no features. Rows are scored one by one; null and repeated ids are kept as they are.
    """
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, part in T.slices(T.docs_of(batch.column(1))):
                severity, p = model.predict(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(severity), pa.array(p), pa.array(p >= least)], names=["doc_id", "severity", "p_toxic", "toxic"])

    return rows.mapInArrow(run, f"doc_id {kind}, severity double, p_toxic double, toxic boolean")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
