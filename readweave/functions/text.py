"""Scores of plain strings, as Column expressions. Lengths and edits count code points; a null gives a null.

Levenshtein stays in the JVM. The adjacent-transposition distance (optimal string alignment) runs in a batched Arrow
kernel, for the pairs alone that the Levenshtein distance doesn't decide: up to 1 both agree, and it is never under half.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from readweave.functions.kernels import edit_batch

METRICS = ("distance", "damerau_distance", "combined_distance", "normalized_similarity", "normalized_distance", "ratio")
DISTANCES = METRICS[:3]

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def check_metric(metric: str) -> str:
    if not isinstance(metric, str):
        raise TypeError("the metric must be a str")
    if metric not in METRICS:
        raise ValueError(f"the metric must be one of {', '.join(METRICS)}")
    return metric


#: What a metric's cutoff may be: its types, and the largest value (None: no bound). A bool counts as no number.
_CUTOFFS = {m: ((int,), None) for m in DISTANCES} | {m: ((int, float), 1.0) for m in METRICS[len(DISTANCES) :]}


def check_cutoff(cutoff: int | float | None, metric: str) -> int | float | None:
    """The cutoff of a metric, as a float where the metric is one; an error where `_CUTOFFS` has no place for it."""
    kinds, most = _CUTOFFS[metric]
    if cutoff is None:
        return None
    if type(cutoff) not in kinds:
        raise TypeError(f"a cutoff of {metric} is of type {' or '.join(k.__name__ for k in kinds)}, not {cutoff!r}")
    if not 0 <= cutoff <= (cutoff if most is None else most):
        raise ValueError(f"a cutoff of {metric} is {'at least 0' if most is None else 'between 0 and 1'}, not {cutoff!r}")
    return kinds[-1](cutoff)


def apply_cutoff(score: Column, metric: str, cutoff: int | float | None) -> Column:
    """A miss reads cutoff + 1, a similarity of 0.0 or a normalized distance of 1.0."""
    cutoff = check_cutoff(cutoff, check_metric(metric))
    if cutoff is None:
        return score
    if metric in DISTANCES:
        return F.when(score <= cutoff, score).when(score > cutoff, F.lit(cutoff + 1).cast("int"))
    if metric == "normalized_distance":
        return F.when(score <= cutoff, score).when(score > cutoff, F.lit(1.0))
    return F.when(score >= cutoff, score).when(score < cutoff, F.lit(0.0))


@F.pandas_udf(IntegerType())
def osa_kernel(left: pd.Series, right: pd.Series) -> pd.Series:
    out = pd.array([None] * len(left), "Int32")
    use = (left.notna() & right.notna()).to_numpy()
    if use.any():
        out[use] = edit_batch(left[use].tolist(), right[use].tolist())
    return pd.Series(out)


def levenshtein(left: Text, right: Text, cutoff: int | None = None) -> Column:
    """With a cutoff, null where the distance is over it (the computation is banded)."""
    if cutoff is None:
        return F.levenshtein(_c(left), _c(right))
    d = F.levenshtein(_c(left), _c(right), check_cutoff(cutoff, "distance"))
    return F.when(d >= 0, d)


def osa(left: Text, right: Text, cutoff: int | None = None) -> Column:
    """With a cutoff, null where the distance is over it; pairs that Levenshtein already rules out skip the kernel."""
    left, right = _c(left), _c(right)
    lev = F.levenshtein(left, right)
    undecided = lev > 1 if cutoff is None else (lev > 1) & (lev <= 2 * check_cutoff(cutoff, "damerau_distance"))
    d = F.when(lev <= 1, lev).otherwise(osa_kernel(F.when(undecided, left), right))
    return d if cutoff is None else F.when(d <= cutoff, d)


def distance(left: Text, right: Text, score_cutoff: int | None = None) -> Column:
    if score_cutoff is None:
        return levenshtein(left, right)
    left, right = _c(left), _c(right)
    return F.when(left.isNotNull() & right.isNotNull(), F.coalesce(levenshtein(left, right, score_cutoff), F.lit(score_cutoff + 1)))


def damerau_distance(left: Text, right: Text, score_cutoff: int | None = None) -> Column:
    if score_cutoff is None:
        return osa(left, right)
    left, right = _c(left), _c(right)
    return F.when(left.isNotNull() & right.isNotNull(), F.coalesce(osa(left, right, score_cutoff), F.lit(score_cutoff + 1)))


#: The smaller of both distances, which is always the one with transpositions
combined_distance = damerau_distance


def similarity_of(d: Column, left: Column, right: Column) -> Column:
    longest = F.greatest(F.char_length(left), F.char_length(right))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - d / longest))


def normalized_similarity(left: Text, right: Text, score_cutoff: float | None = None) -> Column:
    left, right = _c(left), _c(right)
    return apply_cutoff(similarity_of(F.levenshtein(left, right), left, right), "normalized_similarity", score_cutoff)


ratio = normalized_similarity


def normalized_distance(left: Text, right: Text, score_cutoff: float | None = None) -> Column:
    return apply_cutoff(1.0 - normalized_similarity(left, right), "normalized_distance", score_cutoff)


def within_distance(left: Text, right: Text, most: int) -> Column:
    left, right = _c(left), _c(right)
    return F.when(left.isNotNull() & right.isNotNull(), F.levenshtein(left, right, check_cutoff(most, "distance")) >= 0)


def within_damerau_distance(left: Text, right: Text, most: int) -> Column:
    return damerau_distance(left, right, most) <= most


def plain(metric: str):
    """The function of a metric by name."""
    return {"distance": distance, "damerau_distance": damerau_distance, "combined_distance": combined_distance, "normalized_similarity": normalized_similarity, "normalized_distance": normalized_distance, "ratio": ratio}[check_metric(metric)]
