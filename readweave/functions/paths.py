"""Scores of path sets (array<string>): the best over all pairs of paths.

An empty set, or one that mixes the empty string with others, is an error; sets of empty strings alone count as one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from readweave.functions.kernels import DISTANCE_CELLS, STRING_CELLS, Lattice, Levels, Strings, edit_batch, lattice_distance, lattice_similarity, lattice_trace, path_keys, share_path
from readweave.functions.text import Text, _c, apply_cutoff, check_cutoff, similarity_of


def checked(paths: Text) -> Column:
    """The distinct paths, or an error."""
    p = _c(paths)
    return (
        F.when(F.size(p) == 0, F.raise_error(F.lit("a path set must not be empty")))
        .when(F.exists(p, lambda x: x == "") & F.exists(p, lambda x: x != ""), F.raise_error(F.lit("a path set must not mix empty and other paths")))
        .otherwise(F.array_distinct(p))
    )


def each_pair(left: Column, right: Column, score) -> Column:
    return F.flatten(F.transform(left, lambda p: F.transform(right, lambda q: score(p, q))))


def least_distance(left: Column, right: Column, most: int | None = None) -> Column:
    """With `most`, distances over it read most + 1, and their computation is banded."""
    if most is None:
        return F.array_min(each_pair(left, right, F.levenshtein))
    near = F.array_min(F.filter(each_pair(left, right, lambda p, q: F.levenshtein(p, q, most)), lambda d: d >= 0))
    return F.when(left.isNotNull() & right.isNotNull(), F.coalesce(near, F.lit(most + 1)))


def best_similarity(left: Column, right: Column) -> Column:
    return F.array_max(each_pair(left, right, lambda p, q: similarity_of(F.levenshtein(p, q), p, q)))


@F.pandas_udf(IntegerType())
def osa_sets(left: pd.Series, right: pd.Series) -> pd.Series:
    """Least adjacent-transposition distance of two sets; all pairs of a batch go through the kernel together."""
    rows = [i for i, (a, b) in enumerate(zip(left, right)) if a is not None and b is not None]
    ls, rs, at = [], [], [0]
    for i in rows:
        ls += [p for p in left[i] for _ in right[i]]
        rs += [q for _ in left[i] for q in right[i]]
        at.append(len(ls))
    out = pd.array([None] * len(left), "Int32")
    if rows and ls:
        out[rows] = np.minimum.reduceat(edit_batch(ls, rs), at[:-1])
    return pd.Series(out)


def _lattices(left: pd.Series, right: pd.Series, most: pd.Series, transpose: bool) -> pd.Series:
    known: dict[str, Lattice] = {}
    out = []
    for a, b, m in zip(left, right, most):
        if a is None or b is None:
            out.append(None)
            continue
        for x in (a, b):
            if x not in known:
                known[x] = Lattice.unpack(x)
        m = None if pd.isna(m) else int(m)
        d = lattice_distance(known[a], known[b], transpose, m)
        out.append(m + 1 if d is None and m is not None else d)
    return pd.Series(pd.array(out, "Int32"))


@F.pandas_udf(IntegerType())
def lattice_levenshtein(left: pd.Series, right: pd.Series, most: pd.Series) -> pd.Series:
    """Distance of packed lattices: for languages too large to write out. Over `most` (null: no bound) it reads most + 1."""
    return _lattices(left, right, most, False)


@F.pandas_udf(IntegerType())
def lattice_osa(left: pd.Series, right: pd.Series, most: pd.Series) -> pd.Series:
    return _lattices(left, right, most, True)


#: Strings for each pair, up to which lattices are written out to be compared with others all at once
STRINGS = 512


def lattice_scores(left: list, right: list, similarity: bool) -> list:
    """Scores of pairs of packed lattices, null where one is. Pairs are sorted by a lattice of the side with more different
    ones: where several meet the same, their strings go through it together, and other pairs are searched one by one."""
    out: list = [None] * len(left)
    rows = [i for i, (a, b) in enumerate(zip(left, right)) if a is not None and b is not None]
    if len({left[i] for i in rows}) > len({right[i] for i in rows}):
        left, right = right, left
    lattices: dict[str, Lattice] = {}
    levels: dict[str, Levels] = {}
    written: dict[str, list[str] | None] = {}
    strings: dict[tuple[str, ...], Strings | None] = {}
    groups: dict[str, list[int]] = {}
    for i in rows:
        groups.setdefault(right[i], []).append(i)

    def lattice(x: str) -> Lattice:
        if x not in lattices:
            lattices[x] = Lattice.unpack(x)
        return lattices[x]

    def leveled(x: str) -> Levels:
        if x not in levels:
            levels[x] = Levels(lattice(x), similarity)
        return levels[x]

    for b, some in groups.items():
        ask = tuple(dict.fromkeys(left[i] for i in some))
        if ask not in strings:
            for a in ask:
                if a not in written:
                    written[a] = lattice(a).paths(STRINGS)
            sets = [written[a] for a in ask]
            strings[ask] = Strings(sets) if len(ask) > 1 and all(sets) else None
        many = strings[ask]
        if many is not None and many.cells(leveled(b)) <= STRING_CELLS:
            found = dict(zip(ask, many.best(leveled(b), similarity).tolist()))
        elif similarity:
            found = {a: lattice_similarity(leveled(a), leveled(b)) for a in ask}
        else:
            found = {a: lattice_distance(lattice(a), lattice(b)) for a in ask}
        for i in some:
            out[i] = found[left[i]]
    return out


@F.pandas_udf(IntegerType())
def lattice_least(left: pd.Series, right: pd.Series) -> pd.Series:
    """Distances of packed lattices, of which many meet the same."""
    return pd.Series(pd.array(lattice_scores(left.tolist(), right.tolist(), False), "Int32"))


@F.pandas_udf(DoubleType())
def lattice_alike(left: pd.Series, right: pd.Series) -> pd.Series:
    """The largest normalized similarity of paths of packed lattices."""
    return pd.Series(lattice_scores(left.tolist(), right.tolist(), True), dtype="float64")


def over_cells(left: Column, right: Column, most: int = DISTANCE_CELLS) -> Column:
    """Whether two packed lattices have more node pairs than a kernel takes; false where one is null."""
    nodes = lambda x: F.substring_index(x, " ", 1).cast("long")
    return F.coalesce(nodes(left) * nodes(right) > most, F.lit(False))


@F.pandas_udf(ArrayType(StringType()))
def lattice_keys(lattice: pd.Series) -> pd.Series:
    return lattice.map(lambda x: None if x is None else path_keys(Lattice.unpack(x)))


@F.pandas_udf(BooleanType())
def lattices_share(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([share_path(Lattice.unpack(a), Lattice.unpack(b)) for a, b in zip(left, right)], dtype=bool)


STEP = StructType([StructField(x, StringType()) for x in ("op", "left", "right")])
TRACE = StructType([StructField("distance", IntegerType()), StructField("steps", ArrayType(STEP))])


@F.pandas_udf(TRACE)
def trace_kernel(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """The distance of two packed lattices with the steps of a best alignment."""
    rows = []
    for a, b in zip(left, right):
        if a is None or b is None:
            rows.append((None, None))
            continue
        d, steps = lattice_trace(Lattice.unpack(a), Lattice.unpack(b))
        rows.append((d, [dict(zip(("op", "left", "right"), s)) for s in steps]))
    return pd.DataFrame({"distance": pd.array([r[0] for r in rows], "Int32"), "steps": [r[1] for r in rows]})


@F.pandas_udf(StringType())
def pack_paths(paths: pd.Series) -> pd.Series:
    """The packed minimal lattice of a path set."""
    return paths.map(lambda p: None if p is None else Lattice.of_paths(list(p)).pack())


def left_of(trace: Column) -> Column:
    """The left side's path of an alignment."""
    return F.array_join(F.transform(F.filter(trace["steps"], lambda s: s["left"].isNotNull()), lambda s: s["left"]), "")


def right_of(trace: Column) -> Column:
    return F.array_join(F.transform(F.filter(trace["steps"], lambda s: s["right"].isNotNull()), lambda s: s["right"]), "")


def distance_paths(left: Text, right: Text) -> Column:
    return least_distance(checked(left), checked(right))


def damerau_distance_paths(left: Text, right: Text) -> Column:
    return osa_sets(checked(left), checked(right))


def normalized_similarity_paths(left: Text, right: Text, score_cutoff: float | None = None) -> Column:
    return apply_cutoff(best_similarity(checked(left), checked(right)), "ratio", score_cutoff)


ratio_paths = normalized_similarity_paths


def normalized_distance_paths(left: Text, right: Text, score_cutoff: float | None = None) -> Column:
    return apply_cutoff(1.0 - best_similarity(checked(left), checked(right)), "normalized_distance", score_cutoff)


def within_distance_paths(left: Text, right: Text, most: int) -> Column:
    """Stops at the first pair that is near enough."""
    most = check_cutoff(most, "distance")
    return F.exists(checked(left), lambda p: F.exists(checked(right), lambda q: F.levenshtein(p, q, most) >= 0))


def within_damerau_distance_paths(left: Text, right: Text, most: int) -> Column:
    return damerau_distance_paths(left, right) <= check_cutoff(most, "damerau_distance")
