"""Scores of pairs, plain or through readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readweave.functions import paths as P
from readweave.functions import text as X
from readweave.functions.kernels import TRACE_CELLS
from readweave.functions.readings import Options
from readweave.operators.expand import attach, expand
from readweave.sources.lexicon import Bundle, resolve


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind those that the table has already."""
    out = []
    for x in names:
        while x in df.columns or x in out:
            x += "_"
        out.append(x)
    return out


#: Pairs of written paths up to which their distances are taken one by one
PATH_PAIRS = 4096


def few_pairs(a: Column, b: Column) -> Column:
    """Whether both expansions have written paths, with few pairs of them, or no lattices that a kernel could take."""
    written = a["lattice_paths"].isNotNull() & b["lattice_paths"].isNotNull()
    few = F.size(a["lattice_paths"]) * F.size(b["lattice_paths"]) <= PATH_PAIRS
    return F.coalesce(written & (few | a["lattice"].isNull() | b["lattice"].isNull()), F.lit(False))


#: Path pairs over which similarities of one pair of texts go to the lattice kernel
ALIKE_PAIRS = 64


def kernel_pairs(left: str, right: str, metric: str, few: int) -> Column:
    """Whether the lattice kernels take a pair of expansions: both have lattices that are small enough, and more than `few`
    pairs of written paths, or too many paths to write them."""
    a, b = (kernel_lattice(x, metric) for x in (left, right))
    paths = "paths" if metric not in X.DISTANCES else "lattice_paths"
    return F.coalesce(a.isNotNull() & b.isNotNull() & ~P.over_cells(a, b) & F.coalesce(F.size(F.col(left)[paths]) * F.size(F.col(right)[paths]) > few, F.lit(True)), F.lit(False))


def kernel_lattice(name: str, metric: str) -> Column:
    r = F.col(name)
    return F.coalesce(r["packed"], r["lattice"]) if metric in X.DISTANCES else r["packed"]


def lattice_score(left: str, right: str, transpose: bool = False, most: int | None = None, few: int | None = None) -> Column:
    """Least distance of the two lattices (struct columns of expansions). Sets that are written out and have few pairs are
    scored in the JVM, and only the rest goes to the lattice kernel; pairs beyond its limit are null. With `most`, searches
    end there, and distances over it read most + 1. With `few`, sets of more than so many pairs (without transpositions) go
    to the kernel that takes pairs of one text together, and `most` doesn't end it."""
    a, b = F.col(left), F.col(right)
    both = few_pairs(a, b)
    if few is not None and not transpose:
        some = kernel_pairs(left, right, "distance", few) & (both | ~P.over_cells(a["lattice"], b["lattice"]))
        x, y = (kernel_lattice(c, "distance") for c in (left, right))
        return F.when(some, P.lattice_least(F.when(some, x), F.when(some, y))).when(both, P.least_distance(a["lattice_paths"], b["lattice_paths"], most))
    large = ~both & a["lattice"].isNotNull() & b["lattice"].isNotNull() & ~P.over_cells(a["lattice"], b["lattice"])
    kernel = (P.lattice_osa if transpose else P.lattice_levenshtein)(F.when(large, a["lattice"]), F.when(large, b["lattice"]), F.lit(most).cast("int"))
    small = P.osa_sets(F.when(both, a["lattice_paths"]), F.when(both, b["lattice_paths"])) if transpose else P.least_distance(a["lattice_paths"], b["lattice_paths"], most)
    return F.when(both, small).otherwise(kernel)


def reading_score(left: str, right: str, left_text: str, right_text: str, metric: str, most: int | None = None, few: int | None = None) -> Column:
    """A metric of two expansions, before cutoffs; distances over `most` may read anything over it. Pairs with more than
    `few` path pairs go to the kernel that takes pairs of one text together; similarities always do, over a bound."""
    if metric == "distance":
        return lattice_score(left, right, most=most, few=few)
    if metric == "damerau_distance":
        return lattice_score(left, right, transpose=True, most=most)
    if metric == "combined_distance":
        lped = lattice_score(left, right, most=most)
        return F.when(lped.isNotNull(), F.least(X.osa(left_text, right_text), lped))
    # the largest over path pairs; an impossible pair counts 0
    some = kernel_pairs(left, right, metric, ALIKE_PAIRS if few is None else few)
    a, b = kernel_lattice(left, metric), kernel_lattice(right, metric)
    best = F.greatest(F.lit(0.0), P.best_similarity(F.col(left)["paths"], F.col(right)["paths"]))
    best = F.when(some, P.lattice_alike(F.when(some, a), F.when(some, b))).when(F.col(left)["paths"].isNotNull() & F.col(right)["paths"].isNotNull(), best)
    return 1.0 - best if metric == "normalized_distance" else best


def reading_error(left: str, right: str, metric: str) -> Column:
    a, b = F.col(left), F.col(right)
    if metric not in X.DISTANCES:
        return F.coalesce(a["paths_error"], b["paths_error"])
    return F.coalesce(a["error"], b["error"], F.when(~few_pairs(a, b) & P.over_cells(a["lattice"], b["lattice"]), F.lit("the two lattices have too many node pairs")))


def checked_error(score: Column, error: Column, on_error: str) -> Column:
    if on_error not in ("null", "raise"):
        raise ValueError("on_error must be 'null' or 'raise'")
    return score if on_error == "null" else F.when(error.isNotNull(), F.raise_error(error)).otherwise(score)


def with_readings(df: DataFrame, columns: list[str], lang: str, lexicon: DataFrame, options: Options, metric: str = "distance") -> tuple[DataFrame, list[str]]:
    """Expand the distinct texts of all columns once, as the metric needs it, and attach the expansions: the table, and
    their columns' names."""
    texts = df.select(F.col(columns[0]).alias("text"))
    for c in columns[1:]:
        texts = texts.union(df.select(F.col(c)))
    e = expand(texts, lexicon, lang, options, **needed(metric))
    names = unused(df, *(f"_r{i}" for i in range(len(columns))))
    for c, name in zip(columns, names):
        df = attach(df, c, e, name)
    return df, names


def needed(metric: str) -> dict[str, bool]:
    """What a metric takes of expansions: distances go by lattices, similarities by written paths."""
    return {"lattices": metric in X.DISTANCES, "paths": metric not in X.DISTANCES, "packed": metric not in X.DISTANCES}


def new_columns(df: DataFrame, *names: str) -> None:
    """An error where a result's column would take the place of one of the table."""
    if taken := sorted(set(names) & set(df.columns)):
        raise ValueError(f"the table has columns named {', '.join(taken)}; name the result's otherwise")


def score(df: DataFrame, left: str, right: str, metric: str = "distance", *, lang: str | None = None, lexicon: DataFrame | Bundle | None = None, options: Options | None = None, score_cutoff: int | float | None = None, on_error: str = "null", out: str = "score", error_out: str = "error") -> DataFrame:
    """Add `out` to pairs. With a language or a lexicon, texts are compared through their readings, and `error_out` tells
    why a score is null (with on_error="raise" the first such text fails the query). Null texts give null scores. Columns
    of these names in the table are an error."""
    X.check_metric(metric)
    X.check_cutoff(score_cutoff, metric)
    new_columns(df, out)
    if lang is None and lexicon is None:
        if options is not None:
            raise ValueError("reading options need a language or a lexicon")
        return df.withColumn(out, X.plain(metric)(left, right, score_cutoff))
    new_columns(df, error_out)
    lang, words, options = resolve(lang, lexicon, options)
    rows, (a, b) = with_readings(df, [left, right], lang, words, options, metric)
    error = reading_error(a, b, metric)
    most = score_cutoff if metric in X.DISTANCES else None
    value = X.apply_cutoff(reading_score(a, b, left, right, metric, most), metric, score_cutoff)
    return rows.withColumn(out, checked_error(value, error, on_error)).withColumn(error_out, error).drop(a, b)


def within(df: DataFrame, left: str, right: str, most: int, metric: str = "distance", *, out: str = "within", **how) -> DataFrame:
    """Whether a distance is at most `most`."""
    if metric not in ("distance", "damerau_distance"):
        raise ValueError("within takes distance or damerau_distance")
    X.check_cutoff(most, metric)
    return score(df, left, right, metric, out=out, **how).withColumn(out, F.col(out) <= most)


def compare(df: DataFrame, left: str, right: str, *, lang: str | None = None, lexicon: DataFrame | Bundle | None = None, options: Options | None = None, on_error: str = "null", out: str = "comparison") -> DataFrame:
    """Add a struct of five distances: surface_levenshtein, surface_damerau, lattice, lattice_damerau, combined."""
    new_columns(df, out, "error")
    lang, words, options = resolve(lang, lexicon, options)
    rows, (a, b) = with_readings(df, [left, right], lang, words, options)
    error = reading_error(a, b, "distance")
    lped, surface, lattice = unused(rows, "_lped", "_osa", "_lattice_osa")
    rows = rows.withColumn(lped, checked_error(lattice_score(a, b), error, on_error)).withColumn(surface, X.osa(left, right)).withColumn(lattice, lattice_score(a, b, transpose=True))
    made = F.struct(X.levenshtein(left, right).alias("surface_levenshtein"), F.col(surface).alias("surface_damerau"), F.col(lped).alias("lattice"), F.col(lattice).alias("lattice_damerau"), F.least(surface, lped).alias("combined"))
    return rows.withColumn(out, F.when(error.isNull() & F.col(lped).isNotNull(), made)).withColumn("error", error).drop(a, b, lped, surface, lattice)


def align(df: DataFrame, left: str, right: str, *, lang: str | None = None, lexicon: DataFrame | Bundle | None = None, options: Options | None = None, on_error: str = "null", out: str = "trace") -> DataFrame:
    """Add the struct `out`: the readings' distance, and the steps (op, left, right) of a best alignment."""
    new_columns(df, out, "error")
    lang, words, options = resolve(lang, lexicon, options)
    rows, (a, b) = with_readings(df, [left, right], lang, words, options)
    packed = lambda r: F.coalesce(F.col(r)["lattice"], P.pack_paths(F.col(r)["lattice_paths"]))
    over = P.over_cells(packed(a), packed(b), TRACE_CELLS)
    error = F.coalesce(reading_error(a, b, "distance"), F.when(over, F.lit("the two lattices have too many node pairs")))
    made = F.when(packed(a).isNotNull() & packed(b).isNotNull() & ~over, P.trace_kernel(F.when(~over, packed(a)), packed(b)))
    return rows.withColumn(out, checked_error(made, error, on_error)).withColumn("error", error).drop(a, b)


def zero_distance_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, *, lang: str, lexicon: DataFrame | Bundle | None = None, options: Options | None = None) -> DataFrame:
    """Pairs of rows that share a spelling: a hash join on spellings instead of the product of both sides.

    Texts over the limits of written-out spellings meet others by the first character and length of a spelling, and
    their lattices decide.
    """
    lang, words, options = resolve(lang, lexicon, options)
    a, b = (expand(df, words, lang, options, text=on).select(F.col("text").alias(f"_{name}"), "paths", F.col("lattice").alias(f"_{name}_lattice")) for df, on, name in ((left, left_on, "left"), (right, right_on, "right")))

    def spelled(e: DataFrame, name: str) -> DataFrame:
        return e.select(f"_{name}", F.explode("paths").alias("_spelling"))

    pairs = spelled(a, "left").join(spelled(b, "right"), "_spelling").select("_left", "_right").distinct()
    if lang == "ja":  # others have no lattices, and no limits

        def keyed(e: DataFrame, name: str) -> DataFrame:
            e = e.where(F.col(f"_{name}_lattice").isNotNull())
            return e.select(f"_{name}", f"_{name}_lattice", F.explode(P.lattice_keys(f"_{name}_lattice")).alias("_key"))

        over = F.col("paths").isNull()
        some = keyed(a.where(over), "left").join(keyed(b, "right"), "_key").unionByName(keyed(a.where(~over), "left").join(keyed(b.where(over), "right"), "_key"))
        some = some.dropDuplicates(["_left", "_right"]).where(P.lattices_share("_left_lattice", "_right_lattice"))
        pairs = pairs.union(some.select("_left", "_right"))
    return left.join(pairs, left[left_on] == pairs["_left"]).join(right, pairs["_right"] == right[right_on]).drop("_left", "_right")
