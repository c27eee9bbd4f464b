"""The span of a text that is nearest to a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readweave.functions import paths as P
from readweave.functions import text as X
from readweave.functions.readings import Options
from readweave.operators.expand import attach, expand
from readweave.sources.lexicon import Bundle, resolve

ALIGNMENT = "struct<score:{},src_start:int,src_end:int,dest_start:int,dest_end:int>"


def check_partial(metric: str, max_span_chars: int | None) -> str:
    if type(metric) is not str or max_span_chars is not None and type(max_span_chars) is not int:
        raise TypeError("a metric is a str, and max_span_chars a whole number or None")
    if metric not in ("ratio", "distance"):
        raise ValueError(f"spans are scored by 'ratio' or 'distance', not {metric!r}")
    if max_span_chars is not None and max_span_chars < 1:
        raise ValueError(f"spans have one character at least, so max_span_chars can't be {max_span_chars}")
    return metric


def span_limit(query: Column) -> Column:
    n = F.char_length(query)
    return F.when(n == 0, 0).otherwise(F.greatest(2 * n, n + 4))


def starts(query: Column, text: Column, limit: Column) -> Column:
    """Where spans begin. The empty one alone counts where query, text or limit is empty."""
    some = (F.char_length(text) > 0) & (F.char_length(query) > 0) & (limit > 0)
    return F.when(some, F.sequence(F.lit(0), F.char_length(text) - 1)).otherwise(F.array(F.lit(0)))


def sizes(query: Column, text: Column, limit: Column, start: Column) -> Column:
    """The sizes of the spans from a start, up to the limit."""
    some = (F.char_length(text) > 0) & (F.char_length(query) > 0) & (limit > 0)
    return F.when(some, F.sequence(F.lit(1), F.least(limit, F.char_length(text) - start))).otherwise(F.array(F.lit(0)))


def _aligned(best: Column, query: Column, metric: str, cutoff: int | float | None) -> Column:
    """An alignment from the least (key, size, start)."""
    value = best["key"] if metric == "distance" else -best["key"]
    good = best.isNotNull() & (F.lit(True) if metric == "distance" else value > 0)
    if cutoff is not None:
        good = good & (value <= cutoff if metric == "distance" else value >= cutoff)
    made = F.struct(value.alias("score"), F.lit(0).alias("src_start"), F.char_length(query).alias("src_end"), best["start"].alias("dest_start"), (best["start"] + best["size"]).alias("dest_end"))
    return F.when(good, made.cast(ALIGNMENT.format("int" if metric == "distance" else "double")))


def partial_alignment(df: DataFrame, query: str, text: str, metric: str = "ratio", *, lang: str | None = None, lexicon: DataFrame | Bundle | None = None, options: Options | None = None, score_cutoff: int | float | None = None, max_span_chars: int | None = None, out: str = "alignment") -> DataFrame:
    """Add the struct `out` (score, src_start, src_end, dest_start, dest_end), or null where no span counts.

    Of equal scores, the shortest span counts, then the first. Similarities of 0 don't count. Plain strings are scored
    within the row, in the JVM. Through readings, the distinct spans of all rows are expanded once; spans that can't be
    read are skipped (one with a kana that has no spelling is an error, as is such a query), and so are, for distances,
    spans that have nothing in common with the query.
    """
    check_partial(metric, max_span_chars)
    cutoff = X.check_cutoff(score_cutoff, "distance" if metric == "distance" else "ratio")
    q, t = F.col(query), F.col(text)
    limit = F.lit(max_span_chars) if max_span_chars is not None else span_limit(q)
    if lang is None and lexicon is None:

        def scored(start: Column, size: Column) -> Column:
            span = F.substring(t, start + 1, size)
            d = F.levenshtein(q, span)
            return F.struct((d if metric == "distance" else -X.similarity_of(d, q, span)).alias("key"), size.alias("size"), start.alias("start"))

        # the spans of one start at a time: memory follows the text, not the text times the limit
        best = F.array_min(F.transform(starts(q, t, limit), lambda s: F.array_min(F.transform(sizes(q, t, limit, s), lambda k: scored(s, k)))))
        return df.withColumn(out, F.when(q.isNotNull() & t.isNotNull(), _aligned(best, q, metric, cutoff)))

    lang, words, options = resolve(lang, lexicon, options)
    rows = df.select(q.alias("_pq"), t.alias("_pt")).where("_pq is not null and _pt is not null").distinct()
    asked = attach(rows, "_pq", expand(rows, words, lang, options, text="_pq", lattices=False), "_q")
    asked = asked.withColumn("_paths", F.when(F.col("_q.paths_error").isNotNull(), F.raise_error(F.col("_q.paths_error")).cast("array<string>")).otherwise(F.col("_q.paths")))
    longest = F.array_max(F.transform("_paths", lambda p: F.char_length(p)))
    limit = F.lit(max_span_chars) if max_span_chars is not None else F.greatest(span_limit(F.col("_pq")), longest)
    each = asked.withColumn("_limit", limit)
    of = (F.col("_pq"), F.col("_pt"), F.col("_limit"))
    each = each.withColumn("start", F.explode(starts(*of))).withColumn("size", F.explode(sizes(*of, F.col("start"))))
    each = each.select("_pq", "_pt", "_paths", "start", "size", F.substring(F.col("_pt"), F.col("start") + 1, F.col("size")).alias("span"))
    each = attach(each, "span", expand(each, words, lang, options, text="span", lattices=False), "_s")
    bad = F.col("_s.paths_error").isNotNull() & ~F.col("_s.unsupported")
    each = each.withColumn("_span_paths", F.when(bad, F.raise_error(F.col("_s.paths_error")).cast("array<string>")).otherwise(F.col("_s.paths"))).where("_span_paths is not null")
    alike = F.greatest(F.lit(0.0), P.best_similarity(F.col("_paths"), F.col("_span_paths")))
    each = each.withColumn("alike", alike).where("alike > 0")
    key = P.least_distance(F.col("_paths"), F.col("_span_paths")) if metric == "distance" else -F.col("alike")
    best = each.groupBy("_pq", "_pt").agg(F.min(F.struct(key.alias("key"), "size", "start")).alias("_best"))
    joined = df.join(best, (df[query] == best["_pq"]) & (df[text] == best["_pt"]), "left").drop("_pq", "_pt")
    return joined.withColumn(out, _aligned(F.col("_best"), F.col(query), metric, cutoff)).drop("_best")


def partial_ratio(df: DataFrame, query: str, text: str, *, out: str = "score", **how) -> DataFrame:
    """The best similarity of a span, or 0.0."""
    rows = partial_alignment(df, query, text, "ratio", out="_a", **how)
    return rows.withColumn(out, F.when(F.col(query).isNotNull() & F.col(text).isNotNull(), F.coalesce(F.col("_a.score"), F.lit(0.0)))).drop("_a")


def partial_distance(df: DataFrame, query: str, text: str, *, score_cutoff: int | None = None, out: str = "score", **how) -> DataFrame:
    """The least distance of a span. Where none counts: the cutoff and one, or without a cutoff the query's length."""
    rows = partial_alignment(df, query, text, "distance", score_cutoff=score_cutoff, out="_a", **how)
    miss = F.char_length(query) if score_cutoff is None else F.lit(score_cutoff + 1)
    return rows.withColumn(out, F.when(F.col(query).isNotNull() & F.col(text).isNotNull(), F.coalesce(F.col("_a.score"), miss))).drop("_a")
