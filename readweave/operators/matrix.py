"""Score matrices of queries and choices, in long format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readweave.functions import text as X
from readweave.functions.readings import Options
from readweave.operators.expand import attach, expand
from readweave.operators.scoring import checked_error, needed, new_columns, reading_error, reading_score, unused
from readweave.sources.lexicon import Bundle, resolve


def cdist(queries: DataFrame, choices: DataFrame, query: str = "query", choice: str = "choice", metric: str = "distance", *, lang: str | None = None, lexicon: DataFrame | Bundle | None = None, options: Options | None = None, score_cutoff: int | float | None = None, on_error: str = "null") -> DataFrame:
    """Every query with every choice, and `score`. A cutoff replaces scores and never drops cells; an empty side gives no
    rows. Columns of the choices whose names the queries have too get `_choice` behind them, and the query's and the
    choice's own columns must differ in name (a column of the queries that is named like the choice gets `_query`).

    With readings, each distinct text of a side is expanded once, before the product, and each pair of distinct texts is
    scored once, whatever number of rows has them. Catalyst broadcasts the smaller side where its size is known to be small,
    and otherwise deals out a Cartesian product of partitions.
    """
    X.check_metric(metric)
    X.check_cutoff(score_cutoff, metric)
    if query == choice:
        raise ValueError("the query's and the choice's column must have different names")
    if query in choices.columns:
        choices = choices.withColumnRenamed(query, f"{query}_choice")
    choices = choices.select(*[F.col(f"`{c}`").alias(f"{c}_choice" if c in queries.columns and c != choice else c) for c in choices.columns])
    if choice in queries.columns:
        queries = queries.withColumnRenamed(choice, f"{choice}_query")
    new_columns(queries, "score", "error")
    new_columns(choices, "score", "error")
    if lang is None and lexicon is None:
        return queries.crossJoin(choices).withColumn("score", X.plain(metric)(query, choice, score_cutoff))
    lang, words, options = resolve(lang, lexicon, options)
    a, b, rows_a, rows_b = unused(queries.crossJoin(choices), "_r0", "_r1", "_rows0", "_rows1")
    asked, offered = by_text(queries, query, rows_a), by_text(choices, choice, rows_b)
    how = needed(metric) | {"packed": metric not in X.DISTANCES or metric == "distance"}
    asked = attach(asked, query, expand(queries, words, lang, options, text=query, **how), a)
    offered = attach(offered, choice, expand(choices, words, lang, options, text=choice, **how), b)
    # choices are dealt out, since scores take far longer than their few bytes tell an adaptive plan; the pairs of a choice
    # follow each other
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = offered.repartition(parts).crossJoin(asked)
    error = reading_error(a, b, metric)
    most = score_cutoff if metric in X.DISTANCES else None
    value = X.apply_cutoff(reading_score(a, b, query, choice, metric, most, PAIRS), metric, score_cutoff)
    scored = pairs.select(query, choice, rows_a, rows_b, checked_error(value, error, on_error).alias("score"), error.alias("error"))
    one = lambda c, own, rows: F.col(rows)[c].alias(c) if c != own else F.col(own)
    scored = scored.withColumn(rows_a, F.explode(rows_a)).withColumn(rows_b, F.explode(rows_b))
    return scored.select(*[one(c, query, rows_a) for c in queries.columns], *[one(c, choice, rows_b) for c in choices.columns], "score", "error")


#: Path pairs over which pairs of a matrix go to the lattice kernel, which takes the many that meet one text together
PAIRS = 4
#: Rows of a text that stand together, about
ROWS = 1000


def by_text(df: DataFrame, text: str, rows: str) -> DataFrame:
    """(text, rows): each distinct text with its rows as an array of structs of the other columns. Of a text that many rows
    have, shares of about a thousand stand in rows of their own; rows that are alike stay together."""
    others = [c for c in df.columns if c != text]
    packed = df.select(F.col(f"`{text}`"), F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias(unused(df, "_")[0])).alias(rows))
    size, share = unused(packed, "_size", "_share")
    hashed = [F.col(rows)[f.name] for f in df.schema if f.name != text and "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    sizes = packed.groupBy(text).agg(F.count(F.lit(1)).alias(size)).where(F.col(size) > ROWS).withColumnRenamed(text, f"{size}_text")
    dealt = packed.join(sizes, packed[text].eqNullSafe(sizes[f"{size}_text"]), "left")
    dealt = dealt.withColumn(share, F.pmod(F.xxhash64(*hashed, F.lit(0)), F.ceil(F.coalesce(F.col(size), F.lit(1)) / F.lit(ROWS))))
    return dealt.groupBy(text, share).agg(F.collect_list(rows).alias(rows)).select(text, rows)


#: Strings up to this length meet by their spellings with deletions, for up to this many edits
SHORT, FEW = 64, 2


def without(text: Column, edits: int) -> Column:
    """The distinct strings that up to `edits` deletions leave of a text."""
    out = F.array(text)
    for _ in range(edits):
        cut = lambda t: F.transform(F.sequence(F.lit(1), F.char_length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.char_length(t))))  # noqa: E731, B023
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(F.filter(out, lambda t: F.char_length(t) > 0), cut))))
    return out


def within_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, most: int) -> DataFrame:
    """Pairs of plain strings at a Levenshtein distance of at most `most`, without the product of both sides.

    Strings of up to 64 characters, for at most two edits, meet by what deletions leave of them: two strings within
    `most` edits become one by at most so many deletions on each side, and such keys are nearly as selective as whole
    strings, whatever strings have in common. Longer strings, or more edits, meet by segments: a string that is cut into
    most+1 of them keeps one whole in any string so near, shifted by at most `most`. Segments that many strings share
    bring their product, which is dealt out by the hash of the left string. The distance decides.
    """
    X.check_cutoff(most, "distance")
    ls = left.select(F.col(left_on).alias("_l")).where("_l is not null").distinct()
    rs = right.select(F.col(right_on).alias("_r")).where("_r is not null").distinct()
    short = lambda c: (F.char_length(c) <= SHORT) & F.lit(most <= FEW)
    # a string near a short one has at most `most` characters more
    near = lambda c: (F.char_length(c) <= SHORT + most) & F.lit(most <= FEW)
    keyed = lambda df, c: df.select(c, F.explode(F.transform(without(F.col(c), most), lambda v: F.xxhash64(v))).alias("k"))
    pairs = keyed(ls.where(short("_l")), "_l").join(keyed(rs.where(near("_r")), "_r"), "k").select("_l", "_r")
    pairs = pairs.union(by_segments(ls.where(~short("_l")), rs, most))
    pairs = pairs.distinct().withColumn("distance", F.levenshtein("_l", "_r", most)).where("distance >= 0")
    return left.join(pairs, left[left_on] == pairs["_l"]).join(right, pairs["_r"] == right[right_on]).drop("_l", "_r")


#: Rows of the left side for each share of a segment that many strings have
SHARE = 1000


def by_segments(ls: DataFrame, rs: DataFrame, most: int) -> DataFrame:
    """Candidate pairs (_l, _r) that share a segment by length and place."""
    n = F.char_length
    k = most + 1
    bound = lambda size, i: F.floor(size * i / k).cast("int")

    def piece(text, size, i, shift):
        return F.struct(size.alias("size"), i.alias("part"), F.substring(text, bound(size, i) + shift + 1, bound(size, i + 1) - bound(size, i)).alias("piece"))

    parts = F.sequence(F.lit(0), F.lit(most))
    left = ls.select("_l", F.explode(F.transform(parts, lambda i: piece(F.col("_l"), n("_l"), i, 0))).alias("k"))
    # a right string looks for left strings of each near length, each part at each near shift
    sizes = F.sequence(F.greatest(F.lit(0), n("_r") - most), n("_r") + most)

    def pieces(size):
        some = F.transform(parts, lambda i: F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda d: F.when(bound(size, i) + d >= 0, piece(F.col("_r"), size, i, d))))
        return F.filter(F.flatten(some), lambda x: x.isNotNull())

    right = rs.select("_r", F.explode(F.array_distinct(F.flatten(F.transform(sizes, pieces)))).alias("k"))
    shares = left.groupBy("k").agg(F.ceil(F.count("*") / F.lit(SHARE)).cast("int").alias("shares"))
    left = left.join(shares, "k").withColumn("share", F.pmod(F.xxhash64("_l"), F.col("shares")).cast("int")).select("k", "share", "_l")
    right = right.join(shares, "k").select("k", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "_r")
    return left.join(right, ["k", "share"]).select("_l", "_r")
