"""Readings of many texts: substrings meet the lexicon in a join, and each distinct text is expanded once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readweave.functions import paths as P
from readweave.functions import readings as R
from readweave.functions import text as X
from readweave.functions import scripts
from readweave.functions.kernels import Lattice, LatticeError
from readweave.functions.readings import Options
from readweave.functions.romaji import OverLimit, ReadingError, Unsupported

#: Lattices with this many strings at most are also written out
WRITTEN = 512
#: Characters of written spellings up to which they are also packed as their smallest lattice
PACKED_CHARS = 1_000_000

EXPANSION = "lattice string, lattice_paths array<string>, paths array<string>, packed string, error string, paths_error string, unsupported boolean"
_PATH = "array<struct<joined_reading:string,segments:array<struct<surface:string,reading:string,source:string>>>>"


def substrings(text: Column, longest: int) -> Column:
    """All distinct substrings of up to `longest` characters, the whole text, and each run of ASCII letters and digits."""
    n = F.char_length(text)
    some = F.transform(F.sequence(F.lit(1), n), lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), n - s + 1)), lambda size: F.substring(text, s, size)))
    return F.when(n > 0, F.array_distinct(F.concat(F.flatten(some), F.array(text), F.regexp_extract_all(text, F.lit("([0-9A-Za-z]+)"), F.lit(1))))).otherwise(F.array().cast("array<string>"))


def lookups(texts: DataFrame, lexicon: DataFrame, lang: str, options: Options) -> DataFrame:
    """(text, hits): the readings of each text's substrings. Japanese surfaces that the lexicon lacks are also looked up
    in plain width. Texts without hits stay. Catalyst broadcasts a small lexicon and shuffles by surface for a large one.
    """
    spans = texts.select("text", F.explode(substrings(F.col("text"), options.max_span_chars)).alias("span"))
    keys = F.array(F.struct(F.col("span").alias("key"), F.lit(0).alias("rank")))
    if lang == "ja":
        folded = F.array(F.struct(scripts.fold_width("span").alias("key"), F.lit(1).alias("rank")))
        keys = F.concat(keys, F.when(scripts.fold_width("span") != F.col("span"), folded).otherwise(F.filter(folded, lambda _: F.lit(False))))
    spans = spans.select("text", "span", F.explode(keys).alias("k")).select("text", "span", "k.key", "k.rank")
    words = lexicon.select(F.col("surface").alias("key"), "readings")
    hits = spans.join(words, "key").groupBy("text").agg(F.collect_list(F.struct("span", "rank", "readings")).alias("hits"))
    return texts.join(hits, "text", "left")


def _finder(hits) -> R.Find:
    found: dict[str, tuple[int, list[str]]] = {}
    for h in hits if hits is not None else ():
        h = h.asDict() if hasattr(h, "asDict") else h
        if h["span"] not in found or h["rank"] < found[h["span"]][0]:
            found[h["span"]] = h["rank"], list(h["readings"])
    return lambda s: found[s][1] if s in found else None


def smallest(paths: list[str] | None) -> str | None:
    """The packed minimal lattice of written paths, where they have one and don't have very many characters."""
    if not paths or ("" in paths and len(set(paths)) > 1) or sum(map(len, paths)) > PACKED_CHARS:
        return None
    return Lattice.of_paths(paths).pack()


def expand(texts: DataFrame, lexicon: DataFrame, lang: str, options: Options, *, text: str = "text", lattices: bool = True, paths: bool = True, packed: bool = False) -> DataFrame:
    """One row for each distinct text: its packed lattice, the lattice's strings (null where there are many), the written
    paths, and errors. With `packed` also the smallest lattice of the strings, or else of the paths (null where they have
    very many characters). `unsupported` tells texts that have characters beyond reach from those over a limit. Lattices or
    paths that aren't asked for are null and not computed."""
    want_lattices, want_paths = lattices, paths
    distinct = texts.select(F.col(text).alias("text")).where("text is not null").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t, hits in zip(batch["text"], batch["hits"]):
                find = _finder(hits)
                lattice = strings = paths = error = paths_error = None
                unsupported = False
                try:
                    if not want_lattices and lang == "ja":
                        pass
                    elif lang == "ja":
                        lat = R.ja_lattice(t, find, options)
                        lattice, strings = lat.pack(), lat.paths(WRITTEN)
                    else:
                        strings = R.zh_paths(t, find, options)
                except (ReadingError, LatticeError) as e:
                    error = str(e)
                try:
                    paths = strings if lang == "zh" else R.ja_paths(t, find, options) if want_paths else None
                    if lang == "zh" and strings is None:
                        paths_error, unsupported = error, True
                except ReadingError as e:
                    paths_error, unsupported = str(e), isinstance(e, Unsupported) and not isinstance(e, OverLimit)
                rows.append((t, lattice, strings, paths, smallest(strings if want_lattices else paths) if packed else None, error, paths_error, unsupported))
            yield pd.DataFrame(rows, columns=["text", "lattice", "lattice_paths", "paths", "packed", "error", "paths_error", "unsupported"])

    # looking up and spelling out texts take far longer than their few bytes tell an adaptive plan, which would join the
    # partitions
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lookups(distinct.repartition(parts), lexicon, lang, options).repartition(parts)
    return dealt.mapInPandas(run, f"text string, {EXPANSION}")


def attach(df: DataFrame, column: str, expansion: DataFrame, name: str) -> DataFrame:
    """Add a text's expansion as the struct `name`. A text without one (null) gets a null."""
    packed = expansion.select(F.col("text").alias(f"_{name}"), F.struct(*[c for c in expansion.columns if c != "text"]).alias(name))
    return df.join(packed, df[column] == packed[f"_{name}"], "left").drop(f"_{name}")


def reading_paths(texts: DataFrame, lexicon: DataFrame, lang: str, options: Options | None = None, *, text: str = "text", hybrid: bool = False) -> DataFrame:
    """(text, paths, stats): each distinct text's segmentations with their counters. With `hybrid`, runs that can be read
    as they are may stand beside lexicon surfaces."""
    options = options or Options()
    distinct = texts.select(F.col(text).alias("text")).where("text is not null").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t, hits in zip(batch["text"], batch["hits"]):
                some, stats = R.segmentations(t, _finder(hits), options, lang, hybrid)
                rows.append((t, [{"joined_reading": p.reading, "segments": [dict(zip(("surface", "reading", "source"), s)) for s in p.segments]} for p in some], {k: stats[k] for k in R.STATS}))
            yield pd.DataFrame(rows, columns=["text", "paths", "stats"])

    stats = ",".join(f"{k}:bigint" for k in R.STATS)
    return lookups(distinct, lexicon, lang, options).mapInPandas(run, f"text string, paths {_PATH}, stats struct<{stats}>")


def with_overrides(texts: DataFrame, exceptions: DataFrame, *, text: str = "text") -> DataFrame:
    """(text, paths): spellings of the readings that an override gives for the whole text, else of the text itself."""
    rows = texts.select(F.col(text).alias("text")).where("text is not null").distinct()
    rows = rows.join(exceptions.select(F.col("surface").alias("text"), "readings"), "text", "left")
    rows = rows.withColumn("reading", F.explode(F.coalesce("readings", F.array("text"))))
    spelled = rows.withColumn("spelled", scripts.romaji_paths("reading"))
    return spelled.groupBy("text").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spelled")))).alias("paths"))


def compare_with_overrides(df: DataFrame, left: str, right: str, exceptions: DataFrame, *, out: str = "comparison") -> DataFrame:
    """Add a struct of five distances, as `compare` does, of texts that are read by overrides or as they are. Null where
    a text has no spelling."""
    texts = df.select(F.col(left).alias("text")).union(df.select(F.col(right)))
    spelled = with_overrides(texts, exceptions)
    for c, name in ((left, "_o0"), (right, "_o1")):
        df = df.join(spelled.select(F.col("text").alias(f"{name}_text"), F.col("paths").alias(name)), F.col(c) == F.col(f"{name}_text"), "left").drop(f"{name}_text")
    both = (F.size("_o0") > 0) & (F.size("_o1") > 0)
    a, b = F.when(both, F.col("_o0")), F.when(both, F.col("_o1"))
    df = df.withColumn("_lped", P.least_distance(a, b)).withColumn("_losa", P.osa_sets(a, b)).withColumn("_sosa", X.osa(left, right))
    made = F.struct(X.levenshtein(left, right).alias("surface_levenshtein"), F.col("_sosa").alias("surface_damerau"), F.col("_lped").alias("lattice"), F.col("_losa").alias("lattice_damerau"), F.least("_sosa", "_lped").alias("combined"))
    return df.withColumn(out, F.when(F.col("_lped").isNotNull(), made)).drop("_o0", "_o1", "_lped", "_losa", "_sosa")
