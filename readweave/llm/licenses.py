"""Operator 6: licence scan by diagonal voting over word k-grams. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readweave.llm.tables import table

K = 3
#: Diagonals this near (in words) belong to one span: words added or left out shift the diagonal
NEAR = 4
#: Share of a template's words that a span must hold, in percent
COVER = 80

# Base phrases, and templates of common licence notices, with their labels
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission"),
]

_APART = [chr(c) for c in [*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]]
_UPPER = [chr(c) for c in range(65, 91)]


def words(text: Column) -> Column:
    """Words of a text: runs of digits, letters a to z (A to Z lower-cased) and all characters beyond ASCII."""
    plain = F.translate(F.coalesce(text, F.lit("")), "".join(_APART + _UPPER), " " * len(_APART) + "".join(_UPPER).lower())
    return F.filter(F.split(plain, " "), lambda w: w != "")


def grams(w: Column, k: int) -> Column:
    """Rolling word k-grams: structs of place, hash and the words themselves."""
    at = lambda i: [F.get(w, i + j) for j in range(k)]
    made = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(i.alias("place"), F.xxhash64(*at(i)).alias("hash"), F.concat_ws(" ", *at(i)).alias("gram")))
    return F.when(F.size(w) >= k, made).otherwise(F.array().cast("array<struct<place:int,hash:bigint,gram:string>>"))


def templates(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]], k: int) -> DataFrame:
    """(template, label, base, n_grams, n_words, start, hash, gram): a row for each k-gram of each template, and one
    without a label that every document's closing row meets."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(i < len(phrases)).alias("base"), F.lit(text).alias("text")) for i, (label, text) in enumerate([*phrases, *notices])]
    some = spark.range(1).select(F.inline(F.array(*rows))).withColumn("w", F.split("text", " "))
    some = some.select("template", "label", "base", (F.size("w") - k + 1).alias("n_grams"), F.size("w").alias("n_words"), F.explode(grams(F.col("w"), k)).alias("g"))
    some = some.select("template", "label", "base", "n_grams", "n_words", F.col("g.place").alias("start"), "g.hash", "g.gram")
    end = spark.range(1).select(F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("n_grams"), F.lit(0).alias("n_words"), F.lit(0).alias("start"), F.xxhash64(F.lit("")).alias("hash"), F.lit("").alias("gram"))
    return some.unionByName(end)


def license_scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", phrases: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None, k: int = K, near: int = NEAR, cover: int = COVER) -> tuple[DataFrame, DataFrame]:
    """(documents, spans). Documents: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. Spans:
    doc_id, label, start, end, coverage of every verified span.

    All rolling k-grams of all texts are joined by hash to the template positions (a fixed, small table, sent to all
    executors) and must have the same words. Hits vote for diagonals (place in the text less place in the template); a
    phrase on one diagonal in full is a base place. Neighbouring diagonals of a template merge into a span, which holds
    if its hits cover `cover` percent of the template's words. score is the best coverage of any template in the text.

    Null and empty texts have no words and no labels. Rows are told apart by their place in the input: repeated and null
    ids each keep their own row. Templates of under k words are not allowed.
    """
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    if any(len(t.split()) < k for _, t in [*phrases, *notices]):
        raise ValueError(f"templates need at least {k} words")
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[doc_id].alias("doc_id"), words(docs[text]).alias("w"))
    closing = F.struct(F.size("w").alias("place"), F.xxhash64(F.lit("")).alias("hash"), F.lit("").alias("gram"))
    places = rows.select("row", "doc_id", F.explode(F.concat(grams(F.col("w"), k), F.array(closing))).alias("g"))
    places = places.select("row", "doc_id", F.col("g.place").alias("place"), "g.hash", "g.gram")
    hits = places.join(F.broadcast(templates(spark, phrases, notices, k)), ["hash", "gram"])
    # diagonals: at most as many starts as the template has
    lines = hits.groupBy("row", "doc_id", "template", "label", "base", "n_grams", "n_words", (F.col("place") - F.col("start")).alias("diagonal")).agg(F.collect_set("start").alias("starts"))
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by) > near
    lines = lines.withColumn("span", F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(by))
    full = F.col("base") & (F.size("starts") == F.col("n_grams"))
    spans = lines.groupBy("row", "doc_id", "template", "label", "base", "n_words", "span").agg(
        F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"),
        F.count(F.when(full, 1)).alias("places"), F.min(F.when(full, F.col("diagonal"))).alias("first"), F.max(F.when(full, F.col("diagonal"))).alias("last"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + k - 1)))))
    spans = spans.withColumn("covered", F.when(F.col("template") < 0, 0).otherwise(covered))
    holds = (F.col("template") >= 0) & (100 * F.col("covered") >= cover * F.col("n_words")) & (~F.col("base") | (F.col("places") > 0))
    spans = spans.withColumn("holds", holds).withColumn("coverage", F.when(F.col("n_words") > 0, F.col("covered") / F.col("n_words")).otherwise(0.0))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("template") < 0, F.col("low"))).cast("long").alias("n_words"), F.sum("places").alias("n_base"), F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        joined(F.when(F.col("places") > 0, F.col("label"))).alias("base_labels"), joined(F.when(F.col("holds"), F.col("label"))).alias("labels"), F.max("coverage").alias("score"),
    )
    found = spans.where("holds").select("doc_id", "label", (F.col("low") + F.array_min("starts")).alias("start"), (F.col("high") + F.array_max("starts") + k).alias("end"), "coverage")
    return out.drop("row"), found


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))[0]


def _values() -> str:
    rows = [(i, label, i < len(PHRASES), text) for i, (label, text) in enumerate([*PHRASES, *NOTICES])]
    return ", ".join(f"({i}, '{label}', {str(base).lower()}, '{text}')" for i, label, base, text in rows)


ORACLE_SQL = rf"""
with t as (select template, label, base, string_split(text, ' ') as w from (values {_values()}) v(template, label, base, text)),
tg as (select template, label, base, len(w) as n_words, len(w) - {K - 1} as n_grams, i - 1 as start, array_to_string(w[i:i+{K - 1}], ' ') as gram
  from (select *, unnest(range(1, len(w) - {K - 2})) as i from t)),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
g as (select doc_id, i - 1 as place, array_to_string(w[i:i+{K - 1}], ' ') as gram from (select *, unnest(range(1, len(w) - {K - 2})) as i from d)),
lines as (select doc_id, template, label, base, n_grams, n_words, place - start as diagonal, list(distinct start) as starts from g join tg using (gram) group by all),
marked as (select *, coalesce(diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) > {NEAR}, false)::int as apart from lines),
spanned as (select *, sum(apart) over (partition by doc_id, template order by diagonal) as span, base and len(starts) = n_grams as whole from marked),
spans as (select doc_id, template, label, base, n_words, span, count(*) filter (whole) as places, min(diagonal) filter (whole) as lo, max(diagonal) filter (whole) as hi,
  len(list_distinct(flatten(list(flatten(list_transform(starts, lambda s: range(s, s + {K}))))))) as covered from spanned group by all),
held as (select *, 100 * covered >= {COVER} * n_words and (not base or places > 0) as holds from spans),
found as (select doc_id, sum(places) as n_base, min(lo) as first_word, max(hi) as last_word, list_sort(list(distinct label) filter (places > 0)) as b, list_sort(list(distinct label) filter (holds)) as l, max(covered / n_words) as score from held group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(array_to_string(b, ','), '') as base_labels, coalesce(array_to_string(l, ','), '') as labels, coalesce(score, 0)::double as score
from d left join found using (doc_id)
"""
