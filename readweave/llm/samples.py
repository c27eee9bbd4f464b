"""Bounded, repeatable samples of labelled documents, on which classifiers are fitted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], *, doc_id: str = "doc_id", text: str = "text", chars: int = 20_000) -> pd.DataFrame:
    """Up to most[v] texts for each label value v, those with the smallest hashes of their ids: columns text and label,
    in a fixed order. Texts over `chars` characters are left out, so the sample has a bound in bytes too. Of rows that
    share an id, the one with the smallest text counts. Null ids, labels and texts don't take part.
    """
    parts = []
    for value, n in most.items():
        some = labels.where((F.col(label) == value) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.lit(value).alias("label")).distinct()
        parts.append(some.orderBy(F.xxhash64("id"), "id").limit(n))
    ids = parts[0]
    for p in parts[1:]:
        ids = ids.union(p)
    # at most sum(most.values()) ids
    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= chars))
    got = rows.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("text").alias("text")).toPandas()
    return got.sort_values(["id", "label", "text"], kind="stable").reset_index(drop=True)
