"""A training-corpus pipeline of five operators: quality rules, near-duplicate and substring removal, benchmark
decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept. All but the last return
the columns of `documents`; `n_chars` follows where a stage changes texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readweave.llm import contamination, neardup, packing, quality, substrings
from readweave.llm.tables import clear, stash, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the line field, which is fitted on the labelled ones among `documents`."""
    crf = quality.fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_quality(docs, crf)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id. Rows without an id, or without words, stay."""
    groups = neardup.near_duplicates(docs.select("doc_id", "text"), percent=80)
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 20-word windows that start earlier in the corpus; `n_chars` is the length of what stays."""
    cut = substrings.remove_repeats(docs)
    return cut.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 80 % of its shingles."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids in windows of 2048."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can't decode the line field or run the tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written to the shared folder and read again by the next. What a stage wrote besides
    goes once its result is written, and so does the result of the stage before."""
    docs, mark = table(spark, sf_dir, "documents"), written()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, name.replace(" ", "-"))
            clear(spark, docs, since=mark)
    return docs
