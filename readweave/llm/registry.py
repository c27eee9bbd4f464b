"""Queries of the subpackage, for __spark_entry__.py; `oracles` has DuckDB SQL where SQL can express a query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readweave.llm import contamination, idfile, katz, licenses, neardup, packing, quality, substrings, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": contamination.op1_decontamination,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_katz_scores": katz.op3_katz_scores,
        "op4_substring_dedup": substrings.op4_substring_dedup,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_near_duplicates": neardup.op7_near_duplicates,
        "op8_warc": warc.op8_warc,
        "op9_token_ids": idfile.op9_token_ids,
        "op10_packing": packing.op10_packing,
    }


def oracles() -> dict[str, str]:
    return {
        "op1_decontamination": contamination.ORACLE_SQL,
        "op4_substring_dedup": substrings.ORACLE_SQL,
        "op6_license_scan": licenses.ORACLE_SQL,
        "op7_near_duplicates": neardup.ORACLE_SQL,
        "op8_warc": warc.ORACLE_SQL,
    }
