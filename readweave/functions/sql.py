"""The scores for SQL: expressions as temporary SQL functions that Catalyst inlines, kernels as registered functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from readweave.functions import paths, scripts, text

_MACROS = {
    "rw_distance(l string, r string) returns int": "levenshtein(l, r)",
    "rw_similarity(l string, r string) returns double": "case when greatest(char_length(l), char_length(r)) = 0 then 1.0D else greatest(0.0D, 1.0D - levenshtein(l, r) / greatest(char_length(l), char_length(r))) end",
    "rw_normalized_distance(l string, r string) returns double": "1.0D - rw_similarity(l, r)",
    "rw_within(l string, r string, most int) returns boolean": "levenshtein(l, r) <= most",
    "rw_distance_paths(l array<string>, r array<string>) returns int": "array_min(flatten(transform(l, p -> transform(r, q -> levenshtein(p, q)))))",
}


def register(spark: SparkSession) -> None:
    """rw_distance, rw_similarity, rw_normalized_distance, rw_within, rw_distance_paths, rw_osa, rw_osa_paths,
    rw_romaji_paths, rw_can_spell in this session."""
    for head, body in _MACROS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    for name, kernel in {"rw_osa": text.osa_kernel, "rw_osa_paths": paths.osa_sets, "rw_romaji_paths": scripts.romaji_paths, "rw_can_spell": scripts.can_spell_surface}.items():
        spark.udf.register(name, kernel)
