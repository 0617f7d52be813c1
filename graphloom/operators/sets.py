"""Combining the candidates of several paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_of(paths: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, n_paths, path_ids): every candidate with the paths that support it."""
    return _tagged(paths, key).groupBy(key).agg(F.count_distinct("path_id").alias("n_paths"), F.array_join(F.array_sort(F.collect_set("path_id")), ";").alias("path_ids"))


def intersection_of(paths: dict[str, DataFrame], key: str, contributing: set[str] | None = None) -> DataFrame:
    """The candidates that every contributing path supports."""
    use = {k: v for k, v in paths.items() if contributing is None or k in contributing}
    return union_of(use, key).where(F.col("n_paths") == len(use))


def except_of(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def _tagged(paths: dict[str, DataFrame], key: str) -> DataFrame:
    out = None
    for name, df in sorted(paths.items()):
        part = df.select(key).withColumn("path_id", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def merged_by(df: DataFrame, key: Column, order: list[str], keep: list[str], total: list[str]) -> DataFrame:
    """Rows with an equal key as one: `keep` from the first by `order`, `total` summed."""
    first = F.min_by(F.struct(*keep), F.struct(*order))
    return df.groupBy(key.alias("merge_key")).agg(first.alias("k"), *[F.sum(c).alias(c) for c in total], F.count(F.lit(1)).alias("n_merged")).select("merge_key", "k.*", *total, "n_merged")


def ordered_distinct(df: DataFrame, key: str, position: str) -> DataFrame:
    """Each key once, at its first position."""
    return df.groupBy(key).agg(F.min(position).alias(position))
