"""Entries that expire, by status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed times to live, in seconds.
TTL = {"success": 2592000.0, "empty": 2592000.0, "timeout": 604800.0, "error": 3600.0}


def ttl(status: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for k, v in TTL.items():
        out = out.when(status == k, v)
    return out.otherwise(TTL["success"])


def latest_fresh(entries: DataFrame, key: str, at: str, tie: str, now: str) -> DataFrame:
    """The latest entry of each key (by `at`, then `tie`) with `is_fresh`: not older than its
    status allows at the time `now`. One partial aggregate, no window."""
    cols = [c for c in entries.columns if c != key]
    one = entries.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col(at), F.col(tie))).alias("e")).select(key, "e.*")
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1e6
    return one.withColumn("is_fresh", age <= ttl(F.col("status")))


def purge(entries: DataFrame, at: str, now: str) -> DataFrame:
    """The entries that have not expired."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1e6
    return entries.where(age <= ttl(F.col("status")))
