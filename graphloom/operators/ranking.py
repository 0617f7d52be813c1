"""Normalising, scoring, ranking and picking of candidates.

The extremes of the one pool are scalar subqueries, those of several pools are joined back
as one row per pool; no window runs over a whole pool in one task. Only the ranks that are asked for are numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalised(df: DataFrame, criteria: dict[str, str], pool: list[str] | None = None) -> DataFrame:
    """`df` with n_<criterion> in 0..1 for each criterion ('asc' or 'desc', best is 1): min-max
    over the pool, 0.5 where all are equal, null where the criterion is unknown."""
    aggs = [f(c).alias(f"{p}_{c}") for c in criteria for p, f in (("lo", F.min), ("hi", F.max))]
    out = df.join(df.groupBy(*pool).agg(*aggs), pool) if pool else df
    whole = None if pool else df.agg(*aggs).select(F.struct("*")).scalar()  # one subquery for all extremes
    for c, way in criteria.items():
        lo, hi = (F.col(f"lo_{c}"), F.col(f"hi_{c}")) if pool else (whole[f"lo_{c}"], whole[f"hi_{c}"])
        v = F.col(c)
        n = F.when(v.isNull(), None).when(hi == lo, 0.5).otherwise((v - lo) / (hi - lo))
        out = out.withColumn(f"n_{c}", F.when(hi != lo, 1 - n).otherwise(n) if way == "asc" else n)
    return out.drop(*[f"{p}_{c}" for c in criteria for p in ("lo", "hi")])


def weighted_mean(weights: dict[str, float]) -> Column:
    """The weighted mean of the known ones among n_<criterion>; null if none is known."""
    num, den = F.lit(0.0), F.lit(0.0)
    for c, w in weights.items():
        known = F.col(f"n_{c}").isNotNull()
        num, den = num + F.when(known, F.lit(float(w)) * F.col(f"n_{c}")).otherwise(0.0), den + F.when(known, float(w)).otherwise(0.0)
    return F.when(den > 0, num / den)


def top(df: DataFrame, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows by a total order, numbered. Every task sends k rows at most."""
    few = df.orderBy(*order).limit(k)
    return few.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def top_in_groups(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group: Spark's group limit drops the rest before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def round_robin(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """k rows in turn from the groups: the best of each group first, groups in the order of
    their best rows."""
    within = top_in_groups(df, group, order, k, "turn")
    return top(within, [F.col("turn"), *order], k, "rank")


def reading_prefix(df: DataFrame, group: list[str], order: list[Column], supports: Column, least: int = 3, most: int = 5) -> DataFrame:
    """The rows that are read in order: reading ends once `least` are read and one of them
    supports, or at `most`."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    first = df.withColumn("position", n).where(F.col("position") <= most)
    seen = F.coalesce(F.sum(supports.cast("int")).over(before), F.lit(0))
    return first.withColumn("s_before", seen).where((F.col("position") <= least) | (F.col("s_before") == 0)).drop("s_before")


def tie_keys(rule: str, key: str, priority: str = "path_priority", name: str = "name", when: str = "recency", seed: int = 0) -> list[Column]:
    """The columns that decide between equal scores: by path priority (a missing one last),
    alphabetically, the newest first, or by a seeded hash; the key makes the order total."""
    if rule == "path_priority":
        return [F.coalesce(F.col(priority), F.lit(1_000_000)).asc(), F.col(key)]
    if rule == "alphabetical":
        return [F.lower(F.col(name)).asc_nulls_last(), F.col(key)]
    if rule == "recency":
        return [F.col(when).desc_nulls_last(), F.col(key)]
    if rule == "random":
        return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))).asc(), F.col(key)]
    raise ValueError(rule)


def budgeted(edges: DataFrame, key: str, position: list[str], k: int) -> DataFrame:
    """The first k different keys in the order of their first places."""
    first = edges.groupBy(key).agg(F.min(F.struct(*position)).alias("first_place"))
    return top(first, [F.col("first_place"), F.col(key)], k).drop("first_place")
