"""Edge rules with full accounts: every rule is tried on every edge, in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """`keep` is true for edges that pass; `missing` for edges that lack what it looks at."""

    name: str
    keep: Column
    missing: Column


def at_least(name: str, column: str, n: float) -> Rule:
    c = F.col(column)
    return Rule(name, F.coalesce(c >= n, F.lit(False)), c.isNull() | (c == 0))


def one_of(name: str, column: str, values: list[str]) -> Rule:
    c = F.col(column)
    return Rule(name, F.coalesce(c.isin(*values), F.lit(False)), c.isNull())


def none_of(name: str, column: str, values: list[str]) -> Rule:
    c = F.col(column)
    return Rule(name, ~F.coalesce(c.isin(*values), F.lit(False)), c.isNull())


def present(name: str, column: str) -> Rule:
    return Rule(name, F.col(column).isNotNull(), F.col(column).isNull())


def is_false(name: str, column: str) -> Rule:
    return Rule(name, ~F.coalesce(F.col(column), F.lit(False)), F.col(column).isNull())


def kept(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """The edges that pass all rules."""
    for r in rules:
        edges = edges.where(r.keep)
    return edges


def account(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, n_checked, n_dropped, n_missing, n_mismatch, drop_rate) of each rule, and of all
    together under the name `all`: one aggregation over the edges, no shuffle of them."""
    whole = F.lit(True)
    for r in rules:
        whole = whole & r.keep
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, r in enumerate([*rules, Rule("all", whole, F.lit(False))]):
        aggs += [F.count_if(~r.keep).alias(f"d{i}"), F.count_if(~r.keep & r.missing).alias(f"m{i}")]
    one = edges.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col("n").alias("n_checked"), F.col(f"d{i}").alias("n_dropped"), F.col(f"m{i}").alias("n_missing"), (F.col(f"d{i}") - F.col(f"m{i}")).alias("n_mismatch")) for i, name in enumerate([*(r.name for r in rules), "all"])])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("drop_rate", F.round(F.col("n_dropped") / F.greatest(F.col("n_checked"), F.lit(1)), 6))


def first_reason(reasons: list[tuple[str, Column]], otherwise: str = "kept") -> Column:
    """The name of the first condition that holds."""
    out = F.when(F.coalesce(reasons[0][1], F.lit(False)), reasons[0][0])
    for name, c in reasons[1:]:
        out = out.when(F.coalesce(c, F.lit(False)), name)
    return out.otherwise(otherwise)
