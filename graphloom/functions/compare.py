"""Comparison of a value, or any element of a list, with an expected one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = ("eq", "neq", "in", "not_in", "gte", "lte", "gt", "lt", "exists", "not_exists", "contains")


def apply_op(op: str, actual: Column, expected=None) -> Column:
    """Whether `actual` (a column of array<string>; a scalar goes in as a list of one) meets
    `op`. exists / not_exists look at null only; with them aside a null fails. Strings are
    compared without case. eq, in, contains and the orders hold if any element does, neq
    and not_in if all do. What is no number fails an order. An empty list meets neq and
    not_in and nothing else."""
    if op not in OPS:
        raise ValueError(f"unknown operator {op}")
    if op == "exists":
        return actual.isNotNull()
    if op == "not_exists":
        return actual.isNull()
    many = [str(x).lower() for x in (expected if isinstance(expected, (list, tuple, set)) else [expected])]
    if op in ("eq", "in"):
        met = F.exists(actual, lambda x: F.lower(x).isin(many))
    elif op in ("neq", "not_in"):
        met = F.forall(actual, lambda x: ~F.lower(x).isin(many))
    elif op == "contains":
        met = F.exists(actual, lambda x: F.contains(F.lower(x), F.lit(many[0])))
    else:
        try:
            bound = float(expected)
        except (TypeError, ValueError):
            return F.lit(False)
        order = {"gte": lambda v: v >= bound, "lte": lambda v: v <= bound, "gt": lambda v: v > bound, "lt": lambda v: v < bound}[op]
        met = F.exists(actual, lambda x: F.coalesce(order(x.try_cast("double")), F.lit(False)))
    return F.coalesce(met, F.lit(False))


def as_list(value: Column) -> Column:
    """A scalar as a list of one, null as the empty list."""
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value.cast("string")))
