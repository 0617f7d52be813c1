"""Questions to a hierarchy whose paths are known (`hierarchy.with_paths`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import spill


def ancestors(pathed: DataFrame, group: str) -> DataFrame:
    """(group, node, ancestor, distance), nearest first by distance 1."""
    return pathed.select(group, "node", F.posexplode("ancestors").alias("at", "ancestor"), "depth").select(group, "node", "ancestor", (F.col("depth") - F.col("at")).cast("int").alias("distance"))


def nearest(pathed: DataFrame, facts: DataFrame, group: str, value: str, meets: Column) -> DataFrame:
    """(group, node, value): `value` of the nearest ancestor (or the node itself) whose facts
    (group, node, ...) meet a condition."""
    own = pathed.select(group, F.col("node").alias("ancestor"), "node", F.lit(0).alias("distance"))
    up = ancestors(pathed, group).select(group, "ancestor", "node", "distance").unionByName(own)
    f = facts.where(meets).select(group, F.col("node").alias("ancestor"), value)
    return up.join(f, [group, "ancestor"]).groupBy(group, "node").agg(F.min_by(value, "distance").alias(value))


def leaves_below(pathed: DataFrame, group: str) -> DataFrame:
    """(group, node, n_leaves): the leaves under each inner node."""
    leaf = pathed.where("n_descendants = 0")
    return ancestors(leaf, group).groupBy(group, F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n_leaves"))


def completed_inverses(inverses: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Inverses that are given one way only, both ways; each pair once in each direction."""
    one = inverses.where(F.col(b).isNotNull()).select(group, a, b)
    return one.union(one.select(group, F.col(b), F.col(a))).distinct()


def satisfies(pathed: DataFrame, pairs: DataFrame, group: str, mixins: DataFrame | None = None) -> DataFrame:
    """`pairs` (group, have, want) with `is_satisfied`: `want` is `have` or stands above it. A
    mixin (rows group, mixin, implementer) also satisfies what all of its implementers do."""
    own = pathed.select(group, F.col("node").alias("have"), F.col("node").alias("want"))
    above = ancestors(pathed, group).select(group, F.col("node").alias("have"), F.col("ancestor").alias("want")).unionByName(own).withColumn("yes", F.lit(True))
    direct = pairs.join(above, [group, "have", "want"], "left")
    if mixins is None:
        return direct.select(group, "have", "want", F.col("yes").isNotNull().alias("is_satisfied"))
    as_is = mixins.select(group, F.col("mixin").alias("have"), F.col("implementer"))
    each = direct.where("yes is null").drop("yes").join(as_is, [group, "have"], "left").join(above.withColumnRenamed("have", "implementer"), [group, "implementer", "want"], "left")
    by_all = each.groupBy(group, "have", "want").agg(F.bool_and(F.col("yes").isNotNull()).alias("is_satisfied"))
    return direct.where("yes is not null").select(group, "have", "want", F.lit(True).alias("is_satisfied")).unionByName(by_all)


def concrete(pathed: DataFrame, facts: DataFrame, group: str) -> DataFrame:
    """(group, node, implementer): the classes at or below each class that can stand for
    themselves: neither mixin nor abstract nor deprecated by `facts` (group, node, is_mixin,
    is_abstract, is_deprecated); a class without facts is none of them."""
    flags = [F.coalesce(c, F.lit(False)) for c in ("is_mixin", "is_abstract", "is_deprecated")]
    real = pathed.join(facts, [group, "node"], "left").where(~(flags[0] | flags[1] | flags[2]))
    own = real.select(group, "node", F.col("node").alias("implementer"))
    return own.unionByName(ancestors(real, group).select(group, F.col("ancestor").alias("node"), F.col("node").alias("implementer")))


def family(pathed: DataFrame, roots: DataFrame, group: str) -> DataFrame:
    """(group, node, family): the first of the `roots` (group, root, place) that each node is or
    stands below; nodes of no family are left out."""
    own = pathed.select(group, "node", F.col("node").alias("root"))
    up = ancestors(pathed, group).select(group, "node", F.col("ancestor").alias("root")).unionByName(own)
    return up.join(roots, [group, "root"]).groupBy(group, "node").agg(F.min_by("root", F.struct("place", "root")).alias("family"))


def components(ties: DataFrame) -> DataFrame:
    """(name, comp): the connected names of `ties` (a, b), each with the least name it is tied
    to: least neighbours, then a jump to that name's own, until nothing changes."""
    both = spill(ties.select("a", "b").union(ties.select("b", "a")).distinct())
    label = both.groupBy(F.col("a").alias("name")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    label = spill(label)
    while True:
        near = both.join(label.withColumnRenamed("name", "b"), "b").groupBy(F.col("a").alias("name")).agg(F.min("comp").alias("near"))
        hop = label.select(F.col("name").alias("comp"), F.col("comp").alias("far"))
        nxt = spill(label.join(near, "name").join(hop, "comp").select("name", F.least("comp", "near", "far").alias("comp"), (F.least("near", "far") < F.col("comp")).alias("moved")))
        label = nxt.select("name", "comp")
        if nxt.where("moved").isEmpty():
            return label
