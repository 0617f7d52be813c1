"""Parent-child links of unknown depth as full hierarchies, and rings of links.

Method: peeling. Rounds that remove the nodes without children shrink the links
to a core; repeated squaring of the link function on the core leaves exactly the
nodes on rings. With the rings cut, every tree becomes an Euler tour, a linked
list of entries (+1) and exits (-1), ranked in parallel by pointer jumping: the
prefix sum gives the depth, the list's head the root, and the ranks of entry and
exit an interval that holds all descendants. Paths come from blocks of the tour:
a block needs its own entries and the intervals that reach into it, no more, so
that no tree is ever gathered in one task; the first blocks of many trees are walked
together. Siblings are linked in hash buckets, so that a parent of a third of all
rows is no sort of one task. The rounds run while the DataFrame is built.

All steps are joins on one key over tables in the shared folder; rounds grow with
the logarithm of the height.

Defined cases
* a link to itself is a ring of one; rows with a null child are ignored;
* a parent without a row of its own is a root;
* a node that only leads to a ring has no root (null) and depth -1;
* of several rows of a child the caller chooses one (`latest`).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

SIBLING_BUCKETS = 256
TOUR_BLOCK = 8192


def latest(links: DataFrame, key: list[str], value: str, when: str) -> DataFrame:
    """The row of each key with the latest `when` (ties: the greatest value)."""
    return links.groupBy(*key).agg(F.max_by(value, F.struct(F.col(when), F.coalesce(F.col(value), F.lit("")))).alias(value))


def ring_nodes(links: DataFrame, scratch: Scratch, shrink: float = 0.25) -> DataFrame:
    """(id) of the nodes on rings of `links` (id, up), where each id has at most one up."""
    core = scratch.spill(links.where("up is not null").select("id", "up"))
    n = core.count()
    while n:  # peel nodes to which no link leads, as long as many fall
        rest = scratch.spill(core.join(core.select(F.col("up").alias("id")).distinct(), "id", "left_semi"))
        scratch.drop(core)
        core, before, n = rest, n, rest.count()
        if n > before * (1 - shrink):
            break
    jump, image = core, n + 1
    while n:
        found = jump.agg(F.count_distinct("up")).first()[0]
        if found == image:  # the image of the squared function no longer shrinks: only rings are left
            break
        image = found
        second = jump.select(F.col("id").alias("up"), F.col("up").alias("up2"))
        third = jump.select(F.col("id").alias("up2"), F.col("up").alias("up3"))
        nxt = scratch.spill(jump.join(second, "up").join(third, "up2").select("id", F.col("up3").alias("up")))
        scratch.drop(jump)
        jump = nxt
        if not found:
            break
    return jump.select(F.col("up").alias("id")).distinct()


def _tour_list(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The Euler tours as one linked list: element (2 id on entry, 2 id + 1 on exit), its
    predecessor (null at a root's entry) and its step."""
    child = links.where("up is not null").select("id", "up", F.pmod(F.xxhash64("id"), F.lit(SIBLING_BUCKETS)).alias("bucket"))
    in_bucket = child.withColumn("prev", F.lag("id").over(Window.partitionBy("up", "bucket").orderBy("id")))
    ends = child.groupBy("up", "bucket").agg(F.max("id").alias("last"))
    before = ends.select("up", "bucket", F.lag("last").over(Window.partitionBy("up").orderBy("bucket")).alias("last_before"))
    linked = in_bucket.join(before, ["up", "bucket"]).select("id", "up", F.coalesce("prev", "last_before").alias("prev"))
    last = ends.groupBy("up").agg(F.max_by("last", "bucket").alias("last")).withColumnRenamed("up", "id")
    inner = nodes.select("id").join(linked, "id", "left")
    entry = inner.select((F.col("id") * 2).alias("e"), F.when(F.col("prev").isNotNull(), F.col("prev") * 2 + 1).otherwise(F.col("up") * 2).alias("ptr"), F.lit(1).cast("bigint").alias("sum"))
    leave = nodes.select("id").join(last, "id", "left").select((F.col("id") * 2 + 1).alias("e"), F.when(F.col("last").isNotNull(), F.col("last") * 2 + 1).otherwise(F.col("id") * 2).alias("ptr"), F.lit(-1).cast("bigint").alias("sum"))
    return entry.unionByName(leave).withColumn("n", F.lit(1).cast("bigint")).withColumn("head", F.when(F.col("ptr").isNull(), F.col("e")))


def ranked_tours(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root, depth, entry, exit) of a forest: `links` (id, up) without rings."""
    whole = scratch.spill(_tour_list(nodes, links))
    while not whole.where("head is null").isEmpty():
        a, b = whole.where("head is null").alias("a"), whole.alias("b")
        step = a.join(b, F.col("a.ptr") == F.col("b.e")).select(F.col("a.e").alias("e"), F.col("b.ptr").alias("ptr"), (F.col("a.sum") + F.col("b.sum")).alias("sum"), (F.col("a.n") + F.col("b.n")).alias("n"), F.col("b.head").alias("head"))
        nxt = scratch.spill(whole.where("head is not null").unionByName(step))
        scratch.drop(whole)
        whole = nxt
    entry = whole.where("e % 2 = 0").select((F.col("e") / 2).cast("bigint").alias("id"), (F.col("head") / 2).cast("bigint").alias("root"), (F.col("sum") - 1).alias("depth"), F.col("n").alias("entry"))
    leave = whole.where("e % 2 = 1").select(((F.col("e") - 1) / 2).cast("bigint").alias("id"), F.col("n").alias("exit"))
    return entry.join(leave, "id")


def hierarchy(links: DataFrame, group: str, child: str, parent: str, scratch: Scratch | None = None) -> DataFrame:
    """(group, node, root, depth, entry, exit, on_ring) for each name that is a child or a
    parent. One row per (group, child) is expected; the parent may be null."""
    scratch = scratch or Scratch(links.sparkSession)
    rows = links.where(F.col(child).isNotNull()).select(F.col(group).alias("grp"), F.col(child).alias("node"), F.col(parent).alias("over"))
    rows = scratch.spill(rows)
    names = rows.select("grp", "node").union(rows.where("over is not null").select("grp", "over")).distinct()
    nodes = scratch.spill(names.withColumn("id", F.monotonically_increasing_id()))
    # null-safe on the group: a null group is a group
    up = nodes.select(F.col("grp").alias("g2"), F.col("node").alias("over"), F.col("id").alias("up"))
    r = rows.alias("r")
    own = r.join(nodes.alias("n"), (F.col("r.node") == F.col("n.node")) & F.col("r.grp").eqNullSafe(F.col("n.grp"))).select("n.id", "r.grp", "r.over")
    ids = scratch.spill(own.join(up, (own["over"] == up["over"]) & own["grp"].eqNullSafe(up["g2"]), "left").select("id", "up"))
    rings = scratch.spill(ring_nodes(ids, scratch))
    cut = ids.join(rings, "id", "left_anti")
    tours = ranked_tours(nodes, cut, scratch)
    marked = rings.select(F.col("id").alias("root"), F.lit(True).alias("to_ring"))
    on = rings.withColumn("on_ring", F.lit(True))
    named = nodes.select(F.col("id").alias("root"), F.col("node").alias("root_name"))
    out = nodes.join(tours, "id").join(marked, "root", "left").join(on, "id", "left").join(named, "root")
    ring = F.col("to_ring").isNotNull()
    return out.select(F.col("grp").alias(group), "node", F.when(~ring, F.col("root_name")).alias("root"), F.when(ring, F.lit(-1)).otherwise(F.col("depth")).cast("int").alias("depth"), "entry", "exit", F.coalesce("on_ring", F.lit(False)).alias("on_ring"))


def rings(links: DataFrame, group: str, child: str, other: str, least: int = 3) -> DataFrame:
    """(group, node) of the nodes on rings of at least `least` (1 to 3) links."""
    scratch = Scratch(links.sparkSession)
    key = lambda g, n: F.concat_ws("\x00", F.col(g), F.col(n))
    rows = scratch.spill(links.where(F.col(child).isNotNull()).select(F.col(group).alias("grp"), F.col(child).alias("node"), key(group, child).alias("id"), F.when(F.col(other).isNotNull(), key(group, other)).alias("up")))
    found = ring_nodes(rows.select("id", "up"), scratch)
    step = rows.select(F.col("id").alias("up"), F.col("up").alias("up2"))
    far = rows.join(found, "id", "left_semi").join(step, "up")
    short = {1: F.lit(True), 2: F.col("id") != F.col("up"), 3: (F.col("id") != F.col("up")) & (F.col("id") != F.col("up2"))}[least]
    return far.where(short).select(F.col("grp").alias(group), "node")


def with_paths(tree: DataFrame, group: str, sep: str = "/") -> DataFrame:
    """`tree` (from `hierarchy`) with `path` (names from the root, by `sep`), `ancestors`
    (array of names from the root down) and `n_descendants`; nodes that lead to a ring
    have no path. Made block by block of the tour from the intervals that reach into it."""
    held = tree.where("depth >= 0")
    block: Column = F.floor(F.col("entry") / TOUR_BLOCK)
    own = held.withColumn("block", block)
    into = own.where(F.floor(F.col("exit") / TOUR_BLOCK) > F.col("block")).withColumn("block", F.explode(F.sequence(F.col("block") + 1, F.floor(F.col("exit") / TOUR_BLOCK).cast("bigint"))))
    cols = [group, "root", "node", "depth", "entry", "block"]
    both = own.select(*cols, F.lit(True).alias("own")).unionByName(into.select(*cols, F.lit(False).alias("own")))
    # the first blocks of all trees share as many groups as there are partitions; further blocks are groups of their own
    buckets = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.col("block") == 0
    bucket = F.when(first, F.pmod(F.xxhash64(F.col(group), F.col("root")), F.lit(buckets)))
    keys = [bucket.alias("bucket"), F.when(~first, F.col(group)).alias("of_group"), F.when(~first, F.col("root")).alias("of_root"), F.when(~first, F.col("block")).alias("of_block")]

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([group, "root", "entry"])
        stack: list[str] = []
        out = []
        for node, depth, is_own in zip(part["node"], part["depth"], part["own"]):
            del stack[depth:]
            if is_own:
                out.append(list(stack))
            stack.append(node)
        mine = part[part["own"]]
        return pd.DataFrame({group: mine[group], "node": mine["node"], "ancestors": pd.Series(out, mine.index, dtype=object)})

    paths = both.groupBy(*keys).applyInPandas(walk, f"`{group}` {tree.schema[group].dataType.simpleString()}, node string, ancestors array<string>")
    found = paths.select(F.col(group).alias("p_group"), F.col("node").alias("p_node"), "ancestors")
    out = tree.join(found, tree[group].eqNullSafe(found["p_group"]) & (tree["node"] == found["p_node"]), "left").drop("p_group", "p_node")
    return out.withColumn("path", F.concat_ws(sep, "ancestors", "node")).withColumn("path", F.when(F.col("depth") >= 0, F.col("path"))).withColumn("n_descendants", F.when(F.col("depth") >= 0, ((F.col("exit") - F.col("entry") - 1) / 2).cast("bigint")))


def descendants(pathed: DataFrame, group: str) -> DataFrame:
    """(group, node, descendant, distance): every pair of a node and one below it."""
    return pathed.select(group, F.posexplode("ancestors").alias("at", "ancestor"), F.col("node").alias("descendant"), "depth").select(group, F.col("ancestor").alias("node"), "descendant", (F.col("depth") - F.col("at")).cast("int").alias("distance"))
