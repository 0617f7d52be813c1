"""Filling containers of fixed capacity with items of varying length.

Method: best-fit decreasing with a segment tree over remaining capacities. Sizes
are whole numbers up to the capacity, so items of one size and open containers of
one remaining capacity are interchangeable: the packer places counts, not items.
It sees a histogram of sizes (at most one row per token of capacity) and gives
runs ("the items with ranks a to b of size s go to containers c, c + 1, ... , q
each"). That is exactly what best-fit decreasing does one item at a time over the
whole corpus, yet no task ever holds more than a histogram. Items are numbered
within their size by their key in two steps: the table is split into ranges of keys,
each range counts its items of each size and numbers them inside, so that a size with
a third of all items is no sort of one task. The result depends on the rows alone,
not on how they are spread. The jobs that count run while the DataFrame is built.

An item longer than the capacity is cut into pieces of the full capacity, each
alone in its container, and a rest that is packed like any other item.

Defined cases: null and empty texts (no tokens) take no part; a capacity that is
null or below 1 gives no rows; equal sizes are taken in the order of keys, null first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import spill


class OpenContainers:
    """Numbers of open containers by remaining capacity, under a segment tree that finds
    the least remaining capacity of at least s in logarithmic time."""

    def __init__(self, capacity: int):
        self.width = 1 << (capacity + 1 - 1).bit_length() if capacity else 1
        while self.width <= capacity:
            self.width *= 2
        self.tree = [0] * (2 * self.width)
        self.runs: dict[int, list[list[int]]] = {}

    def add(self, room: int, first: int, count: int) -> None:
        self.runs.setdefault(room, []).append([first, count])
        i = room + self.width
        while i:
            self.tree[i] += count
            i //= 2

    def take(self, room: int, at_most: int) -> tuple[int, int]:
        """(first, count) of a run of containers with exactly `room` left."""
        run = self.runs[room][-1]
        n = min(at_most, run[1])
        first = run[0]
        run[0] += n
        run[1] -= n
        if not run[1]:
            self.runs[room].pop()
        i = room + self.width
        while i:
            self.tree[i] -= n
            i //= 2
        return first, n

    def tightest(self, size: int) -> int | None:
        i = size + self.width
        if self.tree[i]:
            return size
        while i > 1:  # up until a right sibling holds something, then down to its left end
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.width
            i //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int, first_container: int = 0) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (size, first rank, items, first container, items per container) and the number
    of containers, for `histogram[size]` items of each size."""
    runs: list[tuple[int, int, int, int, int]] = []
    opened = OpenContainers(capacity)
    used = first_container
    for size in sorted(histogram, reverse=True):
        rank, left = 0, histogram[size]
        while left:
            room = opened.tightest(size)
            if room is None:
                per = capacity // size
                full = left // per
                if full:
                    runs.append((size, rank, full * per, used, per))
                    if capacity - per * size:
                        opened.add(capacity - per * size, used, full)
                    used, rank, left = used + full, rank + full * per, left - full * per
                if left:
                    runs.append((size, rank, left, used, left))
                    opened.add(capacity - left * size, used, 1)
                    used, left = used + 1, 0
                break
            per = room // size
            if left >= per:
                first, n = opened.take(room, left // per)
                runs.append((size, rank, n * per, first, per))
                opened.add(room - per * size, first, n)
                rank, left = rank + n * per, left - n * per
            else:
                first, _ = opened.take(room, 1)
                runs.append((size, rank, left, first, left))
                opened.add(room - left * size, first, 1)
                left = 0
    return runs, used


def _ranked(items: DataFrame) -> DataFrame:
    """`items` (budget_name, part, seq, size, ...) with `rank` among equal sizes of a budget."""
    cols = items.columns
    w = Window.partitionBy("budget_name", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = items.groupBy("budget_name", "size", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    return items.join(before, ["budget_name", "size", "part"]).withColumn("rank", F.col("offset") + F.col("seq")).select(*cols, "rank")


def pack(sizes: DataFrame, budgets: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(budget_name, key, piece, first_token, piece_tokens, container) of every item, for
    each of the few budgets (budget_name, capacity_tokens). The driver holds histograms:
    at most one number per token of the largest capacity and budget."""
    spark = sizes.sparkSession
    budgets = budgets.where("budget_name is not null and capacity_tokens >= 1").groupBy("budget_name").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    caps = {r["budget_name"]: r["capacity"] for r in budgets.collect()}
    out_schema = f"budget_name string, `{key}` {sizes.schema[key].dataType.simpleString()}, piece bigint, first_token bigint, piece_tokens bigint, container bigint"
    if not caps:
        return spark.createDataFrame([], out_schema)
    held = sizes.where(F.col(size) > 0).select(key, F.col(size).cast("bigint").alias("n"))
    held = spill(held.withColumn("row", F.monotonically_increasing_id()))
    kind = held.schema[key].dataType.simpleString()

    # the rows of one range of keys, in order: running numbers of the items of each size and of
    # the full pieces. `row` splits a key with very many rows; such rows are alike.
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = held.repartitionByRange(ranges, key, "n", "row").sortWithinPartitions(key, "n", "row").select(key, "n", F.spark_partition_id().alias("part"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}
        pieces: dict[str, int] = dict.fromkeys(caps, 0)
        for b in batches:
            n = b.column("n").to_numpy()
            for name, c in sorted(caps.items()):
                full, rest = n // c, n % c
                order = np.argsort(rest, kind="stable")
                sizes_ = rest[order]
                start = np.flatnonzero(np.r_[True, sizes_[1:] != sizes_[:-1]])
                lens = np.diff(np.r_[start, len(n)])
                base = np.zeros(len(start), np.int64)
                for j, size_ in enumerate(sizes_[start].tolist()):
                    base[j] = seen.get((name, size_), 0)
                    seen[name, size_] = int(base[j] + lens[j])
                seq = np.empty(len(n), np.int64)
                seq[order] = np.arange(len(n)) - np.repeat(start - base, lens)
                within = pieces[name] + np.cumsum(full) - full
                pieces[name] += int(full.sum())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), b.column(key), b.column("n"), b.column("part"), pa.array(rest), pa.array(seq), pa.array(full), pa.array(within)], ["budget_name", key, "n", "part", "size", "seq", "full", "within"])

    numbered = spill(ordered.mapInArrow(number, f"budget_name string, `{key}` {kind}, n bigint, part int, size bigint, seq bigint, full bigint, within bigint"))
    items = numbered.where("size > 0").select("budget_name", key, "n", "part", "size", "seq")

    histogram: dict[str, dict[int, int]] = {b: {} for b in caps}
    for r in items.groupBy("budget_name", "size").count().collect():
        histogram[r["budget_name"]][r["size"]] = r["count"]
    runs, used = [], {}
    for b, c in sorted(caps.items()):
        found, used[b] = best_fit_decreasing(histogram[b], c)
        runs += [(b, *r) for r in found]
    run_rows = spark.createDataFrame(runs or [("", 0, 0, 0, 0, 0)], "budget_name string, size bigint, run_rank bigint, run_items bigint, run_first bigint, per bigint")
    # the runs of one size lie in an array, by rank: one equi-join and a lookup, no range join
    by_size = run_rows.groupBy("budget_name", "size").agg(F.array_sort(F.collect_list(F.struct("run_rank", "run_items", "run_first", "per"))).alias("runs"))
    ranked = _ranked(items).join(by_size, ["budget_name", "size"])
    run = F.filter("runs", lambda r: (r["run_rank"] <= F.col("rank")) & (F.col("rank") < r["run_rank"] + r["run_items"]))[0]
    ends = ranked.withColumn("r", run).select("budget_name", key, "n", "size", (F.col("r.run_first") + F.floor((F.col("rank") - F.col("r.run_rank")) / F.col("r.per"))).alias("container"))
    rests = ends.select("budget_name", key, F.floor((F.col("n") - F.col("size")) / F.element_at(F.create_map(*[x for b, c in sorted(caps.items()) for x in (F.lit(b), F.lit(c).cast("bigint"))]), F.col("budget_name"))).alias("piece"), (F.col("n") - F.col("size")).alias("first_token"), F.col("size").alias("piece_tokens"), "container")
    # pieces of the full capacity: containers after all others, in the order of keys
    long = numbered.where("full > 0").select("budget_name", key, "part", "full", "within").join(budgets, "budget_name")
    w = Window.partitionBy("budget_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = long.groupBy("budget_name", "part").agg(F.sum("full").alias("f")).withColumn("before", F.coalesce(F.sum("f").over(w), F.lit(0))).drop("f")
    placed = long.join(before, ["budget_name", "part"])
    base = F.element_at(F.create_map(*[x for b, u in sorted(used.items()) for x in (F.lit(b), F.lit(u).cast("bigint"))]), F.col("budget_name"))
    full = placed.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1))).select("budget_name", key, "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("piece_tokens"), (base + F.col("before") + F.col("within") + F.col("piece")).alias("container"))
    return rests.unionByName(full)
