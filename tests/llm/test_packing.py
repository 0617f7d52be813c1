import bisect
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import packing


def plain(sizes, capacity):
    """Best-fit decreasing, one item at a time."""
    room = []
    n = 0
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(room, s)
        r = room.pop(i) if i < len(room) else capacity
        n += r == capacity
        if r - s:
            bisect.insort(room, r - s)
    return n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_counts_equal_one_item_at_a_time(sizes):
    runs, used = packing.best_fit_decreasing(dict(Counter(sizes)), 30)
    held, items = Counter(), Counter()
    for size, rank, n, first, per in runs:
        for r in range(rank, rank + n):
            held[first + (r - rank) // per] += size
            items[size, r] += 1
    assert used == plain(sizes, 30) == len(held)
    assert all(v <= 30 for v in held.values())
    assert items == Counter({(s, r): 1 for s, n in Counter(sizes).items() for r in range(n)})


def test_the_tightest_container_is_found():
    o = packing.OpenContainers(100)
    for room in (7, 40, 41, 99):
        o.add(room, room, 1)
    assert [o.tightest(s) for s in (1, 7, 8, 41, 42, 100)] == [7, 7, 40, 41, 99, None]
    o.take(40, 1)
    assert o.tightest(8) == 41


@pytest.mark.parametrize("seed", [1, 2])
def test_table(spark, seed):
    rng = random.Random(seed)
    sizes = [0, None] + [rng.choice([1, 2, 5, 5, 5, 40, 64, 65, 128, 200, 511, 700]) if rng.random() < 0.7 else rng.randint(1, 300) for _ in range(800)]
    df = spark.createDataFrame([(i, s, 1) for i, s in enumerate(sizes)], "doc_id bigint, n_tokens bigint, size int").repartition(5)
    budgets = spark.createDataFrame([("small", 64), ("small", 64), ("large", 512), ("none", None), (None, 7), ("zero", 0)], "budget_name string, capacity_tokens int")
    rows = packing.pack(df, budgets).collect()
    for name, c in (("small", 64), ("large", 512)):
        own = [r for r in rows if r["budget_name"] == name]
        held, got = Counter(), {}
        for r in own:
            held[r["container"]] += r["piece_tokens"]
            got.setdefault(r["doc_id"], []).append((r["piece"], r["first_token"], r["piece_tokens"]))
        assert max(held.values()) <= c and sorted(held) == list(range(len(held)))
        for i, s in enumerate(sizes):
            pieces = sorted(got.get(i, []))
            assert sum(p[2] for p in pieces) == (s or 0)
            assert [p[0] for p in pieces] == list(range(len(pieces))) and all(p[1] == k * c for k, p in enumerate(pieces))
            assert len(pieces) == -(-(s or 0) // c)
        want = sum((s or 0) // c for s in sizes) + plain([s % c for s in sizes if s and s % c], c)
        assert len(held) == want
    assert {r["budget_name"] for r in rows} == {"small", "large"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    budgets = spark.createDataFrame([("a", 10)], "budget_name string, capacity_tokens int")
    assert packing.pack(docs, budgets).count() == 0
    assert packing.pack(spark.createDataFrame([(1, 3)], docs.schema), budgets.limit(0)).count() == 0


def test_result_does_not_depend_on_how_rows_are_spread(spark):
    import random

    rng = random.Random(5)
    rows = [(i if i % 50 else 7, rng.choice((3, 3, 3, 5, 8, 40, 130))) for i in range(900)] + [(None, 4), (None, 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int")
    budgets = spark.createDataFrame([("b", 50), ("c", 17)], "budget_name string, capacity_tokens int")
    one, other = (sorted(map(str, packing.pack(x, budgets).collect())) for x in (df.coalesce(1), df.repartition(7, "n_tokens")))
    assert one == other and len(one) > 900
