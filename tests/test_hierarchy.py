import random

from graphloom.operators import closure, hierarchy
from graphloom.sources.scratch import Scratch

SCHEMA = "g string, child string, parent string, node string"


def tree(spark, rows):
    return hierarchy.hierarchy(spark.createDataFrame([(g, c, p, "clash") for g, c, p in rows], SCHEMA), "g", "child", "parent")


def brute(rows):
    up = {(g, c): p for g, c, p in rows if c is not None}
    out = {}
    for g, n in {(g, c) for g, c, _ in rows if c is not None} | {(g, p) for g, c, p in rows if p is not None and c is not None}:
        path, seen, at = [n], {n}, n
        while (p := up.get((g, at))) is not None:
            if p in seen:
                path = None
                break
            path.append(p)
            seen.add(p)
            at = p
        out[g, n] = path and path[::-1]
    return out


def test_random_forests_with_rings(spark):
    rng = random.Random(3)
    rows = []
    for g in ("a", None, "c"):
        names = [f"n{i}" for i in range(120)]
        for i, n in enumerate(names):
            if rng.random() < 0.9:
                rows.append((g, n, None if rng.random() < 0.05 else rng.choice(names if rng.random() < 0.05 else names[: i + 1])))
    want = brute(rows)
    pathed = hierarchy.with_paths(tree(spark, rows), "g", "/")
    got = {(r["g"], r["node"]): r for r in pathed.collect()}
    assert got.keys() == want.keys()
    for k, p in want.items():
        r = got[k]
        if p is None:
            assert r["root"] is None and r["depth"] == -1
        else:
            assert (r["root"], r["depth"]) == (p[0], len(p) - 1)
            assert r["path"] == "/".join(p)
            assert r["n_descendants"] == sum(q is not None and kk[0] == k[0] and p == q[: len(p)] and len(q) > len(p) for kk, q in want.items())


def test_a_long_chain_a_hub_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "TOUR_BLOCK", 16)
    rows = [("g", f"c{i:03d}", f"c{i - 1:03d}" if i else None) for i in range(300)] + [("h", f"leaf{i}", "hub") for i in range(700)]
    got = {r["node"]: r for r in hierarchy.with_paths(tree(spark, rows), "g", ">").collect()}
    assert got["c299"]["depth"] == 299 and got["c000"]["n_descendants"] == 299
    assert got["c005"]["path"] == "c000>c001>c002>c003>c004>c005"
    assert got["hub"]["n_descendants"] == 700 and got["leaf9"]["path"] == "hub>leaf9"


def test_rings_of_three_or_more(spark):
    rows = [("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "d", "a"), ("s", "e", "f"), ("s", "f", "e"), ("s", "x", "x"), ("t", "a", "b"), ("t", "b", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    assert {tuple(r) for r in hierarchy.rings(df, "g", "child", "parent").collect()} == {("s", "a"), ("s", "b"), ("s", "c")}
    assert hierarchy.rings(df, "g", "child", "parent", 1).count() == 6


def test_empty_and_null_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hierarchy.hierarchy(empty, "g", "child", "parent").count() == 0
    assert hierarchy.rings(empty, "g", "child", "parent").count() == 0
    assert tree(spark, [("g", None, "p"), ("g", "only", None)]).count() == 1


def test_latest_row_counts(spark):
    df = spark.createDataFrame([("g", "a", "old", 1), ("g", "a", None, 3), ("g", "a", "mid", 2), ("g", "b", "p", 1), ("g", "b", "q", 1)], "g string, c string, p string, t int")
    assert {tuple(r) for r in hierarchy.latest(df, ["g", "c"], "p", "t").collect()} == {("g", "a", None), ("g", "b", "q")}


def test_ring_nodes_by_peeling_and_squaring(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(40, 30), (50, 51), (51, None)], "id bigint, up bigint")
    got = {r["id"] for r in hierarchy.ring_nodes(links, Scratch(spark)).collect()}
    assert got == set(range(30, 41))


def test_questions_to_a_hierarchy(spark):
    t = hierarchy.with_paths(tree(spark, [("g", "b", "a"), ("g", "c", "b"), ("g", "d", "b")]), "g")
    assert {tuple(r) for r in closure.ancestors(t, "g").collect()} == {("g", "b", "a", 1), ("g", "c", "b", 1), ("g", "c", "a", 2), ("g", "d", "b", 1), ("g", "d", "a", 2)}
    assert {tuple(r) for r in closure.leaves_below(t, "g").collect()} == {("g", "a", 2), ("g", "b", 2)}
    facts = spark.createDataFrame([("g", "a", "va", True), ("g", "b", "vb", False), ("g", "d", "vd", True)], "g string, node string, v string, ok boolean")
    from pyspark.sql import functions as F

    assert {tuple(r) for r in closure.nearest(t, facts, "g", "v", F.col("ok")).collect()} == {("g", "a", "va"), ("g", "b", "va"), ("g", "c", "va"), ("g", "d", "vd")}


def test_what_satisfies_what(spark):
    t = hierarchy.with_paths(tree(spark, [("g", "b", "a"), ("g", "c", "b"), ("g", "x", "z")]), "g")
    pairs = spark.createDataFrame([("g", "c", "a"), ("g", "c", "c"), ("g", "a", "c"), ("g", "m", "a"), ("g", "n", "a"), ("g", "?", "a")], "g string, have string, want string")
    mixins = spark.createDataFrame([("g", "m", "b"), ("g", "m", "c"), ("g", "n", "c"), ("g", "n", "x")], "g string, mixin string, implementer string")
    got = {(r["have"], r["want"]): r["is_satisfied"] for r in closure.satisfies(t, pairs, "g", mixins).collect()}
    assert got == {("c", "a"): True, ("c", "c"): True, ("a", "c"): False, ("m", "a"): True, ("n", "a"): False, ("?", "a"): False}
    plain = {(r["have"], r["want"]): r["is_satisfied"] for r in closure.satisfies(t, pairs, "g").collect()}
    assert plain["c", "a"] and not plain["m", "a"]
