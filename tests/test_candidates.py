"""Candidates, paths, grounding and windows on small tables with nulls, ties and repeats."""

import datetime as dt

from pyspark.sql import functions as F

from graphloom.operators import closure, grounding, paths, ranking, resolve
from graphloom.streaming.ratelimit import window_counts

CANDIDATES = "id string, name string, category string, taxa array<string>, types array<string>, extra string"


def test_taxa_narrow_only_scoped_categories_and_unknown_is_kept(spark):
    rows = [("a", "n", "biolink:Gene", ["T:1"], None, "x"), ("b", "n", "Gene", ["T:2"], None, "x"), ("c", "n", "Gene", [], None, "x"), ("d", "n", "Gene", None, None, None), ("e", "n", "Disease", ["T:2"], None, None), ("f", None, None, ["T:2"], None, None)]
    df = spark.createDataFrame(rows, CANDIDATES)
    assert {r["id"] for r in resolve.taxon_filter(df, ["T:1"]).collect()} == {"a", "c", "d", "e", "f"}
    assert resolve.taxon_filter(df.limit(0), ["T:1"]).count() == 0


def test_conflation_counts_within_its_group_only(spark):
    assert set(resolve.acceptable("biolink:Gene")) >= {"Gene", "Protein"} and resolve.acceptable("Disease", ("drug_chemical",)) == ["Disease"]
    assert "SmallMolecule" in resolve.acceptable("Drug", ("drug_chemical",)) and resolve.acceptable("Drug") == ["Drug"]
    rows = [("a", "n", None, None, ["Protein"], None), ("b", "n", None, None, ["Disease"], None), ("c", "m", None, None, ["Disease"], None), ("d", "m", None, None, None, None)]
    got = {(r["id"], r["is_fallback"]) for r in resolve.category_filter(spark.createDataFrame(rows, CANDIDATES), "Gene").collect()}
    assert got == {("a", False), ("c", True), ("d", True)}


def test_first_broken_rule_of_a_path(spark):
    rows = [(["a", "b", "a"], ["G"], ["p", "q"], [False, False], [1, 1], ["weak", "strong"]), (["a", "b", "c"], ["G", None, ""], ["p", "q"], [False, True], [0, 1], ["weak", "strong"]), (["a", "b", "c"], ["H"], ["p", "q"], [False, False], [0, 1], ["any", "strong"]), (["a", "c"], [], ["p"], [False], [3], ["any"])]
    df = spark.createDataFrame(rows, "n array<string>, m array<string>, p array<string>, neg array<boolean>, pubs array<int>, s array<string>")
    c = F.col

    def reasons(**rule):
        return [r[0] for r in df.select(paths.drop_reason(c("n"), c("m"), c("p"), c("neg"), c("pubs"), c("s"), **rule)).collect()]

    assert reasons() == ["repeated_node", "negated_edge", "kept", "kept"]
    assert reasons(allowed_middles=("G",)) == ["repeated_node", "negated_edge", "middle_category_not_allowed", "kept"]
    assert reasons(banned_middles=("H",))[2] == "middle_category_excluded"
    assert reasons(allowed=("p",))[1:] == ["predicate_not_whitelisted"] * 2 + ["kept"]
    assert reasons(banned=("q",))[1:] == ["predicate_blacklisted"] * 2 + ["kept"]
    assert reasons(required=("q",))[3] == "required_predicate_absent"
    assert reasons(least_publications=1)[2] == "insufficient_publications"
    assert reasons(least_strength="weak")[2:] == ["weak_edge", "weak_edge"]


def test_orders_of_paths_and_ties(spark):
    df = spark.createDataFrame([("short", [0.5], 1), ("strong", [0.9, 0.8], 2), ("mean", [1.0, 1.0, 0.7], 3), ("bare", [], 1)], "path string, scores array<double>, length int")
    first = {how: [r["path"] for r in ranking.top(df, [*paths.path_order(how, F.col("scores"), F.col("length")), F.col("path")], 2).orderBy("rank").collect()] for how in ("shortest", "evidence", "composite")}
    assert first == {"shortest": ["short", "bare"], "evidence": ["strong", "mean"], "composite": ["strong", "mean"]}
    ties = spark.createDataFrame([("b", "Z", 2, None), ("a", None, None, 5), ("c", "y", 1, 7)], "id string, name string, path_priority int, recency int")
    order = {rule: [r["id"] for r in ties.orderBy(*ranking.tie_keys(rule, "id")).collect()] for rule in ("path_priority", "alphabetical", "recency")}
    assert order == {"path_priority": ["c", "b", "a"], "alphabetical": ["c", "b", "a"], "recency": ["c", "a", "b"]}
    assert sorted(r["id"] for r in ties.orderBy(*ranking.tie_keys("random", "id", seed=1)).collect()) == ["a", "b", "c"]


def test_every_fault_of_a_statement(spark):
    quote = "the drug lowered the score in most of the cells"
    held = "this long rationale was written by the model and not by the graph"
    rows = [("r", "publication", "PMID:1"), ("r", "edge", "e1"), ("r", "verified_quote", quote), ("r", "quarantine", held), ("r", "quarantine", "short words"), ("r", "query_term", "X:9"), ("r", "candidate", "C:9"), ("other", "publication", "PMID:2"), ("r", "label", None)]
    parts = {k: spark.createDataFrame([(a, t) for a, kk, t in rows if kk == k], "result string, token string") for k in {k for _, k, _ in rows}}
    said = [
        ("r", 1, "finding", "As PMID:1 says, “lowered the score”.", ["e1"]), ("r", 2, "finding", "As PMID:2 says, “raised the score”.", ["e2", "e1"]), ("r", 3, "anchors", "It asked for X:9 and C:9, short words.", None),
        ("r", 4, "resolution_options", "C:9 or X:9", []), ("r", 5, "finding", f"Note: {held}.", None), ("r", 6, "finding", None, None), ("r", 7, "finding", f"“So {quote} of all.” and “of”", None),
    ]
    df = spark.createDataFrame(said, "result string, statement_id int, kind string, text string, supported_by array<string>")
    got = {tuple(r) for r in grounding.faults(df, grounding.lexicon(parts)).collect()}
    assert got == {(2, "unknown_edge", "e2"), (2, "ungrounded_identifier", "PMID:2"), (2, "unverified_quote", "raised the score"), (3, "ungrounded_identifier", "C:9"), (4, "ungrounded_identifier", "X:9"), (5, "model_authored_text", held)}
    banned = {tuple(r)[:2] for r in grounding.faults(df, grounding.lexicon(parts), quotes_allowed=False).collect()}
    assert (1, "quote_not_permitted") in banned and (7, "quote_not_permitted") in banned
    assert grounding.faults(df.limit(0), grounding.lexicon(parts)).count() == 0


def test_connected_names(spark):
    ties = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y"), ("x", "y"), ("y", "x")]
    got = {r["name"]: r["comp"] for r in closure.components(spark.createDataFrame(ties, "a string, b string")).collect()}
    assert got == {**{f"n{i:03d}": "n000" for i in range(41)}, "x": "x", "y": "x"}
    assert closure.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_window_counts_over_stretches(spark):
    import random

    rng = random.Random(1)
    t0 = dt.datetime(2031, 1, 1)
    rows = [(i, rng.choice(["u", "u", "v", None]), t0 + dt.timedelta(seconds=rng.choice((0, 10, 3600, 3601, 7200, rng.randint(0, 20000))))) for i in range(200)] + [(500, "u", None)]
    got = {r["k2"]: r["n_in_window"] for r in window_counts(spark.createDataFrame(rows, "k2 int, u string, ts timestamp"), "u", "ts", "k2", 3600).collect()}
    want = {i: sum(1 for _, c, s in rows if c == u and s is not None and dt.timedelta(0) <= t - s <= dt.timedelta(seconds=3600)) if t else None for i, u, t in rows}
    assert got == want
