import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import attributes as A
from graphloom.functions import scoring as S
from graphloom.functions.compare import apply_op, as_list
from graphloom.operators import match, paths, ranking, rules, sets
from graphloom.plans import Entity, Hop, Plan, PlanError
from graphloom.sources import documents
from graphloom.streaming import expiry, ratelimit

STAR = [("treats", "d1", "x"), ("treats", "d2", "x"), ("treats", "d1", "y"), ("targets", "d1", "g"), ("targets", "d2", "g"), ("targets", "d3", "g"), ("linked", "g", "x"), ("linked", "g", "y")]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame([(f"e{i}", s, p, o, False) for i, (p, s, o) in enumerate(STAR)], "edge_id string, subject string, predicate string, object string, negated boolean")


def plan(hops, pins, returns):
    refs = dict.fromkeys(r for s, _, o in hops for r in (s, o))
    return Plan(tuple(Entity(r, ids=tuple(pins.get(r, ())), is_variable=r not in pins) for r in refs), tuple(Hop(*h) for h in hops), returns)


def test_chain_star_and_cycle_equal_nested_loops(graph):
    edges = [(s, p, o) for p, s, o in STAR]
    cases = [
        ([("drug", "targets", "gene"), ("gene", "linked", "disease")], {"disease": ["x"]}, "drug"),
        ([("drug", "treats", "disease"), ("drug", "targets", "gene")], {"gene": ["g"]}, "drug"),
        ([("drug", "treats", "disease"), ("drug", "targets", "gene"), ("gene", "linked", "disease")], {"disease": ["x", "y"]}, "drug"),
    ]
    for hops, pins, back in cases:
        want = []

        def bind(i, env):
            if i == len(hops):
                want.append(tuple(sorted(env.items())))
                return
            a, p, b = hops[i]
            for s, q, o in edges:
                if q == p and env.get(a, s) == s and env.get(b, o) == o and (a not in pins or s in pins[a]) and (b not in pins or o in pins[b]):
                    bind(i + 1, env | {a: s, b: o})

        bind(0, {})
        p = plan(hops, pins, back)
        refs = sorted({r for h in hops for r in (h[0], h[2])})
        got = [tuple((r, row[r]) for r in refs) for row in match.match(graph, p).collect()]
        assert sorted(got) == sorted(want)


def test_where_a_pattern_breaks(graph):
    p = plan([("drug", "treats", "disease"), ("disease", "linked", "gene")], {"drug": ["d1"]}, "gene")
    assert [(r["n_edges"], r["n_joined"]) for r in match.hop_counts(graph, p).orderBy("step").collect()] == [(2, 2), (2, 0)]


def test_plan_faults_order_and_fingerprint():
    good = plan([("a", "p", "b"), ("c", "q", "b")], {"c": ["1"]}, "a")
    assert good.check() == [] and good.join_order() == [1, 0]
    bad = Plan((Entity("a"), Entity("a"), Entity("9x", ids=("i",))), (Hop("a", "p", "a"), Hop("a", "p", "z")), "q")
    text = "; ".join(bad.check())
    for part in ("declared twice", "no entity name", "to itself", "no entity", "pinned", "does not reach q"):
        assert part in text
    with pytest.raises(PlanError):
        match.match(None, bad)
    apart = Plan((Entity("a", ids=("1",), is_variable=False), Entity("b"), Entity("c"), Entity("d")), (Hop("a", "p", "b"), Hop("c", "p", "d")), "b")
    assert "not connected" in "; ".join(apart.check())
    doc = {"entities": [{"ref": "a", "ids": ["2", "1"]}, {"ref": "b"}], "hops": [{"subject": "a", "predicate": "p", "object": "b"}], "returns": "b"}
    other = json.loads(json.dumps(doc))
    other["entities"][0]["ids"].reverse()
    other["entities"].reverse()
    assert Plan.read(doc).fingerprint() == Plan.read(json.dumps(other)).fingerprint()
    other["hops"][0]["predicate"] = "r"
    assert Plan.read(doc).differences(Plan.read(other)) == [("hops.0.predicate", "p", "r")]


def test_closing_hop_and_distinct_nodes(spark):
    e = spark.createDataFrame([("1", "a", "p", "b"), ("2", "b", "p", "a"), ("3", "b", "p", "c")], "edge_id string, subject string, predicate string, object string")
    p = plan([("x", "p", "y"), ("y", "p", "z")], {"x": ["a"]}, "z")
    assert [r["z"] for r in match.match(e, p).collect()] == ["c"]
    assert sorted(r["z"] for r in match.match(e, p, distinct_nodes=False).collect()) == ["a", "c"]


def test_apply_op_on_lists_and_nulls(spark):
    df = spark.createDataFrame([(["Red", "blue"],), ([],), (None,), (["5", "x"],)], "v array<string>")
    run = lambda op, x=None: [r[0] for r in df.select(apply_op(op, F.col("v"), x)).collect()]
    assert run("eq", "red") == [True, False, False, False]
    assert run("neq", "red") == [False, True, False, True]
    assert run("not_in", ["BLUE"]) == [False, True, False, True]
    assert run("contains", "LU") == [True, False, False, False]
    assert run("gte", "5") == [False, False, False, True] and run("gt", "much") == [False] * 4
    assert run("exists") == [True, True, False, True] and run("not_exists") == [False, False, True, False]
    with pytest.raises(ValueError):
        run("like", "x")
    assert [r[0] for r in spark.createDataFrame([(1,), (None,)], "x int").select(as_list(F.col("x"))).collect()] == [["1"], []]


def test_attributes_on_both_levels(spark):
    inner = [("biolink:publications", None, None, None, None, ["pmid:2", "PMC1", "doi:3"])]
    attrs = [("biolink:knowledge_level", None, None, None, None, ["", "prediction"], []), ("negated", None, None, None, None, ["TRUE"], []), ("x:outer", None, None, None, "My-Field Name", ["7"], inner)]
    df = spark.createDataFrame([(attrs, [("s1", "primary_knowledge_source"), ("s2", None)]), ([], []), (None, None)], f"a array<{A.ATTRIBUTE}>, s array<{A.SOURCE}>").withColumn("a", A.flat(F.col("a")))
    rows = df.select(A.publications(F.col("a")), A.first_value(F.col("a"), "knowledge_level", "not_provided"), A.negated(F.lit(None).cast("boolean"), F.col("a")), A.named(F.col("a"), "my_field_name"), A.primary_source(F.col("s")), A.by_role(F.col("s"), "unknown"), A.names(F.col("a"))).collect()
    assert tuple(rows[0]) == (["PMC1", "pmid:2"], "prediction", True, ["7"], "s1", ["s2"], ["knowledge_level", "negated", "outer", "publications"])
    assert rows[1][1] == rows[2][1] == "not_provided" and rows[1][2] is False


def test_small_projections(spark):
    row = spark.range(1).select(A.year(F.lit("n.d."), F.lit("Spring 1999")), A.camel_case(F.lit("gene or_protein")), A.iri_to_curie(F.lit("http://x.example/obo/AB_12")), A.prefixed(F.lit("treats")), A.path_description(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.array(F.lit("p"), F.lit("q"))), A.number_or_flag(F.lit("Approved")), A.number_or_flag(F.lit("maybe"))).first()
    assert tuple(row) == (1999, "GeneOrProtein", "AB:12", "biolink:treats", "A --[p]--> B --[q]--> C", 1.0, None)


def test_scores(spark):
    row = spark.range(1).select(S.edge_score(F.lit("prediction"), F.lit("x"), F.lit(0), F.lit(3), F.lit(0.7)), S.publication_score(F.lit(10)), S.literature_score(F.lit(0), F.lit(0)), S.literature_score(F.lit(3), F.lit(0)), S.literature_score(F.lit(3), F.lit(3)), S.preference_score(F.lit("b"), ["a", "b", "c"]), S.combined(F.array(F.lit(0.5), F.lit(0.2)), "product")).first()
    assert [None if v is None else round(v, 6) for v in row] == [0.545, 1.0, None, 0.0, 1.0, 0.7, 0.1]


def test_rules_count_missing_and_mismatch(spark):
    df = spark.createDataFrame([(None, 3), ("a", 0), ("b", 5), ("a", None)], "s string, n int")
    use = [rules.present("has", "s"), rules.one_of("is_a", "s", ["a"]), rules.at_least("n2", "n", 2)]
    got = {r["rule"]: tuple(r)[1:5] for r in rules.account(df, use).collect()}
    assert got == {"has": (4, 1, 1, 0), "is_a": (4, 2, 1, 1), "n2": (4, 2, 2, 0), "all": (4, 4, 0, 4)}
    assert rules.kept(df, use).count() == 0 and rules.account(df.limit(0), use).count() == 4


def test_normalising_and_unknown_values(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("b", 3, 5.0), ("c", None, None)], "id string, x int, y double")
    n = ranking.normalised(df, {"x": "asc", "y": "desc"}).withColumn("s", ranking.weighted_mean({"x": 1, "y": 3}))
    assert {r["id"]: (r["n_x"], r["n_y"], r["s"]) for r in n.collect()} == {"a": (1.0, 0.5, 0.625), "b": (0.0, 0.5, 0.375), "c": (None, None, None)}


def test_round_robin_and_reading(spark):
    df = spark.createDataFrame([("g", i) for i in range(5)] + [("h", 10), ("k", 20)], "grp string, v int")
    assert [r["v"] for r in ranking.round_robin(df, ["grp"], [F.col("v")], 5).orderBy("rank").collect()] == [0, 10, 20, 1, 2]
    d = spark.createDataFrame([("a", i, i == 3) for i in range(8)] + [("b", i, i == 0) for i in range(8)] + [("c", 0, False)], "g string, v int, ok boolean")
    read = ranking.reading_prefix(d, ["g"], [F.col("v")], F.col("ok")).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in read} == {"a": 4, "b": 3, "c": 1}


def test_simple_paths_equal_a_depth_first_search(spark):
    import random

    rng = random.Random(5)
    e = [(str(i), f"n{rng.randint(0, 7)}", "p", f"n{rng.randint(0, 7)}") for i in range(16)]
    df = spark.createDataFrame(e, "edge_id string, subject string, predicate string, object string")
    want = []

    def go(trail, used):
        if trail[-1] == "n1":
            want.append((tuple(trail), tuple(used)))
            return
        if len(used) == 4:
            return
        for i, a, _, b in e:
            for x, y in ((a, b), (b, a)):
                if x == trail[-1] and y not in trail:
                    go([*trail, y], [*used, i])

    go(["n0"], [])
    got = [(tuple(r["nodes"]), tuple(r["edges"])) for r in paths.simple_paths(df, ["n0"], ["n1"], 4).collect()]
    assert sorted(got) == sorted(want) and len(got) == len(set(got))
    routes = paths.distinct_routes(paths.simple_paths(df, ["n0"], ["n1"], 4)).collect()
    assert sum(r["variant_count"] for r in routes) == len(want)


def test_sources_by_whole_words(spark):
    ids = ["infores:automat-ctd", "infores:mygene-info", "infores:drug-central", "infores:text-mining-provider-targeted", "infores:go", "infores:gtopdb", "infores:semmeddb2", "", None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "s string").select(A.source_class(F.col("s"))).collect()]
    assert got == ["curated", "other", "curated", "text_mined", "curated", "curated", "text_mined", "other", "other"]


def test_what_a_path_may_be_used_for(spark):
    rows = [([], []), (["biolink:treats", "biolink:causes"], [False, False]), (["biolink:treats", "biolink:affects"], [False, True]), (["biolink:related_to", "biolink:same_as"], [False, False]), (["biolink:causes", "biolink:treats"], [False, False]), (None, None)]
    df = spark.createDataFrame(rows, "p array<string>, n array<boolean>")
    assert [r[0] for r in df.select(paths.verdict(F.col("p"), F.col("n"))).collect()] == ["malformed", "contrary", "negated", "no_mechanism", "ok", "malformed"]


def test_the_first_rule_a_path_breaks(spark):
    rows = [(["a", "b", "a"], ["Gene"], ["p"], [False], [3]), (["a", "b"], ["Gene", "Pathway"], ["p"], [False], [3]), (["a", "b"], ["Gene"], ["p", "q"], [False], [3]), (["a", "b"], ["Gene"], ["r"], [False], [3]), (["a", "b"], ["Gene"], ["p"], [True], [3]), (["a", "b"], ["Gene"], ["p"], [False], [3, 0]), (["a", "b"], [], ["p"], [False], [1])]
    df = spark.createDataFrame(rows, "nodes array<string>, mid array<string>, p array<string>, neg array<boolean>, pubs array<int>")
    c = paths.drop_reason(*[F.col(x) for x in ("nodes", "mid", "p", "neg", "pubs")], allowed_middles=("Gene",), allowed=("p", "r"), required=("p",), least_publications=1)
    assert [r[0] for r in df.select(c).collect()] == ["repeated_node", "middle_category_not_allowed", "predicate_not_whitelisted", "required_predicate_absent", "negated_edge", "insufficient_publications", "kept"]


def test_sets(spark):
    a, b = spark.createDataFrame([("x",), ("y",), ("x",)], "id string"), spark.createDataFrame([("y",), ("z",)], "id string")
    assert {tuple(r) for r in sets.union_of({"P1": a, "P2": b}, "id").collect()} == {("x", 1, "P1"), ("y", 2, "P1;P2"), ("z", 1, "P2")}
    assert [r["id"] for r in sets.intersection_of({"P1": a, "P2": b}, "id").collect()] == ["y"]
    assert [r["id"] for r in sets.except_of(a, b, "id").collect()] == ["x"]


def limiter(rows, limit, window):
    held, out = {}, {}
    for k, c, t in sorted(rows, key=lambda r: (r[2], r[0])):
        h = [x for x in held.get(c, []) if x >= t - dt.timedelta(seconds=window)]
        out[k] = len(h) < limit
        held[c] = [*h, t] if out[k] else h
    return out


def test_rate_limit_in_batch_and_stream(spark, tmp_path):
    import random

    rng = random.Random(2)
    t0 = dt.datetime(2031, 1, 1)
    rows = [(i, rng.choice(["a", "b", "hot", "hot", "hot"]), t0 + dt.timedelta(seconds=rng.randint(0, 3000))) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, who string, at timestamp")
    want = limiter(rows, 3, 600)
    assert {r["id"]: r["is_admitted"] for r in ratelimit.admitted(df, "who", "at", "id", 3, 600).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ratelimit.admitted_stream(stream, "who", "at", "id", 3, 600).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["id"]: r["is_admitted"] for r in spark.table("limited").collect()} == want


def test_expiry(spark):
    t = lambda d: dt.datetime(2031, 1, d)
    df = spark.createDataFrame([("k", 1, "success", t(1)), ("k", 2, "error", t(2)), ("m", 3, "timeout", t(1)), ("n", 4, "success", t(1))], "key string, id int, status string, at timestamp")
    got = {r["key"]: (r["id"], r["is_fresh"]) for r in expiry.latest_fresh(df, "key", "at", "id", "2031-01-05 00:00:00").collect()}
    assert got == {"k": (2, False), "m": (3, True), "n": (4, True)}
    assert expiry.purge(df, "at", "2031-01-10 00:00:00").count() == 2


def test_documents(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"graphs": [{"edges": [{"sub": "a", "pred": "is_a", "obj": "b"}, {"sub": "a", "pred": "part_of", "obj": "c"}]}]}, indent=1))
    assert [tuple(r) for r in documents.read_ontology(spark, str(tmp_path / "o.json")).collect()] == [("a", "b")]
    (tmp_path / "q.txt").write_text("# list\n\nWhat?  | yes\nWhy?\n")
    assert {tuple(r) for r in documents.read_questions(spark, str(tmp_path / "q.txt")).collect()} == {("What?", "yes"), ("Why?", None)}
    documents.write_versioned(spark.range(3).toDF("x"), str(tmp_path / "v"), "1.0")
    assert spark.read.parquet(str(tmp_path / "v")).where("version = '1.0'").count() == 3
    documents.write_result(spark.range(2).toDF("x"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
