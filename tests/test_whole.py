"""Queries that judge every row, also those that their narrower sisters leave out."""

import json
import os

import pytest

from graphloom.queries import QUERIES
from graphloom.sources.graph import nodes

DATA = "/root/testdata/sf0.001"


def test_every_spelling_of_a_time_gets_a_verdict(spark, tmp_path):
    times = {"2031-05-12T05:07:02.215819Z": True, "2031-09-13T05:07:02.215819Z": False, "2031-05-12 05:58:45": True, "2031-07-12 05:58:45": False, "2031-06-01T01:00:00+02:00": True, "2031-07-01T00:00:00+00:00": False, "soon": True, "05:07:02": True, "2031-13-45 00:00:00": True, "": True, None: True}
    spark.createDataFrame([(t,) for t in times], "fetched_at string").write.parquet(str(tmp_path / "cache_entries.parquet"))
    assert {r["fetched_at"]: r["is_stale"] for r in QUERIES["fil31_stale"](spark, str(tmp_path)).collect()} == times


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_all_nodes_have_a_token_and_their_own_label(spark):
    n = {r["id"]: r["name"] for r in nodes(spark, DATA).collect()}
    assert any(i.startswith("ORD:") for i in n)
    assert {*n, *n.values()} <= {r["token"] for r in QUERIES["agg20_lexicon"](spark, DATA).collect()}
    labels = {r["id"]: r["label"] for r in QUERIES["prj26_label_index"](spark, DATA).collect()}
    assert n.items() <= labels.items()


def test_every_request_body_is_judged(spark, tmp_path):
    good = '{"endpoint": "x", "query_graph": {}}'
    bodies = [(good, True), (json.dumps(good), True), (json.dumps(json.dumps(good)), True), (" " + good, True), ('{"endpoint": "x"}', False), (json.dumps('{"curie": "c"}'), False), ('{"endpoint": 1, "query_graph": 2, "more": 3}', False), ('{"endpoint": 1, "endpoint": 1, "query_graph": 2}', False), ("[]", False), ('[["endpoint", 1], ["query_graph", 2]]', False), ("7", False), ("null", False), ("", False), ('{"endpoint": "x', False), ("plain", False)]
    spark.createDataFrame([(i, b) for i, (b, _) in enumerate(bodies)] + [(99, None)], "entry_id bigint, request_json string").write.parquet(str(tmp_path / "cache_entries.parquet"))
    got = {r["entry_id"]: r["is_accepted"] for r in QUERIES["src16_strict_requests"](spark, str(tmp_path)).collect()}
    assert got == {i: ok for i, (_, ok) in enumerate(bodies)}
