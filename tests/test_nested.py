import json
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.operators import nested


def walk(o, path="", in_array=False):
    if isinstance(o, dict):
        if in_array:
            yield path
        for k, v in o.items():
            yield from walk(v, f"{path}/{k}")
    elif isinstance(o, list):
        for i, v in enumerate(o):
            yield from walk(v, f"{path}/{i}", True)


def found(text):
    ix = nested.StructuralIndex(text.encode())
    paths, _ = ix.paths()
    return sorted(p for p, o, k in zip(paths, ix.is_object, ix.place) if o and k >= 0)


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text('ab"\\{}[],:/é', max_size=4), c, max_size=4), max_leaves=25)


@settings(max_examples=150, deadline=None)
@given(st.lists(values, min_size=1, max_size=3) | st.dictionaries(st.text(max_size=3), values, min_size=1, max_size=3), st.sampled_from([None, 1]), st.booleans())
def test_index_equals_a_recursive_walk(doc, indent, ascii_only):
    assert found(json.dumps(doc, indent=indent, ensure_ascii=ascii_only)) == sorted(walk(doc))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text('xy"\\', max_size=3), values, min_size=1, max_size=4))
def test_scalars_are_the_members_that_hold_no_others(doc):
    text = json.dumps(doc)
    ix = nested.StructuralIndex(text.encode())
    scalars = ix.scalars().get(0, [])
    want = {k: v for k, v in doc.items() if not isinstance(v, (dict, list))}
    assert {k: json.loads(v) for k, v, _ in scalars} == want
    assert {k: x for k, _, x in scalars} == {k: v if isinstance(v, str) else None if v is None else json.dumps(v) for k, v in want.items()}


@pytest.mark.parametrize("raw", [None, "", "   ", "{", '{"a": [', "nul", '{"a": 1} x', zlib.compress(b'{"a": [{}]}')[:-5], b"\xff\xfe", '"just text"', "3", "null"])
def test_unreadable_documents_give_nothing(raw):
    assert nested.read_document(raw) is None


@pytest.mark.parametrize("raw", ['{"a": [{}]}', b'{"a": [{}]}', zlib.compress(b'{"a": [{}]}'), '"{\\"a\\": [{}]}"', "\ufeff" + '{"a": [{}]}', json.dumps(json.dumps(json.dumps({"a": [{}]})))])
def test_readable_documents(raw):
    assert json.loads(nested.read_document(raw)) == {"a": [{}]}


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    deep = "[" * 200 + '{"x": 1}' + "]" * 200
    rows = [
        (1, '{"r": [{"a": {"b": [{"id": "z"}, {}]}}, 5, null, {"c": "[{}]"}]}', None, None, "p", "q"),
        (1, '{"r": [{"a": {"b": [{"id": "z"}, {}]}}, 5, null, {"c": "[{}]"}]}', None, None, "other", "q"),
        (2, None, bytearray(zlib.compress(b'[{"k": []}]')), "{}", None, None),
        (3, "", bytearray(b""), "[]", None, None),
        (None, '[{"n": 1}]', None, None, None, None),
        (4, deep, None, json.dumps({"l": [{"t": "x" * 3_000_000}]}), None, None),
    ]
    df = spark.createDataFrame(rows, "entry_id bigint, request_json string, response_blob binary, meta_json string, doc_field string, elem_path string")
    got = {(r["entry_id"], r["doc_field"], r["elem_path"]) for r in nested.elements(df).collect()}
    assert got == {(1, "request_json", "/r/0"), (1, "request_json", "/r/0/a/b/0"), (1, "request_json", "/r/0/a/b/1"), (1, "request_json", "/r/3"), (2, "response_blob", "/0"), (None, "request_json", "/0"), (4, "request_json", "/0" * 200), (4, "meta_json", "/l/0")}
    objects = nested.shredded(df)
    rows = {(r["entry_id"], r["doc_field"], r["node_path"]): r for r in objects.collect()}
    assert rows[1, "request_json", "/r/0/a/b/0"]["parent_path"] == "/r/0/a"
    assert rows[1, "request_json", "/r/0/a/b/0"]["member"] == "b"
    assert rows[1, "request_json", ""]["parent_path"] is None
    flat = nested.flat_table(objects, ("b",), ("id",)).collect()
    assert {(r["node_path"], r["m_id"]) for r in flat} == {("/r/0/a/b/0", "z"), ("/r/0/a/b/1", None)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "entry_id bigint, request_json string, response_blob binary, meta_json string")
    assert nested.elements(df).count() == 0
    assert nested.shredded(df).count() == 0


def test_chunks_split_a_batch(spark, monkeypatch):
    rng = random.Random(1)
    docs = [json.dumps({"r": [{"v": "y" * rng.randint(0, 900)} for _ in range(rng.randint(0, 5))]}) for _ in range(60)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(docs)], ["k", "t"])
    monkeypatch.setattr(nested, "CHUNK_BYTES", 3000)
    seen = [o for buf, owners, starts in nested._chunks(batch, "k", ("t",)) for o in owners]
    assert [k for k, _ in seen] == list(range(60))


def leaves(o, path=""):
    if isinstance(o, list) and not o:
        yield path, None, []
    for k, v in o.items() if isinstance(o, dict) else enumerate(o):
        if isinstance(v, (dict, list)):
            yield from leaves(v, f"{path}/{k}")
        elif isinstance(o, list):
            yield f"{path}/{k}", k, v


@settings(max_examples=150, deadline=None)
@given(st.lists(values, max_size=3) | st.dictionaries(st.text(max_size=3), values, min_size=1, max_size=3), st.sampled_from([None, 1]))
def test_scalar_elements_equal_a_recursive_walk(doc, indent):
    ix = nested.StructuralIndex(json.dumps(doc, indent=indent).encode())
    paths, _ = ix.paths()
    got = [(paths[i] if place is None else f"{paths[i]}/{place}", place, json.loads(text)) for i, place, text in ix.elements()]
    assert sorted(got, key=repr) == sorted(leaves(doc), key=repr)


def test_scalar_elements_are_rows_tied_to_their_object(spark):
    doc = '{"attributes": [{"value": ["PMID:1", 2.50, null, [true], {"x": 1}], "none": []}]}'
    rows = [(1, doc, None, None), (1, doc, None, None), (2, None, bytearray(b'["\\u00e9", 7]'), "{}"), (3, "[", None, None)]
    df = spark.createDataFrame(rows, "entry_id bigint, request_json string, response_blob binary, meta_json string")
    got = {tuple(r) for r in nested.array_values(df).collect()}
    top, at = "/attributes/0", "/attributes/0/value"
    assert got == {
        (1, "request_json", f"{at}/0", top, "value", 0, '"PMID:1"'), (1, "request_json", f"{at}/1", top, "value", 1, "2.50"), (1, "request_json", f"{at}/2", top, "value", 2, "null"),
        (1, "request_json", f"{at}/3/0", top, "value", 0, "true"), (1, "request_json", f"{top}/none", top, "none", None, "[]"),
        (2, "response_blob", "/0", "", "", 0, '"\\u00e9"'), (2, "response_blob", "/1", "", "", 1, "7"),
    }
    assert nested.array_values(df).count() == len(got)


def test_edges_and_nodes_of_maps_and_arrays(spark):
    graph = {"nodes": {"A:1": {"name": "caf\u00e9 \"x\"", "info": {"k": 1}}, "B/2": {"name": None}}, "edges": {"e/0": {"subject": "A:1", "object": "B/2", "predicate": "p", "sources": [{"resource_id": "r"}], "more": {"w": 1}}}}
    listed = {"nodes": [{"id": "null"}], "edges": [{"subject": "s", "object": 3, "more": {"w": 1}}], "paths": [[{"edges": [{"t": 1}]}]]}
    df = spark.createDataFrame([(1, json.dumps({"message": {"knowledge_graph": graph}}), None, json.dumps({"edge": {"subject": "q"}, "edges": ["e0"]})), (2, json.dumps(listed), None, None)], "entry_id bigint, request_json string, response_blob binary, meta_json string")
    objects = nested.shredded(df)
    edges = {(r["entry_id"], r["node_path"], r["m_subject"], r["m_predicate"], r["m_object"]) for r in nested.held_table(objects, "edges", "edge", ("subject", "predicate", "object")).collect()}
    assert edges == {(1, "/message/knowledge_graph/edges/e/0", "A:1", "p", "B/2"), (1, "/edge", "q", None, None), (2, "/edges/0", "s", None, "3"), (2, "/paths/0/0/edges/0", None, None, None)}
    nodes = {(r["entry_id"], r["member"], r["m_id"], r["m_name"]) for r in nested.held_table(objects, "nodes", "node", ("id", "name")).collect()}
    assert nodes == {(1, "A:1", None, 'caf\u00e9 "x"'), (1, "B/2", None, None), (2, "nodes", "null", None)}


def test_objects_query_keeps_scalars(spark, tmp_path):
    from graphloom.queries import QUERIES

    df = spark.createDataFrame([(1, '{"a": {"subject": "x", "n": 1}}', None, None)], "entry_id bigint, request_json string, response_blob binary, meta_json string")
    df.write.parquet(str(tmp_path / "cache_entries.parquet"))
    rows = {r["node_path"]: r for r in QUERIES["p5_objects"](spark, str(tmp_path)).collect()}
    assert [tuple(s) for s in rows["/a"]["scalars"]] == [("subject", '"x"', "x"), ("n", "1", "1")] and rows["/a"]["n_scalars"] == 2


def test_flat_tables_say_what_the_scalars_say(spark):
    doc = '{"attributes": [{"value": "a\\n\\"b\\u00e9\\/"}, {"value": "null"}, {"value": null}, {"value": 1.50}, {"value": "\\ud800x"}, {"value": "\\"q\\""}, {"value": "", "other": true}]}'
    df = spark.createDataFrame([(1, doc, None, None)], "entry_id bigint, request_json string, response_blob binary, meta_json string")
    objects = nested.shredded(df)
    rows = nested.flat_table(objects, ("attributes",), ("value", "other")).orderBy("place").collect()
    assert [r["m_value"] for r in rows] == ['a\n"bé/', "null", None, "1.50", "?x", '"q"', ""]
    assert [r["m_other"] for r in rows] == [None] * 6 + ["true"]
    assert nested.members(objects).count() == 8


def flat(doc, path="", parent=None, member=""):
    """(path, parent, member, scalars) of all objects, by a plain walk."""
    if isinstance(doc, dict):
        yield path, parent, member, {k: v for k, v in doc.items() if not isinstance(v, (dict, list))}
        for k, v in doc.items():
            yield from flat(v, f"{path}/{k}", path, k)
    elif isinstance(doc, list):
        for i, v in enumerate(doc):
            yield from flat(v, f"{path}/{i}", parent if parent is not None else "", member)


def test_whole_table_equals_a_plain_walk(spark):
    import os

    data = "/root/testdata/sf0.01/cache_entries.parquet"
    if not os.path.exists(data):
        pytest.skip("no test tables here")
    df = spark.read.parquet(data)
    got = {(r["entry_id"], r["doc_field"], r["node_path"]): (r["parent_path"], r["member"], {s["name"]: s["value"] for s in r["scalars"]}) for r in nested.shredded(df).collect()}
    want = {}
    for r in df.select("entry_id", *nested.DOC_FIELDS).collect():
        for field in nested.DOC_FIELDS:
            text = nested.read_document(r[field])
            if text is None:
                continue
            for path, parent, member, scalars in flat(json.loads(text, parse_float=lambda t: Raw(t), parse_int=lambda t: Raw(t))):
                want[r["entry_id"], field, path] = (parent, member, {k: None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for k, v in scalars.items()})
    assert got == want and len(got) > 10_000


class Raw(str):
    """A number as written."""
