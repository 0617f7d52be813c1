import json

from graphloom.operators import drift

LINES = "file_id bigint, line_no int, raw_line string, name string, store_id string"
FILES = "file_id bigint, store_id string, file_name string, dumped_at timestamp, name string"


def tables(spark, files, lines):
    import datetime as dt

    f = spark.createDataFrame([(i, s, "f", dt.datetime(2031, 1, d) if d else None, "x") for i, s, d in files], FILES)
    return spark.createDataFrame([(i, n, r, "x", "y") for i, n, r in lines], LINES), f


def entry(k, **more):
    return json.dumps({"key": k, "fetched_at": "t"} | more)


def changes(spark, files, lines):
    a, b = tables(spark, files, lines)
    return {tuple(r) for r in drift.changes(a, b).select("file_id", "change_kind", "field_name", "old_name").collect()}


def test_all_kinds_of_change_and_dirty_lines(spark):
    lines = [(9, i, entry(f"k{i}", ver=f"1.{i}", gone=1, n=str(i))) for i in range(10)]
    lines += [(9, 50, None), (9, 51, ""), (9, 52, '{"key": "cut'), (9, 53, "[1]"), (9, 54, "null"), (9, 55, "# note")]
    lines += [(4, i, "\ufeff" + entry(f"k{i}", version=f"1.{i}", came=[1], n=i)) for i in range(10)]
    lines += [(4, 3, entry("k3", version="1.3", came=[1], n=3)), (None, 1, entry("z", q=1))]
    got = changes(spark, [(9, "s", 1), (4, "s", 2)], lines)
    assert got == {(4, "renamed", "version", "ver"), (4, "removed", "gone", ""), (4, "added", "came", ""), (4, "retyped", "n", "")}


def test_renames_compare_text_across_types(spark):
    a = [(1, i, entry(i_, a=1.50 if i % 2 else True)) for i, i_ in enumerate("pqrs")]
    b = [(2, i, '{"key": "%s", "fetched_at": "t", "b": "%s"}' % (i_, "1.5" if i % 2 else "true")) for i, i_ in enumerate("pqrs")]
    assert changes(spark, [(1, "s", 1), (2, "s", 2)], a + b) == {(2, "renamed", "b", "a"), (2, "retyped", "b", "")}


def test_number_text_is_kept_as_written(spark):
    a = [(1, i, '{"key": "%d", "fetched_at": "t", "a": 1.50}' % i) for i in range(4)]
    b = [(2, i, '{"key": "%d", "fetched_at": "t", "b": "1.5"}' % i) for i in range(4)]
    assert changes(spark, [(1, "s", 1), (2, "s", 2)], a + b) == {(2, "removed", "a", ""), (2, "added", "b", "")}


def test_a_rename_needs_three_entries_and_four_fifths(spark):
    def run(n, equal):
        a = [(1, i, entry(f"k{i}", a=f"v{i}")) for i in range(n)]
        b = [(2, i, entry(f"k{i}", b=f"v{i}" if i < equal else "other")) for i in range(n)]
        return "renamed" in {c[1] for c in changes(spark, [(1, "s", 1), (2, "s", 2)], a + b)}

    assert not run(2, 2) and run(3, 3) and run(5, 4) and not run(4, 3)


def test_arrays_and_objects_equal_nothing(spark):
    a = [(1, i, entry(f"k{i}", a=[1])) for i in range(5)]
    b = [(2, i, entry(f"k{i}", b=[1])) for i in range(5)]
    assert {c[1] for c in changes(spark, [(1, "s", 1), (2, "s", 2)], a + b)} == {"added", "removed"}


def test_a_field_needs_a_tenth_of_the_lines(spark):
    a = [(1, i, entry(f"k{i}")) for i in range(20)]
    b = [(2, i, entry(f"k{i}", **({"rare": 1} if i < 1 else {}), **({"tenth": 1} if i < 2 else {}), nothing=None)) for i in range(20)]
    assert changes(spark, [(1, "s", 1), (2, "s", 2)], a + b) == {(2, "added", "tenth", "")}


def test_order_by_time_not_by_id_and_stores_apart(spark):
    lines = [(5, 0, entry("a", x=1)), (2, 0, entry("a", x=1, y=1)), (7, 0, entry("a", z=1))]
    assert changes(spark, [(5, "s", 1), (2, "s", 3), (7, "t", 2)], lines) == {(2, "added", "y", "")}


def test_file_without_counting_lines_and_empty_tables(spark):
    got = changes(spark, [(1, "s", 1), (2, "s", 2)], [(1, 0, entry("a", x=1)), (2, 0, "")])
    assert got == {(2, "removed", f, "") for f in ("key", "fetched_at", "x")}
    assert changes(spark, [], []) == set()


def test_unified_table(spark):
    lines = [(1, i, entry(f"k{i}", ver=str(i), ok=True)) for i in range(5)] + [(2, i, entry(f"k{i}", version=i, ok=False, **({"odd": 1} if i == 0 else {}))) for i in range(15)]
    a, b = tables(spark, [(1, "s", 1), (2, "s", 2)], lines)
    t = drift.unified(a, b)
    assert dict(t.dtypes)["f_ok"] == "boolean" and not {"f_ver", "f_version"} <= set(t.columns)
    name = "f_ver" if "f_ver" in t.columns else "f_version"
    assert t.where(f"{name} is not null").count() == 20
    assert t.where("map_contains_key(extra, 'odd')").count() == 1


def test_unified_keeps_what_no_column_can_hold(spark):
    lines = [(1, i, entry(f"k{i}", ver=str(i), n=i, ok=True)) for i in range(9)] + [(1, 9, entry("k9", ver="9", n="many", ok="maybe"))]
    lines += [(2, i, entry(f"k{i}", version=str(i), n=i, ok=True)) for i in range(20) if i != 9] + [(2, 9, entry("k9", version="9", ver="nine", n=["a"], ok=False))]
    a, b = tables(spark, [(1, "s", 1), (2, "s", 2)], lines)
    t = drift.unified(a, b)
    assert dict(t.dtypes)["f_n"] == "bigint" and dict(t.dtypes)["f_ok"] == "boolean"
    extra = {(r["file_id"], r["line_no"]): r["extra"] for r in t.where("size(extra) > 0").collect()}
    assert extra[1, 9] == {"n": "many", "ok": "maybe"}
    assert extra[2, 9]["n"] == '["a"]' and extra[2, 9].keys() - {"n"} in ({"ver"}, {"version"})


def test_chains_of_renames_are_one_column(spark):
    names = ["a", "b", "c", "c", "c"]
    lines = [(k, i, entry(f"k{i}", **{n: f"v{i}"})) for k, n in enumerate(names) for i in range(5)]
    files = [(k, "s", k + 1) for k in range(5)]
    lines += [(9, i, entry(f"q{i}", a=f"w{i}")) for i in range(5)]  # another store knows one of the names
    a, b = tables(spark, [*files, (9, "t", 1)], lines)
    t = drift.unified(a, b)
    assert set(t.columns) == {"file_id", "line_no", "f_key", "f_fetched_at", "f_c", "extra"}
    assert t.where("f_c is not null").count() == 30
    log = [tuple(r) for r in drift.change_log(a, b).orderBy("store_id", "file_no", "change_no").select("store_id", "file_no", "change_no", "change_kind", "field_name", "old_name").collect()]
    assert log == [("s", 2, 1, "renamed", "b", "a"), ("s", 3, 1, "renamed", "c", "b")]


def test_one_name_for_two_fields_is_tied_within_stores_only(spark):
    lines = [(k, i, entry(f"k{i}", **{n: f"v{i}"})) for k, n in enumerate(["a", "b"]) for i in range(5)]
    lines += [(5, i, entry(f"k{i}", a=f"x{i}", b=f"y{i}")) for i in range(5)]
    a, b = tables(spark, [(0, "s", 1), (1, "s", 2), (5, "t", 1)], lines)
    t = drift.unified(a, b)
    assert {"f_a", "f_b"} <= set(t.columns)
    both = t.where("file_id = 5 and f_a is not null and f_b is not null")
    assert both.count() == 5 and t.where("file_id < 5 and f_b is not null and f_a is null").count() == 10


def test_types_are_folded_without_loss(spark):
    import datetime as dt
    from decimal import Decimal

    raw = '{"key": "k%d", "big": %s, "dec": %s, "sci": %s, "mix": %s, "day": "%s", "arr": [1, 2.50], "obj": {"a": 1.0}}'
    vals = [("9007199254740993", "1", "1e3", "12345678901234567890", "2031-01-02"), ("1", "9007199254740993.25", "2.5", "1e-3", "2031-01-02T03:04:05Z")]
    a, b = tables(spark, [(1, "s", 1)], [(1, i, raw % (i, *v)) for i, v in enumerate(vals)])
    t = drift.unified(a, b).orderBy("line_no")
    kinds = dict(t.dtypes)
    assert (kinds["f_big"], kinds["f_dec"], kinds["f_sci"], kinds["f_mix"], kinds["f_day"]) == ("bigint", "decimal(18,2)", "double", "string", "timestamp")
    r = t.collect()
    assert r[0]["f_big"] == 9007199254740993 and r[1]["f_dec"] == Decimal("9007199254740993.25") and r[0]["f_sci"] == 1000.0
    assert [x["f_mix"] for x in r] == ["12345678901234567890", "1e-3"] and r[0]["f_arr"] == "[1,2.50]" and r[0]["f_obj"] == '{"a":1.0}'
    assert r[1]["f_day"] == dt.datetime(2031, 1, 2, 3, 4, 5)
    assert drift.unified(a.limit(0), b).columns == ["file_id", "line_no", "extra"]
