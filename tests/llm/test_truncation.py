import json
import random

import pytest

from graphloom.llm import truncation as T


@pytest.mark.parametrize(
    "text,state",
    [
        ('{"a": "x"}', "closed"), ('{"a": "x', "open"), ('{"a": [1, 2', "open"), ("{'a': 'don't'}", "closed"), ("{'a': 'b', ", "open"), ('{"a": 1,}', "closed"),
        ('```json\n{"a": 1}\n```', "closed"), ('```json\n{"a": 1}\n', "open"), ("```json", "open"), ('Sure! {"a": 1}', "closed"), ('Here it is.\n\n{"a": "b', "open"),
        ('{"a": 1}\n\nLet me know.', "closed"), ('{"a": 1}\n\nLet', "prose_open"), ('{"a": "x"}\n(end of reply)', "closed"),
        ("It ended well.", "prose_closed"), ("It ended w", "prose_open"), ("It ended well. ", "prose_open"), ("Она ушла?»", "prose_closed"), ("没有作用。”", "prose_closed"), ("It ended " + "w" * 500, "prose_open"), ("so it was [" + "cut " * 40 + "]", "prose_open"), ('ids ["a", "b"]', "closed"), ("so\n<" + "x" * 90 + ">\n", "prose_open"), ("It ended.\n(" + "note " * 30 + ")", "prose_closed"),
        ("It went on...", "ellipsis"), ("It went on…", "ellipsis"), ('{"a": "x...', "open"), ("It ended w\n<rest omitted>", "prose_open"), ("It ended w [+303 chars]", "prose_open"), ("It ended w [...]", "prose_open"),
        ("A claim [PMID:12]", "prose_open"), ("A claim [PMID:12].", "prose_closed"), ("x\n-- connection lost --", "prose_open"),
    ],
)
def test_endings(text, state):
    assert T.ending(text)[0] == state


def test_lengths_by_measure():
    t = 'a: é😀\n"&<'
    got = dict(zip(T.MEASURES, T.lengths(t)))
    assert got == {"chars": 9, "utf8": 13, "utf16": 10, "json": len(json.dumps(t)) - 2, "json_unicode": 11, "entities": 16, "crlf": 10, "unlabelled": 6}


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_hidden_limits_natural_endings_and_writers(spark):
    rows = []
    full = [words(20 + i % 30, i) + "." for i in range(200)]
    rows += [("t", i, "free", x) for i, x in enumerate(full)]
    rows += [("t", 1000 + i, "capped", (words(60, i) + ".")[:200]) for i in range(40)]
    closes = (words(80) + ".")[:199].rstrip()[:199].ljust(199, "x") + "."
    rows += [("t", 1100, "capped", closes), ("t", 1101, "free", closes)]
    rows += [("t", 1200 + i, "capped", json.dumps({"k": "v" * 191})) for i in range(3)]
    assert len(rows[-1][3]) == 200
    rows += [("t", 1300 + i, "free", f"read timeout after {30 + i}s") for i in range(40)] + [("t", 1400, "free", "read timeout af")]
    rows += [("t", 1500 + i, None, "why: " + words(5, i) + "\nEND") for i in range(10)] + [("t", 1600, None, "why: " + words(5) + ".")]
    rows += [("t", 1700, "capped", None), ("t", 1701, None, ""), ("t", 1000, "capped", (words(60, 0) + ".")[:200])]
    rows += [("u", 1 + i, "marked", words(60, i)[:150] + "...") for i in range(20)] + [("u", 50, "marked", "He waited..."), ("u", 51, None, words(60, 3)[:150] + "...")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "record_table string, record_id bigint, writer string, text string, state string")
    t = T.Truncation(df)
    got = {tuple(r) for r in t.cut().collect()}
    want = {("t", 1000 + i) for i in range(40)} | {("t", 1100), ("t", 1400), ("t", 1600)} | {("u", 1 + i) for i in range(20)} | {("u", 51)}
    assert got == want
    found = {(r["record_table"], r["writer"], r["size"]) for r in t.limits.where("measure = 'chars'").collect()}
    assert {("t", "capped", 200), ("u", "marked", 150)} <= found
    shares = {(r["record_table"], r["writer"]): (r["n_records"], r["n_cut"]) for r in t.shares().collect()}
    assert shares["t", "capped"] == (44, 41) and shares["t", None] == (11, 1)


def test_byte_limit(spark):
    rows = [("t", i, "w", (words(60, i) + "é" * (i % 5) + " " + words(60, i)).encode()[:300].decode("utf-8", "ignore")) for i in range(40)] + [("t", 100 + i, "w", words(5 + i, i) + ".") for i in range(40)]
    df = spark.createDataFrame(rows, "record_table string, record_id bigint, writer string, text string")
    assert T.Truncation(df).limits.where("measure = 'utf8' and size = 300").count() == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "record_table string, record_id bigint, writer string, text string")
    assert T.Truncation(df).cut().count() == 0 and T.Truncation(df).shares().count() == 0


def test_copies_and_templates_cut_at_one_place_are_cut(spark):
    rows = [("t", i, f"w{i % 3}", words(20 + i % 30, i) + ".") for i in range(200)]
    # one text that lost its end, under many ids of several writers
    rows += [("t", 1000 + i, f"w{i % 3}", "The route was found to be asso") for i in range(100)]
    # a template that all ends at its writer's limit, with a few other texts that do
    rows += [("t", 2000 + i, "capped", f"Run {100 + i} " + words(60, 0)[:142]) for i in range(100)]
    rows += [("t", 3000 + i, "capped", words(60, 7 + i)[:149] + "q") for i in range(10)]
    # the same ending as often elsewhere does not save what stands at the limit
    rows += [("t", 4000 + i, "free", f"read timeout after {30 + i}s") for i in range(60)] + [("t", 4100, "free", words(40) + ".")]
    rows += [("t", 5000 + i, "capped", (words(60, 90 + i)[:124].rstrip(" ").ljust(124, "x") + f" waited, timeout after {10 + i}s")[-150:]) for i in range(40)]
    rows += [("t", 6000 + i, None, "the connection timed out after 30s") for i in range(5)]
    assert {len(r[3]) for r in rows if r[2] == "capped"} == {150}
    t = T.Truncation(spark.createDataFrame(rows, "record_table string, record_id bigint, writer string, text string"))
    got = {r["record_id"] for r in t.cut().collect()}
    assert got == {*range(1000, 1100), *range(2000, 2100), *range(3000, 3010), *range(5000, 5040)}
    assert t.limits.where("writer = 'capped' and measure = 'chars' and size = 150").count() == 1


def test_words_that_need_more_are_learned(spark):
    rows = [("t", i, "w", f"{words(6, i)} in approx. 20 cases. " + f"{words(9, i)}. " * 3 + f"{words(7, i)}.") for i in range(300)]
    rows += [("t", 1000, "w", words(9) + " in approx."), ("t", 1001, "w", words(9) + " in “approx."), ("t", 1002, "w", words(9) + " approximately.")]
    t = T.Truncation(spark.createDataFrame(rows, "record_table string, record_id bigint, writer string, text string"))
    assert {r["record_id"] for r in t.cut().collect()} == {1000, 1001}


def test_last_lines_and_endings_count_whole(spark):
    closing = "so ends this long form, as all of its kind do"
    rows = [("t", i, "w", "a_label_of_more_than_twenty_letters: " + words(5, i) + "\n" + closing) for i in range(20)] + [("t", 100, "w", "a_label_of_more_than_twenty_letters: " + words(5) + ".")]
    long = "z" * 300
    rows += [("u", i, "w", words(4 + i % 9, i) + f" after {long}{i}s") for i in range(50)] + [("u", 100, "w", words(30) + " after y" + long[1:] + "0s")]
    t = T.Truncation(spark.createDataFrame(rows, "record_table string, record_id bigint, writer string, text string"))
    assert {tuple(r) for r in t.cut().collect()} == {("t", 100), ("u", 100)}
