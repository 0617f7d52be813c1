import random

from graphloom.llm import spans


def brute(rows, least):
    where = {}
    for k, t in rows:
        for i in range(len(t or "") - least + 1):
            where.setdefault(t[i : i + least], set()).add(k)
    pairs = {(a, b) for ks in where.values() for a in ks for b in ks if a < b}
    cover = {}
    for k, t in rows:
        if t is None or len(t) < least:
            continue
        m = [False] * len(t)
        for i in range(len(t) - least + 1):
            if len(where[t[i : i + least]]) > 1:
                m[i : i + least] = [True] * least
        cover[k] = max(cover.get(k, 0), sum(m))
    return pairs, cover


def check(spark, rows, least, sieve=None):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "string_id bigint, string_text string, text string, cls int")
    s = spans.SharedSpans(df, "string_id", "string_text", least, sieve)
    pairs, cover = brute([r for r in rows if r[0] is not None], least)
    got = [tuple(r) for r in s.pairs("string_a", "string_b").collect()]
    assert set(got) == pairs and len(got) == len(pairs)
    assert {r["string_id"]: r["shared_chars"] for r in s.coverage().collect()} == cover


def test_random_texts_with_planted_spans(spark):
    rng = random.Random(4)
    pieces = ["".join(rng.choice("abcdefgh é漢😀 ") for _ in range(rng.randint(10, 45))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pieces) if rng.random() < 0.3 else "".join(rng.choice("abcdxyz ") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 7)))) for i in range(150)]
    check(spark, rows, 20)
    check(spark, rows, 20, 5)


def test_lengths_just_below_at_and_above(spark):
    core = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    rows = [(1, "A" + core[:80] + "B"), (2, "C" + core[:79] + "D"), (3, core[:80]), (4, "zz" + core[1:90]), (5, core[:81])]
    check(spark, rows, 80)


def test_repeats_copies_runs_nulls_and_short_ones(spark):
    long = "x" * 300
    rows = [(1, "the same text over and over " * 3), (1, "the same text over and over " * 3), (2, "the same text over and over " * 3), (3, None), (4, ""), (5, "short"), (6, long), (7, long[:200] + "y"), (8, "ab" * 100), (9, "ba" * 90), (None, long), (10, "only once " * 2), (11, "z" * 19)]
    check(spark, rows, 20)


def test_one_record_with_two_texts(spark):
    rows = [(1, "first text with a common stretch inside"), (1, "second text, and a common stretch inside"), (2, "a common stretch inside of another"), (3, "second text, and nothing else of it")]
    check(spark, rows, 16)


def test_a_hot_span_and_a_very_long_text(spark):
    rng = random.Random(1)
    hot = "this stretch stands in a third of all of the records"
    rows = [(i, f"{rng.random()}{hot if i % 3 == 0 else ''}{rng.random()}") for i in range(120)]
    rows.append((999, "".join(rng.choice("abcdefghijklmnop") for _ in range(150_000)) + hot))
    check(spark, rows, 40)


def test_empty_table(spark):
    df = spark.createDataFrame([], "string_id bigint, string_text string")
    s = spans.SharedSpans(df, "string_id", "string_text")
    assert s.pairs("a", "b").count() == 0 and s.coverage().count() == 0


def test_window_minima_cover_every_window():
    import numpy as np

    rng = np.random.default_rng(0)
    for n, w in ((1, 5), (5, 5), (6, 5), (200, 25), (50, 1), (300, 64)):
        h = rng.integers(0, 9, n).astype(np.uint64)
        kept = set(spans._window_minima(h, w).tolist())
        for i in range(max(1, n - w + 1)):
            win = h[i : i + w]
            assert i + int(np.argmin(win)) in kept


def test_a_span_in_many_records_is_one_row_each(spark):
    span = "".join(chr(97 + (i * i + 7 * (i // 26)) % 26) for i in range(90))
    rows = [(i, "".join(random.Random(i).choices("abcdefghij", k=120)) + span + "".join(random.Random(-i - 1).choices("abcdefghij", k=90))) for i in range(400)] + [(1000, "q" * 100), (1001, "q" * 100), (1002, "r" * 100)]
    found = spans.SharedSpans(spark.createDataFrame(rows, "id bigint, text string"), "id", "text")
    assert 400 <= found.span_members().count() < 400 * 10  # branches at the ends of the span, not pairs
    got = {tuple(r) for r in found.connected().collect()}
    assert got == {(i, 0, 400) for i in range(400)} | {(1000, 1000, 2), (1001, 1000, 2)}
