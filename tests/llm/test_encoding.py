import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import encoding


@pytest.fixture(scope="module")
def coder():
    return encoding.encoder(*encoding.default_vocabulary())


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def ids(coder, texts):
    offsets, flat = coder.encode_batch(texts)
    return [flat[a:z].tolist() for a, z in zip(offsets, offsets[1:])]


def test_perfect_hash_is_minimal_and_perfect():
    keys = [f"key{i}".encode() for i in range(5000)]
    h = encoding.PerfectHash(keys)
    assert sorted(h.key_at.tolist()) == list(range(5000))
    assert h.lookup(keys).tolist() == list(range(5000))
    assert encoding.PerfectHash([b"one"]).lookup([b"one", b"two"]).tolist() == [0, 0]


def test_every_word_of_the_vocabulary_merges_to_itself(coder):
    for word, i in list(coder.ranks.items())[::7]:
        assert encoding.merge_bytes(word, coder.ranks) == [i]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_public_library(coder, reference, text):
    assert ids(coder, [text]) == reference([text])


@pytest.mark.parametrize("text", ["", " ", "\n\n  \n", "<|endoftext|> x <|endoftext|>", "don't I'LL", "ก" * 50, "👩🏽‍🔬", "é é", "a" * 3000, "ab " * 2000, "𝓐­​", "x\r\ny z"])
def test_odd_texts(coder, reference, text):
    assert ids(coder, [text, "after"]) == reference([text, "after"])


def test_a_very_long_pre_token_is_not_quadratic(coder):
    out = ids(coder, ["ab" * 200_000])[0]
    assert b"".join(coder.keys[coder.ids.tolist().index(i)] for i in set(out)) and sum(len(coder.keys[int(np.flatnonzero(coder.ids == i)[0])]) for i in set(out)) > 0


def test_merges_equal_the_plain_rule(coder):
    def plain(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            best = min(((coder.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                return [coder.ranks[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = np.random.default_rng(1)
    for _ in range(300):
        word = bytes(rng.choice(list(b"abcdeth in0\xc3\xa9\xe0"), rng.integers(1, 40)).tolist())
        assert encoding.merge_bytes(word, coder.ranks) == plain(word)


def test_memo_is_bounded(coder, monkeypatch):
    c = encoding.Encoder(*encoding.default_vocabulary())
    monkeypatch.setattr(encoding, "MEMO_BYTES", 2000)
    for i in range(50):
        c.encode_batch([f"unusualword{i} again{i}"])
        assert c.memo_bytes < 4000


def test_table(spark, reference):
    texts = [None, "", "One text.", "One text.", "y" * 2_000_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encoding.encode(df).collect()}
    assert got[0] == got[1] == [] and got[2] == got[3] == reference(["One text."])[0] and got[4] == reference([texts[4]])[0]
    counts = {r["doc_id"]: r["n_tokens"] for r in encoding.token_counts(df).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert encoding.encode(df.limit(0)).count() == 0
