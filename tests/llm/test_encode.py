import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritrail.llm import encode

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return encode.read_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def other(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def own(encoder, texts):
    ids, counts, begins = encoder.encode(texts)
    out, at = [], 0
    for n in counts:
        out.append(ids[at : at + n].tolist())
        at += n
    return out, begins


PIECES = ["'", "s", "t", "re", "ve", "ll", "d", "m", "a", "Z", "é", "中", "9", "٣", " ", "  ", "\n", "\t", " ", "　", ".", "!", "🙂", "​", "́", "Ⅷ", "½", "\r\n", "<|endoftext|>", "\x1c", "\x85"]


def test_as_two_public_libraries(ranks, other):
    tokenizers = pytest.importorskip("tokenizers")
    third = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    third.encode_special_tokens = True
    rng = random.Random(2)
    texts = ["", "don't've 's\n's it'll  be", "a" * 3000, "ab" * 900 + "!" * 500 + " " * 700 + "中" * 300]
    texts += ["".join(rng.choice(PIECES) for _ in range(rng.randrange(15))) for _ in range(5000)]
    found, _ = own(encode.Encoder(ranks), texts)
    assert found == [other.encode_ordinary(t) for t in texts]
    assert found == [e.ids for e in third.encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_any_text(ranks, other, texts):
    assert own(encode.Encoder(ranks), texts)[0] == [other.encode_ordinary(t) for t in texts]


def test_scan_is_that_of_single_steps():
    rng = random.Random(1)
    table, act, _ = encode._functions()
    for n in (1, 2, 63, 64, 65, 4097, 9000):
        import numpy as np

        kinds = np.array([rng.randrange(9) for _ in range(n)], dtype=np.uint8)
        state, want = encode._START, []
        for k in kinds:
            state = encode._step(state, k)[0]
            want.append(state)
        assert act[encode._prefixes(kinds), encode._START].tolist() == want
    assert len(table) < 250


def test_merging_is_that_of_a_plain_loop(ranks):
    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(4)
    for _ in range(2000):
        piece = "".join(rng.choice("abcdeit hoanr") for _ in range(rng.randrange(1, 25))).encode()
        assert encode.merge(piece, ranks) == plain(piece)


def test_rows(spark, ranks):
    texts = [None, "", "two words", "two words", "x" * 200_000, "中文，标点。"]
    rows = spark.createDataFrame([(i, t, "clash", [1]) for i, t in enumerate(texts)], "doc_id long, text string, lang string, ids array<int>")
    found = {r.doc_id: r for r in encode.encode(rows, offsets=True).collect()}
    assert found[0].ids == found[1].ids == [] and found[2].ids == found[3].ids and len(found) == len(texts)
    assert all(len(r.ids) == len(r.begins) and list(r.begins) == sorted(r.begins) for r in found.values())
    assert found[2].begins == [0, 3]
    decoded = {r.doc_id: r.text for r in encode.decode(encode.encode(rows)).collect()}
    assert decoded == {i: t or "" for i, t in enumerate(texts)}
    assert encode.encode(rows.limit(0)).count() == 0


def test_chunks_change_nothing(spark, monkeypatch):
    texts = [f"text {i} it's" * (i % 7) for i in range(50)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r.doc_id: r.ids for r in encode.encode(rows).collect()}
    assert [len(c) for c in encode._chunks(["ab", "c", "defg", ""])] == [4]
    monkeypatch.setattr(encode, "CHUNK_CHARACTERS", 3)
    assert [len(c) for c in encode._chunks(["ab", "c", "defg", ""])] == [2, 1, 1]
    parts = {t: i for t, i in zip(texts, own(encode.Encoder(encode.read_ranks()), texts)[0])}
    assert all(whole[i] == parts[t] for i, t in enumerate(texts))
