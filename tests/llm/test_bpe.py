import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
M = bpe.machine(bpe.default_vocabulary())
REF = tiktoken.Encoding("ref", pat_str=P.PATTERN, mergeable_ranks=M.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_equal_to_reference(text):
    ids = M.encode(text).tolist()
    assert ids == REF.encode_ordinary(text)
    d = bpe.Decoder(M)
    assert "".join(d.feed([i]) for i in ids) + d.feed([], True) == text


@pytest.mark.parametrize("text", ["a" * 9000, "=" * 5000, "ab" * 4000, "中文字符" * 1500, " " * 6000, "\n" * 3000, "<|endoftext|>" * 50, "x\x1cy\x85z\u3000", "it'll 'll 'l", "𝒳" * 700])
def test_odd_and_long(text):
    assert M.encode(text).tolist() == REF.encode_ordinary(text)


def test_streaming_in_small_chunks(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 40)
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["a", "  ", "the ", "'ll", "é", "\n\n ", "x" * 30, "=" * 25, "12345", "漢字"]) for _ in range(rng.randrange(1, 90)))
        got = [i for part in M.transduce(text[k : k + 7] for k in range(0, len(text), 7)) for i in part]
        assert got == REF.encode_ordinary(text)


def test_piece_stream_keeps_little():
    rng = random.Random(2)
    data = "".join(rng.choice("abcdeth") for _ in range(20_000)).encode()
    assert list(M.stream(data[i : i + 64] for i in range(0, len(data), 64))) == REF.encode_ordinary(data.decode())
    assert 128 <= M.lookahead < 10_000


def test_table(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (None, "a", "w")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(df).collect()}
    assert got == {1: REF.encode_ordinary("Hello world"), 2: [], 3: [], None: REF.encode_ordinary("a")}
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df).collect()}[2] == 0
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_runs_without_a_boundary_are_streamed():
    import tiktoken

    from graphloom.llm import bpe

    m = bpe.machine(bpe.default_vocabulary())
    enc = tiktoken.Encoding("x", pat_str=bpe.default_pattern(), mergeable_ranks=m.ranks, special_tokens={})
    size = bpe.CHUNK
    try:
        bpe.CHUNK = 500  # so that runs outgrow chunks
        for text in ("ab" * 4000 + " end. 12", "7" * 3000 + "x", "!?" * 2000 + "a b", "漢字" * 1500 + "。x", " " * 3000 + "a", "a" * 2600 + " " + "b" * 2600 + "'s", "é" * 700 + "1" * 700 + "-" * 700 + "\n\n x"):
            parts = [list(p) for p in m.transduce(text[i : i + 500] for i in range(0, len(text), 500))]
            assert [i for p in parts for i in p] == enc.encode_ordinary(text)
            d = bpe.Decoder(m)
            assert "".join(d.feed([i]) for p in parts for i in p) + d.feed([], final=True) == text
    finally:
        bpe.CHUNK = size


def test_decode_corpus(spark):
    from graphloom.llm import bpe

    texts = ["", None, "Grüße 漢字 🙂", "a\r\n\tb", "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in bpe.decode_corpus(bpe.encode_corpus(df)).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.decode_corpus(bpe.encode_corpus(df.limit(0))).count() == 0
