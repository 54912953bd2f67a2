import random

from graphloom.llm import spans
from graphloom.llm.spans import shared_share, shared_spans


def brute(docs, k):
    seen = {}
    for d, t in docs:
        for i in range(len(t or "") - k + 1):
            seen.setdefault(t[i : i + k], set()).add(d)
    out = []
    for d, t in docs:
        start = end = None
        for i in range(len(t or "") - k + 1):
            if len(seen[t[i : i + k]]) > 1:
                if end is not None and i <= end:
                    end = i + k
                else:
                    if end is not None:
                        out.append((d, start, end))
                    start, end = i, i + k
        if end is not None:
            out.append((d, start, end))
    return sorted(out)


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefgh é漢𝒳") for _ in range(k))
    shared = [word(rng.choice([19, 20, 21, 45, 200])) for _ in range(8)] + ["=" * 90, "ab" * 40]
    docs = [(i, "".join(rng.choice([word(rng.randrange(1, 60)), rng.choice(shared)]) for _ in range(rng.randrange(0, 9)))) for i in range(n)]
    return [*docs, (n, None), (n + 1, ""), (n + 2, docs[3][1]), (n + 3, shared[4] * 3), (n + 4, "=" * 400)]


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, doc string, n int")
        got = sorted((r["doc_id"], r["span_start"], r["span_end"]) for r in shared_spans(df, min_chars=20, batches=3).collect())
        assert got == brute(docs, 20)


def test_long_texts_in_segments(spark, monkeypatch):
    docs = corpus(5, 20)
    want = brute(docs, 20)
    monkeypatch.setattr(spans, "SEGMENT", 64)  # on the driver only; executors keep theirs, which must not matter
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r["doc_id"], r["span_start"], r["span_end"]) for r in shared_spans(df, min_chars=20).collect()) == want
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(600_000))
    two = spark.createDataFrame([(1, long), (2, long[250_000:290_000] + "x" * 500)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["span_start"], r["span_end"]) for r in shared_spans(two).collect()) == [(1, 250_000, 290_000), (2, 0, 40_000)]


def test_share_and_empty(spark):
    df = spark.createDataFrame([(1, "a" * 50 + "b"), (2, "c" + "a" * 50), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in shared_share(df, min_chars=30).collect()}
    assert got == {1: (51, 50), 2: (51, 50), 3: (0, 0)}
    assert shared_spans(df.limit(0)).count() == 0
