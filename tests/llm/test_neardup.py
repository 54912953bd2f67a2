import datetime as dt
import random
import re

import pytest

from graphloom.llm import neardup
from graphloom.llm.neardup import near_duplicates

S = "id string, kind string, source_code string, updated_at timestamp, cid int, h int, size int"
T0 = dt.datetime(2024, 1, 1)


def brute(rows, t=0.7):
    sets = {}
    for i, code in rows:
        w = re.findall("[A-Za-z0-9_]+", code or "")
        if len(w) >= 40:
            sets[i] = set(zip(w, w[1:], w[2:], strict=False))
    ids = sorted(sets)
    return sorted((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t)


def corpus(seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(900)}" for _ in range(rng.choice([40, 42, 60, 150, 400]))] for _ in range(15)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            k = rng.randrange(len(w))
            rng.choice([lambda: w.insert(k, "new"), lambda: w.pop(k), lambda: w.__setitem__(k, "z")])()
        rows.append((f"s{i:03}", " ".join(w)))
    hot = "const a = new B ( ) ; " * 30
    return [*rows, *[(f"h{i}", hot) for i in range(30)], ("short", "a b c"), ("null", None), ("empty", "")]


@pytest.mark.parametrize("light", [None, 10**6])
def test_against_brute_force(spark, monkeypatch, light):
    if light:  # all sets by subsets of two
        monkeypatch.setattr(neardup, "boundary", lambda *a: light)
    rows = corpus(7)
    old = [(i, "function", "x " * 50 + i, T0, 1, 2, 3) for i, _ in rows[:20]]
    df = spark.createDataFrame([*old, *[(i, "method", c, dt.datetime(2025, 1, 1), 1, 2, 3) for i, c in rows], ("cls", "class", rows[0][1], T0, 1, 2, 3), (None, None, None, None, None, None, None)], S)
    got = sorted((r["id_a"], r["id_b"]) for r in near_duplicates(df).collect())
    assert got == brute(rows)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], S)).count() == 0


def test_classes_of_many_copies(spark):
    import datetime as dt

    from graphloom.llm.neardup import duplicate_classes, near_duplicates

    base = [f"tok{i}" for i in range(60)]
    rows = [(f"c{i:03d}", " ".join(base)) for i in range(150)]  # one body, many copies
    rows += [("near", " ".join(base[:58] + ["x", "y"])), ("far", " ".join(f"q{i}" for i in range(60))), ("short", "a b c"), ("none", None)]
    df = spark.createDataFrame([(i, "function", t, dt.datetime(2024, 1, 1)) for i, t in rows], "id string, kind string, source_code string, updated_at timestamp")
    got = {r["id"]: (r["class_id"], r["copies"], r["links"]) for r in duplicate_classes(df).collect()}
    assert got == {**{f"c{i:03d}": ("c000", 149, 150) for i in range(150)}, "near": ("c000", 0, 150), "far": ("far", 0, 0)}
    pairs = near_duplicates(df).count()
    assert pairs == sum(links for _, _, links in got.values()) // 2
    assert duplicate_classes(df.limit(0)).count() == 0
