import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.packing import best_fit_decreasing, certificate, lower_bound, pack


def optimum(sizes, capacity):
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in sorted({r: k for k, r in enumerate(rooms)}.values()):
            if rooms[k] >= sizes[i]:
                place(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_and_heuristic(sizes):
    counts = [sizes.count(s) for s in range(21)]
    where, bins = best_fit_decreasing(sizes, 20)
    best = optimum(sizes, 20)
    assert lower_bound(counts, 20) <= best <= bins
    room = defaultdict(int)
    for s, b in zip(sizes, where.tolist(), strict=True):
        room[b] += s
    assert max(room.values()) <= 20 and len(room) == bins


def test_every_token_once(spark):
    rng = random.Random(4)
    sizes = {i: rng.choice([0, 1, 5, 700, 1300, 2047, 2048, 2049, 9000, rng.randrange(1, 2048)]) for i in range(3000)}
    df = spark.createDataFrame([*[(i, s, "x", 0) for i, s in sizes.items()], (9999, None, "x", 0), (None, 7, "y", 0)], "doc_id long, n_tokens long, container string, room int")
    out = pack(df, per_group=400)
    rows = out.collect()
    fill, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        assert r["token_start"] < r["token_end"]
        fill[r["container"]] += r["token_end"] - r["token_start"]
        parts[r["doc_id"]].append((r["token_start"], r["token_end"]))
    assert max(fill.values()) <= 2048
    for i, s in sizes.items():
        p = sorted(parts[i])
        assert [x for x, _ in p] == [0, *[y for _, y in p[:-1]]] if s else not p
        assert not s or p[-1][1] == s
        assert len(p) <= 1 or s > 2048
    c = certificate(df, out).first()
    assert c["lower_bound"] <= c["containers"] == len(fill) <= c["lower_bound"] * 1.01 + 8


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0
