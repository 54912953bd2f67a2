from collections import defaultdict, deque
from itertools import combinations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphloom.operators import graph as O

NAMES = "abcdefg"
GRAPHS = st.lists(st.tuples(st.sampled_from(NAMES), st.sampled_from(NAMES)), max_size=14)
SLOW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, edges):
    return spark.createDataFrame(edges, "a string, b string")


def bfs(edges, root, depth):
    out, queue = {root: 0}, deque([root])
    while queue:
        x = queue.popleft()
        if out[x] < depth:
            for a, b in edges:
                if a == x and b not in out:
                    out[b] = out[x] + 1
                    queue.append(b)
    return out


@SLOW
@given(GRAPHS)
def test_reach_and_paths(spark, edges):
    got = {r["id"]: r["depth"] for r in O.reach(frame(spark, edges), spark.createDataFrame([("a",)], "root string"), 3).collect()}
    assert got == bfs(edges, "a", 3)
    want = bfs(edges, "a", 4)
    pairs = spark.createDataFrame([("a", x) for x in NAMES], "src string, dst string")
    rows = O.shortest_paths(frame(spark, edges), pairs, 4).collect()
    assert {r["dst"]: r["hops"] for r in rows} == want
    for r in rows:
        assert all(p in set(edges) for p in zip(r["path"], r["path"][1:], strict=False))


@SLOW
@given(GRAPHS)
def test_components(spark, edges):
    comp = {x: {x} for x in NAMES}
    for a, b in edges:
        if comp[a] is not comp[b]:
            comp[a] |= comp[b]
            for x in comp[b]:
                comp[x] = comp[a]
    nodes = spark.createDataFrame([(x,) for x in NAMES], "id string")
    assert {r["id"]: r["component"] for r in O.components(nodes, frame(spark, edges)).collect()} == {x: min(comp[x]) for x in NAMES}


@SLOW
@given(GRAPHS)
def test_clustering(spark, edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for x, n in near.items():
        if len(n) >= 2:
            t = sum(1 for p, q in combinations(sorted(n), 2) if q in near[p] and x not in (p, q))
            want[x] = (len(n), t)
    assert {r["id"]: (r["degree"], r["triangles"]) for r in O.clustering(frame(spark, edges)).collect()} == want


@SLOW
@given(GRAPHS)
def test_cycles_and_levels(spark, edges):
    e = {(a, b) for a, b in edges if a != b}
    want = set()

    def walk(path):
        for a, b in e:
            if a == path[-1]:
                if b == path[0]:
                    want.add(tuple(path))
                elif b > path[0] and b not in path and len(path) < 4:
                    walk([*path, b])

    for x in NAMES:
        walk([x])
    found = O.cycles(frame(spark, edges), 4)
    assert {tuple(r["chain"]) for r in found.collect()} == want
    dag = {(a, b) for a, b in e if a < b}
    level = {x: 0 for p in dag for x in p}
    for _ in NAMES:
        for a, b in sorted(dag):
            level[b] = max(level[b], level[a] + 1)
    if dag:
        assert {r["id"]: r["level"] for r in O.levels(frame(spark, sorted(dag))).collect()} == level


def test_hub_and_loops(spark):
    edges = [("hub", f"n{i}") for i in range(200)] + [("x", "x"), ("n1", "n2")]
    c = {r["id"]: r["coefficient"] for r in O.clustering(frame(spark, edges)).collect()}
    assert c["n1"] == 1.0 and 0 < c["hub"] < 0.001
    r = {x["id"]: x["rank"] for x in O.pagerank(frame(spark, [("a", "b"), ("b", "a")]), 5).collect()}
    assert all(abs(v - 1) < 1e-9 for v in r.values())


def test_empty(spark):
    e = frame(spark, [])
    assert O.components(spark.createDataFrame([("q",)], "id string"), e).first()["component"] == "q"
    assert O.clustering(e).count() == 0 and O.cycles(e, 3).count() == 0
    assert O.reach(e, spark.createDataFrame([("q",)], "root string"), 2).count() == 1


@SLOW
@given(GRAPHS)
def test_strong_components_shortest_cycles_and_least_paths(spark, edges):
    near = {x: sorted({b for a, b in edges if a == x and b != x}) for x in NAMES}

    def reach(x):
        out, todo = set(), [x]
        while todo:
            for b in near[todo.pop()]:
                if b not in out:
                    out.add(b)
                    todo.append(b)
        return out

    after = {x: reach(x) for x in NAMES}
    scc = {x: max([x, *(y for y in after[x] if x in after[y])]) for x in NAMES if x in after[x]}
    assert {r["id"]: r["component"] for r in O.strong_components(frame(spark, edges)).collect()} == scc

    def least(src, dst):
        level = [[src]]
        seen = {src}
        while level:
            done = [p for p in level if len(p) > 1 and p[-1] == dst] if src == dst else [p for p in level if p[-1] == dst]
            if done:
                return min(done)
            level = [[*p, b] for p in level for b in near[p[-1]] if b not in seen or b == dst]
            seen |= {p[-1] for p in level}
        return None

    want = set()
    for x in scc:
        c = least(x, x)[:-1]
        i = c.index(min(c))
        want.add((*c[i:], *c[:i]))
    assert {tuple(r["chain"]) for r in O.shortest_cycles(frame(spark, edges)).collect()} == want
    pairs = [(a, b) for a in NAMES for b in NAMES if a != b]
    got = {(r["src"], r["dst"]): r["path"] for r in O.shortest_paths(frame(spark, edges), spark.createDataFrame(pairs, "src string, dst string"), 6).collect()}
    assert got == {p: least(*p) for p in pairs if least(*p)}


def test_long_chains_and_rings(spark):
    ring = [(f"r{i:03d}", f"r{(i + 1) % 12:03d}") for i in range(12)]
    found = O.shortest_cycles(frame(spark, ring)).collect()
    assert len(found) == 1 and found[0]["length"] == 12 and found[0]["chain"][0] == "r000"
    chain = frame(spark, [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(110)])
    assert O.levels(chain).agg({"level": "max"}).first()[0] == 110
    assert O.reach(chain, spark.createDataFrame([("n000",)], "root string"), None).count() == 111
    assert O.strong_components(chain).count() == 0


def test_short_needles(spark):
    from graphloom.operators.relations import substring_links

    t = spark.createDataFrame([("pg",), ("lodash",), ("ws",), ("a",), ("",), (None,)], "pkg string")
    n = spark.createDataFrame([("pg",), ("dash",), ("a",), ("s",), ("",), (None,), ("zz",)], "dep string")
    got = sorted((r["pkg"], r["dep"]) for r in substring_links(t, n, "pkg", "dep").collect())
    assert got == [("a", "a"), ("lodash", "a"), ("lodash", "dash"), ("lodash", "s"), ("pg", "pg"), ("ws", "s")]
