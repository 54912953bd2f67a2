"""Iterative graph operators: frontier loops whose state is a written table a round."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ordering import global_rank
from graphloom.storage import cut

STEPS = 3  # steps along edges between two written tables, where a round's table is small


def reach(edges: DataFrame, roots: DataFrame, depth: int | None) -> DataFrame:
    """(root, id, depth): what each root reaches over (a, b) edges within ``depth`` steps (None: all), with the least depth.

    Breadth first over all roots at once. Each round expands the last frontier and drops what was seen; the roots
    themselves are at depth 0.
    """
    edges = cut(edges.select("a", "b").distinct(), "reach-edges")
    frontier = cut(roots.select("root", F.col("root").alias("id"), F.lit(0).alias("depth")).distinct(), "frontier")
    seen = frontier
    for d in count(1) if depth is None else range(1, depth + 1):
        step = frontier.join(edges, F.col("id") == F.col("a")).select("root", F.col("b").alias("id")).distinct()
        frontier = cut(step.join(seen.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", F.lit(d).alias("depth")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(src, dst, hops, path): for each asked pair the least path among the shortest, within ``depth`` hops.

    Breadth first from both ends, half of the depth each, so a search takes in the square root of what one from a
    single end would. Every node keeps the least way (as an array) of those that reach it first; where both searches
    meet, the least way there and the least way on make the least path.
    """
    edges = cut(edges.select("a", "b").distinct(), "path-edges")
    pairs = pairs.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()

    def half(ends: DataFrame, rounds: int, forth: bool) -> DataFrame:
        from_, to = ("a", "b") if forth else ("b", "a")
        frontier = cut(ends.select("end", F.col("end").alias("id"), F.array("end").alias("way")), "paths")
        seen = frontier
        for _ in range(rounds):
            way = F.concat("way", F.array(to)) if forth else F.concat(F.array(to), "way")
            step = frontier.join(edges, F.col("id") == F.col(from_)).select("end", F.col(to).alias("id"), way.alias("way"))
            step = step.groupBy("end", "id").agg(F.min("way").alias("way"))
            frontier = cut(step.join(seen.select("end", "id"), ["end", "id"], "left_anti").select("end", "id", "way"), "paths")
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
        return seen

    there = half(pairs.select(F.col("src").alias("end")).distinct(), depth - depth // 2, True)
    back = half(pairs.select(F.col("dst").alias("end")).distinct(), depth // 2, False)
    met = pairs.join(there.select(F.col("end").alias("src"), "id", F.col("way").alias("w1")), "src").join(back.select(F.col("end").alias("dst"), "id", F.col("way").alias("w2")), ["dst", "id"])
    hops = F.size("w1") + F.size("w2") - 2
    # Of the places where the searches meet on a shortest path those as far from the source as can be are compared.
    best = met.groupBy("src", "dst").agg(F.min(F.struct(hops.alias("hops"), (-F.size("w1")).alias("far"), F.concat("w1", F.slice("w2", 2, depth + 1)).alias("path"))).alias("m"))
    return best.select("src", "dst", "m.hops", "m.path")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): connected components, named by their least id.

    Alternating large-star and small-star steps until nothing changes: a logarithmic number of rounds, each a few aggregations, and no
    node's whole neighbourhood in one place but as a minimum.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        links = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links", instead_of=links)
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    named = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return nodes.select("id").join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles): by oriented wedges. Each undirected edge points to its end of greater (degree, id), so a hub
    starts few wedges however many neighbours it has."""
    und = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    deg = und.select(F.col("a").alias("id")).unionAll(und.select("b")).groupBy("id").agg(F.count("*").alias("d"))
    e = und.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    o = cut(e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y")), "oriented")
    wedge = o.select("x", F.col("y").alias("y1")).join(o.select("x", F.col("y").alias("y2")), "x").where("y1 < y2")
    closed = o.select(F.least("x", "y").alias("y1"), F.greatest("x", "y").alias("y2"))
    tri = wedge.join(closed, ["y1", "y2"])
    return tri.select(F.explode(F.array("x", "y1", "y2")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, coefficient) of every node with two or more distinct neighbours."""
    und = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    # A self-loop makes a node its own neighbour, which counts in the degree and closes no triangle.
    deg = und.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree")).where("degree >= 2")
    return deg.join(triangles(edges), "id", "left").select("id", "degree", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"), (2 * F.coalesce("triangles", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).alias("coefficient"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): the nodes of strongly connected components of two nodes or more, named by their greatest id.

    By colours: the greatest id that reaches a node is its colour, and what reaches that id within its colour is a
    component. Edges between colours are on no cycle and drop out; what a round leaves goes on to the next.
    """
    e = cut(edges.select("a", "b").where("a <> b AND a IS NOT NULL AND b IS NOT NULL").distinct(), "scc-edges")
    out = e.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    while True:
        # Nodes without a way in or out are on no cycle; more of them go with the colours.
        e = cut(e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "scc-edges")
        if e.isEmpty():
            return out
        colour = cut(e.select(F.col("a").alias("id")).union(e.select("b")).distinct().withColumn("c", F.col("id")), "scc-colours")
        start = colour
        before = None
        while True:
            for _ in range(STEPS):
                got = e.join(colour, F.col("a") == F.col("id")).groupBy("b").agg(F.max("c").alias("m"))
                colour = colour.join(got, F.col("id") == F.col("b"), "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c"))
            colour = start = cut(colour, "scc-colours", instead_of=start)
            now = colour.agg(F.sum(F.xxhash64("id", "c").cast("decimal(20,0)"))).first()[0]
            if now == before:
                break
            before = now
        tint = lambda k: colour.select(F.col("id").alias(k), F.col("c").alias(f"c_{k}"))
        e = cut(e.join(tint("a"), "a").join(tint("b"), "b").where("c_a = c_b").select("a", "b"), "scc-edges")
        frontier = cut(colour.where("id = c"), "scc-reached")
        reached = frontier
        while True:
            step = frontier
            for _ in range(STEPS):
                step = step.unionByName(step.join(e, F.col("id") == F.col("b")).select(F.col("a").alias("id"), "c")).distinct()
            frontier = cut(step.join(reached.select("id"), "id", "left_anti"), "scc-reached")
            if frontier.isEmpty():
                break
            reached = reached.unionByName(frontier)
        sizes = reached.groupBy("c").agg(F.count("*").alias("n")).where("n > 1")
        out = out.unionByName(cut(reached.join(sizes, "c", "left_semi").select("id", F.col("c").alias("component")), "scc"))
        e = e.join(reached.select(F.col("id").alias("a")), "a", "left_anti").join(reached.select(F.col("id").alias("b")), "b", "left_anti")


def _cyclic(edges: DataFrame) -> DataFrame:
    """The edges that lie on cycles: both ends in one strong component."""
    scc = cut(strong_components(edges), "scc")
    at = lambda k: scc.select(F.col("id").alias(k), F.col("component").alias(f"c_{k}"))
    return cut(edges.select("a", "b").distinct().join(at("a"), "a").join(at("b"), "b").where("c_a = c_b AND a <> b").select("a", "b"), "cycle-edges")


def cycles(edges: DataFrame, longest: int) -> DataFrame:
    """(length, chain): all simple cycles of 2 to ``longest`` nodes, each starting at its least node; walks only visit
    nodes greater than their start within its strong component."""
    e = _cyclic(edges)
    walk = e.where("a < b").select(F.col("a").alias("s"), F.col("b").alias("at"), F.array("a", "b").alias("chain"))
    found = None
    for n in range(2, longest + 1):
        hop = walk.join(e, F.col("at") == F.col("a"))
        closed = hop.where("b = s").select(F.lit(n).alias("length"), "chain")
        found = closed if found is None else found.unionByName(closed)
        if n < longest:
            walk = cut(hop.where("b > s AND NOT array_contains(chain, b)").select("s", F.col("b").alias("at"), F.concat("chain", F.array("b")).alias("chain")), "walks")
    return found


def shortest_cycles(edges: DataFrame) -> DataFrame:
    """(length, chain): the shortest cycle through each node that lies on one, of any length, each cycle once.

    Of several shortest ones that with the least chain, read from the node on, counts; chains begin at their least
    node. Self-loops are no cycles. Only edges within strong components are followed, and a node's search ends where
    it comes back to it, so what is on no cycle costs nothing.
    """
    cyclic = _cyclic(edges)
    # Ways are kept as the places of nodes in the order of their ids, which compare as the ids do and take less room.
    nodes = cut(global_rank(cyclic.select(F.col("a").alias("id")).distinct(), ["id"], "n").select("id", F.col("n").cast("int").alias("n")), "cycle-nodes")
    place = lambda k: nodes.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"))
    e = cut(cyclic.join(place("a"), "a").join(place("b"), "b").select(F.col("n_a").alias("a"), F.col("n_b").alias("b")), "cycle-edges")
    frontier = cut(e.select(F.col("a").alias("s"), F.col("b").alias("id"), F.array("a", "b").alias("way")), "walks")
    seen, found = frontier, None
    while not frontier.isEmpty():
        step = frontier.join(e, F.col("id") == F.col("a")).select("s", F.col("b").alias("id"), "way", F.concat("way", F.array("b")).alias("next"))
        step = cut(step.groupBy("s", "id").agg(F.min("next").alias("next")), "walks")
        home = step.where("id = s").select("s", F.slice("next", 1, F.size("next") - 1).alias("chain"))
        found = home if found is None else found.unionByName(home)
        on = step.where("id <> s").join(home.select("s"), "s", "left_anti").join(seen.select("s", "id"), ["s", "id"], "left_anti")
        frontier = cut(on.select("s", "id", F.col("next").alias("way")), "walks")
        seen = seen.unionByName(frontier)
    if found is None:
        return cyclic.select(F.lit(0).alias("length"), F.array("a").alias("chain")).limit(0)
    at = F.array_position("chain", F.array_min("chain")).cast("int")
    turned = found.select(F.concat(F.slice("chain", at, F.size("chain")), F.slice("chain", 1, at - 1)).alias("c")).distinct()
    named = turned.select("c", F.posexplode("c").alias("pos", "n")).join(nodes, "n").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("l"))
    return named.select(F.size("c").alias("length"), F.transform("l", lambda x: x["id"]).alias("chain"))


def levels(edges: DataFrame) -> DataFrame:
    """(id, level): the length of the longest way down to each node of a DAG over (a, b) edges; nodes on cycles and
    behind them never settle and are left out."""
    e = cut(edges.select("a", "b").where("a <> b").distinct(), "level-edges")
    nodes = cut(e.select(F.col("a").alias("id")).union(e.select("b")).distinct(), "level-nodes")
    done, level = None, 0
    left, rest = nodes, e
    for level in count():
        free = cut(left.join(rest.select(F.col("b").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level)), "level")
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        left = cut(left.join(free.select("id"), "id", "left_anti"), "level-nodes", instead_of=left if left is not nodes else None)
        rest = cut(rest.join(free.select(F.col("id").alias("a")), "a", "left_anti"), "level-edges", instead_of=rest)
    return done if done is not None else nodes.withColumn("level", F.lit(0)).limit(0)


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, rank) after a fixed number of rounds; ranks sum to the number of nodes that have any edge, less what
    sinks lose."""
    e = edges.select("a", "b").distinct()
    out = e.groupBy("a").agg(F.count("*").alias("n"))
    e = cut(e.join(out, "a"), "rank-edges")
    nodes = cut(e.select(F.col("a").alias("id")).union(e.select("b")).distinct(), "rank-nodes")
    rank = nodes.withColumn("rank", F.lit(1.0))
    for _ in range(rounds):
        given = e.join(rank, F.col("a") == F.col("id")).groupBy("b").agg(F.sum(F.col("rank") / F.col("n")).alias("got")).withColumnRenamed("b", "id")
        rank = cut(nodes.join(given, "id", "left").select("id", (F.lit(1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")), "ranks", instead_of=rank)
    return rank
