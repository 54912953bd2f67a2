"""Joins over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def neighbours(edges: DataFrame, nodes: DataFrame, at: str, other: str) -> DataFrame:
    """Edges joined to the node at their ``other`` end: (``at`` as id, neighbour columns). Dangling ends drop out."""
    n = nodes.select(*[F.col(c).alias(f"n_{c}") for c in nodes.columns])
    return edges.join(n, F.col(other) == F.col("n_id")).select(F.col(at).alias("id"), *n.columns)


def callers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, n_*) for every known caller of every id."""
    return neighbours(edges.where("kind = 'calls'"), nodes, "dst", "src")


def callees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return neighbours(edges.where("kind = 'calls'"), nodes, "src", "dst")


def counts(edges: DataFrame, at: str, name: str) -> DataFrame:
    """(id, name): edges at the end ``at``; ids without any are absent."""
    return edges.groupBy(F.col(at).alias("id")).agg(F.count("*").alias(name))


def known_counts(edges: DataFrame, nodes: DataFrame, at: str, other: str, name: str) -> DataFrame:
    """As ``counts``, but only edges whose ``other`` end is a known node."""
    return edges.join(nodes.select(F.col("id").alias(other)), other, "left_semi").groupBy(F.col(at).alias("id")).agg(F.count("*").alias(name))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def with_ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Edges with columns of both ends, as src_* and dst_*; edges with an unknown end drop out."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end)
    return edges


def first_match(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``, which must end in something unique."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison by null-safe keys: status added, removed, changed or same."""
    a = old.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col(value).alias("old_value"), F.lit(True).alias("in_old"))
    b = new.select(*[F.col(k).alias(f"n_{k}") for k in keys], F.col(value).alias("new_value"), F.lit(True).alias("in_new"))
    on = None
    for k in keys:
        c = F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}"))
        on = c if on is None else on & c
    both = a.join(b, on, "full_outer")
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("old_value").eqNullSafe(F.col("new_value")), "same").otherwise("changed")
    return both.select(*[F.coalesce(f"o_{k}", f"n_{k}").alias(k) for k in keys], "old_value", "new_value", status.alias("status"))


def contained(inner: DataFrame, outer: DataFrame, on: str, start: str, end: str) -> DataFrame:
    """Interval containment within an equal key: (outer_id, inner_id) with the inner interval inside the outer."""
    i = inner.select(F.col(on), F.col("id").alias("inner_id"), F.col(start).alias("i_s"), F.col(end).alias("i_e"))
    o = outer.select(F.col(on), F.col("id").alias("outer_id"), F.col(start).alias("o_s"), F.col(end).alias("o_e"))
    return o.join(i, on).where("i_s >= o_s AND i_e <= o_e").select("outer_id", "inner_id")


def point_in_interval(points: DataFrame, intervals: DataFrame, on: str, point: str, start: str, end: str) -> DataFrame:
    """Each point with the first interval (least start, then greatest end, then id) that holds it."""
    i = intervals.select(F.col(on), F.col("id").alias("interval_id"), F.col(start).alias("s"), F.col(end).alias("e"))
    hit = points.join(i, on).where(F.col(point).between(F.col("s"), F.col("e")))
    return first_match(hit, ["id"], [F.col("s"), F.col("e").desc(), F.col("interval_id")]).drop("s", "e")


def substring_links(left: DataFrame, right: DataFrame, text: str, needle: str, gram: int = 3) -> DataFrame:
    """left × right rows where ``text`` contains ``needle``, without a nested loop.

    Every needle meets texts only on its rarest n-gram among those of all texts; the containment itself is checked
    afterwards. A needle shorter than ``gram`` characters is its own gram. Null and empty needles and texts match nothing.
    """

    def by(size: int, needles: DataFrame) -> DataFrame:
        grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - size + 1)), lambda i: F.substr(c, i, F.lit(size)))
        t = left.where(F.length(text) >= size).select(*left.columns, F.explode(F.array_distinct(grams(F.col(text)))).alias("__g"))
        if size < gram:
            return needles.withColumn("__g", F.col(needle)).join(t, "__g").drop("__g")
        freq = t.groupBy("__g").agg(F.count("*").alias("__n"))
        each = needles.select(needle, F.explode(F.array_distinct(grams(F.col(needle)))).alias("__g")).distinct().join(freq, "__g", "left")
        rare = each.groupBy(needle).agg(F.min_by("__g", F.struct(F.coalesce("__n", F.lit(0)), "__g")).alias("__g"))
        return needles.join(rare, needle).join(t, "__g").where(F.col(text).contains(F.col(needle))).drop("__g")

    out = by(gram, right.where(F.length(needle) >= gram))
    for size in range(1, gram):
        out = out.unionByName(by(size, right.where(F.length(needle) == size)))
    return out


def substring_sets(texts: DataFrame, needles: DataFrame, gram: int = 3, piece: int = 1000) -> DataFrame:
    """(kind, text, ns): the numbers of the needles that each text of the same kind contains; texts without any are absent.

    ``texts`` has distinct (kind, text), ``needles`` kind, needle and its number n. As in ``substring_links`` a needle meets
    texts on its rarest n-gram, or on itself if it is shorter. Grams carry a hash of their text instead of the text, and
    are taken piece by piece; the text comes back once, to be searched for the needles that it may contain. Grams are
    never broadcast: what is told of their size is that of the texts, as exploding counts for nothing.
    """
    upto = lambda n: F.sequence(F.lit(1), F.greatest(F.lit(1), n))
    grams = lambda c, size: F.transform(upto(F.length(c) - size + 1), lambda i: F.substr(c, i, F.lit(size)))
    keyed = texts.where(F.length("text") > 0).withColumn("__t", F.xxhash64("kind", "text"))
    pieces = F.transform(upto(F.ceil(F.length("text") / piece).cast("int")), lambda i: F.substr("text", (i - 1) * piece + 1, F.lit(piece + gram - 1)))
    part = keyed.select("kind", "__t", F.explode(pieces).alias("__p"))
    t = part.select("kind", "__t", F.explode(F.array_distinct(F.concat(*[grams(F.col("__p"), size) for size in range(1, gram + 1)]))).alias("__g"))
    freq = t.groupBy("kind", "__g").agg(F.count("*").alias("__n"))
    own = F.when(F.length("needle") < gram, F.array("needle")).otherwise(F.array_distinct(grams(F.col("needle"), gram)))
    each = needles.where(F.length("needle") > 0).select("kind", "n", "needle", F.explode(own).alias("__g")).join(freq.hint("merge"), ["kind", "__g"], "left")
    rare = each.groupBy("kind", "n", "needle").agg(F.min_by("__g", F.struct(F.coalesce("__n", F.lit(0)), "__g")).alias("__g"))
    may = rare.join(t.hint("merge"), ["kind", "__g"]).groupBy("kind", "__t").agg(F.collect_set(F.struct("n", "needle")).alias("__c"))
    inside = F.transform(F.filter("__c", lambda c: F.col("text").contains(c["needle"])), lambda c: c["n"])
    return keyed.join(may, ["kind", "__t"]).select("kind", "text", inside.alias("ns")).where(F.size("ns") > 0)
