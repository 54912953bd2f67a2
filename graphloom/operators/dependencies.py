"""Declared against used dependencies, and the health score they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.imports import listed_by_nature
from graphloom.operators.relations import substring_links


def short_name(dep: Column) -> Column:
    """The part of ``owner/name@version`` that names the library; null without an owner."""
    return F.when(dep.contains("/"), F.nullif(F.trim(F.substring_index(F.get(F.split(dep, "/"), F.lit(1)), "@", 1)), F.lit("")))


def unused(declared: DataFrame, imported: DataFrame) -> DataFrame:
    """(dep): declared (dep, dev) that no imported (pkg) equals or contains; development dependencies never count.

    Looked for are the name, the name without its scope and the short name behind an owner.
    """
    d = declared.where("dep IS NOT NULL AND dep <> ''").groupBy("dep").agg(F.max(F.coalesce("dev", F.lit(False))).alias("dev")).where("NOT dev").select("dep")
    names = F.array_distinct(F.filter(F.array(F.col("dep"), F.regexp_replace("dep", r"^@[^/]+/", ""), short_name(F.col("dep"))), lambda x: x.isNotNull()))
    variants = d.select("dep", F.explode(names).alias("needle"))
    hit = substring_links(imported.select("pkg").where("pkg IS NOT NULL").distinct(), variants, "pkg", "needle").select("dep").distinct()
    return d.join(hit, "dep", "left_anti")


def unlisted(declared: DataFrame, imported: DataFrame) -> DataFrame:
    """(pkg): imported packages that no declaration names: not itself, not one of the directories above it, and no
    short name it contains. Headers of systems, frameworks and the project itself need none."""
    p = imported.select("pkg").where("pkg IS NOT NULL AND pkg <> ''").distinct().where(~listed_by_nature(F.col("pkg")))
    d = declared.where("dep IS NOT NULL").select("dep").distinct()
    parts = F.split("pkg", "/")
    above = p.select("pkg", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("dep"))
    named = above.join(d, "dep", "left_semi").select("pkg")
    shorts = d.select(short_name(F.col("dep")).alias("short")).where("short IS NOT NULL").distinct()
    return p.join(named.union(substring_links(p, shorts, "pkg", "short").select("pkg")).distinct(), "pkg", "left_anti")


def health(cycles: DataFrame, not_used: DataFrame, not_listed: DataFrame) -> DataFrame:
    """One row (cycles, unused, unlisted, score): 100 less 15 a cycle, 3 an unused and 5 an unlisted dependency, within 0 and 100."""
    c, u, l = (df.agg(F.count("*").alias(n)) for df, n in ((cycles, "cycles"), (not_used, "unused"), (not_listed, "unlisted")))
    row = c.join(F.broadcast(u), how="inner", on=F.lit(True)).join(F.broadcast(l), how="inner", on=F.lit(True))
    score = 100 - 15 * F.col("cycles") - 3 * F.col("unused") - 5 * F.col("unlisted")
    return row.select("cycles", "unused", "unlisted", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long").alias("score"))
