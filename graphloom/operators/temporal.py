"""Joins in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each left row with the last ``value`` of its key at or before its time, by one union and one window; null if
    there is none. Of right rows at one time the greatest value counts."""
    l = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(1).alias("__side"))
    r = right.groupBy(key, time).agg(F.max(value).alias("__v"))
    r = r.select(*[F.col(c) if c in (key, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], "__v", F.lit(0).alias("__side"))
    w = W.partitionBy(key).orderBy(time, "__side").rowsBetween(W.unboundedPreceding, 0)
    return l.unionByName(r).withColumn(f"last_{value}", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__v", "__side")


def within(left: DataFrame, right: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """Pairs of one key that are at most ``seconds`` apart: both sides fall into buckets of that width, the right one
    also into its neighbours, and only equal buckets meet."""
    b = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds)
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns], b.alias("__b"))
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.explode(F.array(b - 1, b, b + 1)).alias("__b"))
    gap = F.unix_micros(F.col(f"r_{time}").cast("timestamp")) - F.unix_micros(F.col(f"l_{time}").cast("timestamp"))
    return l.join(r, (F.col(f"l_{key}") == F.col(f"r_{key}")) & (l["__b"] == r["__b"])).where(F.abs(gap) <= seconds * 1_000_000).drop("__b")


def gaps_and_islands(rows: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """(key, start, end, n): bursts whose rows are less than ``seconds`` apart, in batch."""
    w = W.partitionBy(key).orderBy(time)
    t = F.unix_micros(F.col(time).cast("timestamp"))
    new = F.when(t - F.lag(t).over(w) < seconds * 1_000_000, 0).otherwise(1)
    marked = rows.withColumn("__new", new)
    numbered = marked.withColumn("__i", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "__i").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n")).drop("__i")
