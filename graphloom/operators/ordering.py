"""Global order without one big task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.storage import cut


def global_rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Adds the place (from 1) of each row in the order of all rows, which must end in something unique.

    Rows are spread by ranges of the order and written; each range is numbered by itself and shifted by the sizes of
    the ranges before it. Only one number a range is ever gathered.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(W.partitionBy("__p").orderBy(*order))
    return ranged.withColumn("__own", own).join(F.broadcast(before), "__p").withColumn(name, F.col("__own") + F.col("__before")).drop("__p", "__own", "__before")
