"""Current rows among versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: str, *values: Column) -> DataFrame:
    """For each ``key`` the ``values`` of its row with the greatest ``order``; rows that tie are equal.

    Only the key, the order and the values are shuffled, after a partial aggregation. Rows without a key are
    dropped, a null ``order`` counts as the least. A column called ``key`` among the values isn't allowed.
    """
    packed = F.struct(F.coalesce(F.col(order).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("__at"), F.struct(*values).alias("__v"))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"), packed.alias("__p"))
    return rows.groupBy("__k").agg(F.max_by(F.col("__p.__v"), F.col("__p.__at")).alias("__v")).select(F.col("__k").alias(key), "__v.*")
