"""Results kept by file and made anew only where the file's hash changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale(kept: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of ``files`` (path, hash) that ``kept`` has no result for, or one of another hash; a null hash is always stale."""
    return files.join(kept.select("path", "hash").distinct(), ["path", "hash"], "left_anti")


def refreshed(kept: DataFrame, files: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results (path, hash, columns) of all current files: those kept whose hash still holds, and ``make`` of the rest.

    Results of files that are gone drop out. Only stale files reach ``make``.
    """
    valid = kept.join(files.select("path", "hash").where(F.col("hash").isNotNull()).distinct(), ["path", "hash"], "left_semi")
    return valid.unionByName(make(stale(kept, files)).select(*kept.columns))
