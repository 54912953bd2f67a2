"""The property graph: current symbols, distinct edges and current files of one snapshot folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.versions import latest
from graphloom.storage import spread

#: Closed domains of the model.
LAYERS = ("interface", "business", "data", "utility", "unknown")
KINDS = ("class", "function", "method", "variable", "interface", "type", "enum", "module", "constant", "property", "namespace")
RELATIONS = ("calls", "imports", "extends", "implements", "contains", "uses_type", "overrides", "exports", "creates", "decorates")

_META = T.MapType(T.StringType(), T.StringType())
SYMBOLS = T.StructType([T.StructField(n, t) for n, t in [("id", T.StringType()), ("name", T.StringType()), ("kind", T.StringType()), ("file_path", T.StringType()), ("start_line", T.IntegerType()), ("end_line", T.IntegerType()), ("start_col", T.IntegerType()), ("end_col", T.IntegerType()), ("source_code", T.StringType()), ("language", T.StringType()), ("layer", T.StringType()), ("doc_comment", T.StringType()), ("ai_summary", T.StringType()), ("complexity", T.IntegerType()), ("exported", T.BooleanType()), ("metadata", _META), ("created_at", T.TimestampType()), ("updated_at", T.TimestampType())]])
EDGES = T.StructType([T.StructField("id", T.StringType()), T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("metadata", _META)])
FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("language", T.StringType()), T.StructField("size", T.LongType()), T.StructField("line_count", T.IntegerType()), T.StructField("hash", T.StringType()), T.StructField("parsed_at", T.TimestampType()), T.StructField("imports", T.ArrayType(T.StringType())), T.StructField("metadata", _META)])


class Graph:
    """Lazy views of one folder of tables. Only the columns asked for are read and shuffled."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def heavy(self, name: str) -> DataFrame:
        """A table for work that is heavy by the row, over all cores."""
        return spread(self.table(name))

    def symbols(self, *columns: str) -> DataFrame:
        """The current row of each symbol id: the one with the greatest ``updated_at``."""
        return latest(self.table("symbols"), "id", "updated_at", *[F.col(c) for c in columns if c != "id"] or [F.lit(True).alias("present")])

    def files(self, *columns: str) -> DataFrame:
        """The current row of each path: the one with the greatest ``parsed_at``."""
        return latest(self.table("files"), "path", "parsed_at", *[F.col(c) for c in columns if c != "path"])

    def edges(self, *kinds: str) -> DataFrame:
        """One row for each edge id (id, src, dst, kind, line); repeats keep the first line."""
        e = self.table("edges")
        if kinds:
            e = e.where(F.col("kind").isin(*kinds))
        return e.groupBy("id").agg(F.min("src").alias("src"), F.min("dst").alias("dst"), F.min("kind").alias("kind"), F.min("line").alias("line"))


#: The same views for DuckDB; ``{columns}`` isn't needed there.
SQL_VIEWS = """sym AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM symbols) WHERE rn = 1),
fil AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY parsed_at DESC NULLS LAST) AS rn FROM files) WHERE rn = 1),
edg AS (SELECT id, min(src) AS src, min(dst) AS dst, min(kind) AS kind, min(line) AS line FROM edges GROUP BY id)"""


def sql(body: str, recursive: bool = False) -> str:
    """DuckDB SQL over the views: ``body`` is a SELECT, or further common tables ending in one."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    first = body.lstrip()
    return head + SQL_VIEWS + (", " if not first.upper().startswith("SELECT") else " ") + first
