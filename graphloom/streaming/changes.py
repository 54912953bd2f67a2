"""Change streams: coalescing, quiet periods, windows, incremental maintenance, session state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.storage import cut, scratch

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def stream(spark: SparkSession, folder: str, schema: T.StructType = EVENTS, name: str = "events.parquet") -> DataFrame:
    """A file stream over ``name`` in ``folder``, itself a file or a folder of files, with event time as a timestamp,
    which watermarks need."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    reader = spark.readStream.schema(schema)
    s = reader.option("pathGlobFilter", name).parquet(folder) if status.isFile() else reader.parquet(f"{folder}/{name}")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def run(query: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a streaming query over all that is there and returns what it wrote, as a table in the shared folder.

    ``complete`` results are kept as of their last batch.
    """
    spark = query.sparkSession
    out, state = scratch(spark, name), scratch(spark, f"{name}-state")
    schema = query.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    # An empty table first, so that a stream without rows leaves a readable result.
    spark.createDataFrame([], schema).write.parquet(out)
    q = query.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def quiet_periods(events: DataFrame, key: str = "user_id", gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Bursts of changes of a key that are apart by ``gap`` or more: a debounce in event time."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def last_wins(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The last event of each key; ties by the greatest event id."""
    return events.groupBy(key).agg(F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", "event_id")).alias("e")).select(key, "e.*")


def maintain(table: DataFrame, batch: DataFrame, key: str, gone: str) -> DataFrame:
    """``table`` with the rows of ``batch`` put in place by key; batch rows whose ``gone`` is true take theirs away.
    A key must be unique in either."""
    keep = table.join(batch.select(key), key, "left_anti")
    return keep.unionByName(batch.where(~F.coalesce(F.col(gone), F.lit(False))).select(*table.columns))


def maintained(changes: DataFrame, empty: DataFrame, key: str, gone: str, order: list[str], name: str) -> DataFrame:
    """Applies a change stream to a table batch by batch; each batch writes the next version of the table, so a lost
    batch is simply written again. Returns the last version."""
    spark = changes.sparkSession
    versions = [cut(empty, f"{name}-0")]

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")
        versions.append(cut(maintain(versions[-1], last, key, gone), f"{name}-{number + 1}"))

    q = changes.writeStream.foreachBatch(apply).option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return versions[-1]


SESSION = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("turns", T.LongType()), T.StructField("topic", T.StringType()), T.StructField("hot", T.StringType())])
STATE = T.StructType([T.StructField("turns", T.LongType()), T.StructField("kinds", T.ArrayType(T.StringType()))])


def _session(keep: int) -> Callable:
    def step(key, batches: Iterator, state) -> Iterator:  # noqa: ANN001
        import pandas as pd

        turns, kinds = state.get if state.exists else (0, [])
        kinds = list(kinds)
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "event_id"])
            turns += len(pdf)
            kinds = (kinds + pdf["event_type"].tolist())[-keep:]
        state.update((turns, kinds))
        hot = max(sorted(set(kinds)), key=kinds.count) if kinds else None
        yield pd.DataFrame([{"user_id": key[0], "turns": turns, "topic": kinds[-1] if kinds else None, "hot": hot}])

    return step


def sessions(events: DataFrame, keep: int = 20) -> DataFrame:
    """State of each user's session: turns so far, last kind and the most frequent of the last ``keep``."""
    return events.groupBy("user_id").applyInPandasWithState(_session(keep), SESSION, STATE, "update", "NoTimeout")
