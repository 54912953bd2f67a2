"""Streams and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators import temporal as O
from graphloom.plans.catalog import query
from graphloom.streaming import changes as C


@query("str01_tumbling", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(g: Graph) -> DataFrame:
    """The stream run to its end in complete mode, so that the last windows are there too."""
    out = C.run(C.tumbling(C.stream(g.spark, g.folder)), "tumbling", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("str02_sliding", "SELECT d + to_days(o::INT) AS start, count(*) AS n FROM (SELECT date_trunc('day', ts) AS d FROM events), (VALUES (0), (-1)) AS x(o) GROUP BY 1")
def sliding(g: Graph) -> DataFrame:
    return C.run(C.sliding(C.stream(g.spark, g.folder)), "sliding", "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


_SESSIONS = "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, i"


@query("str03_quiet_periods", _SESSIONS)
def quiet(g: Graph) -> DataFrame:
    return C.run(C.quiet_periods(C.stream(g.spark, g.folder)), "quiet", "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("str04_quiet_batch", _SESSIONS)
def quiet_batch(g: Graph) -> DataFrame:
    """The same bursts in batch, by gaps and islands."""
    return O.gaps_and_islands(g.table("events").select("user_id", "ts"), "user_id", "ts", 12 * 3600).select("user_id", "start", "n")


@query("str05_last_wins", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def last_wins(g: Graph) -> DataFrame:
    return C.last_wins(g.table("events")).select("user_id", "event_id", "event_type")


@query("str06_first_seen")
def first_seen(g: Graph) -> DataFrame:
    """Repeats of a user's kind of event dropped within the watermark."""
    return C.run(C.first_seen(C.stream(g.spark, g.folder), ["user_id", "event_type"]).select("event_id", "user_id", "event_type"), "first", "append")


@query("str07_maintained_table", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) <> 'error'")
def maintained(g: Graph) -> DataFrame:
    """A table kept by key from the stream: the last event puts the row, an error takes it away."""
    s = C.stream(g.spark, g.folder).select("user_id", "event_type", "value", "ts", "event_id", (F.col("event_type") == "error").alias("gone"))
    empty = g.spark.createDataFrame([], "user_id long, event_type string, value double")
    return C.maintained(s, empty, "user_id", "gone", ["ts", "event_id"], "kept")


@query("str08_session_state")
def session_state(g: Graph) -> DataFrame:
    """Custom state a user, kept across batches."""
    return C.run(C.sessions(C.stream(g.spark, g.folder)), "sessions", "update")


@query("join28_as_of", "SELECT e.event_id, (SELECT max(o.o_totalprice) FROM orders o WHERE o.o_custkey = e.user_id AND o.o_orderdate = (SELECT max(p.o_orderdate) FROM orders p WHERE p.o_custkey = e.user_id AND p.o_orderdate <= e.ts)) AS last_price FROM events e")
def as_of(g: Graph) -> DataFrame:
    e = g.table("events").select("event_id", F.col("user_id").alias("k"), F.col("ts").alias("t"))
    o = g.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.col("o_totalprice").alias("price"))
    return O.as_of(e, o, "k", "t", "price").select("event_id", "last_price")


@query("join29_within_an_hour", "SELECT a.event_id AS signup, b.event_id AS click FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'click' AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 3600000000")
def within_hour(g: Graph) -> DataFrame:
    e = g.table("events").select("event_id", "user_id", "ts", "event_type")
    return O.within(e.where("event_type = 'signup'"), e.where("event_type = 'click'"), "user_id", "ts", 3600).select(F.col("l_event_id").alias("signup"), F.col("r_event_id").alias("click"))


@query("str09_result_cache", "WITH r AS (SELECT path, hash, size, dense_rank() OVER (PARTITION BY path ORDER BY parsed_at DESC NULLS LAST) AS rk FROM files), n AS (SELECT DISTINCT path, hash, size FROM r WHERE rk = 1), o AS (SELECT DISTINCT path, hash FROM r WHERE rk = 2) SELECT n.path, (o.path IS NOT NULL AND o.hash = n.hash) IS TRUE AS kept FROM n LEFT JOIN o ON o.path = n.path")
def result_cache(g: Graph) -> DataFrame:
    """Results of the version before the current one, used again where the hash is the same and made anew elsewhere."""
    from graphloom.operators.versions import latest
    from graphloom.streaming.cache import refreshed

    v = g.table("files").select("path", "hash", "parsed_at")
    now = latest(v, "path", "parsed_at", "hash", F.col("parsed_at").alias("at"))
    old = latest(v.join(now.select("path", "at"), "path").where("parsed_at < at"), "path", "parsed_at", "hash").withColumn("kept", F.lit(True))
    return refreshed(old, now.select("path", "hash"), lambda df: df.withColumn("kept", F.lit(False))).select("path", "kept")
