import datetime as dt

from graphloom.operators import temporal as O
from graphloom.streaming import changes as C

T0 = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)


def events(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, C.EVENTS)
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return C.stream(spark, str(tmp_path))


ROWS = [(1, T0, 1, "view", 1.0, None), (2, T0 + H, 1, "click", 2.0, None), (3, T0 + 30 * H, 1, "error", None, None), (4, T0, 2, "view", 4.0, "{}"), (5, T0, 2, "view", 4.0, "{}")]


def test_windows_and_sessions(spark, tmp_path):
    s = events(spark, tmp_path, ROWS)
    day = {(r["start"].day, r["event_type"]): r["n"] for r in C.run(C.tumbling(s), "t", "complete").collect()}
    assert day == {(1, "view"): 3, (1, "click"): 1, (2, "error"): 1}
    quiet = sorted((r["user_id"], r["n"]) for r in C.run(C.quiet_periods(C.stream(spark, str(tmp_path))), "q", "complete").collect())
    assert quiet == [(1, 1), (1, 2), (2, 2)]
    state = {r["user_id"]: (r["turns"], r["topic"], r["hot"]) for r in C.run(C.sessions(C.stream(spark, str(tmp_path)), keep=2), "s", "update").collect()}
    assert state == {1: (3, "error", "click"), 2: (2, "view", "view")}
    assert {r["event_id"] for r in C.last_wins(spark.createDataFrame(ROWS, C.EVENTS)).collect()} == {3, 5}


def test_maintained(spark, tmp_path):
    from pyspark.sql import functions as F

    s = events(spark, tmp_path, ROWS).select("user_id", "event_type", "ts", "event_id", (F.col("event_type") == "error").alias("gone"))
    out = C.maintained(s, spark.createDataFrame([(1, "kept"), (7, "old")], "user_id long, event_type string"), "user_id", "gone", ["ts", "event_id"], "m")
    assert {r["user_id"]: r["event_type"] for r in out.collect()} == {2: "view", 7: "old"}


def test_time_joins(spark):
    left = spark.createDataFrame([(1, "k", T0 + H), (2, "k", T0 - H), (3, None, T0), (4, "k", T0)], "i int, k string, t timestamp")
    right = spark.createDataFrame([("k", T0, 5.0), ("k", T0, 7.0), ("k", T0 + 2 * H, 9.0), ("z", T0, 1.0)], "k string, t timestamp, v double")
    assert {r["i"]: r["last_v"] for r in O.as_of(left, right, "k", "t", "v").collect()} == {1: 7.0, 2: None, 3: None, 4: 7.0}
    a = spark.createDataFrame([(1, "k", T0)], "i int, k string, t timestamp")
    b = spark.createDataFrame([(10, "k", T0 + H), (11, "k", T0 - H), (12, "k", T0 + H + dt.timedelta(seconds=1)), (13, "z", T0)], "i int, k string, t timestamp")
    assert {r["r_i"] for r in O.within(a, b, "k", "t", 3600).collect()} == {10, 11}
    g = O.gaps_and_islands(b.select("k", "t"), "k", "t", 3 * 3600)
    assert sorted((r["k"], r["n"]) for r in g.collect()) == [("k", 3), ("z", 1)]
