import datetime as dt

from pyspark.sql import functions as F

from graphloom.operators import relations as R
from graphloom.operators.versions import latest

T = lambda d: dt.datetime(2024, 1, d)


def test_latest(spark):
    df = spark.createDataFrame([("a", T(1), "old", 9), ("a", T(2), "new", 9), ("a", T(2), "new", 9), ("b", None, "only", 9), ("b", None, "only", 9), (None, T(1), "x", 9)], "id string, at timestamp, v string, __k int")
    assert {r["id"]: r["v"] for r in latest(df, "id", "at", F.col("v")).collect()} == {"a": "new", "b": "only"}
    assert latest(df.limit(0), "id", "at", F.col("v")).count() == 0


def test_diff(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("b", 5), (None, 3), ("c", 1)], "k string, v int")
    assert {r["k"]: r["status"] for r in R.diff(old, new, ["k"], "v").collect()} == {"a": "removed", "b": "changed", None: "same", "c": "added"}


def test_intervals(spark):
    boxes = spark.createDataFrame([("o", "f", 1, 100), ("i", "f", 10, 20), ("x", "g", 1, 100)], "id string, f string, s int, e int")
    points = spark.createDataFrame([("p", "f", 15), ("q", "f", 500), ("r", "g", 1)], "id string, f string, at int")
    assert {r["id"]: r["interval_id"] for r in R.point_in_interval(points, boxes, "f", "at", "s", "e").collect()} == {"p": "o", "r": "x"}
    inner = boxes.where("id <> 'o'")
    assert {(r["outer_id"], r["inner_id"]) for r in R.contained(inner, boxes.where("id = 'o'"), "f", "s", "e").collect()} == {("o", "i")}


def test_substring_links(spark):
    t = spark.createDataFrame([(1, "user service"), (2, "service"), (3, None), (4, "")], "i int, text string")
    n = spark.createDataFrame([("service",), ("user s",), ("absent",), ("ab",), (None,)], "needle string")
    got = {(r["i"], r["needle"]) for r in R.substring_links(t, n, "text", "needle").collect()}
    assert got == {(1, "service"), (2, "service"), (1, "user s")}
