from graphloom.operators.ordering import global_rank


def test_global_rank(spark):
    rows = [(i * 7919 % 1009, f"k{i}") for i in range(3000)]
    got = {(r["v"], r["k"]): r["rank"] for r in global_rank(spark.createDataFrame(rows, "v int, k string"), ["v", "k"]).collect()}
    assert got == {x: i + 1 for i, x in enumerate(sorted(rows))}
    assert global_rank(spark.createDataFrame([], "v int"), ["v"]).count() == 0
