"""References of tests on odd names and paths, against the queries' own SQL."""

import datetime as dt

import duckdb
import pytest

from graphloom.model import EDGES, SYMBOLS
from graphloom.operators import coverage
from graphloom.plans import catalog


def folder(spark, path):
    at = dt.datetime(2024, 1, 1)
    row = lambda i, name, file, code, exported=True: {"id": i, "name": name, "kind": "function", "file_path": file, "source_code": code, "language": "ts", "layer": "business", "complexity": 1, "exported": exported, "updated_at": at}
    code = "foo(a.b);\nx += operator+(y) /* naïve 変数 */ ; Foo.bar['k']; " + "wide" * 800 + "Tail " + "q" * 998 + "seam(); "
    rows = [
        *[row(f"s{i}", n, f"src/{i}.ts", "code") for i, n in enumerate(["foo", "a.b", "operator+", "naïve", "変数", "+=", "b", "Tail", "qseam", "test_x", "x", "Foo.bar", "deep", "a/b", "util", "", "missing", "x.y", "Foo.baz", "x", "one.test.two", "KIND"])],
        row("nopath", "foo", None, "code"), row("hidden", "foo", "src/h.ts", "code", False), row("noname", None, "src/n.ts", "c"),
        row("t1", "checks kind", "tests/all.ts", code), row("t2", "x", "src/test_test_x.y.py", None), row("t3", None, "lib/deep.test.d/one.test.two.test.ts", ""),
        row("t4", "Foo", "a/b.spec.ts", "util"), row("t5", "", "__tests__/missing_test.go", "a.b"), row("t6", "again", "tests/all.ts", "foo a b"),
    ]
    names = [f.name for f in SYMBOLS]
    spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SYMBOLS).write.parquet(f"{path}/symbols.parquet")
    spark.createDataFrame([("e1", "s0", "s6", "calls", 1, None)], EDGES).write.parquet(f"{path}/edges.parquet")
    return str(path)


def same(spark, path, name):
    c = duckdb.connect()
    for t in ("symbols", "edges"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    df = catalog.queries()[name](spark, path)
    r = c.execute(catalog.oracle_sql()[name])
    at = [[x[0] for x in r.description].index(k) for k in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=repr)
    return df._jdf.queryExecution().executedPlan().toString()


def test_join17(spark, tmp_path):
    plan = same(spark, folder(spark, tmp_path), "join17_test_references")
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") < 25  # each costs the driver memory


def test_agg17(spark, tmp_path):
    plan = same(spark, folder(spark, tmp_path), "agg17_coverage")
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") < 28


def test_cmp13(spark, tmp_path):
    plan = same(spark, folder(spark, tmp_path), "cmp13_context_metrics")
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") < 33


def test_driver_holds_no_grams(spark, tmp_path, monkeypatch):
    path, plans = folder(spark, tmp_path), []
    cut = coverage.cut
    monkeypatch.setattr(coverage, "cut", lambda df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df, *a))[1])
    plans.append(same(spark, path, "cmp13_context_metrics").split("== Initial Plan ==")[-1])
    exploded, most = [], 0
    for plan in plans:
        lines = [(len(x) - len(x.lstrip(" :+-")), x.lstrip(" :+-")) for x in plan.splitlines()]
        most = max(most, sum("Join" in x.split(" ")[0] for _, x in lines))
        for k, (depth, x) in enumerate(lines):
            if x.startswith("BroadcastExchange"):
                below = next((j for j in range(k + 1, len(lines)) if lines[j][0] <= depth), len(lines))
                exploded += [y for _, y in lines[k + 1 : below] if y.startswith("Generate")]
    assert not exploded  # their estimated size is that of what they were exploded from
    assert len(plans) > 3 and most < 9  # the driver makes a whole plan anew with each of its stages
