import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions.embedding import embed_one
from graphloom.operators import rules as R
from graphloom.operators import search as S


def test_embedding_forms_agree(spark):
    texts = ["Get the user by id", "", "a b c", "snake_case CamelCase 42 éà", "one", None, "x " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    sql = {r["i"]: r["v"] for r in df.select("i", S.hash_embedding(F.col("t"), 64).alias("v")).collect()}
    arrow = {r["i"]: r["embedding"] for r in S.embed_texts(df, "t", dim=64).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert sql[i] is None and arrow[i] is None
            continue
        want = embed_one(t, 64)
        assert max(abs(a - b) for a, b in zip(want, sql[i], strict=True)) < 1e-12
        assert max(abs(a - b) for a, b in zip(want, arrow[i], strict=True)) < 1e-12
        assert abs(math.sqrt(sum(x * x for x in want)) - (1 if want != [0.0] * 64 else 0)) < 1e-9


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r["c"] for r in df.select(S.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0]


QUESTIONS = [
    ("Can I safely delete UserService?", "safe_delete"),
    ("What happens if I change the login function?", "impact"),
    ("who calls getUser", "call_chain"),
    ("删除这个函数安全吗", "safe_delete"),
    ("修改这里会影响什么", "impact"),
    ("What does main do? explain", "understand"),
    ("Show me the architecture", "architecture"),
    ("zzz", "free_form"),
    ("", "free_form"),
    (None, "free_form"),
]


def test_intents(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(QUESTIONS)], "i int, q string")
    got = {r["i"]: r["intent"] for r in R.intents(df, "q").collect()}
    assert got == {i: k for i, (_, k) in enumerate(QUESTIONS)}


T0 = dt.datetime(2024, 1, 1)
S_ = "id string, name string, kind string, file_path string, source_code string, updated_at timestamp"


def test_layers(spark):
    rows = [("1", "getUser", "function", "src/routes/api.ts"), ("2", "createUser", "function", "src/services/user.ts"), ("3", "saveUser", "method", "src/repositories/user-repository.ts"), ("4", "x", "function", "zzz.ts"), ("5", "lv_obj", "type", "zzz.ts"), ("6", "q", None, "src/utils/a.ts")]
    s = spark.createDataFrame([(*r, None, T0) for r in rows], S_)
    f = spark.createDataFrame([("zzz.ts", ["lodash"], T0)], "path string, imports array<string>, parsed_at timestamp")
    got = {r["id"]: r["layer"] for r in R.classify_layers(s, f).collect()}
    assert got == {"1": "interface", "2": "business", "3": "data", "4": "business", "5": "business", "6": "utility"}
    more = {r["id"]: r["layer"] for r in R.classify_layers(s, f, [("data", "path", 9, ["zzz.*"])]).collect()}
    assert more["4"] == "data" and {r["id"]: r["layer"] for r in R.classify_layers(s, f).collect()} == got


@pytest.mark.parametrize(("glob", "yes", "no"), [("**/routes/**", "a/routes/b.ts", "a/route/b.ts"), ("**/*.service.*", "x/y.service.ts", "x/service.ts"), ("src/*.py", "src/a.py", "src/b/a.py")])
def test_globs(glob, yes, no):
    import re

    assert re.match(R.glob_regex(glob), yes) and not re.match(R.glob_regex(glob), no)


def test_review_and_long(spark):
    code = "try { eval('x'); el.innerHTML = 1; } catch (e) { }\n// TODO: fix\npassword = 'abcdefgh1'\nfor (;;) { for (;;) {} }"
    rows = [("a", "f", "function", "a.ts", code, T0), ("b", "g", "function", "a.ts", "x\n" * 150, T0), ("c", "h", "method", "a.ts", None, T0), ("d", "C", "class", "a.ts", "y\n" * 501, T0)]
    s = spark.createDataFrame(rows, S_)
    got = {(r["id"], r["rule"]) for r in R.review(s).collect()}
    assert {("a", x) for x in ("eval", "inner-html", "empty-catch", "note", "hardcoded-secret", "nested-loops")} <= got and ("c", "note") not in got
    assert {(r["id"], r["severity"]) for r in R.long_code(s).collect()} == {("b", "warning"), ("d", "error")}
