import json

from graphloom.sources import documents as D


def test_manifests(spark):
    rows = [
        ("a/package.json", json.dumps({"dependencies": {"react": "^18", "@x/y": "1"}, "devDependencies": {"vitest": "2"}})),
        ("a/requirements.txt", "numpy==1.2\n# note\npandas>=2\nrich\n"),
        ("a/go.mod", "module x\nrequire github.com/a/b v1.2.3\n"),
        ("a/Cargo.toml", '[package]\nname = "z"\n[dependencies]\nserde = "1.0"\ntokio = { version = "1" }\n[dev-dependencies]\nrand = "0.8"\n'),
        ("a/platformio.ini", "[env:esp]\nlib_deps =\n  bblanchon/ArduinoJson @ ^6.0\n  lvgl\n"),
        ("b/package.json", "not json"),
        ("c/other.txt", "x==1"),
        ("d/package.json", None),
    ]
    got = {(r["dep"], r["dev"]) for r in D.manifests(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {("react", False), ("@x/y", False), ("vitest", True), ("numpy", False), ("pandas", False), ("rich", False), ("github.com/a/b", False), ("serde", False), ("tokio", False), ("rand", True), ("bblanchon/ArduinoJson", False), ("lvgl", False)}


def test_build_config(spark):
    rows = [("p/platformio.ini", "[env:esp32dev]\nframework = arduino\nbuild_flags = -DX=1 -Wall\n"), ("p/CMakeLists.txt", "project(foo C)\nadd_executable(foo main.c src/a.cpp)\n"), ("p/x.py", "no"), ("p/Makefile", "TARGET := bar\nCFLAGS = -O2 -Iinc\n")]
    got = {r["type"]: (r["name"], r["flags"], r["sources"], r["vendor"]) for r in D.build_config(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"platformio": ("esp32dev", ["-DX=1", "-Wall"], [], True), "cmake": ("foo", [], ["main.c", "src/a.cpp"], False), "make": ("bar", ["-O2", "-Iinc"], [], False)}


def test_traces(spark, tmp_path):
    step = lambda *src: {"name": "n", "from_steps": list(src)}
    (tmp_path / "trace.json").write_text(json.dumps({"id": "t", "steps": {"a": step(), "b": step("a"), "c": step("a"), "d": step("b", "c")}}, indent=1))
    (tmp_path / "bad.json").write_text("{")
    steps = {r["step"]: (r["upstream"], r["downstream"]) for r in D.trace_steps(D.read_json(spark, str(tmp_path), D.TRACE).where("id IS NOT NULL")).collect()}
    assert steps == {"a": ([], ["b", "c"]), "b": (["a"], ["d"]), "c": (["a"], ["d"]), "d": (["b", "c"], [])}
    runs = spark.createDataFrame([("run_1", "x", {"a": ({"kind": "done", "message": None},), "b": ({"kind": "error", "message": "boom"},)}), ("run_2", "y", {"a": (None,)})], D.RUN)
    assert {(r["run"], r["kind"]): (r["n"], r["share"]) for r in D.run_status(runs).collect()} == {("run_1", "done"): (1, 0.5), ("run_1", "error"): (1, 0.5), ("run_2", "waiting"): (1, 1.0)}
    assert [(r["step"], r["message"]) for r in D.failures(runs).collect()] == [("b", "boom")]
    assert D.latest_run(runs).first()["name"] == "run_2"


def test_snapshot(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.StringType())])
    assert D.snapshot(spark, str(tmp_path / "none"), schema).count() == 0
    spark.createDataFrame([("a",)], schema).write.parquet(str(tmp_path / "s"))
    assert D.snapshot(spark, str(tmp_path / "s"), schema).count() == 1


def test_settings():
    text = "scan:\n  include:\n    - src\n    - lib\n  exclude: [a, 'b']\n  depth: 3\nname: ${WHO} # note\nratio: 0.5\non: true\nnone:\n"
    got = D.settings(text, {"WHO": "me"})
    assert got == {"scan": {"include": ["src", "lib"], "exclude": ["a", "b"], "depth": 3}, "name": "me", "ratio": 0.5, "on": True, "none": None}
    assert D.merged(got, {"scan": {"depth": 4}})["scan"] == {"include": ["src", "lib"], "exclude": ["a", "b"], "depth": 4}
    assert D.settings("") == {}
