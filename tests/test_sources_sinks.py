import datetime as dt
import os

from graphloom.operators import linux as L
from graphloom.sinks import writers as W
from graphloom.sources import files as S


def test_discover_and_changes(spark, tmp_path):
    root = tmp_path / "proj"
    for name, text in {"index.ts": "export function main() {}\n", "services/user.ts": "class A {}\n", "node_modules/x/y.js": "no", "big.js": "x" * 600_000, "notes.txt": "no", "a b.py": "def f():\n    '''Doc.'''\n    return g()\n"}.items():
        p = root / name
        os.makedirs(p.parent, exist_ok=True)
        p.write_text(text)
    f = S.discover(spark, str(root))
    got = {r["path"]: (r["language"], r["line_count"]) for r in f.collect()}
    assert got == {"index.ts": ("typescript", 2), "services/user.ts": ("typescript", 2), "a b.py": ("python", 4)} or got.keys() == {"index.ts", "services/user.ts", "a%20b.py"}
    first = f.select("path", "hash")
    known = spark.createDataFrame(first.collect(), "path string, hash string")
    (root / "index.ts").write_text("export function other() {}\n")
    (root / "new.py").write_text("x = 1\n")
    os.remove(root / "services/user.ts")
    status = {r["path"]: r["status"] for r in S.changes(known, S.discover(spark, str(root)).select("path", "hash")).collect()}
    assert status["index.ts"] == "changed" and status["new.py"] == "new" and status["services/user.ts"] == "gone"


def test_parse(spark):
    rows = [("a.py", "class A(B):\n    def m(self):\n        'Doc.'\n        return h(self.k())\n\ndef f(): pass\n", "python"), ("b.ts", "export class C {}\nasync function go() {}\ninterface I {}\n", "typescript"), ("c.c", "static int add(int a, int b)\n{\n}\n", "c"), ("bad.py", "def (", "python"), ("n.py", None, "python"), ("e.py", "", None)]
    got = {(r["path"], r["name"]): (r["kind"], r["start_line"]) for r in S.parse(spark.createDataFrame(rows, "path string, text string, language string")).collect()}
    assert got == {("a.py", "A"): ("class", 1), ("a.py", "m"): ("method", 2), ("a.py", "f"): ("function", 6), ("b.ts", "C"): ("class", 1), ("b.ts", "go"): ("function", 2), ("b.ts", "I"): ("interface", 3), ("c.c", "add"): ("function", 1)}


def test_macros(spark):
    rows = [("a.h", "API_EXPORT int one(int a);\nAPI_EXPORT const char *two(void);\nAPI_EXPORT int one(int a);\nint three(void);\n"), ("a.ts", "API_EXPORT int one(int a);"), ("b.c", None)]
    got = {r["name"] for r in S.macro_declarations(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"one", "two"}


KBUILD = "obj-$(CONFIG_FOO_DRIVER) += foo-core.o\nobj-m := bar-module.o\nfoo-core-objs := foo-main.o foo-irq.o\n"
KCONFIG = 'config FOO_DRIVER\n\ttristate "Foo support"\n\tdepends on OF\n\tselect REGMAP\n\thelp\n\t  Foo.\n\nconfig BAR\n\tbool "Bar"\n'
DTS = '/ {\n\tuart0: serial@1000 {\n\t\tcompatible = "acme,uart", "ns16550";\n\t\tstatus = "okay";\n\t};\n\tspi@2000 {\n\t\tcompatible = "acme,spi";\n\t\tstatus = "disabled";\n\t};\n};\n'
DRIVER = 'static const struct of_device_id m[] = { { .compatible = "acme,uart" }, {} };\nstatic struct platform_driver foo_driver = { .probe = foo_probe, .remove = foo_remove, .driver = { .name = "foo" } };\nmodule_param(debug_mode, int, 0);\nMODULE_LICENSE("GPL");\nMODULE_AUTHOR("A");\nMODULE_DESCRIPTION("D");\n'
SERVICE = "[Unit]\nAfter=network.target a.service\n[Service]\nExecStart=/usr/bin/foo -x\n[Install]\nWantedBy=multi-user.target\n"
RECIPE = 'SUMMARY = "Foo"\nLICENSE = "MIT"\nSRC_URI = "git://x \\\n file://y"\nDEPENDS = "libfoo"\nRDEPENDS:${PN} = "libfoo-runtime"\ninherit systemd cmake\n'


def test_linux(spark):
    t = lambda x: spark.createDataFrame([("f", x), ("n", None)], "k string, t string")
    k = {(r["target"], r["config"]): r["objects"] for r in L.kbuild(t(KBUILD), "k", "t").collect()}
    assert k == {("obj", "CONFIG_FOO_DRIVER"): ["foo-core.o"], ("obj", None): ["bar-module.o"], ("foo-core", None): ["foo-main.o", "foo-irq.o"]}
    c = {r["name"]: (r["type"], r["prompt"], r["depends_on"], r["selects"]) for r in L.kconfig(t(KCONFIG), "k", "t").collect()}
    assert c == {"FOO_DRIVER": ("tristate", "Foo support", ["OF"], ["REGMAP"]), "BAR": ("bool", "Bar", [], [])}
    nodes = L.device_tree(t(DTS), "k", "t")
    assert {r["node"]: (r["label"], r["status"], r["compatible"]) for r in nodes.collect()} == {"serial@1000": ("uart0", "okay", ["acme,uart", "ns16550"]), "spi@2000": (None, "disabled", ["acme,spi"])}
    d = L.drivers(t(DRIVER), "k", "t")
    r = d.first()
    assert (r["bus"], r["name"], r["probe"], r["remove"], r["license"], r["compatible"], r["params"]) == ("platform", "foo", "foo_probe", "foo_remove", "GPL", ["acme,uart"], ["debug_mode"])
    assert [(x["node"], x["driver"]) for x in L.matched(nodes, d).collect()] == [("serial@1000", "foo")]
    s = L.services(t(SERVICE), "k", "t").first()
    assert (s["exec_start"], s["after"], s["wanted_by"]) == ("/usr/bin/foo -x", ["network.target", "a.service"], ["multi-user.target"])
    x = L.recipes(t(RECIPE), "k", "t").first()
    assert (x["summary"], x["src_uri"], x["depends"], x["rdepends"], x["inherits"]) == ("Foo", ["git://x", "file://y"], ["libfoo"], ["libfoo-runtime"], ["systemd", "cmake"])


def test_upserts(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, name string, n int")
    new = spark.createDataFrame([("b", "z", 9), ("c", "w", None)], "id string, name string, n int")
    rows = lambda df: {r["id"]: (r["name"], r["n"]) for r in df.collect()}
    assert rows(W.upsert(old, new, "id")) == {"a": ("x", 1), "b": ("z", 9), "c": ("w", None)}
    assert rows(W.upsert(old, new, "id", ["n"])) == {"a": ("x", 1), "b": ("y", 9), "c": ("w", None)}
    assert rows(W.insert_new(old, new, "id")) == {"a": ("x", 1), "b": ("y", 2), "c": ("w", None)}
    nodes = spark.createDataFrame([("a", "f"), ("b", "g")], "id string, file_path string")
    edges = spark.createDataFrame([("1", "a", "b"), ("2", "b", "b"), ("3", "b", "zz")], "id string, src string, dst string")
    n, e = W.delete_files(nodes, edges, spark.createDataFrame([("f",)], "path string"))
    assert [r["id"] for r in n.collect()] == ["b"] and {r["id"] for r in e.collect()} == {"2", "3"}


def test_save_forms(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x"], dt.date(2024, 1, 1)), ("b", None, None)], "id string, l array<string>, d date")
    for form in ("parquet", "orc", "json", "csv"):
        W.save(df, str(tmp_path / form), form=form)
        assert spark.read.option("header", True).format(form).load(str(tmp_path / form)).count() == 2
