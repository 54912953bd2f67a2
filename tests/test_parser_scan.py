import pytest
from pyspark.sql import functions as F

from graphloom.operators import scan
from graphloom.sources import files as S
from graphloom.sources.parser import complexity, mask, parse_text


def names(code, lang, *fields):
    return [tuple(getattr(s, f) for f in ("name", "kind", *fields)) for s in parse_text(code, lang).symbols]


def relations(code, lang, kind):
    return [(r.source, r.target) for r in parse_text(code, lang).relations if r.kind == kind]


def test_one_function_one_class_one_interface():
    assert names("\n  function hello() {\n    return 'world';\n  }\n", "typescript") == [("hello", "function")]
    assert names("\n  class UserService {\n    constructor() {}\n    getUser() {}\n  }\n", "typescript", "parent") == [("UserService", "class", None), ("constructor", "method", "UserService"), ("getUser", "method", "UserService")]
    assert names("export function open() {}\nfunction closed() {}\n", "typescript", "exported") == [("open", "function", True), ("closed", "function", False)]
    assert names("interface User {\n  id: number;\n  name: string;\n}\n", "typescript") == [("User", "interface")]
    assert relations("function helper() {}\nfunction main() {\n  helper();\n}\n", "typescript", "calls") == [("main", "helper")]
    for text in ("", None, " \n", "// note\n/* more\n lines */\n"):
        assert parse_text(text, "typescript") == ([], [], [])
    assert parse_text("x", None) == ([], [], []) and parse_text("x = (", "python") == ([], [], [])


TS = """import fs, { readFile as rf, join } from 'node:fs';
import * as path from 'path';
import './side';
const { Foo } = require('./foo');
/** Says hello. */
export function hello(a: string, b = f(1)): { x: number } {
  const y = "}{ import z from 'q'";
  return helper(y, callback) ? 1 : 2;
}
@Injectable()
export default class Service<T> extends Base<T> implements A, B {
  /** Gets. */
  async get(id: number): Promise<User> {
    if (id > 1 && id < 3) { this.repo.find(id); }
  }
}
export type Id = string | number;
enum Color { Red }
"""


def test_typescript():
    assert names(TS, "typescript", "start_line", "end_line", "doc", "exported") == [
        ("hello", "function", 6, 9, "/** Says hello. */", True), ("Service", "class", 11, 16, None, True), ("get", "method", 13, 15, "/** Gets. */", False), ("Id", "type", 17, 17, None, True), ("Color", "enum", 18, 18, None, False)]
    assert relations(TS, "typescript", "extends") == [("Service", "Base")]
    assert relations(TS, "typescript", "implements") == [("Service", "A"), ("Service", "B")]
    assert relations(TS, "typescript", "decorates") == [("Service", "Injectable")]
    assert relations(TS, "typescript", "contains") == [("Service", "get")]
    assert {("hello", "helper"), ("hello", "callback"), ("Service", "this.repo.find")} <= set(relations(TS, "typescript", "calls"))
    assert [(i.source, i.names, i.wildcard, i.line) for i in parse_text(TS, "typescript").imports] == [("node:fs", ["readFile", "join", "fs"], False, 1), ("path", [], True, 2), ("./side", [], False, 3), ("./foo", ["Foo"], False, 4)]


CPP = """#include <stdio.h>
#include "a/b.h"
#define MAX 10
#define SQ(x) ((x)*(x))
/** Adds. */
static int add(int a, int b)
{
    if (a) { return more(b, a); }
    return a + b;
}
struct point { int x; };
typedef struct { int z; } pt_t;
typedef unsigned long ulong_t;
int proto(void);
int counter = 0;
void Foo::bar(int x) const { baz(); }
class Foo : public Base {
public:
  void run() { go(); }
};
"""


def test_cpp_go_rust_java():
    assert names(CPP, "cpp", "parent", "exported") == [
        ("MAX", "constant", None, True), ("SQ", "function", None, True), ("add", "function", None, False), ("point", "class", None, True), ("pt_t", "type", None, True), ("ulong_t", "type", None, True),
        ("proto", "function", None, True), ("counter", "variable", None, True), ("bar", "method", "Foo", True), ("Foo", "class", None, True), ("run", "method", "Foo", True)]
    assert relations(CPP, "cpp", "extends") == [("Foo", "Base")] and ("add", "more") in relations(CPP, "cpp", "calls")
    assert [(i.source, i.names, i.wildcard) for i in parse_text(CPP, "cpp").imports] == [("stdio.h", ["*"], True), ("a/b.h", ["*"], True)]
    go = 'package main\n\nimport (\n\t"fmt"\n\tx "a/b"\n)\n\n// Server serves.\ntype Server struct { a int }\n\nfunc (s *Server) Run(a int) error { return s.start(a) }\nfunc helper() { fmt.Println("x{") }\ntype I interface { Run() }\n'
    assert names(go, "go", "parent", "exported", "doc") == [("Server", "class", None, True, "// Server serves."), ("Run", "method", "Server", True, None), ("helper", "function", None, False, None), ("I", "interface", None, True, None)]
    rust = "use std::io::{Read, Write as W};\n/// A point.\npub struct Point { x: i32 }\nimpl fmt::Display for Point {\n    fn fmt(&self) -> R { write!(f, \"{}\", 'a') }\n}\npub fn main<'a>(x: &'a str) { go(x); }\n"
    assert names(rust, "rust", "parent", "exported", "doc") == [("Point", "class", None, True, "/// A point."), ("fmt", "method", "Point", False, None), ("main", "function", None, True, None)]
    assert relations(rust, "rust", "implements") == [("Point", "fmt::Display")]
    java = "package a.b;\nimport java.util.List;\n/** Main. */\n@Service\npublic class Main extends Base implements Runnable {\n    @Override\n    public void run() throws X { if (a) { go(x); } new Foo(y); }\n    static <T> List<T> of(T a) { return null; }\n}\n"
    assert names(java, "java", "parent", "exported", "doc") == [("Main", "class", None, True, "/** Main. */"), ("run", "method", "Main", True, None), ("of", "method", "Main", False, None)]
    assert relations(java, "java", "decorates") == [("Main", "Service"), ("run", "Override")]


def test_python():
    code = 'import os\nfrom a.b import c, d\nX = 1\n@router.get("/")\ndef f(x=Depends(get_db)):\n    """Doc."""\n    return g(h, 1)\n# about K\nclass K(Base):\n    def m(self): return self.n()\n'
    assert names(code, "python", "parent", "doc") == [("X", "constant", None, None), ("f", "function", None, "Doc."), ("K", "class", None, "# about K"), ("m", "method", "K", None)]
    assert {("f", "Depends"), ("f", "get_db"), ("f", "g"), ("K", "self.n")} <= set(relations(code, "python", "calls"))
    assert relations(code, "python", "decorates") == [("f", "router.get")] and relations(code, "python", "imports") == [("X", "os"), ("X", "a.b")]


def test_complexity_and_masks():
    assert complexity("if (a) {} else if (b && c) {} x = p ? q : r;", "c") == 1 + 2 + 1 + 1 + 1
    assert complexity("#ifdef A\nwhile (1) {}\n", "c") == 3 and complexity("#ifdef A\nwhile (1) {}\n", "go") == 2
    for lang in ("typescript", "c", "go", "rust", "java"):
        code = "a /* { \n */ \"}\\\"\" '{' // {\nb"
        masked, comments = mask(code, lang)
        assert len(masked) == len(code) and masked.count("\n") == 2 and "{" not in masked and len(comments) == 2


@pytest.mark.parametrize("lang", ["typescript", "cpp", "go", "rust", "java", "python"])
def test_odd_texts_end(lang):
    for code in ("{" * 20_000, "(" * 5000 + "}" * 5000, "'" * 9999, "/*" * 5000, "class A {" * 400, "function f(" * 400, "é漢\r\n\0" * 500, "a" * 200_000, "x = 1;" * 20_000):
        parse_text(code, lang)


FILES = [
    ("r/src/main.ts", "typescript", "import { User } from './user';\nimport { go } from '../lib';\nexport function main() {\n  const u = new User();\n  go(u);\n  local();\n  unknown();\n}\nfunction local() {}\n"),
    ("r/src/user.ts", "typescript", "/** A user. */\nexport class User {\n  name() { return helper(); }\n}\n"),
    ("r/lib/index.ts", "typescript", "export function go(x) { return x; }\n"),
    ("r/lib/help.ts", "typescript", "export function helper() {}\n"),
    ("r/a.c", "c", '#include "util/b.h"\nint run(void) { return twice(2); }\n'),
    ("r/inc/b.h", "c", "int twice(int x);\n"),
    ("r/empty.ts", "typescript", ""),
    ("r/null.ts", "typescript", None),
    ("s/lib/index.ts", "typescript", "export function helper() {}\n"),
]


def test_scan(spark, tmp_path):
    df = spark.createDataFrame(FILES, "path string, language string, text string")
    g = scan.graph(df)
    ids = {r["name"]: r["id"] for r in g["symbols"].where("file_path LIKE 'r/%'").collect()}
    assert ids["main"] == "r/src/main.ts:main:3" and ids["name"] == "r/src/user.ts:name:3"
    e = {(r["src"], r["dst"], r["kind"]) for r in g["edges"].collect()}
    assert {(ids["main"], ids["go"], "calls"), (ids["main"], ids["User"], "calls"), (ids["main"], ids["local"], "calls"), (ids["main"], "unknown", "calls")} <= e
    assert (ids["User"], ids["helper"], "calls") in e  # the only one of its name in the repository
    assert {(ids["main"], ids["User"], "imports"), (ids["main"], ids["go"], "imports"), (ids["run"], ids["twice"], "imports"), (ids["run"], ids["twice"], "calls")} <= e
    assert (ids["User"], ids["name"], "contains") in e
    assert g["files"].count() == len(FILES)
    scan.save(g, str(tmp_path))
    back = spark.read.parquet(f"{tmp_path}/symbols.parquet")
    assert back.count() == g["symbols"].count() and set(back.columns) == set(g["symbols"].columns)
    # user.ts changes, help.ts goes
    known = {n: spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in g}
    new = spark.createDataFrame([("r/src/user.ts", "typescript", "\n\nexport class User {}\n")], df.schema)
    h = scan.rescan(known, new, spark.createDataFrame([("r/lib/help.ts",)], "path string"))
    e = {(r["src"], r["dst"]) for r in h["edges"].collect()}
    assert (ids["main"], "r/src/user.ts:User:3") in e and (ids["main"], ids["go"]) in e and not any(ids["helper"] in x for x in e)
    assert h["symbols"].where("name IN ('helper', 'name') AND file_path LIKE 'r/%'").count() == 0
    assert scan.graph(df.limit(0))["edges"].count() == 0


def test_relative_paths(spark):
    rows = [("a/b/c.ts", "./d", "a/b/d"), ("a/b/c.ts", "../d/e", "a/d/e"), ("c.ts", "./d", "d"), ("a/b/c.py", ".d", "a/b/d"), ("a/b/c.py", "..d.e", "a/d/e"), ("a/b/c.py", ".", "a/b"), ("a/c.ts", "../../../x", "x"), ("a/c.ts", "lodash", None), ("a/c.ts", None, None)]
    df = spark.createDataFrame(rows, "p string, s string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", S.relative_path(F.col("p"), F.col("s"))).collect())
