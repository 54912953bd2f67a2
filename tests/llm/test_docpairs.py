import datetime as dt

import pytest

from graphloom.llm.docpairs import describe, doc_pairs

SAYS = [
    ("handler", "/** Must run before padPabe. */", "function handler() {}"),
    ("f", "# Caller must already hold the lock.", "def f(): pass"),
    ("f", None, 'def f(a: int, b=(1, 2)) -> str:\n    """Keeps the queue in step with the disk."""\n    return 1'),
    ("g", None, "// TODO: tidy up.\n// Falls back to the old cache when no new one is there.\nfunction g() {}"),
    ("g", "/**\n * 解析全局关系，并压缩所有共享会话。\n */", "function g() {}"),
    ("g", "/**\n * @param q the header which is read from the open socket\n */", "function g(q) {}"),
]
SILENT = [
    ("lockPamar", "/**\n * lockPamar\n */", "function lockPamar() {}"),
    ("visitZibeka", "/** Visits the zibeka */", "x"),
    ("h", "/** ---- timer ---- */", "x"),
    ("h", "# noqa: E501", "x"),
    ("h", "/**\n * Copyright (c) 2016 The Truta Authors. All rights reserved.\n */", "x"),
    ("h", "/** while (stale.length > 8946) { */", "x"),
    ("h", "# :param a:\n# :returns:", "def h(a): pass"),
    ("h", "/**\n * @param openCache the open cache\n * @returns the result\n */", "function h(openCache) {}"),
    ("h", "/** TODO: translate and complete the documentation once the review is over. */", "x"),
    ("h", "/** Auto-generated method stub */", "x"),
    ("h", "", "x"),
    ("h", None, None),
]


@pytest.mark.parametrize(("name", "doc", "code"), SAYS)
def test_says_something(name, doc, code):
    assert describe(doc, code, name)


@pytest.mark.parametrize(("name", "doc", "code"), SILENT)
def test_says_nothing(name, doc, code):
    assert not describe(doc, code, name)


SCHEMA = "id string, name string, kind string, file_path string, source_code string, doc_comment string, metadata map<string,string>, updated_at timestamp, description int, inherits int"


def row(i, name, kind, code, doc=None, parent=None, at=1, file="a.py"):
    return (i, name, kind, file, code, doc, {"parent": parent} if parent else None, dt.datetime(2024, 1, at), 1, 1)


def test_inherited_documentation_and_versions(spark):
    rows = [
        row("B", "Base", "class", "class Base:\n  pass"),
        row("M", "Mid", "class", "class Mid(Base):\n  pass"),
        row("C", "Leaf", "class", "class Leaf(Mid):\n  pass"),
        row("B.run", "run", "method", "def run(self): pass", "# Walks every open socket once.", "Base"),
        row("M.run", "run", "method", "def run(self): pass", None, "Mid"),
        row("C.run", "run", "method", "def run(self): pass", "# {@inheritDoc}", "Leaf"),
        row("C.off", "off", "method", "def off(self): pass", "# {@inheritDoc}", "Leaf"),
        row("old", "old", "function", "def old(): pass", "# Keeps the disk in step with the cache."),
        row("old", "old", "function", "def old(): pass", "# TODO", at=2),
        row("new", "new", "function", "def new(): pass", "# Keeps the disk in step with the cache.", at=2),
        row("new", "new", "function", "", None),
        row("none", None, None, None, None),
        row("empty", "empty", "function", "", "# Keeps the disk in step with the cache."),
    ]
    got = {r["id"]: r["from_id"] for r in doc_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"B.run": "B.run", "M.run": "B.run", "C.run": "B.run", "new": "new"}


def test_empty(spark):
    assert doc_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


SAID = "# Opens the local socket before anything is sent."
OTHER = "# Renders all the invoices of one month."


def test_bases_are_told_apart_by_file_import_and_repository(spark):
    rows = []

    def base(file, doc, name="Base"):
        rows.extend([row(f"{file}:{name}", name, "class", f"class {name}:\n  pass", file=file), row(f"{file}:{name}.run", "run", "method", "def run(self): pass", doc, name, file=file)])

    def kid(file, head, name="Kid", text=None):
        rows.extend([row(f"{file}:{name}", name, "class", head, file=file), row(f"{file}:{name}.run", "run", "method", "def run(self): pass", None, name, file=file)])
        if text:
            rows.append(row(f"{file}:m", "m", "module", text, file=file))

    base("a0/z.py", OTHER)
    base("r1/a.py", SAID)
    kid("r1/sub/b.py", "class Kid(Base):\n  pass")  # the repository's own, though a0/z.py comes first
    base("r2/x/one.py", OTHER)
    base("r2/y/two.py", SAID)
    kid("r2/c.py", "@dec(a=(1))\nclass Kid(two.Base, metaclass=Meta):\n  pass", text="import os\nfrom y.two import (\n  Other,\n  Base,\n)\n")
    kid("r2/x/d.py", "class Kid(Base):\n  pass")  # the one in the same directory
    base("r2/e.py", SAID)
    kid("r2/e.py", "class Kid(Base):\n  pass", name="Near")  # the one in the same file
    kid("r3/f.py", "class Kid(Base):\n  pass")  # nobody's
    base("r4/lib/index.ts", SAID)
    base("r4/b.ts", OTHER)
    kid("r4/src/g.ts", "/** Kid of the base. */\nexport abstract class Kid<T extends Foo> extends Base<T> implements Bar {\n}", text="import {\n  Base,\n} from '../lib';\n")
    kid("r4/src/long.ts", "/*" + " and so on\n" * 900 + "*/\nexport class Kid extends Base {\n}")
    got = {r["id"]: (r["from_id"], r["description"]) for r in doc_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    source = {k: v[0] for k, v in got.items() if k != v[0]}
    assert source == {
        "r1/sub/b.py:Kid.run": "r1/a.py:Base.run",
        "r2/c.py:Kid.run": "r2/y/two.py:Base.run",
        "r2/x/d.py:Kid.run": "r2/x/one.py:Base.run",
        "r2/e.py:Near.run": "r2/e.py:Base.run",
        "r4/src/g.ts:Kid.run": "r4/lib/index.ts:Base.run",
        "r4/src/long.ts:Kid.run": "r4/b.ts:Base.run",
    }


def test_deep_cyclic_and_branching_hierarchies_against_brute_force(spark):
    import random

    rng = random.Random(11)
    rows, bases, docs, methods = [], {}, {}, []
    for i in range(60):
        up = rng.sample(range(60), rng.choice([0, 1, 1, 2])) if i >= 12 else [i + 1]  # 0 .. 12: a chain of twelve levels; cycles elsewhere
        bases[i] = [b for b in up if b != i]
        rows.append(row(f"c{i:02d}", f"C{i}", "class", f"class C{i}({', '.join(f'C{b}' for b in bases[i])}):\n  pass"))
        for m in ("go", "stop"):
            doc = f"# Tells the {m} number {i} of all the open sockets." if (i == 12 and m == "go") or (i > 12 and rng.random() < 0.2) else None
            rows.append(row(f"c{i:02d}.{m}", m, "method", f"def {m}(self): pass", doc, f"C{i}"))
            methods.append((i, m))
            if doc:
                docs[i, m] = f"c{i:02d}.{m}"
    want = {}
    for i, m in methods:
        if (i, m) in docs:
            want[f"c{i:02d}.{m}"] = docs[i, m]
            continue
        seen, level = set(), {i: ()}
        while level:
            reached = {}
            for c, way in level.items():
                for place, b in enumerate(bases[c]):
                    if b not in seen and (b not in reached or (*way, place) < reached[b]):
                        reached[b] = (*way, place)
            hits = sorted((way, docs[c, m]) for c, way in reached.items() if (c, m) in docs)
            if hits:
                want[f"c{i:02d}.{m}"] = hits[0][1]
                break
            seen |= set(reached)
            level = reached
    got = {r["id"]: r["from_id"] for r in doc_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and got["c00.go"] == "c12.go"


def test_documentation_behind_long_signatures(spark):
    wide = "def f(\n" + "".join(f"    a{i}: int = {i},\n" for i in range(3000)) + ') -> str:\n    """Keeps the queue in step with the disk."""\n'
    assert describe(None, wide, "f") == "Keeps the queue in step with the disk."
