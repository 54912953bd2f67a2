"""Queries over the files of a project: manifests and dependencies, firmware, kernel and image descriptions, traces.

The test tables have no such files, so these run over the rows of ``graphloom.fixtures``; their SQL states what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import fixtures as X
from graphloom.functions.imports import dynamic_packages, included_packages, packages, static_packages
from graphloom.model import Graph, sql
from graphloom.operators import dependencies as D
from graphloom.operators import embedded as E
from graphloom.operators import graph as O
from graphloom.operators import linux as L
from graphloom.operators.versions import latest
from graphloom.plans.catalog import query
from graphloom.plans.graphplans import CYCLES_SQL, file_imports
from graphloom.sources import documents as S
from graphloom.sources import files as P
from graphloom.storage import cut


def _values(columns: str, *rows: tuple) -> str:
    """SQL of a constant table; strings, numbers, booleans and None."""

    def lit(v: object) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns})"


# --- manifests and dependencies

_MANIFESTS = (
    ("api/requirements.txt", "fastapi", "0.104.1", False), ("api/requirements.txt", "requests", None, False), ("api/requirements.txt", "uvicorn", "0.24", False),
    ("core/Cargo.toml", "criterion", "0.5", True), ("core/Cargo.toml", "serde", "1.0", False), ("core/Cargo.toml", "tokio", None, False),
    ("fw/platformio.ini", "bblanchon/ArduinoJson", "^6.21.0", False), ("fw/platformio.ini", "knolleary/PubSubClient", None, False), ("fw/platformio.ini", "lvgl/lvgl", "^8.3.0", False),
    ("svc/go.mod", "github.com/gin-gonic/gin", "v1.9.1", False), ("svc/go.mod", "github.com/redis/go-redis/v9", "v9.0.0", False), ("svc1/go.mod", "github.com/spf13/cobra", "v1.8.0", False),
    ("web/package.json", "@scope/tools", "1.0.0", False), ("web/package.json", "express", "^4.18.0", False), ("web/package.json", "left-pad", "1", False), ("web/package.json", "lodash", "4", False), ("web/package.json", "lodash", "4", True),
    ("web/package.json", "pg", "8", False), ("web/package.json", "vitest", "1.0.0", True),
)


@query("src20_manifests", _values("path, dep, version, dev", *_MANIFESTS))
def manifests(g: Graph) -> DataFrame:
    return S.manifests(X.files(g.spark))


def _imported(g: Graph, like: str) -> DataFrame:
    return X.files(g.spark, like).select(F.explode(packages(F.col("text"))).alias("pkg")).distinct()


@query("fn12_import_packages", _values("path, kind, pkg", ("web/src/app.ts", "static", "express"), ("web/src/app.ts", "static", "@scope/tools"), ("web/src/app.ts", "static", "undeclared"), ("web/src/app.ts", "static", "pg-pool"), ("web/src/app.ts", "dynamic", "chokidar"), *[("fw/src/main.cpp", "include", p) for p in ("Arduino", "lvgl", "ArduinoJson", "audio", "TinyGPS")]))
def import_packages(g: Graph) -> DataFrame:
    """Packages by the way they are named: import statements, dynamic imports, include lines."""
    f = X.files(g.spark, r"app\.ts|main\.cpp")
    part = lambda name, x: f.select("path", F.lit(name).alias("kind"), F.explode(x(F.col("text"))).alias("pkg"))
    return part("static", static_packages).unionByName(part("dynamic", dynamic_packages)).unionByName(part("include", included_packages)).distinct()


@query("set07_imported_packages", sql(r"""c AS (SELECT source_code AS t FROM sym WHERE source_code IS NOT NULL),
i AS (SELECT unnest(list_concat(regexp_extract_all(t, 'import\s+.*?\s+from\s+[''"]([^''"]+)[''"]', 1), list_concat(regexp_extract_all(t, 'import\s+[''"]([^''"]+)[''"]', 1), regexp_extract_all(t, 'require\s*\(\s*[''"]([^''"]+)[''"]\s*\)', 1)))) AS s FROM c),
d AS (SELECT unnest(regexp_extract_all(t, 'import\s*\(\s*[''"]([^''"]+)[''"]\s*\)', 1)) AS s FROM c), h AS (SELECT unnest(regexp_extract_all(t, '#\s*include\s*[<"]([^>"]+)[>"]', 1)) AS s FROM c),
p AS (SELECT CASE WHEN s LIKE '@%' THEN CASE WHEN contains(s, '/') THEN split_part(s, '/', 1) || '/' || split_part(s, '/', 2) END ELSE split_part(s, '/', 1) END AS pkg FROM (SELECT s FROM i WHERE NOT starts_with(s, '.') AND NOT starts_with(s, '/') AND (NOT contains(s, '.') OR starts_with(s, '@')) AND lower(s) NOT IN ('file', 'module', 'source', 'path', 'lines', 'code') UNION ALL SELECT s FROM d WHERE NOT starts_with(s, '.') AND NOT starts_with(s, '/'))
UNION ALL SELECT CASE WHEN contains(s, '/') THEN split_part(s, '/', 1) WHEN length(regexp_replace(s, '\.h(h|pp|xx)?$', '')) > 2 THEN regexp_replace(s, '\.h(h|pp|xx)?$', '') END FROM h WHERE NOT regexp_matches(s, '^(esp_|freertos|driver|hal|soc|sdkconfig|std|string|cmath|cstd|cint|cstr|sys/|linux/|asm/)')
UNION ALL SELECT nullif(regexp_extract(file_path, '(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)', 1), '') FROM sym UNION ALL SELECT nullif(regexp_extract(file_path, '(?:^|/)\.pio/libdeps/[^/]+/([^/]+)', 1), '') FROM sym)
SELECT DISTINCT pkg FROM p WHERE pkg IS NOT NULL"""))
def imported_packages(g: Graph) -> DataFrame:
    """All packages that code imports, by four producers: import statements, dynamic imports, include lines and the
    directories of installed packages. What is shuffled is the names only."""
    from graphloom.functions.imports import package_of_path

    found = F.concat(packages(F.coalesce("source_code", F.lit(""))), F.filter(F.array(package_of_path(F.col("file_path"))), lambda x: x.isNotNull()))
    return latest(g.heavy("symbols"), "id", "updated_at", found.alias("pkgs")).select(F.explode("pkgs").alias("pkg")).distinct()


@query("join15_unused_declared", _values("project, dep", ("fw", "knolleary/PubSubClient"), ("web", "left-pad")))
def unused(g: Graph) -> DataFrame:
    """Declared dependencies that nothing imports, by project: development ones are exempt, ``pg`` is found in ``pg-pool``."""
    out = None
    for project in ("web", "fw"):
        part = D.unused(S.manifests(X.files(g.spark, f"^{project}/")), _imported(g, f"^{project}/")).select(F.lit(project).alias("project"), "dep")
        out = part if out is None else out.unionByName(part)
    return out


@query("join16_unlisted_imports", _values("project, pkg", ("fw", "TinyGPS"), ("web", "chokidar"), ("web", "pg-pool"), ("web", "undeclared")))
def unlisted(g: Graph) -> DataFrame:
    """Imported packages that no manifest of the project declares; framework, system and local headers need none."""
    out = None
    for project in ("web", "fw"):
        part = D.unlisted(S.manifests(X.files(g.spark, f"^{project}/")), _imported(g, f"^{project}/")).select(F.lit(project).alias("project"), "pkg")
        out = part if out is None else out.unionByName(part)
    return out


#: The tables' own packages against each other: those that files of several repositories import stand for declared ones.
_USED = "im AS (SELECT DISTINCT split_part(path, '/', 1) AS repo, unnest(imports) AS imp FROM fil), pk AS (SELECT DISTINCT repo, CASE WHEN imp LIKE '@%' THEN split_part(imp, '/', 1) || '/' || split_part(imp, '/', 2) ELSE split_part(imp, '/', 1) END AS pkg FROM im WHERE imp NOT LIKE '.%'), dc AS (SELECT pkg AS dep FROM pk GROUP BY 1 HAVING count(DISTINCT repo) >= 2)"


def _packages(g: Graph) -> tuple[DataFrame, DataFrame]:
    from graphloom.functions.imports import package

    i = g.files("imports").select(F.substring_index("path", "/", 1).alias("repo"), F.explode("imports").alias("imp")).where(~F.col("imp").startswith("."))
    p = i.select("repo", package(F.col("imp")).alias("pkg")).where("pkg IS NOT NULL").distinct()
    return p, p.groupBy(F.col("pkg").alias("dep")).agg(F.countDistinct("repo").alias("n")).where("n >= 2").select("dep", F.lit(False).alias("dev"))


_UNLISTED = _USED + ", ul AS (SELECT DISTINCT pk.pkg FROM pk WHERE NOT EXISTS (SELECT 1 FROM dc WHERE dc.dep = pk.pkg OR starts_with(pk.pkg, dc.dep || '/') OR (contains(dc.dep, '/') AND contains(pk.pkg, split_part(dc.dep, '/', 2)))))"


@query("join16_unlisted_in_tables", sql(_UNLISTED + " SELECT pkg FROM ul"))
def unlisted_in_tables(g: Graph) -> DataFrame:
    """Packages of a single repository that no shared one covers."""
    p, d = _packages(g)
    return D.unlisted(d, p)


@query("agg22_health_score", _values("project, cycles, unused, unlisted, score", ("fw", 0, 1, 1, 92), ("web", 1, 1, 3, 67)))
def health(g: Graph) -> DataFrame:
    """100 less 15 for each import cycle, 3 for each unused and 5 for each unlisted dependency, of each project."""
    from graphloom.operators import scan

    f = X.files(g.spark, "^(web|fw)/")
    made = scan.graph(f.select("path", P.language(F.col("path")).alias("language"), "text").where("language IS NOT NULL"))
    at = made["symbols"].select("id", "file_path")
    e = made["edges"].where("kind = 'imports'").join(at.select(F.col("id").alias("src"), F.col("file_path").alias("a")), "src").join(at.select(F.col("id").alias("dst"), F.col("file_path").alias("b")), "dst").where("a <> b").select("a", "b")
    found = cut(O.shortest_cycles(e), "cycles")
    out = None
    for project in ("web", "fw"):
        declared, imported = S.manifests(X.files(g.spark, f"^{project}/")), _imported(g, f"^{project}/")
        own = found.where(F.col("chain")[0].startswith(f"{project}/"))
        part = D.health(own, D.unused(declared, imported), D.unlisted(declared, imported)).select(F.lit(project).alias("project"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "cmp23_dependency_health",
    sql(CYCLES_SQL + ", " + _UNLISTED + ", x AS (SELECT (SELECT count(*) FROM cyc) AS cycles, 0::BIGINT AS unused, (SELECT count(*) FROM ul) AS unlisted) SELECT cycles, unused, unlisted, greatest(0, least(100, 100 - 15 * cycles - 3 * unused - 5 * unlisted))::BIGINT AS score FROM x", recursive=True),
)
def dependency_health(g: Graph) -> DataFrame:
    """Health of the tables' graph: import cycles of any length, declared packages that nothing imports (none, as they
    are derived from imports) and packages that no declaration covers."""
    p, d = _packages(g)
    return D.health(O.shortest_cycles(file_imports(g)), D.unused(d, p), D.unlisted(d, p))


@query("join07_project_imports", _values("path, spec, target", ("web/src/app.ts", "./b", "web/src/b.ts"), ("web/src/b.ts", "./c", "web/src/c.ts"), ("web/src/c.ts", "./d", "web/src/d.ts"), ("web/src/d.ts", "./b", "web/src/b.ts"), ("fw/src/main.cpp", "audio.h", "fw/lib/audio.h")))
def project_imports(g: Graph) -> DataFrame:
    """Imports as parsed from files, bound to files: relative ones by endings, include lines by their last part."""
    f = X.files(g.spark)
    specs = P.parse_files(f.select("path", P.language(F.col("path")).alias("language"), "text").where("language IS NOT NULL")).select("path", F.explode("imports").alias("i")).select("path", F.col("i.source").alias("spec"))
    return P.resolve_imports(specs, f)


# --- firmware

_FW = r"^fw/src/"


@query("rul11_tasks", _values("path, family, task, function", ("fw/src/main.cpp", "freertos", "blink", "blink_task"), ("fw/src/irq.c", "zephyr", "worker", "worker")))
def tasks(g: Graph) -> DataFrame:
    return E.tasks(X.files(g.spark, _FW), "path", "text")


@query("rul11_handlers", _values("path, handler, source", ("fw/src/main.cpp", "on_edge", "ESP32"), ("fw/src/irq.c", "TIM2_IRQHandler", "STM32"), ("fw/src/irq.c", "TIMER1_OVF_vect", "Arduino")))
def handlers(g: Graph) -> DataFrame:
    return E.handlers(X.files(g.spark, _FW), "path", "text")


@query("rul11_memory", _values("path, setting, bytes", ("fw/src/main.cpp", "STACK_SIZE", 4096), ("fw/src/irq.c", "HEAP_SIZE", 8192)))
def memory(g: Graph) -> DataFrame:
    return E.memory(X.files(g.spark, _FW), "path", "text")


_PERIPHERALS = "n(p) AS (VALUES " + ", ".join(f"('{p}')" for p in E.PERIPHERALS) + "), u AS (SELECT s.id, s.language, n.p AS peripheral, CASE WHEN contains(source_code, p || '->CR') OR contains(source_code, p || '->DR') OR contains(source_code, p || '.write') OR contains(source_code, p || '.begin') THEN 'write' ELSE 'read' END AS access FROM sym s JOIN n ON contains(source_code, p || '->') OR contains(source_code, p || '_') OR contains(source_code, p || '.') OR contains(source_code, p || '::'))"


def _used(g: Graph) -> DataFrame:
    """(id, language, peripheral, access) over all current symbols; only what was found is shuffled."""
    t = g.heavy("symbols")
    found = E.peripherals(t.where("source_code IS NOT NULL").select(F.struct("id", "updated_at", "language").alias("k"), "source_code"), "k", "source_code")
    now = latest(t, "id", "updated_at", F.col("updated_at").alias("at"))
    rows = found.select("k.id", F.col("k.updated_at").alias("at"), "k.language", "peripheral", "access").distinct()
    return rows.join(now, (rows["id"] == now["id"]) & rows["at"].eqNullSafe(now["at"]), "left_semi")


@query("rul11_peripherals", sql(_PERIPHERALS + " SELECT id, peripheral, access FROM u"))
def peripherals(g: Graph) -> DataFrame:
    return _used(g).select("id", "peripheral", "access")


_GROUPS = "m(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in E.PERIPHERAL_GROUPS.items()) + ")"


@query("agg25_peripheral_groups", sql(_PERIPHERALS + ", " + _GROUPS + " SELECT language, string_agg(DISTINCT coalesce(m.b, peripheral), ',' ORDER BY coalesce(m.b, peripheral)) AS peripherals FROM u LEFT JOIN m ON m.a = lower(peripheral) GROUP BY 1"))
def peripheral_groups(g: Graph) -> DataFrame:
    """Peripherals in use under one name each, by language."""
    return _used(g).groupBy("language").agg(F.array_join(F.array_sort(F.collect_set(E.peripheral_group(F.col("peripheral")))), ",").alias("peripherals"))


# --- kernel and image


@query("join22_compatible_drivers", _values("node, driver", ("serial@1000", "foo"), ("spi@2000", "bar")))
def compatible(g: Graph) -> DataFrame:
    """Device-tree nodes and the drivers that name the same compatible string."""
    f = X.files(g.spark, "^kernel/")
    return L.matched(L.device_tree(f, "path", "text"), L.drivers(f, "path", "text"))


@query("rul13_findings", _values("finding, subject", ("node without driver", "ethernet@3000"), ("compatible without node", "acme,gone"), ("undefined option", "GHOST"), ("undefined select", "NOT_THERE"), ("undefined select", "REGMAP")))
def findings(g: Graph) -> DataFrame:
    """What doesn't fit together: nodes no driver serves, drivers' strings no node has, options nobody defines."""
    f = X.files(g.spark, "^kernel/")
    nodes, drv, opt = L.device_tree(f, "path", "text"), L.drivers(f, "path", "text"), L.kconfig(f, "path", "text")
    say = lambda df, what, c: df.select(F.lit(what).alias("finding"), F.col(c).alias("subject")).distinct()
    n = nodes.where(F.size("compatible") > 0)
    served = L.matched(nodes, drv).select("node")
    named = drv.select(F.explode("compatible").alias("c")).distinct().join(nodes.select(F.explode("compatible").alias("c")), "c", "left_anti")
    defined = opt.select("name").distinct()
    used = L.kbuild(f, "path", "text").where("config IS NOT NULL").select(F.regexp_replace("config", "^CONFIG_", "").alias("name"))
    return say(n.join(served, "node", "left_anti"), "node without driver", "node").unionByName(say(named, "compatible without node", "c")).unionByName(say(used.join(defined, "name", "left_anti"), "undefined option", "name")).unionByName(say(opt.select(F.explode("selects").alias("name")).join(defined, "name", "left_anti"), "undefined select", "name"))


@query("join23_select_integrity", _values("name, selects", ("BAR", "NOT_THERE"), ("FOO_DRIVER", "REGMAP")))
def selects(g: Graph) -> DataFrame:
    """Options that select one which no Kconfig defines."""
    opt = L.kconfig(X.files(g.spark, "^kernel/"), "path", "text")
    s = opt.select("name", F.explode("selects").alias("selects"))
    return s.join(opt.select(F.col("name").alias("selects")).distinct(), "selects", "left_anti").select("name", "selects")


@query("join24_config_overlay", _values("name, type, value", ("FOO_DRIVER", "tristate", "m"), ("FOO_CORE", "bool", "y"), ("BAR", "bool", "n")))
def overlay(g: Graph) -> DataFrame:
    """Kconfig options with what a configuration sets; what it lists as unset is n, what it doesn't list null."""
    f = X.files(g.spark, "^kernel/")
    c = f.where(F.col("path").rlike(r"(^|/)\.config$")).select(F.explode(F.split("text", "\n")).alias("l"))
    on = r"^CONFIG_(\w+)=\"?([^\"]*)\"?$"
    off = r"^# CONFIG_(\w+) is not set$"
    v = c.where(F.col("l").rlike(on)).select(F.regexp_extract("l", on, 1).alias("name"), F.regexp_extract("l", on, 2).alias("value")).unionByName(c.where(F.col("l").rlike(off)).select(F.regexp_extract("l", off, 1).alias("name"), F.lit("n").alias("value")))
    return L.kconfig(f, "path", "text").select("name", "type").join(v, "name", "left").select("name", "type", "value")


@query("agg21_drivers_by_bus", _values("bus, n", ("platform", 1), ("spi", 1)))
def by_bus(g: Graph) -> DataFrame:
    return L.drivers(X.files(g.spark, "^kernel/"), "path", "text").groupBy("bus").agg(F.count("*").alias("n"))


@query("rul12_image", _values("path, kind, name", ("image/foo.bb", "recipe", "Foo"), ("image/foo.service", "service", "/usr/bin/foo -x"), ("image/package/foo/Config.in", "option", "BR2_PACKAGE_FOO"), ("image/package/foo/foo.mk", "package", "FOO 1.2")))
def image(g: Graph) -> DataFrame:
    """Recipes, service units and packages of an image, with what names them."""
    f = X.files(g.spark, "^image/")
    r = L.recipes(f, "path", "text").select("path", F.lit("recipe").alias("kind"), F.col("summary").alias("name"))
    s = L.services(f, "path", "text").select("path", F.lit("service").alias("kind"), F.col("exec_start").alias("name"))
    o = L.kconfig(f, "path", "text").select("path", F.lit("option").alias("kind"), "name")
    b = L.buildroot(f, "path", "text").select("path", F.lit("package").alias("kind"), F.concat_ws(" ", "package", "version").alias("name"))
    return r.unionByName(s).unionByName(o).unionByName(b)


@query("rul14_build_config", _values("path, type, name, vendor", ("core/Cargo.toml", "cargo", "core", False), ("fw/CMakeLists.txt", "cmake", "firmware", False), ("fw/platformio.ini", "platformio", "esp32s3", True), ("image/foo.bb", "yocto", None, False), ("image/package/foo/Config.in", "buildroot", None, False), ("image/package/foo/foo.mk", "kbuild", None, False), ("kernel/drivers/foo/Makefile", "make", None, False)))
def build_config(g: Graph) -> DataFrame:
    return S.build_config(X.files(g.spark)).select("path", "type", "name", "vendor")


@query("src08_macros", _values("path, macro, name", ("inc/api.h", "API_EXPORT", "api_open"), ("inc/api.h", "API_EXPORT", "api_close")))
def macros(g: Graph) -> DataFrame:
    return P.macro_declarations(X.files(g.spark))


# --- traces


def _traces(g: Graph) -> tuple[DataFrame, DataFrame]:
    f = X.files(g.spark, "^trace/")
    return S.json_files(f.where("path LIKE '%trace.json'"), S.TRACE), S.json_files(f.where("path LIKE '%/state.json'"), S.RUN)


@query("src17_trace_steps", _values("trace, step, upstream, downstream", ("t1", "fetch", "", "parse"), ("t1", "parse", "fetch", "index,lint"), ("t1", "index", "parse", "report"), ("t1", "lint", "parse", "report"), ("t1", "report", "index,lint", "")))
def trace_steps(g: Graph) -> DataFrame:
    """Steps with what they follow and what follows them (JOIN21); files that are no JSON are skipped."""
    return S.trace_steps(_traces(g)[0]).select("trace", "step", F.array_join("upstream", ",").alias("upstream"), F.array_join("downstream", ",").alias("downstream"))


@query("src17_replies", _values("run, step, author", ("run_2", "fetch", "ann")))
def replies(g: Graph) -> DataFrame:
    f = X.files(g.spark, "/replies/")
    return S.json_files(f, S.REPLY).select(F.regexp_extract("path", r"/runs/([^/]+)/", 1).alias("run"), "step", "author")


@query("agg19_run_status", _values("run, kind, n, share", ("run_1", "done", 3, 0.6), ("run_1", "error", 1, 0.2), ("run_1", "waiting", 1, 0.2), ("run_2", "error", 1, 0.2), ("run_2", "running", 1, 0.2), ("run_2", "waiting", 3, 0.6)))
def run_status(g: Graph) -> DataFrame:
    return S.run_status(_traces(g)[1])


@query("agg20_hot_steps", _values("trace, step, dependents, chain", ("t1", "parse", 2, "parse > index > report")))
def hot_steps(g: Graph) -> DataFrame:
    return S.hot_steps(_traces(g)[0]).select("trace", "step", "dependents", F.array_join("chain", " > ").alias("chain"))


@query("rul15_failures", _values("run, step, message, upstream, advice", ("run_1", "index", "disk full", "parse", "Check step logic and dependencies"), ("run_2", "fetch", "no network", "", "Check input data and step configuration")))
def failures(g: Graph) -> DataFrame:
    t, r = _traces(g)
    return S.failure_advice(r, t)


@query("join20_step_symbols", sql(r"st(id, name) AS (VALUES ('fetch', 'fetch sources'), ('parse', 'parse code'), ('index', 'index'), ('lint', 'lint'), ('report', 'report')) SELECT s.id, bool_or(contains(lower(st.name), lower(s.name)) OR contains(lower(s.name), lower(st.id))) AS executed FROM sym s CROSS JOIN st WHERE s.name IS NOT NULL AND s.name <> '' GROUP BY 1"))
def step_symbols(g: Graph) -> DataFrame:
    """Which symbols a trace's steps stand for: a step's name contains the symbol's, or that the step's id."""
    from graphloom.operators.relations import substring_links

    steps = S.trace_steps(_traces(g)[0]).select(F.lower("step").alias("step"), F.lower("name").alias("said")).distinct()
    s = g.symbols("id", "name").where("name IS NOT NULL AND name <> ''").select("id", F.lower("name").alias("name"))
    names = s.select("name").distinct()
    one = substring_links(steps.select("said"), names, "said", "name").select("name")
    two = substring_links(names, steps.select("step").distinct(), "name", "step").select("name")
    return s.join(one.union(two).distinct().withColumn("hit", F.lit(True)), "name", "left").select("id", F.coalesce("hit", F.lit(False)).alias("executed"))


@query("cmp25_trace_view", _values("step, level, latest_status", ("fetch", 0, "error"), ("parse", 1, "waiting"), ("index", 2, "waiting"), ("lint", 2, "running"), ("report", 3, "waiting")))
def trace_view(g: Graph) -> DataFrame:
    """The flow of a trace by levels, with what the latest run says of each step."""
    t, r = _traces(g)
    e = S.trace_steps(t).select(F.explode("upstream").alias("a"), F.col("step").alias("b"))
    last = S.latest_run(r).select(F.explode("steps").alias("id", "s")).select("id", F.coalesce("s.status.kind", F.lit("waiting")).alias("latest_status"))
    return O.levels(e).join(last, "id", "left").select(F.col("id").alias("step"), "level", "latest_status")
