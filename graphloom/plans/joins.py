"""Joins, set operations and filters over the graph (JOIN, SET, FLT, SRC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph, sql
from graphloom.operators import relations as R
from graphloom.operators.coverage import TEST_FILES, TEST_PATH, test_counts
from graphloom.operators.versions import latest
from graphloom.plans.catalog import query
from graphloom.sources.files import PROBES, resolve_imports
from graphloom.storage import cut


@query("join01_callers", sql("SELECT e.dst AS id, s.id AS caller_id, s.name AS caller_name, s.kind AS caller_kind FROM edg e JOIN sym s ON s.id = e.src WHERE e.kind = 'calls'"))
def callers(g: Graph) -> DataFrame:
    return R.callers(g.edges("calls"), g.symbols("id", "name", "kind")).select("id", F.col("n_id").alias("caller_id"), F.col("n_name").alias("caller_name"), F.col("n_kind").alias("caller_kind"))


@query("join02_callees", sql("SELECT e.src AS id, s.id AS callee_id, s.name AS callee_name, s.layer AS callee_layer FROM edg e JOIN sym s ON s.id = e.dst WHERE e.kind = 'calls'"))
def callees(g: Graph) -> DataFrame:
    return R.callees(g.edges("calls"), g.symbols("id", "name", "layer")).select("id", F.col("n_id").alias("callee_id"), F.col("n_name").alias("callee_name"), F.col("n_layer").alias("callee_layer"))


@query("join03_induced_subgraph", sql("n AS (SELECT id FROM sym WHERE layer = 'business') SELECT e.id, e.src, e.dst, e.kind FROM edg e WHERE e.src IN (SELECT id FROM n) AND e.dst IN (SELECT id FROM n)"))
def induced(g: Graph) -> DataFrame:
    return R.induced(g.edges(), g.symbols("id", "layer").where("layer = 'business'")).select("id", "src", "dst", "kind")


@query("join04_layer_transitions", sql("SELECT a.layer AS src_layer, b.layer AS dst_layer, count(*) AS n FROM edg e JOIN sym a ON a.id = e.src JOIN sym b ON b.id = e.dst GROUP BY ALL"))
def transitions(g: Graph) -> DataFrame:
    return R.with_ends(g.edges(), g.symbols("id", "layer"), "layer").groupBy("src_layer", "dst_layer").agg(F.count("*").alias("n"))


@query("join05_target_names", sql("SELECT e.id, coalesce(s.name, e.dst) AS target, s.id IS NOT NULL AS resolved FROM edg e LEFT JOIN sym s ON s.id = e.dst"))
def targets(g: Graph) -> DataFrame:
    names = g.symbols("id", "name").select(F.col("id").alias("dst"), "name")
    return g.edges().join(names, "dst", "left").select("id", F.coalesce("name", "dst").alias("target"), F.col("name").isNotNull().alias("resolved"))


_NAMED = """u AS (SELECT e.id, e.dst AS name, s.file_path FROM edg e JOIN sym s ON s.id = e.src WHERE e.dst NOT IN (SELECT id FROM sym)),
c AS (SELECT u.id, t.id AS target_id, (t.file_path = u.file_path) AS is_local FROM u JOIN sym t ON t.name = u.name),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY is_local DESC, target_id) AS rn FROM c)
SELECT u.id, u.name, r.target_id, r.is_local FROM u LEFT JOIN r ON r.id = u.id AND r.rn = 1"""


@query("join06_resolve_names", sql(_NAMED))
def resolve_names(g: Graph) -> DataFrame:
    """Names no symbol id stands for: the symbol of that name in the same file, else the first one elsewhere.

    Candidates elsewhere are cut to the least id of each name before the join, so a name that a third of all symbols
    bear doesn't multiply the edges that use it.
    """
    s = g.symbols("id", "name", "file_path")
    e = g.edges().select("id", "src", "dst")
    e = e.join(s.select(F.col("id").alias("dst")), "dst", "left_anti")
    u = e.join(s.select(F.col("id").alias("src"), "file_path"), "src").select("id", F.col("dst").alias("name"), "file_path")
    local = s.groupBy("name", "file_path").agg(F.min("id").alias("local_id"))
    anywhere = s.groupBy("name").agg(F.min("id").alias("global_id"))
    hit = u.join(local, ["name", "file_path"], "left").join(anywhere, "name", "left")
    target = F.coalesce("local_id", "global_id")
    return hit.select("id", "name", target.alias("target_id"), F.when(target.isNotNull(), F.col("local_id").isNotNull()).alias("is_local"))


_RAW = r"""w AS (SELECT DISTINCT path, imp AS spec FROM (SELECT path, unnest(imports) AS imp FROM fil) WHERE imp IS NOT NULL)"""
_VALUES = ", ".join(f"({i}, '{x}')" for i, x in enumerate(PROBES))


def _specs(g: Graph) -> DataFrame:
    """(path, spec): what each file imports, as it says so."""
    return g.files("imports").select("path", F.explode("imports").alias("spec")).where("spec IS NOT NULL").distinct()


@query(
    "join07_import_paths",
    sql(_RAW + rf""", b AS (SELECT path, spec, regexp_replace(regexp_replace(regexp_replace(path, '[^/]*$', ''), '/$', '') || '/' || regexp_replace(spec, '^\./', ''), '\.(?:js|jsx|mjs)$', '') AS base FROM w WHERE starts_with(spec, './')), x(rank, ext) AS (VALUES {_VALUES}),
h AS (SELECT b.path, b.spec, f.path AS target, row_number() OVER (PARTITION BY b.path, b.spec ORDER BY x.rank) AS rn FROM b CROSS JOIN x JOIN fil f ON f.path = b.base || x.ext)
SELECT path, spec, target FROM h WHERE rn = 1 AND target <> path"""),
)
def import_paths(g: Graph) -> DataFrame:
    """Every relative import probed with each ending, alone and as an index file; the first probe that is a file counts."""
    return resolve_imports(_specs(g).where(F.col("spec").startswith(".")), g.files("language"))


@query(
    "join08_basename_imports",
    sql(_RAW + r""", i AS (SELECT path, spec, regexp_extract(spec, '([^/]+)$', 1) AS stem, split_part(path, '/', 1) AS repo, regexp_replace(path, '/?[^/]*$', '') AS dir FROM w WHERE NOT starts_with(spec, '.')),
n AS (SELECT regexp_extract(regexp_replace(path, '/(?:index|__init__|mod)\.[^./]*$', ''), '([^/]+?)(?:\.[^./]*)?$', 1) AS stem, split_part(path, '/', 1) AS repo, regexp_replace(path, '/?[^/]*$', '') AS dir, path AS target FROM fil),
a AS (SELECT stem, dir, min(target) AS near FROM n GROUP BY 1, 2), c AS (SELECT stem, repo, min(target) AS far FROM n GROUP BY 1, 2)
SELECT i.path, i.spec, coalesce(a.near, c.far) AS target FROM i LEFT JOIN a ON a.stem = i.stem AND a.dir = i.dir LEFT JOIN c ON c.stem = i.stem AND c.repo = i.repo WHERE coalesce(a.near, c.far) <> i.path"""),
)
def basenames(g: Graph) -> DataFrame:
    """Other imports matched on their last part alone, in the same directory or else the same repository."""
    return resolve_imports(_specs(g).where(~F.col("spec").startswith(".")), g.files("language"))


@query(
    "join09_exported_imports",
    sql("""i AS (SELECT e.id, e.src, t.name, t.id AS target_id FROM edg e JOIN sym t ON t.id = e.dst WHERE e.kind = 'imports' AND t.exported),
x AS (SELECT DISTINCT file_path, name FROM sym WHERE exported)
SELECT i.id, i.target_id FROM i JOIN sym s ON s.id = i.src JOIN x ON x.file_path = s.file_path AND x.name = i.name"""),
)
def exported_imports(g: Graph) -> DataFrame:
    s = g.symbols("id", "name", "file_path", "exported")
    t = s.where("exported").select(F.col("id").alias("dst"), F.col("name"))
    i = g.edges("imports").join(t, "dst").join(s.select(F.col("id").alias("src"), "file_path"), "src")
    return i.join(s.where("exported").select("file_path", "name").distinct(), ["file_path", "name"]).select("id", F.col("dst").alias("target_id"))


@query(
    "join10_file_pair_edges",
    sql("""p AS (SELECT DISTINCT a.file_path AS src_file, b.file_path AS dst_file FROM edg e JOIN sym a ON a.id = e.src JOIN sym b ON b.id = e.dst WHERE e.kind = 'imports' AND a.file_path <> b.file_path),
f AS (SELECT file_path, arg_min(id, (start_line, id)) AS id FROM sym GROUP BY 1), x AS (SELECT file_path, arg_min(id, (start_line, id)) AS id FROM sym WHERE exported GROUP BY 1)
SELECT p.src_file, p.dst_file, f.id AS src, x.id AS dst FROM p JOIN f ON f.file_path = p.src_file JOIN x ON x.file_path = p.dst_file"""),
)
def file_pairs(g: Graph) -> DataFrame:
    """One edge for each pair of files: first symbol to first exported symbol, instead of all times all."""
    s = g.symbols("id", "file_path", "start_line", "exported")
    pairs = R.with_ends(g.edges("imports"), s.select("id", "file_path"), "file_path").where("src_file_path <> dst_file_path").select(F.col("src_file_path").alias("src_file"), F.col("dst_file_path").alias("dst_file")).distinct()
    first = lambda df, file, out: df.groupBy(F.col("file_path").alias(file)).agg(F.min_by("id", F.struct("start_line", "id")).alias(out))
    return pairs.join(first(s, "src_file", "src"), "src_file").join(first(s.where("exported"), "dst_file", "dst"), "dst_file").select("src_file", "dst_file", "src", "dst")


@query(
    "join11_enclosing_symbol",
    sql("""c AS (SELECT e.id, e.line, s.file_path FROM edg e JOIN sym s ON s.id = e.src WHERE e.line IS NOT NULL),
o AS (SELECT id, file_path, start_line, end_line FROM sym WHERE kind IN ('class', 'function', 'method')),
h AS (SELECT c.id, c.line, o.id AS interval_id, row_number() OVER (PARTITION BY c.id ORDER BY o.start_line, o.end_line DESC, o.id) AS rn FROM c JOIN o ON o.file_path = c.file_path AND c.line BETWEEN o.start_line AND o.end_line)
SELECT id, line, interval_id AS enclosing_id FROM h WHERE rn = 1"""),
)
def enclosing(g: Graph) -> DataFrame:
    s = g.symbols("id", "file_path", "start_line", "end_line", "kind")
    c = g.edges().where("line IS NOT NULL").join(s.select(F.col("id").alias("src"), "file_path"), "src").select("id", "line", "file_path")
    o = s.where(F.col("kind").isin("class", "function", "method"))
    return R.point_in_interval(c, o, "file_path", "line", "start_line", "end_line").select("id", "line", F.col("interval_id").alias("enclosing_id"))


@query(
    "join12_methods_by_range",
    sql("SELECT c.id AS class_id, m.id AS method_id FROM sym c JOIN sym m ON m.file_path = c.file_path AND m.start_line >= c.start_line AND m.end_line <= c.end_line WHERE c.kind = 'class' AND m.kind = 'method'"),
)
def methods_by_range(g: Graph) -> DataFrame:
    s = g.symbols("id", "file_path", "start_line", "end_line", "kind")
    return R.contained(s.where("kind = 'method'"), s.where("kind = 'class'"), "file_path", "start_line", "end_line").select(F.col("outer_id").alias("class_id"), F.col("inner_id").alias("method_id"))


@query(
    "join13_methods_by_parent",
    sql("SELECT c.id AS class_id, m.id AS method_id FROM sym m JOIN sym c ON c.file_path = m.file_path AND c.name = m.metadata['parent'] WHERE c.kind = 'class' AND m.kind = 'method'"),
)
def methods_by_parent(g: Graph) -> DataFrame:
    s = g.symbols("id", "file_path", "name", "kind", "metadata")
    m = s.where("kind = 'method'").select(F.col("id").alias("method_id"), "file_path", F.col("metadata")["parent"].alias("name"))
    return s.where("kind = 'class'").select(F.col("id").alias("class_id"), "file_path", "name").join(m, ["file_path", "name"]).select("class_id", "method_id")


@query("join14_never_called", sql("SELECT id, name, kind FROM sym WHERE id NOT IN (SELECT dst FROM edg WHERE kind = 'calls' AND src IN (SELECT id FROM sym)) AND kind NOT IN ('interface', 'type', 'namespace')"))
def never_called(g: Graph) -> DataFrame:
    s = g.symbols("id", "name", "kind")
    called = R.known_counts(g.edges("calls"), s, "dst", "src", "n").select("id")
    return s.where(~F.coalesce(F.col("kind"), F.lit("")).isin("interface", "type", "namespace") & F.col("kind").isNotNull()).join(called, "id", "left_anti").select("id", "name", "kind")


_PKG = """CASE WHEN imp LIKE '@%' THEN split_part(imp, '/', 1) || '/' || split_part(imp, '/', 2) ELSE split_part(imp, '/', 1) END"""


def _packages(g: Graph) -> DataFrame:
    """(path, pkg): the package of every import that isn't relative; scoped names keep their scope."""
    i = g.files("imports").select("path", F.explode("imports").alias("imp")).where(~F.col("imp").startswith("."))
    parts = F.split("imp", "/")
    scoped = F.concat(parts[0], F.lit("/"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    return i.select("path", F.when(F.col("imp").startswith("@"), scoped).otherwise(parts[0]).alias("pkg"))


_TESTS = r"""x AS (SELECT id, name, file_path FROM sym WHERE coalesce(exported, false) AND NOT regexp_matches(file_path, '{p}') AND length(name) > 0), t AS (SELECT id, name, file_path, source_code FROM sym WHERE regexp_matches(file_path, '{p}')),
r AS (SELECT x.id, t.file_path, NULL AS test_id FROM x JOIN (SELECT DISTINCT file_path FROM t) t ON contains(t.file_path, x.name || '.test.') OR contains(t.file_path, x.name || '.spec.') OR contains(t.file_path, 'test_' || x.name || '.') OR contains(t.file_path, x.name || '_test.')
UNION SELECT x.id, t.file_path, t.id FROM x JOIN t ON contains(lower(t.name), lower(x.name)) OR contains(t.source_code, x.name))""".replace("{p}", TEST_FILES)


def referenced(g: Graph, *more: Column) -> DataFrame:
    """Current symbols, written, with what ``test_counts`` asks for and ``more``; only tests have their code."""
    code = F.when(F.col("file_path").rlike(TEST_FILES), F.col("source_code")).alias("source_code")
    return cut(latest(g.table("symbols"), "id", "updated_at", "name", "file_path", "exported", code, *more), "referenced")


def references(g: Graph) -> DataFrame:
    return test_counts(referenced(g))


@query("join17_test_references", sql(_TESTS + " SELECT id, count(DISTINCT test_id) AS tests, count(DISTINCT file_path) AS files FROM r GROUP BY 1"))
def tested(g: Graph) -> DataFrame:
    """Exported symbols that tests refer to, by file name, test name or code, with the numbers of tests and files."""
    return references(g)


#: The graph as it is and as it was: of each symbol the current row and the row before it, if there is one.
VERSIONS_SQL = """v AS (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rk FROM symbols WHERE id IS NOT NULL),
n AS (SELECT name, file_path, max(complexity) AS v FROM (SELECT DISTINCT id, name, file_path, complexity FROM v WHERE rk = 1) GROUP BY 1, 2),
o AS (SELECT name, file_path, max(complexity) AS v FROM (SELECT DISTINCT id, name, file_path, complexity FROM v WHERE rk = 2) GROUP BY 1, 2)"""


def snapshots(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(old, new) of (name, file_path, v): the complexity in the version before the current one, and in that. A symbol
    that was never scanned again is only in the new graph."""
    v = g.table("symbols").where("id IS NOT NULL").select("id", "name", "file_path", "complexity", F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at")).distinct()
    now = v.groupBy("id").agg(F.max("at").alias("now"))
    past = v.join(now, "id").where("at < now")
    was = past.groupBy("id").agg(F.max("at").alias("was"))
    by = lambda df: df.groupBy("name", "file_path").agg(F.max("complexity").alias("v"))
    return by(past.join(was, "id").where("at = was")), by(v.join(now, "id").where("at = now"))


@query(
    "join18_graph_diff",
    "WITH " + VERSIONS_SQL + """ SELECT coalesce(o.name, n.name) AS name, coalesce(o.file_path, n.file_path) AS file_path, o.v AS old_value, n.v AS new_value,
CASE WHEN o.file_path IS NULL AND o.name IS NULL THEN 'added' WHEN n.file_path IS NULL AND n.name IS NULL THEN 'removed' WHEN o.v IS NOT DISTINCT FROM n.v THEN 'same' ELSE 'changed' END AS status
FROM o FULL OUTER JOIN n ON o.name IS NOT DISTINCT FROM n.name AND o.file_path IS NOT DISTINCT FROM n.file_path""",
)
def graph_diff(g: Graph) -> DataFrame:
    """The graph before the last scan of each symbol against the one after it, on name and file."""
    return R.diff(*snapshots(g), ["name", "file_path"], "v")


@query("join19_moved_symbols", sql("""f AS (SELECT max(parsed_at) - INTERVAL 60 DAY AS at FROM fil), n AS (SELECT DISTINCT s.name, s.file_path FROM sym s JOIN fil ON fil.path = s.file_path, f WHERE fil.parsed_at >= f.at), o AS (SELECT DISTINCT s.name, s.file_path FROM sym s JOIN fil ON fil.path = s.file_path, f WHERE fil.parsed_at < f.at)
SELECT n.name, n.file_path, min(o.file_path) AS old_path FROM n JOIN o ON o.name = n.name WHERE n.file_path <> o.file_path GROUP BY 1, 2"""))
def moved(g: Graph) -> DataFrame:
    """Symbols of files parsed in the last sixty days that bear the name of one in files parsed before."""
    f = g.files("parsed_at")
    last = f.agg((F.max("parsed_at") - F.expr("INTERVAL 60 DAYS")).alias("at"))
    f = f.join(F.broadcast(last), how="inner", on=F.lit(True)).select(F.col("path").alias("file_path"), (F.col("parsed_at") >= F.col("at")).alias("recent"))
    s = g.symbols("name", "file_path").join(f, "file_path").select("name", "file_path", "recent").distinct()
    old = s.where("NOT recent").groupBy("name").agg(F.min("file_path").alias("old_path"))
    return s.where("recent").join(old, "name").where("file_path <> old_path").select("name", "file_path", "old_path")


@query("join20_names_in_paths", sql("a AS (SELECT DISTINCT file_path AS path FROM sym), b AS (SELECT DISTINCT name AS part FROM sym WHERE kind = 'module' AND length(name) >= 1) SELECT path, part FROM a JOIN b ON contains(a.path, b.part)"))
def names_in_paths(g: Graph) -> DataFrame:
    """A substring join of all paths with all module names, by the rarest n-gram of each name."""
    s = g.symbols("name", "kind", "file_path")
    paths = s.select(F.col("file_path").alias("path")).distinct()
    parts = s.where("kind = 'module'").select(F.col("name").alias("part")).distinct()
    return R.substring_links(paths, parts, "path", "part").select("path", "part").distinct()


@query("join21_reverse_dag", sql("SELECT s.name AS upstream, count(*) AS n, min(t.name) AS first_downstream FROM edg e JOIN sym s ON s.id = e.dst JOIN sym t ON t.id = e.src WHERE e.kind = 'extends' GROUP BY 1"))
def reverse_dag(g: Graph) -> DataFrame:
    return R.with_ends(g.edges("extends"), g.symbols("id", "name"), "name").groupBy(F.col("dst_name").alias("upstream")).agg(F.count("*").alias("n"), F.min("src_name").alias("first_downstream"))


@query(
    "join22_shared_imports",
    sql("i AS (SELECT DISTINCT path, unnest(imports) AS imp FROM fil), c AS (SELECT imp, count(*) AS n, min(path) AS first_path FROM i GROUP BY 1 HAVING count(*) >= 2) SELECT i.path, count(*) AS shared, sum(c.n - 1)::BIGINT AS links FROM i JOIN c USING (imp) GROUP BY 1"),
)
def shared_imports(g: Graph) -> DataFrame:
    """For each file how many of its imports others have too, and to how many other files these link it. The files of an
    import are a class with a count, so one that everybody uses makes no pairs."""
    i = g.files("imports").select("path", F.explode(F.array_distinct("imports")).alias("imp"))
    n = i.groupBy("imp").agg(F.count("*").alias("n")).where("n >= 2")
    return i.join(n, "imp").groupBy("path").agg(F.count("*").alias("shared"), F.sum(F.col("n") - 1).alias("links"))


@query("join23_dangling_targets", sql("SELECT dst, count(*) AS n FROM edg WHERE dst NOT IN (SELECT id FROM sym) GROUP BY 1"))
def dangling(g: Graph) -> DataFrame:
    counted = g.edges().groupBy("dst").agg(F.count("*").alias("n"))
    return counted.join(g.symbols("id").select(F.col("id").alias("dst")), "dst", "left_anti")


@query("join24_settings_overlay", sql("SELECT s.id, s.name, m.value FROM sym s LEFT JOIN project_meta m ON m.key = s.name WHERE s.kind = 'property'"))
def overlay(g: Graph) -> DataFrame:
    meta = g.table("project_meta").select(F.col("key").alias("name"), "value")
    return g.symbols("id", "name", "kind").where("kind = 'property'").join(meta, "name", "left").select("id", "name", "value")


_ANN = "ann AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM annotations) WHERE rn = 1)"


def annotations(g: Graph, *columns: str) -> DataFrame:
    from graphloom.operators.versions import latest

    return latest(g.table("annotations"), "id", "updated_at", *[F.col(c) for c in columns])


@query("join25_annotated_symbols", sql(_ANN + " SELECT s.id, s.name, count(*) AS notes, count(*) FILTER (WHERE NOT coalesce(a.resolved, false)) AS open_notes FROM ann a JOIN sym s ON s.id = a.symbol_id GROUP BY 1, 2"))
def annotated(g: Graph) -> DataFrame:
    a = annotations(g, "symbol_id", "resolved").groupBy(F.col("symbol_id").alias("id")).agg(F.count("*").alias("notes"), F.count_if(~F.coalesce("resolved", F.lit(False))).alias("open_notes"))
    return a.join(g.symbols("id", "name"), "id").select("id", "name", "notes", "open_notes")


KEYWORDS = ("handler", "service", "build", "parse", "cache")


@query("join26_keyword_votes", sql("k(kw) AS (VALUES ('handler'), ('service'), ('build'), ('parse'), ('cache')) SELECT s.id, count(*) AS votes FROM sym s JOIN k ON contains(lower(s.name), kw) OR contains(lower(s.doc_comment), kw) GROUP BY 1"))
def keyword_votes(g: Graph) -> DataFrame:
    s = g.symbols("id", "name", "doc_comment")
    vote = lambda k: F.when(F.lower("name").contains(k) | F.coalesce(F.lower("doc_comment").contains(k), F.lit(False)), 1).otherwise(0)
    return s.select("id", sum((vote(k) for k in KEYWORDS), F.lit(0)).cast("long").alias("votes")).where("votes > 0")


FORBIDDEN = (("data", "interface"), ("utility", "business"), ("utility", "interface"))


@query("join27_forbidden_calls", sql("r(f, t) AS (VALUES ('data', 'interface'), ('utility', 'business'), ('utility', 'interface')) SELECT e.id, a.layer AS src_layer, b.layer AS dst_layer FROM edg e JOIN sym a ON a.id = e.src JOIN sym b ON b.id = e.dst JOIN r ON r.f = a.layer AND r.t = b.layer WHERE e.kind = 'calls'"))
def forbidden_calls(g: Graph) -> DataFrame:
    ends = R.with_ends(g.edges("calls"), g.symbols("id", "layer"), "layer")
    wrong = F.lit(False)
    for a, b in FORBIDDEN:
        wrong = wrong | ((F.col("src_layer") == a) & (F.col("dst_layer") == b))
    return ends.where(wrong).select("id", "src_layer", "dst_layer")


# --- set operations


@query("set01_union_terms", sql("SELECT id FROM sym WHERE name ILIKE '%handler%' UNION SELECT id FROM sym WHERE name ILIKE '%parse%'"))
def union_terms(g: Graph) -> DataFrame:
    s = g.symbols("id", "name")
    return s.where(F.col("name").ilike("%handler%")).select("id").union(s.where(F.col("name").ilike("%parse%")).select("id")).distinct()


@query("set02_functions_and_methods", sql("SELECT id, kind FROM sym WHERE kind = 'function' UNION ALL SELECT id, kind FROM sym WHERE kind = 'method'"))
def functions_and_methods(g: Graph) -> DataFrame:
    return g.symbols("id", "kind").where(F.col("kind").isin("function", "method")).select("id", "kind")


@query("set03_both_directions", sql("SELECT src AS a, dst AS b FROM edg WHERE kind = 'calls' UNION SELECT dst AS a, src AS b FROM edg WHERE kind = 'calls'"))
def both_directions(g: Graph) -> DataFrame:
    e = g.edges("calls")
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


@query("set04_except", sql("SELECT name FROM sym WHERE layer = 'data' EXCEPT SELECT name FROM sym WHERE layer = 'interface'"))
def except_names(g: Graph) -> DataFrame:
    s = g.symbols("name", "layer")
    return s.where("layer = 'data'").select("name").subtract(s.where("layer = 'interface'").select("name"))


@query("set05_array_except", sql("SELECT path, len(list_distinct(list_filter(imports, lambda x: NOT starts_with(x, '.')))) AS foreign_imports FROM fil WHERE imports IS NOT NULL"))
def array_except(g: Graph) -> DataFrame:
    local = F.filter("imports", lambda x: x.startswith("."))
    return g.files("imports").where("imports IS NOT NULL").select("path", F.size(F.array_except("imports", local)).cast("long").alias("foreign_imports"))


@query("set07_import_packages", sql(f"SELECT DISTINCT {_PKG} AS pkg FROM (SELECT unnest(imports) AS imp FROM fil) WHERE imp NOT LIKE '.%'"))
def import_packages(g: Graph) -> DataFrame:
    return _packages(g).select("pkg").distinct()


@query("set08_intersect", sql("SELECT name FROM sym WHERE layer = 'data' INTERSECT SELECT name FROM sym WHERE layer = 'business'"))
def intersect_names(g: Graph) -> DataFrame:
    s = g.symbols("name", "layer")
    return s.where("layer = 'data'").select("name").intersect(s.where("layer = 'business'").select("name"))


# --- filters


@query("flt01_symbol_view", sql("SELECT id, name, kind, file_path AS filePath, start_line AS startLine, coalesce(exported, false) AS exported, metadata['parent'] AS parentName FROM sym"))
def symbol_view(g: Graph) -> DataFrame:
    return g.symbols("id", "name", "kind", "file_path", "start_line", "exported", "metadata").select("id", "name", "kind", F.col("file_path").alias("filePath"), F.col("start_line").alias("startLine"), F.coalesce("exported", F.lit(False)).alias("exported"), F.col("metadata")["parent"].alias("parentName"))


@query("flt02_like_search", sql("SELECT id, name FROM sym WHERE name ILIKE '%layer%' OR doc_comment ILIKE '%layer%'"))
def like_search(g: Graph) -> DataFrame:
    return g.symbols("id", "name", "doc_comment").where(F.col("name").ilike("%layer%") | F.col("doc_comment").ilike("%layer%")).select("id", "name")


@query("flt03_kind_layer_file", sql("SELECT id FROM sym WHERE kind = 'function' AND layer = 'business' AND contains(file_path, 'src/services')"))
def kind_layer_file(g: Graph) -> DataFrame:
    return g.symbols("id", "kind", "layer", "file_path").where(F.col("file_path").contains("src/services")).where("kind = 'function' AND layer = 'business'").select("id")


@query("flt04_or_terms", sql("q(t) AS (SELECT unnest(string_split('handler|timer|queue', '|'))) SELECT s.id, count(*) AS terms FROM sym s JOIN q ON s.name ILIKE '%' || q.t || '%' GROUP BY 1"))
def or_terms(g: Graph, q: str = "handler|timer|queue") -> DataFrame:
    s = g.symbols("id", "name").withColumn("t", F.explode(F.split(F.lit(q), r"\|")))
    return s.where(F.lower("name").contains(F.lower("t"))).groupBy("id").agg(F.count("*").alias("terms"))


@query("flt05_fuzzy_fallback", sql("e AS (SELECT id FROM sym WHERE name = 'handlerx'), f AS (SELECT id FROM sym WHERE contains(lower(name), 'handler') OR contains(lower(file_path), 'handler')) SELECT id FROM e UNION ALL SELECT id FROM f WHERE NOT EXISTS (SELECT 1 FROM e)"))
def fuzzy_fallback(g: Graph) -> DataFrame:
    """An exact search, and where it finds nothing at all, a looser one; emptiness is decided inside the plan."""
    s = g.symbols("id", "name", "file_path")
    exact = s.where("name = 'handlerx'").select("id")
    any_exact = exact.agg(F.count("*").alias("n")).where("n > 0")
    loose = s.where(F.lower("name").contains("handler") | F.lower("file_path").contains("handler")).select("id")
    return exact.unionAll(loose.join(F.broadcast(any_exact.limit(1)), how="left_anti", on=F.lit(True)))


@query("flt08_test_paths", sql(f"SELECT path FROM fil WHERE regexp_matches(path, '{TEST_FILES}')"))
def test_paths(g: Graph) -> DataFrame:
    return g.files("language").where(F.col("path").rlike(TEST_FILES)).select("path")


#: Names and paths that are meant for use from outside.
API_NAMES = r"^create[A-Z]|^make[A-Z]|^build[A-Z]|^new[A-Z]|^get[A-Z]|^set[A-Z]|^is[A-Z]|^has[A-Z]|^to[A-Z]|^from[A-Z]|^on[A-Z]|^handle[A-Z]|^render[A-Z]|^connect[A-Z]|Factory$|Provider$|Handler$|Controller$|Service$|^main$|^init_|^setup_|^configure|^bootstrap|^app$|^server$|^router$|^middleware|^plugin|^define|^register|^mount|^listen|^start|^run$|^exports\.|^module\.exports"
API_PATHS = r"/index\.|/main\.|/app\.|/server\.|/api/|/routes/|/controllers/|/public/|/exports/"


@query("flt09_api_pattern", sql(f"SELECT id FROM sym WHERE regexp_matches(name, '{API_NAMES}') OR regexp_matches(file_path, '{API_PATHS}')"))
def api_pattern(g: Graph) -> DataFrame:
    return g.symbols("id", "name", "file_path").where(F.col("name").rlike(API_NAMES) | F.col("file_path").rlike(API_PATHS)).select("id")


@query("flt10_match_rules", sql("SELECT id, CASE WHEN layer = 'data' THEN 'layer' WHEN regexp_full_match(file_path, '.*/services/.*') THEN 'path' WHEN contains(name, 'Private') THEN 'name' END AS matched FROM sym WHERE layer = 'data' OR regexp_full_match(file_path, '.*/services/.*') OR contains(name, 'Private')"))
def match_rules(g: Graph) -> DataFrame:
    how = F.when(F.col("layer") == "data", "layer").when(F.col("file_path").rlike("^.*/services/.*$"), "path").when(F.col("name").contains("Private"), "name")
    return g.symbols("id", "layer", "file_path", "name").select("id", how.alias("matched")).where("matched IS NOT NULL")


@query("flt11_meaningful", sql("SELECT id FROM sym WHERE NOT (coalesce(complexity, 0) < 3 AND NOT coalesce(exported, false) AND coalesce(ai_summary, '') = '' AND coalesce(doc_comment, '') = '' AND coalesce(len(string_split(source_code, chr(10))), 0) < 5)"))
def meaningful(g: Graph) -> DataFrame:
    s = g.table("symbols")
    lines = F.coalesce(F.length("source_code") - F.length(F.translate("source_code", "\n", "")) + 1, F.lit(0))
    from graphloom.operators.versions import latest

    cur = latest(s, "id", "updated_at", "complexity", "exported", (F.coalesce("ai_summary", F.lit("")) == "").alias("no_summary"), (F.coalesce("doc_comment", F.lit("")) == "").alias("no_doc"), lines.alias("lines"))
    simple = (F.coalesce("complexity", F.lit(0)) < 3) & ~F.coalesce("exported", F.lit(False)) & F.col("no_summary") & F.col("no_doc") & (F.col("lines") < 5)
    return cur.where(~simple).select("id")


@query(
    "flt12_resolve_id",
    sql("""q(target) AS (SELECT DISTINCT replace(id, '/', '\\') FROM sym WHERE kind = 'class' UNION SELECT DISTINCT name FROM sym WHERE kind = 'module'),
c AS (SELECT q.target, s.id, CASE WHEN s.id = q.target THEN 0 ELSE 1 END AS p FROM q JOIN sym s ON s.id = replace(q.target, '\\', '/') UNION ALL SELECT q.target, s.id, 2 + CASE s.kind WHEN 'class' THEN 0 WHEN 'function' THEN 1 WHEN 'method' THEN 2 ELSE 3 END FROM q JOIN sym s ON s.name = q.target)
SELECT target, arg_min(id, (p, id)) AS id FROM c GROUP BY 1"""),
)
def resolve_id(g: Graph) -> DataFrame:
    """Targets given as id, as id with other slashes or as name; the best candidate by rank, then kind, then id."""
    s = g.symbols("id", "name", "kind")
    q = s.where("kind = 'class'").select(F.translate("id", "/", "\\").alias("target")).union(s.where("kind = 'module'").select("name")).distinct()
    rank = 2 + F.when(F.col("kind") == "class", 0).when(F.col("kind") == "function", 1).when(F.col("kind") == "method", 2).otherwise(3)
    by_id = q.withColumn("id", F.translate("target", "\\", "/")).join(s.select("id"), "id").select("target", "id", F.when(F.col("id") == F.col("target"), 0).otherwise(1).alias("p"))
    by_name = s.groupBy("name").agg(F.min(F.struct(rank.alias("p"), "id")).alias("b")).join(q.withColumnRenamed("target", "name"), "name").select(F.col("name").alias("target"), "b.id", "b.p")
    return by_id.unionByName(by_name).groupBy("target").agg(F.min_by("id", F.struct("p", "id")).alias("id"))


@query(
    "flt13_entry_points",
    sql("""m AS (SELECT * FROM sym WHERE regexp_matches(lower(name), 'main|index|app|server|bootstrap|start|run|handler') AND (exported OR kind IN ('function', 'module'))),
c AS (SELECT DISTINCT dst FROM edg WHERE kind = 'calls' AND src IN (SELECT id FROM sym)) SELECT m.id, m.name, (c.dst IS NULL) AS is_root FROM m LEFT JOIN c ON c.dst = m.id"""),
)
def entry_points(g: Graph) -> DataFrame:
    s = g.symbols("id", "name", "kind", "exported")
    m = s.where(F.lower("name").rlike("main|index|app|server|bootstrap|start|run|handler") & (F.coalesce("exported", F.lit(False)) | F.col("kind").isin("function", "module")))
    called = R.known_counts(g.edges("calls"), s, "dst", "src", "n").select("id", F.lit(True).alias("called"))
    return m.join(called, "id", "left").select("id", "name", F.col("called").isNull().alias("is_root"))
