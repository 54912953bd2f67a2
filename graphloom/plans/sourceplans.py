"""Sources and parsers (SRC, RUL11 to RUL13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.model import Graph, sql
from graphloom.operators import linux as L
from graphloom.operators.versions import latest
from graphloom.plans.catalog import query
from graphloom import fixtures as X
from graphloom.sources import documents as D
from graphloom.sources import files as S
from graphloom.storage import scratch

ROW = T.StructType([T.StructField(x, T.StringType()) for x in ("id", "name")])


@query("src04_changes", "WITH r AS (SELECT path, hash, parsed_at, row_number() OVER (PARTITION BY path ORDER BY parsed_at DESC NULLS LAST) AS rn FROM (SELECT DISTINCT path, hash, parsed_at FROM files)), n AS (SELECT path, hash FROM r WHERE rn = 1), o AS (SELECT path, hash FROM r WHERE rn = 2) SELECT n.path, CASE WHEN o.path IS NULL THEN 'new' WHEN o.hash = n.hash THEN 'same' ELSE 'changed' END AS status FROM n LEFT JOIN o ON o.path = n.path")
def changed(g: Graph) -> DataFrame:
    """The current version of each file against the one before."""
    v = g.table("files").select("path", "hash", "parsed_at").distinct()
    now = latest(v, "path", "parsed_at", "hash", F.col("parsed_at").alias("at"))
    old = v.join(now.select("path", "at"), "path").where("parsed_at < at")
    return S.changes(latest(old, "path", "parsed_at", "hash"), now)


@query("src05_large_directories", sql("p AS (SELECT array_to_string(list_slice(string_split(path, '/'), 1, 2), '/') AS dir, count(*) AS n FROM fil GROUP BY 1) SELECT dir, n FROM p WHERE n >= 5 AND n >= 0.01 * (SELECT count(*) FROM fil)"))
def directories(g: Graph, least: int = 5, share: float = 0.01) -> DataFrame:
    p = g.files("language").groupBy(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("dir")).agg(F.count("*").alias("n"))
    total = p.agg(F.sum("n").alias("all"))
    return p.join(F.broadcast(total), how="inner", on=F.lit(True)).where((F.col("n") >= least) & (F.col("n") >= share * F.col("all"))).select("dir", "n")


@query("src06_languages", "SELECT DISTINCT path, CASE regexp_extract(path, '(\\.[^./]*)$', 1) WHEN '.ts' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.py' THEN 'python' WHEN '.c' THEN 'c' WHEN '.cpp' THEN 'cpp' END AS lang FROM files")
def languages(g: Graph) -> DataFrame:
    return g.table("files").select("path").distinct().select("path", S.language(F.col("path")).alias("lang"))


@query("src07_parse_code")
def parsed(g: Graph) -> DataFrame:
    """All files parsed anew: how many of the table's classes, functions and methods the parser finds again by file and
    name, by language and kind. Code that breaks off isn't found."""
    made = S.parse(S.rebuilt(g.heavy("symbols"))).select("path", "name").distinct().withColumn("found", F.lit(True))
    has = F.coalesce(F.length("source_code") > 0, F.lit(False))
    s = latest(g.table("symbols"), "id", "updated_at", F.col("file_path").alias("path"), "name", "kind", "language", has.alias("has")).where(F.col("has") & F.col("kind").isin("class", "function", "method"))
    return s.join(made, ["path", "name"], "left").groupBy("language", "kind").agg(F.count("*").alias("n"), F.count_if(F.coalesce("found", F.lit(False))).alias("found"))


_EXTENSIONS = " ".join(f"WHEN '{e}' THEN '{l}'" for e, l in S.LANGUAGES.items())


@query("src01_discover", X.sql(f"f AS (SELECT path, text, CASE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) {_EXTENSIONS} END AS language FROM fx WHERE NOT regexp_matches(path, '{S.SKIPPED}')) SELECT path, language, length(text) AS size, len(string_split(text, chr(10)))::INTEGER AS line_count, sha256(text) AS hash FROM f WHERE language IS NOT NULL"))
def discovered(g: Graph) -> DataFrame:
    """Source files of a folder with their facts (SRC01 to SRC03): the sample project written out and read."""
    folder = scratch(g.spark, "project")
    X.write(g.spark, folder)
    return S.discover(g.spark, folder).select("path", "language", "size", "line_count", "hash")


@query("src06_all_languages", "SELECT ext, language FROM (VALUES " + ", ".join(f"('{e}', '{l}')" for e, l in S.LANGUAGES.items()) + ", ('.md', NULL), ('', NULL)) AS t(ext, language)")
def all_languages(g: Graph) -> DataFrame:
    rows = g.spark.createDataFrame([(e,) for e in (*S.LANGUAGES, ".md", "")], "ext string")
    return rows.select("ext", S.language(F.concat(F.lit("a.b/c"), F.upper("ext"))).alias("language"))


@query("src12_symbols_by_layer", sql("SELECT id, layer, row_number() OVER (PARTITION BY layer ORDER BY file_path, start_line, id) AS place FROM sym WHERE layer IS NOT NULL"))
def by_layer(g: Graph) -> DataFrame:
    """The symbols of each layer by file and line; a layer may hold a third of all, so places come by ranges."""
    from pyspark.sql import Window as W

    from graphloom.operators.ordering import global_rank

    r = global_rank(g.symbols("layer", "file_path", "start_line").where("layer IS NOT NULL"), ["layer", F.asc_nulls_last("file_path"), F.asc_nulls_last("start_line"), "id"])
    first = r.groupBy("layer").agg(F.min("rank").alias("first"))
    return r.join(F.broadcast(first), "layer").select("id", "layer", (F.col("rank") - F.col("first") + 1).cast("long").alias("place"))


@query("src15_annotations_of_symbols", "WITH ann AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM annotations) WHERE rn = 1) SELECT symbol_id, id, row_number() OVER (PARTITION BY symbol_id ORDER BY created_at DESC NULLS LAST, id) AS place FROM ann")
def annotations_of(g: Graph) -> DataFrame:
    from pyspark.sql import Window as W

    a = latest(g.table("annotations"), "id", "updated_at", "symbol_id", "created_at")
    return a.select("symbol_id", "id", F.row_number().over(W.partitionBy("symbol_id").orderBy(F.desc_nulls_last("created_at"), "id")).cast("long").alias("place"))


@query("src18_snapshot", sql("SELECT 'there' AS snapshot, count(*) AS n FROM sym UNION ALL SELECT 'missing', 0"))
def snapshots(g: Graph) -> DataFrame:
    """A snapshot read back, and one that isn't there, which is empty."""
    from graphloom.sinks import writers

    path = scratch(g.spark, "snapshot") + "/graph.json"
    writers.save(g.symbols("id", "name"), path, form="json")
    n = lambda p, what: D.snapshot(g.spark, p, ROW).agg(F.lit(what).alias("snapshot"), F.count("*").alias("n"))
    return n(path, "there").unionByName(n(path + ".missing", "missing"))


@query("src19_team_data", "SELECT * FROM (VALUES ('a1', 's1', 'ann'), ('a2', 's2', 'bob')) AS t(id, symbol_id, user_id)")
def team_data(g: Graph) -> DataFrame:
    files = g.spark.createDataFrame([("team.json", '{"version": "1.0", "annotations": [{"id": "a1", "symbol_id": "s1", "user_id": "ann", "content": "x", "type": "note"}, {"id": "a2", "symbol_id": "s2", "user_id": "bob"}]}')], "path string, text string")
    return D.team_data(files).select("id", "symbol_id", "user_id")


@query("src11_symbols_by_file", sql("SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) AS place FROM sym"))
def by_file(g: Graph) -> DataFrame:
    from pyspark.sql import Window as W

    return g.symbols("id", "file_path", "start_line").select("id", "file_path", F.row_number().over(W.partitionBy("file_path").orderBy("start_line", "id")).cast("long").alias("place"))


@query("src13_edges_of_symbol", sql("t AS (SELECT min(id) AS id FROM sym WHERE kind = 'class') SELECT e.id, e.kind, CASE WHEN e.src = t.id THEN 'out' ELSE 'in' END AS side FROM edg e, t WHERE e.src = t.id OR e.dst = t.id"))
def edges_of(g: Graph) -> DataFrame:
    t = g.symbols("id", "kind").where("kind = 'class'").agg(F.min("id").alias("t"))
    e = g.edges().join(F.broadcast(t), (F.col("src") == F.col("t")) | (F.col("dst") == F.col("t")))
    return e.select("id", "kind", F.when(F.col("src") == F.col("t"), "out").otherwise("in").alias("side"))


@query("src16_metadata", "SELECT key, value FROM project_meta WHERE key LIKE 'knn.%'")
def metadata(g: Graph) -> DataFrame:
    return g.table("project_meta").where(F.col("key").startswith("knn.")).select("key", "value")


@query("src17_scan_log", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_kind = 'scan_log') SELECT regexp_extract(line, '^(\\d{4}-\\d{2}-\\d{2})T\\S+ (\\w+) \\[(\\w+)\\]', 2) AS level, regexp_extract(line, '^(\\d{4}-\\d{2}-\\d{2})T\\S+ (\\w+) \\[(\\w+)\\]', 1) AS day, count(*) AS n FROM l WHERE regexp_matches(line, '^\\d{4}-\\d{2}-\\d{2}T\\S+ \\w+ \\[\\w+\\]') GROUP BY 1, 2")
def scan_log(g: Graph) -> DataFrame:
    """Log lines parsed out of documents and counted by level and day."""
    p = r"^(\d{4}-\d{2}-\d{2})T\S+ (\w+) \[(\w+)\]"
    l = g.table("documents").where("doc_kind = 'scan_log'").select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(p))
    return l.groupBy(F.regexp_extract("line", p, 2).alias("level"), F.regexp_extract("line", p, 1).alias("day")).agg(F.count("*").alias("n"))


def _builds(g: Graph) -> DataFrame:
    return g.table("documents").where("doc_kind = 'build_file' AND text IS NOT NULL").select("doc_id", "text")


@query("rul12_kconfig", "WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^[ \\t]*(?:menu)?config[ \\t]+(\\w+)[ \\t]*\\r?\\n', 1)) AS name FROM documents WHERE doc_kind = 'build_file') SELECT doc_id, name, count(*) AS n FROM h GROUP BY 1, 2")
def kconfig(g: Graph) -> DataFrame:
    return L.kconfig(_builds(g), "doc_id", "text").groupBy("doc_id", "name").agg(F.count("*").alias("n"))


@query("rul12_kbuild", "WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^[ \\t]*obj-\\$\\((CONFIG_\\w+)\\)[ \\t]*\\+?=[ \\t]*[^\\n\\\\#]+', 1)) AS config FROM documents WHERE doc_kind = 'build_file') SELECT config, count(*) AS n FROM h GROUP BY 1")
def kbuild(g: Graph) -> DataFrame:
    return L.kbuild(_builds(g), "doc_id", "text").where("config IS NOT NULL").groupBy("config").agg(F.count("*").alias("n"))


@query("rul12_device_tree", "WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^&(\\w+) \\{[^{}]*\\}', 0)) AS t FROM documents WHERE doc_kind = 'build_file') SELECT doc_id, regexp_extract(t, '^&(\\w+)', 1) AS node, regexp_extract(t, 'status[ \\t]*=[ \\t]*\"([^\"]+)\"', 1) AS status, count(*) AS n FROM h WHERE contains(t, 'status') GROUP BY ALL")
def device_tree(g: Graph) -> DataFrame:
    n = L.device_tree(_builds(g), "doc_id", "text").where(F.col("node").rlike(r"^&\w+$") & F.col("label").isNull())
    return n.groupBy("doc_id", F.substring("node", 2, 1000).alias("node"), "status").agg(F.count("*").alias("n"))


@query("rul13_undefined_options", "WITH d AS (SELECT unnest(regexp_extract_all(text, '(?m)^[ \\t]*(?:menu)?config[ \\t]+(\\w+)[ \\t]*\\r?\\n', 1)) AS name FROM documents WHERE doc_kind = 'build_file'), u AS (SELECT unnest(regexp_extract_all(text, '(?m)^[ \\t]*obj-\\$\\(CONFIG_(\\w+)\\)[ \\t]*\\+?=[ \\t]*[^\\n\\\\#]+', 1)) AS name FROM documents WHERE doc_kind = 'build_file') SELECT name, count(*) AS n FROM u WHERE name NOT IN (SELECT name FROM d) GROUP BY 1")
def undefined_options(g: Graph) -> DataFrame:
    """Options that object lists hang on and no Kconfig defines."""
    b = _builds(g)
    used = L.kbuild(b, "doc_id", "text").where("config IS NOT NULL").groupBy(F.substring("config", 8, 1000).alias("name")).agg(F.count("*").alias("n"))
    return used.join(L.kconfig(b, "doc_id", "text").select("name").distinct(), "name", "left_anti")


@query("agg21_status_counts", "WITH h AS (SELECT unnest(regexp_extract_all(text, '(?m)^&(\\w+) \\{[^{}]*\\}', 0)) AS t FROM documents WHERE doc_kind = 'build_file') SELECT regexp_extract(t, 'status[ \\t]*=[ \\t]*\"([^\"]+)\"', 1) AS status, count(*) AS n FROM h WHERE contains(t, 'status') GROUP BY 1")
def status_counts(g: Graph) -> DataFrame:
    n = L.device_tree(_builds(g), "doc_id", "text").where(F.col("node").rlike(r"^&\w+$") & F.col("label").isNull())
    return n.groupBy("status").agg(F.count("*").alias("n"))


@query("rul11_embedded_signals", sql("SELECT id, len(regexp_extract_all(source_code, '\\b(malloc|calloc|realloc|kmalloc|kzalloc|devm_kzalloc|pvPortMalloc|heap_caps_malloc|alloca)\\s*\\(')) AS allocations FROM sym WHERE language IN ('c', 'cpp') AND regexp_matches(source_code, '\\b(malloc|calloc|realloc|kmalloc|kzalloc|devm_kzalloc|pvPortMalloc|heap_caps_malloc|alloca)\\s*\\(')"))
def embedded(g: Graph) -> DataFrame:
    code = F.when(F.col("language").isin("c", "cpp"), F.regexp_count("source_code", F.lit(L.MEMORY)).cast("long"))
    return latest(g.table("symbols"), "id", "updated_at", code.alias("allocations")).where("allocations > 0")
