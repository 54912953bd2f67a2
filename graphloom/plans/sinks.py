"""Sinks (SNK): what is written is read back, so the query shows the table as stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import signature
from graphloom.model import Graph, sql
from graphloom.operators.versions import latest
from graphloom.plans.catalog import query
from graphloom.sinks import writers as W
from graphloom.storage import scratch


@query("snk01_saved_graph", sql("SELECT layer, kind, count(*) AS n FROM sym GROUP BY 1, 2"))
def saved(g: Graph) -> DataFrame:
    """Symbols written by layer and read back; the read of a layer touches its directory only."""
    path = scratch(g.spark, "saved")
    W.save(g.symbols("id", "kind", "layer"), path, ("layer",))
    return g.spark.read.parquet(path).groupBy("layer", "kind").agg(F.count("*").alias("n"))


#: The stored table is each symbol as it was before its last scan, the rows to store are the current ones.
_OLD = """v AS (SELECT DISTINCT id, name, layer, complexity, dense_rank() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rk FROM symbols WHERE id IS NOT NULL),
o AS (SELECT id, name, layer, complexity FROM v WHERE rk = 2), n AS (SELECT id, name, layer, complexity FROM v WHERE rk = 1)"""


def _versions(g: Graph) -> tuple[DataFrame, DataFrame]:
    s = g.table("symbols").where("id IS NOT NULL").select("id", "name", "layer", "complexity", F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"))
    now = latest(s, "id", "at", "name", "layer", "complexity", F.col("at").alias("now"))
    old = latest(s.join(now.select("id", "now"), "id").where("at < now"), "id", "at", "name", "layer", "complexity")
    return old, now.drop("now")


@query("snk02_partial_upsert", "WITH " + _OLD + " SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NOT NULL THEN o.name ELSE n.name END AS name, CASE WHEN o.id IS NOT NULL THEN o.layer ELSE n.layer END AS layer, n.complexity FROM o FULL OUTER JOIN n ON n.id = o.id")
def partial(g: Graph) -> DataFrame:
    return W.upsert(*_versions(g), "id", ["complexity"])


@query("snk03_insert_or_ignore", "WITH " + _OLD + " SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)")
def ignore(g: Graph) -> DataFrame:
    return W.insert_new(*_versions(g), "id")


@query("snk05_replace", "WITH " + _OLD + " SELECT * FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n")
def replace(g: Graph) -> DataFrame:
    return W.upsert(*_versions(g), "id")


_A = "WITH ann AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM annotations) WHERE rn = 1)"
_GONE = "gone AS (SELECT id FROM sym WHERE file_path IN (SELECT path FROM fil WHERE language = 'python'))"


@query("snk06_delete_files", sql(_GONE + " SELECT id FROM edg WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)"))
def delete(g: Graph) -> DataFrame:
    files = g.files("language").where("language = 'python'")
    return W.delete_files(g.symbols("id", "file_path"), g.edges(), files)[1].select("id")


@query("snk12_graph_json", sql("SELECT kind, count(*) AS n, count(DISTINCT j) AS distinct_rows FROM (SELECT 'node' AS kind, to_json({'id': id, 'name': name}) AS j FROM sym UNION ALL SELECT 'edge', to_json({'dst': dst, 'kind': kind, 'src': src}) FROM edg) GROUP BY 1"))
def graph_json(g: Graph) -> DataFrame:
    return W.graph_json(g.symbols("id", "name"), g.edges().select("src", "dst", "kind")).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("json").alias("distinct_rows"))


@query("snk12_mermaid", sql("n AS (SELECT id, name, kind FROM sym WHERE kind = 'class') SELECT 1 AS place, count(*) AS n FROM n UNION ALL SELECT 0, 1 UNION ALL SELECT 2, count(*) FROM edg WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) HAVING count(*) > 0"))
def chart(g: Graph) -> DataFrame:
    return W.mermaid(g.symbols("id", "name", "kind").where("kind = 'class'"), g.edges()).groupBy("place").agg(F.count("*").alias("n"))


@query("snk14_notes", sql("SELECT file_path AS path, '# ' || file_path || chr(10) || chr(10) || string_agg('- ' || name || ' (' || coalesce(kind, '?') || ') line ' || start_line, chr(10) ORDER BY (NOT coalesce(exported, false)), start_line, id) AS note FROM sym GROUP BY 1"))
def notes(g: Graph) -> DataFrame:
    return W.notes(g.symbols("id", "name", "kind", "file_path", "start_line", "exported"))


@query("snk16_team_export", "SELECT a.user_id, count(*) AS n FROM (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM annotations) WHERE rn = 1) a WHERE a.symbol_id IN (SELECT id FROM symbols) GROUP BY 1")
def team(g: Graph) -> DataFrame:
    """Annotations whose symbol exists, by user."""
    from graphloom.plans.joins import annotations

    a = annotations(g, "symbol_id", "user_id")
    return a.join(g.table("symbols").select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


@query("snk06_deleted_counts", sql(_GONE + " SELECT (SELECT count(*) FROM gone) AS symbols, (SELECT count(*) FROM edg WHERE src IN (SELECT id FROM gone) OR dst IN (SELECT id FROM gone)) AS edges"))
def deleted(g: Graph) -> DataFrame:
    """How much goes with some files."""
    s, e = g.symbols("id", "file_path"), g.edges()
    left = W.delete_files(s, e, g.files("language").where("language = 'python'"))
    n = lambda df, c: df.agg(F.count("*").alias(c))
    row = n(s, "a").join(F.broadcast(n(left[0], "b")), on=F.lit(True), how="inner").join(F.broadcast(n(e, "c")), on=F.lit(True), how="inner").join(F.broadcast(n(left[1], "d")), on=F.lit(True), how="inner")
    return row.select((F.col("a") - F.col("b")).alias("symbols"), (F.col("c") - F.col("d")).alias("edges"))


@query("snk07_clear", sql("SELECT count(*) AS was, 0::BIGINT AS now, 2::BIGINT AS columns FROM sym"))
def clear(g: Graph) -> DataFrame:
    path = scratch(g.spark, "cleared")
    W.save(g.symbols("id", "kind"), path)
    was = W.clear(g.spark, path)
    t = g.spark.read.parquet(path)
    return t.agg(F.lit(was).cast("long").alias("was"), F.count("*").alias("now"), F.lit(len(t.columns)).cast("long").alias("columns"))


_LOGGED = _A + " SELECT id, symbol_id, user_id, content, type, (coalesce(resolved, false) OR coalesce(type = 'todo', false)) AS resolved FROM ann WHERE content <> ''"


@query("snk08_annotation_log", _LOGGED)
def annotation_log(g: Graph) -> DataFrame:
    """Annotations as a log of events: all are added, some updated, resolved (all of type todo) or deleted (those without
    content), and the log is appended batch by batch and read as it stands."""
    a = latest(g.table("annotations"), "id", "updated_at", "symbol_id", "user_id", "content", "type", "resolved", F.col("updated_at").alias("at"))
    cols = lambda df, action, later: df.select("id", "symbol_id", "user_id", "content", "type", F.lit(action).alias("action"), (F.coalesce("at", F.lit("2024-01-01").cast("timestamp_ntz")) + F.expr(f"INTERVAL {later} SECONDS")).alias("at"))
    path = scratch(g.spark, "annotation-log")
    cols(a.withColumn("content", F.concat(F.lit("draft: "), "content")), "add", 0).write.parquet(path)
    cols(a, "update", 1).write.mode("append").parquet(path)
    cols(a.where("coalesce(resolved, false) OR type = 'todo'"), "resolve", 2).write.mode("append").parquet(path)
    cols(a.where("content = '' OR content IS NULL"), "delete", 3).write.mode("append").parquet(path)
    return W.annotation_view(g.spark.read.parquet(path))


@query("snk09_set_metadata", "SELECT key, value FROM project_meta WHERE key NOT IN ('last_scan', 'scanned_files') UNION ALL SELECT 'last_scan', '2025-01-01T00:00:00Z' UNION ALL SELECT 'scanned_files', (SELECT count(DISTINCT path) FROM files)::VARCHAR")
def set_metadata(g: Graph) -> DataFrame:
    n = g.table("files").select("path").distinct().count()
    path = scratch(g.spark, "meta")
    W.save(W.put_meta(g.table("project_meta"), {"last_scan": "2025-01-01T00:00:00Z", "scanned_files": str(n)}), path)
    return g.spark.read.parquet(path)


@query("snk10_persist_embeddings", sql("SELECT model, count(*) AS n, count(DISTINCT symbol_id) AS symbols, min(dim) AS dim FROM (SELECT id AS symbol_id, 'local-hash' AS model, 256::BIGINT AS dim FROM sym) GROUP BY 1"))
def persist(g: Graph) -> DataFrame:
    """Embeddings of all symbols written under the one model name, and the index read back."""
    from graphloom.operators.search import embed_texts

    path = scratch(g.spark, "embeddings")
    s = g.symbols("id", "name", "kind", "file_path").select(F.col("id").alias("symbol_id"), F.concat_ws(" ", "name", "kind", "file_path").alias("text"))
    W.save(embed_texts(s, "text").select("symbol_id", "embedding", F.lit("local-hash").alias("model")), path)
    return g.spark.read.parquet(path).groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("symbol_id").alias("symbols"), F.min(F.size("embedding")).cast("long").alias("dim"))


@query("snk11_baseline", sql("SELECT count(*) AS n, count(DISTINCT id) AS symbols, coalesce(sum(complexity), 0)::BIGINT AS complexity FROM sym"))
def baseline(g: Graph) -> DataFrame:
    """The graph saved as lines of JSON, to be compared with later."""
    path = scratch(g.spark, "baseline")
    W.save(g.symbols("id", "name", "complexity"), path, form="json")
    return g.spark.read.schema("id string, name string, complexity int").json(path).agg(F.count("*").alias("n"), F.countDistinct("id").alias("symbols"), F.coalesce(F.sum("complexity"), F.lit(0)).cast("long").alias("complexity"))


_CLASSES = "n AS (SELECT id, name, kind FROM sym WHERE kind = 'class')"


@query("snk12_csv", sql(_CLASSES + ", m AS (SELECT src, dst, kind FROM edg WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)) SELECT 0 AS place, 'id,name,kind' AS line UNION ALL SELECT 1, id || ',' || name || ',' || kind FROM n UNION ALL SELECT 2, 'src,dst,kind' UNION ALL SELECT 3, src || ',' || dst || ',' || kind FROM m"))
def graph_csv(g: Graph) -> DataFrame:
    from graphloom.operators.relations import induced

    n = g.symbols("id", "name", "kind").where("kind = 'class'").select("id", "name", "kind")
    return W.graph_csv(n, induced(g.edges(), n).select("src", "dst", "kind"))


@query("snk12_matrix", sql(_CLASSES + """, p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM n) SELECT a.place AS "row", b.place AS "column", count(*) AS n FROM edg e JOIN p a ON a.id = e.src JOIN p b ON b.id = e.dst GROUP BY 1, 2"""))
def matrix(g: Graph) -> DataFrame:
    return W.adjacency(g.symbols("id", "kind").where("kind = 'class'"), g.edges())


@query("snk12_stats", sql("SELECT 'layer' AS what, coalesce(layer, 'unknown') AS value, count(*) AS n FROM sym GROUP BY 1, 2 UNION ALL SELECT 'kind', coalesce(kind, 'unknown'), count(*) FROM sym GROUP BY 1, 2 UNION ALL SELECT 'edge', kind, count(*) FROM edg GROUP BY 1, 2"))
def graph_stats(g: Graph) -> DataFrame:
    s = g.symbols("layer", "kind")
    by = lambda df, what, c: df.groupBy(F.lit(what).alias("what"), F.coalesce(c, F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    return by(s, "layer", "layer").unionByName(by(s, "kind", "kind")).unionByName(by(g.edges(), "edge", "kind"))


@query("snk13_html", sql("SELECT place, layer, count(*) AS lines FROM (SELECT 0 AS place, '' AS layer UNION ALL SELECT 2, '' UNION ALL SELECT 1, layer FROM (SELECT DISTINCT coalesce(layer, 'unknown') AS layer FROM sym) UNION ALL SELECT 1, coalesce(layer, 'unknown') FROM sym) GROUP BY 1, 2"))
def html(g: Graph) -> DataFrame:
    return W.html_page(g.symbols("id", "name", "kind", "layer")).groupBy("place", "layer").agg(F.count("*").alias("lines"))


@query("snk14_directories", sql("""d AS (SELECT file_path, coalesce(layer, 'unknown') AS layer, unnest(list_transform(range(1, len(string_split(file_path, '/'))), lambda i: array_to_string(string_split(file_path, '/')[1:i], '/'))) AS dir FROM sym WHERE file_path IS NOT NULL),
c AS (SELECT dir, layer, count(*) AS n FROM d GROUP BY 1, 2), l AS (SELECT dir, string_agg('- ' || layer || ': ' || n, chr(10) ORDER BY '- ' || layer || ': ' || n) AS t FROM c GROUP BY 1), f AS (SELECT dir, count(DISTINCT file_path) AS files, count(*) AS symbols FROM d GROUP BY 1)
SELECT f.dir, '# ' || f.dir || chr(10) || chr(10) || files || ' files, ' || symbols || ' symbols' || chr(10) || t AS note FROM f JOIN l ON l.dir = f.dir"""))
def directories(g: Graph) -> DataFrame:
    return W.directory_notes(g.symbols("id", "file_path", "layer"))


@query("snk15_skeleton", sql("SELECT file_path AS path, count(DISTINCT kind) AS sections, count(*) AS entries FROM sym WHERE file_path IS NOT NULL AND kind IN ('class', 'interface', 'function', 'method', 'type', 'enum', 'constant', 'variable') GROUP BY 1"))
def skeleton(g: Graph) -> DataFrame:
    about = F.when(F.length(F.trim("doc_comment")) > 0, F.regexp_replace("doc_comment", "#", ""))
    n = latest(g.table("symbols"), "id", "updated_at", "name", "kind", "file_path", "start_line", F.regexp_replace(signature(F.col("source_code")), "#", "").alias("signature"), about.alias("about"))
    count = lambda p: F.size(F.regexp_extract_all("doc", F.lit(p), F.lit(0))).cast("long")
    return W.skeleton(n).select("path", count(r"(?m)^## (?:class|interface|function|method|type|enum|constant|variable)$").alias("sections"), count("(?m)^### ").alias("entries"))


@query("snk16_team_import", _A + ", h AS (SELECT * FROM ann WHERE user_id = (SELECT min(user_id) FROM ann)), c AS (SELECT * FROM ann WHERE user_id <> (SELECT min(user_id) FROM ann) AND symbol_id IN (SELECT id FROM symbols)) SELECT user_id, count(*) AS n FROM (SELECT user_id FROM h UNION ALL SELECT user_id FROM c) GROUP BY 1")
def team_import(g: Graph) -> DataFrame:
    """The annotations of one user as they are here, and those of the others as they come in from a team."""
    a = latest(g.table("annotations"), "id", "updated_at", "symbol_id", "user_id", "content", "type")
    one = F.broadcast(a.agg(F.min("user_id").alias("me")))
    both = a.join(one, how="inner", on=F.lit(True))
    return W.team_import(both.where("user_id = me"), both.where("user_id <> me"), g.table("symbols").select("id")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("snk17_weighted_graph", sql("n AS (SELECT id FROM sym WHERE layer = 'business'), w AS (SELECT dst AS id, count(*) AS n FROM edg WHERE kind = 'calls' AND src IN (SELECT id FROM n) GROUP BY 1) SELECT n.id, coalesce(w.n, 0) AS weight, (SELECT count(*) FROM edg WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)) AS edges FROM n LEFT JOIN w ON w.id = n.id"))
def weighted(g: Graph) -> DataFrame:
    """The induced graph of a layer with the weight of each node."""
    nodes, edges = W.weighted_graph(g.symbols("id", "layer").where("layer = 'business'"), g.edges())
    return nodes.join(F.broadcast(edges.agg(F.count("*").alias("edges"))), how="inner", on=F.lit(True)).select("id", "weight", "edges")
