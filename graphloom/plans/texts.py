"""Scalar functions over code, paths and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.model import Graph, sql
from graphloom.operators.versions import latest
from graphloom.plans.catalog import query


@query("fn01_paths", "SELECT path, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext, len(string_split(path, '/')) - 1 AS depth FROM (SELECT DISTINCT path FROM files)")
def paths(g: Graph) -> DataFrame:
    return g.table("files").select("path").distinct().select("path", S.basename(F.col("path")).alias("base"), S.dirname(F.col("path")).alias("dir"), S.extension(F.col("path")).alias("ext"), (F.size(F.split("path", "/")) - 1).cast("long").alias("depth"))


@query("fn02_slugs", "SELECT DISTINCT file_path, trim(regexp_replace(regexp_replace(regexp_replace(lower(file_path), '[/.]', '-', 'g'), '[^a-z0-9_-]', '', 'g'), '-+', '-', 'g'), '-') AS slug FROM symbols")
def slugs(g: Graph) -> DataFrame:
    return g.table("symbols").select("file_path").distinct().select("file_path", S.slug(F.col("file_path")).alias("slug"))


@query("fn03_ancestors", "SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS dir FROM (SELECT DISTINCT path, unnest(range(1, len(string_split(path, '/')))) AS n FROM files)")
def ancestors(g: Graph) -> DataFrame:
    return g.table("files").select("path").distinct().select(F.explode(S.ancestors(F.col("path"))).alias("dir")).distinct()


@query("fn04_token_estimate", sql("SELECT id, ceil(length(source_code) / 3.5)::BIGINT AS t35, ceil(length(source_code) / 4.0)::BIGINT AS t40 FROM sym WHERE source_code IS NOT NULL"))
def token_estimate(g: Graph) -> DataFrame:
    n = F.length("source_code")
    return latest(g.table("symbols"), "id", "updated_at", F.ceil(n / 3.5).alias("t35"), F.ceil(n / 4).alias("t40")).where("t35 IS NOT NULL")


@query("fn05_complexity", sql("""SELECT id, 1 + len(regexp_extract_all(source_code, '\\bif\\s*\\(')) + len(regexp_extract_all(source_code, '\\belse\\s+if\\b')) + len(regexp_extract_all(source_code, '\\bwhile\\s*\\(')) + len(regexp_extract_all(source_code, '\\bfor\\s*\\(')) + len(regexp_extract_all(source_code, '\\bcase\\b')) + len(regexp_extract_all(source_code, '\\bcatch\\s*\\(')) + len(regexp_extract_all(source_code, '\\bswitch\\s*\\(')) + len(regexp_extract_all(source_code, '&&')) + len(regexp_extract_all(source_code, '\\|\\|')) AS complexity FROM sym WHERE source_code IS NOT NULL"""))
def complexity(g: Graph) -> DataFrame:
    return latest(g.heavy("symbols"), "id", "updated_at", S.cyclomatic(F.col("source_code")).alias("complexity")).where("complexity IS NOT NULL")


@query("fn06_signature", sql("SELECT id, trim(list_filter(string_split(source_code, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '' AND NOT regexp_matches(x, '^\\s*(//|/?\\*|#|@|\"\"\")'))[1], ' ' || chr(9) || chr(13))[:120] AS signature FROM sym WHERE kind IN ('function', 'method') AND source_code IS NOT NULL"))
def signatures(g: Graph) -> DataFrame:
    s = F.when(F.col("kind").isin("function", "method") & F.col("source_code").isNotNull(), F.struct(S.signature(F.col("source_code")).alias("x")))
    return latest(g.table("symbols"), "id", "updated_at", s.alias("s")).where("s IS NOT NULL").select("id", F.col("s.x").alias("signature"))


@query("fn07_parameters", sql("SELECT id, len(list_filter(string_split(regexp_extract(source_code, '\\(([^)]+)\\)', 1), ','), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '')) AS n FROM sym WHERE kind IN ('function', 'method') AND source_code IS NOT NULL"))
def parameters(g: Graph) -> DataFrame:
    n = F.when(F.col("kind").isin("function", "method"), S.parameter_count(F.col("source_code")))
    return latest(g.table("symbols"), "id", "updated_at", n.cast("long").alias("n")).where("n IS NOT NULL")


@query("fn08_content_hash", "SELECT doc_id, sha256(text) AS sha, strlen(text) AS bytes, len(string_split(text, chr(10))) AS lines FROM documents WHERE text IS NOT NULL AND text NOT LIKE '%' || chr(0) || '%'")
def content_hash(g: Graph) -> DataFrame:
    return g.table("documents").where(F.col("text").isNotNull() & ~F.col("text").contains("\0")).select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("bytes"), (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long").alias("lines"))


@query("fn09_event_json", "SELECT event_id, (props->>'k')::BIGINT AS k, date_trunc('day', ts) AS day, dayofweek(ts) AS dow FROM events")
def event_json(g: Graph) -> DataFrame:
    return g.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), (F.dayofweek("ts") - 1).cast("long").alias("dow"))


@query("fn10_js_round", "SELECT s_suppkey, floor(s_acctbal + 0.5)::BIGINT AS r FROM supplier")
def js_round(g: Graph) -> DataFrame:
    return g.table("supplier").select("s_suppkey", F.floor(F.col("s_acctbal") + 0.5).alias("r"))


@query("fn11_identifiers", sql("SELECT id, array_to_string(list_transform(list_filter(string_split(regexp_replace(replace(name, '_', ' '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' '), lambda w: w <> ''), lambda w: lower(w)), ' ') AS words FROM sym"))
def identifiers(g: Graph) -> DataFrame:
    return g.symbols("id", "name").select("id", S.identifier_words(F.col("name")).alias("words"))
