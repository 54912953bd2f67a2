"""Aggregations, windows and ordered results (AGG, WIN, SRT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.model import Graph, sql
from graphloom.operators import relations as R
from graphloom.operators.ordering import global_rank
from graphloom.operators.versions import latest
from graphloom.plans.catalog import query
from graphloom.operators.coverage import TEST_FILES
from graphloom.plans.joins import _ANN, _TESTS, annotations, references

NL = "chr(10)"


def lines(code: str = "source_code") -> Column:
    """Number of lines; null for null code."""
    return (F.length(code) - F.length(F.translate(code, "\n", "")) + 1).cast("long")


@query("agg01_caller_counts", "SELECT dst AS id, count(*) AS callers FROM (SELECT id, min(dst) AS dst FROM edges WHERE kind = 'calls' GROUP BY id) GROUP BY 1")
def caller_counts(g: Graph) -> DataFrame:
    return R.counts(g.edges("calls"), "dst", "callers")


@query("agg02_callee_counts", "SELECT src AS id, count(*) AS callees FROM (SELECT id, min(src) AS src FROM edges WHERE kind = 'calls' GROUP BY id) GROUP BY 1")
def callee_counts(g: Graph) -> DataFrame:
    return R.counts(g.edges("calls"), "src", "callees")


@query("agg03_stats", sql("SELECT (SELECT count(*) FROM sym) AS symbols, (SELECT count(*) FROM edg) AS edges, (SELECT count(*) FROM fil) AS files, (SELECT count(DISTINCT language) FROM fil) AS languages"))
def stats(g: Graph) -> DataFrame:
    one = [g.table("symbols").agg(F.countDistinct("id").alias("symbols")), g.table("edges").agg(F.countDistinct("id").alias("edges")), g.files("language").agg(F.count("*").alias("files"), F.countDistinct("language").alias("languages"))]
    out = one[0]
    for x in one[1:]:
        out = out.join(F.broadcast(x), how="inner", on=F.lit(True))
    return out


@query("agg04_edges_by_kind", sql("SELECT kind, count(*) AS n FROM edg GROUP BY 1"))
def edges_by_kind(g: Graph) -> DataFrame:
    return g.edges().groupBy("kind").agg(F.count("*").alias("n"))


@query("agg05_annotation_counts", f"WITH {_ANN} SELECT symbol_id, count(*) AS n, count(*) FILTER (WHERE NOT resolved) AS unresolved FROM ann GROUP BY 1")
def annotation_counts(g: Graph) -> DataFrame:
    return annotations(g, "symbol_id", "resolved").groupBy("symbol_id").agg(F.count("*").alias("n"), F.count_if(~F.col("resolved")).alias("unresolved"))


@query("agg06_file_rollup", sql("SELECT file_path, count(*) AS symbols, count(DISTINCT kind) AS kinds, coalesce(max(complexity), 0) AS max_complexity, arg_min(name, (-coalesce(complexity, 0), id)) AS most_complex FROM sym GROUP BY 1"))
def file_rollup(g: Graph) -> DataFrame:
    s = g.symbols("id", "file_path", "kind", "complexity", "name")
    return s.groupBy("file_path").agg(F.count("*").alias("symbols"), F.countDistinct("kind").alias("kinds"), F.coalesce(F.max("complexity"), F.lit(0)).alias("max_complexity"), F.min_by("name", F.struct(-F.coalesce("complexity", F.lit(0)), "id")).alias("most_complex"))


@query("agg07_layer_share", sql("SELECT layer, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM sym), 4) AS percent FROM sym GROUP BY 1"))
def layer_share(g: Graph) -> DataFrame:
    c = g.symbols("layer").groupBy("layer").agg(F.count("*").alias("n"))
    return c.select("layer", "n", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(W.partitionBy()), 4).alias("percent"))


@query("agg08_top_modules", sql("SELECT array_to_string(list_slice(string_split(file_path, '/'), 1, 3), '/') AS module, count(*) AS n FROM sym GROUP BY 1 ORDER BY n DESC, module LIMIT 5"))
def top_modules(g: Graph) -> DataFrame:
    m = F.array_join(F.slice(F.split("file_path", "/"), 1, 3), "/")
    return g.symbols("file_path").groupBy(m.alias("module")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module").limit(5)


@query("agg09_grouping_sets", sql("SELECT kind, layer, language, grouping(kind) * 4 + grouping(layer) * 2 + grouping(language) AS level, count(*) AS n FROM sym GROUP BY GROUPING SETS ((kind), (layer), (language))"))
def histograms(g: Graph) -> DataFrame:
    """The three histograms in one pass."""
    s = g.symbols("kind", "layer", "language")
    k, l, n = F.col("kind"), F.col("layer"), F.col("language")
    return s.groupingSets([[k], [l], [n]], k, l, n).agg((F.grouping("kind") * 4 + F.grouping("layer") * 2 + F.grouping("language")).cast("long").alias("level"), F.count("*").alias("n"))


_DEG = """u AS (SELECT e.src, e.dst FROM edg e WHERE e.src IN (SELECT id FROM sym) AND e.dst IN (SELECT id FROM sym)),
b AS (SELECT src AS id, dst AS nb FROM u UNION SELECT dst, src FROM u), deg AS (SELECT s.id, count(b.nb) AS degree FROM sym s LEFT JOIN b ON b.id = s.id GROUP BY 1)"""


def degrees(g: Graph) -> DataFrame:
    """(id, degree): distinct neighbours in either direction among known symbols, 0 included."""
    s = g.symbols("id")
    u = R.induced(g.edges(), s)
    b = u.select(F.col("src").alias("id"), F.col("dst").alias("nb")).union(u.select("dst", "src")).distinct().groupBy("id").agg(F.count("*").alias("d"))
    return s.select("id").join(b, "id", "left").select("id", F.coalesce("d", F.lit(0)).cast("long").alias("degree"))


@query("agg10_degree_stats", sql(_DEG + " SELECT count(*) AS nodes, (SELECT count(*) FROM u) AS edges, round(avg(degree), 6) AS avg_degree, max(degree) AS max_degree, round((SELECT count(*) FROM u)::DOUBLE / (count(*) * (count(*) - 1)), 9) AS density FROM deg"))
def degree_stats(g: Graph) -> DataFrame:
    d = degrees(g).agg(F.count("*").alias("nodes"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.max("degree").alias("max_degree"))
    e = R.induced(g.edges(), g.symbols("id")).agg(F.count("*").alias("edges"))
    return d.join(F.broadcast(e), how="inner", on=F.lit(True)).select("nodes", "edges", "avg_degree", "max_degree", F.round(F.col("edges").cast("double") / (F.col("nodes") * (F.col("nodes") - 1)), 9).alias("density"))


@query("grf08_degree_histogram", sql(_DEG + " SELECT degree, count(*) AS n FROM deg GROUP BY 1"))
def degree_histogram(g: Graph) -> DataFrame:
    return degrees(g).groupBy("degree").agg(F.count("*").alias("n"))


@query("agg11_shotgun_surgery", sql("SELECT e.dst AS id, count(*) AS callers, count(DISTINCT s.file_path) AS files FROM edg e JOIN sym s ON s.id = e.src JOIN sym t ON t.id = e.dst WHERE e.kind = 'calls' GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT s.file_path) >= 4"))
def shotgun(g: Graph) -> DataFrame:
    s = g.symbols("id", "file_path")
    return R.callers(g.edges("calls"), s).join(s.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("callers"), F.countDistinct("n_file_path").alias("files")).where("callers >= 3 AND files >= 4")


@query(
    "agg12_feature_envy",
    sql("""c AS (SELECT f.id, f.file_path AS own, t.file_path AS file, t.kind FROM edg e JOIN sym f ON f.id = e.src JOIN sym t ON t.id = e.dst WHERE e.kind = 'calls' AND f.kind IN ('function', 'method')),
t AS (SELECT id, count(*) AS total FROM c GROUP BY 1), m AS (SELECT id, file, count(*) AS n FROM c WHERE kind = 'method' AND file <> own GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT m.id, arg_min(m.file, (-m.n, m.file)) AS file, max(m.n) AS external_calls, t.total FROM m JOIN t ON t.id = m.id WHERE t.total >= 3 GROUP BY m.id, t.total"""),
)
def feature_envy(g: Graph, least: int = 3) -> DataFrame:
    """Functions with ``least`` or more calls to methods of one other file and three callees in all; the most called file counts."""
    s = g.symbols("id", "file_path", "kind")
    c = R.with_ends(g.edges("calls"), s, "file_path", "kind").where(F.col("src_kind").isin("function", "method"))
    total = c.groupBy("src").agg(F.count("*").alias("total"))
    m = c.where("dst_kind = 'method' AND dst_file_path <> src_file_path").groupBy("src", F.col("dst_file_path").alias("file")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    best = m.groupBy("src").agg(F.min_by("file", F.struct(-F.col("n"), "file")).alias("file"), F.max("n").alias("external_calls"))
    return best.join(total, "src").where("total >= 3").select(F.col("src").alias("id"), "file", "external_calls", "total")


@query(
    "agg13_god_class",
    sql("""m AS (SELECT c.id, count(*) AS methods FROM sym c JOIN sym m ON m.file_path = c.file_path AND m.kind = 'method' AND m.start_line >= c.start_line AND m.end_line <= c.end_line WHERE c.kind = 'class' GROUP BY 1),
k AS (SELECT e.dst AS id, count(*) AS callers FROM edg e JOIN sym s ON s.id = e.src WHERE e.kind = 'calls' GROUP BY 1)
SELECT m.id, m.methods, coalesce(k.callers, 0) AS callers, CASE WHEN m.methods > 20 THEN 'error' ELSE 'warning' END AS severity FROM m LEFT JOIN k ON k.id = m.id WHERE m.methods > 15 OR (m.methods > 10 AND coalesce(k.callers, 0) > 8)"""),
)
def god_class(g: Graph, many: int = 15, some: int = 10, popular: int = 8, error: int = 20) -> DataFrame:
    """Classes with too many methods, or with many and many callers."""
    s = g.symbols("id", "file_path", "start_line", "end_line", "kind")
    m = R.contained(s.where("kind = 'method'"), s.where("kind = 'class'"), "file_path", "start_line", "end_line").groupBy(F.col("outer_id").alias("id")).agg(F.count("*").alias("methods"))
    k = R.known_counts(g.edges("calls"), s, "dst", "src", "callers")
    r = m.join(k, "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)).cast("long"))
    return r.where((F.col("methods") > many) | ((F.col("methods") > some) & (F.col("callers") > popular))).select("id", "methods", "callers", F.when(F.col("methods") > error, "error").otherwise("warning").alias("severity"))


@query(
    "agg13_god_class_low",
    sql("""m AS (SELECT c.id, count(*) AS methods FROM sym c JOIN sym m ON m.file_path = c.file_path AND m.kind = 'method' AND m.start_line >= c.start_line AND m.end_line <= c.end_line WHERE c.kind = 'class' GROUP BY 1),
k AS (SELECT e.dst AS id, count(*) AS callers FROM edg e JOIN sym s ON s.id = e.src WHERE e.kind = 'calls' GROUP BY 1)
SELECT m.id, m.methods, coalesce(k.callers, 0) AS callers, CASE WHEN m.methods > 4 THEN 'error' ELSE 'warning' END AS severity FROM m LEFT JOIN k ON k.id = m.id WHERE m.methods > 3 OR (m.methods > 2 AND coalesce(k.callers, 0) > 1)"""),
)
def god_class_low(g: Graph) -> DataFrame:
    """The same with limits that small code bases reach."""
    return god_class(g, 3, 2, 1, 4)


@query("agg14_high_coupling", sql("SELECT e.src AS id, count(*) AS callees FROM edg e JOIN sym t ON t.id = e.dst WHERE e.kind = 'calls' GROUP BY 1 HAVING count(*) > 10"))
def high_coupling(g: Graph, most: int = 10) -> DataFrame:
    return R.known_counts(g.edges("calls"), g.symbols("id"), "src", "dst", "callees").where(F.col("callees") > most)


@query(
    "agg15_guard_limits",
    sql("""k AS (SELECT e.dst AS id, count(*) AS n FROM edg e JOIN sym s ON s.id = e.src WHERE e.kind = 'calls' GROUP BY 1)
SELECT s.id, 'max-coupling' AS rule, k.n AS value FROM k JOIN sym s ON s.id = k.id WHERE k.n > 20 UNION ALL SELECT id, 'max-complexity', complexity::BIGINT FROM sym WHERE complexity > 50"""),
)
def guard_limits(g: Graph, callers: int = 20, complexity: int = 50) -> DataFrame:
    s = g.symbols("id", "complexity")
    many = R.known_counts(g.edges("calls"), s, "dst", "src", "n").where(F.col("n") > callers).join(s.select("id"), "id", "left_semi")
    return many.select("id", F.lit("max-coupling").alias("rule"), F.col("n").alias("value")).unionByName(s.where(F.col("complexity") > complexity).select("id", F.lit("max-complexity").alias("rule"), F.col("complexity").cast("long").alias("value")))


@query("agg17_coverage", sql(_TESTS + ", c AS (SELECT s.layer, s.kind, (s.id IN (SELECT id FROM r)) AS has FROM sym s JOIN x ON x.id = s.id) SELECT layer, kind, count(*) AS n, count(*) FILTER (WHERE has) AS covered, round(100.0 * count(*) FILTER (WHERE has) / count(*), 4) AS percent FROM c GROUP BY GROUPING SETS ((layer, kind), (layer), (kind), ())"))
def coverage(g: Graph) -> DataFrame:
    """Share of the exported symbols that tests refer to, by layer and kind, by each alone and in all."""
    hit = references(g).select("id", F.lit(True).alias("has"))
    s = g.symbols("name", "file_path", "exported", "layer", "kind")
    x = s.where(F.coalesce("exported", F.lit(False)) & ~F.coalesce(F.col("file_path").rlike(TEST_FILES), F.lit(False)) & F.col("file_path").isNotNull() & (F.length("name") > 0))
    c = x.join(hit, "id", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    l, k = F.col("layer"), F.col("kind")
    return c.groupingSets([[l, k], [l], [k], []], l, k).agg(F.count("*").alias("n"), F.count_if("has").alias("covered"), F.round(F.lit(100.0) * F.count_if("has") / F.count("*"), 4).alias("percent"))


@query(
    "agg18_batch_risk",
    sql("""k AS (SELECT dst AS id, count(*) AS n FROM edg WHERE kind = 'calls' GROUP BY 1),
r AS (SELECT s.id, s.complexity, CASE WHEN coalesce(k.n, 0) > 10 THEN 'critical' WHEN coalesce(k.n, 0) > 5 THEN 'high' WHEN coalesce(k.n, 0) > 2 THEN 'medium' ELSE 'low' END AS risk FROM sym s LEFT JOIN k ON k.id = s.id)
SELECT risk, count(*) AS n, round(avg(complexity), 6) AS avg_complexity FROM r GROUP BY 1"""),
)
def batch_risk(g: Graph) -> DataFrame:
    k = R.counts(g.edges("calls"), "dst", "n")
    n = F.coalesce("n", F.lit(0))
    r = g.symbols("id", "complexity").join(k, "id", "left").withColumn("risk", F.when(n > 10, "critical").when(n > 5, "high").when(n > 2, "medium").otherwise("low"))
    return r.groupBy("risk").agg(F.count("*").alias("n"), F.round(F.avg("complexity"), 6).alias("avg_complexity"))


@query("agg20_fan_in", sql("d AS (SELECT dst, count(DISTINCT src) AS dependents FROM edg WHERE kind IN ('extends', 'implements') GROUP BY 1 HAVING count(DISTINCT src) >= 2) SELECT dst AS id, dependents FROM d ORDER BY dependents DESC, dst LIMIT 5"))
def fan_in(g: Graph) -> DataFrame:
    return g.edges("extends", "implements").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("dependents")).where("dependents >= 2").orderBy(F.desc("dependents"), "id").limit(5)


@query("agg24_team_summary", f"WITH {_ANN} SELECT user_id, type, count(*) AS n, count(*) FILTER (WHERE NOT coalesce(resolved, false)) AS unresolved FROM ann GROUP BY ROLLUP (user_id, type)")
def team_summary(g: Graph) -> DataFrame:
    return annotations(g, "user_id", "type", "resolved").rollup("user_id", "type").agg(F.count("*").alias("n"), F.count_if(~F.coalesce("resolved", F.lit(False))).alias("unresolved"))


@query("agg26_cube", sql("SELECT kind, layer, count(*) AS n, round(avg(complexity), 6) AS avg_complexity FROM sym GROUP BY CUBE (kind, layer)"))
def cube(g: Graph) -> DataFrame:
    return g.symbols("kind", "layer", "complexity").cube("kind", "layer").agg(F.count("*").alias("n"), F.round(F.avg("complexity"), 6).alias("avg_complexity"))


@query("agg27_percentiles", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.9) AS p90, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY 1")
def percentiles(g: Graph) -> DataFrame:
    return g.table("lineitem").groupBy("l_returnflag").agg(F.expr("percentile(l_quantity, 0.5)").alias("median"), F.expr("percentile(l_quantity, 0.9)").alias("p90"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"))


@query("agg28_pivot", sql("SELECT layer, count(*) FILTER (WHERE kind = 'class') AS class, count(*) FILTER (WHERE kind = 'function') AS function, count(*) FILTER (WHERE kind = 'method') AS method FROM sym WHERE kind IN ('class', 'function', 'method') GROUP BY 1"))
def pivot(g: Graph) -> DataFrame:
    p = g.symbols("layer", "kind").where(F.col("kind").isin("class", "function", "method")).groupBy("layer").pivot("kind", ["class", "function", "method"]).agg(F.count(F.lit(1)))
    return p.select("layer", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("class", "function", "method")])


@query("agg29_sketches", sql("SELECT layer, true AS names_close, true AS hll_close, true AS median_close FROM sym GROUP BY 1"))
def sketches(g: Graph) -> DataFrame:
    """Mergeable sketches by layer - distinct names in two ways, median complexity - held against the exact values."""
    near = lambda a, b, by: F.abs(a - b) <= F.greatest(F.lit(1.0), by * b)
    s = g.symbols("id", "layer", "name", "complexity").groupBy("layer").agg(
        F.approx_count_distinct("name", 0.02).alias("a"), F.hll_sketch_estimate(F.hll_sketch_agg("name")).alias("h"), F.countDistinct("name").alias("n"), F.percentile_approx("complexity", 0.5).alias("p"), F.expr("percentile(complexity, 0.5)").alias("m")
    )
    return s.select("layer", near(F.col("a"), F.col("n"), 0.1).alias("names_close"), near(F.col("h"), F.col("n"), 0.1).alias("hll_close"), F.coalesce(near(F.col("p"), F.col("m"), 0.1), F.lit(True)).alias("median_close"))


# --- windows


@query("win01_rank_score", sql("h AS (SELECT id, name FROM sym WHERE name ILIKE '%handler%') SELECT id, round(1 - (row_number() OVER (ORDER BY name, id) - 1)::DOUBLE / count(*) OVER (), 9) AS score FROM h"))
def rank_score(g: Graph) -> DataFrame:
    """Place in the order of all hits as a score; the hits aren't brought into one task for it."""
    h = g.symbols("id", "name").where(F.col("name").ilike("%handler%"))
    ranked = global_rank(h.select("id", "name"), ["name", "id"])
    total = ranked.agg(F.count("*").alias("n"))
    return ranked.join(F.broadcast(total), how="inner", on=F.lit(True)).select("id", F.round(1 - (F.col("rank") - 1) / F.col("n"), 9).alias("score"))


@query("win02_top_callers", sql("c AS (SELECT e.dst, e.src, row_number() OVER (PARTITION BY e.dst ORDER BY s.name, s.id) AS rn FROM edg e JOIN sym s ON s.id = e.src WHERE e.kind = 'calls') SELECT dst AS id, src AS caller_id, rn FROM c WHERE rn <= 3"))
def top_callers(g: Graph) -> DataFrame:
    w = W.partitionBy("id").orderBy("n_name", "n_id")
    return R.callers(g.edges("calls"), g.symbols("id", "name")).withColumn("rn", F.row_number().over(w).cast("long")).where("rn <= 3").select("id", F.col("n_id").alias("caller_id"), "rn")


@query("win03_top_files_per_layer", sql("c AS (SELECT layer, file_path, count(*) AS n FROM sym GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY n DESC, file_path) AS rn FROM c) SELECT layer, file_path, n FROM r WHERE rn <= 5"))
def top_files(g: Graph) -> DataFrame:
    c = g.symbols("layer", "file_path").groupBy("layer", "file_path").agg(F.count("*").alias("n"))
    return c.withColumn("rn", F.row_number().over(W.partitionBy("layer").orderBy(F.desc("n"), "file_path"))).where("rn <= 5").drop("rn")


@query("win04_keep_first", "SELECT id, line FROM (SELECT id, line, row_number() OVER (PARTITION BY id ORDER BY line NULLS LAST) AS rn FROM edges) WHERE rn = 1")
def keep_first(g: Graph) -> DataFrame:
    """First row of each id; a minimum does it without sorting."""
    return g.table("edges").groupBy("id").agg(F.min("line").alias("line"))


@query("win06_last_annotations", f"WITH {_ANN} SELECT id, user_id FROM (SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS LAST, id) AS rn FROM ann) WHERE rn <= 3")
def last_annotations(g: Graph) -> DataFrame:
    a = annotations(g, "user_id", "created_at")
    return a.withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc_nulls_last("created_at"), "id"))).where("rn <= 3").select("id", "user_id")


@query("win08_kind_priority", sql("r AS (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY CASE kind WHEN 'class' THEN 0 WHEN 'interface' THEN 1 WHEN 'function' THEN 2 WHEN 'method' THEN 3 ELSE 9 END, id) AS rn FROM sym) SELECT name, id FROM r WHERE rn = 1"))
def kind_priority(g: Graph) -> DataFrame:
    p = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "interface", 1).when(F.col("kind") == "function", 2).when(F.col("kind") == "method", 3).otherwise(9)
    return g.symbols("id", "name", "kind").groupBy("name").agg(F.min_by("id", F.struct(p, "id")).alias("id"))


@query("win09_line_nesting", sql("l AS (SELECT id, unnest(string_split(source_code, chr(10))) AS t FROM sym WHERE source_code IS NOT NULL) SELECT id, greatest(0, max((length(t) - length(replace(t, '{', ''))) - (length(t) - length(replace(t, '}', ''))))) AS depth FROM l GROUP BY 1"))
def nesting(g: Graph) -> DataFrame:
    """Greatest surplus of opening braces on one line, computed where the code lies."""
    net = lambda t: (F.length(t) - F.length(F.translate(t, "{", ""))) - (F.length(t) - F.length(F.translate(t, "}", "")))
    depth = F.greatest(F.lit(0), F.array_max(F.transform(F.split("source_code", "\n"), net)))
    return latest(g.table("symbols"), "id", "updated_at", F.when(F.col("source_code").isNotNull(), depth.cast("long")).alias("depth")).where("depth IS NOT NULL")


@query("win10_frames", "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS quarter, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 9) AS pr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def frames(g: Graph) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return g.table("orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("running"), F.lag("o_orderkey").over(w).alias("previous"), F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("pr"))


# --- ordered results


@query("srt01_by_name", sql("SELECT id, name FROM sym ORDER BY name, id LIMIT 50"))
def by_name(g: Graph) -> DataFrame:
    return g.symbols("id", "name").orderBy("name", "id").limit(50).select("id", "name")


def _hot(callers: int, callees: int, long: int, notes: bool) -> str:
    extra = f", a AS (SELECT symbol_id AS id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS r FROM annotations) WHERE r = 1 AND NOT coalesce(resolved, false) GROUP BY 1)" if notes else ""
    plus = " + 3 * coalesce(a.n, 0)" if notes else ""
    join = " LEFT JOIN a ON a.id = s.id" if notes else ""
    return f"""ci AS (SELECT dst AS id, count(*) AS n FROM edg WHERE kind = 'calls' GROUP BY 1), co AS (SELECT src AS id, count(*) AS n FROM edg WHERE kind = 'calls' GROUP BY 1){extra},
x AS (SELECT s.id, s.name, CAST((CASE WHEN coalesce(ci.n, 0) > {callers} THEN ci.n ELSE 0 END) + (CASE WHEN coalesce(co.n, 0) > {callees} THEN co.n ELSE 0 END) + (CASE WHEN coalesce(len(string_split(s.source_code, chr(10))), 0) > {long} THEN len(string_split(s.source_code, chr(10))) // 10 ELSE 0 END){plus} AS BIGINT) AS score
FROM sym s LEFT JOIN ci ON ci.id = s.id LEFT JOIN co ON co.id = s.id{join})
SELECT id, name, score FROM x WHERE score > 0 ORDER BY score DESC, id LIMIT 10"""


def hotspots(g: Graph, callers: int, callees: int, long: int, notes: bool, top: int = 10) -> DataFrame:
    """Symbols by fan-in, fan-out, length and open annotations; only numbers about the code are shuffled."""
    s = latest(g.table("symbols"), "id", "updated_at", "name", F.coalesce(lines(), F.lit(0)).alias("n_lines"))
    e = g.edges("calls")
    s = s.join(R.counts(e, "dst", "ci"), "id", "left").join(R.counts(e, "src", "co"), "id", "left")
    over = lambda c, least, value: F.when(F.coalesce(c, F.lit(0)) > least, value).otherwise(0)
    score = over("ci", callers, F.col("ci")) + over("co", callees, F.col("co")) + over("n_lines", long, F.expr("n_lines div 10"))
    if notes:
        a = annotations(g, "symbol_id", "resolved").where(~F.coalesce("resolved", F.lit(False))).groupBy(F.col("symbol_id").alias("id")).agg(F.count("*").alias("a"))
        s = s.join(a, "id", "left")
        score = score + 3 * F.coalesce("a", F.lit(0))
    return s.select("id", "name", score.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(top)


@query("srt02_hotspots", sql(_hot(5, 5, 50, True)))
def hotspots_full(g: Graph) -> DataFrame:
    return hotspots(g, 5, 5, 50, True)


@query("srt03_hotspots_low", sql(_hot(3, 3, 30, False)))
def hotspots_low(g: Graph) -> DataFrame:
    return hotspots(g, 3, 3, 30, False)


@query("srt06_recent_files", sql("SELECT path, parsed_at FROM fil ORDER BY parsed_at DESC, path LIMIT 20"))
def recent(g: Graph) -> DataFrame:
    return g.files("parsed_at").orderBy(F.desc("parsed_at"), "path").limit(20)


@query("srt07_central_nodes", sql(_DEG + " SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 10"))
def central(g: Graph) -> DataFrame:
    return degrees(g).orderBy(F.desc("degree"), "id").limit(10)


@query("srt08_exported_first", sql("SELECT id, row_number() OVER (PARTITION BY file_path ORDER BY (NOT coalesce(exported, false))::INT, start_line, id) AS place FROM sym"))
def exported_first(g: Graph) -> DataFrame:
    w = W.partitionBy("file_path").orderBy((~F.coalesce("exported", F.lit(False))).cast("int"), "start_line", "id")
    return g.symbols("id", "file_path", "exported", "start_line").select("id", F.row_number().over(w).cast("long").alias("place"))
