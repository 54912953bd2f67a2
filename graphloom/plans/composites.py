"""Composite queries (CMP): the operators put together, as tables instead of prose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.model import Graph, sql
from graphloom.operators import graph as O
from graphloom.operators import relations as R
from graphloom.operators.coverage import test_counts
from graphloom.operators.versions import latest
from graphloom.plans.aggregates import _ANN
from graphloom.plans.catalog import SQL, query
from graphloom.plans.graphplans import _walk as walk_sql
from graphloom.plans.joins import VERSIONS_SQL, _TESTS, annotations, referenced, snapshots
from graphloom.plans.rules import _CLEAN, _GUARD, _SMELLS_LOW, _LOW, _intent_sql, _review_sql, refactor_plan, smells, targets, violations
from graphloom.plans.rules import SQL_TARGETS
from graphloom.storage import cut

_IN_OUT = "ci AS (SELECT dst AS id, count(*) AS n FROM edg WHERE kind = 'calls' AND src IN (SELECT id FROM sym) GROUP BY 1), co AS (SELECT src AS id, count(*) AS n FROM edg WHERE kind = 'calls' AND dst IN (SELECT id FROM sym) GROUP BY 1)"


def _in_out(g: Graph, s: DataFrame) -> DataFrame:
    """Adds callers and callees, 0 included."""
    e = g.edges("calls")
    s = s.join(R.known_counts(e, s, "dst", "src", "callers"), "id", "left").join(R.known_counts(e, s, "src", "dst", "callees"), "id", "left")
    return s.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("callers", "callees")})


@query("cmp02_safe_delete", sql(_IN_OUT + ", u AS (SELECT DISTINCT dst AS id FROM edg WHERE src IN (SELECT id FROM sym) AND kind <> 'contains') SELECT s.id, coalesce(ci.n, 0) AS callers, coalesce(co.n, 0) AS callees, CASE WHEN u.id IS NULL AND NOT coalesce(s.exported, false) THEN 'safe' WHEN u.id IS NULL THEN 'check' ELSE 'unsafe' END AS verdict FROM sym s LEFT JOIN ci ON ci.id = s.id LEFT JOIN co ON co.id = s.id LEFT JOIN u ON u.id = s.id"))
def safe_delete(g: Graph) -> DataFrame:
    s = g.symbols("id", "exported")
    used = g.edges().where("kind <> 'contains'").join(s.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().withColumn("used", F.lit(True))
    r = _in_out(g, s).join(used, "id", "left")
    return r.select("id", "callers", "callees", F.when(F.col("used"), "unsafe").when(F.coalesce("exported", F.lit(False)), "check").otherwise("safe").alias("verdict"))


@query("cmp04_understand", sql(_IN_OUT + " SELECT s.id, s.kind, s.layer, coalesce(ci.n, 0) AS callers, coalesce(co.n, 0) AS callees, length(coalesce(s.ai_summary, s.doc_comment)) AS about FROM sym s LEFT JOIN ci ON ci.id = s.id LEFT JOIN co ON co.id = s.id WHERE s.kind IN ('class', 'function')"))
def understand(g: Graph) -> DataFrame:
    s = latest(g.table("symbols"), "id", "updated_at", "kind", "layer", F.length(F.coalesce("ai_summary", "doc_comment")).alias("about"))
    return _in_out(g, s).where("kind IN ('class', 'function')").select("id", "kind", "layer", "callers", "callees", "about")


@query("cmp05_compare", sql(_IN_OUT + ", m AS (SELECT s.layer, avg(coalesce(ci.n, 0)) AS c, avg(coalesce(s.complexity, 0)) AS x, count(*) AS n FROM sym s LEFT JOIN ci ON ci.id = s.id GROUP BY 1) SELECT a.layer AS a, b.layer AS b, round(a.c - b.c, 6) AS callers_diff, round(a.x - b.x, 6) AS complexity_diff FROM m a JOIN m b ON a.layer < b.layer"))
def compare(g: Graph) -> DataFrame:
    """Layers side by side, pair by pair; there are as many rows as pairs of layers."""
    m = _in_out(g, g.symbols("id", "layer", "complexity")).groupBy("layer").agg(F.avg("callers").alias("c"), F.avg(F.coalesce("complexity", F.lit(0))).alias("x")).where("layer IS NOT NULL")
    every = m.withColumn("all", F.collect_list(F.struct("layer", "c", "x")).over(W.partitionBy()))
    pairs = every.select("layer", "c", "x", F.explode("all").alias("o")).where("layer < o.layer")
    return pairs.select(F.col("layer").alias("a"), F.col("o.layer").alias("b"), F.round(F.col("c") - F.col("o.c"), 6).alias("callers_diff"), F.round(F.col("x") - F.col("o.x"), 6).alias("complexity_diff"))


@query("cmp09_architecture", sql("x AS (SELECT layer, count(*) AS symbols, count(DISTINCT file_path) AS files, round(avg(complexity), 6) AS avg_complexity FROM sym GROUP BY 1), y AS (SELECT a.layer, count(*) FILTER (WHERE b.layer = a.layer) AS inner_edges, count(*) FILTER (WHERE b.layer <> a.layer) AS outer_edges FROM edg e JOIN sym a ON a.id = e.src JOIN sym b ON b.id = e.dst GROUP BY 1) SELECT x.layer, symbols, files, avg_complexity, coalesce(inner_edges, 0) AS inner_edges, coalesce(outer_edges, 0) AS outer_edges FROM x LEFT JOIN y ON y.layer IS NOT DISTINCT FROM x.layer"))
def architecture(g: Graph) -> DataFrame:
    s = g.symbols("id", "layer", "file_path", "complexity")
    x = s.groupBy("layer").agg(F.count("*").alias("symbols"), F.countDistinct("file_path").alias("files"), F.round(F.avg("complexity"), 6).alias("avg_complexity"))
    y = R.with_ends(g.edges(), s.select("id", "layer"), "layer").groupBy(F.col("src_layer").alias("l")).agg(F.count_if(F.col("dst_layer") == F.col("src_layer")).alias("inner_edges"), F.count_if(F.col("dst_layer") != F.col("src_layer")).alias("outer_edges"))
    return x.join(y, F.col("layer").eqNullSafe(F.col("l")), "left").select("layer", "symbols", "files", "avg_complexity", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("inner_edges", "outer_edges")])


@query(
    "cmp13_smart_context",
    sql(
        _IN_OUT
        + """, t AS (SELECT id, file_path FROM sym WHERE kind = 'class'), nb AS (SELECT e.dst AS id, 'caller' AS role, e.src AS other FROM edg e WHERE e.kind = 'calls' AND e.dst IN (SELECT id FROM t) AND e.src IN (SELECT id FROM sym) UNION ALL SELECT e.src, 'callee', e.dst FROM edg e WHERE e.kind = 'calls' AND e.src IN (SELECT id FROM t) AND e.dst IN (SELECT id FROM sym)),
r AS (SELECT *, row_number() OVER (PARTITION BY id, role ORDER BY other) AS rn FROM nb) SELECT id, role, other FROM r WHERE rn <= 5"""
    ),
)
def smart_context(g: Graph) -> DataFrame:
    """The first five callers and callees of each class."""
    s = g.symbols("id", "kind")
    t = s.where("kind = 'class'").select("id")
    e = g.edges("calls")
    known = s.select(F.col("id").alias("other"))
    side = lambda at, other, role: e.select(F.col(at).alias("id"), F.lit(role).alias("role"), F.col(other).alias("other"))
    nb = side("dst", "src", "caller").unionByName(side("src", "dst", "callee")).join(t, "id", "left_semi").join(known, "other", "left_semi")
    return nb.withColumn("rn", F.row_number().over(W.partitionBy("id", "role").orderBy("other"))).where("rn <= 5").select("id", "role", "other")


@query("cmp19_changes", sql("f AS (SELECT path, parsed_at FROM fil ORDER BY parsed_at DESC, path LIMIT 20) SELECT f.path, count(s.id) AS symbols, max(s.complexity) AS max_complexity FROM f LEFT JOIN sym s ON s.file_path = f.path GROUP BY 1"))
def changes(g: Graph) -> DataFrame:
    f = g.files("parsed_at").orderBy(F.desc("parsed_at"), "path").limit(20).select(F.col("path"))
    s = g.symbols("id", "file_path", "complexity").groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("symbols"), F.max("complexity").alias("max_complexity"))
    return f.join(s, "path", "left").select("path", F.coalesce("symbols", F.lit(0)).cast("long").alias("symbols"), "max_complexity")


@query("cmp26_annotation_views", f"WITH {_ANN} SELECT type, resolved, count(*) AS n, count(DISTINCT symbol_id) AS symbols, count(DISTINCT user_id) AS users FROM ann GROUP BY 1, 2")
def annotation_views(g: Graph) -> DataFrame:
    a = annotations(g, "type", "resolved", "symbol_id", "user_id")
    return a.groupBy("type", "resolved").agg(F.count("*").alias("n"), F.countDistinct("symbol_id").alias("symbols"), F.countDistinct("user_id").alias("users"))


@query("cmp28_probes", "SELECT doc_kind, bool_or(regexp_matches(text, '(?m)^obj-\\$\\(CONFIG_')) AS kbuild, bool_or(regexp_matches(text, '(?m)^config [A-Z]')) AS kconfig, bool_or(contains(text, 'compatible =')) AS device_tree FROM documents GROUP BY 1")
def probes(g: Graph) -> DataFrame:
    x = lambda p: F.bool_or(F.col("text").rlike(p))
    return g.table("documents").groupBy("doc_kind").agg(x(r"(?m)^obj-\$\(CONFIG_").alias("kbuild"), x("(?m)^config [A-Z]").alias("kconfig"), F.bool_or(F.col("text").contains("compatible =")).alias("device_tree"))


@query("cmp29_hotspots_of_business", "SELECT p_partkey, count(*) AS suppliers, round(sum(l_quantity), 2) AS qty FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size > 40 GROUP BY 1 HAVING count(*) > 20")
def parts(g: Graph) -> DataFrame:
    """The same shape of query over the order tables: a filter, a join, a grouped having."""
    p = g.table("part").where("p_size > 40").select("p_partkey")
    l = g.table("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("suppliers"), F.round(F.sum("l_quantity"), 2).alias("qty")).where("suppliers > 20")
    return p.join(l, "p_partkey").select("p_partkey", "suppliers", "qty")


_FIND = """h AS (SELECT id, name, kind FROM sym WHERE contains(lower(name), '{term}') OR contains(lower(doc_comment), '{term}')), t AS (SELECT id, name, kind FROM sym WHERE (SELECT count(*) FROM h) < 3 AND ({words})), u AS (SELECT * FROM h UNION SELECT * FROM t)
SELECT kind, count(*) AS n, min(name) AS first_name FROM u GROUP BY 1"""


def find(g: Graph, question: str) -> DataFrame:
    """(id, name, kind): symbols that a question's whole text names, topped up by its single words if these are under three."""
    s = g.symbols("id", "name", "kind", "doc_comment")
    has = lambda k: F.coalesce(F.lower("name").contains(k), F.lit(False)) | F.coalesce(F.lower("doc_comment").contains(k), F.lit(False))
    whole = has(question.lower())
    words = [w for w in question.lower().split() if len(w) > 2]
    hits = s.agg(F.count_if(whole).alias("hits"))
    some = F.lit(False)
    for w in words:
        some = some | has(w)
    return s.join(F.broadcast(hits), how="inner", on=F.lit(True)).where(whole | ((F.col("hits") < 3) & some)).select("id", "name", "kind")


@query("cmp08_find_code", sql(_FIND.format(term="cache", words="contains(lower(name), 'cache') OR contains(lower(doc_comment), 'cache')")))
def find_code(g: Graph) -> DataFrame:
    return find(g, "cache").groupBy("kind").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


@query("cmp08_find_code_by_words", sql(_FIND.format(term="parse the queue", words=" OR ".join(f"contains(lower(name), '{w}') OR contains(lower(doc_comment), '{w}')" for w in ("parse", "the", "queue")))))
def find_by_words(g: Graph) -> DataFrame:
    return find(g, "parse the queue").groupBy("kind").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


_FILE_BUDGET = """m AS (SELECT id, file_path, coalesce(complexity, 0) AS x, CAST(ceil(coalesce(length(source_code), 0) / 3.5) AS BIGINT) AS cost, CAST(ceil((coalesce(length(name), 0) + coalesce(length(kind), 0) + 2) / 3.5) AS BIGINT) AS less FROM sym WHERE file_path IS NOT NULL AND {which}),
o AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY x DESC, id) AS rn FROM m),
b(file_path, rn, used, whole, short) AS (SELECT file_path, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT file_path FROM o) UNION ALL
SELECT b.file_path, o.rn, b.used + CASE WHEN b.used + o.cost <= {budget} THEN o.cost WHEN b.used + o.less <= {budget} THEN o.less ELSE 0 END, b.whole + CASE WHEN b.used + o.cost <= {budget} THEN 1 ELSE 0 END, b.short + CASE WHEN b.used + o.cost > {budget} AND b.used + o.less <= {budget} THEN 1 ELSE 0 END FROM b JOIN o ON o.file_path = b.file_path AND o.rn = b.rn + 1)
SELECT file_path, arg_max(used, rn) AS tokens, arg_max(whole, rn) AS symbols, arg_max(short, rn) AS reduced FROM b GROUP BY 1"""
_MEANINGFUL = "NOT (coalesce(complexity, 0) < 3 AND NOT coalesce(exported, false) AND coalesce(ai_summary, '') = '' AND coalesce(doc_comment, '') = '' AND coalesce(len(string_split(source_code, chr(10))), 0) < 5)"


def budgeted(s: DataFrame, budget: int) -> DataFrame:
    """(file_path, tokens, symbols, reduced) of (id, file_path, complexity, cost, less): for each file the symbols that
    fit a budget of tokens, most complex first; one that doesn't fit is taken by its head alone, and if that doesn't
    either it is skipped and takes nothing. A file's symbols are folded in order, a file at a time; no row is one
    without a file."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("complexity")).alias("x"), "id", "cost", "less")))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("used", "whole", "short")])

    def step(a, i):  # noqa: ANN001, ANN202
        full, head = a["used"] + i["cost"] <= budget, a["used"] + i["less"] <= budget
        cost = F.when(full, i["cost"]).when(head, i["less"]).otherwise(F.lit(0).cast("long"))
        return F.struct((a["used"] + cost).alias("used"), (a["whole"] + F.when(full, 1).otherwise(0)).alias("whole"), (a["short"] + F.when(~full & head, 1).otherwise(0)).alias("short"))

    r = s.where("file_path IS NOT NULL").groupBy("file_path").agg(F.aggregate(items, zero, step).alias("r"))
    return r.select("file_path", F.col("r.used").alias("tokens"), F.col("r.whole").alias("symbols"), F.col("r.short").alias("reduced"))


def _costs(g: Graph) -> DataFrame:
    n = lambda c: F.ceil(c / 3.5).cast("long")
    length = lambda c: F.coalesce(F.length(c), F.lit(0))
    lines = F.coalesce(F.length("source_code") - F.length(F.translate("source_code", "\n", "")) + 1, F.lit(0))
    simple = (F.coalesce("complexity", F.lit(0)) < 3) & ~F.coalesce("exported", F.lit(False)) & (F.coalesce("ai_summary", F.lit("")) == "") & (F.coalesce("doc_comment", F.lit("")) == "") & (lines < 5)
    return latest(g.table("symbols"), "id", "updated_at", "file_path", F.coalesce("complexity", F.lit(0)).alias("complexity"), n(length("source_code")).alias("cost"), n(length("name") + length("kind") + 2).alias("less"), simple.alias("simple"))


@query("win05_token_budget", sql(_FILE_BUDGET.format(which="true", budget=4000), recursive=True))
def token_budget(g: Graph) -> DataFrame:
    return budgeted(_costs(g), 4000)


@query("cmp14_review_context", sql(_FILE_BUDGET.format(which=_MEANINGFUL, budget=800), recursive=True))
def review_context(g: Graph) -> DataFrame:
    """What a review of each file has room for, without symbols that say nothing."""
    return budgeted(_costs(g).where("NOT simple"), 800)


@query("cmp05_compare_symbols", sql(_IN_OUT + ", q AS (SELECT layer, min(id) AS a, max(id) AS b FROM sym WHERE kind = 'class' GROUP BY 1) SELECT q.layer, q.a, q.b, coalesce(ca.n, 0) - coalesce(cb.n, 0) AS callers_diff, coalesce(oa.n, 0) - coalesce(ob.n, 0) AS callees_diff, len(string_split(x.source_code, chr(10))) - len(string_split(y.source_code, chr(10))) AS lines_diff FROM q JOIN sym x ON x.id = q.a JOIN sym y ON y.id = q.b LEFT JOIN ci ca ON ca.id = q.a LEFT JOIN ci cb ON cb.id = q.b LEFT JOIN co oa ON oa.id = q.a LEFT JOIN co ob ON ob.id = q.b"))
def compare_symbols(g: Graph) -> DataFrame:
    """The first and the last class of each layer side by side."""
    lines = (F.length("source_code") - F.length(F.translate("source_code", "\n", "")) + 1).cast("long")
    s = cut(_in_out(g, latest(g.table("symbols"), "id", "updated_at", "layer", "kind", lines.alias("lines"))).where("kind = 'class'"), "compared")
    q = s.groupBy("layer").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    side = lambda k: s.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("callers", "callees", "lines")])
    r = q.join(side("a"), "a").join(side("b"), "b")
    return r.select("layer", "a", "b", *[(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"{c}_diff") for c in ("callers", "callees", "lines")])


_CHANGED = "ch AS (SELECT id FROM sym WHERE file_path IN (SELECT path FROM fil WHERE parsed_at >= TIMESTAMP '2024-11-01'))"


def changed(g: Graph) -> DataFrame:
    f = g.files("parsed_at").where(F.col("parsed_at") >= F.lit("2024-11-01").cast("timestamp_ntz")).select(F.col("path").alias("file_path"))
    return g.symbols("id", "file_path").join(f, "file_path", "left_semi").select("id")


@query("cmp07_code_review", sql(_SMELLS_LOW + ", " + _CHANGED + ", " + _GUARD.replace("UNION ALL SELECT chain, 'no-circular-deps', 'error' FROM cyc", "") + ", f AS (SELECT id, smell AS finding, severity FROM al UNION ALL SELECT id, rule, severity FROM vio) SELECT id, finding, severity, count(*) AS n FROM f WHERE id IN (SELECT id FROM ch) GROUP BY 1, 2, 3"))
def code_review(g: Graph) -> DataFrame:
    """Smells and broken rules of the symbols of changed files."""
    v = violations(g, cycles=False).select("id", F.col("rule").alias("finding"), "severity")
    f = smells(g, **_LOW).select("id", F.col("smell").alias("finding"), "severity").unionByName(v)
    return f.join(changed(g), "id", "left_semi").groupBy("id", "finding", "severity").agg(F.count("*").alias("n"))


@query("cmp15_review", sql("rv AS (" + _review_sql() + "), " + _CHANGED + ", " + walk_sql("SELECT 'all' AS root, id FROM ch", "SELECT dst AS a, src AS b FROM edg WHERE src IN (SELECT id FROM sym)", 2, "") + ", sc AS (SELECT id, min(depth) AS depth FROM reach GROUP BY 1) SELECT sc.depth, rv.rule, rv.severity, count(*) AS symbols, sum(rv.n)::BIGINT AS n FROM rv JOIN sc ON sc.id = rv.id GROUP BY 1, 2, 3"))
def review(g: Graph) -> DataFrame:
    """Findings in changed symbols and in what depends on them, by distance."""
    from graphloom.operators.rules import review as found
    from graphloom.plans.graphplans import review_scope

    return found(g.heavy("symbols")).join(review_scope(g), "id").groupBy("depth", "rule", "severity").agg(F.count("*").alias("symbols"), F.sum("n").alias("n"))


@query("cmp16_refactor_report", "SELECT smell, risk, effort, count(*) AS n, max(symbols_affected) AS most_symbols, (max(effort) = 'quick') AS quick FROM (" + SQL["rul10_refactor_plan"] + ") GROUP BY 1, 2, 3")
def refactor_report(g: Graph) -> DataFrame:
    """The refactoring plan counted: by smell, risk and effort, with the quick ones told apart."""
    p = refactor_plan(g)
    return p.groupBy("smell", "risk", "effort").agg(F.count("*").alias("n"), F.max("symbols_affected").alias("most_symbols"), (F.max("effort") == "quick").alias("quick"))


@query("cmp13_context_metrics", sql(_IN_OUT + ", " + _TESTS + ", tt AS (SELECT id, count(DISTINCT test_id) AS tests FROM r GROUP BY 1) SELECT s.id, coalesce(ci.n, 0) AS callers, coalesce(co.n, 0) AS callees, coalesce(tt.tests, 0) AS tests, coalesce(s.complexity, 0) AS complexity, coalesce(len(string_split(s.source_code, chr(10))), 0) AS lines FROM sym s LEFT JOIN ci ON ci.id = s.id LEFT JOIN co ON co.id = s.id LEFT JOIN tt ON tt.id = s.id WHERE s.kind IN ('class', 'function')"))
def context_metrics(g: Graph) -> DataFrame:
    """What is told of each class and function besides its neighbours: callers, callees, tests, complexity, lines."""
    lines = F.coalesce(F.length("source_code") - F.length(F.translate("source_code", "\n", "")) + 1, F.lit(0)).cast("long")
    s = referenced(g, F.col("kind"), F.coalesce("complexity", F.lit(0)).alias("complexity"), lines.alias("lines"))
    t = test_counts(s).select("id", "tests")
    r = _in_out(g, s.select("id", "kind", "complexity", "lines")).where("kind IN ('class', 'function')").join(t, "id", "left")
    return r.select("id", "callers", "callees", F.coalesce("tests", F.lit(0)).cast("long").alias("tests"), "complexity", "lines")


@query(
    "cmp01_ask",
    sql(
        "i AS (" + _intent_sql("answer") + "), w AS (SELECT doc_id, " + SQL_TARGETS + " AS ws FROM documents WHERE doc_kind = 'answer' AND text IS NOT NULL), p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS at FROM w), nm AS (SELECT name, min(id) AS id FROM sym GROUP BY 1), "
        + "tg AS (SELECT p.doc_id, arg_min(nm.id, p.at) AS target FROM p JOIN nm ON nm.name = p.word GROUP BY 1), " + _IN_OUT
        + " SELECT i.doc_id, i.intent, tg.target, coalesce(ci.n, 0) AS callers, coalesce(co.n, 0) AS callees FROM i LEFT JOIN tg ON tg.doc_id = i.doc_id LEFT JOIN ci ON ci.id = tg.target LEFT JOIN co ON co.id = tg.target"
    ),
)
def ask(g: Graph) -> DataFrame:
    """Each question with its intent, the first symbol it names and that symbol's neighbours in numbers: what the flow of
    the intent starts from. A name stands for its least symbol."""
    from graphloom.operators.rules import intents

    d = g.heavy("documents").where("doc_kind = 'answer'")
    i = intents(d.withColumn("text", F.coalesce("text", F.lit(""))), "text").select("doc_id", "intent")
    t = d.where("text IS NOT NULL").select("doc_id", F.posexplode(targets(F.col("text"))["targets"]).alias("at", "name"))
    s = g.symbols("id", "name")
    names = s.groupBy("name").agg(F.min("id").alias("id"))
    t = t.join(names, "name").groupBy("doc_id").agg(F.min_by("id", "at").alias("target"))
    n = _in_out(g, s.select("id")).withColumnRenamed("id", "target")
    r = i.join(t, "doc_id", "left").join(n, "target", "left")
    return r.select("doc_id", "intent", "target", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("callers", "callees")])


@query("cmp20_scan")
def scan(g: Graph) -> DataFrame:
    """The whole way from files to a saved graph: files put together from their symbols, parsed, resolved, classified,
    written and read back; counted by table, kind and layer."""
    from graphloom.operators import scan as S
    from graphloom.sources.files import rebuilt
    from graphloom.storage import scratch

    folder = scratch(g.spark, "scan")
    S.save(S.graph(cut(rebuilt(g.heavy("symbols")), "rebuilt")), folder)
    made = Graph(g.spark, folder)
    s = made.table("symbols").groupBy(F.lit("symbols").alias("what"), "kind", "layer").agg(F.count("*").alias("n"))
    e = made.table("edges").groupBy(F.lit("edges").alias("what"), "kind", F.lit(None).cast("string").alias("layer")).agg(F.count("*").alias("n"))
    return s.unionByName(e).unionByName(made.table("files").select(F.lit("files").alias("what"), F.col("language").alias("kind"), F.lit(None).cast("string").alias("layer")).groupBy("what", "kind", "layer").agg(F.count("*").alias("n")))


_QUERIES = ("handler", "cache", "parse")


@query("cmp21_multi_search", sql("q(q) AS (VALUES " + ", ".join(f"('{x}')" for x in _QUERIES) + "), h AS (SELECT q, id, name, row_number() OVER (PARTITION BY q ORDER BY name, id) AS rn FROM sym JOIN q ON contains(lower(name), q)) SELECT q, id, rn FROM h WHERE rn <= 5"))
def multi_search(g: Graph) -> DataFrame:
    """Several searches in one pass, the first five hits of each."""
    hit = F.filter(F.array(*[F.when(F.lower("name").contains(x), F.lit(x)) for x in _QUERIES]), lambda x: x.isNotNull())
    h = g.symbols("id", "name").select("id", "name", F.explode(hit).alias("q"))
    return h.withColumn("rn", F.row_number().over(W.partitionBy("q").orderBy("name", "id")).cast("long")).where("rn <= 5").select("q", "id", "rn")


@query(
    "cmp22_graph_diff_summary",
    "WITH " + VERSIONS_SQL + """, d AS (SELECT CASE WHEN o.name IS NULL AND o.file_path IS NULL THEN 'added' WHEN n.name IS NULL AND n.file_path IS NULL THEN 'removed' WHEN o.v IS NOT DISTINCT FROM n.v THEN 'same' ELSE 'changed' END AS status, coalesce(n.v, 0) - coalesce(o.v, 0) AS delta, n.name AS nn, o.name AS oname FROM o FULL OUTER JOIN n ON o.name IS NOT DISTINCT FROM n.name AND o.file_path IS NOT DISTINCT FROM n.file_path),
mv AS (SELECT count(*) AS moved FROM (SELECT DISTINCT nn FROM d WHERE status = 'added' AND nn IN (SELECT name FROM o))), ev AS (SELECT id, count(DISTINCT coalesce(line, -1)) AS versions FROM edges GROUP BY 1)
SELECT status, count(*) AS n, sum(delta)::BIGINT AS complexity_delta, (SELECT moved FROM mv) AS moved, (SELECT greatest(0, count(*) - count(*) FILTER (WHERE versions > 1)) FROM ev) AS edges_added FROM d GROUP BY 1""",
)
def diff_summary(g: Graph) -> DataFrame:
    """The two snapshots in numbers: by status, complexity gained, names that were elsewhere before, edges that are new."""
    old, new = snapshots(g)
    d = cut(R.diff(old, new, ["name", "file_path"], "v"), "diff")
    moved = d.where("status = 'added' AND name IS NOT NULL").select("name").distinct().join(old.select("name").distinct(), "name", "left_semi").agg(F.count("*").alias("moved"))
    e = g.table("edges").groupBy("id").agg(F.countDistinct(F.coalesce("line", F.lit(-1))).alias("versions")).agg(F.greatest(F.lit(0), F.count("*") - F.count_if(F.col("versions") > 1)).alias("edges_added"))
    r = d.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.coalesce("new_value", F.lit(0)) - F.coalesce("old_value", F.lit(0))).cast("long").alias("complexity_delta"))
    return r.join(F.broadcast(moved), how="inner", on=F.lit(True)).join(F.broadcast(e), how="inner", on=F.lit(True))


@query("cmp24_explain_context", sql("e AS (SELECT src AS id, count(*) AS n FROM edg GROUP BY 1), x AS (SELECT dst AS id, count(*) AS n FROM edg GROUP BY 1) SELECT s.id, coalesce(e.n, 0) AS out_edges, coalesce(x.n, 0) AS in_edges, length(concat_ws(chr(10), s.name || ' (' || coalesce(s.kind, '?') || ')', s.doc_comment, s.source_code)) AS characters FROM sym s LEFT JOIN e ON e.id = s.id LEFT JOIN x ON x.id = s.id"))
def explain_context(g: Graph) -> DataFrame:
    """What an explanation of each symbol is given: its name and kind, documentation, code, and its edges in numbers. Only
    the length of the text is shuffled."""
    text = F.concat_ws("\n", F.concat("name", F.lit(" ("), F.coalesce("kind", F.lit("?")), F.lit(")")), "doc_comment", "source_code")
    s = latest(g.table("symbols"), "id", "updated_at", F.length(text).cast("long").alias("characters"))
    e = g.edges()
    n = lambda at, c: e.groupBy(F.col(at).alias("id")).agg(F.count("*").alias(c))
    r = s.join(n("src", "out_edges"), "id", "left").join(n("dst", "in_edges"), "id", "left")
    return r.select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("out_edges", "in_edges")], "characters")


@query("srt09_files_by", sql("f AS (SELECT file_path, count(*) AS symbols, coalesce(max(complexity), 0) AS complexity FROM sym GROUP BY 1), a AS (SELECT 'symbols' AS sorted, file_path, row_number() OVER (ORDER BY symbols DESC, file_path) AS place FROM f UNION ALL SELECT 'complexity', file_path, row_number() OVER (ORDER BY complexity DESC, file_path) FROM f UNION ALL SELECT 'name', file_path, row_number() OVER (ORDER BY file_path) FROM f) SELECT * FROM a WHERE place <= 10"))
def files_by(g: Graph) -> DataFrame:
    """Files in the order of an option: by symbols, by complexity, by name; the first ten of each."""
    f = cut(g.symbols("file_path", "complexity").groupBy("file_path").agg(F.count("*").alias("symbols"), F.coalesce(F.max("complexity"), F.lit(0)).alias("complexity")), "by-file")
    out = None
    for option, order in (("symbols", [F.desc("symbols")]), ("complexity", [F.desc("complexity")]), ("name", [])):
        first = f.orderBy(*order, F.asc_nulls_last("file_path")).limit(10)
        part = first.select(F.lit(option).alias("sorted"), "file_path", F.row_number().over(W.orderBy(*order, F.asc_nulls_last("file_path"))).cast("long").alias("place"))
        out = part if out is None else out.unionByName(part)
    return out


@query("agg06_layers_of_files", sql("c AS (SELECT file_path, coalesce(layer, 'unknown') AS layer, count(*) AS n FROM sym GROUP BY 1, 2), k AS (SELECT file_path, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM sym GROUP BY 1) SELECT c.file_path, kinds, string_agg(layer || '=' || n, ',' ORDER BY layer) AS layers FROM c JOIN k ON k.file_path = c.file_path GROUP BY 1, 2"))
def layers_of_files(g: Graph) -> DataFrame:
    """The kinds in each file and how many symbols of each layer it holds, as a map."""
    s = g.symbols("file_path", "kind", "layer").where("file_path IS NOT NULL")
    c = s.groupBy("file_path", F.coalesce("layer", F.lit("unknown")).alias("layer")).agg(F.count("*").alias("n"))
    m = c.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("layer", "n"))).alias("l"))
    k = s.groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return m.join(k, "file_path").select("file_path", "kinds", F.array_join(F.transform("l", lambda x: F.concat_ws("=", x["layer"], x["n"].cast("string"))), ",").alias("layers"))


@query("agg23_edge_delta", "WITH v AS (SELECT kind, id, count(DISTINCT coalesce(line, -1)) AS versions FROM edges GROUP BY 1, 2) SELECT kind, greatest(0, count(*) - count(*) FILTER (WHERE versions > 1)) AS added, greatest(0, count(*) FILTER (WHERE versions > 1) - count(*)) AS removed FROM v GROUP BY 1")
def edge_delta(g: Graph) -> DataFrame:
    """Edges now against those that were seen before, at another line, both ways and never negative."""
    v = g.table("edges").groupBy("kind", "id").agg(F.countDistinct(F.coalesce("line", F.lit(-1))).alias("versions"))
    now, was = F.count("*"), F.count_if(F.col("versions") > 1)
    return v.groupBy("kind").agg(F.greatest(F.lit(0), now - was).alias("added"), F.greatest(F.lit(0), was - now).alias("removed"))
