"""Graph traversals and measures (GRF)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph, sql
from graphloom.operators import graph as O
from graphloom.operators import relations as R
from graphloom.plans.catalog import query


def _undirected(g: Graph, *kinds: str) -> DataFrame:
    e = R.induced(g.edges(*kinds), g.symbols("id"))
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b"))


def _walk(base: str, step: str, depth: int, final: str) -> str:
    """Breadth-first levels without a growing walk: one common table a level, each minus what was seen."""
    parts = [f"l0 AS ({base})"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT root, id FROM l{i}" for i in range(d))
        parts.append(f"l{d} AS (SELECT DISTINCT l.root, e.b AS id FROM l{d - 1} l JOIN ({step}) e ON e.a = l.id WHERE (l.root, e.b) NOT IN (SELECT (root, id) FROM ({seen})))")
    union = " UNION ALL ".join(f"SELECT root, id, {d} AS depth FROM l{d}" for d in range(depth + 1))
    return ", ".join(parts) + f", reach AS ({union}) {final}"


_INC = "SELECT dst AS a, src AS b FROM edg WHERE src IN (SELECT id FROM sym)"


@query("grf01_impact", sql("r AS (SELECT id FROM sym WHERE kind = 'class'), " + _walk("SELECT id AS root, id FROM r", _INC, 3, "SELECT root, id, depth FROM reach WHERE depth > 0")))
def impact(g: Graph) -> DataFrame:
    """Everything that refers to each class directly or through others, three steps deep."""
    s = g.symbols("id", "kind")
    inc = g.edges().join(s.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return O.reach(inc, s.where("kind = 'class'").select(F.col("id").alias("root")), 3).where("depth > 0")


@query(
    "grf02_risk",
    sql(
        "r AS (SELECT id, file_path FROM sym WHERE kind = 'class'), "
        + _walk("SELECT id AS root, id FROM r", "SELECT dst AS a, src AS b FROM edg WHERE src IN (SELECT id FROM sym) UNION SELECT src, dst FROM edg WHERE kind = 'calls' AND dst IN (SELECT id FROM sym)", 2, "")
        + """SELECT r.id AS root, count(*) - 1 AS affected, count(*) FILTER (WHERE depth = 1) AS direct, count(DISTINCT s.file_path) AS files,
CASE WHEN count(*) - 1 = 0 THEN 'low' WHEN count(*) - 1 <= 3 THEN 'medium' WHEN count(*) - 1 <= 10 THEN 'high' ELSE 'critical' END AS risk FROM reach JOIN r ON r.id = reach.root JOIN sym s ON s.id = reach.id GROUP BY 1"""
    ),
)
def risk(g: Graph) -> DataFrame:
    """Impact in both senses - users of a symbol and what it calls - counted, with affected files and a risk class."""
    s = g.symbols("id", "kind", "file_path")
    e = g.edges()
    used = e.join(s.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("a"), F.col("src").alias("b"))
    calls = e.where("kind = 'calls'").join(s.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    r = O.reach(used.union(calls), s.where("kind = 'class'").select(F.col("id").alias("root")), 2).join(s.select("id", "file_path"), "id")
    n = F.count("*") - 1
    return r.groupBy("root").agg(n.alias("affected"), F.count_if(F.col("depth") == 1).alias("direct"), F.countDistinct("file_path").alias("files"), F.when(n == 0, "low").when(n <= 3, "medium").when(n <= 10, "high").otherwise("critical").alias("risk"))


_UND = "SELECT src AS a, dst AS b FROM edg WHERE src IN (SELECT id FROM sym) AND dst IN (SELECT id FROM sym) UNION SELECT dst, src FROM edg WHERE src IN (SELECT id FROM sym) AND dst IN (SELECT id FROM sym)"


@query(
    "grf03_shortest_path",
    sql(
        "q AS (SELECT DISTINCT min(id) AS src, max(id) AS dst FROM sym WHERE kind = 'class' GROUP BY layer), "
        + _walk("SELECT DISTINCT src AS root, src AS id FROM q UNION SELECT dst, dst FROM q", _UND, 6, "")
        + f""", h AS (SELECT q.src, q.dst, x.depth AS hops FROM q JOIN reach x ON x.root = q.src AND x.id = q.dst),
p(src, dst, hops, here, path, k) AS (SELECT src, dst, hops, src, [src], 0 FROM h UNION ALL SELECT p.src, p.dst, p.hops, e.b, list_append(p.path, e.b), k + 1 FROM p JOIN (SELECT DISTINCT a, b FROM ({_UND})) e ON e.a = p.here JOIN reach x ON x.root = p.dst AND x.id = e.b AND x.depth = p.hops - p.k - 1 WHERE k < hops)
SELECT src, dst, hops, array_to_string(min(path), ' > ') AS path FROM p WHERE k = hops GROUP BY 1, 2, 3""",
        recursive=True,
    ),
)
def paths(g: Graph) -> DataFrame:
    """The way from the first to the last class of each layer, over edges in either direction."""
    q = g.symbols("id", "kind", "layer").where("kind = 'class'").groupBy("layer").agg(F.min("id").alias("src"), F.max("id").alias("dst")).select("src", "dst")
    e = _undirected(g)
    return O.shortest_paths(e.union(e.select("b", "a")), q, 6).select("src", "dst", "hops", F.array_join("path", " > ").alias("path"))


_CALLS = "SELECT src AS a, dst AS b FROM edg WHERE kind = 'calls' AND dst IN (SELECT id FROM sym)"


@query("grf04_call_tree", sql("r AS (SELECT id FROM sym WHERE kind = 'module'), " + _walk("SELECT id AS root, id FROM r", _CALLS, 4, "SELECT root, count(*) AS nodes, max(depth) AS depth FROM reach GROUP BY 1")))
def call_tree(g: Graph) -> DataFrame:
    """Size and depth of what each module calls, breadth first to depth 4, each symbol once."""
    s = g.symbols("id", "kind")
    calls = g.edges("calls").join(s.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return O.reach(calls, s.where("kind = 'module'").select(F.col("id").alias("root")), 4).groupBy("root").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"))


_FILES = "f AS (SELECT DISTINCT a.file_path AS a, b.file_path AS b FROM edg e JOIN sym a ON a.id = e.src JOIN sym b ON b.id = e.dst WHERE e.kind = 'imports' AND a.file_path <> b.file_path)"


#: The shortest cycle through each file. The walk is bounded in SQL only.
CYCLES_SQL = (
    _FILES
    + """, r(s, id, n) AS (SELECT a, b, 1 FROM f UNION SELECT r.s, f.b, r.n + 1 FROM r JOIN f ON f.a = r.id WHERE r.n < 14), d AS (SELECT s, id, min(n) AS n FROM r GROUP BY 1, 2),
p(s, id, chain, k) AS (SELECT s, s, [s], n FROM d WHERE s = id UNION ALL SELECT p.s, f.b, list_append(p.chain, f.b), p.k - 1 FROM p JOIN f ON f.a = p.id JOIN d ON d.s = f.b AND d.id = p.s AND d.n = p.k - 1 WHERE p.k > 1),
m AS (SELECT s, min(chain) AS chain FROM p WHERE k = 1 GROUP BY 1), t AS (SELECT chain, list_position(chain, list_min(chain)) AS i FROM m),
cyc AS (SELECT DISTINCT len(chain)::INTEGER AS length, array_to_string(list_concat(chain[i:], chain[:i - 1]), ' > ') AS chain FROM t)"""
)


def file_imports(g: Graph) -> DataFrame:
    """(a, b): which file imports which other one."""
    ends = R.with_ends(g.edges("imports"), g.symbols("id", "file_path"), "file_path").where("src_file_path <> dst_file_path")
    return ends.select(F.col("src_file_path").alias("a"), F.col("dst_file_path").alias("b")).distinct()


@query("grf05_import_cycles", sql(CYCLES_SQL + " SELECT length, chain FROM cyc", recursive=True))
def import_cycles(g: Graph) -> DataFrame:
    """Import cycles of any length: the shortest one through each file."""
    return O.shortest_cycles(file_imports(g)).select("length", F.array_join("chain", " > ").alias("chain"))


@query("grf05_strong_components", sql(_FILES + ", r(s, id) AS (SELECT a, b FROM f UNION SELECT r.s, f.b FROM r JOIN f ON f.a = r.id) SELECT x.s AS path, max(x.id) AS component FROM r x JOIN r y ON y.s = x.id AND y.id = x.s GROUP BY 1 HAVING count(DISTINCT x.id) > 1", recursive=True))
def strong(g: Graph) -> DataFrame:
    """The files that depend on one another, however far round."""
    return O.strong_components(file_imports(g)).select(F.col("id").alias("path"), "component")


@query(
    "grf06_components",
    sql(
        """u AS (SELECT src AS a, dst AS b FROM edg WHERE src IN (SELECT id FROM sym) AND dst IN (SELECT id FROM sym)), b AS (SELECT a, b FROM u UNION SELECT b, a FROM u),
r(id, m) AS (SELECT id, id FROM sym UNION SELECT b.b, r.m FROM r JOIN b ON b.a = r.id) SELECT id, min(m) AS component FROM r GROUP BY 1""",
        recursive=True,
    ),
)
def components(g: Graph) -> DataFrame:
    return O.components(g.symbols("id"), _undirected(g))


_TRI = """u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edg WHERE src <> dst AND src IN (SELECT id FROM sym) AND dst IN (SELECT id FROM sym)),
t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM u x JOIN u y ON y.a = x.b JOIN u z ON z.a = x.a AND z.b = y.b), n AS (SELECT id, count(*) AS triangles FROM (SELECT p AS id FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) GROUP BY 1),
d AS (SELECT a AS id, count(*) AS degree FROM (SELECT src AS a, dst AS b FROM edg WHERE src IN (SELECT id FROM sym) AND dst IN (SELECT id FROM sym) UNION SELECT dst, src FROM edg WHERE src IN (SELECT id FROM sym) AND dst IN (SELECT id FROM sym)) GROUP BY 1 HAVING count(*) >= 2)"""


@query("grf07_clustering", sql(_TRI + " SELECT d.id, d.degree, coalesce(n.triangles, 0) AS triangles, round(2.0 * coalesce(n.triangles, 0) / (d.degree * (d.degree - 1)), 9) AS coefficient FROM d LEFT JOIN n ON n.id = d.id"))
def clustering(g: Graph) -> DataFrame:
    return O.clustering(_undirected(g)).select("id", "degree", "triangles", F.round("coefficient", 9).alias("coefficient"))


@query("grf09_two_hop_callers", sql("c AS (SELECT DISTINCT src, dst FROM edg WHERE kind = 'calls' AND src IN (SELECT id FROM sym)) SELECT a.dst AS id, count(DISTINCT b.src) AS callers2 FROM c a JOIN c b ON b.dst = a.src GROUP BY 1"))
def two_hop(g: Graph) -> DataFrame:
    c = g.edges("calls").join(g.symbols("id").select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst").distinct()
    return c.select(F.col("dst").alias("id"), F.col("src").alias("mid")).join(c.select(F.col("dst").alias("mid"), "src"), "mid").groupBy("id").agg(F.countDistinct("src").alias("callers2"))


@query("grf10_changed_files_depth", sql("r AS (SELECT id FROM sym WHERE file_path IN (SELECT path FROM fil WHERE parsed_at >= TIMESTAMP '2024-11-01')), " + _walk("SELECT id AS root, id FROM r", _INC, 4, "SELECT root, max(depth) AS deepest FROM reach GROUP BY 1 HAVING max(depth) > 3")))
def changed_depth(g: Graph) -> DataFrame:
    """Symbols of recently changed files that are depended on more than three steps away."""
    s = g.symbols("id", "file_path")
    changed = g.files("parsed_at").where(F.col("parsed_at") >= F.lit("2024-11-01").cast("timestamp_ntz")).select(F.col("path").alias("file_path"))
    inc = g.edges().join(s.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("a"), F.col("src").alias("b"))
    roots = s.join(changed, "file_path", "left_semi").select(F.col("id").alias("root"))
    return O.reach(inc, roots, 4).groupBy("root").agg(F.max("depth").alias("deepest")).where("deepest > 3")


@query("grf11_review_scope", sql("r AS (SELECT id FROM sym WHERE file_path IN (SELECT path FROM fil WHERE parsed_at >= TIMESTAMP '2024-11-01')), " + _walk("SELECT 'all' AS root, id FROM r", _INC, 2, "SELECT id, min(depth) AS depth FROM reach GROUP BY 1")))
def review_scope(g: Graph) -> DataFrame:
    """One search from all changed symbols together."""
    s = g.symbols("id", "file_path")
    changed = g.files("parsed_at").where(F.col("parsed_at") >= F.lit("2024-11-01").cast("timestamp_ntz")).select(F.col("path").alias("file_path"))
    inc = g.edges().join(s.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("a"), F.col("src").alias("b"))
    starts = s.join(changed, "file_path", "left_semi").select("id").distinct()
    hub = starts.select(F.lit("\0changed").alias("a"), F.col("id").alias("b"))
    root = g.spark.createDataFrame([("\0changed",)], "root string")
    return O.reach(inc.union(hub), root, 3).where("depth > 0").select("id", (F.col("depth") - 1).alias("depth"))


_DAG = "g AS (SELECT DISTINCT src AS a, dst AS b FROM edg WHERE kind = 'contains' AND src <> dst AND src IN (SELECT id FROM sym) AND dst IN (SELECT id FROM sym)), n AS (SELECT a AS id FROM g UNION SELECT b FROM g)"


@query("grf12_dag_levels", sql(_DAG + ", r(id, level) AS (SELECT id, 0 FROM n WHERE id NOT IN (SELECT b FROM g) UNION SELECT g.b, r.level + 1 FROM r JOIN g ON g.a = r.id) SELECT id, max(level) AS level FROM r GROUP BY 1", recursive=True))
def dag_levels(g: Graph) -> DataFrame:
    """Longest-path levels of the containment graph."""
    return O.levels(_undirected(g, "contains"))


@query("grf13_first_successors", sql(_DAG + ", s AS (SELECT a, min(b) AS b FROM g GROUP BY 1), r(root, id, step) AS (SELECT a, a, 0 FROM s WHERE a NOT IN (SELECT b FROM g) UNION ALL SELECT r.root, s.b, r.step + 1 FROM r JOIN s ON s.a = r.id) SELECT root, count(*) AS length, max(id) AS last FROM r GROUP BY 1", recursive=True))
def first_successors(g: Graph) -> DataFrame:
    """Chains that always go on to the least successor; each round follows all of them one step."""
    e = _undirected(g, "contains").where("a <> b").distinct()
    nxt = e.groupBy("a").agg(F.min("b").alias("b"))
    roots = nxt.select("a").join(e.select(F.col("b").alias("a")).distinct(), "a", "left_anti").select(F.col("a").alias("root"))
    return O.reach(nxt, roots, None).groupBy("root").agg(F.count("*").alias("length"), F.max("id").alias("last"))


@query("grf14_adjacency", sql("SELECT a.layer AS src_layer, count(*) FILTER (WHERE b.layer = 'interface') AS interface, count(*) FILTER (WHERE b.layer = 'business') AS business, count(*) FILTER (WHERE b.layer = 'data') AS data, count(*) FILTER (WHERE b.layer = 'utility') AS utility FROM edg e JOIN sym a ON a.id = e.src JOIN sym b ON b.id = e.dst GROUP BY 1"))
def adjacency(g: Graph) -> DataFrame:
    """A matrix of the layers; of single symbols the matrix stays in coordinate form (``join03``)."""
    e = R.with_ends(g.edges(), g.symbols("id", "layer"), "layer")
    cols = ("interface", "business", "data", "utility")
    return e.groupBy("src_layer").agg(*[F.count_if(F.col("dst_layer") == c).alias(c) for c in cols])


@query("grf15_expand_context", sql("t AS (SELECT id FROM sym WHERE kind = 'class'), x AS (SELECT id FROM t UNION SELECT src FROM edg WHERE kind = 'calls' AND dst IN (SELECT id FROM t) AND src IN (SELECT id FROM sym) UNION SELECT dst FROM edg WHERE kind = 'calls' AND src IN (SELECT id FROM t) AND dst IN (SELECT id FROM sym)) SELECT id FROM x"))
def expand(g: Graph) -> DataFrame:
    s = g.symbols("id", "kind")
    t = s.where("kind = 'class'").select("id")
    c = R.induced(g.edges("calls"), s)
    near = lambda a, b: c.join(t.select(F.col("id").alias(a)), a, "left_semi").select(F.col(b).alias("id"))
    known = g.edges("calls")
    callers = known.join(t.select(F.col("id").alias("dst")), "dst", "left_semi").join(s.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"))
    return t.union(callers).union(near("src", "dst")).distinct()


@query("grf17_pagerank")
def ranks(g: Graph) -> DataFrame:
    return O.pagerank(_undirected(g, "calls")).select("id", F.round("rank", 6).alias("rank"))
