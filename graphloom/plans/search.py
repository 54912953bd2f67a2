"""Search, similarity and ranking (SIM)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph, sql
from graphloom.operators import search as S
from graphloom.operators.versions import latest
from graphloom.plans.catalog import query
from graphloom.storage import spread

_KW = "k0 AS (SELECT id, name FROM sym WHERE name ILIKE '%{q}%' OR doc_comment ILIKE '%{q}%' ORDER BY name, id LIMIT {n}), kw AS (SELECT id, 1 - (row_number() OVER (ORDER BY name, id) - 1)::DOUBLE / count(*) OVER () AS score FROM k0)"


@query("sim01_keyword", sql(_KW.format(q="queue", n=20) + " SELECT id, round(score, 9) AS score FROM kw"))
def keyword(g: Graph) -> DataFrame:
    return S.keyword_hits(g.symbols("id", "name", "doc_comment"), "queue", 20).select("id", F.round("score", 9).alias("score"))


@query("sim02_hash_embedding")
def hash_embedding(g: Graph) -> DataFrame:
    """Hashed vectors of all symbols' names, kinds, paths, comments and layers."""
    return S.embed_texts(spread(_texts(g)), "text").select("id", F.size("embedding").alias("dim"), F.round(S.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


def _texts(g: Graph) -> DataFrame:
    about = F.when(F.length("ai_summary") > 0, F.col("ai_summary")).when(F.length("doc_comment") > 0, F.substring("doc_comment", 1, 200))
    return g.symbols("id", "name", "kind", "file_path", "layer", "ai_summary", "doc_comment").select("id", F.concat_ws(" ", "name", "kind", "file_path", about, F.concat(F.lit("layer:"), F.coalesce("layer", F.lit("unknown")))).alias("text"))


@query("sim04_embedding_text", sql("SELECT id, concat_ws(' ', name, kind, file_path, CASE WHEN length(ai_summary) > 0 THEN ai_summary WHEN length(doc_comment) > 0 THEN doc_comment[:200] END, 'layer:' || coalesce(layer, 'unknown')) AS text FROM sym"))
def embedding_text(g: Graph) -> DataFrame:
    return _texts(g)


@query("sim05_cosine_to_label", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) b ON b.label = a.label")
def cosine_to_label(g: Graph) -> DataFrame:
    """Similarity of each vector to the first one of its label."""
    v = g.table("embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e"))
    return v.join(first, "label").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("e")), 6).alias("score"))


@query("sim06_vector_topk", "WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, q WHERE list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) > 0.05 ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(g: Graph) -> DataFrame:
    v = g.table("embeddings")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("query")).limit(1)
    return S.top_similar(v, q, "vec_id", "embedding", 10).select("vec_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "vec_id")


_VEC = "e AS (SELECT symbol_id AS id, arg_max(embedding, created_at) AS v FROM symbol_embeddings WHERE model = 'local-hash' AND len(embedding) = 256 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true) GROUP BY 1), z AS (SELECT id, v FROM e WHERE list_dot_product(v, v) > 0), q AS (SELECT v FROM z ORDER BY id LIMIT 1), vec AS (SELECT id, round(list_cosine_similarity(z.v, q.v), 9) AS score FROM z, q WHERE list_cosine_similarity(z.v, q.v) > 0.05 ORDER BY score DESC, id LIMIT 20)"


def _vectors(g: Graph) -> DataFrame:
    e = g.table("symbol_embeddings")
    ok = (F.col("model") == "local-hash") & (F.size("embedding") == 256) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return latest(e.where(ok), "symbol_id", "created_at", F.col("embedding")).withColumnRenamed("symbol_id", "id").where(F.exists("embedding", lambda x: x != 0))


@query(
    "sim07_hybrid",
    sql(
        _KW.format(q="queue", n=20)
        + ", "
        + _VEC
        + """, h AS (SELECT id, score, 0 AS s FROM kw UNION ALL SELECT id, score, 1 FROM vec), sd AS (SELECT id AS seed, score FROM h ORDER BY s, score DESC, id LIMIT 5),
c AS (SELECT DISTINCT src, dst FROM edg WHERE kind = 'calls' AND src IN (SELECT id FROM sym) AND dst IN (SELECT id FROM sym)),
nb AS (SELECT DISTINCT seed, score, src AS id, 'dst' AS side FROM c JOIN sd ON sd.seed = c.dst UNION ALL SELECT DISTINCT seed, score, dst, 'src' FROM c JOIN sd ON sd.seed = c.src),
nr AS (SELECT *, row_number() OVER (PARTITION BY seed, side ORDER BY id) AS r FROM nb), gr AS (SELECT id, 0.5 * max(score) AS g FROM nr WHERE r <= 3 GROUP BY 1),
a AS (SELECT id FROM kw UNION SELECT id FROM vec UNION SELECT id FROM gr)
SELECT a.id, round(coalesce(kw.score, 0) * 0.3 + coalesce(vec.score, 0) * 0.5 + coalesce(gr.g, 0) * 0.2, 9) AS score FROM a LEFT JOIN kw USING (id) LEFT JOIN vec USING (id) LEFT JOIN gr USING (id) ORDER BY score DESC, id LIMIT 10"""
    ),
)
def hybrid(g: Graph) -> DataFrame:
    v = _vectors(g)
    q = v.orderBy("id").limit(1).select(F.col("embedding").alias("query"))
    nodes = g.symbols("id", "name", "doc_comment")
    calls = g.edges("calls").join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    vec = S.top_similar(v, q, "id", "embedding", 20)
    return S.hybrid(S.keyword_hits(nodes, "queue", 20), vec, calls, 10)


@query("sim08_index_stats", "SELECT model, count(*) AS n, count(DISTINCT symbol_id) AS symbols, min(len(embedding)) AS least_dim, max(len(embedding)) AS most_dim FROM symbol_embeddings GROUP BY 1")
def index_stats(g: Graph) -> DataFrame:
    d = F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long")
    return g.table("symbol_embeddings").groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("symbol_id").alias("symbols"), F.min(d).alias("least_dim"), F.max(d).alias("most_dim"))


@query(
    "sim09_match_score",
    sql(
        """p AS (SELECT id, name, exported, layer, lower(name) AS l, list_transform(string_split_regex(regexp_replace(name, '([A-Z])', chr(1) || '\\1', 'g'), '[' || chr(1) || '_-]'), lambda w: lower(w)) AS parts FROM sym)
SELECT id, round(least(1.0, CASE WHEN l = 'handler' THEN 1.0 WHEN contains(l, 'handler') THEN 0.7 WHEN contains('handler', l) THEN 0.5 ELSE 0 END
+ 0.15 * (CASE WHEN len(list_filter(parts, lambda w: contains(w, 'queue'))) > 0 THEN 1 ELSE 0 END) + 0.15 * (CASE WHEN len(list_filter(parts, lambda w: contains(w, 'page'))) > 0 THEN 1 ELSE 0 END)
+ CASE WHEN exported THEN 0.1 ELSE 0 END + CASE WHEN layer = 'business' THEN 0.05 ELSE 0 END), 6) AS score FROM p"""
    ),
)
def match_score(g: Graph) -> DataFrame:
    """How well each name fits a target and keywords; names are split at capitals, underscores and hyphens."""
    target, words = "handler", ("queue", "page")
    low = F.lower("name")
    parts = F.transform(F.split("name", r"(?=[A-Z])|[_\-]"), lambda w: F.lower(w))
    base = F.when(low == target, 1.0).when(low.contains(target), 0.7).when(F.lit(target).contains(low), 0.5).otherwise(0.0)
    hit = lambda k: F.exists(parts, lambda w: w.contains(k))
    extra = sum((F.when(hit(k), 0.15).otherwise(0.0) for k in words), F.lit(0.0))
    score = base + extra + F.when(F.col("exported"), 0.1).otherwise(0.0) + F.when(F.col("layer") == "business", 0.05).otherwise(0.0)
    return g.symbols("id", "name", "exported", "layer").select("id", F.round(F.least(F.lit(1.0), score), 6).alias("score"))


@query("sim10_prefilter", sql("SELECT id, (CASE WHEN contains(lower(name), 'cache') THEN 3 ELSE 0 END) + (CASE WHEN contains(lower(doc_comment), 'cache') THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(ai_summary), 'cache') THEN 1 ELSE 0 END) AS score FROM sym WHERE contains(lower(name), 'cache') OR contains(lower(doc_comment), 'cache') OR contains(lower(ai_summary), 'cache') ORDER BY score DESC, id LIMIT 50"))
def prefilter(g: Graph) -> DataFrame:
    has = lambda c, n: F.when(F.lower(c).contains("cache"), n).otherwise(0)
    score = has("name", 3) + has("doc_comment", 2) + has("ai_summary", 1)
    return g.symbols("id", "name", "doc_comment", "ai_summary").select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(50)


@query("sim11_ask", sql("v AS (SELECT id, (contains(lower(name), 'queue'))::INT + (contains(lower(name), 'page'))::INT + (contains(lower(name), 'depot'))::INT AS votes FROM sym), t AS (SELECT count(*) AS n FROM v WHERE votes > 0) SELECT v.id, v.votes, round(least(1.0, least(t.n / 5.0, 1.0) + 0.5), 6) AS confidence FROM v, t WHERE votes > 0 ORDER BY votes DESC, id LIMIT 20"))
def ask(g: Graph) -> DataFrame:
    votes = sum((F.lower("name").contains(k).cast("int") for k in ("queue", "page", "depot")), F.lit(0))
    v = g.symbols("id", "name").select("id", votes.alias("votes")).where("votes > 0")
    t = v.agg(F.round(F.least(F.lit(1.0), F.least(F.count("*") / 5.0, F.lit(1.0)) + 0.5), 6).alias("confidence"))
    return v.orderBy(F.desc("votes"), "id").limit(20).join(F.broadcast(t), how="inner", on=F.lit(True))
