"""Text and vector search: hashed embeddings, cosine ranking, keyword and hybrid scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def fnv_float(text: Column) -> Column:
    """The 32-bit hash of a string in double arithmetic: (h xor c) as signed 32 bits times 16777619, rounded to a
    double, modulo 2^32. Not the integer FNV-1a; null text gives null."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: F.pmod((F.when(h.bitwiseXOR(c) >= 2147483648, h.bitwiseXOR(c) - 4294967296).otherwise(h.bitwiseXOR(c)).cast("double") * F.lit(16777619.0)).cast("long"), F.lit(4294967296))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), step)


def hash_embedding(text: Column, dim: int = 256) -> Column:
    """Unit vector of hashed words and word pairs: each adds 1 at one place and 0.5 at another.

    Text is lower-cased, everything but ASCII letters, digits, underscore and white space becomes a blank, words of
    one character are dropped. Text without words gives the zero vector, null gives null. All JVM-side.
    """
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", " "), r"\s+"), lambda w: F.length(w) > 1)
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))
    grams = F.concat(words, pairs)
    ones = F.transform(grams, lambda x: F.struct(F.pmod(fnv_float(x), F.lit(dim)).cast("int").alias("p"), F.lit(1.0).alias("v")))
    halves = F.transform(grams, lambda x: F.struct(F.pmod(fnv_float(F.concat(x, F.lit("_2"))), F.lit(dim)).cast("int").alias("p"), F.lit(0.5).alias("v")))
    hits = F.concat(ones, halves)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(hits, lambda h: h["p"] == i), F.lit(0.0), lambda a, h: a + h["v"]))
    return F.when(text.isNotNull(), normalise(raw))


def embed_texts(df: DataFrame, text: str, out: str = "embedding", dim: int = 256) -> DataFrame:
    """The same vectors by Arrow batches, for whole tables: a word's places are computed once a process."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        from graphloom.functions.embedding import embed_one

        return pd.Series([None if t is None else embed_one(t, dim) for t in texts])

    return df.withColumn(out, embed(F.col(text)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if their lengths differ or one has no length."""
    d = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (d == 0), F.lit(0.0)).otherwise(dot(a, b) / d)


def top_similar(vectors: DataFrame, query: DataFrame, key: str, vector: str, k: int, least: float = 0.05) -> DataFrame:
    """The ``k`` vectors most similar to the one of ``query``, a table of one row (query); ties by key. No row finds nothing."""
    both = vectors.join(F.broadcast(query.select(F.col("query").alias("__q"))), how="inner", on=F.lit(True))
    s = both.select(key, F.round(cosine(F.col(vector), F.col("__q")), 9).alias("score")).where(F.col("score") > least)
    return s.orderBy(F.desc("score"), key).limit(k)


def keyword_hits(nodes: DataFrame, text: str, k: int) -> DataFrame:
    """(id, score): names or comments that contain ``text``, ranked by name: 1 - place / number of hits."""
    like = f"%{text}%"
    top = nodes.where(F.col("name").ilike(like) | F.col("doc_comment").ilike(like)).orderBy("name", "id").limit(k)
    w = W.partitionBy()
    return top.select("id", (1 - (F.row_number().over(w.orderBy("name", "id")) - 1) / F.count("*").over(w)).alias("score"))


def hybrid(keyword: DataFrame, vector: DataFrame, calls: DataFrame, k: int, weights: tuple[float, float, float] = (0.3, 0.5, 0.2), seeds: int = 5, each: int = 3) -> DataFrame:
    """(id, score): keyword, vector and graph scores combined.

    The first ``seeds`` hits (keyword hits first) pass half their score on to their first ``each`` callers and callees
    by id; a node keeps the greatest of what it is passed.
    """
    hits = keyword.select("id", "score", F.lit(0).alias("src")).unionByName(vector.select("id", "score", F.lit(1).alias("src")))
    seed = hits.orderBy("src", F.desc("score"), "id").limit(seeds).select(F.col("id").alias("seed"), "score")
    out = lambda a, b: calls.join(F.broadcast(seed), F.col(a) == F.col("seed")).select("seed", "score", F.col(b).alias("id"), F.lit(a).alias("side")).distinct()
    near = out("dst", "src").unionByName(out("src", "dst"))
    near = near.withColumn("r", F.row_number().over(W.partitionBy("seed", "side").orderBy("id"))).where(F.col("r") <= each)
    graph = near.groupBy("id").agg((F.max("score") * 0.5).alias("g"))
    both = keyword.select("id", F.col("score").alias("kw")).join(vector.select("id", F.col("score").alias("vec")), "id", "full_outer").join(graph, "id", "full_outer")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return both.select("id", F.round(z("kw") * weights[0] + z("vec") * weights[1] + z("g") * weights[2], 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)
