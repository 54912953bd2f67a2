"""Queries of the training-data operators, with their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.versions import latest
from graphloom.session import ship
from graphloom.storage import spread


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df) if name in ("symbols", "documents") else df


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm.generated import classify

    return classify(_read(spark, d, "files"), _read(spark, d, "symbols"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_reasons(spark, d).where("reason IS NOT NULL").select("path")


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm.knn import nearest

    return nearest(_read(spark, d, "symbol_embeddings"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm.knn import neighbour_pairs

    return neighbour_pairs(_read(spark, d, "symbol_embeddings"))


def _code(spark: SparkSession, d: str, least: int) -> DataFrame:
    """Current symbols whose code has more than ``least`` characters; only their texts are shuffled."""
    long = F.when(F.length("source_code") > least, F.col("source_code"))
    return latest(_read(spark, d, "symbols"), "id", "updated_at", long.alias("source_code"), "start_line").where("source_code IS NOT NULL")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm.split import split_items

    return split_items(_code(spark, d, 2400), "id", "source_code", "start_line")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm.split import bodies

    parts = F.size(bodies(F.col("source_code")))
    return latest(_read(spark, d, "symbols"), "id", "updated_at", F.when(F.col("source_code").isNotNull(), parts).alias("n")).where("n > 1").select("id")


def p4_lines(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm.credentials import find_credentials

    return find_credentials(_read(spark, d, "symbols"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_lines(spark, d).select("id", "line_no")


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm.credentials import redacted

    return redacted(_read(spark, d, "symbols"))


def p4_checked(spark: SparkSession, d: str) -> DataFrame:
    """Redaction held against its purpose: nothing found again, nothing else changed."""
    from graphloom.llm.credentials import redaction_check

    return redaction_check(_read(spark, d, "symbols"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm.docpairs import doc_pairs

    symbols = _read(spark, d, "symbols")
    code = F.when(F.col("kind").isin("function", "method"), F.col("source_code"))
    return doc_pairs(symbols).join(latest(symbols, "id", "updated_at", "name", "language", code.alias("code")), "id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """A description taken over from an overridden method is none of the symbol's own, so it is no case."""
    from graphloom.llm.docpairs import doc_pairs

    return doc_pairs(_read(spark, d, "symbols")).where("from_id = id").select("id")


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm.neardup import near_duplicates

    return near_duplicates(_read(spark, d, "symbols"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pairs(spark, d).select("id_a", "id_b")


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm.neardup import duplicate_classes

    return duplicate_classes(_read(spark, d, "symbols"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm.bpe import encode_corpus

    return encode_corpus(_read(spark, d, "documents"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Ids decoded again, id by id, and compared with the text; null texts count as empty."""
    from graphloom.llm.bpe import decode_corpus, encode_corpus

    docs = _read(spark, d, "documents")
    back = decode_corpus(encode_corpus(docs)).withColumnRenamed("text", "back")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(back, "doc_id").select("doc_id", (F.col("text") == F.col("back")).alias("same"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm.bpe import count_tokens
    from graphloom.storage import cut

    return cut(count_tokens(_read(spark, d, "documents")), "sizes")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm.packing import pack

    return pack(_sizes(spark, d))


def p8_certificate(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm.packing import certificate, pack

    sizes = _sizes(spark, d)
    return certificate(sizes, pack(sizes))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm.spans import shared_spans

    return shared_spans(_read(spark, d, "documents"))


def p9_share(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm.spans import shared_share

    return shared_share(_read(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_reasons, p2_found, p2_neighbours, p3_found, p3_pieces, p4_found, p4_lines, p4_redacted, p4_checked, p5_found, p5_pairs, p6_found, p6_pairs, p6_classes, p7_ids, p7_roundtrip, p8_containers, p8_certificate, p9_found, p9_share)}


_CURRENT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM symbols) WHERE rn = 1)"


_KNN = """WITH e AS (SELECT symbol_id AS id, arg_max(embedding, created_at) AS v FROM symbol_embeddings WHERE model = 'local-hash' AND len(embedding) = 256 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
p AS (SELECT a.id AS q, b.id AS x, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM e a JOIN e b ON a.id <> b.id), r AS (SELECT q, x, row_number() OVER (PARTITION BY q ORDER BY s DESC, x) AS rn FROM p)
SELECT DISTINCT least(q, x) AS id_a, greatest(q, x) AS id_b FROM r WHERE rn <= 5"""

_NEAR = """WITH t AS (SELECT id, regexp_extract_all(source_code, '[A-Za-z0-9_]+') AS w FROM {current} AS s WHERE kind IN ('function', 'method') AND source_code IS NOT NULL),
g AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 40)), n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
SELECT {columns} FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k::DOUBLE / (x.n + y.n - k) >= 0.7"""

_SPANS = """WITH w AS (SELECT doc_id, i, hash(substr(text, i + 1, 300)) AS h, md5(substr(text, i + 1, 300)) AS m FROM (SELECT doc_id, text, unnest(range(0, length(text) - 299)) AS i FROM documents WHERE length(text) >= 300)),
s AS (SELECT h, m FROM w GROUP BY 1, 2 HAVING min(doc_id) <> max(doc_id)), k AS (SELECT w.doc_id, w.i FROM w JOIN s ON s.h = w.h AND s.m = w.m),
b AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 300 THEN 1 ELSE 0 END AS new FROM k), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM b)
SELECT doc_id, min(i)::INTEGER AS span_start, (max(i) + 300)::INTEGER AS span_end FROM g GROUP BY doc_id, island"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _KNN,
        "p3_found": f"SELECT id FROM {_CURRENT} AS s WHERE length(source_code) > 2400",
        "p4_checked": f"SELECT id, true AS clean, true AS kept FROM {_CURRENT} AS s",
        "p6_found": _NEAR.format(current=_CURRENT, columns="id_a, id_b"),
        "p6_pairs": _NEAR.format(current=_CURRENT, columns="id_a, id_b, k::DOUBLE / (x.n + y.n - k) AS similarity"),
        "p7_roundtrip": "SELECT doc_id, true AS same FROM documents",
        "p9_found": _SPANS,
        "p9_share": f"SELECT d.doc_id, coalesce(length(d.text), 0)::INTEGER AS n_chars, coalesce(sum(x.span_end - x.span_start), 0)::BIGINT AS shared_chars FROM documents d LEFT JOIN ({_SPANS}) x ON x.doc_id = d.doc_id GROUP BY 1, 2",
    }
