"""Writers: tables, upserts and exports. Everything is written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite", form: str = "parquet") -> None:
    """A table as parquet, ORC, JSON or CSV; nested columns of a CSV become JSON text."""
    if form == "csv":
        df = df.select(*[F.to_json(c).alias(c) if k.startswith(("array", "map", "struct")) else F.col(c) for c, k in df.dtypes])
    w = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    (w.option("header", True) if form == "csv" else w).format(form).save(path)


def upsert(table: DataFrame, rows: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """``table`` with ``rows`` put in by key. With ``columns`` only those change on rows that are there already.
    Keys must be unique in ``rows``; a null key matches nothing."""
    if columns is None:
        return table.join(rows.select(key), key, "left_anti").unionByName(rows.select(*table.columns))
    new = rows.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in rows.columns if c != key], F.lit(True).alias("__new"))
    both = table.withColumn("__old", F.lit(True)).join(new, F.col(key) == F.col("__k"), "full_outer")
    pick = lambda c: F.when(F.col("__new") & (F.col("__old").isNull() | F.lit(c in columns)), F.col(f"__{c}")).otherwise(F.col(c))
    return both.select(*[F.coalesce(key, "__k").alias(key) if c == key else pick(c).alias(c) for c in table.columns])


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` and those of ``rows`` whose key it hasn't; of rows that repeat a key one is kept."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(*table.columns))


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, path: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without what lies in ``files`` (column ``path``); edges go with either end."""
    gone = nodes.join(files.select(F.col("path").alias(path)), path, "left_semi").select("id")
    left = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(files.select(F.col("path").alias(path)), path, "left_anti"), left.select(*edges.columns)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): one JSON line for each node and edge."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*sorted(nodes.columns))).alias("json"))
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*sorted(edges.columns))).alias("json")))


#: The brackets of each kind in a flow chart.
SHAPES = {"class": ("([", "])"), "function": ("[", "]"), "method": ("[", "]"), "interface": ("{", "}"), "enum": ("{{", "}}"), "type": ("[[", "]]")}


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, line): a flow chart as text lines, nodes first; only edges between the nodes."""
    from graphloom.operators.relations import induced

    mark = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9]", "_")
    opening, closing = F.lit("("), F.lit(")")
    for kind, (a, b) in SHAPES.items():
        opening, closing = F.when(F.col("kind") == kind, a).otherwise(opening), F.when(F.col("kind") == kind, b).otherwise(closing)
    n = nodes.select(F.lit(1).alias("place"), F.concat(F.lit("  "), mark(F.col("id")), opening, F.lit('"'), F.translate("name", '"', "'"), F.lit('"'), closing).alias("line"))
    e = induced(edges, nodes).select(F.lit(2).alias("place"), F.concat(F.lit("  "), mark(F.col("src")), F.lit(" -->|"), F.col("kind"), F.lit("| "), mark(F.col("dst"))).alias("line"))
    head = nodes.sparkSession.createDataFrame([(0, "graph TD")], "place int, line string")
    return head.unionByName(n).unionByName(e)


def notes(nodes: DataFrame) -> DataFrame:
    """(path, note): a page for each file that lists its symbols, exported ones first, then by line. The symbols of a
    file are gathered; a file's list is bounded by the file itself."""
    item = F.struct((~F.coalesce("exported", F.lit(False))).alias("x"), "start_line", "id", F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.coalesce("kind", F.lit("?")), F.lit(") line "), F.col("start_line").cast("string")).alias("t"))
    g = nodes.groupBy("file_path").agg(F.array_sort(F.collect_list(item)).alias("l"))
    return g.select(F.col("file_path").alias("path"), F.concat(F.lit("# "), F.col("file_path"), F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n")).alias("note"))


def clear(spark, path: str) -> int:  # noqa: ANN001
    """Empties a table at ``path`` but keeps its columns; returns how many rows it had."""
    old = spark.read.parquet(path)
    n, schema = old.count(), old.schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return n


#: The columns of the annotation log; ``action`` is add, update, resolve or delete.
EVENT_COLUMNS = ("id", "symbol_id", "user_id", "content", "type", "action", "at")


def annotation_id(symbol, user, at):  # noqa: ANN001, ANN201
    """Symbol, user and the time in milliseconds, as an id."""
    return F.concat_ws(":", symbol, user, (F.unix_micros(at.cast("timestamp")) / 1000).cast("long").cast("string"))


def annotation_view(log: DataFrame) -> DataFrame:
    """(id, symbol_id, user_id, content, type, resolved): annotations as an append-only log of events leaves them.

    The last event that states a field counts for it; a resolve marks, an update keeps the mark, a delete takes the
    annotation away and a later add brings it back. Events of one time count in the order add, update, resolve, delete.
    """
    place = F.struct("at", F.array_position(F.array(*[F.lit(x) for x in ("add", "update", "resolve", "delete")]), F.col("action")))
    last = lambda c, when=None: F.max_by(c, F.when(when if when is not None else F.col(c).isNotNull(), place))
    rows = log.where("id IS NOT NULL").groupBy("id").agg(*[last(c).alias(c) for c in ("symbol_id", "user_id", "content", "type")], F.max(F.when(F.col("action") == "resolve", place)).alias("__r"), F.max(F.when(F.col("action") == "add", place)).alias("__a"), F.max(F.when(F.col("action") == "delete", place)).alias("__d"))
    alive = F.col("__d").isNull() | (F.col("__a") > F.col("__d"))
    return rows.where(F.coalesce(alive, F.lit(True)) & F.col("__a").isNotNull()).select("id", "symbol_id", "user_id", "content", "type", F.coalesce(F.col("__r") > F.col("__a"), F.lit(False)).alias("resolved"))


def put_meta(meta: DataFrame, values: dict[str, str | None]) -> DataFrame:
    """(key, value) with ``values`` set; others stay."""
    new = meta.sparkSession.createDataFrame(list(values.items()), "key string, value string")
    return upsert(meta.select("key", "value"), new, "key")


def graph_csv(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, line): nodes and then edges as lines of CSV with a head each; quotes are doubled."""
    cell = lambda c: F.when(F.col(c).isNull(), "").when(F.col(c).cast("string").rlike("[\",\\n\\r]"), F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), '"', '""'), F.lit('"'))).otherwise(F.col(c).cast("string"))
    rows = lambda df, place: df.select(F.lit(place).alias("place"), F.concat_ws(",", *[cell(c) for c in df.columns]).alias("line"))
    heads = nodes.sparkSession.createDataFrame([(0, ",".join(nodes.columns)), (2, ",".join(edges.columns))], "place int, line string")
    return heads.unionByName(rows(nodes, 1)).unionByName(rows(edges, 3))


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(row, column, n): the adjacency matrix of the nodes in coordinates, by their place in the order of ids; cells of
    nodes without an edge are absent."""
    from graphloom.operators.ordering import global_rank
    from graphloom.operators.relations import induced

    at = global_rank(nodes.select("id").distinct(), ["id"], "place").select("id", (F.col("place") - 1).cast("long").alias("place"))
    e = induced(edges, nodes).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return e.join(at.select(F.col("id").alias("src"), F.col("place").alias("row")), "src").join(at.select(F.col("id").alias("dst"), F.col("place").alias("column")), "dst").select("row", "column", "n")


def weighted_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with ``weight`` (known callers, 0 included) and the edges between them: what a client draws."""
    from graphloom.operators.relations import induced, known_counts

    w = known_counts(edges.where("kind = 'calls'"), nodes, "dst", "src", "weight")
    return nodes.join(w, "id", "left").withColumn("weight", F.coalesce("weight", F.lit(0)).cast("long")), induced(edges, nodes)


def _escaped(c):  # noqa: ANN001, ANN202
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def html_page(nodes: DataFrame) -> DataFrame:
    """(place, layer, id, line): a page that lists the nodes by layer, line by line in this order."""
    n = nodes.withColumn("layer", F.coalesce("layer", F.lit("unknown")))
    counts = n.groupBy("layer").agg(F.count("*").alias("n"))
    head = counts.select(F.lit(1).alias("place"), "layer", F.lit("").alias("id"), F.concat(F.lit("<h2>"), _escaped(F.col("layer")), F.lit(" ("), F.col("n").cast("string"), F.lit(")</h2>")).alias("line"))
    item = n.select(F.lit(1).alias("place"), "layer", "id", F.concat(F.lit("<li><b>"), _escaped(F.col("name")), F.lit("</b> <i>"), _escaped(F.col("kind")), F.lit("</i></li>")).alias("line"))
    ends = nodes.sparkSession.createDataFrame([(0, "", "", "<html><body>"), (2, "", "", "</body></html>")], "place int, layer string, id string, line string")
    return ends.unionByName(head).unionByName(item)


def directory_notes(nodes: DataFrame) -> DataFrame:
    """(dir, note): a page for each directory at any height: how many files and symbols lie below, by layer."""
    from graphloom.functions.scalars import ancestors

    n = nodes.where("file_path IS NOT NULL").select("file_path", F.coalesce("layer", F.lit("unknown")).alias("layer"), F.explode(ancestors(F.col("file_path"))).alias("dir"))
    c = n.groupBy("dir", "layer").agg(F.count("*").alias("n"))
    f = n.groupBy("dir").agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("symbols"))
    lines = c.groupBy("dir").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col("layer"), F.lit(": "), F.col("n").cast("string")))), "\n").alias("layers"))
    return f.join(lines, "dir").select("dir", F.concat(F.lit("# "), F.col("dir"), F.lit("\n\n"), F.col("files").cast("string"), F.lit(" files, "), F.col("symbols").cast("string"), F.lit(" symbols\n"), F.col("layers")).alias("note"))


#: The sections of a file's documentation, in order.
SECTIONS = ("class", "interface", "function", "method", "type", "enum", "constant", "variable")


def skeleton(nodes: DataFrame) -> DataFrame:
    """(path, doc): documentation to be filled in for each file: its symbols by kind, each with its signature and what
    it documents of itself. A file's symbols are gathered, which the file bounds; kinds without a section are left out."""
    place = F.array_position(F.array(*[F.lit(x) for x in SECTIONS]), F.col("kind"))
    n = nodes.where("file_path IS NOT NULL").withColumn("place", place).where("place > 0")
    text = F.concat(F.lit("### "), F.col("name"), F.lit("\n`"), F.coalesce("signature", F.lit("")), F.lit("`\n"), F.coalesce("about", F.lit("_undocumented_")))
    part = n.groupBy("file_path", "place", "kind").agg(F.array_sort(F.collect_list(F.struct("start_line", "id", text.alias("t")))).alias("l"))
    part = part.select("file_path", "place", F.concat(F.lit("## "), F.col("kind"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n")).alias("t"))
    doc = part.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("place", "t"))).alias("l"))
    return doc.select(F.col("file_path").alias("path"), F.concat(F.lit("# "), F.col("file_path"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n")).alias("doc"))


def team_import(annotations: DataFrame, incoming: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, symbol_id, user_id, content, type): ``annotations`` and those of ``incoming`` that are new and whose symbol exists."""
    cols = ["id", "symbol_id", "user_id", "content", "type"]
    known = incoming.select(*cols).join(nodes.select(F.col("id").alias("symbol_id")).distinct(), "symbol_id", "left_semi").select(*cols)
    return insert_new(annotations.select(*cols), known, "id")
