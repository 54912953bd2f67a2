"""From source files to a graph: discover, parse, resolve names and imports across files, classify, save."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.rules import classify_layers
from graphloom.sources import files as S
from graphloom.storage import cut


def _last(name: str) -> Column:
    """The part of a called name that can be a symbol's: behind the last dot, colon or arrow."""
    return F.regexp_extract(F.rtrim(F.col(name), F.lit("!")), r"([\w$~]+)$", 1)


def graph(files: DataFrame) -> dict[str, DataFrame]:
    """The tables symbols, edges and files of (path, language, text), all over written tables.

    A symbol's id is ``path:name:start_line``. An edge starts at the first symbol of its name in the file. Its target
    is, in this order, a symbol of the file, one of a file that the file imports, the only one of that name in the
    repository, else the bare name. Imports of files become one edge from the first symbol of the file to the first
    exported symbol of the imported one, or to the module's name. Edges that repeat are one, with their first line.
    Files without symbols stay in files.
    """
    parsed = cut(S.parse_files(files), "parsed")
    flat = parsed.select("path", "language", F.inline("symbols"))
    s = flat.withColumn("id", F.concat_ws(":", "path", "name", "start_line")).groupBy("id").agg(*[F.min_by(c, F.struct("end_line", "start_col")).alias(c) for c in flat.columns])
    s = cut(s, "scanned-symbols")
    raw = parsed.select("path", F.inline("relations"))
    specs = parsed.select("path", F.explode("imports").alias("i")).select("path", F.col("i.source").alias("spec")).distinct()
    found = cut(S.resolve_imports(specs, parsed.select("path")), "scanned-imports")

    first = s.groupBy("path", F.col("name").alias("source")).agg(F.min_by("id", F.struct("start_line", "id")).alias("src"))
    edges = raw.where("kind <> 'imports'").join(first, ["path", "source"]).select("path", "src", "kind", "line", "target", _last("target").alias("name"), F.substring_index("path", "/", 1).alias("repo"))
    local = s.groupBy("path", "name").agg(F.min_by("id", F.struct("start_line", "id")).alias("local"))
    seen = found.join(s.where("exported").select(F.col("path").alias("target"), "name", "id"), "target").groupBy("path", "name").agg(F.min("id").alias("imported"))
    only = s.groupBy(F.substring_index("path", "/", 1).alias("repo"), "name").agg(F.min("id").alias("only"), F.max("id").alias("other")).where("only = other").drop("other")
    edges = edges.join(local, ["path", "name"], "left").join(seen, ["path", "name"], "left").join(only, ["repo", "name"], "left")
    edges = edges.select("src", F.coalesce("local", "imported", "only", "target").alias("dst"), "kind", "line")

    head = s.groupBy("path").agg(F.min_by("id", F.struct("start_line", "id")).alias("src"))
    open_ = s.where("exported").groupBy("path").agg(F.min_by("id", F.struct("start_line", "id")).alias("dst")).withColumnRenamed("path", "target")
    i = parsed.select("path", F.inline("imports")).select("path", F.col("source").alias("spec"), "line").groupBy("path", "spec").agg(F.min("line").alias("line"))
    i = i.join(head, "path").join(found, ["path", "spec"], "left").join(open_, "target", "left").select("src", F.coalesce("dst", "spec").alias("dst"), F.lit("imports").alias("kind"), "line")
    edges = edges.unionByName(i).groupBy("src", "dst", "kind").agg(F.min("line").alias("line"))
    edges = cut(edges.select(F.concat_ws("->", "src", F.concat_ws(":", "kind", "dst")).alias("id"), "src", "dst", "kind", "line"), "scanned-edges")

    now = F.lit("2000-01-01").cast("timestamp")
    imported = parsed.select("path", "language", F.array_distinct(F.transform("imports", lambda x: x["source"])).alias("imports"), now.alias("parsed_at"))
    layers = classify_layers(s.select("id", "name", "kind", F.col("path").alias("file_path"), "source_code", now.alias("updated_at")), imported).select("id", "layer")
    symbols = s.join(layers, "id").select("id", "name", "kind", F.col("path").alias("file_path"), "start_line", "end_line", "start_col", "end_col", "source_code", "language", "layer", F.col("doc").alias("doc_comment"), "complexity", "exported", F.when(F.col("parent").isNotNull(), F.create_map(F.lit("parent"), "parent")).alias("metadata"))
    return {"symbols": symbols, "edges": edges, "files": imported.drop("parsed_at")}


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes the tables of a graph under ``folder``, symbols by layer."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy("layer") if name == "symbols" else w).parquet(f"{folder}/{name}.parquet")


def rescan(known: dict[str, DataFrame], files: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """The graph after a change: ``files`` are new or changed, ``gone`` (path) left.

    Only the files given are parsed. Symbols and edges of changed and gone files are replaced; edges from unchanged
    files into changed ones stay and are bound again, to the symbol that has the id's path and name now, else to the
    bare name.
    """
    new = graph(files)
    out = files.select("path").unionByName(gone.select("path")).distinct()
    at = lambda c: F.regexp_extract(c, r"^(.*):[^:]*:\d+$", 1)
    kept = known["symbols"].join(out.withColumnRenamed("path", "file_path"), "file_path", "left_anti").select(*new["symbols"].columns)
    symbols = cut(kept.unionByName(new["symbols"]), "rescanned-symbols")
    old = known["edges"].withColumn("path", at("src")).join(out, "path", "left_anti").drop("path")
    stale = old.withColumn("path", at("dst")).join(out, "path", "left_semi").withColumn("name", F.regexp_extract("dst", r":([^:]*):\d+$", 1))
    home = symbols.groupBy(F.col("file_path").alias("path"), "name").agg(F.min_by("id", F.struct("start_line", "id")).alias("now"))
    bound = stale.join(home, ["path", "name"], "left").select("src", F.coalesce("now", "name").alias("dst"), "kind", "line")
    bound = bound.select(F.concat_ws("->", "src", F.concat_ws(":", "kind", "dst")).alias("id"), "src", "dst", "kind", "line")
    fresh = old.join(stale.select("id"), "id", "left_anti").select("id", "src", "dst", "kind", "line")
    return {"symbols": symbols, "edges": cut(fresh.unionByName(bound).unionByName(new["edges"]), "rescanned-edges"), "files": known["files"].join(out, "path", "left_anti").select(*new["files"].columns).unionByName(new["files"])}
