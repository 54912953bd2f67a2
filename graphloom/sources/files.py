"""Files as tables: discovery, filters, facts, change detection, macros, parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File endings and the language they stand for.
LANGUAGES = {".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".ino": "cpp", ".kt": "kotlin", ".swift": "swift"}
SKIPPED = r"(^|/)(node_modules|\.git|dist|build|out|coverage|\.next|target|vendor|__pycache__|\.venv)(/|$)"


def language(path: Column) -> Column:
    """The language of a path by its ending; null if unknown."""
    m = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(m, F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)))


def discover(spark: SparkSession, root: str, most_bytes: int = 512_000, skip: str = SKIPPED) -> DataFrame:
    """(path, language, size, line_count, hash, text) of the source files under ``root``; no cap on their number.

    Paths are relative to ``root``. Files of unknown languages, in skipped directories, with paths over 260
    characters or over ``most_bytes`` are left out before they are read, files with NUL bytes (binary ones) after;
    files that vanish or can't be read are passed over.
    """
    base = re.escape(root.rstrip("/"))
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(root)
    f = f.withColumn("rel", F.regexp_replace("path", rf"^(?:file:)?/*?(?:.*?){base}/", ""))
    f = f.where((F.col("length") <= most_bytes) & (F.length("rel") <= 260) & ~F.col("rel").rlike(skip) & language(F.col("rel")).isNotNull())
    text = F.col("content").cast("string")
    f = f.where(~text.contains("\0"))
    return f.select(F.col("rel").alias("path"), language(F.col("rel")).alias("language"), F.col("length").alias("size"), (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).alias("line_count"), F.sha2("content", 256).alias("hash"), text.alias("text"))


def changes(known: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status): new, changed, same or gone, by hash; a null hash is never the same."""
    a = known.select("path", F.col("hash").alias("old"), F.lit(True).alias("was"))
    b = now.select("path", F.col("hash").alias("new"), F.lit(True).alias("is"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


MACRO = r"(?m)^[ \t]*([A-Z][A-Z0-9_]{2,})[ \t]+((?:const[ \t]+)?(?:unsigned[ \t]+|struct[ \t]+)?\w+[ \t*]+)(\w+)[ \t]*\(([^;{}]*)\)[ \t\r\n]*;"


def macro_declarations(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, macro, name): exported declarations behind a macro in C and C++ files, each name once a file."""
    c = files.where(language(F.col(path)).isin("c", "cpp") & (F.length(text) <= 1_000_000))
    hits = c.select(path, F.explode(F.regexp_extract_all(text, F.lit(MACRO), F.lit(0))).alias("h"))
    return hits.select(path, F.regexp_extract("h", MACRO, 1).alias("macro"), F.regexp_extract("h", MACRO, 3).alias("name")).dropDuplicates([path, "name"])


def _struct(**fields: str) -> str:
    return "struct<" + ",".join(f"{k}:{v}" for k, v in fields.items()) + ">"


PARSED = _struct(
    symbols="array<" + _struct(name="string", kind="string", start_line="int", end_line="int", start_col="int", end_col="int", parent="string", doc="string", exported="boolean", complexity="int", source_code="string") + ">",
    relations="array<" + _struct(source="string", target="string", kind="string", line="int") + ">",
    imports="array<" + _struct(source="string", names="array<string>", wildcard="boolean", line="int") + ">",
)


def parse_files(files: DataFrame, path: str = "path", text: str = "text", lang: str = "language") -> DataFrame:
    """(path, language, symbols, relations, imports) of every file; files that don't parse have empty arrays.

    One Arrow pass reads each text once; explode what is needed of the three.
    """

    @F.pandas_udf(PARSED)
    def run(texts, langs):  # noqa: ANN001, ANN202
        import pandas as pd

        from graphloom.sources.parser import parse_text

        rows = [parse_text(t, x) for t, x in zip(texts, langs, strict=True)]
        return pd.DataFrame({"symbols": [[s._asdict() for s in p.symbols] for p in rows], "relations": [[r._asdict() for r in p.relations] for p in rows], "imports": [[i._asdict() for i in p.imports] for p in rows]})

    return files.select(F.col(path).alias("path"), F.col(lang).alias("language"), run(F.col(text), F.col(lang)).alias("p")).select("path", "language", "p.*")


def parse(files: DataFrame, path: str = "path", text: str = "text", lang: str = "language") -> DataFrame:
    """(path, name, kind, start_line, end_line, start_col, end_col, parent, doc, exported, complexity, source_code): the symbols of every file."""
    return parse_files(files, path, text, lang).select("path", F.inline("symbols"))


def rebuilt(symbols: DataFrame) -> DataFrame:
    """(path, language, text): files put together again from the current code of their outermost symbols, by line.

    Methods and properties are left out, as their class has them; a file's code is gathered, which the file bounds.
    """
    from graphloom.operators.versions import latest

    outer = F.when(~F.coalesce("kind", F.lit("")).isin("method", "property"), F.col("source_code"))
    s = latest(symbols, "id", "updated_at", F.col("file_path").alias("path"), "language", "start_line", outer.alias("code")).where("path IS NOT NULL AND code IS NOT NULL")
    code = F.array_sort(F.collect_list(F.struct("start_line", "id", "code")))
    return s.groupBy("path").agg(F.min("language").alias("language"), F.array_join(F.transform(code, lambda x: x["code"]), "\n").alias("text"))


#: Endings tried in turn on an import path, alone and as an index file.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".py", ".c", ".cpp", ".h", ".hpp", ".go", ".rs")
PROBES = (*ENDINGS, *(f"/index{x}" for x in ENDINGS[1:]), "/__init__.py", "/mod.rs")


def relative_path(path: Column, spec: Column) -> Column:
    """The path that a relative ``spec`` names from the file ``path``, without ``.`` and ``..``; null for other specs.

    Dots of Python (``.a``, ``..a.b``) count as directories, one dot being the file's own.
    """
    dots = F.regexp_extract(spec, r"^(\.+)[A-Za-z_]?", 1)
    python = spec.rlike(r"^\.+(?:[A-Za-z_]|$)") & ~spec.contains("/")
    up = F.concat(F.repeat(F.lit("../"), F.length(dots) - 1), F.translate(F.substr(spec, F.length(dots) + 1), ".", "/"))
    whole = F.concat_ws("/", F.nullif(F.regexp_replace(path, r"/?[^/]*$", ""), F.lit("")), F.when(python, up).otherwise(spec))
    parts = F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != "."))
    step = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.when(spec.startswith("."), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, spec, target): the file that each import of (path, spec) names; imports that name none are left out.

    Relative paths are probed with each ending in turn; others by their last part alone, as include files and modules
    are found by search paths: a file of that name in the same directory, else the least in the same repository.
    """
    i = imports.where("path IS NOT NULL AND spec IS NOT NULL").select("path", "spec").distinct()
    known = files.where("path IS NOT NULL").select("path").distinct()
    base = i.withColumn("base", relative_path(F.col("path"), F.col("spec"))).where("base IS NOT NULL")
    base = base.withColumn("base", F.regexp_replace("base", r"\.(?:js|jsx|mjs)$", ""))
    tries = F.array(*[F.struct(F.lit(r).alias("rank"), F.concat("base", F.lit(x)).alias("target")) for r, x in enumerate(PROBES)])
    near = base.select("path", "spec", F.inline(tries)).join(known.select(F.col("path").alias("target")), "target").groupBy("path", "spec").agg(F.min_by("target", "rank").alias("target"))
    module = F.regexp_replace(F.regexp_replace("spec", r"^(?:crate|self|super)::", ""), r"::", "/")
    module = F.when(F.col("spec").rlike(r"\.(?:h|hh|hpp|hxx|c|cc|cpp)$"), F.regexp_replace("spec", r"\.[^./]*$", "")).when(module.contains("/"), module).otherwise(F.translate(module, ".", "/"))
    stem = lambda c: F.regexp_extract(F.regexp_replace(c, r"/(?:index|__init__|mod)\.[^./]*$", ""), r"([^/]+?)(?:\.[^./]*)?$", 1)
    repo = lambda c: F.substring_index(c, "/", 1)
    far = i.where(~F.col("spec").startswith(".")).select("path", "spec", F.regexp_extract(module, r"([^/]+)$", 1).alias("stem"), repo(F.col("path")).alias("repo"))
    named = known.select(stem(F.col("path")).alias("stem"), repo(F.col("path")).alias("repo"), F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), F.col("path").alias("target"))
    same_dir = named.groupBy("stem", "dir").agg(F.min("target").alias("near"))
    anywhere = named.groupBy("stem", "repo").agg(F.min("target").alias("any"))
    far = far.withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")).join(same_dir, ["stem", "dir"], "left").join(anywhere, ["stem", "repo"], "left")
    far = far.select("path", "spec", F.coalesce("near", "any").alias("target")).where("target IS NOT NULL")
    return near.unionByName(far).where("target <> path")
