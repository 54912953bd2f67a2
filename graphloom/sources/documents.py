"""Structured files as tables: dependency manifests, build configurations, step traces, snapshots, settings."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.scalars import basename

PAIRS = T.MapType(T.StringType(), T.StringType())
PACKAGE = T.StructType([T.StructField("dependencies", PAIRS), T.StructField("devDependencies", PAIRS)])


def manifests(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, dep, version, dev): what package.json, requirements.txt, go.mod, Cargo.toml and platformio.ini declare.

    Text that isn't in the form of its file's name declares nothing.
    """
    f = files.where(F.col(text).isNotNull()).select(F.col(path).alias("path"), F.col(text).alias("t"), basename(F.col(path)).alias("b"))
    js = f.where("b = 'package.json'").select("path", F.from_json("t", PACKAGE).alias("j"))
    part = lambda c, dev: js.select("path", F.explode(f"j.{c}").alias("dep", "version"), F.lit(dev).alias("dev"))
    out = part("dependencies", False).unionByName(part("devDependencies", True))

    def lines(name: str, section: str | None, pattern: str, dev: bool = False) -> DataFrame:
        body = F.regexp_extract("t", section, 1) if section else F.col("t")
        hit = f.where(f"b = '{name}'").select("path", F.explode(F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).alias("h"))
        return hit.select("path", F.regexp_extract("h", pattern, 1).alias("dep"), F.nullif(F.regexp_extract("h", pattern, 2), F.lit("")).alias("version"), F.lit(dev).alias("dev"))

    toml = r"(?m)^([\w-]+)[ \t]*=[ \t]*(?:\"([^\"]*)\"|\{[^\n}]*\})"
    return (
        out.unionByName(lines("requirements.txt", None, r"(?m)^[ \t]*([A-Za-z_][\w.-]*)(?:\[[^\]\n]*\])?[ \t]*(?:[=<>~!]=?[ \t]*([\w.*]+))?"))
        .unionByName(lines("go.mod", None, r"(?m)^[ \t]*(?:require[ \t]+)?([\w-]+\.[\w./-]+)[ \t]+(v[\w.+-]+)"))
        .unionByName(lines("Cargo.toml", r"(?s)(?:^|\n)\[dependencies\]\n(.*?)(?:\n\[|$)", toml))
        .unionByName(lines("Cargo.toml", r"(?s)(?:^|\n)\[dev-dependencies\]\n(.*?)(?:\n\[|$)", toml, True))
        .unionByName(lines("platformio.ini", r"(?s)(?:^|\n)lib_deps[ \t]*=[ \t]*(.*?)(?:\n\S|$)", r"(?m)^[ \t]*([\w@/ .-]*[\w-])(?:[ \t]*@[ \t]*([\w^~.<>=-]+))?[ \t]*$"))
        .where("dep <> ''")
    )


#: Parts of names of vendor and system libraries.
VENDOR_LIBRARIES = ("arduino", "esp-idf", "esp32", "stm32", "hal", "cmsis", "freertos", "lvgl", "mbed", "zephyr", "nordic", "nrf")


def build_config(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, type, name, flags, sources, vendor): what build files tell; ``vendor`` if a known library is named."""
    b = basename(F.col(path))
    kind = F.when(b == "platformio.ini", "platformio").when(b == "CMakeLists.txt", "cmake").when(b.isin("Makefile", "GNUmakefile"), "make").when(b == "Cargo.toml", "cargo").when(b.rlike(r"^Kbuild$|\.mk$"), "kbuild").when(b.rlike(r"\.bb(append)?$"), "yocto").when(b == "Config.in", "buildroot")
    x = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    name = F.coalesce(x(r"(?i)project[ \t]*\([ \t]*\"?([\w-]+)"), x(r"(?m)^\[env:([\w-]+)\]"), x(r"(?ms)^\[package\].*?^name[ \t]*=[ \t]*\"([^\"]+)\""), x(r"(?m)^(?:TARGET|PROJECT)[ \t]*[:?]?=[ \t]*(\S+)"))
    vendor = F.exists(F.array(*[F.lit(v) for v in VENDOR_LIBRARIES]), lambda v: F.lower(F.col(text)).contains(v))
    rows = files.where(F.col(text).isNotNull()).select(F.col(path).alias("path"), kind.alias("type"), name.alias("name"), F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\w-])(-[DWOfmIL][\w=./+-]+)"), F.lit(1))).alias("flags"), F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\w./-]+\.(?:c|cc|cpp|cxx|rs|S))\b"), F.lit(1))).alias("sources"), vendor.alias("vendor"))
    return rows.where("type IS NOT NULL")


STEP = T.StructType([T.StructField("name", T.StringType()), T.StructField("does", T.StringType()), T.StructField("from_steps", T.ArrayType(T.StringType())), T.StructField("assets", T.ArrayType(T.StringType())), T.StructField("deprecated", T.BooleanType())])
TRACE = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("version", T.StringType()), T.StructField("steps", T.MapType(T.StringType(), STEP))])
STATUS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("message", T.StringType())])
RUN = T.StructType([T.StructField("name", T.StringType()), T.StructField("started_at", T.StringType()), T.StructField("steps", T.MapType(T.StringType(), T.StructType([T.StructField("status", STATUS)])))])


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Multi-line JSON files with a given schema; files that don't parse are skipped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def trace_steps(traces: DataFrame) -> DataFrame:
    """(trace, step, name, upstream, downstream, assets): the steps with what they follow and what follows them."""
    s = traces.select(F.col("id").alias("trace"), F.explode("steps").alias("step", "s"))
    up = s.select("trace", "step", F.explode("s.from_steps").alias("source"))
    down = up.groupBy("trace", F.col("source").alias("step")).agg(F.array_sort(F.collect_set("step")).alias("downstream"))
    empty = F.array().cast("array<string>")
    return s.join(down, ["trace", "step"], "left").select("trace", "step", "s.name", F.coalesce("s.from_steps", empty).alias("upstream"), F.coalesce("downstream", empty).alias("downstream"), F.coalesce("s.assets", empty).alias("assets"))


def run_status(runs: DataFrame) -> DataFrame:
    """(run, kind, n, share): steps of each run by status."""
    from pyspark.sql import Window as W

    s = runs.select(F.col("name").alias("run"), F.explode("steps").alias("step", "s")).groupBy("run", F.coalesce("s.status.kind", F.lit("waiting")).alias("kind")).agg(F.count("*").alias("n"))
    return s.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("run")), 6))


def failures(runs: DataFrame) -> DataFrame:
    """(run, step, message): steps that ended in an error."""
    return runs.select(F.col("name").alias("run"), F.explode("steps").alias("step", "s")).where("s.status.kind = 'error'").select("run", "step", F.col("s.status.message").alias("message"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The run of the greatest name."""
    return runs.orderBy(F.desc_nulls_last("name")).limit(1)


def failure_advice(runs: DataFrame, traces: DataFrame) -> DataFrame:
    """(run, step, message, upstream, advice): failed steps with what they follow and what to look at first: failures
    above them, else the step itself, else its input."""
    failed = failures(runs)
    up = trace_steps(traces).select("step", "upstream")
    bad = failed.select("run", F.col("step").alias("u"))
    above = failed.join(up, "step", "left").select("run", "step", F.explode("upstream").alias("u")).join(bad, ["run", "u"]).groupBy("run", "step").agg(F.array_join(F.array_sort(F.collect_set("u")), ", ").alias("first"))
    rows = failed.join(up, "step", "left").join(above, ["run", "step"], "left")
    advice = F.when(F.size(F.coalesce("upstream", F.array().cast("array<string>"))) == 0, "Check input data and step configuration").when(F.col("first").isNotNull(), F.concat(F.lit("Fix upstream failures first: "), F.col("first"))).otherwise("Check step logic and dependencies")
    return rows.select("run", "step", "message", F.array_join("upstream", ",").alias("upstream"), advice.alias("advice"))


def hot_steps(traces: DataFrame, least: int = 2, top: int = 5) -> DataFrame:
    """(trace, step, dependents, chain): the ``top`` steps that ``least`` or more others follow, and the chain from each
    that always goes on to the first step downstream not yet in it.

    A trace's own edges are gathered in one map: a trace is a document of one file.
    """
    from pyspark.sql import Window as W

    s = trace_steps(traces)
    n = s.select("trace", F.explode("upstream").alias("step")).groupBy("trace", "step").agg(F.count("*").alias("dependents")).where(F.col("dependents") >= least)
    n = n.withColumn("r", F.row_number().over(W.partitionBy("trace").orderBy(F.desc("dependents"), "step"))).where(F.col("r") <= top).drop("r")
    down = s.groupBy("trace").agg(F.map_from_entries(F.collect_list(F.struct("step", "downstream"))).alias("down"), F.count("*").cast("int").alias("size"))
    rows = n.join(down, "trace")
    empty = F.array().cast("array<string>")
    go = lambda chain, _: F.concat(chain, F.slice(F.array_except(F.coalesce(F.try_element_at("down", F.element_at(chain, -1)), empty), chain), 1, 1))
    return rows.select("trace", "step", "dependents", F.aggregate(F.sequence(F.lit(1), F.col("size")), F.array("step"), go).alias("chain"))


REPLY = T.StructType([T.StructField("step", T.StringType()), T.StructField("author", T.StringType()), T.StructField("text", T.StringType())])


def json_files(files: DataFrame, schema: T.StructType, path: str = "path", text: str = "text") -> DataFrame:
    """(path, columns of ``schema``) of the texts that are JSON objects; others are skipped."""
    p = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    whole = F.try_parse_json(text).isNotNull() & F.trim(text).startswith("{")
    return files.where(F.col(text).isNotNull() & whole).select(F.col(path).alias("path"), p.alias("j")).select("path", "j.*")


TEAM = T.StructType([T.StructField("version", T.StringType()), T.StructField("annotations", T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("id", "symbol_id", "user_id", "content", "type")])))])


def team_data(files: DataFrame, versions: tuple[str, ...] = ("1.0",), path: str = "path", text: str = "text") -> DataFrame:
    """(path, id, symbol_id, user_id, content, type): annotations out of exported team files. A file of another version
    is an error, as its fields may mean something else."""
    j = json_files(files, TEAM, path, text)
    known = F.col("version").isin(*versions)
    return j.where(F.when(F.coalesce(known, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("team data of unknown version: "), F.coalesce("version", F.lit("none")))).cast("boolean"))).select("path", F.inline("annotations"))


def snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A snapshot written as JSON or parquet lines; a missing one is empty."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path) if path.rstrip("/").endswith("json") else spark.read.schema(schema).parquet(path)


def settings(text: str, env: dict[str, str] | None = None) -> dict:
    """A subset of YAML on the driver: nested maps by indentation, lists, inline lists, scalars, ``${NAME}``."""
    env = dict(os.environ if env is None else env)

    def scalar(v: str):  # noqa: ANN202
        v = re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], ""), v.strip())
        if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'":
            return v[1:-1]
        if v.startswith("[") and v.endswith("]"):
            return [scalar(x) for x in v[1:-1].split(",") if x.strip()]
        low = v.lower()
        if low in ("true", "false"):
            return low == "true"
        if low in ("", "null", "~"):
            return None
        return int(v) if re.fullmatch(r"-?\d+", v) else float(v) if re.fullmatch(r"-?\d+\.\d+", v) else v

    rows = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]

    def block(i: int, indent: int):  # noqa: ANN202
        out: dict | list = [] if i < len(rows) and rows[i][1].startswith("- ") else {}
        while i < len(rows) and rows[i][0] == indent:
            line = rows[i][1]
            if isinstance(out, list):
                out.append(scalar(line[2:]))
                i += 1
                continue
            key, _, rest = line.partition(":")
            rest = re.sub(r"\s+#.*$", "", rest)
            if rest.strip():
                out[key.strip()] = scalar(rest)
                i += 1
            elif i + 1 < len(rows) and (rows[i + 1][0] > indent or rows[i + 1][1].startswith("- ") and rows[i + 1][0] == indent):
                out[key.strip()], i = block(i + 1, rows[i + 1][0])
            else:
                out[key.strip()] = None
                i += 1
        return out, i

    return block(0, rows[0][0])[0] if rows else {}


def merged(base: dict, over: dict) -> dict:
    """Nested settings, the second ones first."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
