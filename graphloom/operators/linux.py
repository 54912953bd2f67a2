"""Build and hardware descriptions as tables: Kbuild, Kconfig, device tree, drivers, services, recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KBUILD = r"(?m)^[ \t]*(?:(obj|lib)-(?:\$\((CONFIG_\w+)\)|([ymn]))|([\w-]+)-(?:objs|y))[ \t]*[:+]?=[ \t]*([^\n\\#]+)"
KCONFIG = r"(?m)^[ \t]*(?:menu)?config[ \t]+(\w+)[ \t]*\r?\n((?:[ \t]+[^\n]*\n?|[ \t]*\r?\n(?=[ \t]))*)"
DTS_NODE = r"(?ms)^[ \t]*(?:(\w+)[ \t]*:[ \t]*)?(&?[\w,.-]+(?:@[0-9a-fA-F]+)?)[ \t]*\{([^{}]*)\}"


def _rows(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("pos", "hit"))


def _words(c):  # noqa: ANN001, ANN202
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def kbuild(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, target, config, objects): one row for each object list; ``config`` is the option it hangs on."""
    part = lambda i: F.regexp_extract("hit", KBUILD, i)
    r = _rows(docs, key, text, KBUILD)
    return r.select(key, "pos", F.when(part(4) != "", part(4)).otherwise(part(1)).alias("target"), F.nullif(part(2), F.lit("")).alias("config"), _words(part(5)).alias("objects"))


def kconfig(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, name, type, prompt, depends_on, selects): one row for each option, from the lines below its head."""
    r = _rows(docs, key, text, KCONFIG).select(key, "pos", F.regexp_extract("hit", KCONFIG, 1).alias("name"), F.regexp_extract("hit", KCONFIG, 2).alias("body"))
    kind = F.regexp_extract("body", r"(?m)^[ \t]+(bool|tristate|string|int|hex|def_bool|def_tristate)\b", 1)
    prompt = F.regexp_extract("body", r"(?m)^[ \t]+(?:bool|tristate|string|int|hex|prompt)[ \t]+\"([^\"]*)\"", 1)
    return r.select(key, "pos", "name", F.nullif(kind, F.lit("")).alias("type"), F.nullif(prompt, F.lit("")).alias("prompt"), F.regexp_extract_all("body", F.lit(r"(?m)^[ \t]+depends on[ \t]+([^\n\r]+)"), F.lit(1)).alias("depends_on"), F.regexp_extract_all("body", F.lit(r"(?m)^[ \t]+select[ \t]+(\w+)"), F.lit(1)).alias("selects"))


def device_tree(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, node, label, compatible, status): innermost nodes; a node without a status is okay."""
    part = lambda i: F.regexp_extract("hit", DTS_NODE, i)
    r = _rows(docs, key, text, DTS_NODE).select(key, "pos", part(2).alias("node"), F.nullif(part(1), F.lit("")).alias("label"), part(3).alias("body"))
    listed = F.regexp_extract("body", r"compatible[ \t]*=[ \t]*([^;]+);", 1)
    status = F.regexp_extract("body", r"status[ \t]*=[ \t]*\"([^\"]+)\"", 1)
    return r.select(key, "pos", "node", "label", F.regexp_extract_all(listed, F.lit(r'"([^"]+)"'), F.lit(1)).alias("compatible"), F.when(status == "", "okay").otherwise(status).alias("status"))


def drivers(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bus, name, probe, remove, license, author, compatible, params) of each file with a driver structure or module macros."""
    x = lambda p, i=1: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    bus = x(r"struct[ \t]+(platform|i2c|spi|usb|pci)_driver\b")
    return docs.where(F.col(text).rlike(r"struct[ \t]+\w+_driver\b|MODULE_\w+\s*\(|module_init\s*\(")).select(
        key, bus.alias("bus"), x(r"\.name[ \t]*=[ \t]*\"([^\"]+)\"").alias("name"), x(r"\.probe[ \t]*=[ \t]*(\w+)").alias("probe"), x(r"\.remove(?:_new)?[ \t]*=[ \t]*(\w+)").alias("remove"),
        x(r"MODULE_LICENSE\s*\(\s*\"([^\"]+)\"").alias("license"), x(r"MODULE_AUTHOR\s*\(\s*\"([^\"]+)\"").alias("author"), x(r"MODULE_DESCRIPTION\s*\(\s*\"([^\"]+)\"").alias("description"),
        F.regexp_extract_all(text, F.lit(r"\.compatible[ \t]*=[ \t]*\"([^\"]+)\""), F.lit(1)).alias("compatible"), F.regexp_extract_all(text, F.lit(r"module_param\s*\(\s*(\w+)"), F.lit(1)).alias("params"),
    )


def services(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, exec_start, after, wants, wanted_by) of each service unit."""
    x = lambda p: F.nullif(F.regexp_extract(text, rf"(?m)^{p}=[ \t]*([^\r\n]+)", 1), F.lit(""))
    words = lambda p: _words(F.coalesce(x(p), F.lit("")))
    return docs.where(F.col(text).rlike(r"(?m)^\[Service\]")).select(key, x("ExecStart").alias("exec_start"), words("After").alias("after"), words("Wants").alias("wants"), words("WantedBy").alias("wanted_by"))


def recipes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, summary, license, src_uri, depends, rdepends, inherits) of each build recipe."""
    x = lambda p: F.nullif(F.regexp_extract(text, rf"(?m)^{p}[ \t]*[?+:]*=[ \t]*\"([^\"]*)\"", 1), F.lit(""))
    words = lambda c: _words(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", " "))
    inherits = F.nullif(F.regexp_extract(text, r"(?m)^inherit[ \t]+([^\r\n]+)", 1), F.lit(""))
    return docs.where(F.col(text).rlike(r"(?m)^(?:SRC_URI|DEPENDS|inherit)\b")).select(key, x("SUMMARY").alias("summary"), x("LICENSE").alias("license"), words(x("SRC_URI")).alias("src_uri"), words(x("DEPENDS")).alias("depends"), words(x(r"RDEPENDS[:_]?\S*")).alias("rdepends"), words(inherits).alias("inherits"))


def buildroot(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, package, version, site, depends) of each package makefile, named by the prefix of its version."""
    x = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return docs.where(F.col(text).rlike(r"\$\(eval \$\([\w-]*package\)\)")).select(
        key, x(r"(?m)^(\w+)_VERSION[ \t]*[:?]?=").alias("package"), x(r"(?m)^\w+_VERSION[ \t]*[:?]?=[ \t]*([^\r\n]+)").alias("version"), x(r"(?m)^\w+_SITE[ \t]*[:?]?=[ \t]*([^\r\n]+)").alias("site"),
        _words(F.coalesce(x(r"(?m)^\w+_DEPENDENCIES[ \t]*[+:?]?=[ \t]*([^\r\n]+)"), F.lit(""))).alias("depends"),
    )


def matched(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(node key columns, driver key): device-tree nodes and drivers that name the same compatible string."""
    n = nodes.select(F.col("node"), F.explode("compatible").alias("c"))
    d = found.select(F.col("name").alias("driver"), F.explode("compatible").alias("c"))
    return n.join(d, "c").select("node", "driver").distinct()


#: What marks real-time tasks and interrupt handlers.
RTOS = r"\b(xTaskCreate\w*|osThreadNew|tx_thread_create|k_thread_create|rt_thread_create|OSTaskCreate)\s*\("
ISR = r"\b(\w+_IRQHandler|ISR\s*\(\s*\w+|request_irq|attachInterrupt|IRAM_ATTR|__interrupt|HAL_NVIC_EnableIRQ|devm_request_irq)"
MEMORY = r"\b(malloc|calloc|realloc|kmalloc|kzalloc|devm_kzalloc|pvPortMalloc|heap_caps_malloc|alloca)\s*\("


def embedded_signals(code: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tasks, handlers, allocations): counts in each code text, rows with none left out."""
    n = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    return code.where(F.col(text).isNotNull()).select(key, n(RTOS).alias("tasks"), n(ISR).alias("handlers"), n(MEMORY).alias("allocations")).where("tasks + handlers + allocations > 0")
