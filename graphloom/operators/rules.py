"""Rule engines: rules are data, applied as column expressions or as a small joined table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.versions import latest

# The weighted layer rules - layer, what they look at, weight, patterns.
LAYER_RULES: list[tuple[str, str, int, list[str]]] = [
    ("interface", "path", 3, ["**/routes/**", "**/controllers/**", "**/views/**", "**/pages/**", "**/components/**", "**/screens/**", "**/*.controller.*", "**/*.handler.*", "**/*.route.*", "**/*.view.*", "**/*.page.*", "**/*.component.*"]),
    ("interface", "naming", 3, ["Controller", "Handler", "Router", "Middleware", "View", "Page", "Component", "Screen", "Layout", "Template", "Action", "Endpoint", "setupEventListeners", "cycleLayout", "render", "draw", "addEventListener", "removeEventListener"]),
    ("interface", "import", 2, ["express", "fastify", "koa", "hono", "next/router", "react-router", "vue-router", "react", "vue", "svelte", "angular"]),
    ("interface", "naming", 3, ["ui_", "_ui", "gui_", "_gui", "display_", "screen_", "lv_", "_lv", "widget", "button", "menu", "draw", "render", "paint", "canvas"]),
    ("interface", "path", 3, ["**/ui/**", "**/gui/**", "**/display/**", "**/screen/**", "**/views/**", "**/widgets/**", "**/pages/**"]),
    ("business", "path", 3, ["**/services/**", "**/domain/**", "**/models/**", "**/entities/**", "**/usecases/**", "**/core/**", "**/*.service.*", "**/*.usecase.*", "**/*.manager.*"]),
    ("business", "naming", 2, ["Service", "Manager", "Processor", "UseCase", "Validator", "Factory", "Strategy", "Builder", "Handler", "Executor", "Orchestrator"]),
    ("business", "naming", 2, ["init", "setup", "loop", "main", "task", "run", "start", "stop", "reset", "update", "process", "handle", "dispatch", "event", "callback"]),
    ("business", "path", 1, ["**/src/**", "**/app/**", "**/application/**"]),
    ("data", "path", 3, ["**/repositories/**", "**/dal/**", "**/database/**", "**/migrations/**", "**/schemas/**", "**/stores/**", "**/*.repository.*", "**/*.dao.*", "**/*.mapper.*", "**/*.model.*", "**/*.entity.*"]),
    ("data", "import", 2, ["prisma", "typeorm", "sequelize", "mongoose", "knex", "drizzle", "sqlalchemy", "pg", "mysql2", "sqlite", "redis"]),
    ("data", "naming", 2, ["Repository", "DAO", "Mapper", "Schema", "Migration", "Store", "Adapter", "Gateway"]),
    ("data", "code", 1, ["SELECT ", "INSERT ", "UPDATE ", "DELETE ", "db.query", "prisma.", "typeorm."]),
    ("data", "naming", 3, ["nvs_", "eeprom_", "flash_", "storage_", "persist_", "save", "load", "read", "write", "get", "set", "database", "db_", "cache_"]),
    ("data", "import", 2, ["nvs", "eeprom", "flash", "spi", "i2c", "uart", "wire", "serial", "hardware"]),
    ("utility", "path", 3, ["**/utils/**", "**/helpers/**", "**/lib/**", "**/common/**", "**/shared/**", "**/tools/**", "**/*.util.*", "**/*.helper.*", "**/*.config.*"]),
    ("utility", "naming", 2, ["util", "helper", "format", "parse", "validate", "transform", "logger", "config", "constants", "types", "interfaces", "substitute", "env", "merge", "deepMerge"]),
    ("utility", "naming", 3, ["debug_", "log_", "print_", "printf", "math_", "calc_", "convert_", "transform_", "timer_", "delay_", "sleep_", "string_", "str_", "mem_", "memcpy"]),
    ("utility", "path", 2, ["**/utils/**", "**/helpers/**", "**/common/**", "**/debug/**", "**/log/**", "**/math/**"]),
]
#: Order in which equal scores win, the layer without any score, names that naming rules skip.
LAYER_ORDER = ("interface", "data", "business", "utility")
DEFAULT_LAYER = "business"
FRAMEWORK_NAMES = ("lv_", "_lv", "ui_", "gui_", "screen_")


def glob_regex(pattern: str) -> str:
    """A path glob as a regex: ``**/`` any directories or none, ``**`` anything, ``*`` anything but a slash."""
    out = []
    for part in re.split(r"(\*\*/|/\*\*$|\*\*|\*|\?)", pattern):
        out.append({"**/": "(?:.*/)?", "/**": "(?:/.*)", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part) if part else ""))
    return "^" + "".join(out) + "$"


def any_of(column: Column, words: list[str]) -> Column:
    """Whether a text contains one of some words, as a single regex."""
    return F.coalesce(column.rlike("|".join(re.escape(w) for w in words)), F.lit(False))


def layer_scores(rules: list[tuple[str, str, int, list[str]]], name: Column, kind: Column, path: Column, imports: Column, code: Column) -> dict[str, Column]:
    """The score of each layer, as columns."""
    framework = kind.isin("variable", "type") & any_of(name, list(FRAMEWORK_NAMES))
    scores: dict[str, Column] = {}
    for layer, what, weight, patterns in rules:
        if what == "path":
            hit = F.coalesce(path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)), F.lit(False))
        elif what == "naming":
            hit = ~F.coalesce(framework, F.lit(False)) & any_of(name, patterns)
        elif what == "import":
            hit = F.coalesce(F.exists(imports, _starts(patterns)), F.lit(False))
        else:
            hit = any_of(code, patterns)
        scores[layer] = scores.get(layer, F.lit(0)) + F.when(hit, weight).otherwise(0)
    return scores


def _starts(patterns: list[str]):  # noqa: ANN202
    regex = "^(?:" + "|".join(re.escape(p) for p in patterns) + ")(?:/|$)"
    return lambda i: i.rlike(regex)


def classify_layers(symbols: DataFrame, files: DataFrame, extra: list[tuple[str, str, int, list[str]]] | None = None) -> DataFrame:
    """(id, layer, score): the layer with the greatest total weight; ties go by ``LAYER_ORDER``, no score at all means
    ``DEFAULT_LAYER``. Further rules can be added; the fixed ones never change."""
    rules = LAYER_RULES + list(extra or [])
    code_words = [w for _, what, _, words in rules if what == "code" for w in words]
    kept = latest(symbols, "id", "updated_at", "name", "kind", "file_path", *[any_of(F.col("source_code"), [w]).alias(f"code_{i}") for i, w in enumerate(code_words)])
    rows = kept.join(latest(files, "path", "parsed_at", "imports").withColumnRenamed("path", "file_path"), "file_path", "left")
    marks = F.concat_ws("\n", *[F.when(F.col(f"code_{i}"), F.lit(w)) for i, w in enumerate(code_words)])
    s = layer_scores(rules, F.col("name"), F.col("kind"), F.col("file_path"), F.col("imports"), marks)
    rows = rows.select("id", *[s.get(x, F.lit(0)).alias(x) for x in LAYER_ORDER])
    best = F.greatest(*LAYER_ORDER)
    layer = F.when(best == 0, DEFAULT_LAYER)
    for x in LAYER_ORDER:
        layer = layer.when(F.col(x) == best, x)
    return rows.select("id", layer.alias("layer"), best.cast("long").alias("score"))


# --- review findings

#: What a review looks for in code - rule, severity, pattern.
REVIEW_RULES = [
    ("empty-catch", "warning", r"catch\s*\([^)]*\)\s*\{\s*\}"),
    ("eval", "error", r"\beval\s*\("),
    ("inner-html", "warning", r"\.innerHTML\s*="),
    ("hardcoded-secret", "error", r"(?i)(?:password|passwd|secret|api_?key|token|auth)\s*[:=]\s*['\"][^'\"]{8,}['\"]"),
    ("sync-io", "warning", r"\bfs\.(readFileSync|writeFileSync|existsSync)\s*\("),
    ("nested-loops", "warning", r"for\s*\([^)]*\)\s*\{[^}]*for\s*\("),
    ("long-parameters", "info", r"function\s+\w+\s*\(([^)]{100,})\)"),
]
NOTES = r"(?i)(TODO|FIXME|HACK|XXX|WORKAROUND)\s*[:\-]?\s*(.*)"
#: Numbers that need no name.
PLAIN_NUMBERS = ("100", "1000", "1024", "10000", "365")


def review(symbols: DataFrame) -> DataFrame:
    """(id, rule, severity, n): findings in the current code of each symbol; ``n`` counts to-do notes, else is 1."""
    code = F.col("source_code")
    rules = [F.when(code.rlike(p), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.lit(1).cast("long").alias("n"))) for r, s, p in REVIEW_RULES]
    notes = F.regexp_count(code, F.lit(NOTES)).cast("long")
    rules.append(F.when(notes > 0, F.struct(F.lit("note").alias("rule"), F.lit("info").alias("severity"), notes.alias("n"))))
    net = F.array_max(F.transform(F.split(code, "\n"), lambda t: (F.length(t) - F.length(F.translate(t, "{", ""))) - (F.length(t) - F.length(F.translate(t, "}", "")))))
    rules.append(F.when(net > 4, F.struct(F.lit("deep-nesting").alias("rule"), F.lit("warning").alias("severity"), net.cast("long").alias("n"))))
    lines = (F.length(code) - F.length(F.translate(code, "\n", "")) + 1).cast("long")
    rules.append(F.when(lines > 100, F.struct(F.lit("large-function").alias("rule"), F.lit("info").alias("severity"), lines.alias("n"))))
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return latest(symbols, "id", "updated_at", found.alias("f")).select("id", F.inline("f"))


def magic_numbers(symbols: DataFrame) -> DataFrame:
    """(id, number, n): numbers of three digits or more in code that aren't part of a name, a decimal or an assignment."""
    found = F.filter(F.regexp_extract_all("source_code", F.lit(r"(?<!=\s{0,20})(?<![\w.])\b(\d{3,})\b(?!\.\d)"), F.lit(1)), lambda x: ~x.isin(*PLAIN_NUMBERS))
    return latest(symbols, "id", "updated_at", found.alias("f")).select("id", F.explode("f").alias("number")).groupBy("id", "number").agg(F.count("*").alias("n"))


# --- questions

# Intents of questions - type, priority, patterns.
INTENTS: list[tuple[str, int, list[str]]] = [
    ("safe_delete", 8, [r"(?i)(?:can|could|is it safe to)\s+(?:i\s+)?(?:safely\s+)?(?:delete|remove|drop)\b", r"(?i)(?:delete|remove)\s+.{2,40}\s+safely", r"(?i)(?:unused|dead\s*code|no\s*(?:one|body)\s*(?:uses|calls|references))", "能.{0,4}(?:删除|移除|去掉)", "(?:删除|移除|去掉).{0,4}安全", "没有.{0,4}(?:引用|调用|使用)", "死代码"]),
    ("impact", 7, [r"(?i)(?:what\s+(?:happens|changes|breaks|is\s+affected)|impact|risk|consequences?)\s+(?:if|of)\s+(?:i\s+)?(?:change|modify|update|refactor|delete|rename)", r"(?i)(?:what\s+is\s+the\s+)?impact\s+(?:of|from)\s+", r"(?i)(?:what\s+)?(?:happens|changes|breaks)\s+(?:if|when)\s+(?:i\s+)?(?:change|modify|update|refactor|delete|rename)", r"(?i)(?:affected|breaking|downstream|upstream)\s+(?:files|modules|code|symbols)", "(?:修改|改动|变更|重构).{0,8}(?:影响|后果|风险|波及)", "(?:修改|改动|变更).{0,4}.{2,20}.{0,4}(?:会|能|可以).{0,4}(?:影响|什么|怎样|如何)", "影响.{0,6}(?:范围|分析|评估)", "(?:动了|改了).{0,8}会.{0,4}(?:怎样|如何|影响)"]),
    ("understand", 5, [r"(?i)(?:what\s+does|explain|describe|tell\s+me\s+about|help\s+me\s+understand|how\s+does)\b", "(?:这个|这个).{0,4}(?:做|干|是).{0,2}(?:什么|啥)", "(?:解释|说明|介绍|描述).{0,6}(?:一下)?", "(?:做什么|干什么|是干嘛的|有什么用|什么意思)", r"(?i)how\s+(?:does|do)\s+.{2,30}\s+work"]),
    ("relationship", 7, [r"(?i)(?:how\s+(?:are|is)|what'?s?\s+the\s+(?:relationship|relation|connection|link))\s+(?:between|from|to)\b", r"(?i)(?:related|connected|depends?\s+on|dependenc)", r".{2,20}\s+(?:和|与|跟|同)\s+.{2,20}\s+(?:什么关系|有啥关系|的关系|怎么联系)", "(?:依赖|关联|关系).{0,4}(?:之间)"]),
    ("code_review", 6, [r"(?i)(?:anything\s+wrong|problems?|issues?|bugs?|code\s*smells?|anti[- ]?patterns?)\s+(?:with|in)\b", r"(?i)(?:review|check|audit|inspect)\s+(?:(?:the|this)\s+)?(?:code|module|file|class|function)", "(?:有问题|有bug|有错误|写得不好|不规范|有隐患)", r"(?:检查|审查|评审|review)\s*(?:一下)?\s*(?:这段|这个|这文件)"]),
    ("find_code", 5, [r"(?i)(?:where\s+is|find|locate|search\s+for|show\s+me)\s+(?:the\s+)?(?:code|function|class|module|file)\s+(?:that|for|handling|related)", r"(?i)(?:handle|process|manage|implement)\s+.{2,30}\s+(?:logic|flow|feature)", "(?:在哪|哪里|哪个文件|哪个模块).{0,4}(?:处理|实现|负责)", "(?:找|搜索|查找).{0,4}(?:代码|函数|类|文件)", "(?:处理|实现|负责).{0,6}(?:什么|哪些)"]),
    ("architecture", 6, ["(?i)architecture", "(?i)architectural", "(?i)(?:structure|design|pattern|layer)", r"(?i)(?:module\s+structure)", "(?i)(?:optimization|optimize|performance)", r"(?i)(?:how\s+is\s+(?:this|the)\s+(?:project|app|codebase|code)\s+(?:organized|structured|designed|architected))", "(?:架构|结构|分层|模块|设计模式)", "(?:怎么组织|如何组织|项目结构)"]),
    ("call_chain", 6, [r"(?i)(?:who\s+calls|what\s+calls|callers?\s+of|called\s+by|invokes?)\b", r"(?i)(?:what\s+does\s+.{2,30}\s+call|callees?\s+of|calls?\s+to)\b", r"(?i)(?:call\s+(?:chain|graph|tree|hierarchy)|execution\s+(?:flow|path))", "(?:谁调用|调用.{0,2}谁|调用链|调用关系)", "(?:被.{0,2}调用|上游|下游)"]),
    ("refactor", 6, [r"(?i)(?:how\s+(?:should|to|can)\s+(?:i\s+)?|best\s+way\s+to)\s*(?:refactor|improve|clean\s+up|restructure)\b", r"(?i)(?:refactor|improvement|cleanup)\s+(?:suggestions?|ideas?|recommendations?)", r"(?i)(?:tech\s*debt|technical\s+debt)", "(?:怎么重构|如何重构|重构建议|改进建议)", "(?:技术债|代码债)"]),
    ("test_coverage", 5, [r"(?i)(?:test|tested|coverage|spec)\s*(?:ed|s|ing)?\s*(?:\?|well|enough|adequate)", r"(?i)test\s+coverage\s+(?:of|for)", r"(?i)(?:is|are)\s+.{2,30}\s+(?:well\s+)?tested", "(?:测试覆盖|有没有测试|测试够不够|测试情况)"]),
    ("overview", 4, [r"(?i)(?:overview|summary|dashboard|stats?|statistics|about\s+the\s+project)", r"(?i)(?:give\s+me|show\s+me)\s+(?:an?\s+)?(?:overview|summary|big\s+picture)", "(?:项目概览|项目概况|总体|整体|概况|统计)", "(?:简单介绍|大概|大致)"]),
    ("compare", 7, [r"(?i)(?:compare|diff|difference|vs\.?|versus)\s+(?:between)?\b", "(?:对比|比较|区别|不同|差异)"]),
    ("entry_point", 5, [r"(?i)(?:entry\s*point|start|boot|bootstrap|main|initializ)", r"(?i)(?:where\s+does\s+(?:it|the\s+app|the\s+program)\s+start)", "(?:入口|启动|开始|初始化)"]),
    ("embedded_linux", 7, [r"(?i)(?:embedded\s+linux|linux\s+(?:kernel|driver|module|kconfig|kbuild|device\s*tree|dts|yocto|buildroot|sysfs|procfs|debugfs|ioctl))", r"(?i)(?:kernel\s+module|platform\s+driver|i2c_driver|spi_driver|usb_driver)", "(?i)(?:module_init|MODULE_LICENSE|of_device_id)", r"(?i)(?:device\s*tree|dts|compatible|devicetree)", "(?:嵌入式.?linux|内核驱动|设备树|内核模块|用户态接口)", "(?i)(?:Kconfig|Kbuild|Yocto|Buildroot|systemd)", r"(?i)(?:sysfs|procfs|debugfs)\s+interface"]),
]


def intents(questions: DataFrame, text: str) -> DataFrame:
    """Adds intent and confidence: matches times priority, the first of the best; without a match free_form at 0.3.

    Every pattern is one JVM-side test on the row; null texts count as empty.
    """
    q = F.coalesce(F.col(text), F.lit(""))
    rows = questions.withColumns({f"__s{i}": sum((F.when(q.rlike(p), priority).otherwise(0) for p in patterns), F.lit(0)) for i, (_, priority, patterns) in enumerate(INTENTS)})
    best = F.greatest(*[f"__s{i}" for i in range(len(INTENTS))])
    kind = F.when(best == 0, "free_form")
    for i, (name, _, _) in enumerate(INTENTS):
        kind = kind.when(F.col(f"__s{i}") == best, name)
    out = rows.withColumn("intent", kind).withColumn("confidence", F.when(best == 0, 0.3).otherwise(F.least(best / 16, F.lit(1.0))))
    return out.drop(*[f"__s{i}" for i in range(len(INTENTS))])


#: Lines from which code counts as long - kind, warning, error.
LONG = (("function", 100, 200), ("method", 80, 150), ("class", 300, 500), ("module", 200, 400))
SEVERITY = ("error", "warning", "info")


def long_code(symbols: DataFrame, limits: tuple = LONG) -> DataFrame:
    """(id, severity, lines) of code longer than its kind's limits."""
    lines = (F.length("source_code") - F.length(F.translate("source_code", "\n", "")) + 1).cast("long")
    s = latest(symbols, "id", "updated_at", "kind", lines.alias("lines"))
    sev = F.lit(None).cast("string")
    for kind, soft, hard in limits:
        sev = F.when((F.col("kind") == kind) & (F.col("lines") > hard), "error").when((F.col("kind") == kind) & (F.col("lines") > soft), "warning").otherwise(sev)
    return s.select("id", sev.alias("severity"), "lines").where("severity IS NOT NULL")
