"""Rule engines (RUL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph, sql
from graphloom.operators import relations as R
from graphloom.operators import rules as O
from graphloom.operators.versions import latest
from graphloom.plans.catalog import query
from graphloom.operators.graph import shortest_cycles
from graphloom.plans.graphplans import CYCLES_SQL, file_imports
from graphloom.plans.graphplans import _walk as walk_sql
from graphloom.plans.joins import API_NAMES, API_PATHS, FORBIDDEN


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _layer_sql(extra: tuple = ()) -> str:
    """The same rules as text, rule by rule."""
    import re

    parts: dict[str, list[str]] = {}
    for layer, what, weight, words in [*O.LAYER_RULES, *extra]:
        any_word = lambda c, w=words: f"regexp_matches({c}, {_lit('|'.join(re.escape(x) for x in w))})"
        if what == "path":
            test = f"regexp_matches(s.file_path, {_lit('|'.join(f'(?:{O.glob_regex(x)})' for x in words))})"
        elif what == "naming":
            fw = "|".join(O.FRAMEWORK_NAMES)
            test = f"({any_word('s.name')} AND NOT (s.kind IN ('variable', 'type') AND regexp_matches(s.name, {_lit(fw)})))"
        elif what == "import":
            test = "len(list_filter(f.imports, lambda i: regexp_matches(i, " + _lit("^(?:" + "|".join(re.escape(x) for x in words) + ")(?:/|$)") + "))) > 0"
        else:
            test = any_word("s.source_code")
        parts.setdefault(layer, []).append(f"CASE WHEN {test} THEN {weight} ELSE 0 END")
    cols = ", ".join(f"{' + '.join(v)} AS s_{k}" for k, v in parts.items())
    best = "greatest(s_interface, s_data, s_business, s_utility)"
    return f"x AS (SELECT s.id, {cols} FROM sym s LEFT JOIN fil f ON f.path = s.file_path) SELECT id, CASE WHEN {best} = 0 THEN 'business' WHEN s_interface = {best} THEN 'interface' WHEN s_data = {best} THEN 'data' WHEN s_business = {best} THEN 'business' ELSE 'utility' END AS layer, {best}::BIGINT AS score FROM x"


@query("rul01_layers", sql(_layer_sql()))
def layers(g: Graph) -> DataFrame:
    return O.classify_layers(g.heavy("symbols"), g.table("files"))


_EXTRA = (("utility", "naming", 5, ["Private"]), ("data", "path", 3, ["**/drivers/**"]))


@query("rul02_custom_rules", sql(_layer_sql(_EXTRA)))
def custom(g: Graph) -> DataFrame:
    """The fixed rules with two more; the table of fixed rules stays as it is."""
    return O.classify_layers(g.heavy("symbols"), g.table("files"), list(_EXTRA))


_GUARD = """fb(f, t) AS (VALUES ('data', 'interface'), ('utility', 'business'), ('utility', 'interface')),
vio AS (SELECT e.src AS id, 'layer-violation' AS rule, 'error' AS severity FROM edg e JOIN sym a ON a.id = e.src JOIN sym b ON b.id = e.dst JOIN fb ON fb.f = a.layer AND fb.t = b.layer
UNION ALL SELECT id, 'max-complexity', 'warning' FROM sym WHERE complexity > 50 UNION ALL SELECT s.id, 'max-coupling', 'warning' FROM sym s JOIN (SELECT dst, count(*) AS n FROM edg WHERE kind = 'calls' AND src IN (SELECT id FROM sym) GROUP BY 1) c ON c.dst = s.id AND c.n > 20
UNION ALL SELECT chain, 'no-circular-deps', 'error' FROM cyc)"""


def violations(g: Graph, forbidden: tuple[tuple[str, str], ...] = FORBIDDEN, complexity: int = 50, callers: int = 20, cycles: bool = True) -> DataFrame:
    """(id, rule, severity): import cycles (their chain as id) if asked for, edges against the layers, and exceeded limits."""
    s = g.symbols("id", "layer", "complexity")
    rules = g.spark.createDataFrame(list(forbidden), "src_layer string, dst_layer string")
    wrong = R.with_ends(g.edges(), s.select("id", "layer"), "layer").join(F.broadcast(rules), ["src_layer", "dst_layer"], "left_semi")
    say = lambda df, c, rule, severity: df.select(F.col(c).alias("id"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
    many = R.known_counts(g.edges("calls"), s, "dst", "src", "n").where(F.col("n") > callers).join(s.select("id"), "id", "left_semi")
    out = say(wrong, "src", "layer-violation", "error").unionByName(say(s.where(F.col("complexity") > complexity), "id", "max-complexity", "warning")).unionByName(say(many, "id", "max-coupling", "warning"))
    if not cycles:
        return out
    rings = shortest_cycles(file_imports(g)).select(F.array_join("chain", " > ").alias("chain"))
    return out.unionByName(say(rings, "chain", "no-circular-deps", "error"))


@query("rul03_guard", sql(CYCLES_SQL + ", " + _GUARD + " SELECT rule, severity, count(*) AS n, count(DISTINCT id) AS symbols, bool_and(severity <> 'error') AS passed FROM vio GROUP BY GROUPING SETS ((rule, severity), ())", recursive=True))
def guard(g: Graph) -> DataFrame:
    """Violations by rule, and in all; passed are those without an error."""
    r, s = F.col("rule"), F.col("severity")
    v = violations(g).withColumn("kind", s)
    return v.groupingSets([[r, s], []], r, s).agg(F.count("*").alias("n"), F.countDistinct("id").alias("symbols"), F.bool_and(F.col("kind") != "error").alias("passed"))


# (name, from, to, most callers, most callees, most complexity): a pattern is a layer or a part of a name; * is everything.
CUSTOM_RULES = (("no-ui-from-data", "data", "interface", None, None, None), ("no-private", "business", "Private", None, None, None), ("lean-utilities", "utility", None, 3, 2, 5), ("bounded", "*", None, 20, None, 30))


@query(
    "rul04_custom_rules",
    sql(
        "rl(name, f, t, mci, mco, mcx) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in CUSTOM_RULES) + """),
ci AS (SELECT dst AS id, count(*) AS n FROM edg WHERE kind = 'calls' AND src IN (SELECT id FROM sym) GROUP BY 1), co AS (SELECT src AS id, count(*) AS n FROM edg WHERE kind = 'calls' AND dst IN (SELECT id FROM sym) GROUP BY 1),
st AS (SELECT rl.*, s.id, s.complexity FROM sym s JOIN rl ON rl.f = '*' OR s.layer = rl.f OR contains(s.name, rl.f))
SELECT st.name AS rule, 'error' AS severity, st.id, NULL::BIGINT AS value FROM st JOIN edg e ON e.src = st.id AND e.kind = 'calls' JOIN sym b ON b.id = e.dst WHERE st.t IS NOT NULL AND (b.layer = st.t OR contains(b.name, st.t))
UNION ALL SELECT st.name, 'warning', st.id, ci.n FROM st JOIN ci ON ci.id = st.id WHERE ci.n > st.mci UNION ALL SELECT st.name, 'warning', st.id, co.n FROM st JOIN co ON co.id = st.id WHERE co.n > st.mco UNION ALL SELECT name, 'warning', id, complexity::BIGINT FROM st WHERE complexity > mcx"""
    ),
)
def custom_rules(g: Graph) -> DataFrame:
    """Custom rules from a table: forbidden calls, and limits on callers, callees and complexity of what a rule is for."""
    rules = g.spark.createDataFrame(list(CUSTOM_RULES), "rule string, f string, t string, mci long, mco long, mcx long")
    match = lambda p, layer, name: (F.col(p) == "*") | (F.col(layer) == F.col(p)) | F.col(name).contains(F.col(p))
    s = g.symbols("id", "layer", "name", "complexity")
    subject = s.join(F.broadcast(rules), match("f", "layer", "name"))  # as many as there are rules, a table of fixed size
    e = g.edges("calls")
    other = s.select(F.col("id").alias("dst"), F.col("layer").alias("l2"), F.col("name").alias("n2"))
    bad = subject.where("t IS NOT NULL").join(e.select(F.col("src").alias("id"), "dst"), "id").join(other, "dst").where(match("t", "l2", "n2"))
    say = lambda df, value, severity: df.select("rule", F.lit(severity).alias("severity"), "id", F.expr(value).cast("long").alias("value"))
    out = say(bad, "NULL", "error").unionByName(say(subject.where("complexity > mcx"), "complexity", "warning"))
    for at, to, most in (("dst", "src", "mci"), ("src", "dst", "mco")):
        out = out.unionByName(say(subject.join(R.known_counts(e, s, at, to, "n"), "id").where(F.col("n") > F.col(most)), "n", "warning"))
    return out


_SMELLS = f"""k AS (SELECT e.dst AS id, count(*) AS n FROM edg e JOIN sym s ON s.id = e.src WHERE e.kind = 'calls' GROUP BY 1),
dead AS (SELECT s.id, 'dead-code' AS smell, CASE WHEN NOT coalesce(s.exported, false) THEN 'warning' ELSE 'info' END AS severity FROM sym s LEFT JOIN k ON k.id = s.id WHERE k.id IS NULL AND s.kind NOT IN ('interface', 'type', 'namespace') AND (NOT coalesce(s.exported, false) OR NOT (regexp_matches(s.name, '{API_NAMES}') OR regexp_matches(s.file_path, '{API_PATHS}')))),
ln AS (SELECT id, kind, len(string_split(source_code, chr(10))) AS n FROM sym WHERE source_code IS NOT NULL),
lim(kind, soft, hard) AS (VALUES ('function', 100, 200), ('method', 80, 150), ('class', 300, 500), ('module', 200, 400)),
long AS (SELECT ln.id, 'long-function' AS smell, CASE WHEN n > hard THEN 'error' ELSE 'warning' END AS severity FROM ln JOIN lim USING (kind) WHERE n > soft),
par AS (SELECT id, 'data-clumps' AS smell, 'info' AS severity FROM sym WHERE kind IN ('function', 'method') AND len(list_filter(string_split(regexp_extract(source_code, '\\(([^)]+)\\)', 1), ','), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '')) >= 6),
hc AS (SELECT e.src AS id, 'high-coupling' AS smell, 'warning' AS severity FROM edg e JOIN sym t ON t.id = e.dst WHERE e.kind = 'calls' GROUP BY 1 HAVING count(*) > 10),
ss AS (SELECT e.dst AS id, 'shotgun-surgery' AS smell, 'warning' AS severity FROM edg e JOIN sym s ON s.id = e.src JOIN sym t ON t.id = e.dst WHERE e.kind = 'calls' GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT s.file_path) >= 4),
md AS (SELECT c.id, count(*) AS methods FROM sym c JOIN sym m ON m.file_path = c.file_path AND m.kind = 'method' AND m.start_line >= c.start_line AND m.end_line <= c.end_line WHERE c.kind = 'class' GROUP BY 1),
god AS (SELECT md.id, 'god-class' AS smell, CASE WHEN md.methods > {{error}} THEN 'error' ELSE 'warning' END AS severity FROM md LEFT JOIN k ON k.id = md.id WHERE md.methods > {{many}} OR (md.methods > {{some}} AND coalesce(k.n, 0) > {{popular}})),
cl AS (SELECT f.id, f.file_path AS own, t.file_path AS file, t.kind FROM edg e JOIN sym f ON f.id = e.src JOIN sym t ON t.id = e.dst WHERE e.kind = 'calls' AND f.kind IN ('function', 'method')),
env AS (SELECT id, 'feature-envy' AS smell, 'warning' AS severity FROM cl WHERE kind = 'method' AND file <> own AND id IN (SELECT id FROM cl GROUP BY 1 HAVING count(*) >= 3) GROUP BY id HAVING max_n_placeholder),
al AS (SELECT * FROM dead UNION ALL SELECT * FROM long UNION ALL SELECT * FROM par UNION ALL SELECT id, 'long-parameter-list', severity FROM par UNION ALL SELECT * FROM hc UNION ALL SELECT * FROM ss UNION ALL SELECT * FROM god UNION ALL SELECT * FROM env)"""
_SMELLS = _SMELLS.replace("SELECT id, 'feature-envy' AS smell, 'warning' AS severity FROM cl WHERE kind = 'method' AND file <> own AND id IN (SELECT id FROM cl GROUP BY 1 HAVING count(*) >= 3) GROUP BY id HAVING max_n_placeholder", "SELECT DISTINCT id, 'feature-envy' AS smell, 'warning' AS severity FROM (SELECT id, file, count(*) AS n FROM cl WHERE kind = 'method' AND file <> own GROUP BY 1, 2) WHERE n >= {envy} AND id IN (SELECT id FROM cl GROUP BY 1 HAVING count(*) >= 3)")
_LOW = {"many": 3, "some": 2, "popular": 1, "error": 4, "envy": 2}
_SMELLS_LOW, _SMELLS = _SMELLS.format(**_LOW), _SMELLS.format(many=15, some=10, popular=8, error=20, envy=3)


def smells(g: Graph, many: int = 15, some: int = 10, popular: int = 8, error: int = 20, envy: int = 3) -> DataFrame:
    """(id, smell, severity): all eight detectors in one union; a long list of parameters counts as a clump of data too."""
    from graphloom.functions.scalars import parameter_count
    from graphloom.storage import cut

    t = g.heavy("symbols")
    lines = (F.length("source_code") - F.length(F.translate("source_code", "\n", "")) + 1).cast("long")
    params = F.when(F.col("kind").isin("function", "method"), parameter_count(F.col("source_code")))
    s = cut(latest(t, "id", "updated_at", "name", "kind", "file_path", "exported", "start_line", "end_line", lines.alias("lines"), params.alias("params")), "smell-symbols")
    e = cut(g.edges("calls").select("src", "dst"), "smell-calls")
    k = R.known_counts(e, s, "dst", "src", "callers")
    exported = F.coalesce("exported", F.lit(False))
    api = F.col("name").rlike(API_NAMES) | F.col("file_path").rlike(API_PATHS)
    tag = lambda df, smell, sev: df.select("id", F.lit(smell).alias("smell"), (F.lit(sev) if isinstance(sev, str) else sev).alias("severity"))
    dead = tag(s.where(~F.col("kind").isin("interface", "type", "namespace") & (~exported | ~api)).join(k.select("id"), "id", "left_anti"), "dead-code", F.when(~exported, "warning").otherwise("info"))
    sev = F.lit(None).cast("string")
    for kind, soft, hard in O.LONG:
        sev = F.when((F.col("kind") == kind) & (F.col("lines") > hard), "error").when((F.col("kind") == kind) & (F.col("lines") > soft), "warning").otherwise(sev)
    long = tag(s, "long-function", sev).where("severity IS NOT NULL")
    clumps = tag(s.where("params >= 6"), "data-clumps", "info")
    lists = tag(s.where("params >= 6"), "long-parameter-list", "info")
    coupled = tag(R.known_counts(e, s, "src", "dst", "n").where("n > 10"), "high-coupling", "warning")
    wide = R.neighbours(e, s.select("id", "file_path"), "dst", "src").join(s.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("n_file_path").alias("files")).where("n >= 3 AND files >= 4")
    m = R.contained(s.where("kind = 'method'"), s.where("kind = 'class'"), "file_path", "start_line", "end_line").groupBy(F.col("outer_id").alias("id")).agg(F.count("*").alias("methods"))
    god = m.join(k, "id", "left").where((F.col("methods") > many) | ((F.col("methods") > some) & (F.coalesce("callers", F.lit(0)) > popular)))
    c = R.with_ends(e, s, "file_path", "kind").where(F.col("src_kind").isin("function", "method"))
    busy = c.groupBy("src").agg(F.count("*").alias("n")).where("n >= 3").select("src")
    envious = c.where("dst_kind = 'method' AND dst_file_path <> src_file_path").groupBy("src", "dst_file_path").agg(F.count("*").alias("n")).where(F.col("n") >= envy).select("src").distinct().join(busy, "src", "left_semi").withColumnRenamed("src", "id")
    out = dead
    for df in (long, clumps, lists, coupled, tag(wide, "shotgun-surgery", "warning"), tag(god, "god-class", F.when(F.col("methods") > error, "error").otherwise("warning")), tag(envious, "feature-envy", "warning")):
        out = out.unionByName(df)
    return out


@query("rul05_smells", sql(_SMELLS + " SELECT id, smell, severity FROM al"))
def all_smells(g: Graph) -> DataFrame:
    return smells(g)


@query("rul05_smells_low", sql(_SMELLS_LOW + " SELECT smell, severity, count(*) AS n, count(DISTINCT id) AS symbols FROM al GROUP BY 1, 2"))
def low_smells(g: Graph) -> DataFrame:
    """With limits that small code bases reach."""
    return smells(g, **_LOW).groupBy("smell", "severity").agg(F.count("*").alias("n"), F.countDistinct("id").alias("symbols"))


_QUICK = "'dead-code', 'long-parameter-list', 'data-clumps'"


@query("agg16_smell_rollup", sql(_SMELLS + f" SELECT smell, severity, count(*) AS n, count(*) FILTER (WHERE smell IN ({_QUICK})) AS quick_fixes FROM al GROUP BY 1, 2"))
def smell_rollup(g: Graph) -> DataFrame:
    return smells(g).groupBy("smell", "severity").agg(F.count("*").alias("n"), F.count_if(F.expr(f"smell IN ({_QUICK})")).alias("quick_fixes"))


@query("srt05_severity_order", sql(_SMELLS + " SELECT id, smell, severity FROM al ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, smell, id LIMIT 20"))
def severity_order(g: Graph) -> DataFrame:
    place = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return smells(g).orderBy(place, "smell", "id").limit(20)


def _review_sql() -> str:
    parts = [f"SELECT id, '{r}' AS rule, '{s}' AS severity, 1::BIGINT AS n FROM sym WHERE regexp_matches(source_code, {_lit(p)})" for r, s, p in O.REVIEW_RULES]
    parts.append("SELECT id, 'note', 'info', len(regexp_extract_all(source_code, " + _lit(O.NOTES.replace("(.*)", "([^\\r\\n]*)")) + ")) FROM sym WHERE regexp_matches(source_code, '(?i)(TODO|FIXME|HACK|XXX|WORKAROUND)')")
    parts.append("SELECT id, 'deep-nesting', 'warning', max(d) FROM (SELECT id, (length(t) - length(replace(t, '{', ''))) - (length(t) - length(replace(t, '}', ''))) AS d FROM (SELECT id, unnest(string_split(source_code, chr(10))) AS t FROM sym)) GROUP BY id HAVING max(d) > 4")
    parts.append("SELECT id, 'large-function', 'info', len(string_split(source_code, chr(10))) FROM sym WHERE len(string_split(source_code, chr(10))) > 100")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ")"


@query("rul06_review", sql(_review_sql()))
def review(g: Graph) -> DataFrame:
    """Correctness, security, performance and readability findings (RUL06 to RUL09 but for magic numbers)."""
    return O.review(g.heavy("symbols"))


@query("rul07_document_secrets", "SELECT doc_id FROM documents WHERE regexp_matches(text, " + _lit(next(p for r, _, p in O.REVIEW_RULES if r == "hardcoded-secret")) + ")")
def document_secrets(g: Graph) -> DataFrame:
    return g.table("documents").where(F.col("text").rlike(next(p for r, _, p in O.REVIEW_RULES if r == "hardcoded-secret"))).select("doc_id")


@query("rul09_magic_numbers")
def magic(g: Graph) -> DataFrame:
    return O.magic_numbers(g.heavy("symbols"))


# What to do about each smell, in order; other smells have one step.
STEPS = {
    "god-class": ("Identify responsibilities", "Extract new classes", "Update callers"), "feature-envy": ("Move method", "Update references"), "shotgun-surgery": ("Introduce facade", "Route through facade"),
    "dead-code": ("Verify usage", "Remove if unused"), "high-coupling": ("Identify core dependencies", "Extract interfaces", "Apply dependency inversion"),
}
OTHER_STEP = "Review and refactor"
_RISK = "CASE WHEN severity = 'error' THEN 'high' WHEN smell IN ('god-class', 'shotgun-surgery') THEN 'medium' WHEN smell IN ('dead-code', 'long-parameter-list') THEN 'low' ELSE 'medium' END"
_EFFORT = "CASE WHEN smell IN ('dead-code', 'long-parameter-list', 'data-clumps') THEN 'quick' WHEN smell IN ('god-class', 'shotgun-surgery') THEN 'significant' ELSE 'moderate' END"
_USERS = "SELECT dst AS a, src AS b FROM edg WHERE src IN (SELECT id FROM sym) UNION SELECT src, dst FROM edg WHERE kind = 'calls' AND dst IN (SELECT id FROM sym)"


@query(
    "rul10_refactor_plan",
    sql(
        _SMELLS_LOW + ", st(smell, steps) AS (VALUES " + ", ".join(f"('{k}', '{' > '.join(v)}')" for k, v in STEPS.items()) + "), rt AS (SELECT DISTINCT id FROM al WHERE smell <> 'dead-code'), " + walk_sql("SELECT id AS root, id FROM rt", _USERS, 2, "")
        + f""", im AS (SELECT root AS id, count(*) - 1 AS symbols, count(DISTINCT s.file_path) AS files FROM reach JOIN sym s ON s.id = reach.id GROUP BY 1)
SELECT al.id, al.smell, coalesce(st.steps, '{OTHER_STEP}') AS steps, {_RISK} AS risk, {_EFFORT} AS effort, coalesce(im.symbols, 0) AS symbols_affected, coalesce(im.files, 1) AS files_affected FROM al LEFT JOIN st USING (smell) LEFT JOIN im ON im.id = al.id"""
    ),
)
def refactor_plan(g: Graph) -> DataFrame:
    """What to do about each smell, at what risk and effort, and how much it touches within two steps. Nothing refers to
    dead code, so its reach isn't searched."""
    from graphloom.operators.graph import reach
    from graphloom.storage import cut

    al = cut(smells(g, **_LOW), "smells")
    s = g.symbols("id", "file_path")
    e = g.edges()
    used = e.join(s.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("a"), F.col("src").alias("b"))
    calls = e.where("kind = 'calls'").join(s.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    r = reach(used.union(calls), al.where("smell <> 'dead-code'").select(F.col("id").alias("root")).distinct(), 2).join(s, "id").groupBy(F.col("root").alias("id")).agg((F.count("*") - 1).alias("symbols"), F.countDistinct("file_path").alias("files"))
    steps = F.create_map(*[F.lit(x) for k, v in STEPS.items() for x in (k, " > ".join(v))])
    rows = al.join(r, "id", "left")
    return rows.select("id", "smell", F.coalesce(F.try_element_at(steps, F.col("smell")), F.lit(OTHER_STEP)).alias("steps"), F.expr(_RISK).alias("risk"), F.expr(_EFFORT).alias("effort"), F.coalesce("symbols", F.lit(0)).cast("long").alias("symbols_affected"), F.coalesce("files", F.lit(1)).cast("long").alias("files_affected"))


def _intent_sql(kind: str = "commit_message") -> str:
    cols = ", ".join(f"({' + '.join(f'CASE WHEN regexp_matches(q, {_lit(p)}) THEN {pr} ELSE 0 END' for p in ps)}) AS s_{n}" for n, pr, ps in O.INTENTS)
    names = [n for n, _, _ in O.INTENTS]
    best = "greatest(" + ", ".join(f"s_{n}" for n in names) + ")"
    case = " ".join(f"WHEN s_{n} = {best} THEN '{n}'" for n in names)
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS q FROM documents WHERE doc_kind = '{kind}'), s AS (SELECT doc_id, {cols} FROM d) SELECT doc_id, CASE WHEN {best} = 0 THEN 'free_form' {case} END AS intent, round(CASE WHEN {best} = 0 THEN 0.3 ELSE least({best} / 16.0, 1.0) END, 6) AS confidence FROM s"


@query("rul16_intents", _intent_sql())
def intents(g: Graph) -> DataFrame:
    d = g.heavy("documents").where("doc_kind = 'commit_message'")
    return O.intents(d, "text").select("doc_id", "intent", F.round("confidence", 6).alias("confidence"))


#: Words of questions that are no names.
STOP = tuple(
    "the this that code function class module file method variable interface type enum import export does doing done using used handle handling handled implement implementing implemented process processing manage managing managed logic flow feature system "
    "project app application program codebase repo safely safe delete remove change modify update refactor check review test tested coverage can could should would will may might shall must what when where which who how why are was were has had have been being "
    "about between from into also any more than then just only very really well much many some each every both other another get set put let not new old big all here there these those anything something nothing everything happens happen calls called calling "
    "find found make made show shown give gave tell told take took need needed want look looks seem seems seemed wrong with without right good bad best worst compare versus diff like such same different is if and or define defined explain".split()
)
#: A word that may be a name: Pascal or camel case, or snake case of five characters and more.
NAME = r"^(?:[A-Z][A-Za-z0-9_]{2,}|[a-z][A-Za-z0-9]+|(?=.{5})[a-z][a-z0-9]*(?:_[a-z0-9]+)+)$"
PATH = r"(?:src|lib|packages|app)/[\w/.-]+"


def targets(text: Column) -> Column:
    """Struct (targets, keywords) of a question: paths first, then the names it mentions, each once in order; and the
    first ten other words of three characters and more."""
    words = F.filter(F.split(text, r"[\s,;()\[\]{}'\"]+"), lambda w: w != "")
    clean = F.filter(F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, r"[^a-zA-Z0-9_.-]+$", ""), r"^[^a-zA-Z0-9]+", "")), lambda w: w != "")
    quoted = F.filter(F.regexp_extract_all(text, F.lit(r"`([^`\s]+)`"), F.lit(1)), lambda w: w != "")
    names = F.filter(clean, lambda w: w.rlike(NAME) & ~F.lower(w).isin(*STOP))
    found = F.array_distinct(F.concat(F.slice(F.regexp_extract_all(text, F.lit(PATH), F.lit(0)), 1, 1), names, quoted))
    rest = F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"[^\w]", "")), lambda w: (F.length(w) > 2) & ~F.array_contains(found, w))
    return F.struct(found.alias("targets"), F.slice(rest, 1, 10).alias("keywords"))


_CLEAN = r"list_filter(list_transform(list_filter(regexp_split_to_array(text, '[\s,;()\[\]{}''\"]+'), lambda w: w <> ''), lambda w: regexp_replace(regexp_replace(w, '[^a-zA-Z0-9_.-]+$', ''), '^[^a-zA-Z0-9]+', '')), lambda w: w <> '')"
_IS_NAME = "(regexp_full_match(w, '[A-Z][A-Za-z0-9_]{2,}|[a-z][A-Za-z0-9]+') OR (length(w) >= 5 AND regexp_full_match(w, '[a-z][a-z0-9]*(_[a-z0-9]+)+'))) AND lower(w) NOT IN (" + ", ".join(f"'{x}'" for x in STOP) + ")"
#: The names of a text in order, then those in backticks.
SQL_TARGETS = "list_concat(list_filter(" + _CLEAN + ", lambda w: " + _IS_NAME + "), regexp_extract_all(text, '`([^`\\s]+)`', 1))"


@query(
    "rul17_targets",
    "WITH w AS (SELECT doc_id, unnest(list_distinct(list_concat(" + _CLEAN + ", regexp_extract_all(text, '`([^`\\s]+)`', 1)))) AS word FROM documents WHERE doc_kind = 'answer') SELECT word, count(*) AS docs FROM w WHERE (regexp_full_match(word, '[A-Z][A-Za-z0-9_]{2,}|[a-z][A-Za-z0-9]+') OR (length(word) >= 5 AND regexp_full_match(word, '[a-z][a-z0-9]*(_[a-z0-9]+)+'))) AND lower(word) NOT IN (" + ", ".join(f"'{x}'" for x in STOP) + ") GROUP BY 1",
)
def keywords(g: Graph) -> DataFrame:
    """Names that documents mention, with the number of documents."""
    t = g.heavy("documents").where("doc_kind = 'answer' AND text IS NOT NULL").select(F.explode(F.filter(targets(F.col("text"))["targets"], lambda w: w.rlike(NAME) & ~F.lower(w).isin(*STOP))).alias("word"))
    return t.groupBy("word").agg(F.count("*").alias("docs"))
