"""Problem 5: functions and methods paired with documentation that says something."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.generated import COMMENT

# Words that tell nothing, directives, templates.
EMPTY_WORDS = frozenset("a an the this that these those it its of to for and or is are be was in on at by as with from function method class procedure routine def func fn constructor destructor getter setter implementation result results value values return returns returned returning param parameter parameters arg args argument object type none null void description documentation summary docs doc comment here todo name does do".split())
DIRECTIVE = re.compile(r"(?i)^(noqa|eslint|prettier|pylint|flake8|mypy|pyright|type:\s*ignore|nolint|nosec|nosonar|istanbul|c8 ignore|v8 ignore|ts-|@ts-|tslint|jshint|jslint|clang-format|clang-tidy|cppcheck|coverity|pragma|fmt:|isort|yapf|ruff|coverage|rubocop|checkstyle|noinspection|biome-ignore|deno-|webpack|@?__pure__|region|endregion|-\*-|vim:)")
NOTE = re.compile(r"(?i)^@?(?:(?:todo|fixme|xxx|hack|tbd|tbc|wip)\b|待补充|待完善|待定|暂无|无描述|待办)")
LICENCE = re.compile(r"(?i)copyright|\(c\)\s*\d{4}|spdx-|licen[sc]ed under|all rights reserved|permission is hereby|released under|@licen[sc]e|redistribution and use")
TEMPLATE = re.compile(r"(?i)here goes|(add|write|insert|put|enter|provide|replace)\b.{0,40}\b(description|docs?|documentation|docstring|summary|text|comment)\b|describe me|(method|function|class|short|brief|long) description|description of (the|this) (function|method|class)|auto-?generated|editor template|undocumented|no (documentation|description|comment)|not (yet )?documented|^ditto|^n\s*/?\s*a\b\.?$|exactly what its name|what (it|the name) says|self[- ]?explanatory|^see (above|below|code|name|source)|^missing (docs|docstring)|^placeholder|lorem ipsum|^(non-)?javadoc|^constructor\b\.?$|^(getter|setter)\b")
INHERIT = re.compile(r"(?i)\{?@inherit-?doc\}?|^\s*see (the )?(base|super|parent) ?class\.?\s*$|^\s*inherited(\.| from (base|super|parent))")
TAG = re.compile(r"^(?:@|\\|:)\s*(\w+)\b[ \t]*(?:\{[^}]*\})?[ \t]*(.*)$")
NAMED = frozenset("param parameter arg argument key keyword raises throws exception property prop var attribute template tparam typeparam type rtype retval".split())
CODE = re.compile(
    r"[;{}]\s*$|->|&&|\|\||::|=>|^\s*(if|elif|while|for|with|switch|until)\b.*[(:<>=]|^\s*(try|else|finally|do)\s*[:{]?\s*$"
    r"|^\s*(return|raise|throw|await|yield|goto|const|let|var|static|import|from|def|class|async|except|catch|case|print|del|assert|int|void|char|long|bool|unsigned|struct)\s+[\w*&(.]+\s*([(\[=.;,]|$)"
    r"|^[\w.\[\]\"'*&>-]+(\s*,\s*[\w.\[\]]+)*\s*([-+*/%|&^]?=)\s*\S|^[\w.>-]+\(.*\)\s*;?$|^[)\]}]+[;,]?$|^#\s*(include|define|if|ifdef|endif)\b"
)
WORD = re.compile(r"[^\W\d_]+|\d+")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")
CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
OPENING = re.compile(r"\s*(/\*(.*?)\*/|(?:[ \t]*(?://|#(?!\s*(?:include|define|if|ifdef|ifndef|endif|pragma|else|undef)\b))[^\n]*(?:\n|\Z))+)", re.S)
DOCSTRING = re.compile(r"\bdef\s+\w+\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*(?:->\s*[^:\n]+)?:[ \t]*(?:#[^\n]*)?\s*[rRuUbB]{0,2}(\"\"\"(.*?)(?:\"\"\"|\Z)|'''(.*?)(?:'''|\Z)|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)')", re.S)
MARKS = re.compile(r"^\s*(?:/\*+!?<?|\*+/|\*(?!\*)|//+[!/<]?|#+!?|\"\"\"|''')?[ \t]*|\s*\*+/\s*$")


def lines_of(doc: str) -> list[str]:
    """A comment's text without its marks and markup, line by line."""
    doc = re.sub(r"</?[A-Za-z][^>\n]{0,80}>", "", doc.replace("\r\n", "\n").replace("\r", "\n"))
    return [MARKS.sub("", MARKS.sub("", x)).strip() for x in doc.split("\n")]


def _stems(text: str) -> set[str]:
    out = set()
    for w in PARTS.findall(text):
        w = w.lower()
        out |= {w, w + "s", w + "es", w + "ed", w + "d", w + "ing", w.rstrip("e") + "ing", w.rstrip("y") + "ies", w + w[-1:] + "ing", w + w[-1:] + "ed"}
    return out


def informative(text: str, known: set[str]) -> int:
    """Words of ``text`` that neither are empty nor follow from the ``known`` ones; two CJK characters are a word."""
    cjk = len(CJK.findall(text))
    words = [w for x in WORD.findall(CJK.sub(" ", text)) for w in PARTS.findall(x)]
    return cjk // 2 + sum(1 for w in words if (len(w) > 1 or w.isdigit()) and w.lower() not in EMPTY_WORDS and w.lower() not in known)


def description(doc: str | None, name: str | None, signature: str = "") -> str:
    """What ``doc`` tells in prose beyond name and signature, else the empty string.

    Names only, placeholders, to-do notes and templates, directives, licence lines, rulers, code, and tags that only
    repeat names and types tell nothing.
    """
    if not doc:
        return ""
    known = _stems(name or "") | _stems(signature)
    own = _stems(name or "")
    kept, score, tagged = [], 0, 0
    for line in lines_of(doc):
        if not any(c.isalnum() for c in line) or re.match(r"^[-=*~#_+.<>]{3,}.*[-=*~#_+.<>]{3,}$", line):
            continue
        if DIRECTIVE.search(line) or NOTE.search(line) or LICENCE.search(line) or TEMPLATE.search(line) or INHERIT.search(line):
            continue
        if m := TAG.match(line):
            rest = m[2].strip()
            label = ""
            if m[1].lower() in NAMED:
                label, _, rest = rest.partition(" ") if " " in rest else (rest, "", "")
            n = informative(rest.strip(" :-"), known | _stems(label))
            tagged += n
            if n:
                kept.append(rest.strip(" :-"))
            continue
        if CODE.search(line):
            continue
        score += informative(line, own)
        kept.append(line)
    return " ".join(kept) if score >= 2 or tagged >= 3 else ""


def places(doc_comment: str | None, code: str | None) -> list[str]:
    """The texts that may document a function: its doc comment, its docstring, the comments that open its code."""
    out = [doc_comment] if doc_comment else []
    if code:
        if (m := DOCSTRING.search(code)) and not re.search(r"[;{]\s*\n", code[: m.start()]):
            out.append(next((x for x in m.groups()[1:] if x is not None), ""))
        if m := OPENING.match(code):
            out.append(m[0])
    return out


def describe(doc_comment: str | None, code: str | None, name: str | None) -> str:
    """The description of a function from the first of its places that tells something, else the empty string."""
    signature = ""
    if code:
        body = code[m.end() :] if (m := OPENING.match(code)) else code
        signature = body.split("{", 1)[0].split("\n", 1)[0]
    for doc in places(doc_comment, code):
        if said := description(doc, name, signature):
            return said
    return ""


@F.pandas_udf(T.StringType())
def _described(docs, codes, names):  # noqa: ANN001, ANN202
    import pandas as pd

    return pd.Series([describe(d, c, n) for d, c, n in zip(docs, codes, names, strict=True)], dtype=object)


def described(symbols: DataFrame) -> DataFrame:
    """Version rows of the functions and methods: id, updated_at, name, file_path, kind, parent, has, description."""
    rows = symbols.where(F.col("kind").isin("function", "method")).withColumn("has", F.coalesce(F.length("source_code") > 0, F.lit(False)))
    said = F.when(F.col("has"), _described(F.col("doc_comment"), F.col("source_code"), F.col("name")))
    return rows.select("id", "updated_at", "name", "file_path", "kind", F.col("metadata")["parent"].alias("parent"), "has", said.alias("description"))


_TOP = rf"\A(?:\s++|{COMMENT}|@[\w.]++(?:\((?:[^()]++|\([^()]*+\))*+\))?+|(?:export|default|declare|public|private|protected|internal|abstract|final|static|sealed|partial|data|open)\b)*+(?:class|interface|struct)\s++[\w$]++(?:<(?:[^<>]++|<[^<>]*+>)*+>)?+\s*+"
#: What follows a class's name: ``(B, C)``, ``extends B implements C``, ``: public B`` or ``: B, C {``.
BASES = rf"(?s){_TOP}(?:\(([^)]*+)\)|:?\s*+((?:extends|implements|public|protected|private|virtual)\b[^{{]*+)|:[ \t]*+([A-Z][^{{\n]*+))"
#: What stands among base classes and names none.
NO_BASE = ("extends", "implements", "public", "protected", "private", "virtual", "object", "class", "where", "with")


def _stem(path: Column) -> Column:
    """The name by which a file is imported: its own without extension, its directory's if it stands for that."""
    own = F.regexp_extract(path, r"([^/]+?)(\.[^/.]*)?$", 1)
    return F.when(own.isin("index", "__init__", "mod"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)).otherwise(own)


def class_parents(symbols: DataFrame) -> DataFrame:
    """(file_path, class, base, place, stem) of every base of every current class, as its code names it.

    ``place`` counts the bases of a class from 0 and ``stem`` is the name of the module that the file imports the base
    from, null if it doesn't. The whole head of a class is read, qualified names count by their last part.
    """
    from graphloom.operators.versions import latest

    code = F.coalesce("source_code", F.lit(""))
    found = F.concat(*[F.regexp_extract(code, BASES, i) for i in (1, 2, 3)])
    heads = latest(symbols.where(F.col("kind").isin("class", "interface", "struct")), "id", "updated_at", F.col("name").alias("class"), "file_path", found.alias("h"))
    plain = F.regexp_replace(F.regexp_replace("h", r"<[^<>]*+>|\[[^\[\]]*+\]", ""), r"\w+\s*=\s*[\w.]+", "")
    names = F.transform(F.regexp_extract_all(plain, F.lit(r"[A-Za-z_$][\w$.]*"), F.lit(0)), lambda x: F.substring_index(x, ".", -1))
    bases = heads.where("file_path IS NOT NULL AND class IS NOT NULL").select("file_path", "class", F.posexplode(F.filter(names, lambda x: ~x.isin(*NO_BASE))).alias("place", "base"))
    bases = bases.groupBy("file_path", "class", "base").agg(F.min("place").alias("place"))
    imports = latest(symbols.where("kind = 'module'"), "id", "updated_at", "file_path", F.col("source_code").alias("text")).where("file_path IS NOT NULL AND text IS NOT NULL").groupBy("file_path").agg(F.max("text").alias("text"))
    quoted = F.regexp_replace("base", r"\$", "\\\\\\$")
    named = [F.concat(F.lit(x), quoted, F.lit(y)) for x, y in ((r"import\s[^;'\"]*\b", r"\b[^;'\"]*?from\s*['\"]([^'\"]+)['\"]"), (r"from[ \t]+([\w.]+)[ \t]+import[ \t]*(?:\([^)]*\b|[^\n]*\b)", r"\b"), (r"import\s+([\w.]+\.", r")\s*;"))]
    spec = F.coalesce(*[F.nullif(F.call_function("regexp_extract", F.col("text"), x, F.lit(1)), F.lit("")) for x in named])
    last = F.when(spec.contains("/") | spec.startswith("."), _stem(F.regexp_replace(spec, r"(^|/)\.+(?=[^/.])", "$1"))).otherwise(F.substring_index(spec, ".", -1))
    return bases.join(imports, "file_path", "left").select("file_path", "class", "base", "place", last.alias("stem"))


def parent_classes(symbols: DataFrame) -> DataFrame:
    """(file_path, class, place, up_file, up_class): the class that each base of each current class is.

    A base is looked for in the same file, then in the file it is imported from, then in the same directory, then
    elsewhere in the same repository (the first part of a path); of several in one place that of the least path
    counts. It isn't looked for in other repositories: what only shares a name documents nothing here. Each place has
    one row a name, so a name that everybody uses multiplies nothing.
    """
    homes = symbols.where("kind IN ('class', 'interface', 'struct') AND name IS NOT NULL AND file_path IS NOT NULL").select(F.col("file_path").alias("up_file"), F.col("name").alias("base"))
    where = lambda c: {"in_file": c, "in_repo": F.substring_index(c, "/", 1), "in_dir": F.regexp_extract(c, r"^(.*)/[^/]*$", 1)}
    rows = class_parents(symbols).withColumns(where(F.col("file_path")))
    places = homes.withColumns(where(F.col("up_file"))).withColumn("stem", _stem(F.col("up_file")))
    for i, keys in enumerate((["in_file"], ["in_repo", "stem"], ["in_dir"], ["in_repo"])):
        one = places.groupBy("base", *keys).agg(F.min("up_file").alias(f"up_{i}"))
        rows = rows.join(one, ["base", *keys], "left")
    own = F.coalesce(*[F.when((F.col(f"up_{i}") != F.col("file_path")) | (F.col("base") != F.col("class")), F.col(f"up_{i}")) for i in range(4)])
    return rows.select("file_path", "class", "place", own.alias("up_file"), F.col("base").alias("up_class")).where("up_file IS NOT NULL").distinct()


def doc_pairs(symbols: DataFrame) -> DataFrame:
    """(id, description, from_id) of each function or method whose documentation says something.

    The current row of an id counts. Documentation stands in ``doc_comment``, as docstring or in the comments that
    open ``source_code``. A method that overrides one and says nothing itself takes the description of the nearest
    class above it that has one for a method of that name (``from_id`` tells whose): the class hierarchy is climbed by
    joins, one level of all classes at a time, until no new class is reached, which also ends cycles. Of several at
    the same distance that of the earlier base counts, then that of the least id. What stays empty is dropped, and so
    are rows with null or empty code.
    """
    from graphloom.operators.versions import latest
    from graphloom.storage import cut

    rows = latest(described(symbols), "id", "updated_at", "name", "file_path", "kind", "parent", "has", "description")
    rows = cut(rows.where(F.col("has")), "described")
    done = rows.where(F.col("description") != "").select("id", "description", F.col("id").alias("from_id"))
    method = rows.where("kind = 'method' AND parent IS NOT NULL AND name IS NOT NULL AND file_path IS NOT NULL").withColumnRenamed("parent", "class")
    open_ = method.where("description = ''").select("id", "name", "file_path", "class")
    up = cut(parent_classes(symbols), "parents")
    if up.isEmpty():
        return done
    # (class, class above, distance, order of the bases that lead there), of classes with open methods.
    level = cut(open_.select("file_path", "class").distinct().join(up, ["file_path", "class"]).select("file_path", "class", "up_file", "up_class", F.lit(1).alias("far"), F.array("place").alias("way")), "above")
    above, far = level, 1
    while not level.isEmpty():
        far += 1
        next_ = level.join(up.select(F.col("file_path").alias("up_file"), F.col("class").alias("up_class"), "place", F.col("up_file").alias("f"), F.col("up_class").alias("c")), ["up_file", "up_class"])
        next_ = next_.select("file_path", "class", F.col("f").alias("up_file"), F.col("c").alias("up_class"), F.lit(far).alias("far"), F.concat("way", F.array("place")).alias("way"))
        next_ = next_.groupBy("file_path", "class", "up_file", "up_class").agg(F.first("far").alias("far"), F.min("way").alias("way"))
        level = cut(next_.join(above, ["file_path", "class", "up_file", "up_class"], "left_anti").select(*level.columns), "above")
        above = above.unionByName(level)
    said = method.where("description <> ''").groupBy(F.col("file_path").alias("up_file"), F.col("class").alias("up_class"), "name").agg(F.min(F.struct("id", "description")).alias("d"))
    found = open_.join(above, ["file_path", "class"]).join(said, ["up_file", "up_class", "name"]).groupBy("id").agg(F.min(F.struct("far", "way", "d.id", "d.description")).alias("b"))
    return done.unionByName(found.select("id", "b.description", F.col("b.id").alias("from_id")))
