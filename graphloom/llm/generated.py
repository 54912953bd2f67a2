"""Problem 1: files nobody wrote by hand - generated, compiled, minified, vendored, data saved as code.

Merkle hashes over the directory trees mark copies shared between unrelated repositories; rules on path, header and
layout catch the rest. All of it is JVM-side; what is shuffled is a few numbers and the comments above a file's code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.versions import latest
from graphloom.storage import cut

# Directories and names that package managers, compilers and generators use.
VENDOR_DIRS = r"(^|/)(node_modules|bower_components|jspm_packages|vendor|third[_-]?party|3rd[_-]?party|3rdparty|thirdparty|external|externals|vendored|_vendor|_vendored|site-packages|dist-packages|\.?venv|virtualenv|\.pio/libdeps|libdeps|Pods|Carthage|\.yarn|\.cargo/registry|pkg/mod|\.gradle|\.m2)/"
BUILT_DIRS = r"(^|/)(dist|\.next|\.nuxt|\.output|\.svelte-kit|\.parcel-cache|build/(out|output|lib|generated|gen|tmp|dist|js|classes)|out/(production|gen|build)|target/(codegen|generated[\w-]*|classes|debug|release|gen)|__generated__|generated|_generated|autogen|gen|codegen-out|obj/(debug|release)|bin/(debug|release)|cmake-build-[\w-]+|__pycache__)/"
NAMES = r"(?i)(\.min\.(js|mjs|cjs|css)|[.-]bundle\.(js|mjs|css)|\.chunk\.js|\.map|\.generated\.\w+|\.gen\.\w+|\.g\.(ts|tsx|dart|cs|js)|\.designer\.cs|\.pb\.(go|cc|h|ts|js|swift)|\.pb-c\.[ch]|_pb2(_grpc)?\.pyi?|_pb\.(js|d\.ts|rb)|\.pbobjc\.[hm]|_grpc_pb\.js|\.freezed\.dart|zz_generated\.[\w.]+|\.tab\.[ch]|\.yy\.[ch]|lex\.yy\.c|moc_\w+\.cpp|ui_\w+\.h|qrc_\w+\.cpp)$"
LOCKS = r"(?i)(^|/)(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|composer\.lock|gemfile\.lock|cargo\.lock|poetry\.lock|pipfile\.lock|go\.sum|flake\.lock)$"
# Hand-written tools around such things live here.
TOOL_DIRS = r"(^|/)(tools|scripts|src/builders|builders|generator|generators)/"
# Configuration is no case by its text: settings repeat, are long tables and quote generated values.
CONFIG = r"(?i)(\.(env|ya?ml|json|toml|ini|cfg|conf|properties)|(^|/)\.env[\w.]*)$"

_SELF = r"(this|the|these) ([\w.-]+ )?(file|code|source|module|class|header|script|document)s?"
_MADE = r"(produced|created|generated|written|built|emitted|compiled|autogenerated)"
#: Headers whose subject is the file itself: a tag, a clause that begins with the marker, or one about "this file".
#: A marker said of something else ("ids are generated by ...", "do not edit their order") is none.
GENERATED_HEADER = (
    r"(?im)^(@generated\b|<auto-?generated|auto-?generated(\s+(file|code|source|by|from|with)\b|\s*[.;,:!-]|\s*$)|machine[ -](written|generated)\b|code generated by\b|(automatically )?(generated|autogenerated) (automatically )?(by|from|with|using)\b|generated (file|code)\b)"
    rf"|{_SELF} (was|is|were|are|has been|have been) (machine[ -]|automatically |auto-?)?{_MADE} ?(automatically )?(by|from|with|using|automatically)|{_SELF} (was|is|has been) auto-?generated"
    r"|(^|[.;:!,-] *)(please )?(do not|don't) (edit|modify|change)( (this|the) (generated )?file| by hand| manually| directly| it)*[\s.!;*/-]*$|(manual |local |any )?(changes|edits|modifications)( to this file| made( here)?| here)? (will|may|would) be (overwritten|lost|discarded)"
    r"|^(auto-?generated )?[\w -]*\brun `[^`]+` to (refresh|regenerate|rebuild|update)"
    r"|(diese datei|dieser code) (wurde|ist|wird) [^\n]*(erzeugt|generiert|erstellt)|^automatisch\s+(aus\s+\S+\s+)?(erzeugt|generiert|erstellt)|nicht von hand (ändern|bearbeiten|editieren)"
    r"|généré automatiquement|ne pas (modifier|éditer)|generado automáticamente|no (editar|modificar)|自动生成|请勿(手动)?(修改|编辑)|自動生成"
)
VENDORED_HEADER = (
    r"(?im)third[ -]?party (code|source|library|software)\s*:|copied verbatim|verbatim (copy )?(of|from)|(imported|vendored|copied|taken|extracted|mirrored|borrowed) (unmodified |unchanged )?from (upstream|[\w.@/-]+ (release|version|v?\d))|amalgamation of|single[- ]file (build|amalgamation)"
    r"|send (fixes|patches|changes) upstream|local (changes|modifications)\s*:\s*none|, unmodified\.?|see its own licen[cs]e|keep in sync with upstream|^\W*(/\*+!?\s*)?[@\w./-]+ v?\d+\.\d+(\.\d+)?\S* *\| *\(c\)|\| *(MIT|BSD[\w-]*|Apache[\w -]*|ISC) licen[cs]e"
)
#: What compilers and bundlers put into their output, at the start of a line.
COMPILED = (
    r"(?m)^(\"use strict\";)?(/\*{3}/ |//[#@] sourceMappingURL=|/\*# sourceMappingURL=|Object\.defineProperty\(exports, [\"']__esModule[\"']|System\.register\(|var Module ?= ?typeof Module|goog\.loadModule\(function|\(function webpackUniversalModuleDefinition|/\* harmony (import|export)"
    r"|var __(awaiter|generator|extends|assign|rest|decorate|param|metadata|importDefault|importStar|createBinding|exportStar|setModuleDefault|spreadArrays?|read|values|asyncGenerator|makeTemplateObject)\b ?= ?\(?this && this\.__|var __(defProp|getOwnPropNames|getOwnPropDesc|commonJS|toESM|toCommonJS|copyProps|export) ?= "
    r"|function _(interopRequire(Default|Wildcard)|classCallCheck|createClass|defineProperties|possibleConstructorReturn|asyncToGenerator|objectSpread2?|getPrototypeOf|assertThisInitialized)\()"
)

# What may stand above a file's code, in runs without any bound; possessive, so that the engine neither recurses nor turns back.
_DIRECTIVE = r"#[ \t]*+(?:include|define|undef|pragma|ifdef|ifndef|if|endif|else|elif|import|region|endregion)\b[^\n]*+"
COMMENT = rf"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)|(?!{_DIRECTIVE})#[^\n]*+|--[^\n]*+|<!--(?:[^-]++|-(?!->))*+-->|\"\"\"(?:[^\"]++|\"(?!\"\"))*+\"\"\"|'''(?:[^']++|'(?!''))*+'''|\(\*(?:[^*]++|\*(?!\)))*+\*\)"
_IMPORT = (
    rf"{_DIRECTIVE}|import\s++\([^)]*+\)|import\b\s*+(?:type\s++)?+(?:[\w$*\s,]*+(?:\{{[^}}]*+\}})?+[\w$\s,*]*+)?+[\"'][^\"'\n]*+[\"'][^\n]*+|import\s++[\w.*, \t]++;?+|from\s++[\w.]++\s++import\s++(?:\([^)]*+\)|[^\n]*+)"
    r"|export\s*+(?:\*|\{[^}]*+\})[^\n]*+|(?:const|let|var)\s++[^=\n]++=\s*+require\([^)\n]*+\)[^\n]*+|package\s++[\w.]++;?+|using\s++[^;\n]*+;|use\s++[^;]*+;|extern crate [^\n]*+|[\"']use strict[\"'];?+|<\?php"
)
PREAMBLE = rf"\A(?:\s++|{COMMENT}|{_IMPORT})*+"
#: Marks of comments at the ends of lines, taken away before the header rules look for clauses.
MARKS = r"(?m)^[ \t]*(?:/\*+!?|\*+/?|//+[/!]?|#+!?|--+|<!--|\"\"\"|'''|\(\*)?[ \t]*|[ \t]*(?:\*+/|-->|\"\"\"|'''|\*\))?[ \t\r]*$"


PEM = r"(?s)-----BEGIN [A-Z0-9 ]+-----.*?(-----END [A-Z0-9 ]+-----|\z)"


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, " \t\r\n", ""))


def header(code: Column) -> Column:
    """The comments above a file's code, without marks; imports and directives may stand before and between them."""
    top = F.regexp_extract(code, PREAMBLE, 0)
    return F.regexp_replace(F.array_join(F.regexp_extract_all(top, F.lit(COMMENT), F.lit(0)), "\n"), MARKS, "")


def bare(code: Column) -> Column:
    """Code without its leading comments, line ends, indentation and blanks, so that those don't tell copies apart."""
    return F.translate(F.regexp_replace(code, rf"\A(?:\s++|{COMMENT})*+", ""), " \t\r\n", "")


def layout(symbols: DataFrame) -> DataFrame:
    """(path, head, compiled, n_code, n_bare, n_chars, long_chars, dense_chars, data_chars, n_lines, content) of each file from the current rows of its symbols.

    ``head`` is the comment above the code of the symbol with the least start line, if that is the file's first or
    stands for the file itself; ``compiled`` tells of marks of compilers and bundlers, ``n_code`` counts symbols with
    code, ``long_chars`` the characters in lines over 300, ``dense_chars`` those of symbols of 200 characters or more
    with under 5 % white space, ``data_chars`` the digits, commas, blanks and hexadecimal marks of literals. Key blocks
    count as no code: a file isn't data for holding one. Methods are left out, as their class has them.
    """
    raw = F.coalesce("source_code", F.lit(""))
    code = F.when(raw.contains("-----BEGIN "), F.regexp_replace(raw, PEM, "")).otherwise(raw)
    n = F.length(code)
    longest = F.regexp_replace(code, r"(?m)^.{0,300}$", "")
    data = n - F.length(F.regexp_replace(code, r"\b(0[xX][0-9a-fA-F]+|-?\d[\d.eE+-]*)\b[ \t]*,?|[\"'][A-Za-z0-9+/=\\n]{40,}[\"'],?|(?m)^[A-Za-z0-9+/=]{40,}$", ""))
    rows = symbols.where(F.coalesce("kind", F.lit("")) != "method")
    line = F.coalesce("start_line", F.lit(0))
    values = latest(
        rows, "id", "updated_at", "file_path", line.alias("line"), F.when((line <= 1) | (F.col("kind") == "module"), header(raw)).alias("head"), raw.rlike(COMPILED).alias("compiled"), n.alias("n"),
        (F.length(longest) - F.length(F.translate(longest, "\n", ""))).alias("nl"), F.length(F.translate(longest, "\r\n", "")).alias("long"),
        F.when((n >= 200) & (_spaces(code) < 0.05 * n), n).otherwise(0).alias("dense"), data.alias("data"), F.length(bare(raw)).alias("bare"), F.xxhash64(bare(raw), F.lit(1)).alias("h1"), F.xxhash64(bare(raw), F.lit(7)).alias("h2"),
    )
    h = lambda c: F.sum(F.when(F.col("bare") > 0, F.xxhash64(c)).cast("decimal(20,0)")).cast("string")
    return values.groupBy(F.col("file_path").alias("path")).agg(
        F.min_by("head", F.struct("line", "id")).alias("head"), F.max("compiled").alias("compiled"), F.count(F.when(F.col("bare") > 0, 1)).alias("n_code"), F.sum("bare").alias("n_bare"), F.sum("n").alias("n_chars"), F.sum("long").alias("long_chars"), F.sum("dense").alias("dense_chars"),
        F.sum("data").alias("data_chars"), F.sum("nl").alias("n_lines"), F.when(F.sum("bare") > 0, F.concat_ws(":", h("h1"), h("h2"))).alias("content"),
    )


def _above(p: Column) -> Column:
    """The directories above a path in parts, the repository's root first."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(p) - 1)), lambda i: F.array_join(F.slice(p, 1, i), "/"))


def merkle(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(dir, repo, n_files, n_chars, digest) of every directory, from files with path, content and n_chars.

    Bottom-up, one aggregation a level: the digest of a directory is the sum (modulo nothing, in decimals) of hashes
    of its children's names and digests, so no directory's children are ever collected in one place. Each level is
    a written table, which keeps the plan of the next one small. A file with null content is counted and else passed
    over: a copy may lose its licence or gain a note. The digest is null only if there is no content at all.
    """
    parts = F.split("path", "/")
    leaves = files.select(parts.alias("p"), F.size(parts).alias("depth"), F.col("content").alias("digest"), F.lit(1).cast("long").alias("n_files"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"))
    if max_depth is None:
        max_depth = leaves.agg(F.max("depth")).first()[0] or 1
    level, out = None, []
    for d in range(max_depth, 1, -1):
        here = leaves.where(F.col("depth") == d)
        if level is not None:
            here = here.unionByName(level)
        up = here.select(F.slice("p", 1, d - 1).alias("p"), F.element_at("p", d).alias("name"), "digest", "n_files", "n_chars")
        h = lambda salt: F.sum(F.when(F.col("digest").isNotNull(), F.xxhash64("name", "digest", F.lit(salt))).cast("decimal(20,0)")).cast("string")
        level = up.groupBy("p").agg(F.when(F.count("digest") > 0, F.concat_ws(":", h(1), h(2))).alias("digest"), F.sum("n_files").alias("n_files"), F.sum("n_chars").alias("n_chars"))
        level = cut(level.withColumn("depth", F.lit(d - 1)), "merkle")
        out.append(level.select(F.array_join("p", "/").alias("dir"), F.element_at("p", 1).alias("repo"), "n_files", "n_chars", "digest"))
    if not out:
        return leaves.select(F.lit("").alias("dir"), F.lit("").alias("repo"), "n_files", "n_chars", "digest").limit(0)
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def _two_repos(rows: DataFrame, key: str) -> DataFrame:
    """The keys that stand in more than one repository; one partial aggregate a key, however often it occurs."""
    return rows.groupBy(key).agg(F.min("repo").alias("a"), F.max("repo").alias("b")).where("a <> b").select(key)


def _leaves(files: DataFrame) -> DataFrame:
    """``files`` within a repository, with ``twin``: whether the content also stands in another repository."""
    rows = files.where(F.col("path").contains("/")).withColumn("repo", F.substring_index("path", "/", 1))
    twins = _two_repos(rows.where(F.col("content").isNotNull()), "content").withColumn("twin", F.lit(True))
    return cut(rows.join(twins, "content", "left").withColumn("twin", F.coalesce("twin", F.lit(False))), "leaves")


def shared_trees(files: DataFrame, min_chars: int = 200, leaves: DataFrame | None = None) -> DataFrame:
    """(dir, repo): the directories whose whole subtree (names and content) also stands in another repository.

    The repository is the first part of a path; a repository's root is no subtree. Subtrees of fewer than
    ``min_chars`` characters tell nothing. A directory can have a twin only if each of its leaves with content has
    one, so hashes are built bottom-up above such directories only: where nothing is shared, that is one aggregation.
    """
    leaves = _leaves(files) if leaves is None else leaves
    code = leaves.where(F.col("content").isNotNull())
    whole = code.select(F.explode(_above(F.split("path", "/"))).alias("dir"), "twin", "n_chars").groupBy("dir").agg(F.min("twin").alias("whole"), F.sum("n_chars").alias("n"))
    whole = cut(whole.where(F.col("whole") & (F.col("n") >= min_chars) & F.col("dir").contains("/")).select("dir"), "whole")
    if whole.isEmpty():
        return leaves.select(F.lit("").alias("dir"), "repo").limit(0)
    under = code.where("twin").select("path", "content", "n_chars", F.explode(_above(F.split("path", "/"))).alias("dir")).join(whole, "dir", "left_semi").select("path", "content", "n_chars").distinct()
    trees = merkle(cut(under, "under")).join(whole, "dir", "left_semi")
    return trees.join(_two_repos(trees, "digest"), "digest", "left_semi").select("dir", "repo")


def shared_paths(files: DataFrame, min_chars: int = 200, min_code: int = 2) -> DataFrame:
    """(path, why) of the files that also stand in another repository, by a whole directory or by themselves.

    ``files`` has path, content (a digest, null without code), n_code and n_chars. All files of a shared directory
    count, those without code too. A single file must have ``min_code`` symbols with code, as one function alone is
    copied between people's own files.
    """
    leaves = _leaves(files)
    trees = shared_trees(files, min_chars, leaves).select("dir").distinct()
    alone = leaves.where(F.col("twin") & (F.col("n_code") >= min_code) & (F.col("n_chars") >= min_chars)).select("path", F.lit("shared file").alias("why"))
    every = leaves.select("path", F.explode(_above(F.split("path", "/"))).alias("dir")).join(trees, "dir", "left_semi").select("path", F.lit("shared tree").alias("why"))
    return alone.unionByName(every).groupBy("path").agg(F.max("why").alias("why"))


def classify(files: DataFrame, symbols: DataFrame, data_least: int = 900) -> DataFrame:
    """(path, reason) of every current path of ``files``; ``reason`` is null for hand-written files.

    Reasons: shared tree, shared file, vendored path, built path, generated name, generated header, vendored header,
    compiled, minified layout, data layout (of ``data_least`` characters at least: a short table is written by hand),
    long lines by size. Configuration is judged by tree, path and name only. Files without symbols are judged by path
    and by size and line count alone; null, zero and negative sizes tell nothing. Null paths are dropped.
    """
    current = latest(files, "path", "parsed_at", F.col("size"), F.col("line_count"))
    rows = current.join(layout(symbols), "path", "left")
    rows = cut(rows, "layout")
    shared = shared_paths(rows.select("path", "content", "n_code", F.col("n_bare").alias("n_chars")))
    rows = rows.join(shared, "path", "left")
    head = F.coalesce("head", F.lit(""))
    n = F.coalesce("n_chars", F.lit(0))
    per_line = F.when((F.col("size") > 0) & (F.col("line_count") > 0), F.col("size") / F.col("line_count"))
    reason = (
        F.when(F.col("why").isNotNull(), F.col("why"))
        .when(F.col("path").rlike(VENDOR_DIRS), "vendored path")
        .when(F.col("path").rlike(NAMES) | F.col("path").rlike(LOCKS), "generated name")
        .when(F.col("path").rlike(BUILT_DIRS) & ~F.col("path").rlike(TOOL_DIRS), "built path")
        .when(F.col("path").rlike(CONFIG), None)
        .when(head.rlike(GENERATED_HEADER), "generated header")
        .when(head.rlike(VENDORED_HEADER), "vendored header")
        .when(F.col("compiled"), "compiled")
        .when((n >= 200) & (F.col("dense_chars") > 0.5 * n), "minified layout")
        .when((n >= data_least) & (F.col("data_chars") > 0.5 * n), "data layout")
        .when((per_line > 150) & (F.col("size") > 2000), "long lines by size")
    )
    return rows.select("path", reason.alias("reason"))
