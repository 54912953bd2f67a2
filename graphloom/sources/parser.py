"""Structural parsing of source text: symbols, relations between names, and import records of one file.

Python goes through its own grammar. The brace languages (C, C++, C#, Go, Java, JavaScript, Kotlin, PHP, Rust, Swift,
TypeScript) are read in two steps: literals and comments are masked by blanks of the same length, then declarations are
matched on what is left and closed by counting brackets. Text that breaks off in the middle gives what was complete.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from typing import NamedTuple

BRACES = ("typescript", "tsx", "javascript", "c", "cpp", "csharp", "go", "rust", "java", "kotlin", "php", "swift")


class Symbol(NamedTuple):
    name: str
    kind: str
    start_line: int
    end_line: int
    start_col: int
    end_col: int
    parent: str | None
    doc: str | None
    exported: bool
    complexity: int | None
    source_code: str


class Relation(NamedTuple):
    source: str
    target: str
    kind: str
    line: int


class Import(NamedTuple):
    source: str
    names: list[str]
    wildcard: bool
    line: int


class Parsed(NamedTuple):
    symbols: list[Symbol]
    relations: list[Relation]
    imports: list[Import]


NOTHING = Parsed([], [], [])

# --- complexity

DECISIONS = re.compile(r"\bif\s*\(|\belse\s+if\b|\bwhile\s*\(|\bfor\s*\(|\bcase\s+|\bcatch\s*\(|\bswitch\s*\(|&&|\|\|")
TERNARY = re.compile(r"\?\s*[^:;]+\s*:")
CONDITIONAL = re.compile(r"#\s*(?:if|ifdef|ifndef|elif)\b")


def complexity(code: str, lang: str) -> int:
    """1 and one more for each decision; ``else if (`` counts as an else-if and as an if."""
    n = 1 + len(re.findall(r"\belse\s+if\b", code)) + sum(1 for m in DECISIONS.finditer(code) if not m[0].startswith("else"))
    n += sum(1 for m in re.findall(r"\belse\s+if\s*\(", code))  # the finder above steps over the if of an else-if
    n += sum(1 for m in TERNARY.findall(code) if '"' not in m and "'" not in m)
    return n + (len(CONDITIONAL.findall(code)) if lang in ("c", "cpp") else 0)


# --- masking

_COMMON = r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>\"(?:[^\"\\\n]|\\.)*\"?)"
_MASKS = {
    "c": re.compile(rf"{_COMMON}|(?P<q>'(?:[^'\\\n]|\\.)+')|(?P<r>R\"(?P<d>[^(\s]*)\(.*?\)(?P=d)\")", re.S),
    "go": re.compile(rf"{_COMMON}|(?P<q>'(?:[^'\\\n]|\\.)+')|(?P<r>`[^`]*`?)", re.S),
    "rust": re.compile(r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<r>\bb?r(?P<d>#*)\".*?\"(?P=d))|(?P<s>b?\"(?:[^\"\\]|\\.)*\"?)|(?P<q>b?'(?:[^'\\\n]|\\.[^'\n]*)')", re.S),
    "js": re.compile(rf"{_COMMON}|(?P<q>'(?:[^'\\\n]|\\.)*'?)|(?P<r>`(?:[^`\\]|\\.)*`?)|(?P<x>(?<=[=(,:;!&|?{{}}\[\n])[ \t]*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)", re.S),
    "java": re.compile(rf"(?P<r>\"\"\".*?\"\"\")|{_COMMON}|(?P<q>'(?:[^'\\\n]|\\.)+')", re.S),
}
_FAMILY = {"typescript": "js", "tsx": "js", "javascript": "js", "php": "js", "c": "c", "cpp": "c", "go": "go", "rust": "rust"}


def mask(text: str, lang: str) -> tuple[str, list[tuple[int, int]]]:
    """``text`` with comments and literals blanked, line ends kept, and the spans of the comments."""
    comments: list[tuple[int, int]] = []

    def blank(m: re.Match) -> str:
        if m.lastgroup == "c" or m["c"] is not None:
            comments.append(m.span())
            return re.sub(r"[^\n]", " ", m[0])
        inside = m[0]
        return inside[0] + re.sub(r"[^\n]", " ", inside[1:-1]) + inside[-1] if len(inside) > 1 else inside

    return _MASKS[_FAMILY.get(lang, "java")].sub(blank, text), comments


# --- declarations of the brace languages: (pattern, kind); group ``n`` is the name, ``p`` the parent, ``e`` what exports.

_W = r"[A-Za-z_$][\w$]*"
_GEN = r"(?:<[^<>{};()]*(?:<[^<>{};()]*>[^<>{};()]*)*>)?"
_JS = rf"(?P<e>export[ \t]+(?:default[ \t]+)?)?(?:declare[ \t]+)?"
_JAVA = r"(?:@[\w.]+(?:\([^()]*\))?\s*)*(?P<e>(?:(?:public|protected|private|internal|open|static|final|abstract|sealed|partial|override|virtual|async|synchronized|native|default|readonly|strictfp|data|inline|suspend|mutating|fileprivate|unsafe|extern)\s+)*)"
_C = r"(?P<e>(?:(?:static|extern|inline|const|constexpr|volatile|virtual|explicit|friend|unsigned|signed|__\w+|[A-Z][A-Z0-9_]*_API)\s+)*)"
DECLARED: dict[str, list[tuple[re.Pattern, str]]] = {
    "js": [
        (re.compile(rf"(?m)^[ \t]*{_JS}(?:async[ \t]+)?function\b[ \t]*\*?[ \t]*(?P<n>{_W})"), "function"),
        (re.compile(rf"(?m)^[ \t]*{_JS}(?:abstract[ \t]+)?class[ \t]+(?P<n>{_W})"), "class"),
        (re.compile(rf"(?m)^[ \t]*{_JS}interface[ \t]+(?P<n>{_W})"), "interface"),
        (re.compile(rf"(?m)^[ \t]*{_JS}(?:const[ \t]+)?enum[ \t]+(?P<n>{_W})"), "enum"),
        (re.compile(rf"(?m)^[ \t]*{_JS}type[ \t]+(?P<n>{_W})[ \t]*{_GEN}[ \t\r\n]*="), "type"),
        (re.compile(rf"(?m)^[ \t]*{_JS}(?:namespace|module)[ \t]+(?P<n>{_W})[ \t]*\{{"), "namespace"),
        (re.compile(rf"(?m)^{_JS}(?:const|let|var)[ \t]+(?P<n>{_W})"), "variable"),
        (re.compile(rf"(?m)^[ \t]*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)[ \t]+)*\*?[ \t]*(?P<n>#?{_W})\??[ \t]*{_GEN}\([^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*\)[ \t]*(?::[^{{}};=]+(?:\{{[^{{}}]*\}}[^{{}};=]*)?)?\{{"), "method"),
    ],
    "c": [
        (re.compile(r"(?m)^[ \t]*#[ \t]*define[ \t]+(?P<n>\w+)\([^)\n]*\)"), "function"),
        (re.compile(r"(?m)^[ \t]*#[ \t]*define[ \t]+(?P<n>\w+)(?![\w(])"), "constant"),
        (re.compile(rf"(?m)^[ \t]*(?:template[ \t]*{_GEN}\s*)?(?P<e>static[ \t]+)?(?:typedef[ \t]+)?(?:struct|class|union)[ \t]+(?:__attribute__\(\(.*?\)\)[ \t]*)?(?P<n>\w+)\b[^;{{}}()=]*\{{"), "class"),
        (re.compile(r"(?m)^[ \t]*(?:typedef[ \t]+)?enum(?:[ \t]+(?:class|struct))?[ \t]+(?P<n>\w+)\b[^;{}()=]*\{"), "enum"),
        (re.compile(r"(?m)^[ \t]*namespace[ \t]+(?P<n>[\w:]+)[ \t\r\n]*\{"), "namespace"),
        (re.compile(r"(?m)^[ \t]*typedef\b(?![^;{]*\{)[^;{}]*?\b(?P<n>\w+)(?:\[[^\]]*\])?[ \t]*;"), "type"),
        (re.compile(r"(?m)^[ \t]*using[ \t]+(?P<n>\w+)[ \t]*="), "type"),
        (re.compile(rf"(?m)^[ \t]*(?:template[ \t]*{_GEN}\s*)?{_C}(?!return\b|else\b|new\b|throw\b|delete\b|goto\b|case\b|typedef\b|using\b|public\b|private\b|protected\b|default\b)(?:struct[ \t]+|class[ \t]+|enum[ \t]+)?(?:[\w:]+{_GEN}[ \t\r\n*&]+)+(?:(?P<p>\w+){_GEN}::)?(?P<n>~?\w+|operator[^\s(]+)[ \t]*\((?P<args>[^;{{}}]*?)\)(?:\s*(?:const|noexcept|override|final|volatile|->[\w:<>*& ]+|__\w+(?:\([^)]*\))?|:[^;{{}}]*(?:\{{[^{{}}]*\}}[^;{{}}]*)*))*\s*[{{;]"), "function"),
        (re.compile(rf"(?m)^{_C}(?!return\b|typedef\b|using\b|goto\b|struct\s+\w+\s*;|class\s+\w+\s*;|enum\s+\w+\s*;|namespace\b)(?:struct[ \t]+|enum[ \t]+)?[\w:]+{_GEN}[ \t*&]+(?P<n>\w+)(?:\[[^\]]*\])*[ \t]*(?:=|;)"), "variable"),
    ],
    "go": [
        (re.compile(r"(?m)^func[ \t]*\([ \t]*(?:\w+[ \t]+)?\*?(?P<p>\w+)(?:\[[^\]]*\])?[ \t]*\)[ \t]*(?P<n>\w+)[ \t]*\("), "method"),
        (re.compile(r"(?m)^func[ \t]+(?P<n>\w+)[ \t]*[\[(]"), "function"),
        (re.compile(r"(?m)^[ \t]*(?:type[ \t]+)(?P<n>\w+)(?:\[[^\]]*\])?[ \t]+interface\b"), "interface"),
        (re.compile(r"(?m)^[ \t]*(?:type[ \t]+)(?P<n>\w+)(?:\[[^\]]*\])?[ \t]+struct\b"), "class"),
        (re.compile(r"(?m)^type[ \t]+(?P<n>\w+)(?:\[[^\]]*\])?[ \t]*=?[ \t]+(?!struct\b|interface\b)\S"), "type"),
        (re.compile(r"(?m)^const[ \t]+(?P<n>\w+)"), "constant"),
        (re.compile(r"(?m)^var[ \t]+(?P<n>\w+)"), "variable"),
    ],
    "rust": [
        (re.compile(r"(?m)^[ \t]*(?P<e>pub(?:\([^)]*\))?[ \t]+)?(?:struct|union)[ \t]+(?P<n>\w+)"), "class"),
        (re.compile(r"(?m)^[ \t]*(?P<e>pub(?:\([^)]*\))?[ \t]+)?enum[ \t]+(?P<n>\w+)"), "enum"),
        (re.compile(r"(?m)^[ \t]*(?P<e>pub(?:\([^)]*\))?[ \t]+)?(?:unsafe[ \t]+)?trait[ \t]+(?P<n>\w+)"), "interface"),
        (re.compile(r"(?m)^[ \t]*(?P<e>pub(?:\([^)]*\))?[ \t]+)?type[ \t]+(?P<n>\w+)"), "type"),
        (re.compile(r"(?m)^[ \t]*(?P<e>pub(?:\([^)]*\))?[ \t]+)?(?:const|static)[ \t]+(?:mut[ \t]+)?(?P<n>[A-Z_]\w*)[ \t]*:"), "constant"),
        (re.compile(r"(?m)^[ \t]*(?P<e>pub(?:\([^)]*\))?[ \t]+)?mod[ \t]+(?P<n>\w+)[ \t]*\{"), "namespace"),
        (re.compile(r"(?m)^[ \t]*(?P<e>pub(?:\([^)]*\))?[ \t]+)?(?:(?:default|async|const|unsafe|extern)[ \t]+(?:\"[^\"]*\"[ \t]+)?)*fn[ \t]+(?P<n>\w+)"), "function"),
        (re.compile(r"(?m)^[ \t]*macro_rules![ \t]*(?P<n>\w+)"), "function"),
    ],
    "java": [
        (re.compile(rf"(?m)^[ \t]*{_JAVA}(?:class|record|struct|object|actor|extension)\s+(?P<n>\w+)"), "class"),
        (re.compile(rf"(?m)^[ \t]*{_JAVA}(?:@?interface|protocol)\s+(?P<n>\w+)"), "interface"),
        (re.compile(rf"(?m)^[ \t]*{_JAVA}enum\s+(?:class\s+)?(?P<n>\w+)"), "enum"),
        (re.compile(rf"(?m)^[ \t]*{_JAVA}(?:namespace)\s+(?P<n>[\w.]+)"), "namespace"),
        (re.compile(rf"(?m)^[ \t]*{_JAVA}(?:fun|func)\s+{_GEN}\s*(?:[\w.]+\.)?(?P<n>\w+)\s*{_GEN}\("), "function"),
        (re.compile(rf"(?m)^[ \t]*{_JAVA}(?!return\b|else\b|new\b|throw\b|case\b|await\b|yield\b)(?:{_GEN}\s*[\w.]+{_GEN}(?:\[\])*[ \t]+)?(?P<n>\w+)[ \t]*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)[ \t\r\n]*(?:throws[ \t]+[\w., \t\r\n]+|where[^{{]*)?[{{;]"), "method"),
    ],
}
#: Words before a bracket that begin no call and name no function, in all languages and in one family.
RESERVED_ALL = frozenset("if for while switch catch return sizeof typeof instanceof await else do try throw delete case default new".split())
RESERVED = {
    "js": RESERVED_ALL | frozenset("function yield void in of with constructor elseif foreach".split()),
    "c": RESERVED_ALL | frozenset("using requires alignof alignas decltype static_assert defined __attribute__ __declspec noexcept void operator".split()),
    "go": RESERVED_ALL | frozenset("func defer go select range chan map interface struct type var const".split()),
    "rust": RESERVED_ALL | frozenset("fn match loop unsafe impl in let mut ref move where as pub crate dyn".split()),
    "java": RESERVED_ALL | frozenset("synchronized super this lock using fixed checked unchecked when guard func fun init where".split()),
}
CALL = re.compile(r"(?<![\w$.#@])((?:[A-Za-z_$][\w$]*(?:(?:\?\.|\.|::|->)~?[A-Za-z_$][\w$]*)*)!?)[ \t]*(?:<[\w, ]+>)?\(")
HERITAGE = re.compile(r"\b(extends|implements)\s+([\w$.,<>\s]+?)(?=\bextends\b|\bimplements\b|\{|$)")
ARGUMENT = re.compile(r"(?<![\w$.\"'])([A-Za-z_$][\w$]*)(?![\w$]*\s*(?:[(.=:]|->|::))")
LITERALS = frozenset("true false null undefined None True False self this nil NULL nullptr int char void const unsigned let var as mut ref".split())


class _Lines:
    """Line and column of a position."""

    def __init__(self, text: str) -> None:
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, pos: int) -> tuple[int, int]:
        i = bisect_right(self.starts, pos) - 1
        return i + 1, pos - self.starts[i]


class _Brackets(dict):
    """Closing position of every opening bracket; those that never close are absent. Knows which braces hold a position."""

    def __init__(self, masked: str) -> None:
        super().__init__()
        self.braces: list[int] = []
        self.outer: dict[int, int] = {}  # the brace around a brace
        open_: list[int] = []
        around: list[int] = []
        pairs = {"}": "{", ")": "(", "]": "["}
        for m in re.finditer(r"[{}()\[\]]", masked):
            if m[0] in "{([":
                open_.append(m.start())
                if m[0] == "{":
                    self.braces.append(m.start())
                    if around:
                        self.outer[m.start()] = around[-1]
                    around.append(m.start())
                continue
            while open_ and masked[open_[-1]] != pairs[m[0]] and m[0] == "}":
                open_.pop()  # an unclosed bracket within the block
            if open_ and masked[open_[-1]] == pairs[m[0]]:
                self[open_.pop()] = m.start()
                if m[0] == "}" and around:
                    around.pop()

    def holding(self, at: int) -> list[int]:
        """The braces whose blocks hold ``at``, the innermost first."""
        i = bisect_right(self.braces, at - 1) - 1
        brace: int | None = self.braces[i] if i >= 0 else None
        out = []
        while brace is not None:
            if self.get(brace, at) >= at:
                out.append(brace)
            brace = self.outer.get(brace)
        return out


def _end(masked: str, brackets: _Brackets, m: re.Match, kind: str, family: str) -> int | None:
    """Where the declaration that ``m`` begins ends; None if its block never closes."""
    if masked[m.start() : m.end()].lstrip().startswith("#"):
        at = m.end()
        while (at := masked.find("\n", at)) > 0 and masked[at - 1] == "\\":
            at += 1
        return len(masked) if at < 0 else at
    at = m.end() - 1 if m[0][-1:] in "{;" else m.end()
    if m[0].rstrip()[-1:] in "([" and at:
        at = m.end() - 1
    limit = len(masked)
    while at < limit:
        c = masked[at]
        if c in "{([":
            close = brackets.get(at)
            if close is None:
                return None
            if c == "{" and kind not in ("type", "variable", "constant") and not (family == "js" and re.search(r"[:|<,&]\s*$", masked[m.start() : at])):  # no object type
                end = close + 1
                if family == "c" and kind in ("class", "enum"):  # names of a typedef and the semicolon
                    semi = masked.find(";", end)
                    if semi >= 0 and re.fullmatch(r"[\w\s*,\[\]]*", masked[end:semi]):
                        end = semi + 1
                return end
            at = close + 1
            continue
        if c == ";":
            return at + 1
        if c == "\n" and kind in ("type", "variable", "constant") and family in ("js", "go") and not re.match(r"\s*[|&?.+=)\]}]", masked[at + 1 : at + 80]) and not re.search(r"[=|&,(\[{+?:]\s*$", masked[max(0, at - 80) : at]):
            return at
        if c == "}" and family in ("js", "java", "rust"):
            return at
        at += 1
    return limit if kind in ("type", "variable", "constant") else None


def _doc(text: str, masked: str, comments: list[tuple[int, int]], starts: list[int], at: int, lang: str) -> str | None:
    """The comment that ends right before ``at``: a block that starts with ``/**``, or lines in languages that document so."""
    i = bisect_right(starts, at) - 1
    if i < 0 or comments[i][1] > at or masked[comments[i][1] : at].strip():
        return None
    a, b = comments[i]
    first = text[a:b]
    if first.startswith("/**") and first != "/**/":
        return first
    if lang in ("go", "rust", "csharp", "swift") and first.startswith("//"):
        while i and not masked[comments[i - 1][1] : comments[i][0]].strip() and text[comments[i - 1][0] :].startswith("//") and text.count("\n", comments[i - 1][1], comments[i][0]) == 1:
            i -= 1
        lines = text[comments[i][0] : b]
        return lines if lang == "go" or lines.startswith("///") else None
    return None


def _exported(m: re.Match, kind: str, lang: str, family: str, depth: int) -> bool:
    said = (m.groupdict().get("e") or "").split()
    if family == "js":
        return "export" in said
    if family == "c":
        return "static" not in said and not m[0].lstrip().startswith("static") and not depth
    if family == "go":
        return m["n"][:1].isupper()
    if family == "rust":
        return bool(said)
    return "public" in said or "open" in said or (lang == "kotlin" and not {"private", "protected", "internal"} & set(said))


def parse_braces(text: str, lang: str) -> Parsed:
    family = _FAMILY.get(lang, "java")
    family = "js" if lang == "php" else family
    masked, comments = mask(text, lang)
    starts = [a for a, _ in comments]
    lines, brackets = _Lines(text), _Brackets(masked)
    rows: list[tuple[int, int, str, str, str | None, bool]] = []
    heads: set[int] = set()  # the brackets that open parameters
    taken: set[int] = set()
    hosts: dict[int, str] = {}  # the braces of classes and the like, which methods stand in
    if family == "rust":
        for m in re.finditer(r"(?m)^[ \t]*(?:unsafe[ \t]+)?impl\b[ \t]*(?:<[^{;]*?>)?[ \t]*(?:[^{;]*?\bfor[ \t]+)?(?:\w+::)*(\w+)[^{;]*\{", masked):
            hosts[m.end() - 1] = m[1]
    for pattern, declared in DECLARED[family]:
        for m in pattern.finditer(masked):
            kind = declared
            name, at = m["n"], m.start() + len(m[0]) - len(m[0].lstrip())
            if at in taken or name.lstrip("~#") in RESERVED[family] and not (kind == "method" and name == "constructor"):
                continue
            parent = m.groupdict().get("p")
            end = _end(masked, brackets, m, kind, family)
            if end is None:
                continue
            if kind in ("function", "method"):
                heads.add(masked.find("(", m.end("n")))
            around = brackets.holding(at)
            host = hosts.get(around[0]) if around else None
            if kind in ("class", "interface", "enum"):
                if (body := masked.find("{", at, end)) >= 0:
                    hosts[body] = name
            elif kind == "method" and not parent:
                if not host:  # not directly within a class
                    continue
                parent = host
            elif kind == "function" and family in ("c", "rust", "java"):
                if parent or host:
                    kind, parent = "method", parent or host
                elif family == "c" and any(not re.search(r"\bnamespace\b[^{};]*$|extern[ \t]*\"[^\"]*\"\s*$", masked[max(0, x - 200) : x]) for x in around):
                    continue  # a call or a local declaration within a body
            elif kind in ("variable", "constant", "type") and family == "c" and masked[at] != "#" and host:
                continue
            taken.add(at)
            rows.append((at, end, name, kind, parent, _exported(m, kind, lang, family, 0)))
    for m in re.finditer(r"\btypedef\s+(?:struct|union|enum)\b[^;{}()]*\{", masked) if family == "c" else ():
        if (close := brackets.get(m.end() - 1)) is not None and (n := re.compile(r"\s*(\w+)\s*;").match(masked, close + 1)) and m.start() not in taken:
            rows.append((m.start(), n.end(), n[1], "type", None, True))
    rows.sort(key=lambda r: (r[0], -r[1]))
    symbols = []
    for at, end, name, kind, parent, exported in rows:
        (l1, c1), (l2, c2) = lines.at(at), lines.at(end)
        code = text[at:end]
        line_start = lines.starts[l1 - 1]
        doc = _doc(text, masked, comments, starts, line_start if not masked[line_start:at].strip() else at, lang)
        if doc is None and (d := re.search(r"(?:^[ \t]*(?:@[\w.]+(?:\([^()]*\))?|#\[[^\]\n]*\])[ \t]*\r?\n)+\Z", masked[max(0, line_start - 2000) : line_start], re.M)):
            doc = _doc(text, masked, comments, starts, line_start - (d.end() - d.start()), lang)
        symbols.append(Symbol(name, kind, l1, l2, c1, c2, parent if kind == "method" else None, doc, exported, complexity(code, lang) if kind in ("function", "method") else None, code))
    return Parsed(symbols, _relations(masked, lines, brackets, heads, symbols, rows, family), _imports(text, masked, lines, family))


def _holders(symbols: list[Symbol]) -> dict[int, Symbol]:
    """For each line the first symbol whose lines hold it."""
    out: dict[int, Symbol] = {}
    for s in symbols:
        for line in range(s.start_line, s.end_line + 1):
            out.setdefault(line, s)
    return out


def _relations(masked: str, lines: _Lines, brackets: _Brackets, heads: set[int], symbols: list[Symbol], rows: list[tuple], family: str) -> list[Relation]:
    out: list[Relation] = []
    functions = {s.name for s in symbols if s.kind in ("function", "method")}
    names, holders = {s.name for s in symbols}, _holders(symbols)
    for m in CALL.finditer(masked):
        target = m[1]
        first = target.split(".")[0].split(":")[0].split("-")[0].split("?")[0]
        paren = m.end() - 1
        if first in RESERVED[family] or paren in heads or target in ("require", "import") or masked.endswith(("fn ", "func ", "fun ", "function "), 0, m.start()):
            continue
        line = lines.at(m.start())[0]
        holder = holders.get(line)
        if not holder or holder.kind == "interface":
            continue
        out.append(Relation(holder.name, target.replace("?.", "."), "calls", line))
        if (close := brackets.get(paren)) is not None:
            for a in ARGUMENT.finditer(_flat(masked, brackets, paren, close)):
                if a[1] != holder.name and a[1] not in LITERALS and a[1] not in RESERVED[family] and (a[1] in functions or a[1] in names or a[1][0].islower()):
                    out.append(Relation(holder.name, a[1], "calls", line))
    for at, end, name, kind, _, _ in rows:
        if kind not in ("class", "interface"):
            continue
        body = masked.find("{", at, end)
        head, line = masked[at : body if body >= 0 else end], lines.at(at)[0]
        hits = [(k, x) for k, names_ in HERITAGE.findall(head) for x in names_.split(",")]
        if not hits and (b := re.search(r":(?!:)\s*([^{]+)$", head)) and family in ("c", "java", "rust"):
            hits = [("extends", re.sub(r"\b(?:public|private|protected|virtual)\b", "", x)) for x in b[1].split(",")]
        for k, x in hits:
            if base := re.match(r"\s*([\w$.:]+)", x):
                out.append(Relation(name, base[1], k, line))
    if family == "rust":
        for m in re.finditer(r"(?m)^[ \t]*(?:unsafe[ \t]+)?impl\b[ \t]*(?:<[^{;]*?>)?[ \t]*([\w:]+)(?:<[^{;]*?>)?[ \t]+for[ \t]+(?:\w+::)*(\w+)", masked):
            out.append(Relation(m[2], m[1], "implements", lines.at(m.start())[0]))
    for m in re.finditer(r"(?m)^[ \t]*@(?!interface\b)([A-Za-z_][\w.]*)", masked) if family in ("js", "java") else ():
        after = next((s for s in symbols if s.start_line >= lines.at(m.start())[0]), None)
        if after and not re.search(r"[;{}]", re.sub(r"\([^()]*(?:\([^()]*\)[^()]*)*\)", "", masked[m.end() : lines.starts[after.start_line - 1] + after.start_col])):
            out.append(Relation(after.name, m[1], "decorates", lines.at(m.start())[0]))
    return out + _contains(symbols)


def _flat(masked: str, brackets: _Brackets, start: int, close: int) -> str:
    """The arguments of a call without those of the calls within it, and without blocks."""
    out, at = [], start + 1
    for m in re.finditer(r"[({]", masked[start + 1 : close]):
        pos = start + 1 + m.start()
        if pos < at:
            continue
        if m[0] == "(" and not re.search(r"[\w$]\s*$", masked[at:pos]):
            continue
        out.append(masked[at : pos + 1])
        at = brackets.get(pos, close)
    return "".join([*out, masked[at:close]])


def _contains(symbols: list[Symbol]) -> list[Relation]:
    methods: dict[str, list[str]] = {}
    for s in symbols:
        if s.kind == "method" and s.parent:
            methods.setdefault(s.parent, []).append(s.name)
    return [Relation(s.name, m, "contains", s.start_line) for s in symbols if s.kind == "class" for m in methods.get(s.name, ())]


_JS_IMPORT = re.compile(r"(?m)^[ \t]*import\s+(?:type\s+)?(?P<what>[\w$*{},\s]+?)\s*from\s*(?P<q>[\"'])(?P<s>[^\"'\n]+)(?P=q)|^[ \t]*import\s*(?P<q2>[\"'])(?P<bare>[^\"'\n]+)(?P=q2)|(?:const|let|var)\s+(?P<req>\{[^{}]*\}|[\w$]+)\s*=\s*require\(\s*(?P<q3>[\"'])(?P<rs>[^\"'\n]+)(?P=q3)\s*\)|export\s*(?P<ex>\*|\{[^{}]*\})\s*(?:as\s+\w+\s+)?from\s*(?P<q4>[\"'])(?P<es>[^\"'\n]+)(?P=q4)")


def _names(what: str) -> tuple[list[str], bool]:
    """The names of an import clause as they are called where they come from, and whether all are taken."""
    named = re.search(r"\{([^{}]*)\}", what)
    out = [re.split(r"\s+as\s+|\s*:\s*", re.sub(r"^type\s+", "", x.strip()))[0] for x in named[1].split(",") if x.strip()] if named else []
    out += [x for x in re.sub(r"\{[^{}]*\}|\*\s*as\s+[\w$]+", "", what).replace(",", " ").split() if re.fullmatch(_W, x) and x != "type"]
    return out, "*" in what


def _imports(text: str, masked: str, lines: _Lines, family: str) -> list[Import]:
    out: list[Import] = []
    if family == "js":
        for m in _JS_IMPORT.finditer(text):
            if not masked[m.start() : m.end()].strip():
                continue  # within a comment or a literal
            line = lines.at(m.start() + len(m[0]) - len(m[0].lstrip()))[0]
            names, all_ = _names(m["what"] or m["req"] or m["ex"] or "")
            out.append(Import(m["s"] or m["bare"] or m["rs"] or m["es"], names, all_, line))
    elif family == "c":
        out = [Import(m[1], ["*"], True, lines.at(m.start())[0]) for m in re.finditer(r"(?m)^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", text) if masked[m.start() : m.end()].strip()]
    elif family == "go":
        for m in re.finditer(r"(?m)^import\s+(?:\((?P<many>[^)]*)\)|(?P<one>[^\n]+))", text):
            start = m.start("many") if m["many"] is not None else m.start("one")
            for x in re.finditer(r"(?m)(?:([\w.]+)[ \t]+)?\"([^\"\n]+)\"", m["many"] or m["one"] or ""):
                out.append(Import(x[2], [x[1] or x[2].rsplit("/", 1)[-1]], x[1] == ".", lines.at(start + x.start())[0]))
    elif family == "rust":
        for m in re.finditer(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use[ \t]+([^;]+);", masked):
            base, _, rest = m[1].partition("{")
            path = re.sub(r"\s+", "", base).rstrip(":")
            names = [re.split(r"\s+as\s+", x.strip())[0].rsplit("::", 1)[-1] for x in re.sub(r"[{}]", "", rest).split(",") if x.strip()] if rest else [re.split(r"\s+as\s+", base.strip())[0].rsplit("::", 1)[-1].strip()]
            out.append(Import(path.split("as", 1)[0] if " as " in base else path, names, "*" in names, lines.at(m.start())[0]))
    else:
        for m in re.finditer(r"(?m)^[ \t]*(?:import|using)[ \t]+(?:static[ \t]+)?([\w.]+(?:\.\*)?)[ \t]*(?:;|$)", masked):
            last = m[1].rsplit(".", 1)[-1]
            out.append(Import(m[1].removesuffix(".*"), [last], last == "*", lines.at(m.start())[0]))
    return out


# --- Python


def parse_python(text: str) -> Parsed:
    """Symbols by Python's own grammar; nothing of text that doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return NOTHING
    raw = text.splitlines(keepends=True)
    symbols: list[Symbol] = []
    relations: list[Relation] = []
    imports: list[Import] = []

    def code(n: ast.AST) -> str:
        return "".join(raw[n.lineno - 1 : n.end_lineno]).rstrip("\r\n")  # type: ignore[attr-defined]

    def doc(n: ast.AST) -> str | None:
        said = ast.get_docstring(n)  # type: ignore[arg-type]
        if said:
            return said
        at = min([n.lineno, *(d.lineno for d in n.decorator_list)]) - 2  # type: ignore[attr-defined]
        above = []
        while at >= 0 and raw[at].lstrip().startswith("#"):
            above.append(raw[at].strip())
            at -= 1
        return "\n".join(reversed(above)) or None

    def name_of(e: ast.AST) -> str | None:
        if isinstance(e, ast.Name):
            return e.id
        if isinstance(e, ast.Attribute):
            base = name_of(e.value)
            return f"{base}.{e.attr}" if base else e.attr
        return name_of(e.func) if isinstance(e, ast.Call) else name_of(e.value) if isinstance(e, ast.Subscript) else None

    def visit(node: ast.AST, parent: str | None, top: bool) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                is_class = isinstance(n, ast.ClassDef)
                kind = "class" if is_class else "method" if parent else "function"
                src = code(n)
                symbols.append(Symbol(n.name, kind, n.lineno, n.end_lineno or n.lineno, n.col_offset, n.end_col_offset or 0, None if is_class else parent, doc(n), top and not n.name.startswith("_"), None if is_class else complexity(src, "python"), src))
                for d in n.decorator_list:
                    relations.append(Relation(n.name, name_of(d) or "unknown", "decorates", d.lineno))
                for b in n.bases if is_class else ():
                    if base := name_of(b):
                        relations.append(Relation(n.name, base, "extends", n.lineno))
                visit(n, n.name if is_class else None, False)
            elif isinstance(n, ast.Assign | ast.AnnAssign) and top:
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name):
                        symbols.append(Symbol(t.id, "constant" if t.id.isupper() else "variable", n.lineno, n.end_lineno or n.lineno, n.col_offset, n.end_col_offset or 0, None, None, not t.id.startswith("_"), None, code(n)))
            elif isinstance(n, ast.If | ast.Try | ast.With) and top:
                visit(n, parent, top)
            elif isinstance(n, ast.Import):
                imports.extend(Import(a.name, [a.name], False, n.lineno) for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                imports.append(Import("." * n.level + (n.module or ""), [a.name for a in n.names], any(a.name == "*" for a in n.names), n.lineno))
            else:
                visit(n, parent, False)

    visit(tree, None, True)
    symbols.sort(key=lambda s: (s.start_line, s.start_col))
    functions = {s.name for s in symbols if s.kind in ("function", "method")}
    names, holders = {s.name for s in symbols}, _holders(symbols)
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and (target := name_of(n.func)) and (holder := holders.get(n.lineno)):
            relations.append(Relation(holder.name, target, "calls", n.lineno))
            for a in [*n.args, *(k.value for k in n.keywords)]:
                if isinstance(a, ast.Name) and a.id != holder.name and (a.id in functions or a.id in names or a.id[0].islower()):
                    relations.append(Relation(holder.name, a.id, "calls", n.lineno))
    relations.sort(key=lambda r: r.line)
    return Parsed(symbols, relations + _contains(symbols), sorted(imports, key=lambda i: i.line))


def parse_text(text: str | None, lang: str | None) -> Parsed:
    """Symbols, relations and imports of a text. Null and empty texts and unknown languages give nothing.

    The file's first symbol imports what the file imports.
    """
    if not text or not text.strip():
        return NOTHING
    out = parse_python(text) if lang == "python" else parse_braces(text, lang) if lang in BRACES else NOTHING
    if out.symbols:
        first = out.symbols[0].name
        out.relations.extend(Relation(first, i.source, "imports", i.line) for i in out.imports)
    return out
