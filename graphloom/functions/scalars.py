"""Column functions over paths, names and code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def ancestors(path: Column) -> Column:
    """All directories above a path, outermost first; none for a bare name."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def slug(text: Column) -> Column:
    """Lower case; slashes and dots become hyphens, other signs go, hyphens are merged and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"[/.]", "-"), r"[^a-z0-9_-]", ""), r"-+", "-"), F.lit("-"))


#: What counts as a branch.
BRANCHES = (r"\bif\s*\(", r"\belse\s+if\b", r"\bwhile\s*\(", r"\bfor\s*\(", r"\bcase\b", r"\bcatch\s*\(", r"\bswitch\s*\(", "&&", r"\|\|")


def cyclomatic(code: Column) -> Column:
    """1 and one more for every branch; an ``else if (`` counts as both."""
    return sum((F.regexp_count(code, F.lit(p)) for p in BRANCHES), F.lit(1)).cast("long")


def signature(code: Column, most: int = 120) -> Column:
    """The first line that is neither blank nor a comment or decorator, trimmed and cut."""
    lines = F.filter(F.split(code, "\n"), lambda x: (F.trim(x, F.lit(" \t\r")) != "") & ~x.rlike(r'^\s*(//|/?\*|#|@|""")'))
    return F.substring(F.trim(F.get(lines, F.lit(0)), F.lit(" \t\r")), 1, most)


def parameter_count(code: Column) -> Column:
    """Parts of the first parenthesis that aren't blank."""
    return F.size(F.filter(F.split(F.regexp_extract(code, r"\(([^)]+)\)", 1), ","), lambda x: F.trim(x, F.lit(" \t\n\r")) != ""))


def identifier_words(name: Column) -> Column:
    """The words of a camel-case or snake-case name, lower case, with blanks between."""
    split = F.split(F.regexp_replace(F.translate(name, "_", " "), r"([a-z0-9])([A-Z])", "$1 $2"), " ")
    return F.array_join(F.transform(F.filter(split, lambda w: w != ""), lambda w: F.lower(w)), " ")
