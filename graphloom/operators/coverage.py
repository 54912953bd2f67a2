"""Which symbols tests refer to: by the test file's name, by a test's own name, by its code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.relations import substring_sets
from graphloom.storage import cut

#: What makes a path a test's.
TEST_PATH = r"(?i:test[_-])|(?i:[_-]test)|\.test\.|\.spec\.|__tests__/|test__"
#: The same with whole directories of tests.
TEST_FILES = TEST_PATH + r"|(^|/)tests?/"
WORD = r"[A-Za-z0-9_$]+"
OTHER = r"[^A-Za-z0-9_$]+"


def _named(path: Column) -> Column:
    """What stands before ``.test.``, ``.spec.`` or ``_test.``, from wherever it may begin, or between ``test_`` and a dot."""
    none = F.array().cast("array<string>")
    upto = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    at = lambda m: F.filter(upto(F.lit(1), F.length(path)), lambda i: F.substr(path, i, F.lit(len(m))) == m)
    before = [F.flatten(F.transform(at(m), lambda i: F.transform(upto(F.lit(1), i - 1), lambda j: F.substr(path, j, i - j)))) for m in (".test.", ".spec.", "_test.")]
    after = F.flatten(F.transform(at("test_"), lambda i: F.transform(F.filter(at("."), lambda d: d > i + 5), lambda d: F.substr(path, i + 5, d - i - 5))))
    return F.array_distinct(F.concat(none, *before, after))


def test_counts(symbols: DataFrame, is_test: str = TEST_FILES) -> DataFrame:
    """(id, tests, files): exported symbols outside of tests that tests refer to, with the numbers of tests that do by
    their name or code, and of files with such tests or with a name that says so.

    ``symbols`` has id, name, file_path, exported and source_code. Names meet paths by equality on what could be a name
    in them; they meet test names and the distinct words of tests as substrings, through n-grams. A name of other signs
    than words meets code where its longest word, or else run of other signs, does, and is then looked for in the code
    itself. Codes are only read for their words and never repeated. Null and empty names match nothing.
    """
    test = F.col("file_path").rlike(is_test)
    targets = symbols.where(~test & F.coalesce("exported", F.lit(False)) & (F.length("name") > 0)).select("id", "name")
    names = cut(targets.select("name").distinct().withColumn("n", F.monotonically_increasing_id()), "names")
    tests = symbols.where(test)
    odd = names.where(~F.col("name").rlike(f"^{WORD}$"))
    odd = None if odd.isEmpty() else odd
    said = lambda kind, text: tests.select(F.lit(kind).alias("kind"), text.alias("text"), "file_path", "id")
    runs = lambda pattern, of="source_code": F.array_distinct(F.regexp_extract_all(F.coalesce(of, F.lit("")), F.lit(pattern), F.lit(0)))
    need = lambda of, kind, needle: of.select(F.lit(kind).alias("kind"), needle.alias("needle"), "n")
    spoken = said("name", F.lower("name")).where(F.length("text") > 0).unionByName(said("code", F.explode(runs(WORD))))
    needles = need(names, "name", F.lower("name")).unionByName(need(names.where(F.col("name").rlike(f"^{WORD}$")), "code", F.col("name")))
    if odd is not None:
        longest = lambda a: F.element_at(F.array_sort(a, lambda x, y: F.length(x) - F.length(y)), -1)
        spoken = spoken.unionByName(said("part", F.explode(F.concat(runs(WORD), runs(OTHER)))))
        part = F.when(F.size(runs(WORD, "name")) > 0, longest(runs(WORD, "name"))).otherwise(F.col("name"))
        needles = needles.unionByName(need(odd, "part", part))
    spoken = cut(spoken, "spoken")
    # Each cut also keeps a plan small: the driver holds every plan, and makes it anew with each of its stages.
    sets = cut(substring_sets(cut(spoken.select("kind", "text").distinct(), "texts"), needles), "sets")
    hit = spoken.join(sets, ["kind", "text"])
    if odd is not None:
        hit = cut(hit.select("kind", "file_path", "id", "ns"), "hits")
        maybe = hit.where("kind = 'part'").select("id", F.explode("ns").alias("n")).distinct().hint("merge").join(odd, "n")
        codes = tests.select("id", "file_path", "source_code")
        sure = maybe.join(codes, "id").where(F.col("source_code").contains(F.col("name"))).select("file_path", "id", F.array("n").alias("ns"))
        found = hit.where("kind <> 'part'").select("file_path", "id", "ns").unionByName(sure)
    else:
        found = hit.select("file_path", "id", "ns")
    files = tests.select("file_path").distinct().select("file_path", F.explode(_named(F.col("file_path"))).alias("name")).hint("merge").join(names, "name")
    found = found.unionByName(files.select("file_path", F.lit(None).cast("string").alias("id"), F.array("n").alias("ns")))
    # A test's file is in one task from here on, so pairs of names and tests are never shuffled.
    pairs = found.repartition("file_path").select("file_path", "id", F.explode("ns").alias("n")).distinct()
    each = pairs.groupBy("file_path", "n").agg(F.count("id").alias("tests"))
    counted = each.groupBy("n").agg(F.sum("tests").alias("tests"), F.count("*").alias("files"))
    return targets.join(cut(counted.join(names, "n").select("name", "tests", "files"), "counted"), "name").select("id", "tests", "files")


test_counts.__test__ = False
