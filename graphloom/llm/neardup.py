"""Problem 6: near-duplicate records by a size-aware heavy-light set similarity join.

A record is the set of its shingles of consecutive tokens. Shingles have one global order: by the number of all
shingles in their hash bucket, so rare ones come first, then by hash. Two sets A, B with |A∩B| / |A∪B| >= t have

* one of the first  p1(A) = |A| - ceil(t|A|) + 1 shingles of each in common, and
* two of the first  p2(A) = |A| - ceil(t|A|) + 2 shingles of each in common (if A has as many that must be shared).

Light (small) sets enumerate the fixed-size subsets - the pairs - of their first p2 shingles and meet on equal pairs.
Heavy (large) sets would have too many, so they scan inverted lists: they meet all other sets on single shingles of the
first p1. Where light ends and heavy begins is set by the cost of either, computed from all sets. Sets that are equal
are one class (a 64-bit hash of the set) from the start, and the sets of all candidates are compared exactly.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.versions import latest
from graphloom.storage import cut

TOKEN = re.compile(r"[A-Za-z0-9_]+")


def _stable_hash():  # noqa: ANN202
    """Token hash that is the same in every process."""
    import xxhash

    return xxhash.xxh3_64_intdigest


def shingle_sets(rows: DataFrame, key: str, text: str, width: int = 3, least: int = 40) -> DataFrame:
    """(key, version columns, size, shingles): the sorted distinct shingle hashes of each text with ``least`` tokens or more.

    Null texts and texts with fewer tokens are left out. Further columns of ``rows`` are kept as they are.
    """
    rest = [c for c in rows.columns if c != text]
    schema = T.StructType([*[rows.schema[c] for c in rest], T.StructField("size", T.IntegerType()), T.StructField("shingles", T.ArrayType(T.LongType(), False))])

    def run(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        from graphloom.llm.neardup import TOKEN, _stable_hash

        digest = _stable_hash()
        known: dict[str, int] = {}
        mul, add = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)

        def number(t: str) -> int:
            n = known.get(t)
            if n is None:
                if len(known) > 1_000_000:
                    known.clear()
                n = known[t] = digest(t.encode())
            return n

        for batch in batches:
            picked, sets = [], []
            for i, s in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                tokens = TOKEN.findall(s) if s else ()
                if len(tokens) < max(least, width):
                    continue
                ids = np.fromiter(map(number, tokens), dtype=np.uint64, count=len(tokens))
                n = len(ids) - width + 1
                with np.errstate(over="ignore"):
                    h = np.zeros(n, dtype=np.uint64)
                    for k in range(width):
                        h = (h ^ (ids[k : k + n] + add * np.uint64(k + 1))) * mul
                        h ^= h >> np.uint64(29)
                picked.append(i)
                sets.append(np.unique(h.view(np.int64)))
            if not picked:
                continue
            offsets = np.zeros(len(sets) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in sets], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))
            at = pa.array(picked, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(j).take(at) for j in range(batch.num_columns - 1)], pa.array(np.diff(offsets), pa.int32()), lists], names=[*rest, "size", "shingles"])

    return rows.select(*rest, text).mapInArrow(run, schema)


def bucket_counts(sets: DataFrame, log2: int = 20):  # noqa: ANN201
    """How many shingles fall into each of 2^``log2`` hash buckets, over all sets: one array of fixed size.

    Each partition sends its counts in slices, which are summed slice by slice; only the sum reaches the driver.
    """
    import numpy as np

    n, slices = 1 << log2, 64
    step = n // slices

    def count(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        seen = np.zeros(n, dtype=np.int64)
        for batch in batches:
            seen += np.bincount(batch.column(0).flatten().to_numpy().view(np.uint64) >> np.uint64(64 - log2), minlength=n)
        for i in range(slices):
            part = seen[i * step : (i + 1) * step]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.minimum(part, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())], names=["slice", "counts"])

    def add(key, pdf):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        whole = sum(np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in pdf["counts"])
        return pd.DataFrame({"slice": [key[0]], "counts": [np.minimum(whole, 2**31 - 1).astype(np.int32).tobytes()]})

    out = np.zeros(n, dtype=np.int32)
    for r in sets.select("shingles").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInPandas(add, "slice int, counts binary").collect():
        out[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r["counts"], dtype=np.int32)
    return out


def boundary(sets: DataFrame, threshold: float) -> int:
    """The size up to which enumerating pairs costs less than scanning inverted lists.

    One set of size n emits C(p2, 2) pairs or p1 postings; a posting meets as many others as its list is long. The
    mean length of the lists is measured on the first shingle by hash of every set.
    """
    prefix = lambda n, k: n - math.ceil(threshold * n) + k
    row = sets.agg(F.approx_count_distinct(F.col("shingles")[0]).alias("lists"), F.approx_count_distinct("cid").alias("sets")).first()
    mean = max(1.0, row["sets"] / max(1, row["lists"]))
    best = 0
    for n in range(1, 4096):
        if math.comb(max(0, prefix(n, 2)), 2) <= prefix(n, 1) * (1 + 8 * (mean - 1)):  # a candidate costs about eight rows
            best = n
    return best


def _signatures(sets: DataFrame, threshold: float, counts, light: int) -> DataFrame:  # noqa: ANN001
    """(sig, single, heavy, cid, size): what each set meets others on; equal sets of a partition count once."""
    schema = T.StructType([T.StructField("sig", T.LongType()), T.StructField("single", T.BooleanType()), T.StructField("heavy", T.BooleanType()), T.StructField("cid", T.LongType()), T.StructField("size", T.IntegerType())])

    def run(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        common = counts.value
        shift = np.uint64(64 - int(len(common)).bit_length() + 1)
        mul = np.uint64(0x94D049BB133111EB)
        met: set[int] = set()
        for batch in batches:
            cids, lists = batch.column(0).to_numpy(), batch.column(1)
            flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            often = common[flat.view(np.uint64) >> shift]
            cols: list[list] = [[], [], [], [], []]
            for i, cid in enumerate(cids.tolist()):
                if cid in met:
                    continue
                if len(met) < 1_000_000:
                    met.add(cid)
                s, c = flat[offsets[i] : offsets[i + 1]], often[offsets[i] : offsets[i + 1]]
                n = len(s)
                s = s[np.lexsort((s, c))]
                must = math.ceil(threshold * n - 1e-9)
                p1, p2 = n - must + 1, min(n, n - must + 2)
                heavy = n > light or must < 2
                sig, single = s[:p1], np.ones(p1, dtype=bool)
                if not heavy:
                    first = s[:p2].view(np.uint64)
                    a, b = np.triu_indices(p2, 1)
                    with np.errstate(over="ignore"):
                        both = ((np.minimum(first[a], first[b]) * mul) ^ np.maximum(first[a], first[b])) * np.uint64(0xBF58476D1CE4E5B9)
                        both ^= both >> np.uint64(31)
                    sig, single = np.concatenate([sig, both.view(np.int64)]), np.concatenate([single, np.zeros(len(both), dtype=bool)])
                for c, v in zip(cols, (sig, single, np.full(len(sig), heavy), np.full(len(sig), cid), np.full(len(sig), n, dtype=np.int32)), strict=True):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=schema.names)

    return sets.select("cid", "shingles").mapInArrow(run, schema)


def similar_pairs(sets: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(cid_a, cid_b, similarity) between distinct sets with a Jaccard similarity of ``threshold`` or more.

    ``sets`` has cid, size and shingles, rows of one cid being equal. All links between different sets are found.
    """
    spark = sets.sparkSession
    light = boundary(sets, threshold)
    sigs = _signatures(sets, threshold, spark.sparkContext.broadcast(bucket_counts(sets)), light).repartition("sig").distinct()
    a, b = (sigs.select("sig", *[F.col(c).alias(f"{c}_{x}") for c in ("single", "heavy", "cid", "size")]) for x in "ab")
    found = (
        a.join(b, "sig")
        .where("cid_a < cid_b AND single_a = single_b AND (NOT single_a OR heavy_a OR heavy_b)")
        .where(F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - 1e-9)
        .select("cid_a", "cid_b")
        .distinct()
    )
    found = cut(found, "candidates")
    named = found.select(F.col("cid_a").alias("cid")).union(found.select("cid_b")).distinct()
    texts = cut(sets.join(named, "cid", "left_semi").groupBy("cid").agg(F.first("shingles").alias("s")), "compared")
    checked = found.join(texts.select(F.col("cid").alias("cid_a"), F.col("s").alias("s_a")), "cid_a").join(texts.select(F.col("cid").alias("cid_b"), F.col("s").alias("s_b")), "cid_b")
    checked = checked.withColumn("common", F.size(F.array_intersect("s_a", "s_b")))
    sim = F.col("common") / (F.size("s_a") + F.size("s_b") - F.col("common"))
    return checked.select("cid_a", "cid_b", sim.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def classes_and_links(symbols: DataFrame, threshold: float = 0.7, width: int = 3, least: int = 40) -> tuple[DataFrame, DataFrame]:
    """(id, cid), the set that each current function and method has, and (cid_a, cid_b, similarity) between sets alike.

    Sets are computed where the rows lie; of older versions the sets are dropped before anything is compared. Null
    and empty code and code with fewer than ``least`` tokens have no partners.
    """
    rows = symbols.where(F.col("id").isNotNull() & F.col("kind").isin("function", "method"))
    sets = shingle_sets(rows.select("id", F.xxhash64("source_code").alias("h"), "source_code"), "id", "source_code", width, least)
    sets = cut(sets.withColumn("cid", F.xxhash64("shingles")), "sets")
    current = latest(symbols, "id", "updated_at", "kind", F.xxhash64("source_code").alias("h")).where(F.col("kind").isin("function", "method"))
    members = cut(sets.select("id", "h", "cid").join(current.select("id", "h"), ["id", "h"], "left_semi").select("id", "cid").distinct(), "members")
    return members, cut(similar_pairs(sets.select("cid", "size", "shingles"), threshold), "pairs")


def duplicate_classes(symbols: DataFrame, threshold: float = 0.7, width: int = 3, least: int = 40) -> DataFrame:
    """(id, class_id, copies, links): one row for each function or method compared, without any list of pairs.

    ``class_id`` is the least id that links lead to, however far round, ``copies`` the number of others with an equal
    set and ``links`` the number of others that are alike, copies among them. A body with a hundred thousand copies is
    one set here.
    """
    from graphloom.operators.graph import components

    members, pairs = classes_and_links(symbols, threshold, width, least)
    size = members.groupBy("cid").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    other = size.select(F.col("cid").alias("other"), F.col("n").alias("m"))
    both = pairs.select(F.col("cid_a").alias("cid"), F.col("cid_b").alias("other")).unionByName(pairs.select(F.col("cid_b").alias("cid"), F.col("cid_a").alias("other")))
    linked = both.join(other, "other").groupBy("cid").agg(F.sum("m").alias("m"))
    comp = components(size.select(F.col("cid").alias("id")), pairs.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"))).withColumnRenamed("id", "cid")
    named = comp.join(size, "cid")
    least_id = named.groupBy("component").agg(F.min("first").alias("class_id"))
    rows = named.join(least_id, "component").join(linked, "cid", "left").select("cid", "class_id", (F.col("n") - 1).alias("copies"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("links"))
    return members.join(rows, "cid").select("id", "class_id", "copies", "links")


def near_duplicates(symbols: DataFrame, threshold: float = 0.7, width: int = 3, least: int = 40) -> DataFrame:
    """(id_a, id_b, similarity) of all pairs of current functions and methods that are alike, equal ones among them: the
    classes of ``duplicate_classes`` written out, which takes as much room as there are pairs."""
    members, pairs = classes_and_links(symbols, threshold, width, least)
    m = lambda x: members.select(F.col("id").alias(f"id_{x}"), F.col("cid").alias(f"cid_{x}"))
    other = pairs.join(m("a"), "cid_a").join(m("b"), "cid_b")
    same = m("a").withColumnRenamed("cid_a", "cid").join(m("b").withColumnRenamed("cid_b", "cid"), "cid").where("id_a < id_b").select("id_a", "id_b", F.lit(1.0).alias("similarity"))
    return other.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "similarity").unionByName(same)
