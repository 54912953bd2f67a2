"""Problem 2: the k most similar vectors of every vector, by multiprobe p-stable hashing.

Vectors are scaled to unit length, where the Euclidean distance orders as the cosine does. A table hashes a vector to
the cells of ``functions`` random projections of width ``width``; each vector lies in one bucket of each of ``tables``
tables and looks into ``probes`` of them, its own and those next to it in the order of estimated success: the
perturbation sets come from one precomputed sequence (expected squared distances to the cell borders), and are mapped
to each vector's own order of borders. The candidates of all tables are merged and ranked by exact cosine.

Equal vectors are one class, so copies cost nothing. In a bucket with more than ``bucket_cap`` classes every part of
those asking is compared with every part of the members, and only the best are kept as candidates. Vectors that found
too few candidates look again through fewer projections, and what is left then is compared with all vectors in the
same way, part by part.

Vectors are kept packed, and are moved twice: to their current row and to their class. Classes ask in groups, one after
another, and vectors are read where candidates are ranked, so what is on disk at once doesn't grow with the candidates
of all.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from graphloom.operators.versions import latest
from graphloom.session import ship
from graphloom.storage import cut, drop, release, scratch

PART = 8192  # classes of either side that are compared at once in a bucket over the cap
GROUP = 24_576  # classes that ask at once
PART_BITS = 33  # of a number that Spark counts rows with, those above are the partition's


def perturbations(functions: int, probes: int) -> list[tuple[int, ...]]:
    """The first ``probes`` sets of ranks (0 the nearest of all 2 * functions borders) in order of estimated success.

    Rank r and rank 2 * functions - 1 - r are the two borders of one projection, so a set never has both. The expected
    squared distance of the r-th nearest border is that of order statistics of uniform values. The first set is empty.
    """
    m = functions
    e = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(e[0], (0,))]
    while heap and len(out) < probes:
        score, ranks = heapq.heappop(heap)
        if all(2 * m - 1 - r not in ranks for r in ranks):
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - e[last] + e[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (score + e[last + 1], (*ranks, last + 1)))
    return out


def usable(df: DataFrame, key: str, vector: str, model: str | None, dim: int) -> DataFrame:
    """Rows with a key and ``dim`` finite components that aren't all zero, of ``model`` if given."""
    v = F.col(vector)
    ok = F.col(key).isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.where(ok & (F.col("model") == model) if model is not None else ok)


def units(rows: DataFrame, key: str, vector: str, order: str) -> DataFrame:
    """(key, order, h, packed): vectors packed by ``_pack`` and a hash that is equal for those of equal unit vectors."""
    schema = T.StructType([rows.schema[key], rows.schema[order], T.StructField("h", T.LongType()), T.StructField("packed", T.BinaryType())])

    def run(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            h = [xxhash.xxh3_64_intdigest(r.tobytes()) - (1 << 63) for r in np.round(_unit(x), 10) + 0.0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h, pa.int64()), pa.array(_pack(x), pa.binary())], names=schema.names)

    return rows.select(key, order, vector).mapInArrow(run, schema)


def _unit(x):  # noqa: ANN001, ANN202
    import numpy as np

    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pack(x) -> list[bytes]:  # noqa: ANN001
    """Each vector in the smallest form that loses nothing: 16-bit decimals and their number of digits, floats, doubles."""
    import numpy as np

    with np.errstate(over="ignore", invalid="ignore"):
        single = (x.astype(np.float32).astype(np.float64) == x).all(axis=1)
        digits, small = np.full(len(x), -1), np.zeros(x.shape, dtype=np.int16)
        for d in range(7):
            n = np.rint(x * 10.0**d)
            fit = (digits < 0) & (np.abs(n) < 32768).all(axis=1) & (n / 10.0**d == x).all(axis=1)
            digits[fit], small[fit] = d, n[fit]
    return [small[i].tobytes() + bytes([d]) if d >= 0 else (x[i].astype(np.float32) if one else x[i]).tobytes() for i, (d, one) in enumerate(zip(digits.tolist(), single.tolist()))]


def _matrix(column, dim: int):  # noqa: ANN001, ANN202
    """Unit vectors of packed ones, one a row."""
    import numpy as np
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if not n:
        return np.empty((0, dim))
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    size, x = np.diff(off), np.empty((n, dim))
    for of, kind in ((2 * dim + 1, np.int16), (4 * dim, np.float32), (8 * dim, np.float64)):
        some = np.flatnonzero(size == of)
        if len(some):
            b = data[off[0] : off[n]].reshape(n, of) if len(some) == n else data[off[some][:, None] + np.arange(of)]
            y = np.ascontiguousarray(b[:, : dim * np.dtype(kind).itemsize]).view(kind)
            x[some] = y / 10.0 ** b[:, -1:] if kind is np.int16 else y
    return _unit(x)


def _keys(classes: DataFrame, dim: int, tables: int, functions: int, width: float, probes: int, seed: int) -> DataFrame:
    """(key, v): the buckets that each vector lies in (probes = 1) or looks into."""
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("key", "v")])
    sets = perturbations(functions, probes)

    def run(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng(seed)
        plans = []
        for t in range(tables):
            a = rng.standard_normal((dim, functions)).astype(np.float32)
            b = rng.uniform(0, 1, functions).astype(np.float32)
            mul = rng.integers(1, 1 << 62, functions) | 1
            plans.append((a, b, mul, int(rng.integers(1 << 62))))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column(1), dim).astype(np.float32)
            v = batch.column(0).to_numpy()
            for a, b, mul, salt in plans:
                p = x @ a
                q = p / width + b
                cell = np.floor(q).astype(np.int64)
                with np.errstate(over="ignore"):
                    own = (cell * mul).sum(axis=1) + salt
                    if probes > 1:
                        part = q - cell
                        order = np.argsort(np.concatenate([part, 1 - part], axis=1), axis=1)
                        delta = np.concatenate([-mul, mul])
                        keys = np.empty((n, len(sets)), dtype=np.int64)
                        for i, ranks in enumerate(sets):
                            keys[:, i] = own
                            for r in ranks:
                                keys[:, i] += delta[order[:, r]]
                    else:
                        keys = own[:, None]
                k = keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(v, k))], names=schema.names)

    return classes.select("v", "packed").mapInArrow(run, schema)


def _candidates(classes: DataFrame, asking: DataFrame, data: DataFrame, hot: DataFrame | None, dim: int, tables: int, functions: int, width: float, probes: int, seed: int, best: int) -> DataFrame:
    """(q, xs): the classes that share a probed bucket with each asking one; of ``hot`` buckets the ``best`` at least."""
    asked = _keys(asking, dim, tables, functions, width, probes, seed).withColumnRenamed("v", "q")
    dense = None
    if hot is not None:
        dense = _dense(classes, data.join(hot.select("key"), "key", "left_semi"), cut(asked.join(hot.select("key"), "key", "left_semi"), "hotasked"), hot, best, dim)
        data, asked = data.join(hot, "key", "left_anti"), asked.join(hot, "key", "left_anti")
    met = asked.join(data, "key").where("q <> v").select("q", "v")
    met = met if dense is None else met.unionByName(dense)
    return met.groupBy("q").agg(F.collect_set("v").alias("xs"))


def _dense(classes: DataFrame, data: DataFrame, asked: DataFrame, hot: DataFrame, best: int, dim: int) -> DataFrame:
    """(q, v): in each hot bucket the ``best`` of every part of its members for each q asking there, ordered as in ``_rank``.

    Every part of those asking meets every part of the members, each of about ``PART`` classes, so all pairs of the bucket
    are compared; the best of a bucket are among the best of its parts.
    """
    askers = asked.groupBy("key").agg(F.count("*").alias("askers"))
    parts = hot.join(askers, "key").select("key", F.ceil(F.col("members") / PART).alias("dn"), F.ceil(F.col("askers") / PART).alias("qn"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = asked.join(parts, "key").select("key", F.pmod(F.xxhash64("q"), "qn").alias("qp"), every("dn").alias("dp"), "q").join(classes.select(F.col("v").alias("q"), F.col("packed").alias("asking")), "q")
    right = data.join(parts, "key").select("key", every("qn").alias("qp"), F.pmod(F.xxhash64("v"), "dn").alias("dp"), "v").join(classes, "v").select(F.col("key").alias("in_key"), F.col("qp").alias("in_qp"), F.col("dp").alias("in_dp"), "v", "first", "packed")

    def run(left, right):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        q, v = left.column("q").to_numpy(), right.column("v").to_numpy()
        x, y = _matrix(left.column("asking"), dim), _matrix(right.column("packed"), dim)
        first = np.unique(np.asarray(right.column("first").to_pylist(), dtype=object).astype(str), return_inverse=True)[1]
        out_q, out_v = [], []
        for at in range(0, len(q), 256):
            some = q[at : at + 256]
            s = np.round(x[at : at + 256] @ y.T, 9)
            s[some[:, None] == v] = -2  # itself
            least = np.partition(s, len(v) - best, axis=1)[:, len(v) - best] if len(v) > best else np.full(len(some), -2.0)
            for i in range(len(some)):
                c = np.flatnonzero((s[i] >= least[i]) & (s[i] > -2))
                c = c[np.lexsort((first[c], -s[i][c]))[:best]]
                out_q.append(np.full(len(c), some[i]))
                out_v.append(v[c])
        return pa.table({"q": pa.array(np.concatenate(out_q)), "v": pa.array(np.concatenate(out_v))})

    return left.groupBy("key", "qp", "dp").cogroup(right.groupBy("in_key", "in_qp", "in_dp")).applyInArrow(run, "q long, v long")


def _files(classes: DataFrame) -> dict[int, list[str]]:
    """The files of each part of the classes' table."""
    out: dict[int, list[str]] = {}
    for r in classes.select((F.shiftright("v", PART_BITS)).alias("part"), F.input_file_name().alias("file")).distinct().collect():
        out.setdefault(r["part"], []).append(r["file"])
    return out


def _load(files: list[str], columns: list[str]):  # noqa: ANN202
    """Columns of a part of the classes' table, in the order of v."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs
    from urllib.parse import unquote

    got = []
    for f in files:
        place, path = fs.FileSystem.from_uri(unquote(f))
        with place.open_input_file(path) as h:
            got.append(pq.ParquetFile(h).read(columns=["v", *columns]))
    return pa.concat_tables(got).sort_by("v") if len(got) > 1 else got[0]


def _rank(found: DataFrame, files: dict[int, list[str]], dim: int, k: int, at_once: int = 24_576, most: int = 2_000_000) -> DataFrame:
    """(q, x, similarity): the ``k`` best candidates of each q by exact cosine, ties by the least member id.

    Classes are numbered so that their numbers tell the file of the classes' table that has them. A task reads the files
    that its lists name, ``at_once`` vectors at a time, from the shared folder: vectors are neither shuffled nor copied
    to where they are compared. Lists are taken together up to ``most`` candidates.
    """
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("x", T.LongType()), T.StructField("similarity", T.DoubleType())])

    def fetch(ids):  # noqa: ANN001, ANN202
        """Vectors of sorted distinct ids."""
        import numpy as np
        import pyarrow as pa

        out, part = np.empty((len(ids), dim)), ids >> PART_BITS
        for p in np.unique(part).tolist():
            lo, hi = np.searchsorted(part, [p, p + 1])
            t = _load(files[p], ["packed"])
            at = np.searchsorted(t.column("v").to_numpy(), ids[lo:hi])
            out[lo:hi] = _matrix(t.column("packed") if len(at) == t.num_rows else t.column("packed").take(pa.array(at)), dim)
        return out

    def compare(q, x, off):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        order = np.argsort(q)
        asking = fetch(q[order])
        place = np.empty(len(q), dtype=np.int64)
        place[order] = np.arange(len(q))
        n = np.diff(off)
        qi = np.repeat(np.arange(len(q)), n)
        need = np.unique(x)
        s = np.empty(len(x))
        # By parts of the needed vectors, so many at a time.
        ends = np.append(np.flatnonzero(np.diff(need >> PART_BITS)) + 1, len(need))
        lo = 0
        while lo < len(need):
            fit = ends[(ends > lo) & (ends <= lo + at_once)]
            hi = int(fit[-1]) if len(fit) else int(ends[ends > lo][0])
            some, vectors = need[lo:hi], fetch(need[lo:hi])
            at = np.flatnonzero((x >= some[0]) & (x <= some[-1])) if hi - lo < len(need) else np.arange(len(x))
            row, of = np.searchsorted(some, x[at]), qi[at]
            cuts = np.append(np.flatnonzero(np.diff(of)) + 1, len(of)).tolist()
            begin = 0
            for end in cuts:
                s[at[begin:end]] = vectors[row[begin:end]] @ asking[place[of[begin]]]
                begin = end
            del vectors
            lo = hi
        s = np.round(s, 9)
        by = np.lexsort((-s, qi))
        x, s, qi = x[by], s[by], qi[by]  # lists keep their places
        least = s[off[:-1] + np.minimum(n, k) - 1]
        keep = s >= least[qi]
        x, s, qi = x[keep], s[keep], qi[keep]
        held = np.bincount(qi, minlength=len(q))
        tied = np.flatnonzero((held > k)[qi] & (s == least[qi]))
        if len(tied):
            ids = np.unique(x[tied])
            first, part = [], ids >> PART_BITS
            for p in np.unique(part).tolist():
                t = _load(files[p], ["first"])
                first += t.column("first").take(pa.array(np.searchsorted(t.column("v").to_numpy(), ids[part == p]))).to_pylist()
            rank = np.empty(len(ids), dtype=np.int64)
            rank[sorted(range(len(ids)), key=lambda i: str(first[i]))] = np.arange(len(ids))
            tie = np.zeros(len(x), dtype=np.int64)
            tie[tied] = rank[np.searchsorted(ids, x[tied])]
            by = np.lexsort((tie, -s, qi))
            x, s, qi = x[by], s[by], qi[by]
            nth = np.arange(len(x)) - np.repeat(np.cumsum(held) - held, held)
            x, s, qi = x[nth < k], s[nth < k], qi[nth < k]
        return pa.RecordBatch.from_arrays([pa.array(q[qi]), pa.array(x), pa.array(s)], names=schema.names)

    def run(batches):  # noqa: ANN001, ANN202
        import numpy as np

        def joined(kept):  # noqa: ANN001, ANN202
            n = np.concatenate([c.value_lengths().to_numpy() for _, c in kept])
            return np.concatenate([q for q, _ in kept]), np.concatenate([c.flatten().to_numpy() for _, c in kept]), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)

        kept, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append((batch.column(0).to_numpy(), batch.column(1)))
            count += len(batch.column(1).flatten())
            if count >= most:
                yield compare(*joined(kept))
                kept, count = [], 0
        if kept:
            yield compare(*joined(kept))

    return found.select("q", "xs").mapInArrow(run, schema)


def nearest(df: DataFrame, key: str = "symbol_id", vector: str = "embedding", k: int = 5, dim: int = 256, model: str | None = "local-hash", order: str = "created_at", tables: int = 15, functions: int | None = None, width: float = 2.2, probes: int = 10, bucket_cap: int = 8192, block: int = 2048, seed: int = 20, group: int = GROUP) -> DataFrame:
    """(key, neighbour, similarity, rank): the ``k`` most similar others of each key, approximately.

    Of a key the usable row with the greatest ``order`` counts; rows of other models, with null, wrong-sized,
    all-zero or non-finite vectors are left out. Similarity is the cosine rounded to 9 decimals; ties go to the smaller
    key. ``functions`` grows with the logarithm of the collection (16 at 40,000 vectors) so that buckets keep their
    size. A key has fewer than ``k`` neighbours only if there are no more.

    About ``group`` classes ask at once, at most 32 groups after another; what a group wrote and shuffled is
    released before the next.
    """
    spark = df.sparkSession
    ship(spark)
    every = cut(latest(units(usable(df, key, vector, model, dim), key, vector, order), key, order, F.col("h"), F.col("packed")), "units")
    release(spark)
    least = every.groupBy("h").agg(F.min(F.col(key)).alias("first"))
    parts = max(1, math.ceil(every.count() / block))
    # Classes are numbered by their place in their file.
    classes = cut(every.repartition(parts, "h").join(least, "h").where(F.col(key) == F.col("first")).select(F.monotonically_increasing_id().alias("v"), "h", "first", "packed"), "classes")
    members = cut(every.select(key, "h").join(classes.select("h", "v"), "h").select(key, "v"), "members")
    drop(spark, every._scratch)
    release(spark)
    w = W.partitionBy("v").orderBy(key)
    n = classes.count()
    files = _files(classes)
    if functions is None:
        functions = min(48, max(6, round(16 + 1.5 * math.log2(max(n, 1) / 40_000))))
    tell = spark.read.schema(classes.schema)
    ranked, lacking = scratch(spark, "ranked"), ""
    add = lambda found: _rank(found, files, dim, 3 * k).write.mode("append").parquet(ranked)
    count = n
    for level in range(3):
        m = max(2, functions >> level)
        data = cut(_keys(classes, dim, tables, m, width, 1, seed + level), "buckets")
        hot = data.groupBy("key").count().where(F.col("count") > bucket_cap).select("key", F.col("count").alias("members"))
        hot = None if hot.isEmpty() else cut(hot, "hotbuckets")
        groups = min(32, max(1, math.ceil(count / group)))
        was, lacking = lacking, scratch(spark, "lacking")
        for g in range(groups):
            if level == 0:
                mine = [f for p, some in sorted(files.items()) if p % groups == g for f in some]
                if not mine:
                    continue
                asking = tell.parquet(*mine)
            else:
                asking = tell.parquet(was).where(F.pmod(F.xxhash64("v"), F.lit(groups)) == g)
            got = cut(_candidates(classes, asking.select("v", "packed"), data, hot, dim, tables, m, width, probes if m >= 4 else 1, seed + level, 4 * k), "candidates")
            enough = got.where(F.size("xs") >= min(4 * k, max(0, n - 1)))
            asking.join(enough.select(F.col("q").alias("v")), "v", "left_anti").write.mode("append").parquet(lacking)
            add(enough)
            drop(spark, got._scratch)
            del got, enough, asking
            release(spark)
        drop(spark, data._scratch)
        left = tell.parquet(lacking) if n else classes
        count = left.count()
        if not count:
            break
    else:
        # Those that still lack candidates against all vectors, part by part; of each part only the best are kept.
        one = F.lit(0).cast("long").alias("key")
        whole = spark.createDataFrame([(0, n)], "key long, members long")
        add(_dense(classes, classes.select(one, "v"), left.select(one, F.col("v").alias("q")), whole, 4 * k, dim).groupBy("q").agg(F.collect_set("v").alias("xs")))
        release(spark)
    if not n:
        return members.select(key, F.col(key).alias("neighbour"), F.lit(0.0).alias("similarity"), F.lit(1).alias("rank"))
    # What one vector ranks high is a candidate of the other one too, at no further comparison. As every class has a
    # member, only classes of the first k + 1 similarities can give a neighbour.
    best = spark.read.schema("q long, x long, similarity double").parquet(ranked)
    best = best.unionByName(best.select(F.col("x").alias("q"), F.col("q").alias("x"), "similarity")).repartition("q").distinct()
    best = cut(best.withColumn("r", F.rank().over(W.partitionBy("q").orderBy(F.desc("similarity")))).where(F.col("r") <= k + 1).drop("r"), "best")
    drop(spark, ranked)
    drop(spark, classes._scratch)
    release(spark)
    # From classes to members: the first ids of the class itself, then those of its neighbours.
    some = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    some = some.groupBy("v").agg(F.array_sort(F.collect_list(F.col(key))).alias("ids"))
    other = best.join(some.select(F.col("v").alias("x"), "ids"), "x").select("q", F.explode("ids").alias("id"), "similarity")
    own = some.where(F.size("ids") > 1).select(F.col("v").alias("q"), F.explode("ids").alias("id"), F.lit(1.0).alias("similarity"))
    near = other.unionByName(own).withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("similarity"), "id"))).where(F.col("r") <= k + 1)
    lists = cut(near.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "id", "similarity"))).alias("l")), "nearest", instead_of=best)
    release(spark)
    out = members.select(key, F.col("v").alias("q")).join(lists, "q")
    mine = F.slice(F.filter("l", lambda x: x["id"] != F.col(key)), 1, k)
    return out.select(key, F.posexplode(mine).alias("rank", "n")).select(key, F.col("n.id").alias("neighbour"), F.col("n.similarity").alias("similarity"), (F.col("rank") + 1).alias("rank"))


def neighbour_pairs(df: DataFrame, key: str = "symbol_id", **how) -> DataFrame:  # noqa: ANN003
    """(id_a, id_b): pairs of which at least one is among the nearest of the other; id_a < id_b."""
    n = nearest(df, key, **how)
    return n.select(F.least(key, "neighbour").alias("id_a"), F.greatest(key, "neighbour").alias("id_b")).distinct()
