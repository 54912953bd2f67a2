"""Problem 8: texts into containers of fixed capacity, by bound-certified repacking.

Documents are spread by hash over partitions of about equal size, each packed by best-fit decreasing. Dual feasible
functions give each partition a lower bound for the containers it needs. Where the number of containers meets the
bound, the packing is proven best and left alone; the partitions with a gap put the documents of their unfilled
containers together, mix them anew and pack again, as long as that saves containers.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.storage import cut


def best_fit_decreasing(sizes, capacity: int):  # noqa: ANN001, ANN201
    """The bin of each item (in the given order); items must be between 1 and ``capacity``."""
    import numpy as np

    order = np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable")
    where = np.zeros(len(order), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have left
    mask, bins = 0, 0  # bit r: some bin has r left
    for i in order.tolist():
        s = int(sizes[i])
        fit = mask >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            r, b, bins = capacity, bins, bins + 1
        where[i] = b
        if r > s:
            room[r - s].append(b)
            mask |= 1 << (r - s)
    return where, bins


def lower_bound(counts: Iterable[int], capacity: int) -> int:
    """Containers that any packing needs: the best of two families of dual feasible functions.

    ``counts[s]`` is the number of items of size s. The first family rounds items over capacity - k up to a whole
    container, counts those over half as they are and drops those under k; the second rounds sizes down to multiples
    of 1/(k+1) of the capacity where that is allowed.
    """
    import numpy as np

    n = np.asarray(list(counts), dtype=np.int64)
    s = np.arange(len(n))
    best = math.ceil(int((n * s).sum()) / capacity)
    at_least = np.concatenate([np.cumsum(n[::-1])[::-1], [0]])
    weight = np.concatenate([np.cumsum((n * s)[::-1])[::-1], [0]])
    for k in range(1, capacity // 2 + 1):  # sizes k .. capacity-k count as they are, those above as whole containers
        whole = at_least[capacity - k + 1] if capacity - k + 1 < len(at_least) else 0
        rest = weight[k] - (weight[capacity - k + 1] if capacity - k + 1 < len(weight) else 0)
        best = max(best, int(whole) + math.ceil(int(rest) / capacity))
        half = capacity // 2 + 1
        big = at_least[half] if half < len(at_least) else 0  # of those over half no two share a container
        free = int(big - whole) * capacity - int(weight[half] - (weight[capacity - k + 1] if capacity - k + 1 < len(weight) else 0)) if half <= capacity - k else 0
        small = int(weight[k] - weight[min(half, len(weight) - 1)]) if k < half else 0
        best = max(best, int(big) + max(0, math.ceil((small - free) / capacity)))
    for k in range(1, 101):
        exact = (s * (k + 1)) % capacity == 0
        value = np.where(exact, s * k, (s * (k + 1) // capacity) * capacity)
        best = max(best, math.ceil(int((n * value).sum()) / (capacity * k)))
    return best


SCHEMA = "grp long, bin long, item_key {key}, start long, n long, room long, gap boolean"


def _pack(items: DataFrame, capacity: int, key_type: str) -> DataFrame:
    """Best-fit decreasing in each group of (grp, item_key, start, n)."""

    def run(pdf):  # noqa: ANN001, ANN202
        import numpy as np

        from graphloom.llm.packing import best_fit_decreasing, lower_bound

        pdf = pdf.sort_values(["n", "item_key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        sizes = pdf["n"].to_numpy()
        where, bins = best_fit_decreasing(sizes, capacity)
        room = capacity - np.bincount(where, weights=sizes, minlength=bins).astype(np.int64)
        gap = bins > lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        return pdf.assign(bin=where, room=room[where], gap=gap)[["grp", "bin", "item_key", "start", "n", "room", "gap"]]

    return items.groupBy("grp").applyInPandas(run, SCHEMA.format(key=key_type))


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = 2048, per_group: int = 20_000) -> DataFrame:
    """(container, key, token_start, token_end): every token of every item exactly once, at most ``capacity`` a container.

    Items above the capacity are divided into whole containers and a rest; no other item is divided. Items of size 0
    or null get no rows. ``key`` must be unique. Containers are numbered without meaning. ``per_group`` items are packed
    in one task; groups whose number of containers isn't proven least are mixed anew as long as that saves any, so what
    a single packing of all might still save is at most what remains above the bound that ``certificate`` gives.
    """
    key_type = sizes.schema[key].dataType.simpleString()
    base = sizes.where(F.col(size) > 0).select(F.col(key).alias("item_key"), F.col(size).cast("long").alias("n"))
    whole = base.where(F.col("n") >= capacity).select("item_key", F.explode(F.sequence(F.lit(0), F.expr(f"n div {capacity}") - 1)).alias("i"))
    full = whole.select(F.concat_ws(":", F.lit("w"), F.xxhash64("item_key").cast("string"), F.col("item_key").cast("string"), F.col("i").cast("string")).alias("container"), "item_key", (F.col("i") * capacity).alias("start"), F.lit(capacity).cast("long").alias("n"))
    rest = base.select("item_key", (F.expr(f"n div {capacity}") * capacity).alias("start"), F.expr(f"n % {capacity}").alias("n")).where("n > 0")
    done, todo = None, rest
    for r in count():
        n = todo.count()
        if not n:
            break
        groups = max(1, math.ceil(n / per_group))
        mixed = todo.withColumn("grp", F.pmod(F.xxhash64("item_key", F.lit(r)), F.lit(groups)))
        packed = cut(_pack(mixed.select("grp", "item_key", "start", "n"), capacity, key_type), "packed")
        named = packed.withColumn("container", F.concat_ws(":", F.lit(f"r{r}"), "grp", "bin")).drop("grp", "bin")
        if r and named.select("container").distinct().count() >= before:  # noqa: F821
            break
        if r:
            done = kept  # noqa: F821
        open_ = F.col("gap") & (F.col("room") > 0)
        settled = named.where(~open_).select("container", "item_key", "start", "n")
        kept = settled if done is None else done.unionByName(settled)
        loose = named.where(open_).select("container", "item_key", "start", "n")
        done = kept.unionByName(loose)
        before, todo = loose.select("container").distinct().count(), loose.drop("container")
        if groups == 1:
            break
    rows = full if done is None else full.unionByName(done)
    return rows.select("container", F.col("item_key").alias(key), F.col("start").cast("long").alias("token_start"), (F.col("start") + F.col("n")).cast("long").alias("token_end"))


def certificate(sizes: DataFrame, packed: DataFrame, size: str = "n_tokens", capacity: int = 2048) -> DataFrame:
    """One row (containers, lower_bound, tokens, fill): what the packing took and what any packing must take.

    Only the number of rests of each size, at most ``capacity`` numbers, reaches the driver.
    """
    spark = sizes.sparkSession
    rows = sizes.where(F.col(size) > 0).select(F.col(size).cast("long").alias("n"))
    whole = rows.agg(F.sum(F.expr(f"n div {capacity}"))).first()[0] or 0
    counts = [0] * (capacity + 1)
    for r in rows.groupBy(F.expr(f"n % {capacity}").alias("s")).count().where("s > 0").collect():
        counts[r["s"]] = r["count"]
    used = packed.agg(F.countDistinct("container").alias("c"), F.sum(F.col("token_end") - F.col("token_start")).alias("t")).first()
    c, t = used["c"], used["t"] or 0
    schema = T.StructType([T.StructField("containers", T.LongType()), T.StructField("lower_bound", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("fill", T.DoubleType())])
    return spark.createDataFrame([(c, int(whole) + lower_bound(counts, capacity), int(t), t / (c * capacity) if c else 1.0)], schema)
