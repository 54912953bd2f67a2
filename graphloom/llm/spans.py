"""Problem 9: long exact spans shared between documents, by a log-structured index of fingerprints.

Every window of ``min_chars`` characters is named by the least of the hashes of the ``anchor`` characters' runs inside
it, so equal windows have equal anchors, whatever stands around them. Neighbouring windows with one anchor form a
cell. A batch of documents becomes an immutable run of cells, sorted by anchor; the index proper is a set of immutable
sorted runs of (anchor, least document, greatest document), merge-joined with every new batch and compacted two by two
as they grow. Only anchors that two documents have are looked at again: cells whose whole text (128-bit hash) stands in
two documents are shared entirely; of the other cells the windows themselves are compared, again by 128 bits, so each
shared character is found and no other. Nothing is compared pair by pair, so a passage that a third of all documents
share costs no more than any other text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from graphloom.storage import cut, drop, scratch

SEGMENT = 1 << 18  # windows handled at a time; a longer text is handled in parts
_POWERS: dict[int, tuple] = {}


def _powers(base: int):  # noqa: ANN202
    """Powers of an odd number and of its inverse modulo 2^64."""
    import numpy as np

    if base not in _POWERS:
        n = SEGMENT + (1 << 16)
        up, down = np.full(n, base, dtype=np.uint64), np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS[base] = np.cumprod(up), np.cumprod(down)
    return _POWERS[base]


BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mix(x, salt: int):  # noqa: ANN001, ANN202
    import numpy as np

    x = (x + np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any run of characters of a text, after one pass."""

    def __init__(self, points, which: int) -> None:  # noqa: ANN001
        import numpy as np

        self.up, self.down = _powers(BASES[which])
        self.sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(_mix(points.astype(np.uint64), BASES[1 - which]) * self.up[: len(points)], out=self.sums[1:])

    def windows(self, size: int):  # noqa: ANN202
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:-size]) * self.down[:n], 1)

    def runs(self, start, end):  # noqa: ANN001, ANN202
        return _mix((self.sums[end] - self.sums[start]) * self.down[start], 2) ^ (end - start).astype(self.sums.dtype)


def least_at(h, m: int):  # noqa: ANN001, ANN202
    """Position of the first least value in every window of ``m`` values, by doubling."""
    import numpy as np

    at, size, n = np.arange(len(h)), 1, len(h) - m + 1
    while 2 * size <= m:
        a, b = at[:-size], at[size:]
        at, size = np.where(h[b] < h[a], b, a), 2 * size
    a, b = at[:n], at[m - size : m - size + n]
    return np.where(h[b] < h[a], b, a)


def segments(text: str, min_chars: int):  # noqa: ANN201
    """(offset, code points) of the overlapping parts of a text whose windows make up all its windows."""
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, max(0, len(points) - min_chars + 1), SEGMENT):
        yield at, points[at : at + SEGMENT + min_chars - 1]


def cells(docs: DataFrame, key: str, text: str, min_chars: int = 300, anchor: int = 150) -> DataFrame:
    """(a, c1, c2, doc, start, n): anchor, hashes of the cell's text, first window and number of windows."""
    schema = T.StructType([*[T.StructField(x, T.LongType()) for x in ("a", "c1", "c2")], T.StructField("doc", docs.schema[key].dataType), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())])

    def run(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        from graphloom.llm.spans import Rolling, least_at, segments

        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            rows, counts = [], []
            with np.errstate(over="ignore"):
                for i, s in enumerate(batch.column(1).to_pylist()):
                    if not s or len(s) < min_chars:
                        continue
                    for offset, points in segments(s, min_chars):
                        one, two = Rolling(points, 0), Rolling(points, 1)
                        h = one.windows(anchor)
                        at = least_at(h, min_chars - anchor + 1)
                        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                        n = np.diff(np.concatenate([first, [len(at)]]))
                        end = first + n - 1 + min_chars
                        for c, v in zip(cols, (h[at[first]].view(np.int64), one.runs(first, end).view(np.int64), two.runs(first, end).view(np.int64), (first + offset).astype(np.int32), n.astype(np.int32)), strict=True):
                            c.append(v)
                        rows.append(i)
                        counts.append(len(first))
            if rows:
                flat = [pa.array(np.concatenate(c)) for c in cols]
                doc = batch.column(0).take(pa.array(np.repeat(rows, counts)))
                yield pa.RecordBatch.from_arrays([*flat[:3], doc, *flat[3:]], names=schema.names)

    return docs.where(F.col(key).isNotNull() & (F.length(text) >= min_chars)).select(key, text).mapInArrow(run, schema)


def _windows(parts: DataFrame, doc_type: T.DataType, min_chars: int) -> DataFrame:
    """(w1, w2, lo, hi, open, doc, pos): the hashes of the windows of the cells in ``parts`` (text, wanted)."""
    schema = T.StructType([T.StructField("w1", T.LongType()), T.StructField("w2", T.LongType()), T.StructField("lo", doc_type), T.StructField("hi", doc_type), T.StructField("open", T.BooleanType()), T.StructField("doc", doc_type), T.StructField("pos", T.IntegerType())])

    def run(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        from graphloom.llm.spans import Rolling, segments

        for batch in batches:
            docs = batch.column(0)
            for i, (s, wanted) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                w = wanted.values
                start, n = w.field("start").to_numpy(), w.field("n").to_numpy()
                with np.errstate(over="ignore"):
                    for offset, points in segments(s, min_chars):
                        count = len(points) - min_chars + 1
                        a = np.clip(start - offset, 0, count)
                        b = np.clip(start - offset + n, 0, count)
                        size = b - a
                        if not size.any():
                            continue
                        rows = np.repeat(np.arange(len(start)), size)
                        pos = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
                        one, two = Rolling(points, 0), Rolling(points, 1)
                        h1, h2 = one.runs(pos, pos + min_chars), two.runs(pos, pos + min_chars)
                        take = pa.array(rows)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), w.field("lo").take(take), w.field("hi").take(take), w.field("open").take(take), docs.take(pa.array(np.full(len(rows), i))), pa.array((pos + offset).astype(np.int32))], names=schema.names
                        )

    return parts.mapInArrow(run, schema)


class SpanIndex:
    """Immutable sorted runs under the shared folder; ``add`` a batch, then ask for the shared spans."""

    def __init__(self, spark: SparkSession, doc_type: T.DataType, min_chars: int = 300, anchor: int = 150) -> None:
        if not 1 <= anchor <= min_chars:
            raise ValueError("anchor must be within min_chars")
        self.spark, self.doc_type, self.min_chars, self.anchor = spark, doc_type, min_chars, anchor
        self.cells = T.StructType([*[T.StructField(x, T.LongType()) for x in ("a", "c1", "c2")], T.StructField("doc", doc_type), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())])
        self.entries = T.StructType([T.StructField("a", T.LongType()), T.StructField("lo", doc_type), T.StructField("hi", doc_type)])
        self.runs: list[str] = []  # of cells
        self.levels: list[tuple[int, str]] = []  # of (anchor, lo, hi): level and path
        self.hot: list[str] = []  # anchors that became shared with a batch

    def _write(self, df: DataFrame, name: str) -> str:
        path = scratch(self.spark, name)
        df.write.parquet(path)
        return path

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Makes a run of the batch, merge-joins its anchors with the historical runs, and compacts."""
        run = self._write(cells(docs, key, text, self.min_chars, self.anchor).sortWithinPartitions("a"), "run")
        self.runs.append(run)
        new = self.spark.read.schema(self.cells).parquet(run).groupBy("a").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
        level, path = 0, self._write(new.sortWithinPartitions("a"), "anchors")
        entries = self.spark.read.schema(self.entries).parquet(path)
        self.hot.append(self._write(entries.where("lo <> hi").select("a"), "hot"))
        for _, old in self.levels:
            both = entries.hint("merge").join(self.spark.read.schema(self.entries).parquet(old).select("a", F.col("lo").alias("l"), F.col("hi").alias("h")), "a")
            self.hot.append(self._write(both.where("lo <> l OR hi <> h").select("a"), "hot"))
        while self.levels and self.levels[-1][0] == level:
            _, old = self.levels.pop()
            merged = self.spark.read.schema(self.entries).parquet(path, old).groupBy("a").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            level, before = level + 1, path
            path = self._write(merged.sortWithinPartitions("a"), "anchors")
            drop(self.spark, old)
            drop(self.spark, before)
        self.levels.append((level, path))

    def spans(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, span_start, span_end) of the longest runs of characters of ``docs`` that another document has too.

        ``docs`` must hold all documents that were added: the texts themselves aren't kept in the index.
        """
        k = self.min_chars
        hot = self.spark.read.schema("a long").parquet(*self.hot).distinct()
        found = cut(self.spark.read.schema(self.cells).parquet(*self.runs).join(hot, "a", "left_semi"), "hotcells")
        named = found.groupBy("a", "c1", "c2", "n").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(F.struct("doc", "start")).alias("one"))
        named = cut(named.withColumn("open", F.col("lo") == F.col("hi")), "classes")
        whole = found.join(named.where("NOT open").select("a", "c1", "c2", "n"), ["a", "c1", "c2", "n"], "left_semi")
        whole = whole.select("doc", F.col("start").alias("from"), (F.col("start") + F.col("n") - 1 + k).alias("to"))
        # What isn't shared whole: all its places, and one place of each class that may share a window with it.
        unsure = named.where("open").select("a", "c1", "c2", "n")
        own = found.join(unsure, ["a", "c1", "c2", "n"], "left_semi").select("doc", F.struct("start", "n", F.col("doc").alias("lo"), F.col("doc").alias("hi"), F.lit(True).alias("open")).alias("cell"))
        witness = named.where("NOT open").join(unsure.select("a").distinct(), "a", "left_semi").select(F.col("one.doc").alias("doc"), F.struct("one.start", "n", "lo", "hi", F.lit(False).alias("open")).alias("cell"))
        wanted = own.unionByName(witness).groupBy("doc").agg(F.collect_list("cell").alias("wanted"))
        texts = docs.where(F.col(key).isNotNull() & (F.length(text) >= k)).select(F.col(key).alias("doc"), F.col(text).alias("text"))
        windows = cut(_windows(wanted.join(texts, "doc").select("doc", "text", "wanted"), self.doc_type, k), "windows")
        shared = windows.groupBy("w1", "w2").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("w1", "w2")
        single = windows.where("open").join(shared, ["w1", "w2"], "left_semi").select("doc", F.col("pos").alias("from"), (F.col("pos") + k).alias("to"))
        pieces = whole.unionByName(single)
        w = W.partitionBy("doc").orderBy("from", "to")
        before = F.max("to").over(w.rowsBetween(W.unboundedPreceding, -1))
        pieces = pieces.withColumn("new", F.when(F.col("from") > before, 1).otherwise(0)).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
        return pieces.groupBy("doc", "island").agg(F.min("from").alias("span_start"), F.max("to").alias("span_end")).select(F.col("doc").alias(key), "span_start", "span_end")


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 300, batches: int = 2) -> DataFrame:
    """All shared spans of ``docs``, added to a fresh index in ``batches``.

    ``key`` must be unique. Null keys, null texts and texts under ``min_chars`` characters share nothing; a passage
    that recurs only within one document isn't shared. Positions count characters (code points) from 0.
    """
    index = SpanIndex(docs.sparkSession, docs.schema[key].dataType, min_chars, min(min_chars, max(1, min_chars // 2)))
    for b in range(batches):
        index.add(docs.where(F.pmod(F.xxhash64(key), F.lit(batches)) == b), key, text)
    return index.spans(docs, key, text)


def shared_share(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 300) -> DataFrame:
    """(key, n_chars, shared_chars): how much of each document stands elsewhere too; null texts count as empty."""
    spans = shared_spans(docs, key, text, min_chars).groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("s"))
    return docs.select(key, F.coalesce(F.length(text), F.lit(0)).alias("n_chars")).join(spans, key, "left").select(key, "n_chars", F.coalesce("s", F.lit(0)).cast("long").alias("shared_chars"))
