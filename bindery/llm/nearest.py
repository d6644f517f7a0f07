"""Exact top-k search (operator 11): bounds from segment means and deviations, coarse to fine, then exact scores.

Components become integers floor(256 * x); the score of two vectors is their inner product. A vector cut into segments of
length L has in each a mean m and a deviation s, and by Cauchy and Schwarz the inner product of two vectors is at most the
sum of L * (m * m' + s * s') over the segments: the lower bound of their distance that segment statistics give, with the
exact norms put in. More segments give a tighter bound.

Equal vectors are one class, searched once and asked for once. Classes are range-sorted by the signs of their segment
means and stored in blocks of BLOCK classes with bounding boxes of the statistics. Each asking class first meets the classes
of its own block, which gives a score that its k-th neighbour reaches at least. Then the asking classes, dealt into chunks
of bounded size, are broadcast one chunk at a time, and every block is tested against them: the box first, then each
level of LEVELS, and what survives is scored exactly. A task hands on k + 1 classes for each query at most.

Defined results: null vectors and those with null or non-finite components take no part. Vectors shorter than the longest
count as followed by zeros, so an empty one scores 0 with all. Rows are known by themselves: of two rows with one vec_id
each is a candidate for the other. A null vec_id asks nothing, is a candidate and loses ties. Equal scores go to smaller
vec_ids. Components and scores beyond 64 bits stop at their limits. An empty table gives no rows, and other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.llm.common import Stash

#: Segments of the levels, coarse to fine. Vectors are followed by zeros up to a multiple of the last.
LEVELS = (1, 4, 16)
#: Classes in a block.
BLOCK = 1024
#: Bytes of the vectors of the asking classes that are broadcast at once.
CHUNK_BYTES = 24 << 20
#: Asking classes that meet a block at once.
SIDE = 2048
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def integer_vectors(vectors: DataFrame, *more) -> DataFrame:
    """vec_id and v, the integer components, of the rows whose vector is whole; `more` columns go along."""
    e, infinite = F.col("embedding"), F.lit(float("inf"))
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < infinite))
    v = F.transform(e, lambda x: F.floor(x.cast("double") * 256))
    return vectors.where(e.isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), *more)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows of `width` integers, short ones followed by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out, flat = np.zeros((len(column), width), np.int64), column.flatten().to_numpy(zero_copy_only=False)
    n = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _fits(a: np.ndarray, b: np.ndarray, bits: int) -> bool:
    peak = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return a.shape[-1] * peak(a) * peak(b) < 1 << bits


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of `a` with all of `b`."""
    if _fits(a, b, 53):
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), _LOW, _HIGH).astype(np.int64)


def inner_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of `a` with the same rows of `b`."""
    if _fits(a, b, 63):
        return np.einsum("ij,ij->i", a, b)
    return np.clip((a.astype(object) * b.astype(object)).sum(1), _LOW, _HIGH).astype(np.int64)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means, then deviations of the segments, both times the root of the length; an inner product of two such rows is a bound."""
    cut = x.astype(float).reshape(len(x), segments, -1)
    root = np.sqrt(cut.shape[2])
    return np.concatenate([cut.mean(2) * root, cut.std(2) * root], 1)


class Queries:
    """Asking classes with the scores that their last neighbours reach at least."""

    def __init__(self, v: np.ndarray, least: np.ndarray):
        self.v, self.least = v, least.copy()
        self.levels = [statistics(v, s) for s in LEVELS]
        # What rounding can take from a bound, relative to the norm of the query.
        self.slack = 1e-9 * np.sqrt((v.astype(float) ** 2).sum(1))


def survivors(q: Queries, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of all pairs that no bound excludes."""
    stats, norm = [statistics(x, s) for s in LEVELS], np.sqrt((x.astype(float) ** 2).sum(1))
    s = LEVELS[-1]
    low, high, spread = stats[-1][:, :s].min(0), stats[-1][:, :s].max(0), stats[-1][:, s:].max(0)
    mean, deviation = q.levels[-1][:, :s], q.levels[-1][:, s:]
    box = np.clip(mean, 0, None) @ high + np.clip(mean, None, 0) @ low + deviation @ spread
    # A score of the lowest limit may stand for any below it.
    asked = np.where(q.least == _LOW, -np.inf, q.least.astype(float))
    near, out = np.flatnonzero(box + q.slack * norm.max() + 1e-6 >= asked), []
    for i in range(0, len(near), SIDE):
        at = near[i : i + SIDE]
        least = asked[at, None] - q.slack[at, None] * norm - 1e-6
        row = col = None
        for a, b in zip(q.levels, stats, strict=True):
            if row is None:
                open_ = a[at] @ b.T >= least
                if open_.mean() < 0.2:
                    row, col = np.nonzero(open_)
            elif len(row):
                bound = np.concatenate([np.einsum("ij,ij->i", a[at[row[j : j + 65536]]], b[col[j : j + 65536]]) for j in range(0, len(row), 65536)])
                keep = bound >= least[row, col]
                row, col = row[keep], col[keep]
        if row is None:
            score = inner(q.v[at], x)
            row, col = np.nonzero(open_ & (score >= q.least[at, None]))
            out.append((at[row], col, score[row, col]))
        elif len(row):
            score = np.concatenate([inner_pairs(q.v[at[row[j : j + 65536]]], x[col[j : j + 65536]]) for j in range(0, len(row), 65536)])
            keep = score >= q.least[at[row]]
            out.append((at[row[keep]], col[keep], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def first_of_each(q: np.ndarray, score: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores of each query, ties to the smaller `first`."""
    order = np.lexsort((first, ~score, q))
    start = np.flatnonzero(np.diff(q[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order)))
    return order[rank < n]


def _blocks(classes: DataFrame, width: int) -> DataFrame:
    """Blocks of classes that are near in the order of the signs of their segment means."""
    v, sign = F.concat(F.col("v"), F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))), F.lit(0)
    for s in LEVELS:
        for i in range(s):
            total = F.aggregate(F.slice(v, i * (width // s) + 1, width // s), F.lit(0.0), lambda a, x: a + x)
            sign = sign * 2 + (total > 0).cast("int")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                flat = pa.array(matrix(part.column("v"), width).ravel())
                yield pa.RecordBatch.from_arrays([one(part.column("cls")), one(part.column("first")), one(part.column("asks")), one(flat)], names=["cls", "first", "asks", "v"])

    n = classes.count()
    dealt = classes.withColumn("sign", sign).repartitionByRange(max(1, n // (8 * BLOCK)), "sign", "cls").sortWithinPartitions("sign", "cls")
    return dealt.select("cls", "first", "asks", "v").mapInArrow(packed, "cls array<string>, first array<long>, asks array<boolean>, v array<long>")


def _own_blocks(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cls, asks = b.column("cls")[i].values, b.column("asks")[i].values.to_numpy(zero_copy_only=False).astype(bool)
                x, at = b.column("v")[i].values.to_numpy().reshape(-1, width), np.flatnonzero(asks)
                if not len(at):
                    continue
                score = inner(x[at], x)
                least = np.partition(score, len(x) - k - 1, 1)[:, len(x) - k - 1] if len(x) > k else np.full(len(at), _LOW)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), pa.array(x[at].ravel()))
                yield pa.RecordBatch.from_arrays([cls.take(pa.array(at)), pa.array(least), vectors], names=["q", "least", "v"])

    return run


def _scan(held, k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, v, least = held.value
        q = Queries(v, least)
        best = [np.zeros(0, np.int64)] * 3
        label: list[str] = []
        for b in batches:
            for i in range(b.num_rows):
                at, row, score = survivors(q, b.column("v")[i].values.to_numpy().reshape(-1, width))
                if not len(at):
                    continue
                used, place = np.unique(row, return_inverse=True)
                cls, first = b.column("cls")[i].values.take(pa.array(used)).to_pylist(), b.column("first")[i].values.to_numpy()[row]
                whole = [np.concatenate(x) for x in zip(best, (at, score, first), strict=True)]
                label_at = np.concatenate([label_at, place + len(label)]) if label else place
                label += cls
                keep = first_of_each(*whole, k + 1)
                best, label_at = [x[keep] for x in whole], label_at[keep]
                live, label_at = np.unique(label_at, return_inverse=True)
                label = [label[j] for j in live.tolist()]
                # The last of k + 1 classes found is one that the rest must reach.
                n = np.bincount(best[0], minlength=len(names))
                full = np.flatnonzero(n > k)
                q.least[full] = np.maximum(q.least[full], best[1][np.cumsum(n)[full] - 1])
        if label:
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.take(pa.array(best[0]))), pa.array([label[j] for j in label_at.tolist()]), pa.array(best[1]), pa.array(best[2])],
                names=["q", "cls", "score", "first"],
            )

    return run


def exact_top_k(spark: SparkSession, vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by `every`."""
    stash = Stash(spark)
    own = integer_vectors(vectors).withColumns({"cls": F.md5(F.concat_ws(",", F.col("v").cast("array<string>")).cast("binary")), "rid": F.monotonically_increasing_id()})
    rows = stash.put(own, "rows")
    longest = rows.agg(F.max(F.size("v")).alias("n")).first()["n"] or 1
    width = -(-max(1, longest) // LEVELS[-1]) * LEVELS[-1]
    asks = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    # Short vectors followed by zeros are equal to longer ones, but as classes of their own they score the same.
    classes = stash.put(
        rows.groupBy("cls").agg(F.any_value("v").alias("v"), F.coalesce(F.min("vec_id"), F.lit(_HIGH)).alias("first"), F.max(asks).alias("asks")), "classes"
    )
    # A class needs no more than its k + 1 first rows: one may be the query's own.
    nth = F.row_number().over(Window.partitionBy("cls").orderBy(F.col("vec_id").asc_nulls_last(), "rid"))
    members = rows.select("cls", "vec_id", "rid").withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")
    blocks = stash.put(_blocks(classes, width), "blocks")
    asked = stash.put(blocks.mapInArrow(_own_blocks(k, width), "q string, least long, v array<long>"), "asked", 8)
    stash.drop(classes)
    n = asked.count()
    chunks = -(-n * width * 8 // CHUNK_BYTES)
    found = spark.createDataFrame([], "q string, cls string, score long, first long")
    for i in range(chunks):
        part = asked.where(F.pmod(F.xxhash64("q"), F.lit(chunks)) == i).toArrow()
        held = spark.sparkContext.broadcast((part["q"].combine_chunks(), matrix(part["v"], width), part["least"].to_numpy()))
        found = found.unionByName(stash.put(blocks.mapInArrow(_scan(held, k, width), "q string, cls string, score long, first long"), "found", 8))
        held.unpersist()
    top = Window.partitionBy("q").orderBy(F.desc("score"), "first", "cls")
    best = found.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k + 1).select("q", "cls", "score")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "rid")
    near = best.join(members, "cls").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    lists = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("nth", "rid", "vec_id", "score"))).alias("near"))
    queries = rows.where(asks).select(F.col("vec_id").alias("query_id"), F.col("rid").alias("own"), F.col("cls").alias("q"))
    others = F.slice(F.filter("near", lambda x: x["rid"] != F.col("own")), 1, k)
    return (
        queries.join(lists, "q").select("query_id", F.posexplode(others).alias("at", "x"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
    )
