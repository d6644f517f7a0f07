"""Shared plumbing: tables written to the shared folder, size-checked joins, and vectorised word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.storage import Scratch

#: Java regex of the separators between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[ \x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table is broadcast only when its rows, counted first, stay below this many bytes; otherwise it is shuffled.
BROADCAST_BYTES = 24 << 20
#: Partitions of up to so many shuffled bytes may be joined by a hash table; larger ones are sorted, which can spill.
HASHED_BYTES = "64m"


class Stash:
    """Tables written once to the shared folder, so that a lost executor costs a reread and not a recomputation.

    The result of an operator is a plan that may still read some of them, so they can't go when the operator returns.
    close() deletes what is left, when the result has been written; otherwise the file system does when the session's process ends.
    """

    def __init__(self, spark: SparkSession):
        scratch = Scratch(spark)
        self.spark, self.root = spark, scratch.root
        self.n = 0
        _open.append(self)

    def put(self, df: DataFrame, name: str = "t", rows: int | None = None, hashes: bool = False, joins: bool = False) -> DataFrame:
        """`hashes`: the table is mostly hashes, on which dictionaries and strong compression are wasted. `joins`: partitions that turn
        out to be small are joined by hash tables and not sorted. `rows`: how many rows are handed to Python at once while the table is made. Texts are long, and an executor
        holds several batches of them. Shuffle files go when the table has been written, as nothing else reads them.
        The session's own settings are put back."""
        self.n += 1
        path, conf = f"{self.root}/{self.n}-{name}", self.spark.conf
        own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
        if rows is not None:
            own["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(rows)
        if joins:
            own["spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"] = HASHED_BYTES
        before = {k: conf.get(k) for k in own}
        try:
            for k, v in own.items():
                conf.set(k, v)
            kind = {"compression": "lz4_raw", "parquet.enable.dictionary": "false"} if hashes else {"compression": "zstd"}
            df.write.options(**kind).parquet(path)
        finally:
            for k, v in before.items():
                conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stash_path = path
        return out

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for df in tables:
            self._delete(df._stash_path)

    def close(self) -> None:
        if self in _open:
            _open.remove(self)
            self._delete(self.root)


_open: list[Stash] = []


def close_all() -> None:
    """Deletes the tables of all operators run so far: for when their results have been written."""
    for stash in list(_open):
        stash.close()


def sized(df: DataFrame, row_bytes) -> DataFrame:
    """`df`, a stored table, with a broadcast hint if the sum of its rows' bytes (a number or column) is small; else as it is."""
    whole = df.agg(F.sum(F.lit(row_bytes)).alias("b")).first()["b"] or 0
    return F.broadcast(df) if whole <= BROADCAST_BYTES else df


#: Rows of texts handed to Python at once.
TEXTS = 1000


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text, null texts as empty; other columns of `docs`, whatever their names, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def keyed(docs: DataFrame, *more) -> DataFrame:
    """doc_id, text (null as empty) and a row's key: did, the doc_id or, if null, the least number, and rid, the text's hash.

    Equal rows have one key; rows of one doc_id with different texts have different ones. `more` columns go along.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    did = F.col("doc_id").cast("long")
    return docs.select(did.alias("doc_id"), F.coalesce(did, F.lit(-(1 << 63))).alias("did"), F.xxhash64(text).alias("rid"), text.alias("text"), *more)


def ascii_lower(c):
    """Lower-cases A-Z and nothing else."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


# --- vectorised hashing of the words of an Arrow string column -------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of them at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for k, b in enumerate((_BASE, inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k : k + 1] = [np.multiply.accumulate(p)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all 64 bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = base**i times the polynomial hash of data[i:j]."""
    p, _ = powers(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * p[: len(data)], out=s[1:])
    return s


def span_hashes(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inv = powers(len(s))
    return mix((s[ends] - s[starts]) * inv[starts])


def pieces_of(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into these bytes) for runs of rows of about `limit` bytes; a row is never split."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes and first-word index of each row for the lower-cased words of the rows cut by `offsets`."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    folded = _FOLD[data]
    gap = np.ones(n + 1, bool)
    gap[1:] = _SEPARATOR[data]
    inside = ~gap[1:]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (gap[:-1] | edge[:-1]))
    after = np.append(gap[2:], True) | edge[1:]
    ends = np.flatnonzero(inside & after) + 1
    hashes = span_hashes(prefix_hashes(folded), starts, ends)
    return starts, ends, hashes, np.searchsorted(starts, offsets)
