"""Vector code compression (operator 12): product codes by Yinyang Lloyd rounds, decided on integers.

Components become integers floor(256 * x). Vectors are cut into PARTS equal parts, and each part position has a codebook
of ENTRIES integer entries. A round assigns every part to its nearest entry and moves each entry to the floored mean of
its parts. The entries of a codebook are clustered into groups of about GROUP. A part keeps, for each group, a lower bound of
its distance to the group's entries other than its own. When entries move, a bound falls by the farthest move within the group,
and only groups whose bound doesn't exceed the exact distance to the part's own entry are scanned. Bounds are floating
point and rounded down, so they only exclude; every decision, ties included, is made on exact integer distances.

Rows, codes and bounds are a stored table, written anew by each round; sums and counts are made by task, for each part and
entry, and summed. The codebooks are the only thing broadcast, and their size is fixed by ENTRIES and the vectors' length.

Defined results: null vectors and those with null or non-finite components are dropped. Vectors shorter than the longest,
and lengths that don't divide by PARTS, are followed by zeros. Equal rows count as often as they stand there. Starting
entries are the vectors of the smallest vec_ids, null ones last, equal ones by their components; fewer rows give fewer
entries. Distances tie to the lower index. Components and errors beyond 64 bits stop at its limits; all before that is exact.
An empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import Stash, sized
from bindery.llm.nearest import integer_vectors, matrix

PARTS, ENTRIES, ROUNDS, GROUP = 16, 64, 2, 10
#: Rows handed to Python at once.
ROWS = 4096
_HIGH = (1 << 63) - 1


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of `x` to all entries."""
    peak = max((abs(int(f)) for a in (x, entries) if a.size for f in (a.min(), a.max())), default=0)
    if x.shape[1] * 4 * peak * peak < 1 << 53:
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    d = x.astype(object)[:, None, :] - entries.astype(object)[None]
    return (d * d).sum(2)


def own_distances(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of `x` to the same rows of `own`."""
    peak = max((abs(int(f)) for a in (x, own) if a.size for f in (a.min(), a.max())), default=0)
    d = x.astype(object) - own if x.shape[1] * 4 * peak * peak >= 1 << 62 else x - own
    return (d * d).sum(1)


def _below(d: np.ndarray) -> np.ndarray:
    """Roots of squared distances, rounded down enough to be bounds."""
    return np.sqrt(d.astype(float)) * (1 - 1e-9)


def grouped(entries: np.ndarray) -> list[np.ndarray]:
    """Ascending indexes of the entries, clustered by a few Lloyd rounds over themselves."""
    n = max(1, len(entries) // GROUP)
    centre = entries[np.linspace(0, len(entries) - 1, n).astype(int)].astype(float)
    for _ in range(5):
        near = ((entries.astype(float)[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        for g in range(n):
            if (near == g).any():
                centre[g] = entries[near == g].mean(0)
    return [at for g in range(n) if len(at := np.flatnonzero(near == g))]


def assign(x: np.ndarray, entries: np.ndarray, groups: list[np.ndarray], code: np.ndarray | None, low: np.ndarray | None, moved: np.ndarray | None):
    """(code, squared distance, bounds, distances computed) of the parts `x`. Without `code` all groups are scanned; with it, those
    whose bound `low`, lessened by the farthest of the `moved` entries in the group, doesn't exceed the distance to the own entry."""
    n, rows = len(x), np.arange(len(x))
    if code is None:
        best, at, low, fails = None, np.full(n, -1), np.zeros((n, len(groups))), np.ones((n, len(groups)), bool)
    else:
        own = own_distances(x, entries[code])
        best, at = own.copy(), code.copy()
        low = np.maximum(low - np.array([moved[g].max() for g in groups]) * (1 + 1e-9), 0)
        fails = low <= np.sqrt(own.astype(float))[:, None] * (1 + 1e-9)
    least, second, which, scanned = {}, {}, {}, 0
    for g, members in enumerate(groups):
        r = np.flatnonzero(fails[:, g])
        if not len(r):
            continue
        d = distances(x[r], entries[members])
        scanned += d.size
        k = d.argmin(1)
        d0 = d[np.arange(len(r)), k]
        rest = d.astype(float)
        rest[np.arange(len(r)), k] = np.inf
        least[g], second[g], which[g] = (r, d0), rest.min(1) if len(members) > 1 else np.full(len(r), np.inf), members[k]
        if best is None:
            best, at = d0.copy(), which[g].copy()
        else:
            better = (d0 < best[r]) | ((d0 == best[r]) & (which[g] < at[r]))
            best[r[better]], at[r[better]] = d0[better], which[g][better]
    for g, (r, d0) in least.items():
        low[r, g] = np.where(at[r] == which[g], second[g] ** 0.5 * (1 - 1e-9), _below(d0))
    if code is not None:
        # The former entry is one of the others now; where its group wasn't scanned, its bound doesn't know it.
        home = np.zeros(len(entries), np.int64)
        for g, members in enumerate(groups):
            home[members] = g
        left = rows[(at != code) & ~fails[rows, home[code]]]
        low[left, home[code[left]]] = np.minimum(low[left, home[code[left]]], _below(own[left]))
    return at, best, low, scanned


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


_STATE = "vec_id long, label {label}, v array<long>, code array<int>, low array<float>, error long, scanned long"


def _assigned(held, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, groups, moved = held.value
        for b in batches:
            x = matrix(b.column("v"), width)
            cut = x.reshape(len(x), PARTS, width // PARTS)
            old = None if moved is None else (b.column("code").flatten().to_numpy().reshape(-1, PARTS), b.column("low").flatten().to_numpy().reshape(len(x), sum(map(len, groups))))
            codes, lows, error, scanned, first = [], [], np.zeros(len(x), object), 0, 0
            for p in range(PARTS):
                last = first + len(groups[p])
                state = (None, None, None) if old is None else (old[0][:, p], old[1][:, first:last].astype(float), moved[p])
                code, d, low, n = assign(cut[:, p], books[p], groups[p], *state)
                codes.append(code)
                lows.append(np.nextafter(low.astype(np.float32), np.float32(-np.inf)))
                error, scanned, first = error + d, scanned + n, last
            error = np.minimum(error, _HIGH).astype(np.int64)
            count = np.zeros(len(x), np.int64)
            count[:1] = scanned
            codes, lows = np.stack(codes, 1).astype(np.int32), np.concatenate(lows, 1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), _lists(x), _lists(codes), _lists(lows), pa.array(error), pa.array(count)], names=["vec_id", "label", "v", "code", "low", "error", "scanned"])

    return run


def _sums(width: int, entries: int):
    """Counts and component sums for each part and entry of the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = width // PARTS
        total, count = np.zeros((PARTS * entries, size), object), np.zeros(PARTS * entries, np.int64)
        for b in batches:
            x = b.column("v").flatten().to_numpy().reshape(-1, size)
            at = (b.column("code").flatten().to_numpy().reshape(-1, PARTS) + np.arange(PARTS) * entries).ravel()
            if x.size and max(abs(int(x.min())), abs(int(x.max()))) * len(x) >= 1 << 62:
                x = x.astype(object)
            part = np.zeros(total.shape, x.dtype)
            np.add.at(part, at, x)
            total += part
            count += np.bincount(at, minlength=len(count))
        k = np.flatnonzero(count)
        cells = [[str(y) for y in row] for row in total[k]]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(count[k]), pa.array(cells, pa.list_(pa.string()))], names=["entry", "n", "sums"])

    return run


def _mean_entries(state: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """The codebooks with each entry moved to the floored mean of its parts. What is collected has one row for each entry."""
    entries, size = books.shape[1], width // PARTS
    parts = state.select("v", "code").mapInArrow(_sums(width, entries), "entry long, n long, sums array<string>")
    total = parts.groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)])
    out = books.copy()
    for r in total.collect():
        p, e = divmod(r["entry"], entries)
        out[p, e] = [int(r[f"s{i}"]) // r["n"] for i in range(size)]
    return out


def compress(spark: SparkSession, vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error and the distances computed) of each whole vector, and the final codebooks by part and entry."""
    stash = Stash(spark)
    rows = stash.put(integer_vectors(vectors, "label"), "rows")
    longest = rows.agg(F.max(F.size("v")).alias("n")).first()["n"] or 1
    width = -(-max(1, longest) // PARTS) * PARTS
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).toArrow()
    start = matrix(first["v"], width)
    books = start.reshape(len(start), PARTS, width // PARTS).transpose(1, 0, 2).copy()
    schema = _STATE.format(label=dict(rows.dtypes)["label"])
    if not len(start):
        return spark.createDataFrame([], schema).select("vec_id", "label", "code", "error", "scanned"), books
    groups, state, moved = [grouped(b) for b in books], rows, None
    for k in range(rounds + 1):
        held = spark.sparkContext.broadcast((books, groups, moved))
        after = stash.put(state.mapInArrow(_assigned(held, width), schema), "state", ROWS)
        held.unpersist()
        stash.drop(state)
        state = after
        if k < rounds:
            former, books = books, _mean_entries(state, books, width)
            moved = np.sqrt(((books.astype(float) - former.astype(float)) ** 2).sum(2))
    return state.select("vec_id", "label", "code", "error", "scanned"), books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each whole vector."""
    state, books = compress(spark, vectors)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_HIGH).cast("decimal(38,0)")).cast("long")
    labels = Stash(spark).put(state.groupBy(F.col("label").alias("own")).agg(total.alias("label_error")), "labels")
    code = F.concat_ws("", F.transform("code", lambda x: F.lower(F.lpad(F.hex(x.cast("long")), 2, "0"))))
    return state.join(sized(labels, 32), F.col("label").eqNullSafe(F.col("own"))).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256")
    )
