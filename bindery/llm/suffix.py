"""Suffix-array dedup (operator 10): a logarithmic family of sparse suffix arrays over the bytes of all documents.

A string of `length` bytes that starts at two places is a long match. Each window of that length is represented by
one suffix: the one that starts at its k-gram of least hash (the leftmost of equals), so equal windows are
represented at equal places. Consecutive windows with one representative are a run; all its windows together are the
run's bytes.

A suffix array is a stored table of these suffixes in the order of their first `gram` bytes, then of the hash of their
run: document, run, prefix. A family holds arrays whose sizes, in batches, are powers of two. A new batch is merge-scanned
with the levels that it completes to the next power, all at once: their rows are dealt out by ranges of that order, sorted,
and each is compared with its neighbours. Suffixes with the prefix of a neighbour are met, those with its run as well are
twins: all their windows are long matches. Levels that were never merged are scanned together when finds are asked for.
Where a range begins or ends, the neighbour is in another task; the prefixes there, two for a range, are compared afterwards.

Suffixes that are never met can't match. Those that are met, but no twins (the edges of shared passages), are compared
window by window. Every stage deals out by ranges that split equal keys, by joins on keys, or by partial sums, so a
passage that many documents share meets in no single task.

Defined results: overlaps within a document count, matches never cross documents; null and empty texts have no bytes,
texts under `length` bytes lose none. Rows with one doc_id and one text are copies of each other and lose all bytes if
they have `length` of them; rows of one doc_id with different texts are different documents, and a null doc_id is one like
others. There are no ties: nothing is kept for being first. An empty table gives no rows; other columns, whatever their
names, are not looked at. Very long texts are hashed in segments of SEGMENT bytes, but held whole by the task that cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import TEXTS, Stash, keyed, mix, pieces_of, prefix_hashes, sized, span_hashes

LENGTH, GRAM = 200, 32
#: Different runs of one k-gram that are compared together; more of them are dealt out in blocks of that size.
BLOCK = 64
#: Bytes looked at in one go; positions take 24 bits.
SEGMENT = 1 << 22
_POSITION = np.uint64((1 << 24) - 1)


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, first window, last window, representative, gram hash, run hash) of all runs of the rows cut by `offsets`."""
    n = len(data)
    starts, ends = offsets[:-1], offsets[1:]
    step = np.zeros(n + 1, np.int64)
    long = ends - starts >= length
    np.add.at(step, starts[long], 1)
    np.add.at(step, ends[long] - length + 1, -1)
    valid = np.cumsum(step)[: max(0, n - length + 1)] > 0
    if not valid.any():
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z
    s = prefix_hashes(data)
    at = np.arange(n - gram + 1)
    grams = span_hashes(s, at, at + gram)
    least = (grams & ~_POSITION) | at.astype(np.uint64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < width:
        more = width - span
        least = np.minimum(least[: len(least) - more], least[more:])
    rep = (least & _POSITION).astype(np.int64)
    same = np.zeros(len(valid), bool)
    same[1:] = (rep[1:] == rep[:-1]) & valid[1:] & valid[:-1]
    first = np.flatnonzero(valid & ~same)
    row = np.searchsorted(offsets, first, "right") - 1
    # Consecutive windows of two rows never have one representative in common, as each lies within its row.
    last = np.flatnonzero(valid & ~np.append(same[1:], False))
    p = rep[first]
    whole = mix(span_hashes(s, first, last + length) + mix((p - first).astype(np.uint64)))
    return row, first, last, p, grams[p].view(np.int64), whole.view(np.int64)


def _segments(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, shifts, bytes, offsets) with texts longer than SEGMENT cut into pieces that share length - 1 bytes."""
    for row, data, offsets in pieces_of(column):
        if len(data) <= SEGMENT:
            m = len(offsets) - 1
            yield np.arange(row, row + m), np.zeros(m, np.int64), data, offsets
            continue
        for i in range(0, max(1, len(data) - length + 1), SEGMENT - length + 1):
            part = data[i : i + SEGMENT]
            yield np.array([row]), np.array([i]), part, np.array([0, len(part)])


SUFFIXES = "did long, rid long, s0 long, s1 long, prefix binary, run long"


def suffix_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(did, rid, s0, s1, prefix, run): the suffixes of keyed documents with first and last window of their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, rid = (b.column(i).to_numpy() for i in (0, 1))
            for rows, shift, data, offsets in _segments(b.column(2), length):
                r, first, last, p, _, whole = runs(data, offsets, length, gram)
                base = (shift - offsets[:-1])[r]
                raw = np.ascontiguousarray(data[p[:, None] + np.arange(gram)])
                prefix = pa.FixedSizeBinaryArray.from_buffers(pa.binary(gram), len(p), [None, pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(did[rows[r]]), pa.array(rid[rows[r]]), pa.array((first + base).astype(np.int64)),
                        pa.array((last + base).astype(np.int64)), prefix, pa.array(whole),
                    ],
                    names=["did", "rid", "s0", "s1", "prefix", "run"],
                )

    return docs.select("did", "rid", "text").mapInArrow(run, SUFFIXES)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks, in one range of sorted suffixes, those that are met or twins, and the first and last one as edges."""
    held, begun = None, False
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if held is None else [held, b.cast(held.schema)]).combine_chunks()
        held = yield from _marked(t, begun, False)
        begun = True
    if held is not None:
        yield from _marked(pa.Table.from_batches([held]), begun and held["edge"][0].as_py() is False, True)


def _marked(t: pa.Table, begun: bool, ended: bool):
    """Gives out all rows but the last, which is returned for the next call, or all if the range has `ended`."""
    n = t.num_rows
    marks = {}
    same = np.zeros(n - 1, bool)
    for name, columns in (("met", ("prefix",)), ("twin", ("prefix", "run"))):
        same = np.ones(n - 1, bool)
        for c in columns:
            same &= pc.equal(t[c].slice(1), t[c].slice(0, n - 1)).to_numpy()
        m = t[name].to_numpy().copy()
        m[1:] |= same
        m[:-1] |= same
        marks[name] = m
    edge = t["edge"].to_numpy().copy()
    edge[0] |= not begun
    edge[-1] |= ended
    for name, m in (*marks.items(), ("edge", edge)):
        t = t.set_column(t.schema.get_field_index(name), name, pa.array(m))
    out = t if ended else t.slice(0, n - 1)
    if out.num_rows:
        yield from out.combine_chunks().to_batches()
    return None if ended else t.slice(n - 1).combine_chunks().to_batches()[0]


class SuffixFamily:
    """Suffix arrays on shared storage, each with the number of batches it holds; their rows tell what merge scans have found."""

    def __init__(self, stash: Stash, ranges: int | None = None):
        self.stash, self.levels = stash, []
        self.ranges = ranges or int(stash.spark.conf.get("spark.sql.shuffle.partitions"))

    def scan(self, rows: DataFrame, found_only: bool) -> DataFrame:
        """The rows in order, with what their neighbours tell; only the met ones if `found_only`."""
        order = ("prefix", "run", "did", "rid", "s0")
        dealt = rows.withColumn("edge", F.lit(False)).repartitionByRange(self.ranges, *order).sortWithinPartitions(*order)
        seen = dealt.mapInArrow(_neighbours, SUFFIXES + ", met boolean, twin boolean, edge boolean")
        seen = self.stash.put(seen.where("met OR edge") if found_only else seen, "scan")
        # As many rows as there are ranges, twice.
        edges = seen.where("edge").groupBy("prefix").agg(F.count("*").alias("k"), F.collect_list("run").alias("runs")).where("k > 1").collect()
        met = F.col("met")
        for e in edges:
            here = F.col("prefix") == F.lit(bytes(e["prefix"]))
            met = met | here
        twins = [(bytes(e["prefix"]), r) for e in edges for r in set(e["runs"]) if e["runs"].count(r) > 1]
        twin = F.col("twin")
        for prefix, r in twins:
            twin = twin | (F.col("prefix") == F.lit(prefix)) & (F.col("run") == F.lit(r))
        out = seen.select("did", "rid", "s0", "s1", "prefix", "run", met.alias("met"), twin.alias("twin"))
        out._stash_path = seen._stash_path
        return out

    def add(self, batch: DataFrame) -> None:
        """Takes in the suffixes of new documents, with all levels that are due to be merged with them in one scan."""
        rows, size, due = batch.withColumns({"met": F.lit(False), "twin": F.lit(False)}), 1, []
        while self.levels and self.levels[-1][0] == size:
            due.append(self.levels.pop()[1])
            rows, size = due[-1].unionByName(rows), size * 2
        self.levels.append((size, self.scan(rows, False)))
        self.stash.drop(*due)

    def found(self) -> DataFrame:
        """(did, rid, s0, s1, prefix, run, met, twin) of each suffix that is met within its level or, if there are several, in another."""
        whole = self.levels[0][1]
        if len(self.levels) > 1:
            for _, level in self.levels[1:]:
                whole = whole.unionByName(level)
            whole = self.scan(whole, True)
        return whole.where("met")


def _run_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of a document, with the bytes of its windows and the block of its k-gram that it belongs to."""
    for b in batches:
        column = b.column(2)
        for i, (did, rid, x) in enumerate(zip(*(b.column(j).to_pylist() for j in (0, 1, 3)), strict=True)):
            raw = column[i].as_buffer().to_pybytes()
            s0, k = np.array([r["s0"] for r in x], np.int64), np.array([r["k"] for r in x], np.int64)
            blocks = -(-k // BLOCK)
            salt = (mix(s0.astype(np.uint64) + mix(np.array([rid], np.int64).view(np.uint64))) % blocks.astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([did] * len(x), pa.int64()), pa.array([rid] * len(x), pa.int64()), pa.array(s0), pa.array([r["gram"] for r in x], pa.int64()),
                    pa.array(salt), pa.array(blocks > 1), pa.array([raw[r["s0"] : r["e"]] for r in x], pa.binary()),
                ],
                names=["did", "rid", "s0", "gram", "block", "hot", "raw"],
            )


def _groups(batches: Iterator[pa.RecordBatch], room: int = 4 << 20) -> Iterator[pa.Table]:
    """Rows sorted by gram and block, in tables of about `room` bytes that never split a block."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size > room:
            t = pa.Table.from_batches(held).combine_chunks()
            g, k = t["gram"].to_numpy(), t["block"].to_numpy()
            cut = np.flatnonzero((g[1:] != g[:-1]) | (k[1:] != k[:-1]))
            if len(cut):
                yield t.slice(0, int(cut[-1]) + 1)
                held = t.slice(int(cut[-1]) + 1).combine_chunks().to_batches()
                size = sum(x.nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held)


def _compared(t: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """What the windows of whole blocks show: those that stand twice, and the hashes of those that hot k-grams leave open."""
    t = t.combine_chunks()
    raw = t["raw"].combine_chunks() if isinstance(t["raw"], pa.ChunkedArray) else t["raw"]
    sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    n = sizes - length + 1
    local = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(begin, n) + local
    h = span_hashes(prefix_hashes(data), at, at + length).view(np.int64)
    did, rid, hot = (np.repeat(t[c].to_numpy(), n) for c in ("did", "rid", "hot"))
    s = np.repeat(t["s0"].to_numpy(), n) + local
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    before, after = np.append(False, same), np.append(same, False)
    hit, one, alone = order[before | after], order[~before & after], order[~before & ~after]
    alone, one = alone[hot[alone]], one[hot[one]]
    for i in range(0, len(alone), 100_000):
        x = alone[i : i + 100_000]
        yield _windows(did[x], rid[x], s[x], s[x] + length, h[x])
    if len(one):
        yield _windows(None, None, s[one], s[one] + length, h[one])
    order = hit[np.lexsort((s[hit], rid[hit], did[hit]))]
    did, rid, s = did[order], rid[order], s[order]
    if len(s):
        # Neighbouring windows make one span.
        cut = np.flatnonzero(np.append(True, (did[1:] != did[:-1]) | (rid[1:] != rid[:-1]) | (s[1:] > s[:-1] + 1)))
        yield _windows(did[cut], rid[cut], s[cut], s[np.append(cut[1:] - 1, len(s) - 1)] + length, None)


def covered_windows(stash: Stash, docs: DataFrame, probes: DataFrame, length: int) -> DataFrame:
    """(did, rid, s, e) of the windows of `probes` (did, rid, s0, s1, gram, k) that stand at two places among them.

    Equal windows have one k-gram, so runs are compared within blocks of about BLOCK runs of one k-gram. Where a k-gram
    has several blocks, what a block leaves open, and one of each of its equal windows, is counted by hash across blocks.
    """
    packed = F.collect_list(F.struct("s0", (F.col("s1") + length).alias("e"), "gram", "k")).alias("x")
    by_doc = stash.put(probes.groupBy("did", "rid").agg(packed), "probes")
    wanted = docs.join(by_doc, ["did", "rid"]).select("did", "rid", "text", "x")
    rows = wanted.mapInArrow(_run_texts, "did long, rid long, s0 long, gram long, block long, hot boolean, raw binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            yield from _compared(t, length)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "gram", "block").sortWithinPartitions("gram", "block")
    found = stash.put(dealt.mapInArrow(compare, "did long, rid long, s long, e long, h long"), "compared", TEXTS)
    open_rows = found.where("h IS NOT NULL")
    twice = stash.put(open_rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "twice")
    more = open_rows.where("did IS NOT NULL").join(twice, "h").select("did", "rid", "s", "e")
    return found.where("h IS NULL").select("did", "rid", "s", "e").unionByName(more)


def _windows(did, rid, s, e, h) -> pa.RecordBatch:
    null = pa.nulls(len(s), pa.int64())
    columns = [null if x is None else pa.array(x) for x in (did, rid, s, e, h)]
    return pa.RecordBatch.from_arrays(columns, names=["did", "rid", "s", "e", "h"])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges each document's spans."""
    for b in batches:
        out = []
        for did, rid, s, e in zip(*(b.column(j).to_pylist() for j in range(4)), strict=True):
            s, e = np.array(s), np.array(e)
            order = np.argsort(s, kind="stable")
            s, e = s[order], np.maximum.accumulate(e[order])
            cut = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
            out.append((did, rid, s[cut], e[np.append(cut[1:] - 1, len(e) - 1)]))
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["did", "rid", "s", "e"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, s, e in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            kept, at = [], 0
            for x, y in zip(s or [], e or [], strict=True):
                kept.append(raw[at:x])
                at = y
            kept = b"".join([*kept, raw[at:]])
            rows.append((len(raw), len(raw) - len(kept), len(s or []), hashlib.sha256(kept).hexdigest()))
        cols = zip(*rows, strict=True) if rows else [[]] * 4
        more = [pa.array(list(c), t) for c, t in zip(cols, [*[pa.int64()] * 3, pa.string()], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), *more], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(stash: Stash, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = 4) -> DataFrame:
    """(did, rid, s, e): arrays of the maximal removed spans, in bytes, of each of the keyed documents that has any."""
    rows = stash.put(suffix_runs(docs, length, gram), "runs", TEXTS)
    family = SuffixFamily(stash)
    for i in range(batches):
        family.add(rows.where(F.pmod(F.hash("did", "rid"), F.lit(batches)) == i))
    stash.drop(rows)
    near = stash.put(family.found().withColumn("gram", F.xxhash64("prefix")).drop("prefix", "met"), "near")
    stash.drop(*(level for _, level in family.levels))
    # Of suffixes of one k-gram with different runs, one of each run is compared window by window.
    first = near.groupBy("gram", "run").agg(F.min(F.struct("did", "rid", "s0", "s1")).alias("f"))
    first = stash.put(first.select("gram", "run", "f.*"), "first")
    several = first.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1")
    probes = first.join(several, "gram").select("did", "rid", "s0", "s1", "gram", "k")
    spans = near.where("twin").select("did", "rid", F.col("s0").alias("s"), (F.col("s1") + length).alias("e"))
    spans = spans.unionByName(covered_windows(stash, docs, probes, length))
    # Repeated rows are copies of each other.
    size = F.octet_length("text").cast("long")
    copies = docs.where(size >= length).groupBy("did", "rid").agg(F.count("*").alias("k"), F.max(size).alias("e")).where("k > 1")
    spans = spans.unionByName(copies.select("did", "rid", F.lit(0).cast("long").alias("s"), "e"))
    spans = spans.groupBy("did", "rid").agg(F.collect_list(F.struct("s", "e")).alias("x")).select("did", "rid", "x.s", "x.e")
    return stash.put(spans.mapInArrow(_united, "did long, rid long, s array<long>, e array<long>"), "spans")


def dedup_bytes(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = 4) -> DataFrame:
    """One row for each document: bytes, removed bytes, removed spans and the digest of what is left."""
    stash, docs = Stash(spark), keyed(docs)
    spans = repeated_spans(stash, docs, length, gram, batches)
    df = docs.join(sized(spans, F.size("s") * 16 + 64), ["did", "rid"], "left").select("doc_id", "text", "s", "e")
    return stash.put(df.mapInArrow(_cut, RESULT), "cut", TEXTS)
