"""Packing (operator 8): documents in Hilbert-curve order, cut into sequences of 2048 tokens without gaps.

A document's token counts are hashed to a short vector, projected to three fixed random directions and placed on a
Hilbert curve; the documents are range-sorted by that key (ties by doc_id, so copies spread over ranges) and laid end
to end, so neighbours in a sequence resemble each other and only the very last sequence is short. It is padded to
2048 unless its length is a power of two. Token offsets are exact: each range counts its own tokens, and only the ranges'
totals are summed up across ranges.

Defined results: null, empty and blank texts are the end id alone. Repeated rows are packed once each, one after the other;
ties on the curve go by doc_id, null first. An empty table gives no pieces; other columns, whatever their names, are not
looked at. The strings of the vocabulary's special tokens are those tokens. A very long text is held, as text and as ids,
by one task, and cut into pieces like others.
"""

from __future__ import annotations

import itertools
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.llm.common import TEXTS, Stash, texts

SEQUENCE, END = 2048, 1
DIMS, BITS, FEATURES = 3, 10, 64


class ChunkTokenizer:
    """Token ids of whole texts from a cache of their space-free chunks.

    The vocabulary's normaliser and splitter never join characters across white space, so the ids of a text are the
    ids of its chunks, one after the other. A chunk of letters with ASCII punctuation after them is the ids of the
    lower-cased letters and those of the punctuation, each one unit to the merges; all others go through the whole
    tokenizer. The chunks of many texts are split and told apart by Arrow, so that each different one is looked up once. The
    cache is emptied when it holds about `room` bytes.
    """

    PUNCTUATION = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())

    def __init__(self, path: str, room: int = 200 << 20):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        self.t, self.room = Tokenizer.from_file(path), room
        self.merges = self.t.model.tokenize
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        #: Each byte as the character by which byte-level vocabularies write it.
        self.byte_names = {i: chr(i) if i in plain else chr(next(spare)) for i in range(256)}
        self.clear()

    def clear(self) -> None:
        self.index = _Places(self.ids_of)
        self.units: dict[str, list[int]] = {}
        self.ids, self.begins = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.held = 0

    def unit(self, text: str) -> list[int]:
        got = self.units.get(text)
        if got is None:
            named = text if text.isascii() else text.encode().decode("latin-1").translate(self.byte_names)
            got = self.units[text] = [x.id for x in self.merges(named)]
            self.held += 200 + len(text) + 8 * len(got)
        return got

    def chunk(self, c: str) -> list[int]:
        if c.isascii() and c.isalpha() and c.islower():
            return [x.id for x in self.merges(c)]  # kept once, under the chunk itself
        core = c.rstrip(self.PUNCTUATION)
        low = core.lower()
        # The final sigma is the one letter that str.lower() lowers by its place; the vocabulary's normaliser doesn't.
        if core.isalpha() and low.isalpha() and (c.isascii() or "\u03a3" not in c and unicodedata.is_normalized("NFC", c)):
            return self.unit(low) if len(core) == len(c) else self.unit(low) + self.unit(c[len(core) :])
        return self.t.encode(c, add_special_tokens=False).ids if c else []

    def ids_of(self, c: str | None) -> list[int]:
        """Ids of a chunk; None is the end of a text."""
        return [END] if c is None else self.chunk(c)

    def batch(self, rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the end id, and how many each text has."""
        if self.held > self.room:
            self.clear()
        chunks = pc.ascii_split_whitespace(rows)
        found = chunks.flatten().dictionary_encode()
        names = found.dictionary.to_pylist()
        at = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))
        last = self.index[None]
        if new := self.index.new:
            ends = self.begins[-1] + np.cumsum([len(x) for x in new])
            flat = np.fromiter(itertools.chain.from_iterable(new), np.uint32)
            self.held += self.index.held + 12 * len(new) + 4 * len(flat)
            self.index.held = 0
            self.ids, self.begins = np.concatenate([self.ids, flat]), np.concatenate([self.begins, ends])
            new.clear()
        # The end id is one more chunk after those of each text.
        stop = np.cumsum(pc.list_value_length(chunks).to_numpy() + 1)
        k = np.full(stop[-1], last, np.int64)
        word = np.ones(len(k), bool)
        word[stop - 1] = False
        k[word] = at[found.indices.to_numpy()]
        begin = self.begins[k]
        n = self.begins[k + 1] - begin
        after = np.cumsum(n)
        ids = self.ids[np.repeat(begin - after + n, n) + np.arange(after[-1])]
        return ids, np.diff(after[stop - 1], prepend=0)


class _Places(dict):
    """Number of each chunk, in the order in which they came; the ids of those that are new wait in `new`."""

    def __init__(self, ids_of):
        super().__init__()
        self.ids_of, self.new, self.held = ids_of, [], 0

    def __missing__(self, chunk: str | None) -> int:
        self[chunk] = n = len(self)
        self.new.append(self.ids_of(chunk))
        self.held += 180 + len(chunk or "")  # the string, its number and its place in the table
        return n


_tokenizers: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """One for each worker process, which takes several tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points (rows), by undoing the curve's turns bit by bit."""
    x = points.astype(np.int64).T.copy()
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            turned = (x[i] & q) > 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    fix, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        fix = np.where(x[-1] & q, fix ^ (q - 1), fix)
        q >>= 1
    x ^= fix
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_key(vectors: np.ndarray) -> np.ndarray:
    """Hilbert key of hashed count vectors (rows of FEATURES counts)."""
    r = np.random.Generator(np.random.PCG64(8)).standard_normal((FEATURES, DIMS))
    v = np.sqrt(vectors.astype(np.float64))
    norm = np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)
    z = (v / norm - 1 / np.sqrt(FEATURES)) @ r
    cells = (1 / (1 + np.exp(-4 * z)) * (1 << BITS)).astype(np.int64)
    return hilbert(np.clip(cells, 0, (1 << BITS) - 1))


def _slices(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(first row, rows) for runs of texts of about `limit` bytes; a text is never split."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(), dtype=np.int64)
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield i, j - i
        i = j


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, hkey, n_tokens, ids as 16-bit binary) with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        bucket = np.random.Generator(np.random.PCG64(7)).integers(0, FEATURES, 1 << 16)
        for whole in batches:
            for i, n in _slices(whole.column(1)):
                b = whole.slice(i, n)
                ids, sizes = tok.batch(b.column(1))
                cells = np.repeat(np.arange(n) * FEATURES, sizes) + bucket[ids]
                counts = np.bincount(cells, minlength=n * FEATURES).reshape(n, FEATURES)
                ends = np.concatenate([[0], np.cumsum(2 * sizes)]).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(curve_key(counts)), pa.array(sizes, pa.int64()), raw], names=["doc_id", "hkey", "n_tokens", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, hkey long, n_tokens long, ids binary")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range's number and the tokens before each row within it."""
    part, before = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column(1).to_numpy(zero_copy_only=False)
        local = before + np.cumsum(n) - n
        before += int(n.sum())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.array(np.full(len(n), part, np.int32)), pa.array(local)],
            names=["doc_id", "n_tokens", "ids", "part", "local"],
        )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, n, raw, at in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            ids, start = np.frombuffer(raw, "<u2").astype("<u4"), 0
            while start < n:
                take = min(n - start, SEQUENCE - at % SEQUENCE)
                crc = zlib.crc32(ids[start : start + take].tobytes())
                rows.append((doc_id, start, take, crc, n, at // SEQUENCE, at % SEQUENCE))
                start, at = start + take, at + take
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row for each piece of each document."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    stash = Stash(spark)
    tokens = stash.put(tokenize(docs, tokenizer_path), "tokens", TEXTS)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        tokens.repartitionByRange(ranges, "hkey", "doc_id").sortWithinPartitions("hkey", "doc_id").select("doc_id", "n_tokens", "ids")
    )
    placed = stash.put(ordered.mapInArrow(_running, "doc_id long, n_tokens long, ids binary, part int, local long"), "placed", TEXTS)
    stash.drop(tokens)
    # As many rows as there are ranges.
    totals = placed.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = totals.select(
        "part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base")
    )
    at = placed.join(F.broadcast(base), "part").select("doc_id", "n_tokens", "ids", (F.col("base") + F.col("local")).alias("at"))
    pieces = stash.put(at.mapInArrow(_pieces, PIECES), "pieces", TEXTS)
    stash.drop(placed)
    return pieces
