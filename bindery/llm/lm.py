"""LM scoring (operator 9): marginal probability over all segmentations into the pieces of an existing vocabulary.

A word is a word-start mark followed by its characters; a segmentation is a sequence of pieces of the vocabulary (any
character may also be spelled by its byte pieces). No vocabulary here comes with unigram scores: the one used is a BPE
vocabulary, whose scores are ranks. So the pieces' probabilities are learned from the training words by expectation
maximisation over the lattice itself: the counts of the vocabulary's own cuts are the start, then come `rounds` rounds in
which every piece gets its expected count over all segmentations of all words, half a count added. A forward recursion
in log space sums over all segmentations of a word. The text's probability is the product over its words and one end
symbol.

Words are counted over all training documents; expectations and scores are computed once for each different word. The
most frequent `head` words (a fixed bound) are broadcast, all other words meet their scores through a shuffle, in which
no word is frequent.

Defined results: null, empty and blank texts have the end symbol only. Repeated rows, and rows with null or repeated
doc_ids, are rows like others; a null doc_id counts as an empty text where its checksum is taken, which is in training.
Ties among the `head` words go by hash. An empty table gives no rows; other columns, whatever their names, are not looked
at. A very long word is cut and summed by one task in time linear in its length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import TEXTS, Stash, pieces_of, texts, words_in

HEAD = 1 << 17
#: A task passes on its word counts when it holds so many different words.
ROOM = 1 << 20


def in_training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1


_TRAINING = "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 5 != 1"


def count_words(docs: DataFrame) -> DataFrame:
    """(hash, word, c): every word of all documents with its count in the training ones, summed within tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, words, known = [], [], {}, 0

        def flush() -> pa.RecordBatch:
            h, at = np.unique(np.concatenate(hashes or [np.zeros(0, np.uint64)]), return_inverse=True)
            c = np.bincount(at, np.concatenate(counts or [np.zeros(0)]), minlength=len(h)).astype(np.int64)
            text = pa.array([words[x] for x in h.tolist()], pa.string())
            hashes.clear(), counts.clear(), words.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), text, pa.array(c)], names=["hash", "word", "c"])

        for b in batches:
            ids = np.array([in_training(x) for x in b.column(0).to_pylist()], bool)
            for row, data, offsets in pieces_of(b.column(1)):
                starts, ends, h, first = words_in(data, offsets)
                train = np.repeat(ids[row : row + len(first) - 1], np.diff(first))
                u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
                hashes.append(u)
                counts.append(np.bincount(inverse, train, minlength=len(u)))
                raw = data.tobytes().translate(_LOWER)
                for x, s, e in zip(u.tolist(), starts[at].tolist(), ends[at].tolist(), strict=True):
                    if x not in words:
                        words[x] = raw[s:e].decode("utf-8", "replace")
            if len(words) > ROOM or len(hashes) > 200:
                if len(words) > ROOM:
                    yield flush()
                else:
                    h, at = np.unique(np.concatenate(hashes), return_inverse=True)
                    c = np.bincount(at, np.concatenate(counts), minlength=len(h))
                    hashes[:], counts[:] = [h], [c]
        yield flush()

    return texts(docs).mapInArrow(run, "hash long, word string, c long")


_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


class Lattice:
    """Segmentations of words into pieces: their summed log probability, and the expected counts of the pieces."""

    MARK, STEP, LONG = 0x2581, 0x9E3779B97F4A7C15, 64

    def __init__(self, names: list[str], logp: np.ndarray):
        self.logp = logp
        spelled = {int(n[3:5], 16): i for i, n in enumerate(names) if len(n) == 6 and n.startswith("<0x")}
        self.byte_piece = np.array([spelled[b] for b in range(256)]) if spelled else np.zeros(256, np.int64)
        skip = {"<unk>", "<s>", "</s>", *(names[i] for i in spelled.values())}
        texts = [(n, i) for i, n in enumerate(names) if n not in skip and n]
        self.longest = max((len(n) for n, _ in texts), default=1)
        h = np.array([self.hash_of(n) for n, _ in texts], np.uint64)
        order = np.argsort(h)
        self.keys, self.ids = h[order], np.array([i for _, i in texts])[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(h >> np.uint64(44)).astype(np.int64)] = True

    @classmethod
    def hash_of(cls, text: str) -> int:
        h = 0
        for c in text:
            h = (h + ord(c) + 1) * cls.STEP % 2**64
        return h

    def pieces(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in `h`, pieces) of the hashes that are a piece's."""
        at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[k] == h[at]
        return at[hit], self.ids[k[hit]]

    def spellings(self, chars: np.ndarray) -> np.ndarray:
        """Log probability of each character's byte pieces."""
        u, at = np.unique(chars, return_inverse=True)
        lp = np.array([self.logp[self.byte_piece[list(chr(c).encode())]].sum() for c in u.tolist()])
        return lp[at.reshape(chars.shape)]

    def arcs(self, chars: np.ndarray):
        """(start, length, rows, pieces) of all pieces in rows of characters of one length."""
        step, codes = np.uint64(self.STEP), chars.astype(np.uint64) + np.uint64(1)
        n = chars.shape[1]
        for i in range(n):
            h = np.zeros(len(chars), np.uint64)
            for k in range(1, min(self.longest, n - i) + 1):
                h = (h + codes[:, i + k - 1]) * step
                rows, ids = self.pieces(h)
                if len(rows):
                    yield i, k, rows, ids

    def _group(self, chars: np.ndarray, counts: np.ndarray | None, total: np.ndarray | None) -> np.ndarray:
        n, spelled, arcs = chars.shape[1], self.spellings(chars), list(self.arcs(chars))
        alpha = np.full((len(chars), n + 1), -np.inf)
        alpha[:, 0] = 0
        at = 0
        for i in range(n):
            alpha[:, i + 1] = np.logaddexp(alpha[:, i + 1], alpha[:, i] + spelled[:, i])
            while at < len(arcs) and arcs[at][0] == i:
                _, k, rows, ids = arcs[at]
                alpha[rows, i + k] = np.logaddexp(alpha[rows, i + k], alpha[rows, i] + self.logp[ids])
                at += 1
        if total is not None:
            beta = np.full((len(chars), n + 1), -np.inf)
            beta[:, n] = 0
            whole = alpha[:, n]
            by_char: list[np.ndarray] = [None] * n
            at = len(arcs) - 1
            for i in range(n - 1, -1, -1):
                lp = spelled[:, i] + beta[:, i + 1]
                by_char[i] = counts * np.exp(alpha[:, i] + lp - whole)
                beta[:, i] = lp
                while at >= 0 and arcs[at][0] == i:
                    _, k, rows, ids = arcs[at]
                    lp = self.logp[ids] + beta[rows, i + k]
                    total += np.bincount(ids, counts[rows] * np.exp(alpha[rows, i] + lp - whole[rows]), minlength=len(total))
                    beta[rows, i] = np.logaddexp(beta[rows, i], lp)
                    at -= 1
            self._spread(chars.ravel(), np.stack(by_char, 1).ravel(), total)
        return alpha[:, n]

    def _spread(self, chars: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
        """Adds the expected counts of spelled characters to their byte pieces."""
        u, at = np.unique(chars, return_inverse=True)
        for c, w in zip(u.tolist(), np.bincount(at, weight).tolist(), strict=True):
            np.add.at(total, self.byte_piece[list(chr(c).encode())], w)

    def _single(self, chars: np.ndarray, count: float, total: np.ndarray | None) -> float:
        """Of one long word, place by place: only the pieces that are there cost time."""
        n, spelled = len(chars), self.spellings(chars).tolist()
        step, codes = np.uint64(self.STEP), chars.astype(np.uint64) + np.uint64(1)
        h, found = np.zeros(n, np.uint64), []
        for k in range(1, min(self.longest, n) + 1):
            h = (h[: n - k + 1] + codes[k - 1 :]) * step
            at, ids = self.pieces(h)
            found.append(np.stack([at, np.full(len(at), k), ids]))
        start, length, ids = np.concatenate(found, 1)
        order = np.argsort(start, kind="stable")
        start, length, ids = start[order], length[order].tolist(), ids[order]
        first, lp = np.searchsorted(start, np.arange(n + 1)).tolist(), self.logp[ids].tolist()
        alpha, exp, log1p = [-math.inf] * (n + 1), math.exp, math.log1p

        def add(x: float, y: float) -> float:
            return x if y == -math.inf else x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))

        alpha[0] = 0.0
        for i in range(n):
            a = alpha[i]
            alpha[i + 1] = add(a + spelled[i], alpha[i + 1])
            for e in range(first[i], first[i + 1]):
                j = i + length[e]
                alpha[j] = add(a + lp[e], alpha[j])
        if total is not None:
            beta, by_char, by_arc = [-math.inf] * (n + 1), [0.0] * n, [0.0] * len(lp)
            beta[n] = 0.0
            for i in range(n - 1, -1, -1):
                b = spelled[i] + beta[i + 1]
                by_char[i] = exp(alpha[i] + b - alpha[n])
                for e in range(first[i], first[i + 1]):
                    y = lp[e] + beta[i + length[e]]
                    by_arc[e] = exp(alpha[i] + y - alpha[n])
                    b = add(y, b)
                beta[i] = b
            total += np.bincount(ids, count * np.array(by_arc), minlength=len(total))
            self._spread(chars, count * np.array(by_char), total)
        return alpha[n]

    def log_probabilities(self, words: list[str], counts: np.ndarray | None = None, total: np.ndarray | None = None) -> np.ndarray:
        """Natural logarithms for words; adds the expected counts, each word `counts` times, to `total` if that is given."""
        out, lengths = np.zeros(len(words)), np.array([len(w) for w in words])
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            text = "".join(words[i] for i in at.tolist())
            chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(at), n)
            chars = np.concatenate([np.full((len(at), 1), self.MARK, np.uint32), chars], 1)
            c = np.ones(len(at)) if counts is None else counts[at].astype(float)
            if n >= self.LONG:
                out[at] = [self._single(x, w, total) for x, w in zip(chars, c.tolist(), strict=True)]
            else:
                out[at] = self._group(chars, c, total)
        return out


def _vocabulary(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return sp, names


def count_pieces(words: DataFrame, path: str) -> DataFrame:
    """(piece, n): counts of the vocabulary's pieces in the training words; one row for a piece and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, names = _vocabulary(path)
        total = np.zeros(len(names), np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 20_000):
                part = b.slice(i, 20_000)
                c = part.column(1).to_numpy(zero_copy_only=False)
                ids = sp.encode(part.column(0).to_pylist(), num_threads=1)
                n = [len(x) for x in ids]
                flat = np.fromiter((y for x in ids for y in x), np.int64, sum(n))
                total += np.bincount(flat, np.repeat(c, n), minlength=len(names)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

    return words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def expected_pieces(words: DataFrame, names: list[str], logp: np.ndarray) -> DataFrame:
    """(piece, n): expected counts of the pieces over all segmentations of the training words; a row for a piece and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(names, logp), np.zeros(len(names))
        for b in batches:
            lattice.log_probabilities(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

    return words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))


def log_probabilities(counts: dict[int, float], pieces: int, ends: int) -> tuple[np.ndarray, float]:
    """Natural logarithms of the pieces' probabilities and of the end symbol's, half a count added to each."""
    n = np.array([counts.get(i, 0) for i in range(pieces)], float)
    whole = n.sum() + ends + 0.5 * (pieces + 1)
    return np.log((n + 0.5) / whole), math.log((ends + 0.5) / whole)


def score_documents(spark: SparkSession, docs: DataFrame, vocabulary_path: str | None = None, head: int = HEAD, rounds: int = 1) -> DataFrame:
    """One row for each document: token counts, smoothed unigram score and lattice score."""
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("piece_bpe_32k.model")
    stash = Stash(spark)
    counted = count_words(docs).groupBy("hash").agg(F.min("word").alias("word"), F.sum("c").alias("c"))
    words = stash.put(counted, "words", TEXTS)
    n_docs = texts(docs).select(F.sum(F.expr(_TRAINING).cast("long"))).first()[0] or 0
    n, v = words.select(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    n, v = (n or 0) + n_docs, (v or 0) + (n_docs > 0)
    norm = n + 0.5 * (v + 1)

    # As many rows as the vocabulary has pieces: a fixed bound.
    _, names = _vocabulary(vocabulary_path)
    logp, end_lm = log_probabilities({r["piece"]: r["n"] for r in count_pieces(words, vocabulary_path).collect()}, len(names), n_docs)
    for _ in range(rounds):
        expected = {r["piece"]: r["n"] for r in expected_pieces(words, names, logp).collect()}
        logp, end_lm = log_probabilities(expected, len(names), n_docs)
    end_lm /= math.log(10)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(names, logp)
        for b in batches:
            lm = pa.array(lattice.log_probabilities(b.column(1).to_pylist()) / math.log(10))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), lm], names=["hash", "c", "lm"])

    scores = stash.put(words.mapInArrow(scored, "hash long, c long, lm double"), "scores")
    stash.drop(words)
    top = scores.orderBy(F.desc("c"), "hash").limit(head).toArrow()
    order = np.argsort(top["hash"].to_numpy().view(np.uint64))
    broadcast = spark.sparkContext.broadcast(
        (top["hash"].to_numpy().view(np.uint64)[order], top["c"].to_numpy()[order], top["lm"].to_numpy()[order])
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, c, lm = broadcast.value
        base = np.log10((c + 0.5) / norm)
        row_id = TaskContext.get().partitionId() << 40
        for b in batches:
            for row, data, offsets in pieces_of(b.column(1)):
                _, _, h, first = words_in(data, offsets)
                m = len(first) - 1
                doc = np.repeat(np.arange(m), np.diff(first))
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                k, d = at[hit], doc[hit]
                sums = [np.bincount(d, w, minlength=m) for w in ((c[k] > 0), base[k], lm[k])]
                rest, n_rest = np.unique(np.stack([doc[~hit].astype(np.uint64), h[~hit]]), axis=1, return_counts=True) if not hit.all() else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
                z = len(n_rest)
                pad = lambda x, t: pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x, t), pa.nulls(z, t)])
                rows = row_id + np.arange(m)
                row_id += m
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([rows, rows[rest[0].astype(np.int64)]])), pad(b.column(0).slice(row, m), pa.int64()),
                        pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(rest[1].view(np.int64))]),
                        pa.array(np.concatenate([np.diff(first), n_rest])),
                        pad(sums[0].astype(np.int64), pa.int64()), pad(sums[1], pa.float64()), pad(sums[2], pa.float64()),
                    ],
                    names=["row", "doc_id", "hash", "n", "n_known", "base_score", "score"],
                )

    # Row numbers hold within this one table.
    schema = "row long, doc_id long, hash long, n long, n_known long, base_score double, score double"
    cut = stash.put(texts(docs).mapInArrow(documents, schema), "cut", TEXTS)
    tail = (
        cut.where("hash IS NOT NULL").select("row", "hash", "n").join(scores, "hash")
        .select(
            "row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n"), F.expr("if(c > 0, n, 0)").alias("n_known"),
            (F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(norm))).alias("base_score"), (F.col("n") * F.col("lm")).alias("score"),
        )
    )
    whole = cut.where("hash IS NULL").drop("hash").unionByName(tail)
    end_base = math.log10((n_docs + 0.5) / norm)
    summed = whole.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        (F.sum("n") + 1).alias("n_tokens"),
        (F.sum("n_known") + F.lit(int(n_docs > 0))).alias("n_known"),
        (F.sum("base_score") + F.lit(end_base)).alias("base_score"),
        (F.sum("score") + F.lit(end_lm)).alias("score"),
    )
    return summed.select(
        "doc_id", (~F.expr(_TRAINING)).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )
