"""Phrase collocation mining (operator 13): sketched upper bounds, an automaton over words, exact counts, thresholds.

Texts are lower-cased (A-Z), split at PUNCTUATION into pieces and those at spaces and tabs into words. Every phrase of 1 to
LONGEST words of a language falls into one of `width` slots, by hash. Tasks count slots over a bounded number of phrases at a
time and hand on the counts slice by slice; a slot's sum is an upper bound of the count of each of its phrases. The width
grows with the texts, so that a slot holds about a quarter of the least count on average, while what a task holds and hands
on doesn't depend on it.

The phrases in slots that reach the least count are the states of an Aho-Corasick automaton whose letters are words. The parts
of a frequent phrase are frequent, so the states are closed under prefixes and suffixes, and whether a word leads on is one
look at the slot of the longer phrase; only these slots are given to the tasks. After each word the automaton is in the state
of the longest phrase that ends there, and no state crosses the end of a piece. A task keeps the states that its texts come to,
with their phrases, their visits and their failure links (the longest shorter state that ends there); a visit counts for
the state and, along the links, for all phrases that end with it, overlapping ones too. So the texts are read once, however
many phrases are frequent, and a task that holds too many hands on what it has. Counts are summed by phrase and those below
the least count go; all counts that the scores need are among the rest. Slots beyond SLOTS take further readings. States are
told apart by hashes of 64 bits.

Defined results: null texts are empty and a null language is `und`, one with documents that are so named. Repeated rows
count as often as they stand there. Scores are integers, computed in decimals of 38 digits; the lowest-scoring cut counts,
ties to the shortest first part. Ranks go by score and count, descending, then by the phrase's bytes. A text, however long,
is held by one task. Languages without frequent phrases give no rows, and so does an empty table; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.llm.common import TEXTS, Stash, mix, words_in

PUNCTUATION, LONGEST, LEAST, KEPT = ".,;:!?\x0a\x0b\x0c\x0d", 5, 100, 2000
#: Phrases that a task counts before it hands on what it has, and bytes of texts that it looks at at once.
HELD, AT_ONCE = 1 << 22, 1 << 21
#: Splits of the texts that a task takes which hands on phrases.
SPLITS = 8
#: Slots in a slice, the unit that is summed by one task.
SLICE = 1 << 20
#: Slots whose phrases are counted by one reading of the texts, and bits by which they are looked up.
SLOTS, _BITS = 1 << 25, 1 << 29
#: Bytes of the phrases that a task holds before it hands on their counts, and rows that it hands on at once.
PASS_BYTES, HANDED = 16 << 20, 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Places of hashes told last.
_FILTER = 1 << 22

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9] = 32
_FOLD[[ord(c) for c in PUNCTUATION]] = 10


def lang_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def folded(b: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """(lang, bytes) of the texts of a batch, a line feed between them and for punctuation; a text is never split."""
    lang, text = b.column("lang"), b.column("text").cast(pa.large_binary())
    for own in pc.unique(lang).to_pylist():
        rows, at = text.filter(pc.equal(lang, own)), 0
        ends = np.cumsum(pc.binary_length(rows).to_numpy(zero_copy_only=False))
        while at < len(rows):
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")) - at)
            yield own, _FOLD[np.frombuffer(b"\n".join(rows.slice(at, n).to_pylist()), np.uint8)]
            at += n


def phrases_in(data: np.ndarray, lang: str, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, whole, start, end) of all runs of one word, of two and so on; those that are whole are phrases of one piece."""
    starts, ends, h, _ = words_in(data, np.array([0, len(data)]))
    breaks = np.cumsum(data == 10, dtype=np.int32)[starts] if len(starts) else starts
    x = mix(h ^ np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), np.uint64))
    for n in range(1, min(longest, len(h)) + 1):
        m = len(h) - n + 1
        x = x if n == 1 else mix(x[:m] * _STEP + h[n - 1 :])
        yield x, breaks[:m] == breaks[n - 1 :], starts[:m], ends[n - 1 :]


def _slot_counts(width: int, longest: int):
    """Counts of slots, packed by slice, and each language's words, under a negative slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        words: dict[str, int] = {}
        pack = zstandard.ZstdCompressor(1).compress

        def told() -> pa.RecordBatch:
            slot, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            which = slot // np.uint64(SLICE)
            start, cells = np.flatnonzero(np.diff(which, prepend=np.uint64(width))), []
            for i, j in zip(start, np.append(start[1:], len(slot)), strict=True):
                gaps = np.diff(slot[i:j] % np.uint64(SLICE), prepend=np.uint64(0))
                both = np.concatenate([gaps.astype(np.uint32), n[i:j].astype(np.uint32)])
                cells.append(pack(both.view(np.uint8).reshape(-1, 4).T.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(which[start].astype(np.int64)), pa.array(cells, pa.binary()), pa.nulls(len(cells), pa.string())], names=["slice", "counts", "lang"])

        for b in batches:
            for lang, data in folded(b):
                for k, (h, whole, _, _) in enumerate(phrases_in(data, lang, longest)):
                    held.append(h[whole] & np.uint64(width - 1))
                    if not k:
                        words[lang] = words.get(lang, 0) + len(h)
                if sum(map(len, held)) >= HELD:
                    yield told()
        if held:
            yield told()
        sums = [np.array([n], np.int64).tobytes() for n in words.values()]
        yield pa.RecordBatch.from_arrays([pa.array([-1 - zlib.crc32(x.encode()) for x in words], pa.int64()), pa.array(sums, pa.binary()), pa.array(list(words), pa.string())], names=["slice", "counts", "lang"])

    return run


def _summed_slots(least: int):
    """Slots that reach the least count, and sums of words. A task holds the slices dealt to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        waiting: dict[int, list[np.ndarray]] = {}
        words: dict[str, int] = {}
        unpack = zstandard.ZstdDecompressor().decompress

        def add(k: int) -> None:
            both = np.concatenate(waiting.pop(k), axis=1)
            n = np.bincount(both[0], both[1], SLICE).astype(np.int64)
            total[k] = total[k] + n if k in total else n

        for b in batches:
            for k, cell, lang in zip(b.column("slice").to_pylist(), b.column("counts"), b.column("lang").to_pylist(), strict=True):
                if lang is not None:
                    words[lang] = words.get(lang, 0) + int(np.frombuffer(cell.as_buffer(), np.int64)[0])
                    continue
                both = np.ascontiguousarray(np.frombuffer(unpack(cell.as_buffer()), np.uint8).reshape(4, -1).T).view(np.uint32).reshape(2, -1)
                np.cumsum(both[0], out=both[0])
                waiting.setdefault(k, []).append(both)
                if sum(x.shape[1] for x in waiting[k]) >= SLICE:
                    add(k)
        for k in list(waiting):
            add(k)
        slots = np.concatenate([k * SLICE + np.flatnonzero(sums >= least) for k, sums in total.items()]) if total else np.zeros(0, np.int64)
        none = len(slots)
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(slots), pa.nulls(len(words), pa.int64())]), pa.array([None] * none + list(words), pa.string()), pa.array([None] * none + list(words.values()), pa.int64())],
            names=["slot", "lang", "n"],
        )

    return run


def _looked_up(slots: np.ndarray, width: int):
    """Whether slots are among the sorted ones, for arrays of them: by a bit of each slot or, if there are too many, of several."""
    mask = np.uint64(min(width, _BITS) - 1)
    bits = np.zeros(int(mask >> np.uint64(3)) + 1, np.uint8)
    place = slots & mask
    np.bitwise_or.at(bits, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))

    def run(slot: np.ndarray) -> np.ndarray:
        place = slot & mask
        out = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        if width > _BITS:
            near = np.flatnonzero(out)
            out[near] = slots[np.minimum(np.searchsorted(slots, slot[near]), len(slots) - 1)] == slot[near]
        return out

    return run


def _states(data: np.ndarray, lang: str, longest: int, frequent, width: int, chunk: int, chunks: int) -> tuple[np.ndarray, ...]:
    """Where words start and end; by number of words and last word the hashes of the states that end there, 0 where none does;
    and the words of the longest state of up to 0, 1, ... words that ends there."""
    starts, ends, hashes, below, shorter = None, None, None, None, None
    for n, (h, whole, start, end) in enumerate(phrases_in(data, lang, longest)):
        if not n:
            starts, ends, hashes, below = start, end, np.zeros((longest, len(h)), np.uint64), np.zeros((longest + 1, len(h)), np.int64)
        # Parts of a frequent phrase are frequent, so only phrases of such parts are looked up. Of parts whose slots another
        # pass has, this one knows nothing.
        at = np.flatnonzero(whole if shorter is None else whole & shorter[:-1] & shorter[1:])
        slot = h[at] & np.uint64(width - 1)
        own = slot % np.uint64(chunks) == np.uint64(chunk) if chunks > 1 else np.ones(len(at), bool)
        own[own] = frequent(slot[own])
        hit, shorter = at[own], np.zeros(len(h), bool)
        shorter[hit] = True
        if chunks > 1:
            shorter[at[slot % np.uint64(chunks) != np.uint64(chunk)]] = True
        hashes[n, hit + n] = h[hit]
    for n in range(len(below) - 1 if below is not None else 0):
        below[n + 1] = np.where(hashes[n] != 0, n + 1, below[n])
    return starts, ends, hashes, below


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.LargeStringArray:
    size = end - start
    to = np.concatenate([[0], np.cumsum(size)])
    raw = [data[np.arange(to[i], to[min(i + HANDED, len(size))]) + np.repeat((start - to[:-1])[i : i + HANDED], size[i : i + HANDED])] for i in range(0, len(size), HANDED)]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(to), pa.py_buffer(np.concatenate(raw)))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.add.reduceat(n, at)


def _counted(held, width: int, longest: int, chunk: int, chunks: int):
    """Phrases of the slots of this pass, with their counts in a task's texts or, if they are too many, in blocks of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _looked_up(held.value.astype(np.uint64), width)
        # Hashes of states told last, by their own high bits: what is pushed out is told again, which does no harm.
        last = np.zeros(_FILTER, np.uint64)
        langs: list[str] = []
        visits: list[tuple[np.ndarray, np.ndarray]] = []
        told: list[tuple] = []
        size = 0
        place = lambda x: x >> np.uint64(40) & np.uint64(_FILTER - 1)

        def visit(lang: str, data: np.ndarray) -> int:
            """Counts the states that the automaton comes to, and tells new ones with their failure links; bytes of their phrases."""
            kept = np.ones(len(data), bool)
            kept[1:] = (data[1:] != 32) | (data[:-1] != 32)
            data = data[kept]
            starts, ends, hashes, below = _states(data, lang, longest, frequent, width, chunk, chunks)
            if starts is None:
                return 0
            at, new = np.flatnonzero(below[-1]), 0
            words = below[-1, at]
            x = hashes[words - 1, at]
            visits.append(np.unique(x, return_counts=True))
            if lang not in langs:
                langs.append(lang)
            while True:
                fresh = np.flatnonzero(last[place(x)] != x)
                if not len(fresh):
                    return new
                x, i = np.unique(x[fresh], return_index=True)
                at, words = at[fresh[i]], words[fresh[i]]
                last[place(x)] = x
                next_words = below[words - 1, at]
                linked = next_words > 0
                link = np.where(linked, hashes[next_words - 1, at], np.uint64(0))
                phrase = _cut(data, starts[at - words + 1], ends[at])
                told.append((x, link, words.astype(np.int8), np.full(len(x), langs.index(lang), np.int32), phrase))
                new += len(phrase.buffers()[2])
                x, at, words = link[linked], at[linked], next_words[linked]

        def counts() -> Iterator[pa.RecordBatch]:
            """A state's visits count for it and along its failure links, which are followed from the longest phrases on."""
            if told:
                x, link, words, lang = (np.concatenate(c) for c in list(zip(*told, strict=True))[:4])
                x, i = np.unique(x, return_index=True)
                link, words, lang, phrase = link[i], words[i], lang[i], pa.concat_arrays([t[4] for t in told])
                told.clear()
                n = np.zeros(len(x), np.int64)
                came, times = _summed(*zip(*visits, strict=True))
                visits.clear()
                n[np.searchsorted(x, came)] = times
                for k in range(longest, 1, -1):
                    at = np.flatnonzero((words == k) & (link != 0))
                    np.add.at(n, np.searchsorted(x, link[at]), n[at])
                name = pa.array(langs).take(pa.array(lang))
                for k in range(0, len(x), HANDED):
                    own = phrase.take(pa.array(i[k : k + HANDED])).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([name[k : k + HANDED], own, pa.array(n[k : k + HANDED])], names=["lang", "phrase", "n"])
            last.fill(0)
            langs.clear()
            visits.clear()

        for b in batches:
            for lang, data in folded(b):
                size += visit(lang, data)
                if sum(len(x) for x, _ in visits) > HELD:
                    visits[:] = [_summed(*zip(*visits, strict=True))]
                if size >= PASS_BYTES or len(visits) == 1 and len(visits[0][0]) > HELD // 2:
                    yield from counts()
                    size = 0
        yield from counts()

    return run


def phrase_counts(spark: SparkSession, docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of all phrases of up to `longest` words found `least` times or more, and (lang, n), all words."""
    stash, texts = Stash(spark), lang_texts(docs)
    # A word and its separator take six bytes or more of nearly all texts; shorter ones only fill the slots more.
    words = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    width = 1 << max(16, (4 * longest * words // least).bit_length())
    counts = texts.mapInArrow(_slot_counts(width, longest), "slice long, counts binary, lang string").repartition(max(1, width // SLICE // 4), "slice")
    sums = stash.put(counts.mapInArrow(_summed_slots(least), "slot long, lang string, n long"), "sums", TEXTS)
    slots, totals = sums.where("slot IS NOT NULL").select("slot"), sums.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    chunks = -(-slots.count() // SLOTS)
    # A task hands on a row for each phrase that it meets, so it takes several splits of the texts, if enough tasks are left
    # for all cores.
    texts = texts.coalesce(max(2 * spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions() // SPLITS))
    out = None
    for i in range(chunks):
        own = slots.where(F.col("slot") % chunks == i).toArrow()["slot"].to_numpy()
        held = spark.sparkContext.broadcast(np.sort(own).astype(np.uint32 if width <= 1 << 32 else np.uint64))
        found = texts.mapInArrow(_counted(held, width, longest, i, chunks), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
        found = found.where(F.col("a") >= least).select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "a")
        found = stash.put(found, "found", TEXTS)
        held.unpersist()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "lang string, phrase string, words int, a long") if out is None else out, totals


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, kept: int = KEPT, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of two words or more."""
    found, totals = phrase_counts(spark, docs, least, longest)
    parts = F.split("phrase", " ")
    longer = found.where("words >= 2").withColumn("w", parts)
    # (start, length) of the phrases of two words or more within one of three or more.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    held = longer.where("words >= 3").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("most")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    free = longer.join(held, ["lang", "phrase"], "left").where("most IS NULL OR most < a").drop("most")
    at = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cut = free.withColumn("k", at).withColumns({"head": F.array_join(F.expr("slice(w, 1, k)"), " "), "tail": F.array_join(F.expr("slice(w, k + 1, words - k)"), " ")})
    part = lambda name, of: found.select("lang", F.col("phrase").alias(of), F.col("a").alias(name))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    both = cut.join(part("l", "head"), ["lang", "head"]).join(part("r", "tail"), ["lang", "tail"]).join(totals, "lang")
    scored = both.withColumns({"top": (big("a") * F.lit(1000).cast("decimal(4,0)") * big("n")).cast("decimal(38,0)"), "under": (big("l") * big("r")).cast("decimal(38,0)")})
    scored = scored.withColumn("score", F.expr("top div under"))
    least_cut = F.min(F.struct("score", "k", "l", "r")).alias("m")
    best = scored.groupBy("lang", "phrase", "a", "n").agg(least_cut).select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), "n", F.col("m.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= kept)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
