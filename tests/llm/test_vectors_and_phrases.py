"""Top-k search, vector codes and collocations, against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindery.llm import codes, collocations, nearest

R = np.random.default_rng(11)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    clash = {c: F.lit(1) for c in ("v", "cls", "rid", "q", "n", "code", "error", "first", "score", "own")}
    return df.withColumns(clash).repartition(3)


def integers(e):
    if e is None or any(x is None or not math.isfinite(x) for x in e):
        return None
    return [math.floor(256 * float(np.float32(x))) for x in e]


@pytest.fixture(scope="module")
def rows():
    base = R.normal(size=(6, 32)) * 0.2
    near = [(int(i), [float(x) for x in base[i % 6] + R.normal(size=32) * 0.05], int(i % 3)) for i in range(300)]
    copies = [(int(300 + i), near[7][1], None) for i in range(120)]
    odd = [
        (1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan")] * 32, 1), (1003, [float("inf")] + [0.0] * 31, 2),
        (1050, [0.5, -0.25], 2), (1100, [], 0), (1150, [0.0] * 32, 0), (50, [1.0] * 32, 1), (50, [1.0] * 32, 1), (None, [1.0] * 32, None),
    ]
    return near + copies + odd


def best_of_all(rows, k=5):
    kept = [(i, v) for i, e, _ in rows if (v := integers(e)) is not None]
    out = []
    for a, (i, v) in enumerate(kept):
        if i is None or i % 50:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), j is None, j or 0) for b, (j, w) in enumerate(kept) if b != a]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


@pytest.mark.parametrize("block, chunk", [(1024, 24 << 20), (16, 1024)])
def test_top_k_equals_brute_force(spark, rows, monkeypatch, block, chunk):
    """Copies, short vectors, zeros, repeated and null ids; with small blocks, many bounds and chunks are at work."""
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "CHUNK_BYTES", chunk)
    df = nearest.exact_top_k(spark, vectors(spark, rows))
    assert dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert found(df) == best_of_all(rows)


def test_top_k_of_few_and_none(spark):
    few = [(0, [1.0, 2.0], 0), (3, [1.0, 1.0], 0), (50, [-1.0, 0.0], 0)]
    assert found(nearest.exact_top_k(spark, vectors(spark, few))) == best_of_all(few)
    assert found(nearest.exact_top_k(spark, vectors(spark, []))) == []
    assert found(nearest.exact_top_k(spark, vectors(spark, [(1, [1.0], 0)]))) == []


def test_top_k_of_huge_components(spark):
    huge = [(0, [3e30, 1.0], 0), (1, [1e10, 5e9], 0), (2, [-2e12, 1.0], 0), (50, [1.5e10, 1.0], 0)]
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    v = {i: [clip(math.floor(256 * float(np.float32(x)))) for x in e] for i, e, _ in huge}
    want = []
    for q in (0, 50):
        order = sorted((-clip(sum(x * y for x, y in zip(v[q], v[i]))), i) for i in v if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(order)]
    assert found(nearest.exact_top_k(spark, vectors(spark, huge))) == sorted(want, key=str)


def test_bounds_hold_and_exclude():
    """No pair at or above the asked score is lost, and fewer pairs than all are scored."""
    x = (R.normal(size=(4, 64))[R.integers(0, 4, 500)] * 60 + R.normal(size=(500, 64)) * 8).astype(np.int64)
    scores = nearest.inner(x[:40], x)
    least = np.sort(scores, 1)[:, -6]
    q, row, score = nearest.survivors(nearest.Queries(x[:40], least), x)
    want = {(a, b) for a, b in zip(*np.nonzero(scores >= least[:, None]))}
    assert {(int(a), int(b)) for a, b in zip(q, row)} == want and (score == scores[q, row]).all()
    for s in nearest.LEVELS:
        assert (nearest.statistics(x, s)[:40] @ nearest.statistics(x, s).T >= scores - 1e-3).all()


# --- vector codes --------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, lb) for i, e, lb in rows if (v := integers(e)) is not None]
    width = -(-max([1, *(len(v) for _, v, _ in kept)]) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), lb) for i, v, lb in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    size = width // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest_of = lambda v, p: min((far(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        got = [[nearest_of(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), g in zip(kept, got) if g[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out, errors = [], collections.Counter()
    for i, v, lb in kept:
        ds = [nearest_of(v, p) for p in range(parts)]
        error = sum(d for d, _ in ds)
        errors[lb] += error
        out.append((i, "".join(f"{e:02x}" for _, e in ds), error, lb))
    flat = ",".join(str(x) for b in books for c in b for x in c)
    import hashlib

    return sorted(((i, c, e, errors[lb], hashlib.sha256(flat.encode()).hexdigest()) for i, c, e, lb in out), key=str)


def test_codes_equal_plain_lloyd(spark, rows):
    got = codes.coded(spark, vectors(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_codes(rows)


def test_codes_of_few_and_none(spark):
    few = [(5, [1.0] * 20, 1), (4, [2.0] * 3, None), (4, [1.0] * 20, None)]
    assert sorted((tuple(r) for r in codes.coded(spark, vectors(spark, few)).collect()), key=str) == plain_codes(few)
    assert codes.coded(spark, vectors(spark, [(1, None, 1)])).collect() == []


def test_groups_are_skipped_and_ties_kept():
    """Rounds by bounds give what full scans give, with fewer distances."""
    x = (R.normal(size=(64, 4))[R.integers(0, 64, 3000)] * 100 + R.normal(size=(3000, 4)) * 4).astype(np.int64)
    x[200:400] = (x[0] + x[1]) // 2  # equal parts, between two entries
    books = x[:64].copy()
    groups = codes.grouped(books)
    at, d, low, full = codes.assign(x, books, groups, None, None, None)
    for _ in range(4):
        new = books.copy()
        for e in range(64):
            if (at == e).any():
                new[e] = x[at == e].sum(0) // (at == e).sum()
        moved = np.sqrt(((new - books).astype(float) ** 2).sum(1))
        books = new
        at, d, low, scanned = codes.assign(x, books, groups, at, np.nextafter(low.astype(np.float32), np.float32(-np.inf)).astype(float), moved)
        every = ((x[:, None] - books[None]) ** 2).sum(2)
        assert (at == every.argmin(1)).all() and (d == every.min(1)).all()
    assert scanned < full / 2


# --- collocations --------------------------------------------------------------------------------------------------

LOW = {c: c + 32 for c in range(65, 91)}


def plain_collocations(rows, least, kept=2000, longest=5):
    n, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    f = {x: a for x, a in f.items() if a >= least}
    held = set()
    for (lang, w), a in f.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if a >= f[lang, w[i : i + k]]:
                    held.add((lang, w[i : i + k]))
    out = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) >= 2 and (lang, w) not in held:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:kept]))


@pytest.fixture(scope="module")
def phrases():
    r = random.Random(3)
    words = ["ab", "a", "b", "été", "x y", "Zz", "中文", "\x01", "c-d", "e'f"]
    make = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " \r\n ", "\x0b"]) for _ in range(n))
    texts = [(r.choice(["en", "fr", None, "und"]), make(r.randint(0, 60))) for _ in range(200)]
    return texts + [("en", None), ("en", ""), (None, " \n., "), ("en", "a b " * 3000), ("fr", "only once here"), ("en", "x" * 100_000), ("fr", "a a a a a a a.")]


@pytest.mark.parametrize("held, slots, size", [(1 << 22, 1 << 20, 6 << 20), (2000, 600, 8000)])
def test_collocations_equal_brute_force(spark, phrases, monkeypatch, held, slots, size):
    """With small bounds, counts are handed on in parts and phrases are counted by many passes and automata."""
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "SLOTS", slots)
    monkeypatch.setattr(collocations, "PASS_BYTES", size)
    df = spark.createDataFrame(phrases, "lang string, text string").withColumns({c: F.lit(1) for c in ("n", "a", "phrase", "pid", "words", "slot")}).repartition(3)
    got = collocations.collocations(spark, df, least=20)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(phrases, 20)


def test_workers_keep_no_automata_of_other_queries(spark):
    """Worker processes are used again; two runs over different texts in a row each count their own phrases."""
    for word in ("x", "y", "x"):
        rows = [("en", f"{word} b {word} c. {word} d" * 5)] * 8
        df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
        assert sorted(tuple(r) for r in collocations.collocations(spark, df, least=20).collect()) == plain_collocations(rows, 20)


def test_texts_are_read_as_often_however_many_phrases_are_frequent(spark, phrases, monkeypatch):
    """For their size, for the slots and for the counts; a task that can hold few phrases hands on more often."""
    monkeypatch.setattr(collocations, "PASS_BYTES", 1000)
    rows = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    df = spark.createDataFrame(phrases, "lang string, text string").repartition(3).mapInArrow(read, "lang string, text string")
    got = collocations.collocations(spark, df, least=20)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(phrases, 20)
    assert rows.value == 3 * len(phrases)


@pytest.mark.parametrize("bits", [1 << 29, 1 << 12])
def test_slots_are_looked_up_exactly(monkeypatch, bits):
    """By a bit of each slot, and by bits that many slots share."""
    monkeypatch.setattr(collocations, "_BITS", bits)
    slots, all_slots = np.unique(R.integers(0, 1 << 17, 3000)).astype(np.uint64), np.arange(1 << 17, dtype=np.uint64)
    assert (collocations._looked_up(slots, 1 << 17)(all_slots) == np.isin(all_slots, slots)).all()
    assert not collocations._looked_up(slots, 1 << 17)(all_slots[:0]).any()


def test_batches_without_words_and_phrases_of_one_batch(spark):
    """Each row is a batch of its own: empty texts, signs only, runs of spaces, phrases that end and begin in several places."""
    rows = [("a", ""), ("a", " \t "), ("b", ".,;"), ("b", None), (None, "x")] + [("a", "x  y\t z x y.z  x y z"), ("b", "y z x y z w y z")] * 9
    df = spark.createDataFrame(rows, "lang string, text string").repartition(len(rows))
    assert sorted(tuple(r) for r in collocations.collocations(spark, df, least=5).collect()) == plain_collocations(rows, 5)


def test_collocations_limits_and_empty_tables(spark, phrases):
    df = spark.createDataFrame(phrases, "lang string, text string")
    assert sorted(tuple(r) for r in collocations.collocations(spark, df, least=20, kept=3).collect()) == plain_collocations(phrases, 20, 3)
    assert collocations.collocations(spark, df.limit(0)).collect() == []
    assert collocations.collocations(spark, df.where("text IS NULL")).collect() == []


def test_scores_pass_64_bits(spark):
    """Counts of millions of millions keep their exact quotient."""
    df = spark.sql("SELECT CAST(9000000000001 AS DECIMAL(20,0)) AS a, CAST(9000000000003 AS DECIMAL(20,0)) AS n")
    got = df.selectExpr("CAST(a * CAST(1000 AS DECIMAL(4,0)) * n AS DECIMAL(38,0)) div CAST(a * a AS DECIMAL(38,0)) AS s").first()["s"]
    assert got == 1000 * 9000000000001 * 9000000000003 // 9000000000001**2
