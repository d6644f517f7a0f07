"""Operators that compare documents, against brute force."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from bindery.llm import decontam, jaccard, linededup, lm, packing, suffix

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}
R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefgé") for _ in range(R.randint(1, 6))) for _ in range(400)]


def prose(n, r=R):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, rate, r=R):
    return " ".join(r.choice(VOCABULARY) if r.random() < rate else w for w in text.split(" "))


EDGES = [None, "", " \n\t", "one", "one two three", "ONE two three", "Same five words in here", "x" * 3000]


@pytest.fixture(scope="module")
def copies():
    base = [prose(n) for n in (30, 60, 120, 300, 40)]
    texts = EDGES + [edited(R.choice(base), R.choice([0, 0.005, 0.02, 0.05])) for _ in range(90)] + [prose(R.randint(5, 80)) for _ in range(30)]
    return texts + [edited(base[2], 0.02) for _ in range(60)]


def linked(texts):
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("group", [32, 2])
def test_jaccard_components(spark, documents, copies, monkeypatch, group):
    """With tiny groups, the comparison of crowded groups in blocks takes over."""
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "SIDE", 512 if group == 32 else 7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(spark, documents(copies)).collect()}
    assert [got[i] for i in range(len(copies))] == linked(copies)


def test_sketches_bound_differences():
    rng = np.random.default_rng(1)
    for _ in range(50):
        common, a, b = (rng.integers(1, 2**63, n, dtype=np.uint64) for n in (200, 15, 9))
        x, y = np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))
        far = np.bitwise_count(np.frombuffer(jaccard.sketch(x), np.uint64) ^ np.frombuffer(jaccard.sketch(y), np.uint64)).sum()
        assert far <= 24
        assert len(np.intersect1d(jaccard.part_keys(x), jaccard.part_keys(y))) >= 1


def test_slack_holds_in_both_bands():
    """Small sets can have fewer parts to spare in the band above their own."""
    rng, fewer = np.random.default_rng(3), 0
    for n in [7] * 300 + list(range(4, 16)) * 20:
        s = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        got = jaccard.slack(s)
        assert got == [len(set((s % np.uint64(jaccard.parts_of(b))).tolist())) - jaccard.most_differing(n, b) for b in jaccard.bands(n)]
        fewer += min(got) < got[0]
    assert fewer


def test_templates_of_few_shingles(spark, documents, monkeypatch):
    """Texts of 7 to 15 shingles made of one template, all parts hot."""
    monkeypatch.setattr(jaccard, "GROUP", 2)
    monkeypatch.setattr(jaccard, "SIDE", 7)
    r = random.Random(11)
    base = [prose(n, r) for n in (19, 17, 15, 13, 12, 11)]
    texts = [f"{b} {prose(k, r)}".strip() for b in base for k in (0, 1, 1, 1, 2, 2, 3)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.link_documents(spark, documents(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == linked(texts)


def test_one_of_each_keeps_columns(spark, documents, copies):
    df = documents(copies[:40])
    out = jaccard.one_of_each(spark, df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [i for i, (_, c) in enumerate(linked(copies[:40])) if c == i]


def test_lines(spark, documents):
    base = [prose(n) for n in (6, 12, 25, 60)]
    texts = EDGES + ["\n".join(edited(R.choice(base), R.choice([0, 0.03, 0.1])) if R.random() < 0.7 else prose(R.randint(1, 9)) for _ in range(R.randint(1, 5))) for _ in range(60)]
    seen, want = [], []
    for t in texts:
        kept, gone = [], 0
        for line in (t or "").split("\n"):
            s = set(WORDS.findall(line))
            if s and any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                gone += 1
            else:
                kept.append(line)
            if s:
                seen.append(s)
        want.append(("\n".join(kept), gone))
    got = {r.doc_id: (r.kept_text, r.n_removed) for r in linededup.dedup_lines(spark, documents(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_short_lines(spark, documents):
    """Every line with a word takes part, down to one word; four words are like the same four and one more."""
    short = ["All rights reserved", "The The The", "a", "a b", "a b c", "a b c d", "a b c d e", "b c d e", "词词词", " \t", ""]
    r = random.Random(7)
    texts = EDGES + ["\n".join(r.choice(short) if r.random() < 0.6 else prose(r.randint(1, 6), r) for _ in range(r.randint(1, 4))) for _ in range(60)]
    seen, want = [], []
    for t in texts:
        kept = []
        for line in (t or "").split("\n"):
            s = set(WORDS.findall(line))
            if not s or not any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
        want.append("\n".join(kept))
    got = {r.doc_id: r.kept_text for r in linededup.dedup_lines(spark, documents(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    out = {r.doc_id: r.text for r in linededup.cleaned_documents(spark, documents(texts)).collect()}
    assert {i: (t or "").strip() for i, t in out.items() if (t or "").strip()} == {i: w.strip() for i, w in enumerate(want) if w.strip()}


@pytest.mark.parametrize("hot", [1 << 12, 1])
def test_hot_words_and_crowds_of_lines(spark, documents, monkeypatch, hot):
    """Near copies of few templates; with a low limit, every word that occurs twice meets in pairs only."""
    monkeypatch.setattr(linededup, "HOT", hot)
    monkeypatch.setattr(linededup, "WIDE", 20)
    r = random.Random(23)
    base = [prose(n, r) for n in (8, 15, 30, 30)]
    texts = ["\n".join(edited(r.choice(base), r.choice([0.02, 0.06, 0.12]), r) for _ in range(3)) for _ in range(80)]
    seen, want = [], []
    for t in texts:
        gone = 0
        for line in t.split("\n"):
            s = set(WORDS.findall(line))
            gone += any(5 * len(s & o) >= 4 * len(s | o) for o in seen)
            seen.append(s)
        want.append(gone)
    got = {x.doc_id: x.n_removed for x in linededup.dedup_lines(spark, documents(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_frequent_words_make_few_rows_and_several_passes(spark, documents, monkeypatch):
    """Counters grow with the words, two hot words of a prefix make one row, and passes over the keys change nothing."""
    from pyspark.sql import functions as F

    from bindery.llm.common import keyed

    r = random.Random(31)
    base = [prose(n, r) for n in (12, 25, 40)]
    texts = ["\n".join(edited(r.choice(base), r.choice([0.02, 0.06, 0.12]), r) for _ in range(3)) for _ in range(40)]
    plain = sorted((x.doc_id, x.kept_text, x.n_removed) for x in linededup.dedup_lines(spark, documents(texts)).collect())
    hashed = linededup.hashed_lines(keyed(documents(texts)))
    monkeypatch.setattr(linededup, "BUCKETS", 64)
    monkeypatch.setattr(linededup, "CROWD", 2)
    assert len(linededup.word_levels(hashed)) > hashed.agg(F.sum(F.size("h"))).first()[0] / 2
    monkeypatch.setattr(linededup, "HOT", 1)
    monkeypatch.setattr(linededup, "PASS_ROWS", 2)
    classes = linededup.line_sets(hashed, linededup.word_levels(hashed)).where("prefix IS NOT NULL").withColumns({"cid": F.xxhash64("did", "line"), "open": F.col("did")})
    made = linededup._prefix_words(classes).groupBy("cid", "np").agg(F.count("*").alias("rows"))
    most = classes.select("cid", (F.size("prefix") - 1).alias("p")).join(made, "cid").groupBy("cid", "p").agg(F.sum("rows").alias("rows"))
    assert most.where("rows > p * (p + 1)").count() == 0  # in two bands of sizes at most
    assert linededup._passes(classes) > 1
    assert sorted((x.doc_id, x.kept_text, x.n_removed) for x in linededup.dedup_lines(spark, documents(texts)).collect()) == plain


def test_like_lines_of_one_document_meet_two_centres(spark):
    """A table or a log of one document: pairs in proportion to its lines, and the result of the brute force."""
    from pyspark.sql import functions as F

    from bindery.llm.common import Stash, keyed

    made = {}
    for n in (500, 2000):
        text = "\n".join(" ".join(f"w{j}" for j in range(30)) + f" row{i} a{i * 7}" for i in range(n))
        docs = keyed(spark.createDataFrame([(1, text)], "doc_id long, text string"))
        hashed = linededup.hashed_lines(docs)
        lines = linededup.line_sets(hashed, linededup.word_levels(hashed)).where("n > 0")
        classes = lines.withColumns({"cid": F.xxhash64("line"), "open": F.col("did")})
        made[n] = linededup._star(Stash(spark).put(classes, "classes")).count()
    assert made[500] <= 3 * 500 * linededup.STAR and made[2000] <= 4.5 * made[500]


def test_removed_lines_count_within_their_document(spark, monkeypatch):
    """A line is like an earlier one of its document, which is removed itself and was the first of the two to be found. Without the
    centres of crowds, which matter for the effort only."""
    star = linededup._star
    monkeypatch.setattr(linededup, "_star", lambda classes: star(classes).where("a IS NULL"))
    first, second, other = [], [], []
    for t in range(40):
        w = [f"t{t}w{i}" for i in range(20)]
        a, b, p, q, u = (f"t{t}{c}" for c in "abpqu")
        first.append(" ".join([*w[:17], w[18], a, b]))
        second += [" ".join([*w[:19], u]), " ".join([*w[:18], p, q])]  # like the one above, and like the one before but not the first
        other.append(" ".join([a, b, p, q, w[17]]))
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate((first, second, other))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in linededup.dedup_lines(spark, df).collect()} == {0: 0, 1: 80, 2: 0}


def test_larger_sets_look_for_smaller_ones_by_few_words(spark, documents):
    """Words by which a class is met are fewer than those by which it meets others."""
    from pyspark.sql import functions as F

    from bindery.llm.common import keyed

    r = random.Random(41)
    hashed = linededup.hashed_lines(keyed(documents([prose(n, r) for n in range(4, 104)])))
    classes = linededup.line_sets(hashed, linededup.word_levels(hashed)).where("prefix IS NOT NULL").withColumns({"cid": F.xxhash64("did", "line"), "open": F.col("did")})
    made = {index: linededup._prefix_words(classes, index) for index in (True, False)}
    most = lambda part: sum(n - -(-part * n // (part + 1)) + 1 for n in range(4, 104))
    assert made[True].count() <= most(8) and made[False].count() <= 2 * most(4)


def test_lines_of_repeated_rows(spark):
    """Equal rows are one document; rows of one doc_id with different texts are two, a null doc_id comes first."""
    rows = [(1, "a b c\nd e f"), (1, "a b c\nd e f"), (1, "g h i"), (2, "g h i\nnew words"), (None, "d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.kept_text) for r in linededup.dedup_lines(spark, df).collect())
    assert got == [(0, "d e f"), (1, "a b c"), (1, "a b c"), (1, "g h i"), (2, "new words")]
    clash = df.selectExpr("doc_id", "text", "1 _kept", "2 _gone", "3 did", "4 rid", "5 gone", "6 kept", "7 row")
    out = linededup.cleaned_documents(spark, clash)
    assert out.columns == clash.columns and sorted(r.text for r in out.collect()) == sorted(x[1] for x in got)


def test_decontamination(spark, documents):
    items = [prose(12), prose(25), "short item", "", None, prose(10), "Ünï çødé"]
    texts = EDGES + [prose(8) + " " + " ".join((R.choice(items) or "").split(" ")[R.randint(0, 4) :]).upper() + ", " + prose(5) for _ in range(60)] + ["a SHORT-item!", "x ünï çødé y"]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate(LOW))
    windows = collections.defaultdict(set)
    for i, t in enumerate(items):
        w = cut(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add(i)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for r in decontam.decontaminate(spark, documents(texts), bench).collect():
        w, hit, found = cut(texts[r.doc_id]), set(), set()
        for g, owners in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), digest, bool(hit))


def test_decontamination_of_repeated_rows(spark):
    """Equal rows share their result, rows of one doc_id with different texts don't; null ids are documents as well."""
    item = "one two three four five six seven eight nine ten"
    rows = [(1, "x " + item), (1, "x " + item), (1, "clean"), (None, item), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("b", item), ("a", item)], "item_id string, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontam.decontaminate(spark, df, bench).collect())
    assert got == [(0, 10, 10, 2), (1, 1, 0, 0), (1, 11, 10, 2), (1, 11, 10, 2), (2, 0, 0, 0)]
    clash = df.selectExpr("*", "1 did", "2 rid", "3 row", "4 _bad_id", "5 w")
    out = decontam.clean_documents(spark, clash, bench)
    assert out.columns == clash.columns and sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "clean"), (2, None)]


def test_decontamination_without_items(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontam.decontaminate(spark, documents(EDGES), none).collect())


ODD = ["İstanbul ΑΣ ΟΔΟΣ. straße", "é café, naïve!!", "it's we'll 12,345 3.14", "日本語 テキスト", "a b c", "<|endoftext|> x<|startoftext|>", "say <|endoftext|> now", "a<|endoftext|>b<|endof text|>!", "ǅ ﬁ Å", "tab\tand\r\nline\x0bfeed", "a\x1cb", "🙂🙂 ok"]


def test_packing(spark, documents, copies):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = copies[:60] + ODD + [prose(3000)]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(spark, documents(texts)).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length])), t
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, rows in by_sequence.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or k == len(by_sequence) - 1 and at < 2048


def test_tokenizer_looks_up_each_chunk_of_a_batch_once():
    """However often a chunk stands in the texts of a batch; the ids are those of the whole tokenizer, also from a cache that is emptied."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), packing.ChunkTokenizer(path, room=0)
    texts = [*ODD, "", "  \n\t ", "one two\x0btwo " * 200, prose(50)]
    looked = []
    for _ in range(2):
        own.clear()
        get = own.index.ids_of
        own.index.ids_of = lambda c: looked.append(c) or get(c)  # noqa: B023
        ids, sizes = own.batch(pa.array(["left out", *texts]).slice(1))
        want = [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert looked.count("two") == 2 and looked.count(None) == 2
    assert list(packing._slices(pa.array(["ab", "c" * 9, "", "d", "e" * 20]), 4)) == [(0, 1), (1, 1), (2, 2), (4, 1)]


def test_hilbert_curve_is_continuous():
    n = 8
    points = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)])
    order = points[np.argsort(packing.hilbert(points, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


class SlowLattice:
    """All segmentations by plain recursion over strings, with a byte-spelled piece for each character."""

    def __init__(self, names, p):
        self.p = {n: x for n, x in zip(names, p, strict=True) if n not in ("<unk>", "<s>", "</s>") and not n.startswith("<0x")}
        self.byte = {int(n[3:5], 16): x for n, x in zip(names, p, strict=True) if n.startswith("<0x")}

    def cuts(self, text):
        """(probability, pieces) of each segmentation."""
        if not text:
            return [(1.0, [])]
        spelled = [f"<0x{b:02X}>" for b in text[0].encode()]
        out = [(math.prod(self.byte[b] for b in text[0].encode()) * q, spelled + r) for q, r in self.cuts(text[1:])]
        for k in range(1, len(text) + 1):
            if text[:k] in self.p:
                out += [(self.p[text[:k]] * q, [text[:k], *r]) for q, r in self.cuts(text[k:])]
        return out


@pytest.mark.parametrize("head", [5, 1000])
def test_scores(spark, documents, copies, head):
    import public_tokenizers
    import sentencepiece

    texts = copies[:7] + copies[8:30]  # words of few characters, so that all segmentations can be listed
    tokens = [[*WORDS.findall((t or "").translate(LOW)), None] for t in texts]
    c = collections.Counter(w for i, t in enumerate(tokens) if lm.in_training(i) for w in t)
    n, v = sum(c.values()), len(c)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    counts = collections.Counter()
    for w, k in c.items():
        for piece in sp.encode(w, out_type=str) if w else ():
            counts[piece] += k
    for learn in (True, False):
        whole = sum(counts.values()) + c[None] + 0.5 * (len(names) + 1)
        slow = SlowLattice(names, [(counts[x] + 0.5) / whole for x in names])
        cuts = {w: slow.cuts("▁" + w) for t in tokens for w in t if w}
        if learn:
            counts = collections.Counter()
            for w, k in c.items():
                z = sum(q for q, _ in cuts[w]) if w else 0
                for q, pieces in cuts[w] if w else ():
                    for piece in pieces:
                        counts[piece] += k * q / z
    end = math.log10((c[None] + 0.5) / whole)
    for r in lm.score_documents(spark, documents(texts), head=head).collect():
        t = tokens[r.doc_id]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1, len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(base)
        assert r.score == pytest.approx(end + sum(math.log10(sum(q for q, _ in cuts[w])) for w in t if w), rel=1e-9)


def test_scores_of_repeated_rows(spark):
    df = spark.createDataFrame([(7, "a b"), (7, "a b"), (7, "c"), (None, "a")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in lm.score_documents(spark, df).collect())
    assert not lm.in_training(7) and got == [(0, 2, 2), (7, 2, 1), (7, 3, 2), (7, 3, 2)]


def test_lattice_sums_all_segmentations():
    names = [f"<0x{b:02X}>" for b in range(256)] + ["▁a", "▁", "a", "b", "ab", "▁ab"]
    lattice = lm.Lattice(names, np.log([1e-9] * 256 + [0.2, 0.1, 0.1, 0.2, 0.15, 0.05]))
    assert np.exp(lattice.log_probabilities(["ab"]))[0] == pytest.approx(0.05 + 0.2 * 0.2 + 0.1 * 0.15 + 0.1 * 0.1 * 0.2, rel=1e-6)


def test_long_words_are_summed_alike(monkeypatch):
    rng = random.Random(9)
    names = [f"<0x{b:02X}>" for b in range(256)] + ["▁", "▁a", "a", "b", "ab", "ba", "aab", "é"]
    lattice = lm.Lattice(names, np.log(np.random.default_rng(0).random(len(names)) / 100))
    words, counts, totals, sums = ["".join(rng.choice("abéx") for _ in range(k)) for k in (1, 2, 5, 5, 30, 63)], np.array([3, 1, 2, 1, 1, 4]), [], []
    for limit in (64, 0):
        monkeypatch.setattr(lm.Lattice, "LONG", limit)
        total = np.zeros(len(names))
        sums.append(lattice.log_probabilities(words, counts, total))
        totals.append(total)
    assert np.allclose(*sums) and np.allclose(*totals)
    # Every character, and the mark, is covered once on average.
    size = np.array([1 if x.startswith("<0x") else len(x.encode()) for x in names])
    assert (totals[0] * size).sum() == pytest.approx(sum(c * len(("▁" + w).encode()) for w, c in zip(words, counts, strict=True)))


def without_repeats(texts):
    """(n_bytes, n_removed, n_spans, digest) of each text by brute force."""
    raw, out = [(t or "").encode() for t in texts], []
    count = collections.Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(y for y, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("block", "batches"), [(64, 4), (3, 7), (64, 1)])
def test_repeated_bytes(spark, documents, monkeypatch, block, batches):
    monkeypatch.setattr(suffix, "BLOCK", block)
    r, letters = random.Random(3), "abcdefgh é\n"
    passages = ["".join(r.choice(letters) for _ in range(n)) for n in (150, 199, 200, 201, 260, 400, 900)]
    texts = []
    for _ in range(120):
        t = "".join(r.choice(letters) for _ in range(r.choice([0, 50, 150, 400])))
        for _ in range(r.choice([0, 1, 2, 3])):
            p = r.choice(passages)
            a = r.randrange(len(p))
            t += p[a : a + r.choice([100, 300, 1000])] + "".join(r.choice(letters) for _ in range(r.choice([0, 1, 30])))
        texts.append(t)
    texts += ["a" * 1000, "ab" * 400, "", None, "xyz" * 66, passages[2], passages[2] + "é", texts[5], texts[5]]
    want = without_repeats(texts)
    for x in suffix.dedup_bytes(spark, documents(texts), batches=batches).collect():
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == want[x.doc_id]


def test_repeated_bytes_of_repeated_rows(spark):
    """Rows of one doc_id with different texts are different documents, equal rows are copies."""
    r = random.Random(8)
    x, y, p, z = ("".join(r.choice("abcdefgh") for _ in range(n)) for n in (500, 900, 300, 250))
    rows = [(0, x + p), (0, y), (1, p), (2, z), (2, z), (None, z[:199]), (None, p + "!")]
    want = without_repeats([t for _, t in rows])
    got = [(r.doc_id, *r[1:]) for r in suffix.dedup_bytes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(i, *w) for (i, _), w in zip(rows, want, strict=True)], key=str)


def test_neighbours_across_ranges_and_batches():
    """Marks don't depend on how sorted rows come in batches; edges are the first and the last row."""
    import pyarrow as pa

    r = random.Random(4)
    rows = sorted((bytes([r.randrange(6)]), r.randrange(2)) for _ in range(40))
    for sizes in ([40], [1] * 40, [7, 0, 20, 13], [39, 1]):
        batches, at = [], 0
        for n in sizes:
            part = rows[at : at + n]
            at += n
            no = pa.array([False] * n)
            batches.append(pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.binary()), pa.array([x[1] for x in part], pa.int64()), no, no, no], names=["prefix", "run", "met", "twin", "edge"]))
        got = [tuple(d[c] for c in ("met", "twin", "edge")) for b in suffix._neighbours(iter(batches)) for d in b.to_pylist()]
        prefixes = [x[0] for x in rows]
        assert got == [(prefixes.count(x[0]) > 1, rows.count(x) > 1, i in (0, 39)) for i, x in enumerate(rows)]


def test_family_levels_are_sorted_and_logarithmic(spark):
    from bindery.llm.common import Stash, keyed

    r = random.Random(2)
    shared = "".join(r.choice("abcdefgh") for _ in range(400))
    family = suffix.SuffixFamily(Stash(spark), ranges=3)
    for i in range(5):
        docs = spark.createDataFrame([(10 * i + k, "".join(r.choice("abcdefgh") for _ in range(600)) + shared * (k == 0)) for k in range(4)], "doc_id long, text string")
        family.add(suffix.suffix_runs(keyed(docs), 200, 32))
        assert [n for n, _ in family.levels] == [[1], [2], [2, 1], [4], [4, 1]][i]
        # What is found so far: the suffixes of the shared passage, of every batch added.
        found = family.found().where("twin").select("did").distinct().collect()
        assert {x.did for x in found} == ({10 * k for k in range(i + 1)} if i else set())
    rows = [tuple(x) for x in family.levels[0][1].select("prefix", "run").collect()]
    assert len(rows) > 50 and {len(p) for p, _ in rows} == {32}


def test_long_texts_are_cut_without_loss(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix, "SEGMENT", 1000)
    text = "".join(random.Random(1).choice("abc ") for _ in range(5000))
    windows = []
    for _, shift, data, offsets in suffix._segments(pa.array([text]), 200):
        _, first, last, *_ = suffix.runs(data, offsets)
        windows += [w + int(shift[0]) for a, z in zip(first, last, strict=True) for w in range(a, z + 1)]
    assert sorted(windows) == list(range(4801))


def test_no_documents(spark, documents):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.link_documents(spark, none).count() == 0
    assert suffix.dedup_bytes(spark, none).count() == 0
    assert linededup.dedup_lines(spark, none).count() == 0
    assert packing.pack(spark, none).count() == 0
    assert lm.score_documents(spark, none).count() == 0
    assert decontam.decontaminate(spark, none, none.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_a_suffix_is_sorted_once_for_each_doubling(spark, documents, monkeypatch):
    """Of four batches the first is sorted alone, the second with it, the third alone, and the fourth with all."""
    from bindery.llm.common import Stash, keyed

    family, sorted_rows = suffix.SuffixFamily(Stash(spark), ranges=3), []
    scan = suffix.SuffixFamily.scan
    monkeypatch.setattr(suffix.SuffixFamily, "scan", lambda self, rows, found_only: (sorted_rows.append(rows.count()), scan(self, rows, found_only))[1])
    for i in range(4):
        family.add(suffix.suffix_runs(keyed(documents([f"{i} " + "the same words again " * 12])), 200, 32))
    one = sorted_rows[0]
    assert len(sorted_rows) == 4 and sum(sorted_rows) <= 9 * one and family.found().count() > 0
