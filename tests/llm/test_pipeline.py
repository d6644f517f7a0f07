"""The pipeline and its stages against an independent brute force, on a small table with every edge."""

import random
import re
import struct
import zlib

import pytest

LOW = {c: c + 32 for c in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BOILERPLATE = (
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "accept cookies", "enable javascript", "subscribe to our newsletter", "skip to content", "back to top",
)
MENU = "home | news | sport | jobs | about"


def line_fails(line):
    """(punctuation or navigation, boilerplate) of a line with a word."""
    marks, bars = sum(c in "#*$%&<>!?=~^{}" for c in line), line.count("|")
    return marks * 100 > len(line) * 10 or bars >= 3 and bars * 100 > len(line) * 4, any(p in line.lower() for p in BOILERPLATE)


def good_lines(docs):
    out = []
    for i, text in docs:
        text = text or ""
        words, lines = SPACED.findall(text), text.split("\n")
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        repeated = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(5)}
        judged = [(x, *line_fails(x)) for x in lines if SPACED.search(x)]
        whole = sum(len(x) for x, _, _ in judged)
        noisy, lost = sum(len(x) for x, a, _ in judged if a), sum(len(x) for x, a, b in judged if a or b)
        if len(words) >= 10 and 100 * len(repeated) <= 20 * len(words) and noisy * 100 <= whole * 50 and lost * 100 <= whole * 90:
            out.append((i, "\n".join(x for x in lines if not SPACED.search(x) or not any(line_fails(x)))))
    return out


def new_lines(docs):
    seen, out = [], []
    for i, text in sorted(docs):
        kept = []
        for line in text.split("\n"):
            s = set(SPACED.findall(line))
            if not s or not any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
        if SPACED.search("\n".join(kept)):
            out.append((i, "\n".join(kept)))
    return out


def one_of_each(docs):
    sets = []
    for _, text in docs:
        w = SPACED.findall(text.translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if near(sets[a], sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return [min(d for d, g in zip(docs, group, strict=True) if g == k) for k in sorted(set(group))]


def uncontaminated(docs, items):
    windows = set()
    for text in items:
        w = TERMS.findall((text or "").translate(LOW))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def clean(text):
        w = TERMS.findall(text.translate(LOW))
        return not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    return [(i, t) for i, t in docs if clean(t)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(31)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randint(2, 7))) for _ in range(300)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    edit = lambda t, rate: re.sub(r"\w+", lambda m: r.choice(words) if r.random() < rate else m[0], t)
    item = line(25)
    base = ["\n".join(line(r.randint(12, 30)) for _ in range(6)) for _ in range(3)]
    shared = [line(9), "one two", "All rights reserved"]
    texts = [None, "", " \n\t", "too few words", "word " * 400, line(4000)]
    for _ in range(12):
        texts.append("\n".join([line(r.randint(10, 40)), r.choice(shared), line(20)]))
    for b in base:
        texts += [b, b, edit(b, 0.01), edit(b, 0.02).replace("\n", " "), b.replace("\n", " ").upper()]
    texts += [f"{MENU}\n{line(30)}\nWOW!!!! ### NOW\n\n{line(12)}", f"{MENU}\n{MENU} | more\nshort line of words", line(15) + " " + " ".join(item.split()[5:17]).upper() + ", " + line(9), "ʼ" + line(40)]
    order = list(range(len(texts)))
    r.shuffle(order)
    rows = [(k, texts[i], "en", f"s{i % 3}", len(texts[i] or "")) for k, i in enumerate(order)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("a", item), ("b", None), ("c", "")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, [(k, t) for k, t, *_ in rows], [item, None, ""]


def test_stages_against_brute_force(spark, tables):
    import corpus_pipeline as p
    import public_tokenizers
    from bindery.llm.common import Stash, close_all
    from tokenizers import Tokenizer

    path, docs, items = tables
    assert [n for n, _ in p.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "packing"] and p.ORACLE_SQL is None
    stash, df = Stash(spark), spark.read.parquet(f"{path}/documents.parquet")
    columns = df.columns
    for (name, stage), expect in zip(p.STAGES[:-1], (good_lines, new_lines, one_of_each, lambda d: uncontaminated(d, items)), strict=True):
        df, before = stash.put(stage(spark, df, path), name), len(docs)
        docs = sorted(expect(docs))
        assert df.columns == columns
        got = sorted((r.doc_id, r.text, r.n_chars) for r in df.collect())
        assert [x[:2] for x in got] == docs, name
        assert all(n == len(t) for _, t, n in got) and 0 < len(docs) <= before
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for pieces in (p.STAGES[-1][1](spark, df, path).collect(), p.run(spark, path).collect()):
        assert {x.doc_id for x in pieces} == {i for i, _ in docs}
        for i, t in docs:
            ids, at = [*tok.encode(t, add_special_tokens=False).ids, 1], 0
            for x in sorted((x for x in pieces if x.doc_id == i), key=lambda x: x.start):
                assert (x.start, x.ids_crc32) == (at, zlib.crc32(struct.pack(f"<{x.length}I", *ids[at : at + x.length])))
                at += x.length
            assert at == len(ids)
        ends = {}
        for x in sorted(pieces, key=lambda x: (x.sequence_id, x.offset)):
            assert x.offset == ends.get(x.sequence_id, 0)
            ends[x.sequence_id] = x.offset + x.length
        assert sorted(ends) == list(range(len(ends))) and all(ends[k] == 2048 for k in range(len(ends) - 1))
    close_all()


def test_stages_on_empty_tables_and_clashing_columns(spark, tables):
    """Each stage returns the columns it got, whatever their names and however few rows there are."""
    import corpus_pipeline as p
    from pyspark.sql import functions as F

    path, docs, _ = tables
    named = ("did", "rid", "row", "gone", "kept", "cleaned", "key", "id", "w", "cls", "_bad_id", "words", "lines", "n", "base")
    df = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.lit(c) for c in named})
    none = df.limit(0)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, none, path)
        assert out.columns == df.columns and out.count() == 0, name
    assert p.STAGES[-1][1](spark, none, path).count() == 0
    for name, stage in p.STAGES[:2]:
        rows = stage(spark, df, path).select("doc_id", *named).collect()
        assert rows and all(r[c] == c for r in rows for c in named), name
