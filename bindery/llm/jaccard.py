"""N-gram Jaccard join (operator 3): parity sketches, joined part by part within size bands, then verified.

A document's set is its distinct five-word shingles. Two sets of a and b shingles are linked if their Jaccard
similarity is 0.8 or more, so at most (a + b) / 9 shingles stand in one of them only. Every shingle toggles one bit
of a sketch; the Hamming distance of two sketches can't exceed the number of shingles in one set only. The sketch of
a band (sizes from 2**(j-1) up to 2**j, and partners down to 0.8 of that) has m parts of 2**32 bits, kept sparse as
the XOR of hashed bit positions. With at most d differing shingles, m - d parts agree; a document with more than d
non-empty parts agrees in one of those, so empty parts are joined only between documents that have too few.

Equal sets are one class from the start, known by a 64-bit signature. Classes that share a part are compared first with
one class of the group, and what is linked becomes one component; only pairs between different components are compared
after that. Groups of GROUP classes or fewer are joined. Classes that could agree in parts of larger groups alone form
crowds; there, those outside a crowd's largest component are compared with all others, in blocks of SIDE by SIDE on
sketches of 1024 bits, first with the nearest of another component, in the end with all that are near enough. So no group
of copies is expanded into all its pairs, and no link between different components is lost. The cost of a crowd is its
size times the number of classes that its largest component leaves out.

Defined results: null, empty and blank texts have no shingles and no links. Rows with one doc_id are rows like others:
with one text they are copies, with different ones they are two documents, which one_of_each keeps or drops by the row.
A null doc_id never is a component_id unless all of a component are null. An empty table gives no rows; other columns,
whatever their names, are not looked at. Ties (equal sketches, equally frequent partners) are broken by signature, which
changes the order of work only. A text's shingles are held as one array by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import TEXTS, Stash, keyed, mix, pieces_of, sized, words_in

N = 5
_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, i, 2**64)) for i in range(N)]
_SEEN = 1 << 18
#: Groups that share a part and have more classes are hot: their classes are compared in blocks of SIDE by SIDE.
GROUP, SIDE = 32, 512


def shingles(h: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    if not len(h):
        return h
    k = min(N, len(h))
    total = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        total += mix(h[i : len(h) - k + 1 + i] + np.uint64(i)) * _STEP[i]
    return np.unique(mix(total))


def bands(n: int) -> list[int]:
    """Upper size limits (powers of two, exclusive) of the bands whose pairs a set of n shingles can be in."""
    own = 1 << n.bit_length()
    return [own] if n * 5 < own * 4 else [own, own * 2]


def parts_of(top: int) -> int:
    """Parts of the sketch of the band below `top`: few more than shingles may differ, lest documents have too few filled."""
    return -(-top // 4) + 2


def most_differing(n: int, top: int) -> int:
    """Shingles in one set only, at most, of a set of n shingles and any partner in the band below `top`."""
    return (n + min(n * 5 // 4, top - 1)) // 9


def slack(s: np.ndarray) -> list[int]:
    """By how many the filled parts of each of a set's bands, its own first, outnumber the shingles that may differ there."""
    return [len(np.unique(s % np.uint64(parts_of(top)))) - most_differing(len(s), top) for top in bands(len(s))]


def sketch(s: np.ndarray) -> bytes:
    """1024 parity bits, each of the shingles that hash to it."""
    odd = np.bincount((s >> np.uint64(40) & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def part_keys(s: np.ndarray) -> np.ndarray:
    """Join keys of a set: band, part and sketch part folded to 64 bits."""
    n, out = len(s), []
    for top in bands(n):
        # Below four shingles, links are between equal sets only, which are one class.
        if n < 4:
            continue
        m = parts_of(top)
        differ = most_differing(n, top)
        part = (s % np.uint64(m)).astype(np.int64)
        bit = mix((s // np.uint64(m)) & np.uint64(0xFFFFFFFF))
        order = np.argsort(part, kind="stable")
        first = np.flatnonzero(np.diff(part[order], prepend=-1))
        folded, at = np.bitwise_xor.reduceat(bit[order], first), part[order][first]
        salt = np.uint64(top) << np.uint64(32)
        out.append(mix(folded ^ mix(at.astype(np.uint64) + salt)))
        if len(at) <= differ:
            rest = np.setdiff1d(np.arange(m), at)
            out.append(mix(mix(rest.astype(np.uint64) + salt) + np.uint64(1)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingles) of each row; the text is the last column."""
    for row, data, offsets in pieces_of(b.column(b.num_columns - 1)):
        _, _, h, first = words_in(data, offsets)
        for i in range(len(first) - 1):
            yield row + i, shingles(h[first[i] : first[i + 1]])


def _signature(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s + np.uint64(7)).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].view(np.int64))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(len(s), _signature(s), (x := slack(s))[0], min(x), sketch(s)) for _, s in _sets(b)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = [*[pa.int64()] * 4, pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(i) for i in range(3)), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
            names=["doc_id", "did", "rid", "n", "cls", "slack", "least", "wide"],
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for b in batches:
        keys, of = [], []
        for _, s in _sets(b):
            c = _signature(s)
            if len(s) and c not in seen:
                seen.add(c)
                keys.append(part_keys(s))
                of.append(np.full(len(keys[-1]), c, np.int64))
            if sum(map(len, keys[-1:])) and len(keys) >= 500:
                yield _pairs_batch(np.concatenate(keys).view(np.int64), np.concatenate(of))
                keys, of = [], []
        if keys:
            yield _pairs_batch(np.concatenate(keys).view(np.int64), np.concatenate(of))
        if len(seen) > _SEEN:
            seen.clear()


def _pairs_batch(key: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls)], names=["key", "cls"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and class, the distinct ones whose key has several classes. One row is carried over."""
    key, cls, shown = None, None, False
    for b in batches:
        if not b.num_rows:
            continue
        k, c = (b.column(i).to_numpy() for i in (0, 1))
        if key is not None:
            k, c = np.append(key, k), np.append(cls, c)
        new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
        k, c = k[new], c[new]
        like = k[1:] == k[:-1]
        several = np.append(False, like) | np.append(like, False)
        # The last row may have its partner in the next batch; the first one may have been given out already.
        out = several.copy()
        out[0] &= not (key is not None and shown)
        yield _pairs_batch(k[out], c[out])
        shown = bool(several[-1]) if len(k) > 1 else shown
        key, cls = k[-1:], c[-1:]


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 200):
            rows = [s for _, s in _sets(b.slice(i, 200))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_signature(s) for s in rows], pa.int64()), pa.array([s.view(np.int64) for s in rows], pa.list_(pa.int64()))],
                names=["id", "s"],
            )


def components(stash: Stash, edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that `edges` (a, b) connect each id with."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stash.put(both, "edges")
    label = stash.put(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "label")
    while True:
        near = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near, label["id"] == near["a"]).select("id", F.least("root", "near").alias("root"))
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("far"))
        new = stash.put(step.join(jump, "root", "left").select("id", F.coalesce("far", "root").alias("root")), "label")
        changed = new.join(label.withColumnRenamed("root", "old"), "id").where("root != old").limit(1).count()
        stash.drop(label)
        label = new
        if not changed:
            stash.drop(both)
            return label


def joined_roots(stash: Stash, roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """`roots` after the components that `links` (a, b) connect have become one; links are between roots, each pair once."""
    if roots is None:
        return components(stash, links)
    of = lambda x: roots.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}"))
    pairs = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    new = components(stash, pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moved = roots.join(new.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    out = stash.put(moved.unionByName(new.join(roots, "id", "left_anti")), "roots")
    stash.drop(roots, new)
    return out


def connected(stash: Stash, rows: DataFrame) -> DataFrame:
    """(id, root) of all ids of (key, id) rows, connected by their keys.

    At first each id has one edge, to the smallest id that any of its keys leads to; then the roots that still share a key
    are linked, each pair once. So no more edges than ids are walked, however many keys they have.
    """
    low = rows.groupBy("key").agg(F.min("id").alias("b"))
    edges = rows.join(low, "key").groupBy(F.col("id").alias("a")).agg(F.min("b").alias("b")).where("a != b")
    roots = components(stash, edges)
    named = rows.join(roots, "id", "left").select("key", F.coalesce("root", "id").alias("root")).distinct()
    low = named.groupBy("key").agg(F.min("root").alias("b"), F.max("root").alias("top")).where("b != top").select("key", "b")
    roots = joined_roots(stash, roots, named.join(low, "key").where("root != b").select(F.col("root").alias("a"), "b").distinct())
    return rows.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def _verified(stash: Stash, pairs: DataFrame, classes: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough."""
    pairs = stash.put(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = stash.put(ids.join(classes, "id").select("did", "rid").distinct(), "ids")
    wanted = docs.join(sized(ids, 24), ["did", "rid"], "left_semi").select("text")
    sets = stash.put(wanted.mapInArrow(_full_sets, "id long, s array<long>"), "sets", TEXTS).dropDuplicates(["id"])
    a, b = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    joined = pairs.join(a, "a").join(b, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return joined.where(F.col("i") * den >= (F.size("sa") + F.size("sb") - F.col("i")) * num).select("a", "b")


def _possible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes, sketches and, where it is known, the number of cold parts they met on still allow."""
    columns = ("n", "need", "wide")
    side = lambda x: classes.select(F.col("id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in columns))
    df = pairs.join(side("a"), "a").join(side("b"), "b")
    na, nb = F.col("a_n"), F.col("b_n")
    need = F.when(na >= nb, F.col("a_need")).otherwise(F.col("b_need"))
    sizes = (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (F.col("met").isNull() | (F.col("met") >= need))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("a_wide", "b_wide"))
            n = b.column("a_n").to_numpy() + b.column("b_n").to_numpy()
            fits = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) * (num + den) <= n * (den - num)
            yield b.select(["a", "b"]).filter(pa.array(fits))

    df = df.where(sizes).select("a", "b", "a_n", "b_n", "a_wide", "b_wide")
    return df.mapInArrow(near, "a long, b long").distinct()


def _star(rows: DataFrame, first) -> DataFrame:
    """(x, y): each class and, of the centres of its groups, the one that it meets most often."""
    seed = F.when(first, 0).otherwise(1)
    centre = rows.groupBy("key").agg(F.min_by(F.struct("id", "root"), F.xxhash64("id", seed)).alias("c")).select("key", "c.*")
    met = rows.alias("x").join(centre.alias("y"), "key").where("x.root != y.root")
    met = met.groupBy(F.col("x.id").alias("x"), F.col("y.id").alias("y")).agg(F.count("*").alias("met"))
    return met.groupBy("x").agg(F.max_by("y", F.struct("met", "y")).alias("y"))


def _crowded(crowds: DataFrame, roots: DataFrame | None, num: int, den: int, best: bool) -> DataFrame:
    """(x, y) of different components within crowds (the classes that hot groups connect) whose wide sketches are near.

    One side is a class outside the largest component of its crowd, the other any class. Each side is cut into blocks of
    SIDE classes; each pair of blocks is one group of rows, compared as a whole. With `best`, a class gets only its
    nearest one of another component in a block.
    """
    df = crowds.withColumn("root", F.col("id")) if roots is None else crowds.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    parts = df.groupBy("crowd", "root").agg(F.count("*").alias("m"))
    main = parts.groupBy("crowd").agg(F.sum("m").alias("g"), F.max(F.struct("m", "root")).alias("top"))
    main = main.where("g > top.m").select("crowd", F.col("top.root").alias("main"), F.ceil((F.col("g") - F.col("top.m")) / SIDE).cast("int").alias("lefts"), F.ceil(F.col("g") / SIDE).cast("int").alias("rights"))
    df = df.join(main, "crowd")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row = ("crowd", "id", "n", "wide", "root")
    left = df.where("root != main").select(*row, F.lit(True).alias("open"), block("lefts").alias("i"), every("rights").alias("j"))
    right = df.select(*row, F.lit(False).alias("open"), every("lefts").alias("i"), block("rights").alias("j"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        open_ = table["open"].to_numpy()
        n, ids, root = (table[c].to_numpy() for c in ("n", "id", "root"))
        wide = np.frombuffer(b"".join(table["wide"].to_pylist()), np.uint64).reshape(len(open_), -1)
        left, right = np.flatnonzero(open_), np.flatnonzero(~open_)
        xs, ys = [], []
        for p in left.tolist():
            q = right[(root[right] != root[p]) & (np.minimum(n[right], n[p]) * den >= np.maximum(n[right], n[p]) * num)]
            far = np.bitwise_count(wide[q] ^ wide[p]).sum(1, dtype=np.int64)
            near = far * (num + den) <= (n[q] + n[p]) * (den - num)
            q, far = q[near], far[near]
            if best and len(q) > 1:
                q = q[[np.lexsort((ids[q], far))[0]]]
            xs.append(np.full(len(q), ids[p]))
            ys.append(ids[q])
        cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
        return pa.table({"x": pa.array(cat(xs), pa.int64()), "y": pa.array(cat(ys), pa.int64())})

    return left.unionByName(right).groupBy("crowd", "i", "j").applyInArrow(compare, "x long, y long").distinct()


def link_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return _linked(spark, keyed(docs)).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _linked(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, did, rid, n, component_id) of every row of keyed `docs`."""
    num, den = 80, 100
    stash = Stash(spark)
    all_docs = docs.mapInArrow(_summaries, "doc_id long, did long, rid long, n long, cls long, slack long, least long, wide binary")
    all_docs = stash.put(all_docs, "docs", TEXTS)
    # Any row speaks for its class, as its text gives the class's set.
    first = F.min(F.struct("did", "rid", "n", "slack", "least", "wide")).alias("f")
    classes = stash.put(all_docs.where("n > 0").groupBy(F.col("cls").alias("id")).agg(first).select("id", "f.*"), "classes")
    keys = docs.select("text").mapInArrow(_keys, "key long, id long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartition(parts, "key").sortWithinPartitions("key", "id")
    groups = stash.put(dealt.mapInArrow(_shared, "key long, id long"), "groups", 2 * TEXTS)

    sizes = groups.groupBy("key").agg(F.count("*").alias("k"))
    counted = stash.put(groups.join(sizes, "key"), "counted")
    stash.drop(groups)
    groups = counted
    # A class that, in each band, has more parts outside hot groups than shingles may differ agrees with any partner in
    # one of those. The hot parts of both bands are counted together, which can only keep more classes.
    hot = groups.where(F.col("k") > GROUP).select("key", "id")
    counts = hot.groupBy("id").agg(F.count("*").alias("h"))
    h = F.coalesce("h", F.lit(0))
    needs = classes.join(counts, "id", "left").withColumn("need", F.col("slack") - h).withColumn("least", F.col("least") - h).drop("slack", "h")
    needs = stash.put(needs, "needs")
    stash.drop(classes)
    classes = needs
    hot = stash.put(hot.join(classes.where("least <= 0").select("id"), "id"), "hot")
    crowds = None
    if hot.limit(1).count():
        members = connected(stash, hot)
        crowds = stash.put(members.select("id", F.col("root").alias("crowd")).join(classes.select("id", "n", "wide"), "id"), "crowds")

    roots = None
    for step in ("star", "star", "best", "best", "best", "all"):
        if step in ("star", "all"):
            if roots is None:
                rows = groups.withColumn("root", F.col("id"))
            else:
                rows = groups.join(roots, "id", "left").select("key", "id", "k", F.coalesce("root", "id").alias("root"))
        if step == "star":
            # Each group against one of its classes, another in each round; each class only with its most frequent partner.
            met = _star(rows, F.lit(roots is None))
        elif step == "all":
            cold = rows.where(F.col("k") <= GROUP)
            mixed = cold.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
            cold = stash.put(cold.join(mixed, "key"), "mixed")
            met = cold.alias("x").join(cold.alias("y"), "key").where("x.root < y.root")
            met = met.groupBy(F.col("x.id").alias("x"), F.col("y.id").alias("y")).agg(F.count("*").alias("met"))
            if crowds is not None:
                met = met.unionByName(_crowded(crowds, roots, num, den, False), allowMissingColumns=True)
        elif crowds is None:
            continue
        else:
            met = _crowded(crowds, roots, num, den, True)
        common = F.col("met") if "met" in met.columns else F.lit(None).cast("long")
        pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), common.alias("met"))
        new = stash.put(_verified(stash, _possible(pairs, classes, num, den), classes, docs, num, den), f"links-{step}")
        if new.limit(1).count():
            roots = joined_roots(stash, roots, new)
    out = all_docs.select("doc_id", "did", "rid", "n", F.col("cls").alias("id"))
    if roots is None:
        roots = classes.select("id", F.col("id").alias("root"))
    else:
        roots = classes.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    least = out.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("least")).join(roots, "id")
    smallest = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = stash.put(least.select("id", "root").join(smallest, "root").select("id", "component_id"), "components")
    out = out.join(of_class, "id", "left")
    return out.select("doc_id", "did", "rid", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component, with all columns; of rows with that doc_id, all.

    The columns of `docs`, whatever their names, go along as one value.
    """
    gone = _linked(spark, keyed(docs)).where("doc_id != component_id").select("did", "rid")
    kept = keyed(docs, F.struct("*").alias("row")).join(gone, ["did", "rid"], "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
