"""The thin opN queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm import codes, collocations, decontam, jaccard, linededup, lm, nearest, packing, pii, quality, secrets, suffix, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(spark, _table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(spark, _table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_exact", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(spark, _table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_columns(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "line_chars", "noisy_chars", "removed_chars",
    )  # fmt: skip


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.judge_urls(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(spark, _table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_bytes(spark, _table(spark, sf_dir, "documents"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.exact_top_k(spark, _table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.coded(spark, _table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark, _table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_line_dedup, op3_jaccard_join, op4_quality_rules, op5_url_filter, op6_decontamination, op7_secret_scan, op8_packing, op9_lm_scoring, op10_suffix_dedup, op11_exact_top_k, op12_vector_codes, op13_collocations)}

# --- SQL ------------------------------------------------------------------------------------------------------

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"

_OP4 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) AS ls
  FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS win FROM d, unnest(range(1, len(w) - 3)) AS t(i) WHERE len(w) >= 5),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, unnest(range(0, 5)) AS t(k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(ls) AS line FROM d),
v AS (
  SELECT doc_id, length(line) AS n,
    length(regexp_replace(line, '[^#*$%&<>!?=~^{{}}]+', '', 'g')) * 100 > length(line) * {quality.PUNCTUATION_IN_100}
    OR (length(line) - length(replace(line, '|', '')) >= 3
        AND (length(line) - length(replace(line, '|', ''))) * 100 > length(line) * {quality.SEPARATORS_IN_100}) AS noisy,
    regexp_matches(lower(line), '{"|".join(quality.BOILERPLATE)}') AS known
  FROM l),
s AS (
  SELECT doc_id, sum(n) AS a, sum(CASE WHEN noisy THEN n ELSE 0 END) AS b,
    sum(CASE WHEN noisy OR known THEN n ELSE 0 END) AS c FROM v GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(a, 0) AS BIGINT) AS line_chars,
    CAST(coalesce(b, 0) AS BIGINT) AS noisy_chars, CAST(coalesce(c, 0) AS BIGINT) AS removed_chars
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR noisy_chars * 100 > line_chars * {quality.LOST_IN_100}
       OR removed_chars * 100 > line_chars * {quality.ALL_LOST_IN_100}) AS kept
FROM m
"""


def _term(t: str) -> str:
    return rf"regexp_matches(subject, '(^|[^\pL]){t}($|[^\pL])')"


_OP5 = rf"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^(?s:.*?)://((?s:.*))$', 1) ELSE '' END AS rest
  FROM pages),
h AS (SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (
  SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(v, d, pre) AS (VALUES {", ".join(f"('{v}', '{d}', '{x}')" for v, d, x in urlfilter.RULES)}),
f AS (
  SELECT page_id, arg_max(v, length(d || pre)) AS v, arg_max(d || pre, length(d || pre)) AS rule
  FROM p JOIN rules ON (host = d OR ends_with(host, '.' || d)) AND starts_with(path, pre) GROUP BY page_id),
t AS (
  SELECT page_id, host, path,
    translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS subject FROM p),
s AS (
  SELECT page_id, host, path, {" + ".join(f"CAST({_term(t)} AS INT)" for t in urlfilter.STRICT)} AS strict_hits,
    {" + ".join(f"CAST({_term(t)} AS INT)" for t in urlfilter.SOFT)} AS soft_hits FROM t)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN strict_hits > 0 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN f USING (page_id)
"""

_OP6 = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 9), ' ') AS g, len(list_slice(w, i, i + 9)) AS n
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
d AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM w, lens, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, d.n, item_id FROM d JOIN win ON d.g = win.g AND d.n = win.n),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id),
-- proximity: the three words of a window that are rarest in the documents, within nine words of its rarest one
df AS (SELECT t, count(*) AS c FROM (SELECT unnest(w) AS t FROM w) WHERE t IN (SELECT unnest(w) FROM b) GROUP BY t),
wt AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS ws
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
wr AS (
  SELECT item_id, ws, list(t ORDER BY coalesce(c, 0), t, pos)[1:3] AS rare, min(coalesce(c, 0)) AS least
  FROM (SELECT item_id, ws, unnest(ws) AS t, unnest(range(1, len(ws) + 1)) AS pos FROM wt) LEFT JOIN df USING (t)
  GROUP BY item_id, ws),
an AS (SELECT DISTINCT item_id, rare FROM wr WHERE least > 0),
po AS (
  SELECT doc_id, i, t, list_slice(w, greatest(i - 9, 1), i + 9) AS around
  FROM (SELECT doc_id, w, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM w) WHERE t IN (SELECT rare[1] FROM an)),
near AS (SELECT DISTINCT doc_id, item_id FROM po JOIN an ON t = rare[1] WHERE list_has_all(around, rare)),
nn AS (SELECT doc_id, count(*) AS k FROM (SELECT doc_id, item_id FROM near UNION SELECT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(k, 0) AS BIGINT) AS n_near_items
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nn USING (doc_id)
"""

#: Rows of a table d(doc_id, text) as lines that stay or go.
LINES_SQL = r"""
l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM d),
ls AS (
  SELECT doc_id, line, t, list_sort(list_distinct(list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))) AS s FROM l),
e AS (SELECT doc_id, line, s, len(s) AS n FROM ls WHERE len(s) >= 1),
c AS (SELECT s, n, min(struct_pack(doc_id := doc_id, line := line)) AS f, row_number() OVER (ORDER BY s) AS cls FROM e GROUP BY s, n),
tk AS (SELECT cls, n, f, unnest(s) AS t FROM c),
tf AS (SELECT t, count(*) AS k FROM tk GROUP BY t),
pr AS (
  SELECT cls, n, f, t FROM (
    SELECT cls, n, f, t, row_number() OVER (PARTITION BY cls ORDER BY k, t) AS r FROM tk JOIN tf USING (t))
  WHERE r <= n - CAST(ceil(n * 4 / 5.0) AS INT) + 1),
cand AS (
  SELECT DISTINCT x.cls AS a, y.cls AS b FROM pr x JOIN pr y USING (t)
  WHERE x.f < y.f AND least(x.n, y.n) * 5 >= greatest(x.n, y.n) * 4),
late AS (
  SELECT DISTINCT y.cls FROM cand JOIN c x ON x.cls = a JOIN c y ON y.cls = b
  WHERE len(list_intersect(x.s, y.s)) * 5 >= (x.n + y.n - len(list_intersect(x.s, y.s))) * 4),
gone AS (
  SELECT e.doc_id, e.line, struct_pack(doc_id := e.doc_id, line := e.line) <> c.f AS again
  FROM e JOIN c USING (s) WHERE struct_pack(doc_id := e.doc_id, line := e.line) <> c.f OR cls IN (FROM late)),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.line) AS n_removed, count(*) FILTER (WHERE again) AS n_exact,
    coalesce(string_agg(l.t, chr(10) ORDER BY l.line) FILTER (WHERE gone.line IS NULL), '') AS kept_text
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.line = l.line GROUP BY l.doc_id)
"""

_OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{LINES_SQL}
SELECT doc_id, n_lines, n_removed, n_exact, sha256(kept_text) AS kept_sha256 FROM kept
"""

_VECTORS = """
v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
"""

_OP11 = f"""
WITH {_VECTORS},
p AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _op12() -> str:
    """A round's steps: parts to entries, entries to floored means, unused ones as they were."""
    size = "len(v) // 16"
    square = "list_sum(list_transform(list_zip(s, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    out = f"""
WITH {_VECTORS},
s AS (SELECT vec_id, p, list_slice(v, p * ({size}) + 1, (p + 1) * ({size})) AS s FROM v, unnest(range(0, 16)) AS t(p)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
b0 AS (SELECT p, e, s AS c FROM s JOIN f USING (vec_id))"""
    for k in range(codes.ROUNDS + 1):
        out += f""",
a{k} AS (
  SELECT vec_id, p, any_value(s) AS s, min(struct_pack(d := d, e := e)) AS m
  FROM (SELECT vec_id, p, s, e, CAST({square} AS BIGINT) AS d FROM s JOIN b{k} USING (p)) GROUP BY vec_id, p)"""
        if k < codes.ROUNDS:
            out += f""",
m{k} AS (
  SELECT p, e, list(CAST(floor(t / CAST(n AS DOUBLE)) AS BIGINT) ORDER BY i) AS c
  FROM (
    SELECT p, m.e AS e, i, sum(s[i]) AS t, count(*) AS n FROM a{k}, unnest(range(1, len(s) + 1)) AS u(i) GROUP BY ALL)
  GROUP BY p, e),
b{k + 1} AS (SELECT p, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e))"""
    last = codes.ROUNDS
    return f"""{out},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last}),
g AS (
  SELECT vec_id, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error
  FROM a{last} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM g JOIN v USING (vec_id), h
"""


_OP13 = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, k, list_slice(w, i, i + k - 1) AS w, count(*) AS a
  FROM w, unnest(range(1, 6)) AS u(k), unnest(range(1, len(w) - k + 2)) AS x(i) GROUP BY ALL HAVING count(*) >= 100),
h AS (
  SELECT lang, list_slice(w, i, i + j - 1) AS w, max(a) AS most
  FROM f, unnest(range(2, k)) AS u(j), unnest(range(1, k - j + 2)) AS x(i) GROUP BY ALL),
c AS (
  SELECT f.lang, f.w, f.a, cut, g.a AS l, e.a AS r, n.n, 1000 * CAST(f.a AS HUGEINT) * n.n // (CAST(g.a AS HUGEINT) * e.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k >= 2) AS f
    JOIN f AS g ON g.lang = f.lang AND g.w = list_slice(f.w, 1, cut)
    JOIN f AS e ON e.lang = f.lang AND e.w = list_slice(f.w, cut + 1, f.k) JOIN n ON n.lang = f.lang
    LEFT JOIN h ON h.lang = f.lang AND h.w = f.w
  WHERE most IS NULL OR most < f.a),
b AS (SELECT lang, w, any_value(a) AS a, any_value(n) AS n, min(struct_pack(score := score, cut := cut, l := l, r := r)) AS m FROM c GROUP BY lang, w),
o AS (SELECT lang, array_to_string(w, ' ') AS phrase, a, m.l AS l, m.r AS r, n, CAST(m.score AS BIGINT) AS score FROM b),
z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM o)
SELECT * FROM z WHERE rank <= 2000
"""

ORACLE = {
    "op11_exact_top_k": _OP11, "op12_vector_codes": _op12(), "op13_collocations": _OP13,
    "op2_line_dedup": _OP2,
    "op6_decontamination": _OP6,
    "op4_quality_rules": _OP4, "op5_url_filter": _OP5}
