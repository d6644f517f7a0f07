"""Secret scans (operator 7): fixed patterns, and zstandard novelty for what they miss.

A sensitive context is a sensitive name with what follows it within `reach` characters; the context's candidates are
unbroken runs of ``[A-Za-z0-9+/_=-]`` that begin there. Each candidate is compressed twice under a dictionary of
identifiers and the code or text around it: the surroundings alone, and the surroundings with the candidate. If the
marginal bytes come to `min_ratio` of its length or more, and to `min_bytes` or more, nothing near it or in the dictionary
explains it. Runs of one kind (letters of one case, a first capital aside, or digits) are words and numbers up to
`longest_word` characters, and not asked; beyond that they are asked like others. What remains is reported as a ``novel``
span unless a base span covers it. The time is linear in the text: every candidate is looked at once, whatever the number of sensitive names before it.

Defined results: null and empty texts give no spans. Every text is scanned whole, by one task; the surroundings
compressed with a candidate are `around` characters on each side, and a context goes `reach` characters on from its name. Rows are judged by themselves, so repeated rows and
null or repeated doc_ids are rows like others, and there are no ties. An empty table gives no rows; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from bindery.llm.common import texts

ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SENSITIVE = re.compile(
    r"""(?:passw|pwd|secret|token|api.?key|credential|private.?key|auth|bearer|access.?key|signature|session)""", re.I | re.A
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
REACH, LONGEST_WORD = 32, 31
#: Identifiers that code around secrets is made of.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_secret authorization bearer session "
    "config settings environment production development username email address database connection string host port "
    "import export return function class public static void const let var def self this null true false none "
    "https http www example com org net localhost index html json yaml xml utf-8 content-type application "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ created_at updated_at description identifier "
    "placeholder changeme your-token-here xxxxxxxxxxxxxxxx 0000000000000000 getElementById addEventListener "
)
KINDS = ("assign", "access", "hex", "novel")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


class Novelty:
    """Marginal compressed size under a fixed dictionary."""

    def __init__(self, dictionary: str = IDENTIFIERS, level: int = 9):
        import zstandard

        primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.z = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False)

    def marginal(self, before: str, text: str, after: str) -> int:
        around = (before + after).encode()
        return len(self.z.compress((before + after + text).encode())) - len(self.z.compress(around))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def mixed(got: str) -> bool:
    """Whether a candidate has letters of both cases inside, or letters and digits."""
    digit, letter = any(c.isdigit() for c in got), any(c.isalpha() for c in got)
    return letter and (digit or not (got[1:].islower() or got.isupper()))


def novel_spans(text: str, base: list, novelty: Novelty, around: int, min_ratio: float, min_bytes: int, longest_word: int = LONGEST_WORD, far: int = REACH) -> list[tuple[int, int, int]]:
    out, reach, known, k = [], 0, sorted((s, e) for s, _, e in base), 0
    for s in SENSITIVE.finditer(text):
        at, stop = max(s.end(), reach), s.end() + far
        while at <= stop and (m := CANDIDATE.search(text, at, min(len(text), stop + 1))):
            # The search ends with the context; the run may go on beyond it.
            start, end = m.start(), CANDIDATE.match(text, m.start()).end()
            at = reach = end
            while k < len(known) and known[k][1] <= start:
                k += 1
            # A run below the least marginal bytes can't reach them, whatever surrounds it.
            if end - start < min_bytes or k < len(known) and known[k][0] < end:
                continue
            got = text[start:end]
            if len(got) > longest_word or mixed(got):
                cost = novelty.marginal(text[max(0, start - around) : start], got, text[end : end + around])
                if cost >= max(min_bytes, min_ratio * len(got)):
                    out.append((start, 3, end))
    return out


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_secrets(docs: DataFrame, around: int = 160, min_ratio: float = 0.6, min_bytes: int = 12, longest_word: int = LONGEST_WORD, reach: int = REACH) -> DataFrame:
    """One row for each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                base = base_spans(text)
                more = novel_spans(text, base, novelty, around, min_ratio, min_bytes, longest_word, reach)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((doc_id, *n, digest, joined(base + more), len(more)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(cols, types, strict=True)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"],
            )

    return texts(docs).mapInArrow(scan, SCHEMA)
