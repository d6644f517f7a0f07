"""URL filters (operator 5): a weighted vocabulary found by one Aho-Corasick pass over the whole address.

A strict term blocks by itself, soft terms block when `soft_limit` different ones occur; a term counts only where
neither neighbour is a letter (digits and punctuation are boundaries). Domain rules come before the vocabulary. The
vocabulary is a table of (weight, language, terms) and a parameter; the one below names gambling, adult, pharmacy and
piracy sites in the four languages of the corpora.

Defined results: null urls, and urls without ``://``, have an empty host and path and no rule; the vocabulary judges what
text there is, so a null or empty url is allowed. Rows are judged by themselves, so repeated rows and null or repeated
page_ids are rows like others; of rules of one length the first in the table decides. An empty table gives no rows;
other columns, whatever their names, are not looked at. A very long url takes time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values: (verdict, host, path prefix); the longest that fits decides.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The vocabulary: (weight, language, terms). Soft terms are ordinary words that such sites' addresses heap up.
VOCABULARY = (
    ("strict", "any", ("casino", "porn", "porno", "xxx", "viagra", "cialis", "escort", "warez", "sexcam", "hentai", "camgirl", "camgirls", "keygen", "pornstar")),
    ("strict", "en", ("sportsbook", "livesex", "torrents", "cracked")),
    ("strict", "de", ("spielautomaten", "sportwetten", "erotik", "potenzmittel", "sexkontakte")),
    ("strict", "fr", ("pariturf", "rencontrecoquine", "machineasous", "sexe")),
    ("strict", "es", ("tragaperras", "apuestas", "tragamonedas", "sexo")),
    ("soft", "any", ("bonus", "poker", "jackpot", "slots", "roulette", "bingo", "lotto", "vip", "hot", "sexy", "adult", "erotic", "torrent", "crack", "serial")),
    ("soft", "en", ("win", "bet", "free", "cash", "loan", "loans", "pills", "cheap", "dating", "click", "payday", "deal", "prize", "singles", "replica", "discount")),
    ("soft", "de", ("gewinn", "wetten", "gratis", "kredit", "pillen", "billig", "partnersuche", "preise", "rabatt", "geld", "verdienen", "spielen")),
    ("soft", "fr", ("gagner", "pari", "paris", "gratuit", "argent", "pilules", "rencontre", "cadeau", "promo", "jeux", "credit")),
    ("soft", "es", ("ganar", "apuesta", "dinero", "prestamo", "pastillas", "barato", "citas", "premio", "oferta", "juegos", "regalo")),
)
STRICT, SOFT = (tuple(t for weight, _, terms in VOCABULARY if weight == w for t in terms) for w in ("strict", "soft"))
SCHEMA = "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int"


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path, as the operator's contract cuts them."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    return host.translate(_ASCII), rest[:cut]


_ASCII = {c: c + 32 for c in range(65, 91)}


def rule_for(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(rule text, verdict) of the longest rule that fits the host, or a parent domain of it, and the path."""
    best = None
    for verdict, domain, prefix in rules:
        if (host == domain or host.endswith("." + domain)) and path.startswith(prefix):
            if best is None or len(domain) + len(prefix) > len(best[0]):
                best = domain + prefix, verdict
    return best


class Vocabulary:
    def __init__(self, strict=STRICT, soft=SOFT, soft_limit: int = 2):
        import ahocorasick

        self.auto, self.soft_limit = ahocorasick.Automaton(), soft_limit
        for weight, terms in ((0, soft), (1, strict)):
            for t in terms:
                self.auto.add_word(t, (weight, t))
        self.auto.make_automaton()

    def hits(self, text: str) -> tuple[int, int]:
        """Distinct strict and soft terms that occur between boundaries."""
        low, found = text.translate(_ASCII), set()
        for end, (weight, term) in self.auto.iter(low):
            start = end - len(term) + 1
            if not (start and low[start - 1].isalpha()) and not (end + 1 < len(low) and low[end + 1].isalpha()):
                found.add((weight, term))
        strict = sum(w for w, _ in found)
        return strict, len(found) - strict

    def blocks(self, strict: int, soft: int) -> bool:
        return strict > 0 or soft >= self.soft_limit


def judge_urls(pages: DataFrame, strict=STRICT, soft=SOFT, soft_limit: int = 2, rules=RULES) -> DataFrame:
    """One row for each page; only page_id and url are read. `strict` and `soft` are terms, of any script."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(strict, soft, soft_limit)
        for b in batches:
            rows = []
            for page_id, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                host, path = split_url(url)
                rule, (n, m) = rule_for(host, path, rules), words.hits(url or "")
                verdict = rule[1] if rule else "block" if words.blocks(n, m) else "allow"
                rows.append((page_id, host, path, rule and rule[0], verdict, n, m))
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            types = [pa.int64(), *[pa.string()] * 4, pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(cols, types, strict=True)],
                names=["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"],
            )

    return pages.selectExpr("cast(page_id as long) page_id", "url").mapInArrow(judge, SCHEMA)
