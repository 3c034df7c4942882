"""URL filters: domain rules first, then a weighted vocabulary found with Aho-Corasick.

Every distinct vocabulary term that occurs in a url between boundaries adds its weight once.
A strict term weighs as much as the limit, so one is enough; soft terms need several distinct ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT = ("porn", "xxx", "escort", "casino", "viagra", "hentai", "adult")
SOFT = (
    "bet", "bets", "betting", "free", "win", "bonus", "poker", "slots", "jackpot", "loan", "loans",
    "payday", "dating", "webcam", "nude", "hot", "torrent", "crack", "pills", "cheap",
)
LIMIT = 2
WEIGHTS = {**dict.fromkeys(STRICT, LIMIT), **dict.fromkeys(SOFT, 1)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HITS = "strict_hits int, soft_hits int, weight int"


@lru_cache(maxsize=4)
def _automaton(terms: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for number, (term, weight) in enumerate(terms):
        built.add_word(term, (number, len(term), weight))
    built.make_automaton()
    return built


def _ascii_alnum(c: str) -> bool:
    return c.isascii() and c.isalnum()


def vocabulary_hits(text: str, terms: tuple[tuple[str, int], ...], limit: int) -> tuple[int, int, int]:
    """Distinct strict and soft terms of a lower-case text, and their weight.

    A hit counts only if no ASCII letter or digit touches it on either side.
    """
    found: dict[int, int] = {}
    for last, (number, length, weight) in _automaton(terms).iter(text):
        first = last - length + 1
        if first and _ascii_alnum(text[first - 1]):
            continue
        if last + 1 < len(text) and _ascii_alnum(text[last + 1]):
            continue
        found[number] = weight
    strict = sum(w >= limit for w in found.values())
    return strict, len(found) - strict, sum(found.values())


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Longest rule ``host/path`` that fits, or null.  A rule fits its host and every subdomain."""
    best = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # a longer rule wraps the shorter ones
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        best = F.when(fits, F.lit(rule)).otherwise(best)
    return best


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    weights: Mapping[str, int] = WEIGHTS,
    limit: int = LIMIT,
    url: str = "url",
) -> DataFrame:
    """Add ``host, path, rule, verdict, strict_hits, soft_hits, weight`` to every row.

    ``rules`` are pairs of ``host/path`` and ``allow`` or ``block``; a rule that fits decides.
    Otherwise a url whose distinct vocabulary terms weigh ``limit`` or more is blocked.
    Null and empty urls have no host, path or hits and are allowed.  Rows are never merged or
    dropped; columns of those names are replaced, all others pass through.
    """
    terms = tuple(sorted((t.lower(), int(w)) for t, w in weights.items()))

    @F.pandas_udf(HITS)
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in urls:
            rows = [vocabulary_hits(u.lower() if u else "", terms, limit) for u in batch]
            yield pd.DataFrame(rows, columns=["strict_hits", "soft_hits", "weight"])

    own = ["host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight"]
    kept = [c for c in pages.columns if c not in own or c == url]
    source = pages[f"`{url}`"]
    found = pages.select(
        *[pages[f"`{c}`"] for c in kept],
        host_of(source).alias("host"),
        path_of(source).alias("path"),
        hits(source).alias("_hits"),
    )
    ruled = found.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("_hits.weight") >= limit, F.lit("block")).otherwise(F.lit("allow"))
    for rule, decision in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(decision)).otherwise(verdict)
    return ruled.select(*kept, "host", "path", "rule", verdict.alias("verdict"), "_hits.*")
