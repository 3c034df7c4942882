import pytest

from fleetlens.llm.queries import QUERIES, URL_RULES
from fleetlens.llm.urlfilter import WEIGHTS, judge_urls, vocabulary_hits

CASES = [
    ("http://shop.Example.NET/en/x", "shop.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://example.net/en", "example.net", "/en", "net/", "block"),
    ("http://net/", "net", "/", "net/", "block"),
    ("http://planet", "planet", "", None, "allow"),
    ("http://a.net", "a.net", "", None, "allow"),
    ("http://a.net?x", "a.net", "", None, "allow"),
    ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
    ("https://m.example.com/de/1#t", "m.example.com", "/de/1", "example.com/de/", "block"),
    ("x://a.org/fr/casino", "a.org", "/fr/casino", "org/fr/", "allow"),
    ("http://casino.test/", "casino.test", "/", None, "block"),
    ("http://casinos.test/", "casinos.test", "/", None, "allow"),
    ("http://free-bets.test/", "free-bets.test", "/", None, "block"),
    ("http://free-free.test/free", "free-free.test", "/free", None, "allow"),
    ("http://free.test/?q=win", "free.test", "/", None, "block"),
    ("no scheme", "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("http://ÄÖ.TEST/é\nx?y", "ÄÖ.test", "/é\nx", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_cases(spark):
    table = spark.createDataFrame(
        [(i, c[0], "clash", "clash") for i, c in enumerate(CASES)], "page_id long, url string, host string, weight string"
    )
    got = judge_urls(table, URL_RULES).orderBy("page_id").collect()
    assert [(r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == CASES
    assert judge_urls(table.limit(0), URL_RULES).count() == 0
    assert judge_urls(table.unionAll(table), URL_RULES).count() == 2 * len(CASES)


@pytest.mark.parametrize("text", ["porn", "a porn.b", "xxx-porn bets", "/free/free/win-win/bet", "étéporn", "pornxxx", "x" * 5000 + " porn"])
def test_hits_equal_a_plain_search(text):
    import re

    terms = tuple(sorted(WEIGHTS.items()))
    found = [w for t, w in terms if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", text)]
    assert vocabulary_hits(text, terms, 2) == (sum(w >= 2 for w in found), sum(w < 2 for w in found), sum(found))


def test_query_returns_every_page(spark, sf):
    assert QUERIES["op9_url_filters"](spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()
