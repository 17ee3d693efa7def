"""URL filters against a plain version."""

from __future__ import annotations

import random
import re

import pytest

from emend.llm import urls

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"), ("block", "com/d"), ("allow", "example.com"), ("block", "b.org/fr/"), ("allow", "b.org/fr/"), ("block", "/x"), ("allow", None), (None, "org/"), ("block", "Org/A")]


def plain(url, rules):
    """(host, path, rule, verdict) by trying all rules."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    host, path = re.fullmatch(r"([^/?#]*)([^?#]*)(?s:.*)", rest).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in rules:
        if not rule or not verdict:
            continue
        own, slash, start = rule.partition("/")
        own, start = own.lower(), slash + start
        if own and (host == own or host.endswith("." + own)) and path.startswith(start):
            found = (len(own + start), len(own), verdict == "block", own + start, verdict)
            best = max(best, found) if best else found
    return (host, path, best[3], best[4]) if best else (host, path, None, "allow")


ODD = [None, "", "example.net/en/1", "http://", "http://net", "http://net/", "HTTP://WWW.Example.NET/en/a#b", "https://anet/en/", "http://.net/x", "http://net./x", "http://example.net:80/en/", "http://a@example.net/en/", "x#y://example.net/en/?q", "http://example.com/d", "http://example.com/de", "http://example.com/de/", "http://example.com?/de/", "http://a.b.org/fr/fr/", "a://b://net/", "http://É.NET/é/", "http://org/A", "http://" + "a." * 3000 + "net" + "/b" * 5000]


def made(n):
    rng = random.Random(5)
    pick = rng.choice
    return [f"http://{pick(['', 'www.', 'a.b.', 'x.'])}{pick(['example.net', 'example.com', 'b.org', 'org', 'net', 'Example.Com'])}{pick(['', '/', '/en/', '/de/1', '/fr/', '/d', '/de', '/A/b'])}{pick(['', '?a/b', '#c', '/z'])}" for _ in range(n)]


@pytest.mark.parametrize("most", [urls.MOST_BROADCAST, 0])
def test_all_urls_are_judged_as_by_trying_all_rules(spark, most):
    given = [(i, u, "x") for i, u in enumerate(ODD + made(400))] + [(None, ODD[6], "x"), (3, ODD[5], "y"), (3, ODD[5], "y")]
    pages = spark.createDataFrame(given, "page_id long, url string, rule string").repartition(4)
    found = urls.judged(pages, spark.createDataFrame(RULES, "verdict string, rule string"), most_broadcast=most).collect()
    assert sorted(map(tuple, found), key=str) == sorted(((i, *plain(u, RULES)) for i, u, _ in given), key=str)


@pytest.mark.parametrize("most", [urls.MOST_BROADCAST, -1])
def test_without_rules_or_pages(spark, most):
    none = spark.createDataFrame([], "verdict string, rule string")
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    assert [tuple(r) for r in urls.judged(pages, none, most_broadcast=most).collect()] == [(1, "net", "/", None, "allow")]
    assert urls.judged(pages.limit(0), none, most_broadcast=most).collect() == []


def test_equal_short_digests_are_no_match(spark, monkeypatch):
    monkeypatch.setattr(urls, "SHORT", 1)  # one hex digit: many expressions meet rules that they don't equal
    given = list(enumerate(made(200)))
    found = urls.judged(spark.createDataFrame(given, "page_id long, url string"), spark.createDataFrame(RULES, "verdict string, rule string")).collect()
    assert sorted(map(tuple, found), key=str) == sorted(((i, *plain(u, RULES)) for i, u in given), key=str)
