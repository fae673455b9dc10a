"""The trie, and the join for large rule lists, against trying every rule."""

import itertools
import random
import re

import pytest

from adsift.llm import url_filter
from adsift.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, host string, rule int"
RULES = URL_RULES + [
    ("example.net", "/en", "block"), ("a.example.net", "/", "allow"), ("a.example.net", "", "block"),
    ("example.com", "/de/x/y", "allow"), ("xn--é.org", "/fr/", "block"), ("com", "/", "block"),
    ("com", "/", "allow"), ("example.com", "/d", "allow"), ("", "/odd", "block"),
]


def parse(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    if not m:
        return "", ""
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


def brute(rows, rules):
    out = []
    for page, url in rows:
        host, path = parse(url)
        fits = [
            (len(h + p), v == "block", h + p, v)
            for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        best = max(fits, default=(0, 0, None, "allow"))
        out.append((page, host, path, best[2], best[3]))
    return sorted(out, key=str)


def urls():
    rng = random.Random(1)
    hosts = ["example.net", "A.Example.net", "b.a.example.net", "notexample.net", "net", "x.com", "example.com",
             "www.example.com", "xn--É.org", "xn--é.org", "org", "", "a..org", "example.net.", "example.net:80"]
    paths = ["", "/", "/en", "/en/", "/en/1", "/english", "/de/", "/de/x/y", "/de/x/yz", "/fr/a?b", "/EN/", "/odd",
             "//en/", "/fr/\n/x", "?q=/en/", "#/en/"]
    full = [f"{s}://{h}{p}" for s, h, p in itertools.product(["http", ""], hosts, paths)]
    full += [None, "", "example.net/en/", "://", "http:/x.net/", "a://b://example.net/", "http://u@example.net/en/"]
    return [(rng.randint(0, 99), u) for u in full] + [(None, "http://x.net/")] * 2


@pytest.mark.parametrize("rules", [URL_RULES, RULES, []])
def test_trie(spark, rules):
    rows = urls()
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], SCHEMA)
    found = url_filter.judge_urls(pages, rules)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, rules)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_rule_tables_of_any_size(spark, limit):
    rows = urls()
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], SCHEMA)
    table = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = url_filter.judge_urls(pages, table, broadcast_bytes=limit)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, RULES)


def test_no_pages(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], SCHEMA), URL_RULES).collect() == []
