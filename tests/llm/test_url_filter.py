from __future__ import annotations

import random

import pytest
from llm_fixtures import collected

from epitrove.llm import url_filter
from epitrove.llm.url_filter import Rule, judge, rules_table


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:end], rest[end:]
    cut = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:cut]


def brute(pages, rules, default):
    out = []
    for page_id, url in pages:
        host, path = parts_of(url)
        fits = [(len(r.host + r.path), len(r.host), r.host + r.path, r.verdict) for r in rules
                if None not in r and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, default=None)
        out.append((page_id, host, path, best and best[2], best[3] if best else default))
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


ODD = [(1, None), (2, ""), (3, "no scheme/a"), (4, "http://"), (5, "HTTP://WWW.Example.COM/EN/x?q#f"), (6, "a://b://c/d"), (6, "a://b://c/d"),
       (None, "http://example.com/en/"), (7, "http://example.com#x"), (8, "http://example.com?x=/en/"), (9, "http://xexample.com/en/"),
       (10, "http://example.com./en/"), (11, "http://.com/en"), (12, "http://É.net/ÄÖ"), (13, "http://example.com:80/en/"), (14, "x\n://net/\n/y")]
RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/"),
         Rule("block", "net", ""), Rule("allow", "net", "/"), Rule(None, "com", "/x"), Rule("block", "b:", "")]


def made(count, seed):
    chance = random.Random(seed)
    labels, paths = ["a", "b", "ab", "com", "x-y"], ["", "/", "/a", "/a/", "/ab", "/a/b", "/b"]
    host = lambda: ".".join(chance.choice(labels) for _ in range(chance.randint(1, 4)))
    return ([(n, f"http://{'hot.com' if n % 3 == 0 else host()}{chance.choice(paths)}{chance.choice(['', '?x', 'c'])}") for n in range(count)],
            [Rule(chance.choice(["allow", "block"]), host(), chance.choice(paths)) for _ in range(40)] + [Rule("block", "hot.com", "/a")])


@pytest.mark.parametrize("size", [50_000, 7])
def test_equals_brute_force(spark, size):
    pages, rules = made(400, size)
    table = spark.createDataFrame(pages, "page_id long, url string").repartition(4)
    assert collected(judge(table, rules_table(spark, rules), "block", size)) == brute(pages, rules, "block")


def test_more_ranges_than_sampled_keys(spark, monkeypatch):
    """Stretches of keys are dealt to several ranges each, so ranges stay as large as asked for."""
    monkeypatch.setattr(url_filter, "SAMPLE", 5)
    pages, rules = made(400, 3)
    table = spark.createDataFrame(pages, "page_id long, url string").repartition(4)
    assert collected(judge(table, rules_table(spark, rules), "block", 7)) == brute(pages, rules, "block")


@pytest.mark.parametrize("size", [50_000, 2])
def test_odd_urls(spark, size):
    table = spark.createDataFrame([(*p, "html", 1) for p in ODD], "page_id long, url string, host string, key int")
    rules = spark.createDataFrame([(*r, 1) for r in RULES], "verdict string, host string, path string, `range` int").drop("range")
    assert collected(judge(table, rules, "allow", size)) == brute(ODD, RULES, "allow")


def test_no_pages_and_no_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert judge(none, rules_table(spark, RULES)).collect() == []
    pages = spark.createDataFrame(ODD, "page_id long, url string")
    assert collected(judge(pages, spark.createDataFrame([], "verdict string, host string, path string"), "block")) == brute(ODD, [], "block")


def test_paths_keep_a_stack_of_nested_beginnings():
    paths = url_filter._Paths([(b"", (0,)), (b"/a", (3,)), (b"/a/b", (2,)), (b"/c", (1,))])
    assert [paths.best(p) for p in (b"", b"/", b"/a", b"/a/b/c", b"/ab", b"/c/d", b"/d")] == [(0,), (0,), (3,), (3,), (3,), (1,), (0,)]
