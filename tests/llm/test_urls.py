import re

import pytest

from verdikt.llm import queries, urls

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("org", "", "block"), ("a.org", "/x", "allow"), ("a.org", "/x/y", "block"), ("a.org", "/x", "block"), ("B.ORG", "/p/", "allow"),
    (None, "/evil", "block"), ("twin.net", "/", "allow"), ("twin.net", "/", "block"), ("twin.net", "/", "block"),
]
URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/a?x#y", "https://example.com/en/1",
    "https://example.com/en", "https://example.com/EN/1", "http://m.example.com/en/", "http://notexample.com/en/1", "http://x.net/es/q",
    "http://x.net/fr/q", "http://net/es/", "http://org", "http://q.a.org/xx", "http://a.org/x/yz/w", "http://a.org/x/", "http://a.org/z",
    "http://c.b.org/p/1", "http://b.org/p", "http://h.info/evil/x", "http://h.info?a=/evil", "http://twin.net/a", "http://a://b.com/c",
    "http://example.com#/en/", "http://user@example.com/en/1", "http://example.com:80/en/1", "http://x..com//", "http://é.com/é", "a\n://x.net/es/\nb",
    "http://" + "s." * 500 + "example.com/en/" + "d/" * 500,
]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, action in rules:
        h, p = (h or "").lower(), p or ""
        if (not h or host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h), len(p), action)
            best = max(best, (key, h + p, action)) if best else (key, h + p, action)
    return host, path, best and best[1], best[2] if best else default


@pytest.mark.parametrize("trie_rules", [100, 0])
def test_same_as_every_rule(spark, trie_rules):
    pages = spark.createDataFrame([(k, u, "x", 1) for k, u in enumerate(URLS + URLS[5:9])], "page_id long, url string, rule string, action int")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    rows = urls.judged(pages, rules, trie_rules=trie_rules).collect()
    assert len(rows) == len(URLS) + 4
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, RULES), r.url


@pytest.mark.parametrize("trie_rules", [100, 0])
def test_no_rules_and_empty(spark, trie_rules):
    pages = spark.createDataFrame([(1, "http://a.com/b")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    row = urls.judged(pages, rules.limit(0), default="block", trie_rules=trie_rules).first()
    assert (row.rule, row.verdict) == (None, "block")
    assert urls.judged(pages.limit(0), rules, trie_rules=trie_rules).count() == 0


def test_query(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op2_url_filter(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute(pages[r.page_id], queries.URL_RULES)
