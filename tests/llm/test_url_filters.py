import re
from collections import Counter

from tickloom.llm import url_filters as u


def brute(url, rules):
    host = path = ""
    best = None
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    for h, p, verdict in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best[0] if best else None, best[1] if best else None


def test_contract_equals_brute_force(spark):
    odd = [None, "", "no scheme", "http://a.net", "http://net/", "HTTP://EXAMPLE.NET/en/x", "http://x.org/fr/?q", "http://xexample.com/de/", "http:///net/", "foo://a.net:80/", "http://q.net/a://b/", "http://a.net/\n/x", "x://ÄÖ.net/"]
    pages = spark.createDataFrame([(i, x) for i, x in enumerate(odd + odd[:4])] + [(None, odd[4])], "page_id long, url string")
    pages = pages.unionByName(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")).selectExpr("*", "1 AS host", "2 AS verdict", "3 AS pattern", "4 AS token")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in u.contract(spark, pages).collect())
    assert got == Counter((r.page_id, *brute(r.url, u.CONTRACT_RULES)) for r in pages.collect())


def test_method_patterns_and_default(spark):
    urls = {"http://a.b/x/ads/y": "block", "http://ads.x.com/": "block", "http://a.b/readsx/": "allow", "http://a.b/x.zip": "block", "http://a.b/x.zipper": "block", "http://a.b/ads": "allow", None: "block"}
    pages = spark.createDataFrame([(k, x) for k, x in enumerate(urls)], "page_id long, url string")
    got = {r.url: r.verdict for r in u.judge(pages, u.rules_table(spark, [], True)).collect()}
    assert got == urls


def test_empty(spark):
    assert u.contract(spark, spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_rules_are_filed_under_their_rarest_token(spark):
    addresses = spark.createDataFrame([("a.net", "/x/"), ("b.net", "/y/"), ("b.net", "/z/")], "host string, path string")
    rules = u.rules_table(spark, [("net", "/y/", "block"), ("b.net", "/", "allow"), ("", "*x", "block")], True)
    assert {r.rule: r.token for r in u.index(rules, addresses).collect()} == {"net/y/": "y", "b.net/": "b", "*x": ""}
