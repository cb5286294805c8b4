import random

from ledgerline.llm import url_filter as uf


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]
    fits = []
    for rule, verdict in rules:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), len(h), rule, verdict))
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge(pages, spark.createDataFrame(rules, "rule string, verdict string")).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_edges(spark):
    check(spark, [None, "", "no scheme", "http://", "http://NET/", "http://net", "http://a.b.net/x?y#z", "ftp://example.net/en/", "http://example.net/en", "http://xexample.com/de/", "x://example.com/de/a://b", "http://a.org?q", "http://ä.org/fr/é"], uf.RULES)


def test_nested_rules_over_many_ranges_and_a_hot_key(spark):
    rng = random.Random(3)
    hosts = ["net", "a.net", "b.a.net", "ab.net", "com", "x.com", "y.x.com", "org"]
    paths = ["/", "/a", "/a/", "/a/b", "/a/b/c", "/ab"]
    rules = [(h + p, rng.choice(["allow", "block"])) for h in hosts for p in paths if rng.random() < 0.5]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '/q', 'x', '?a'])}" for _ in range(500)] + ["http://b.a.net/a/b"] * 400
    check(spark, urls, rules)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "rule string, verdict string")
    assert uf.judge(pages, rules).count() == 0
    check(spark, ["http://a.net/"], uf.RULES)
