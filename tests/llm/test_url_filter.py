"""op7 against brute force, and its filter's false positives."""

from pyspark.sql import functions as F

from pairwell.llm import url_filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b", "", "block")]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fit = [(-len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, min(fit)[1] if fit else None, min(fit)[2] if fit else "allow")


URLS = [None, "", "no scheme", "http://", "HTTP://Foo.NET", "http://foo.net/", "http://net/x", "http://x.net?y=/", "http://example.net/en/a", "https://www.example.net/en", "http://notexample.net/en/", "http://a.example.com/de/1#x", "http://example.com/dex", "http://q.org/fr/", "http://q.org/fr", "x://a.b", "http://c.a.b/q", "http://a://b.net/", "http://é.NET/é", "http://x..net/", "http://foo.net:80/"] + ["http://hot.net/a"] * 300 + ["http://" + "s." * 300 + "net/" + "p" * 5000]


def test_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for blocks in (1, 1 << 16):  # with one block nearly everything passes the filter
        found = {r[0]: tuple(r[1:]) for r in url_filter.url_verdicts(pages, rules, blocks=blocks).collect()}
        assert found == {i: brute(u) for i, u in enumerate(URLS)}


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in url_filter.url_verdicts(pages, rules).collect()] == [(1, "a.net", "/", None, "allow")]
    assert url_filter.url_verdicts(pages.limit(0), spark.createDataFrame(RULES, rules.schema)).count() == 0


def test_false_positives_pass_the_filter_and_not_the_join(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 97}.d{i}.net/p{i % 7}/x") for i in range(400)] + [(1000 + i, "http://hot.org/a") for i in range(50)], "page_id long, url string")
    listed = [(f"d{i}.net", f"/p{i % 5}/", "block") for i in range(0, 400, 3)] + [("hot.org", "/", "allow")]
    rules = spark.createDataFrame(listed, "host string, path string, verdict string")
    pairs = pages.select(*[c.alias(n) for c, n in zip(url_filter.host_and_path(F.col("url")), ("host", "path"), strict=True)], F.lit(1).alias("n")).distinct()
    renamed = rules.toDF("r_host", "r_path", "v").select("r_host", "r_path")
    few, many = (url_filter.candidates(pairs, renamed, [1, 4], blocks).select("c_host", "c_path").distinct() for blocks in (2, 1 << 16))
    exact = {(h, p) for h, p, _ in listed}
    assert few.count() > many.count() >= len(exact & set(map(tuple, many.collect())))
    found = {r.page_id: r.rule for r in url_filter.url_verdicts(pages, rules, blocks=2).collect()}
    assert found == {i: f"d{i}.net/p{i % 5}/" if i % 3 == 0 and i % 7 == i % 5 else None for i in range(400)} | {1000 + i: "hot.org/" for i in range(50)}


def test_any_number_of_path_lengths(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_LENGTHS", 1)
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert {r[0]: tuple(r[1:]) for r in url_filter.url_verdicts(pages, rules).collect()} == {i: brute(u) for i, u in enumerate(URLS)}


def test_common_urls_without_a_rule_are_broadcast(spark):
    pairs = spark.createDataFrame([("hot.zz", "/x", 5000), ("a.net", "/", 900), ("rare.zz", "/", 1)], "host string, path string, n long")
    judged = spark.createDataFrame([("a.net", "/", "net/", "block")], "j_host string, j_path string, rule string, v string")
    found = url_filter.common_verdicts(pairs, judged, 10000).collect()
    assert sorted(map(tuple, found)) == [("a.net", "/", "net/", "block"), ("hot.zz", "/x", None, None)]
    pages = spark.createDataFrame([(k, "http://hot.zz/x") for k in range(500)] + [(500, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    got = url_filter.url_verdicts(pages, rules).groupBy("host", "rule", "verdict").count().collect()
    assert sorted(map(tuple, got)) == [("a.net", "net/", "block", 1), ("hot.zz", None, "allow", 500)]
