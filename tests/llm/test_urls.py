"""URL verdicts against plain string rules; the filter may pass too much but never too little."""

from pyspark.sql import functions as F

from turnwise.llm import queries, urls

ROWS = [(1, "http://www.Example.ORG/es/1?x=1"), (2, "https://a.example.org/en/12#t"), (3, "http://example.org"), (4, None), (5, "no scheme/x"),
        (6, "http://x.com/fr/a/"), (7, "http://m.ads-x.com/en/9.html?utm=1"), (8, "https://www.ads-x.com/en/9"), (9, "http://x.com/en/9"),
        (10, "HTTP://EXAMPLE.org?q"), (11, "http://notexample.org/es/1"), (11, "http://notexample.org/es/1"), (12, ""), (13, "a://b://c/d"),
        (14, "http://x.com/de/%C3%9F ü\n?z"), (15, "http://ads-x.com/en/9/")]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest[:min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host):]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fit = [(len(h + p), h + p, says) for says, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_hosts_paths_rules_and_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "?", "?") for i, u in ROWS], "page_id long, url string, host string, key string")
    listed = spark.createDataFrame([("http://ads-x.com/en/9",), ("http://ads-x.com/en/9",), (None,)], "url string")
    got = urls.judge(pages, listed, queries.RULES).collect()
    assert len(got) == len(ROWS)
    for r in got:
        url = next(u for i, u in ROWS if i == r.page_id)
        host, path = plain(url)
        name, says = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name)
        assert r.verdict == (says or ("block" if r.page_id in (7, 8, 15) else "allow"))
    assert urls.judge(pages.filter("false"), listed, queries.RULES).collect() == []
    assert {r.verdict for r in urls.judge(pages, listed.filter("false"), queries.RULES).filter("rule is null").collect()} == {"allow"}


def test_filter_loses_no_listed_key_and_the_join_removes_the_false_ones(spark, monkeypatch):
    keys = spark.range(20_000).select(F.concat(F.lit("u"), "id").alias("key"))
    listed = keys.filter("substr(key, 2) % 7 = 0")
    want = {f"u{i}" for i in range(0, 20_000, 7)}
    for limit, bits in ((32 << 20, 16), (0, 16), (0, 1)):  # broadcast; joined by block; a filter that passes nearly all
        monkeypatch.setattr(urls, "FILTER_LIMIT", limit)
        got = urls.listed_urls(keys, listed, bits_per_key=bits)
        assert got.count() == 20_000
        assert {r.key for r in got.filter("hit").collect()} == want


def test_no_python_in_the_plan(spark, pages):
    plan = urls.judge(pages, pages, queries.RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
