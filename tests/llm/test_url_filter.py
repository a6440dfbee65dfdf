import re

from corpusloom.llm import url_filter as U


def brute(url):
    at = (url or "").find("://")
    host = path = ""
    if at >= 0:
        rest = url[at + 3:]
        cut = re.search(r"[/?#]", rest)
        host = rest[: cut.start()] if cut else rest
        path = re.match(r"[^?#]*", rest[len(host):], re.S)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in U.BASE if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        best = min(fits, key=lambda x: (-x[0], x[1]))
        return host, path, best[1], best[2]
    blocked = any(re.search(regex, host + path) for _, regex, _ in U.PATTERNS)
    return host, path, None, "block" if blocked else "allow"


URLS = ["http://example.org/es/1", "https://a.b.Example.ORG/es/x?y=1", "https://notexample.org/es/", "http://example.org/en/1", "http://example.org/en/12#t",
        "http://example.org/en/2", "http://example.org", "http://org/", "http://x.org?a", "http://x.com/fr/", "http://x.com/de/a", "http://com/de/", "http://x.com/FR/",
        "http://xcom/de/", "ftp://h/p://q/", "no scheme", "", None, "://", "http://", "http://casino-win.example.net/en/1", "http://m.my-casino.com/de/", "http://casinos.net/",
        "http://ads.example.net/x", "http://ads-track.example.com/fr/", "http://heads.example.net/", "http://x.net/a/torrent/b", "http://x.net/torrents/b",
        "HTTP://WWW.X.COM/de/é\n/z", "http://user:p@x.org:80/en/", "http://adult.net", "http://free-bets.example.net/?q"]


def test_urls_equal_brute_force(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS)], "page_id long, url string, verdict string")
    out = U.filter_urls(df, U.rules(spark)).collect()
    assert len(out) == 2 * len(URLS)
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == brute((URLS + URLS)[r.page_id]), r


def test_pages_table_and_empty_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = U.filter_urls(pages, U.rules(spark)).join(pages.select("page_id", "url"), "page_id").collect()
    assert len(out) == pages.count() and all((r.host, r.path, r.rule, r.verdict) == brute(r.url) for r in out)
    assert U.filter_urls(pages.limit(0), U.rules(spark)).count() == 0


def test_each_rule_is_filed_under_its_rarest_token(spark):
    df = spark.createDataFrame([("http://a.com/fr/",), ("http://b.com/de/",), ("http://c.com/de/",)], "url string")
    urls = df.select("url", U.F.concat(U.host(U.F.col("url")), U.path(U.F.col("url"))).alias("target"))
    tokens = urls.select("url", U.F.explode(U.tokens(U.F.col("target"))).alias("token"))
    rules = U.rules(spark, [("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "com", "/xx/")], [("block", "^a", [])])
    assert {r.rule: r.token for r in U.index(rules, tokens).collect()} == {"com/fr/": "fr", "com/de/": "de", "com/xx/": "xx", "^a": ""}


def test_rule_without_literal_is_tried_on_every_url(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.net/")], "page_id long, url string")
    out = U.filter_urls(df, U.rules(spark, [], [("block", "^a", [])])).collect()
    assert {r.page_id: r.verdict for r in out} == {1: "block", 2: "allow"}


def test_plan_has_no_python(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = U.filter_urls(pages, U.rules(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
