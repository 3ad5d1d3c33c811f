from pyspark.sql import functions as F

from tallyspark.llm import url_filter as u


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
        rest = rest[k:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest] + [len(rest)])]
    fits = [(len(h + p), h + p, v) for h, p, v in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


ODD = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x?q#f", "a://b://c/d", "https://example.org", "https://example.org/en/12?x=/es/", "https://fexample.org/es/",
       "http://org/x", "http://a.com/fr/", "http://a.com/de/1", "http://ÄÖ.COM/de/", "http://x.net#a/b", "http://x.net?y/z", "http://h\nost.com/\nfr/", "https://a.b.com/fr", "://h/p"]


def test_hosts_paths_and_fixed_rules(spark):
    pages = spark.createDataFrame(list(enumerate(ODD)) + [(3, ODD[4]), (None, ODD[5])], "page_id long, url string").withColumn("Host", F.lit("clash"))
    rows = u.url_filter(pages, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        host, path, (rule, verdict) = brute(r.url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_mined_rules(spark):
    urls = [f"https://{'www.' if i % 2 else ''}{'cheap-pills' if i % 5 == 0 else f'site{i % 7}'}.example.net/{'buy' if i % 3 == 0 else 'read'}/{i}?ref=x" for i in range(900)]
    bad = [i % 5 == 0 and i % 3 == 0 for i in range(900)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b)) for i, b in enumerate(bad) if i % 2 == 0], "doc_id long, quality int")
    rules = [set(r.rule) for r in u.mine(pages, labels).collect()]
    assert {"h=pills", "p=buy"} in rules and all({"p=buy"} < r for r in rules)
    for r in u.url_filter(pages, labels).collect():
        assert r.verdict == ("block" if bad[r.page_id] else "allow") and (r.mined is None) == (not bad[r.page_id])
    plain = u.url_filter(pages, labels)
    assert "Python" not in plain._jdf.queryExecution().toString() and "Arrow" not in plain._jdf.queryExecution().toString()
    assert u.url_filter(pages.limit(0), labels).count() == 0


def test_rules_mined_from_what_the_fixed_rules_say(spark):
    urls = [f"https://s{i % 9}.{('net', 'com', 'info')[i % 3]}/{('de', 'fr', 'en')[i // 3 % 3]}/{i}" for i in range(900)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = u.rule_labels(pages)
    want = {i: v for i, x in enumerate(urls) if (v := brute(x)[2][1])}
    assert {r.doc_id: "allow" if r.quality else "block" for r in labels.collect()} == want
    rows = u.url_filter(pages, labels).collect()
    mined = [r for r in rows if r.mined]
    assert mined and all(r.rule is None and r.verdict == "block" and "/de/" in r.url for r in mined)
    assert {r.page_id for r in mined} == {i for i, x in enumerate(urls) if i not in want and "/de/" in x}
