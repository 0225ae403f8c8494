import re

import numpy as np

from tideline.llm import url_filter as u

URLS = [
    None, "", "no scheme here", "http://", "https://Example.ORG/es/1", "http://sub.example.org/en/1x", "http://a.org", "http://a.org?x=/y",
    "http://notorg/fr/", "ftp://x.com/fr/1?u=://b", "http://com/de/", "http://x.com#/fr/", "HTTP://X.COM:80/de/", "http://é.com/fr/",
    "http://example.org/en/2", "http://x.net/" + "a" * 40_000,
]


def expected(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def pages(spark, urls):
    return spark.createDataFrame([(i, url, "h", "p", 1.0) for i, url in enumerate(urls)],
                                 "page_id long, url string, host string, rule string, features double")


def test_rules(spark):
    got = u.digest_rows(pages(spark, URLS + URLS[:3]))
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())
    for r in got.collect():
        host, path, rule, verdict = expected((URLS + URLS[:3])[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert u.digest_rows(pages(spark, [])).count() == 0


def test_without_both_kinds(spark):
    for urls, verdict in ((["http://a.net/1"], "allow"), (["http://a.com/de/1", "http://b.net/x"], "block")):
        assert {r["verdict"] for r in u.digest_rows(pages(spark, urls)).collect()} == {verdict}


def test_regression_tells_kinds_apart(spark):
    urls = [f"http://{'casino' if i % 2 else 'library'}{i * 7919 % 1000}.example/{'bonus' if i % 2 else 'books'}/{i}" for i in range(400)]
    rows = [(i, url, "block" if i % 2 else "allow") for i, url in enumerate(urls)]
    df = spark.createDataFrame(rows, "i int, url string, verdict string")
    model = u.learn(df.where("i < 200"))
    got = u.judge(df.where("i >= 200"), model).select("row.verdict", "block_probability").collect()
    assert np.mean([(r[1] >= 0.5) == (r[0] == "block") for r in got]) > 0.98


def test_verdicts_of_the_given_rules(spark):
    # the rules are written out here, apart from the module's constant
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    urls = ["http://a.org/x", "http://m.example.org/es/2", "http://www.example.org/en/14?p=2", "https://example.org/en/1", "http://x.com/fr/1",
            "http://x.com/de/1", "http://example.org/en/2"]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in u.digest_rows(pages(spark, urls)).collect()}
    expect = ["org/", "example.org/es/", "example.org/en/1", "example.org/en/1", "com/fr/", "com/de/", "org/"]
    assert got == {i: (rule, rules[rule]) for i, rule in enumerate(expect)}
    assert {h + p: v for h, p, v in u.RULES} == rules
