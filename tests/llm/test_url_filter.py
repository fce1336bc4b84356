import re

from pyspark.sql import functions as F

from tracelake.llm import url_filter
from tracelake.llm.url_filter import RULES, Trees


def expected(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


URLS = [None, "", "nothing", "http://a.example.org/en/12?x=/es/", "HTTP://Example.ORG/es/1", "http://example.org", "https://xcom/fr/", "ftp://shop.COM/de/a#b", "http://a.com?x=http://b.org/", "://org/", "http://É.example.org/en/2", "x://a://b.org/", "http://notexample.org/es/", "http://a.net/" + "9" * 50000]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, 1, "h") for i, u in enumerate(URLS)] + [(None, URLS[3], 1, "h")], "page_id long, url string, score int, host string")
    for r in url_filter.judge(pages, how=Trees(rounds=2)).collect():
        host, path, rule, verdict = expected(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and 0 <= r.score <= 1
        assert verdict is None or r.verdict == verdict


def test_no_labels_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert [(r.verdict, r.score) for r in url_filter.judge(pages).collect()] == [("allow", 0.0)]
    assert url_filter.judge(pages.where("false")).count() == 0


def test_trees_learn_from_labelled_urls(spark):
    rows = [(i, f"https://{'bad' if i % 3 == 0 else 'good'}{i % 7}.site.net/{'win' * (i % 3 == 0)}{i}?a=1&b={i}", int(i % 3 == 0)) for i in range(900)]
    frame = spark.createDataFrame(rows, "row long, url string, blocked int")
    host, path = url_filter.host_path(F.col("url"))
    frame = frame.withColumns({"host": host, "path": path})
    model = url_filter.train(frame.where("row < 600"), Trees(rounds=5))
    held = url_filter.score(frame.where("row >= 600"), model).collect()
    assert sum((r.score >= 0.5) == bool(r.blocked) for r in held) / len(held) > 0.95
