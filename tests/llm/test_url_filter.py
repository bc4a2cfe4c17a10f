from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from cohortlake.llm import url_filter as uf
from cohortlake.llm.queries import HOST_RULES, PATTERN_RULES

SCHEMA = "page_id bigint, url string, rule string, host string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(url, rules, patterns, default="allow"):
    host, path = split(url)
    fits = []
    for rule, action in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((-len(rule), rule, action))
    if fits:
        _, rule, action = min(fits)
        return host, path, rule, None, action
    fits = [(-len(n), n, a) for n, a, p, _ in patterns if url is not None and re.search(p, url)]
    if fits:
        return host, path, None, min(fits)[1], min(fits)[2]
    return host, path, None, None, default


RULES = [*HOST_RULES, ("a.b/x", "block"), ("c(d.e/\\E.*", "allow"), ("b/", "block"), ("b/é/", "allow"), ("b/xy/z", "allow")]


def urls():
    rng = random.Random(1)
    fixed = [None, "", "net/", "http:/example.net/en/", "http://net", "http://net/", "HTTP://A.NET/EN/", "x://EXAMPLE.net/en/q",
             "x://notexample.net/en/", "x://a.example.com/de/1?page=2", "x://a.example.com/de", "x://example.com/?page=7",
             "x://y/login", "x://y/Login#a", "x://y/loginx", "y;jsessionid=1", "x://a.b/xylo", "x://q.a.b/x", "x://c(d.e/\\E.*1",
             "x://b/é/a", "x://B/É/a", "x://b/xy/zoo", "x://net:80/", "x://u@net/", "x://net?a=/", "x://org/fr/://net/", "x://a.b\n/x",
             "x://org/fr/" + "a/" * 20000]
    parts = ["example", "net", "com", "org", "a", "b", ".", ".", "/", "/", "en", "de", "fr", "?", "#", "page=1", "x", "NET"]
    return fixed + ["http://" + "".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(300)]


def test_against_every_rule_on_every_url(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls())]
    rows += [rows[5], (None, "x://b.net/", None, None)]
    rules = uf.host_rules(spark, RULES).unionByName(uf.pattern_rules(spark, PATTERN_RULES))
    got = uf.judge_urls(spark.createDataFrame(rows, SCHEMA), rules).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(
        str((i, u, *brute(u, RULES, PATTERN_RULES))) for i, u, *_ in rows
    )


def test_filed_under_the_rarest_literal(spark):
    rules = uf.host_rules(spark, [("example.net/en/", "block"), ("net/", "allow"), ("b.c/de", "block"), ("b.c/de-at/x", "block")])
    pages = [("x://example.net/en/",), ("x://example.net/fr/",), ("x://example.org/en/",), ("x://net/en/",), ("x://c/",)]
    found = spark.createDataFrame(pages, "url string").withColumn("tokens", uf.tokens_of(F.col("url")))
    got = {r.rule: r.token for r in uf.rule_index(rules, found).collect()}
    assert got["net/"] == "net" and got["example.net/en/"] in ("example", "en", "net")
    assert got["b.c/de"] == "b" and got["b.c/de-at/x"] in ("at", "b", "de")


@pytest.mark.parametrize("rules", [[], list(HOST_RULES)])
def test_empty(spark, rules):
    frame = uf.pattern_rules(spark, [])
    if rules:
        frame = frame.unionByName(uf.host_rules(spark, rules))
    pages = spark.createDataFrame([(1, "x://q/", "", "")], SCHEMA)
    assert [r.verdict for r in uf.judge_urls(pages, frame).collect()] == ["allow"]
    assert uf.judge_urls(pages.limit(0), frame).collect() == []
