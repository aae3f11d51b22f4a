"""The url filter against a plain second computation."""

import random

import pytest

from tidemark.llm import url_filter

RULES = [(r.verdict, *r.text.partition("/")[::2]) for r in url_filter.RULES]


def plain(url):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + "/" + p), f"{h}/{p}", v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def urls():
    rng = random.Random(8)
    out = [None, "", "://", "a://", "http://COM", "http://com/", "x://EXAMPLE.com/en/?a", "http://www.example.com/en/#", "http://wwwexample.com/en/", "no scheme/com/", "h://a://b.net/es/", "http://é.NET/fr/ñ?x=1&y=2", "h://net/es", "h://x.net#/es/"]
    for _ in range(250):
        host = ".".join(rng.choice(["www", "Example", "example", "a-b", "x9", "shop"]) for _ in range(rng.randint(0, 3))) + rng.choice([".com", ".net", ".org", "net", ".CO"])
        out.append(rng.choice(["http", "https", "ftp"]) + "://" + host + rng.choice(["", "/", "/en/", "/es/", "/fr/x", "/en"]) + rng.choice(["", "?q=1", "#f", "/es/", "?a=1&b=/fr/"]))
    return out


@pytest.mark.parametrize("few", [100_000, 0])
def test_rules_and_verdicts(spark, monkeypatch, few):
    monkeypatch.setattr(url_filter, "SMALL_SUFFIXES", few)
    rows = [(None if k % 50 == 3 else k, u, "x", k) for k, u in enumerate(urls() + urls()[:5])]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, suffix string, label int"), trees=3).collect()
    want = sorted(((d, *plain(u)) for d, u, _, _ in rows), key=repr)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got), key=repr) == want
    assert all(r.verdict == ("allow" if r.score >= 0.5 else "block") for r in got if not r.rule)


def test_a_suffix_that_is_broadcast_or_dealt(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(urls())), "page_id long, url string")
    a = {(r.page_id, r.verdict, round(r.score, 9)) for r in url_filter.judge(df, trees=3).collect()}
    monkeypatch.setattr(url_filter, "SMALL_SUFFIXES", 0)
    assert a == {(r.page_id, r.verdict, round(r.score, 9)) for r in url_filter.judge(df, trees=3).collect()}


def test_no_urls_or_one_verdict(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty).count() == 0
    only = spark.createDataFrame([(1, "h://a.com/"), (2, "h://a.org/")], "page_id long, url string")
    assert {r.verdict for r in url_filter.judge(only).collect()} == {"allow"}
