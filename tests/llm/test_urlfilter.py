import random

from tandemlake.llm import urlfilter as u

URLS = [
    None, "", "nothing", "http://", "https://EXAMPLE.net/en/1", "http://a.b.example.net/en", "http://example.net/de/?q=://x", "http://xexample.net/",
    "http://net", "http://net/", "ftp://user@example.net/x", "http://example.com/de/a#b", "http://example.com/fr/", "x://www.example.org/fr/?a",
    "http://org/fr/", "http://example.net:8080/en/", "http://a..net/", "http://.net/", "line\nbreak://example.net/en/\nx?y", "http://ünï.net/", "http://example.com?de/",
]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def check(spark, urls, rules):
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(urls)], "page_id bigint, url string, rule string")
    got = u.match_urls(df, u.rules_frame(spark, rules)).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(urls[r["page_id"]], rules), urls[r["page_id"]]


def test_contract_rules(spark):
    check(spark, URLS * 3, u.RULES)


def test_many_nested_rules_and_sweeps(spark, monkeypatch):
    monkeypatch.setattr(u, "ROWS_PER_SWEEP", 20)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "a-b.com", "aa.com", "net", "a.net"]
    rules = [("block" if (i + j) % 2 else "allow", h, p) for i, h in enumerate(hosts) for j, p in enumerate(("", "/", "/x", "/x/y"))]
    urls = [f"http://{h}{p}" for h in ["c.b.a.com", "z.c.b.a.com", "b.a.com", "xa.com", "a-b.com", "b.aa.com", "www.a.net", "org"] for p in ("", "/", "/x", "/x/y/z", "?q")] + URLS
    check(spark, urls, rules)


def test_rules_in_ranges(spark, monkeypatch):
    """More rules than a sweep takes: each range sees its own rules and those that enclose its first key."""
    monkeypatch.setattr(u, "ROWS_PER_SWEEP", 7)
    rng = random.Random(4)
    labels = ["a", "b", "c", "net", "x-y", "é", ""]
    hosts = sorted({".".join(rng.choice(labels) for _ in range(rng.randint(1, 5))) for _ in range(120)})
    rules = [(rng.choice(["block", "allow"]), h, rng.choice(["", "/", "/p"])) for h in hosts]
    urls = [f"http://{'.'.join(rng.choice(labels) for _ in range(rng.randint(1, 6)))}{rng.choice(['', '/', '/p/q', '?x'])}" for _ in range(300)]
    check(spark, urls + ["http://b.net/p"] * 60, rules)


def test_columns_that_clash_in_another_case(spark):
    df = spark.createDataFrame([(1, "http://a.net/", "x")], "page_id bigint, url string, Host string")
    got = u.match_urls(df, u.rules_frame(spark))
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and got.first()["host"] == "a.net"


def test_no_rules_and_no_rows(spark):
    check(spark, URLS, [("allow", None, "/")][:0] or [("block", "nowhere", "/")])
    none = u.rules_frame(spark).filter("false")
    df = spark.createDataFrame([(1, "http://net/")], "page_id bigint, url string")
    assert u.match_urls(df, none, default="block").first()["verdict"] == "block"
    assert u.match_urls(df.filter("false"), u.rules_frame(spark)).count() == 0
