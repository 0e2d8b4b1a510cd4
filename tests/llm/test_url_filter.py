import random
import re

from claimspark.llm.url_filter import url_filter

RULES = "host string, path string, verdict string"


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_against_every_rule(spark):
    draw = random.Random(4)
    hosts = ["com", "b.com", "a.b.com", "x.net", "net", "c.org"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/é", "/a/bc/d"]
    rules = [*{(draw.choice(hosts), draw.choice(paths)): None for _ in range(30)}]
    rules = [(h, p, draw.choice(["allow", "block"])) for h, p in rules]
    urls = [f"http{draw.choice(['', 's'])}://{draw.choice(['', 'www.', 'A.', 'q.r.'])}{draw.choice(hosts + ['bcom', 'other'])}{draw.choice(paths)}{draw.choice(['', 'z', '?q=/a', '#x'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "://x.net/a", urls[0], "https://[::1]:80/a", "http://net./a", "http://x..net/a"]
    rows = [(None if i == 7 else i // 2, u, "h", "p") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string")
    got = sorted((tuple(r) for r in url_filter(pages, spark.createDataFrame(rules, RULES)).collect()), key=str)
    assert got == sorted(((i, *judge(u, rules)) for i, u, _, _ in rows), key=str)


def test_no_rules_no_pages_and_bad_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = spark.createDataFrame([], RULES)
    assert [tuple(r) for r in url_filter(pages, none, default="block").collect()] == [(1, "a.com", "/x", None, "block")]
    assert url_filter(pages.limit(0), none).count() == 0
    rules = spark.createDataFrame([("a.com", "/", "allow"), ("a.com", "/", "block"), (None, "/", "block"), ("com", None, "block")], RULES)
    assert [tuple(r)[3:] for r in url_filter(pages, rules).collect()] == [("a.com/", "block")]


def test_hosts_of_very_many_labels(spark):
    """Each parent domain of such a host would be a row of up to its whole length."""
    long = "a." * 100_000 + "b.com"
    deep = "x." * 300 + "org"
    rules = [("b.com", "/p", "block"), ("com", "/", "allow"), (deep, "/", "block")]
    urls = [f"http://{long}/p/q", f"http://{long}/z", "http://com/", f"http://y.{deep}/", f"http://{deep[2:]}/", "http://" + "." * 50_000 + "/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(tuple(r) for r in url_filter(pages, spark.createDataFrame(rules, RULES)).collect())
    assert got == [(i, *judge(u, rules)) for i, u in enumerate(urls)]
