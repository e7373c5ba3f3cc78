import random

from tessera.llm import url_filter
from tessera.llm.queries import RULES


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.key), len(r.host), r.verdict == "block"), default=None)
    return host, path, best and best.key, best.verdict if best else default


URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/1?x=/en/", "http://www.Example.COM/en/", "http://a.www.example.com/en/x/y#z", "http://notexample.com/en/q", "ftp://x.net/es/", "ftp://net/fr/a/b",
        "http://x.net/es", "http://com", "http://com/", "http://x.com?y/", "a://b://c.com/en/", "http://.com/en/", "http://x.net//es/", "http://ÄB.com/en/", "http://x.com:80/", "http://example.com/en/\nx"]


def check(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, rules).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_against_brute_force(spark):
    check(spark, URLS, RULES)
    check(spark, URLS, [])
    check(spark, URLS, RULES[:1])
    rng = random.Random(2)
    part = lambda: rng.choice("abc")
    rules = list({(h, p): url_filter.Rule(rng.choice(["allow", "block"]), h, p) for h, p in ((".".join(part() for _ in range(rng.randrange(1, 4))), "/" + "".join(part() + "/" for _ in range(rng.randrange(3)))) for _ in range(40))}.values())
    check(spark, ["x://" + ".".join(part() for _ in range(rng.randrange(1, 5))) + "/" + "/".join(part() for _ in range(rng.randrange(4))) for _ in range(400)], rules)


def test_many_rules(spark):
    check(spark, URLS, [url_filter.Rule("block", f"h{i}.com") for i in range(5000)] + RULES)


def test_filters_of_many_rules_are_literals_of_a_plan_without_joins(spark):
    listed = {f"h{i}.com/" for i in range(0, 300_000, 2)}
    rules = [url_filter.Rule("block", k[:-1]) for k in sorted(listed)]
    df = spark.range(20_000).selectExpr("id AS page_id", "concat('http://a.h', id * 7, '.com/x') AS url")
    found = url_filter.judge(df, rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "json" not in plan.lower()
    got = {r["page_id"]: r["verdict"] for r in found.collect()}
    assert all(got[i] == ("block" if f"h{i * 7}.com/" in listed else "allow") for i in range(20_000))


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, RULES).collect()}
    assert got == {r["page_id"]: plain(r["url"], RULES) for r in pages.collect()}


def test_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(3000).selectExpr("concat('k', id) as key")
    listed = spark.range(0, 3000, 7).selectExpr("concat('k', id) as key")
    levels = url_filter.cascade(listed, universe, listed.count(), 3000)
    got = {r["key"] for r in universe.where(url_filter.listed_in(levels, universe["key"])).collect()}
    assert len(levels) > 2 and got == {r["key"] for r in listed.collect()}
