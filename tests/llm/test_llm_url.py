import random

from tickloom.llm import url_filter


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fit = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[4]) if fit else (host, path, None, default)


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", ""),
         ("block", "a.net", "/pa"), ("allow", "org", "/x"), ("block", "b.org", "/")]


def test_verdicts_equal_a_loop(spark):
    r = random.Random(2)
    hosts = ["example.com", "www.EXAMPLE.com", "x.a.net", "net", "b.org", "c.b.org", "notexample.com", "", "a..net", "日本.org"]
    paths = ["", "/", "/en/", "/en", "/en/x?y=/es/", "/es/#a", "/pab", "?q", "#f", "/x/é"]
    urls = [None, "", "no scheme", "://", "http://", "a://b://c.com/"] + [f"http://{r.choice(hosts)}{r.choice(paths)}" for _ in range(150)]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    out = url_filter.judge(pages, url_filter.rules_frame(spark, RULES))
    assert out.columns == [*pages.columns, "_judged"]
    got = {x.page_id: tuple(x._judged) for x in out.collect()}
    assert got == {i: brute(u, RULES) for i, u in enumerate(urls)}
    assert url_filter.judge(pages.where("false"), url_filter.rules_frame(spark, RULES)).count() == 0


def test_no_rules_and_repeated_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/")], "page_id long, url string")
    assert [x._judged.verdict for x in url_filter.judge(pages, url_filter.rules_frame(spark, RULES).where("false"), default="block").collect()] == ["block"] * 2
    twice = url_filter.rules_frame(spark, [("allow", "com", "/"), ("block", "com", "/")])
    assert [x._judged.verdict for x in url_filter.judge(pages, twice).collect()] == ["block"] * 2


def test_very_long_hosts(spark):
    urls = [f"http://{'a.' * 40_000}com/x", f"http://{'.'.join(map(str, range(20_000)))}.b.org/", "http://" + "x" * 100_000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {x.page_id: x._judged for x in url_filter.judge(pages, url_filter.rules_frame(spark, RULES)).collect()}
    assert [got[i].rule for i in range(3)] == ["com/", "b.org/", None] and all(tuple(got[i]) == brute(u, RULES) for i, u in enumerate(urls))
