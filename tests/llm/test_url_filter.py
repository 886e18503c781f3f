import itertools
import random

from concordat.llm import url_filter as U

PAGES = "page_id long, url string, html string, host string, verdict string"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    best = None
    for action, h, p in rules:
        h = h.lower()
        if (host or path) and (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h.split(".")) if h else 0, len(p), action == "block")
            best = max(best, (key, h, p, action)) if best else (key, h, p, action)
    return (host, path, best[1] + best[2] if best else None, best[3] if best else default)


def urls():
    rnd = random.Random(1)
    hosts = ["net", "x.net", "example.net", "a.example.NET", "notexample.net", "example.com", "m.example.com", "org", "b.org", "example.net:80", "", "net.", "u@x.net"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/english", "/de/1", "/fr/?q=://", "/fr#x", "?a=/en/", "//en/"]
    out = [f"{s}://{h}{p}" for s, h, p in itertools.product(["http", "HTTPS", ""], hosts, paths)]
    return out + [None, "", "no scheme", "x.net/en/", "a://b://net/", "http://x.net/\n/en/"] + [rnd.choice(out) for _ in range(30)]


def run(spark, rules, **kw):
    rows = [(i, u, "h", "clash", "clash") for i, u in enumerate(urls())]
    found = U.filter_urls(spark.createDataFrame(rows, PAGES), rules, **kw).orderBy("page_id").collect()
    return [tuple(r)[1:] for r in found]


def test_contract_rules(spark):
    assert run(spark, RULES) == [brute(u, RULES) for u in urls()]


def test_many_rules_by_trie_and_by_join(spark, monkeypatch):
    rules = [*RULES, ("block", "", "/english"), ("allow", "a.example.net", "/en"), ("block", "a.example.net", "/en"), ("block", "ORG", "/f"), ("allow", "com", "/"), ("block", "b.org", "/fr/")]
    rules += [("block", "Example.NET", "/en/"), ("allow", "example.net", "/EN/"), ("allow", "example.net", "/en/x"), ("allow", "COM", "/"), ("block", "u@x.net", "")]
    want = [brute(u, rules) for u in urls()]
    odd = [*rules, (None, "net", "/en"), ("block", None, "/"), ("block", "org", None)]  # left out
    assert run(spark, odd) == want
    table = spark.createDataFrame(odd, "action string, host string, path string")
    assert run(spark, table) == want
    for bound in ("MAX_BROADCAST_RULES", "MAX_BROADCAST_CHARS"):
        with monkeypatch.context() as m:
            m.setattr(U, bound, 2)
            assert run(spark, odd) == want and run(spark, table) == want


def test_many_paths_of_one_host_are_not_searched_one_by_one():
    trie = U.Trie([("block", "x.org", f"/a/{i:05}") for i in range(20_000)])
    assert trie.find("www.x.org", "/a/01234/more") == ("x.org/a/01234", "block") and trie.find("x.org", "/a/x") == (None, None)
    assert list(trie.lengths.values()) == [(5,)] and [len(e) for e in trie.ends.values()] == [20_000] and len(trie.edges) == 4


def test_rules_of_any_depth(spark):
    path, host = "/" + "a/" * 100_000, ".".join(["b"] * 5_000)
    rules = [("block", "x.org", path), ("allow", host, "/")]
    pages = spark.createDataFrame([(1, "http://x.org" + path + "c"), (2, "http://x.org" + path[:-1]), (3, f"http://www.{host}/p"), (4, "http://b.b/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.filter_urls(pages, rules, default="none").collect()}
    assert got == {1: ("x.org" + path, "block"), 2: (None, "none"), 3: (host + "/", "allow"), 4: (None, "none")}


def test_no_rules_and_no_pages(spark):
    assert {r[3] for r in run(spark, [], default="block")} == {"block"}
    assert U.filter_urls(spark.createDataFrame([], PAGES), RULES).count() == 0
