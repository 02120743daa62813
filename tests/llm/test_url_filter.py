"""URL filters: brute force over random rules and addresses, nested rules, edges."""

import random

from talentgrid.llm import op12_url_filter as U

PAGES = "page_id long, url string"


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url[url.index("://") + 3 :]
    at = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:at]), rest[at:]
    path = tail[: min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def judged(spark, urls, rules, **more):
    df = spark.createDataFrame(list(enumerate(urls)), PAGES)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(df, U.rule_table(spark, rules), **more).collect()}


def test_random_rules(spark, monkeypatch):
    rng = random.Random(5)
    label = lambda: rng.choice(["a", "b", "ab", "ü"])
    host = lambda n: ".".join(label() for _ in range(rng.randint(1, n)))
    path = lambda: rng.choice(["", "/", "/a", "/a/", "/a/b", "/ab", "/ü", "/a/b/c"])
    rules = {}
    for _ in range(60):
        rules.setdefault((host(3), path()), rng.choice(["allow", "block"]))
    rules = [(*k, v) for k, v in rules.items()]
    urls = [f"http://{host(5)}{path()}{rng.choice(['', '?x=/a', '#/a', '/z'])}" for _ in range(800)]
    want = {i: brute(u, rules) for i, u in enumerate(urls)}
    assert judged(spark, urls, rules) == want
    monkeypatch.setattr(U, "SWEEP_ROWS", 1)  # every host in many sweeps
    assert judged(spark, urls, rules) == want


def test_edges(spark):
    urls = [None, "", "no scheme.org/", "HTTP://WWW.Example.ORG", "x://example.org/es/?q#f", "x://notexample.org/es/", "x://a..org/", "x://.org/", "x://", "x:///es/", "://com/de/x://org/", "x://com/DE/", "x://" + "a." * 50_000 + "org/" + "p" * 100_000, "x://\u00c4.com/de/", "x://org?/", "x://org./"]
    got = judged(spark, urls, U.RULES)
    assert got == {i: brute(u, U.RULES) for i, u in enumerate(urls)}
    assert got[3] == ("www.example.org", "", None, "allow") and got[4][2] == "example.org/es/" and got[12][2] == "org/"


def test_repeats_ties_nothing_and_clashes(spark):
    kind = "page_id long, url string, host string, rule string, top string, n int"
    rows = [(1, "x://b.org/abc", "h", "r", "t", 1), (1, "x://b.org/abc", "h", "r", "t", 1), (None, None, None, None, None, None)]
    rules = U.rule_table(spark, (("org", "/abc", "block"), ("b.org", "/a", "allow"), ("b.org", "/a", "block")))
    out = U.judge(spark.createDataFrame(rows, kind), rules)
    assert sorted(out.columns) == sorted(["page_id", "url", "top", "n", "host", "path", "rule", "verdict"])
    got = sorted((r["page_id"] or 0, r["rule"], r["verdict"], r["top"]) for r in out.collect())
    # both have seven characters: the longer host wins; given twice, it blocks
    assert got == [(0, None, "allow", None), (1, "b.org/a", "block", "t"), (1, "b.org/a", "block", "t")]
    assert U.judge(spark.createDataFrame([], kind), rules).count() == 0
    assert judged(spark, ["x://a.org/"], (("zz", "", "block"),), default="block")[0][3] == "block"
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert U.judge(spark.createDataFrame(rows, kind), empty).filter("verdict = 'allow'").count() == 3


def test_no_python_on_executors(spark, sf):
    plan = U.op12_url_filter(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoop"))
