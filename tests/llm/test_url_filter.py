"""Dated list entries against brute force."""

import random

from siltstone.llm.url_filter import filter_urls


def intervals(entries):
    order = {"allow": 0, "block": 1, "remove": 2}
    by = {}
    for p, at, action in entries:
        if p is None or at is None or action not in order or not p.strip():
            continue
        p = p.strip()
        host, slash, path = p.partition("/")
        p = host.lower() + ("/" + path).rstrip("/") * bool(slash)
        by.setdefault(p, {})
        if at not in by[p] or order[action] > order[by[p][at]]:
            by[p][at] = action
    out = []
    for p, days in by.items():
        ds = sorted(days)
        out += [(p, a, b, days[a]) for a, b in zip(ds, [*ds[1:], None]) if days[a] != "remove"]
    return out


def verdict(url, t, spans):
    if url is None or t is None or "//" not in url:
        return "none", None
    rest = url.split("//", 1)[1]
    host = rest.split("?")[0].split("#")[0].split("/")[0].split("@")[-1].split(":")[0].lower().rstrip(".")
    path = "/" + "/".join(s for s in rest.split("?")[0].split("#")[0].split("/")[1:] if s)
    best = None
    for p, a, b, action in spans:
        h, _, q = p.partition("/")
        if (host == h or host.endswith("." + h)) and (not q or (path + "/").startswith("/" + q + "/")) and a <= t and (b is None or t < b):
            best = max(best or (0, "", ""), (len(p), p, action))
    return (best[2], best[1]) if best else ("none", None)


def test_against_brute_force(spark):
    rng = random.Random(4)
    hosts = ["a.com", "www.a.com", "x.y.b.org", "b.org", "c.net", "deep.www.a.com"]
    paths = ["", "/", "/p", "/p/q", "/p/q/r?x=1", "/pq#f", "//p//q"]
    captures = [(i, rng.choice(["http://", "HTTPS://u@", "//"]) + rng.choice([str.upper, str])(rng.choice(hosts)) + rng.choice(["", ":80"]) + rng.choice(paths), rng.randrange(20)) for i in range(400)]
    captures += [(900, None, 3), (901, "not a url", 3), (902, "http://a.com/", None), (5, captures[5][1], captures[5][2]), (903, "http://", 3)]
    entries = [(rng.choice([*hosts, "a.com/p", "b.org/p/q/", " A.com ", "com"]), rng.randrange(20), rng.choice(["block", "allow", "remove"])) for _ in range(60)]
    entries += [(None, 1, "block"), ("a.com", None, "block"), ("a.com", 1, None), ("a.com", 2, "other"), ("", 1, "block")]
    df = spark.createDataFrame([(*c, "old") for c in captures], "page_id long, url string, fetched_at long, verdict string")
    out = filter_urls(df, spark.createDataFrame(entries, "pattern string, at long, action string"))
    spans = intervals(entries)
    got = sorted(((r.page_id, r.verdict, r.matched) for r in out.collect()), key=str)
    assert got == sorted(((i, *verdict(u, t, spans)) for i, u, t in captures), key=str)
    assert len({g[1] for g in got}) == 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.com/", 1)], "page_id long, url string, fetched_at long")
    none = spark.createDataFrame([], "pattern string, at long, action string")
    assert filter_urls(captures, none).first().verdict == "none"
    assert filter_urls(captures.limit(0), none).count() == 0


def test_long_urls(spark):
    import time

    url = "http://" + "a." * 1500 + "com/" + "s/" * 2500 + "end"
    rows = [(1, url, 5), (2, "http://x.com/" + "s" * 8000, 5), (3, "http://" + "b" * 8000, 5), (4, "http://a.com" + "/" * 8000, 5), (1, url, 5)]
    captures = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, fetched_at long, pattern string, spans int")
    entries = spark.createDataFrame([("com", 1, "block"), ("a.com/s/s/s", 2, "allow"), ("a.a.com/s", 2, "block"), ("a.com/s/s/s/x", 2, "block"), ("x.com/sss", 1, "block"), ("y.com" + "/s" * 3000, 1, "block")], "pattern string, at long, action string")
    filter_urls(captures, entries).collect()
    began = time.time()
    got = sorted((r.page_id, r.verdict, r.matched) for r in filter_urls(captures, entries).collect())
    assert time.time() - began < 20
    assert got == [(1, "allow", "a.com/s/s/s"), (1, "allow", "a.com/s/s/s"), (2, "block", "com"), (3, "none", None), (4, "block", "com")]
    assert filter_urls(captures, entries).columns == ["page_id", "url", "fetched_at", "pattern", "spans", "verdict", "matched"]


def test_ties_and_clashing_columns(spark):
    captures = spark.createDataFrame([(1, "http://u.a.bc/", 5, "a", "b")], "page_id long, url string, fetched_at long, listed string, matched string")
    entries = spark.createDataFrame([("a.bc", 1, "block"), ("a.bc", 1, "allow"), ("a.bc", 5, "remove"), ("a.bc", 5, "block")], "pattern string, at long, action string")
    assert filter_urls(captures, entries).first().verdict == "none"  # of one date, remove counts last
    assert filter_urls(captures, entries.where("at = 1")).first().verdict == "block"


def test_the_list_is_evaluated_once(spark):
    caps = spark.createDataFrame([(1, "http://a.b.com/x", 5), (2, "http://c.com/", 50)], "page_id long, url string, fetched_at long")
    rows = spark.createDataFrame([("b.com", 1, "block"), ("b.com", 10, "remove"), ("c.com", 7, "allow")], "pattern string, at long, action string")
    out = filter_urls(caps, rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 2 and "url-spans" in "".join(out.inputFiles())
    assert [(r.page_id, r.verdict, r.matched) for r in out.orderBy("page_id").collect()] == [(1, "block", "b.com"), (2, "allow", "c.com")]
