"""The listing data source against a local server."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

import pytest

from siltstone.sources.listing import Listing, links, with_query

ROWS = [{"number": i, "state": "open" if i % 3 else "closed", "user": {"login": f"u{i}"}, "labels": ["a"] * (i % 2), "at": "2024-01-02T03:04:05Z", "odd": i} for i in range(1, 24)]


@pytest.fixture
def server():
    asked, failing = Counter(), {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urlsplit(self.path)
            q = dict(parse_qsl(at.query))
            asked[self.path] += 1
            n, size = int(q.get("page", 1)), int(q.get("per_page", 5))
            if failing.get(n, 0) > 0:
                failing[n] -= 1
                self.send_response(503)
                self.send_header("Retry-After", "0.01")
                self.end_headers()
                return
            if at.path == "/gone":
                self.send_response(404)
                self.end_headers()
                return
            rows = [r for r in ROWS if q.get("state") in (None, r["state"])]
            last = max(1, -(-len(rows) // size))
            to = lambda m, rel: f'<{with_query(f"http://{self.headers["Host"]}{self.path}", page=m)}>; rel="{rel}"'
            found = [to(n + 1, "next")] * (n < last) + ([to(last, "last")] if at.path != "/chain" else [])
            page = rows[(n - 1) * size : n * size]
            self.send_response(200)
            self.send_header("Link", ", ".join(found))
            self.end_headers()
            self.wfile.write(json.dumps({"items": page} if at.path == "/search" else page).encode())

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked, failing
    s.shutdown()


def listing(spark, url, **options):
    spark.dataSource.register(Listing)
    return spark.read.format("listing").schema("number long, state string, user struct<login:string>, labels array<string>, at timestamp, odd string, none double").options(url=url, per_page="5", pause="0.01", **options).load()


@pytest.mark.parametrize("path", ["/rows", "/chain", "/search"])
def test_pages_are_read_whole(spark, server, path):
    df = listing(spark, server[0] + path, pages_per_task="2")
    got = sorted(df.collect(), key=lambda r: r.number)
    assert [r.number for r in got] == list(range(1, 24))
    assert got[2].user.login == "u3" and got[2].labels == ["a"] and got[2].odd == "3" and got[2].none is None and got[2].at.year == 2024
    assert df.rdd.getNumPartitions() == (1 if path == "/chain" else 3)


@pytest.mark.parametrize(("path", "limit"), [("/rows", 7), ("/chain", 7), ("/rows", 10), ("/rows", 0), ("/chain", 500)])
def test_limit(spark, server, path, limit):
    got = [r.number for r in listing(spark, server[0] + path, limit=str(limit)).collect()]
    assert sorted(got) == list(range(1, min(limit, 23) + 1))


def test_passing_failures_are_tried_again(spark, server):
    url, asked, failing = server
    failing.update({1: 1, 3: 2})
    assert listing(spark, url + "/rows", pages_per_task="1").count() == 23
    assert max(asked.values()) >= 3
    failing[4] = 99
    with pytest.raises(Exception, match="503"):
        listing(spark, url + "/rows", tries="2").collect()
    with pytest.raises(Exception, match="404"):
        listing(spark, url + "/gone").collect()


def test_equalities_reach_the_server(spark, server):
    url, asked, _ = server
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = listing(spark, url + "/rows", filters="state").where("state = 'closed' and number > 5").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert sorted(r.number for r in got) == [6, 9, 12, 15, 18, 21]
    assert any("state=closed" in p and "page=2" in p for p in asked)


def test_link_headers():
    assert links('<http://a/?x=1,2>; rel="next", <http://b>; title="a,b"; rel=last') == {"next": "http://a/?x=1,2", "last": "http://b"}
    assert links(None) == links("nothing") == {}
    assert with_query("http://a/b?x=1&page=2#f", page=3) == "http://a/b?x=1&page=3#f"
