"""Main text that stands in several containers."""

from siltstone.llm.html import extract, main_text
from tests.llm.test_html import LONG, page

LINKS = '<div class="more"><p><a href="/a">Another page of this site</a></p><p><a href="/b">And one more of them</a></p></div>'


def split(n, lead=6, rest=4):
    return page(f'<div class="top"><a href="/">Home</a></div><div class="content"><div class="lead"><p>{LONG * lead} {n}</p></div><div class="rest"><p>{LONG * rest} {n}</p></div></div>{LINKS}')


def test_split_bodies(spark):
    want = lambda n: f"{LONG * 6} {n}\n\n{LONG * 4} {n}"
    assert extract(split(1)) == want(1)
    one = page(f'<div class="content"><div class="lead"><p>{LONG * 6}</p></div></div>{LINKS}')
    rows = [(n, "http://h.com/x", split(n)) for n in range(3)] + [(n, "http://h.com/y", one) for n in range(10, 30)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: want(n) for n in range(3)} | {n: LONG * 6 for n in range(10, 30)}
    assert extract(split("x", 9, 1)) == f"{LONG * 9} x\n\n{LONG} x"


def test_outside_head_lines():
    for tag in ("main", "div", 'div class="page"'):
        html = page(f'<{tag}><h1>Head line</h1><div class="body"><p>{LONG}</p><p>{LONG}</p></div></{tag.split()[0]}>{LINKS}')
        assert extract(html) == f"Head line\n\n{LONG}\n\n{LONG}"
    html = page(f'<main><div class="title"><h1>Head line</h1></div><div class="wrap"><div class="body"><p>{LONG * 3}</p></div></div></main>')
    assert extract(html) == f"Head line\n\n{LONG * 3}"


def test_link_lists_stay_out():
    assert extract(page(f'<div class="all"><div class="text"><p>{LONG}</p></div>{LINKS}</div>')) == LONG
