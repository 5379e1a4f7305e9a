"""Broken, deep and long pages are read in one pass, and the vote agrees with a plain one."""

import subprocess
import sys
from collections import defaultdict

import pytest

from siltstone.llm.html import Page, extract, host_paths, main_text
from tests.llm.test_html import LONG, page

ODD = {
    "quotes": "<a " + '"' * 48, "many quotes": "<a " + '"' * 20_000 + ">", "open tags": "<a" * 8000, "cdata": "<![CDATA[" * 8000, "deep": "<div>" * 20_000, "deep text": "<div>x y z " * 20_000,
    "lists": "<ul>" * 20_000, "inline": "<b>" * 20_000 + "</i>" * 20_000, "ends": "<div>" * 20_000 + "</section>" * 20_000, "quoted ends": '<a t=">" ' * 20_000, "half quotes": '<a t=">" <a t=">' * 20_000,
    "comments": "<!--" * 20_000, "scripts": "</script <script>" * 10_000, "spans": "<p><span>" * 20_000, "names": "".join(f'<div class="c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}">text' for i in range(15_000)),
}


@pytest.mark.parametrize("name", ODD)
def test_odd_pages_take_little_time_and_memory(name):
    code = "import sys, time, resource; from siltstone.llm.html import extract; x = sys.stdin.read(); a = time.process_time(); extract(x); print(time.process_time() - a, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    took, mb = subprocess.run([sys.executable, "-c", code], input=ODD[name], capture_output=True, text=True, timeout=60, check=True).stdout.split()
    assert float(took) < 4 and int(mb) < 400


def test_long_page_stays_whole():
    text = " ".join(f"word{i}" for i in range(200_000))
    assert extract(page(f"<article><h1>A</h1><p>{text}</p></article>")) == f"A\n\n{text}"


def test_header_of_the_main_part_stays():
    assert extract(page(f"<header>Site</header><main><header><h1>Head</h1></header><div><p>{LONG}</p></div></main>")) == f"Head\n\n{LONG}"
    assert extract(page(f'<article><p>{LONG}</p><div class="legal-history"><p>{LONG}</p></div></article>')) == f"{LONG}\n\n{LONG}"


def plain_vote(rows, least=0.05):
    """Every page's votes added up in one dictionary, by the names of the paths."""
    votes, keys = defaultdict(lambda: defaultdict(float)), {}
    for host, html in rows:
        p = Page(html)
        for path, x in p.votes(p.own()):
            votes[host][p.paths.key[path]] += x
            keys[p.paths.key[path]] = p.paths.depth[path]
    return {h: [k for k, x in sorted(v.items(), key=lambda i: (-round(i[1] * 1024), keys[i[0]], i[0])) if x >= least * sum(v.values()) - 1e-6] for h, v in votes.items()}


def test_vote_agrees_with_a_plain_one(spark):
    shape = [f'<div class="a"><p>{LONG}</p></div><div class="b"><p>{LONG}</p></div>', f'<section id="s"><p>{LONG * 2}</p></section>', f"<article><p>{LONG}</p></article>", f'<table><tr><td class="c"><p>{LONG}</td></tr></table>', "", None]
    rows = [(i, f"http://h{i % 3}.org/x", page(shape[i * 7 % 5 % len(shape)]) if i % 11 else shape[5], "z") for i in range(90)]
    rows += [(100 + i, "http://h0.org/", page(f'<div class="only{chr(97 + i)}"><p>{LONG}</p></div>'), "z") for i in range(26)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, paths string").repartition(5)
    got = {r.host: r.paths for r in host_paths(df).collect()}
    assert got == plain_vote((r[1][7:13], r[2]) for r in rows)
    want = {r[0]: extract(r[2], got.get(r[1][7:13])) for r in rows}
    assert {r.page_id: r.text for r in main_text(df).collect()} == want
