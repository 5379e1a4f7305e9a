"""Main text of pages."""

from siltstone.llm.html import best_paths, blocks_of, extract, main_text

LONG = "Words of the article that go on for a while, with commas, and some more of them."


def page(body, title="T"):
    return f'<!DOCTYPE html><html lang="en"><head><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'


def test_boilerplate_goes():
    html = page(
        f'<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy now</div><div class="cookie-notice">We use cookies</div>'
        f'<article><h1>Head &amp; line</h1><p>{LONG}<p><b>{LONG} two<br>more</p><div class="ad-slot">x</div><ul><li>one<li>two</ul><table><tr><td>cell<td>other</table><form>Name <input></form></article>'
        f'<aside>Also read {LONG}</aside><section id="comments"><p>{LONG} first!</p><p>{LONG} {LONG}</p></section><footer>&copy; all</footer>'
    )
    assert extract(html).split("\n\n") == ["Head & line", LONG, f"{LONG} two more", "one", "two", "cell", "other"]


def test_without_article_and_odd_markup():
    html = page(f'<div id="menu"><a href="x">{LONG}</a></div><div class="post-12 body"><div><p>{LONG} A&nbsp; B&#33;\n c</p><p>{LONG}</div></div><div class="sidebar">{LONG}{LONG}</div>')
    assert extract(html).split("\n\n") == [f"{LONG} A B! c", LONG]
    assert extract("<p>unclosed <i>tags</b> <b>here" + LONG) == "unclosed tags here" + LONG
    assert extract("no tags at all, a &lt; b") == "no tags at all, a < b"
    assert extract("<article><p>" + LONG + '<br>x <a title="a>b" href=y>z</a></p><!-- open comment <p>gone') == LONG + " x z"
    assert extract(None) == extract("") == extract("<html></html>") == ""
    assert blocks_of("<p>a</p></div></p><p>b") and best_paths("") == []


def test_consensus(spark):
    main = lambda n: page(f'<div class="wrap"><div class="content c{n}"><p>{LONG}</p><p>{LONG} {n}</p></div><div class="box"><p>Short</p></div></div>')
    odd = page(f'<div class="wrap"><div class="content c7"><p>Brief news.</p></div><div class="box"><p>{LONG} {LONG}</p></div></div>')
    rows = [(i, f"http://h.com/{i}", main(i)) for i in range(6)] + [(6, "http://H.com:80/x", odd), (7, "http://other.com/", odd), (8, None, main(8)), (9, "http://h.com/", None), (0, "http://h.com/0", main(0)), (None, "http://h.com/q", main(1))]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text) for r in main_text(df).collect()), key=str)
    want = [(i, f"{LONG}\n\n{LONG} {n}") for i, n in ((0, 0), (0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (8, 8), (None, 1))]
    assert got == sorted([*want, (6, "Brief news."), (7, f"{LONG} {LONG}"), (9, "")], key=str)
    assert main_text(df).columns == ["page_id", "url", "text"]
    assert main_text(df.limit(0)).count() == 0


def test_names():
    from siltstone.llm.html import is_noise

    assert all(map(is_noise, ("nav", "main-nav", "mainNav", "sidebar-content", "page__footer--dark", "ad-slot", "comments-wrapper", "cookie_notice", "share")))
    assert not any(map(is_noise, ("has-sidebar", "content-with-sidebar", "content-sidebar-wrap", "post", "entry-content", "readable", "padding")))
    html = page(f'<div class="layout has-sidebar"><div class="entry"><p>{LONG}</p></div><div class="page__sidebar"><p>{LONG} {LONG}</p></div></div>')
    assert extract(html) == LONG


def test_class_words_inside_an_article_need_more_than_one_word():
    kept = ['section class="related-work"', 'p class="search-results"', 'section id="comment-on-method"', 'div class="form-of-matter"', 'div class="hidden-gems"', 'div class="share-price"', 'div class="alert-system"', 'h2 class="menu-of-the-day"', 'p id="notice-periods"', 'blockquote class="social"']
    gone = ["div class=ad-slot", "div class='share-buttons'", "section id=comments", "div class=related-posts", "p class=advert", "div class='ad-300x250'", "ul class='breadcrumbs'", "div role=complementary", "div class=cookieNotice"]
    shut = lambda t: t.split()[0]
    body = "".join(f"<{t}>{LONG} {i}</{shut(t)}>" for i, t in enumerate(kept)) + "".join(f"<{t}>{LONG} gone</{shut(t)}>" for t in gone)
    assert extract(page(f"<article><h1>Head</h1>{body}</article>")).split("\n\n") == ["Head", *(f"{LONG} {i}" for i in range(len(kept)))]
