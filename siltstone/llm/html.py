"""Main text of web pages by container paths that the pages of a host agree on."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from siltstone.llm.common import written

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The rest of a tag up to its end; a '>' in a quoted value does not end it. Nothing in it is ever tried in two ways.
TAIL = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that neither break a block of text nor hold one.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags whose content is never main text.
OUTSIDE = frozenset("nav header footer aside form script style noscript iframe template svg math head title select button textarea dialog menu object canvas audio video map input option datalist".split())
#: Words of class, id and role that mark what is not main text.
NOISE = frozenset("""nav navbar navigation navi menu menus submenu topmenu header masthead footer bottom sidebar sidebars aside ad ads adv advert adverts advertisement advertising adbox adslot banner banners sponsor sponsored sponsors
promo promos promotion cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup signin login register share sharing social comment comments respond discussion disqus replies reply
related recommended recommendations breadcrumb breadcrumbs pagination pager toolbar widget widgets search searchbox form skip copyright disclaimer hidden contentinfo complementary""".split())
TEXTY = frozenset("body html main article".split())
#: What a start tag ends: tags up the stack that may close without an end tag.
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
SCOPE = ("div", "section", "article", "main", "body", "blockquote", "td", "th")
HOLDERS = frozenset("div section article main body html".split()) | {""}
DIGITS, WORDS, CAMEL, HEAD = re.compile(r"\d+"), re.compile(r"[a-z0-9]+"), re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"h[1-6]$")
#: Words that say what an element goes along with, and last words of elements around others.
BESIDES, AROUND = frozenset("has with no without".split()), frozenset("wrap wrapper container layout page content main body article post entry inner outer".split())
#: Words that say nothing of a text's subject: with words of ``NOISE`` alone they make up the name of a part of the site.
PARTS = AROUND | frozenset("""slot unit box bar block blocks list lists link links button buttons icon icons area section panel row col column group item items posts articles story stories title titles heading text thread top left right
site web mobile desktop tag label inline policy module component card cards small large dark light more now us by you""".split())
#: Tags of the text itself; inside an article only words that name nothing else mark them.
PROSE = frozenset("p blockquote h1 h2 h3 h4 h5 h6 pre table ul ol dl figure li dd td".split())
PLAIN = frozenset("""nav navbar navigation submenu topmenu sidebar sidebars ad ads adv advert adverts advertisement advertising adbox adslot banner banners sponsor sponsored sponsors promo promos cookie cookies gdpr popup newsletter signup signin
login disqus breadcrumb breadcrumbs pagination pager toolbar widget widgets searchbox copyright disclaimer contentinfo complementary""".split())


@lru_cache(8192)
def is_noise(name: str) -> bool:
    """Whether a class, id or role marks what is not main text: 'main-nav', 'sidebar-content', 'page__footer'; but not
    'has-sidebar' or 'content-sidebar-wrap'."""
    words = WORDS.findall(CAMEL.sub("-", name).lower())
    if NOISE.isdisjoint(words) or not BESIDES.isdisjoint(words):
        return False
    return words[0] in NOISE or words[-1] not in AROUND


@lru_cache(8192)
def is_noise_inside(name: str, prose: bool) -> bool:
    """The same inside an article or main part, where a word is not enough: every word of the name must be of the site's
    own parts. 'ad-slot', 'share-buttons', 'related-posts' go; 'related-work', 'share-price', 'hidden-gems' stay. Of tags
    of the text itself, such as quotes and paragraphs, one word at least must mean nothing else: 'social' stays, 'ad' goes."""
    words = WORDS.findall(CAMEL.sub("-", name).lower())
    return is_noise(name) and all(w in NOISE or w in PARTS or DIGITS.search(w) for w in words) and not (prose and PLAIN.isdisjoint(words))


class Paths:
    """Container paths as numbers: a path is its parent's number and a name. Parents have smaller numbers; 0 is the root."""

    def __init__(self) -> None:
        self.parent, self.tag, self.depth, self.article, self.key = [0], [""], [0], [-1], [0]
        self.known: dict[tuple[int, str], int] = {}

    def under(self, parent: int, tag: str, name: str) -> int:
        import xxhash

        n = self.known.get((parent, name))
        if n is None:
            n = self.known[parent, name] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            self.depth.append(self.depth[parent] + 1)
            above = self.article[parent]
            self.article.append(above if above >= 0 else n if tag == "article" else -1)
            raw = xxhash.xxh64_intdigest((self.key[parent] & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little") + name.encode("utf-8", "surrogatepass"))
            self.key.append(raw - (1 << 64) if raw >> 63 else raw)
        return n


class Element:
    __slots__ = ("tag", "path", "out", "inner", "inline", "block", "open")

    def __init__(self, tag: str, path: int, out: bool, inner: bool, block: Element | None):
        self.tag, self.path, self.out, self.inner, self.inline = tag, path, out, inner, block is not None
        self.block = block or self
        self.open: dict[str, int] = {}  # of a block: its open inline elements


def element(tag: str, attrs: str, up: Element, paths: Paths) -> Element:
    named, out, inline = tag, up.out or tag in OUTSIDE, tag in INLINE
    if attrs and not up.out:
        noise, label = False, ""
        for m in ATTR.finditer(attrs):
            key = m[1].lower()
            if key not in ("class", "id", "role", "hidden", "style"):
                continue
            value = m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "style" and "display:none" in value.lower().replace(" ", ""):
                out = True
            elif key in ("class", "id", "role"):
                noise = noise or any(is_noise_inside(x, tag in PROSE) if up.inner else is_noise(x) for x in value.split())
                if key == "class" or key == "id" and not label:
                    label = ".".join(sorted(DIGITS.sub("N", x) for x in value.lower().split()))
        if label:
            named = f"{tag}.{label}"
        if tag not in TEXTY and noise:
            out = True
    if out and not up.out and tag == "header" and up.inner:
        out = False  # the head line of an article or main part; menus in it are left out by their own names
    return Element(tag, up.path if inline or out else paths.under(up.path, tag, named), out, up.inner or tag in ("article", "main"), up.block if inline else None)


class Page:
    """The text blocks of a page outside menus and the like, with the container path of each.

    ``blocks`` holds (path, text, characters in links, tag of the block's own element). A block ends at any tag that
    is not inline. The container is the element around the block's own element, or the element itself where text
    stands in it directly. End tags that match nothing are passed over, and what a start or end tag implies is closed.

    One pass from left to right: every character is read a bounded number of times, and every element is opened and
    closed once, however deep or broken the markup is.
    """

    def __init__(self, html: str | None):
        self.paths = Paths()
        self.blocks: list[tuple[int, str, int, str]] = []
        self._read(html or "")
        self._sum()

    def _read(self, html: str) -> None:
        paths, blocks = self.paths, self.blocks
        stack = [Element("", 0, False, False, None)]
        places: dict[str, list[int]] = {}  # where in the stack elements that are not inline are open, by tag
        parts: list[str] = []
        links, in_link = 0, False

        def close(depth: int) -> None:
            while len(stack) > depth:
                gone = stack.pop()
                if gone.inline:
                    gone.block.open[gone.tag] -= 1
                else:
                    places[gone.tag].pop()

        def push(e: Element) -> None:
            if e.inline:
                e.block.open[e.tag] = e.block.open.get(e.tag, 0) + 1
            else:
                places.setdefault(e.tag, []).append(len(stack))
            stack.append(e)

        def flush() -> None:
            nonlocal links
            if parts:
                text = " ".join(unescape("".join(parts)).split())
                parts.clear()
                if text:
                    at = len(stack) - 1
                    while stack[at].inline:
                        at -= 1
                    tag = stack[at].tag
                    if tag not in HOLDERS and at:
                        at -= 1
                        while stack[at].inline:
                            at -= 1
                    blocks.append((stack[at].path, text, min(links, len(text)), tag))
            links = 0

        def add(text: str) -> None:
            nonlocal links
            if text and not stack[-1].out:
                parts.append(text)
                if in_link:
                    links += len(text)

        last, quotes, cdata, pos, size = html.rfind(">"), True, True, 0, len(html)
        while pos < size:
            at = html.find("<", pos)
            if at < 0 or at > last:
                add(html[pos:])  # no tag ends any more
                break
            add(html[pos:at])
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                pos = end + 3 if end >= 0 else size
                continue
            if cdata and html.startswith("<![CDATA[", at):
                end = html.find("]]>", at + 9)
                cdata = end >= 0
                if cdata:
                    add(html[at + 9 : end])
                    pos = end + 3
                    continue
            if html.startswith(("<!", "<?"), at):
                pos = html.find(">", at) + 1
                continue
            ending = html.startswith("/", at + 1)
            name = NAME.match(html, at + 1 + ending)
            if name is None:
                add("<")
                pos = at + 1
                continue
            tail = TAIL.match(html, name.end()) if quotes and not ending else None
            if tail is None:
                quotes = quotes and ending  # quoted values run to the end: from here on, the next '>' ends a tag
                pos = html.find(">", name.end()) + 1
                if not pos:
                    add(html[at:])
                    break
            else:
                pos = tail.end()
            tag = name[0].lower()
            inline = tag in INLINE
            if ending:
                if tag == "a":
                    in_link = False
                if inline:
                    if stack[-1].block.open.get(tag):
                        depth = len(stack) - 1
                        while stack[depth].tag != tag:
                            depth -= 1
                        close(depth)
                elif places.get(tag):
                    flush()
                    close(places[tag][-1])
                elif tag == "p":
                    flush()
                continue
            if tag in VOID:
                if tag == "br":
                    add("\n")
                elif not inline:
                    flush()
                continue
            if not inline:
                flush()
                floor = max((places[t][-1] for t in SCOPES.get(tag, SCOPE) if places.get(t)), default=0)
                for t in CLOSES.get(tag, ("p",)):
                    where = places.get(t)
                    while where and where[-1] > floor:
                        close(where[-1])
                in_link = False
            if tag == "a":
                in_link = True
            made = element(tag, html[name.end() : pos - 1], stack[-1], paths)
            if tag in RAW:
                end = RAW[tag].search(html, pos)
                if not made.out:
                    push(made)
                    add(html[pos : end.start() if end else size])
                    flush()
                    close(len(stack) - 1)
                pos = html.find(">", end.start()) + 1 or size if end else size
                continue
            push(made)
        flush()

    def _sum(self) -> None:
        """Sums over what is under each path: blocks, their first, characters, characters in links, first <h1>; and the first head line in it."""
        n = len(self.paths.parent)
        none = len(self.blocks)
        self.count, self.size, self.linked, self.first, self.h1, self.head = [0] * n, [0] * n, [0] * n, [none] * n, [none] * n, [none] * n
        for i, (path, text, linked, tag) in enumerate(self.blocks):
            self.count[path] += 1
            self.size[path] += len(text)
            self.linked[path] += linked
            self.first[path] = min(self.first[path], i)
            if HEAD.match(tag) and not linked:
                self.head[path] = min(self.head[path], i)
                if tag == "h1":
                    self.h1[path] = min(self.h1[path], i)
        for p in range(n - 1, 0, -1):
            up = self.paths.parent[p]
            self.count[up] += self.count[p]
            self.size[up] += self.size[p]
            self.linked[up] += self.linked[p]
            self.first[up] = min(self.first[up], self.first[p])
            self.h1[up] = min(self.h1[up], self.h1[p])

    def widened(self) -> list[int]:
        """For each path the outermost container around it that holds more of the same text; an article stays as it is.

        A container holds more of it if what it has besides is not mostly links, and has a head line before the text
        (an <h1>, or any head line that stands in the container itself) or at least a tenth of the text's length.
        """
        out, around = [0], [0]  # around: the nearest ancestor that holds other blocks too
        for p in range(1, len(self.paths.parent)):
            up = self.paths.parent[p]
            around.append(around[up] if self.count[up] == self.count[p] else up)
            a, to = around[p], p
            if self.paths.article[p] < 0 and self.count[p] and self.paths.tag[a] not in ("html", ""):
                size, linked = self.size[a] - self.size[p], self.linked[a] - self.linked[p]
                head = self.h1[a] < self.first[p] or self.head[a] < self.first[p]
                if 2 * linked <= size and (head or 10 * (size - 2 * linked) >= self.size[p]):
                    to = out[a]
            out.append(to)
        return out

    def scored(self) -> dict[int, float]:
        """Score of each path, that of the outermost article on it where there is one: the text of its own blocks that is no link, half of that of the level below."""
        score: dict[int, float] = {}
        for path, text, linked, _ in self.blocks:
            worth = max(0, len(text) - 2 * linked)
            for level in range(3):
                if not path:
                    break
                score[path] = score.get(path, 0.0) + worth / 2**level
                path = self.paths.parent[path]
        out: dict[int, float] = {}
        for path, x in score.items():
            path = self.paths.article[path] if self.paths.article[path] >= 0 else path
            out[path] = max(out.get(path, 0.0), x)
        return out

    def own(self) -> dict[int, tuple[int, float]]:
        """The page's best containers -> (widened path, share of the best score, from a half on)."""
        score = self.scored()
        top = max(score.values(), default=0.0)
        if top <= 0:
            return {}
        wide = self.widened()
        return {p: (wide[p], x / top) for p, x in score.items() if x >= top / 2}

    def votes(self, own: dict[int, tuple[int, float]]) -> list[tuple[int, float]]:
        """(path, vote), best first: shares of the best score; among equals the path nearer to the root."""
        votes: dict[int, float] = {}
        for path, x in own.values():
            votes[path] = max(votes.get(path, 0.0), x)
        return sorted(votes.items(), key=lambda v: (-v[1], self.paths.depth[v[0]], self.paths.key[v[0]]))

    def text(self, path: int) -> str:
        """The blocks under a path."""
        inside = [True] if path == 0 else [False]
        for p in range(1, len(self.paths.parent)):
            inside.append(p == path or inside[self.paths.parent[p]])
        return "\n\n".join(b[1] for b in self.blocks if inside[b[0]])


def blocks_of(html: str | None) -> list[tuple[int, str, int, str]]:
    return Page(html).blocks


def best_paths(html: str | None) -> list[tuple[int, int, float]]:
    """(key of the generalised path, depth, vote) of the page's best containers."""
    page = Page(html)
    return [(page.paths.key[p], page.paths.depth[p], x) for p, x in page.votes(page.own())]


def extract(html: str | None, keys: list[int] | None = None) -> str:
    """The page's main text under the first of the paths (their keys) that it has, or under its own best container.

    Where that path is among the page's own best containers, it is widened as they are.
    """
    page = Page(html)
    own = page.own()
    if keys:
        have = {k: p for p, k in enumerate(page.paths.key) if p and page.count[p]}
        for key in keys:
            path = have.get(key)
            if path is not None:
                return page.text(own[path][0] if path in own else path)
    best = page.votes(own)
    return page.text(best[0][0] if best else 0)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", least: float = 0.05) -> DataFrame:
    """(host, paths ARRAY<LONG>): keys of the container paths by falling votes of the host's pages; at least ``least`` of all votes each.

    Paths below that share, however many a host has, are dropped before a host's paths come together in a row, so a
    row has at most 1 / ``least`` of them.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sums: dict[tuple[str, int, int], float] = {}
            for host, html in zip(part.column(0).to_pylist(), part.column(1)):
                for path, depth, vote in best_paths(html.as_py()):
                    sums[host, path, depth] = sums.get((host, path, depth), 0.0) + vote
            cols = [pa.array([k[i] for k in sums], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([round(v * 1024) for v in sums.values()], pa.int64())], names=["host", "path", "depth", "votes"])

    votes = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(run, "host string, path long, depth int, votes long")
    by_path = written(votes.groupBy("host", "path").agg(F.min("depth").alias("depth"), F.sum("votes").alias("votes")), "votes")
    totals = by_path.groupBy("host").agg(F.sum("votes").alias("all")).select(F.concat("host", F.lit("")).alias("h"), "all")
    kept = by_path.join(totals, F.col("host") == F.col("h")).where(F.col("votes") >= F.lit(least) * F.col("all"))
    order = F.struct((-F.col("votes")).alias("v"), "depth", "path")
    return kept.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(order)), lambda e: e["path"]).alias("paths"))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of every page; the html column is dropped.

    Every page scores its containers, pages vote on generalised tag-class paths per host, and each page is extracted
    again with the winning path of its host that it has, else by its own best container. Votes are summed in each
    task before the exchange, so a host with many pages costs a few rows a task. Hosts' paths are written and read
    back: Spark broadcasts them only if their measured size is under its threshold, and else exchanges pages by host,
    with large hosts split.

    Null html: empty text. Null or odd urls share the host ''. Very long, deep or broken pages are read in one pass,
    whole. Paths with equal votes go by depth, then by key. Repeated rows stay and vote as often as they are there.
    An empty table gives no rows. Other columns stay, but one named like the text is replaced.
    """
    known = written(host_paths(pages, url_col, html_col), "hosts")
    names = [c for c in pages.columns if c not in (html_col, text_col)]
    joined = pages.withColumn("__host", host_of(F.col(url_col))).join(known.select(F.col("host").alias("__h"), F.col("paths").alias("__paths")), F.col("__host") == F.col("__h"), "left")
    joined = joined.select(*names, F.col(html_col).alias("__html"), "__paths")
    schema = T.StructType([*(pages.schema[c] for c in names), T.StructField(text_col, T.StringType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = len(names)
            texts = [extract(html.as_py(), paths) for html, paths in zip(part.column(n), part.column(n + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(texts, pa.string())], names=[f.name for f in schema])

    return joined.mapInArrow(run, schema)
