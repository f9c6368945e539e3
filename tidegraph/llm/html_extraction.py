"""Main text of web pages by a site style tree.

Pages of one host are merged: an element stands for all elements of the host's
pages with the same path of tags, classes and ids. Of each the tree keeps on
how many pages it is, how its presentation (the sequence of its children)
varies and how its content does. Their entropies give the element's importance:
what looks and reads alike on every page of a host (menus, notices, adverts) is
near zero. On a page, a branch's importance joins its own with that of its
children (weighted by how many presentations it has), and branches in which all
is below the threshold are removed.

Mirrored pages (those of a host that have the same elements and texts) count
once, so that an article under many addresses is no template: what has fewer
than `least_pages` different pages is unknown to the tree.

What the tree cannot know is taken from the page: tags that HTML keeps for other
things than content, and names (class, id, role) of adverts, menus and readers'
comments, whose words differ from page to page. Names that also content can have
(a notice, a form, a search) count only where the host has fewer than
`least_pages` pages with that element; elsewhere the tree decides. In an article
a name counts only if no other word goes with it. Elsewhere that holds for names
that words of content often go with (menu-theory, related-work): in a compound
they count where most of the branch is links, or where the tree finds the branch
unimportant. Headings and sections are
never known by their ids, nor are paragraphs without links by names that text
can have. Text of an article is not removed for being the same on other pages;
all else is, even if nothing is left.

The tree is never in one place: its counts are grouped by element, the hot ones
summed before they are shuffled, and each page meets its own elements' values
by joins. A page is parsed once for the tree and once for its text, by loops
that are linear in its length; pages travel compressed.

Defined results: null html gives an empty text, null url is a host of its own;
broken and cut-off markup is read as far as it goes, to any depth; repeated rows
and ids are extracted each; pages of any length are read whole; an empty table
gives an empty result. Only page_id, url and html are read, so extra columns of
any name do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import checkpointed, parallel

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that are no content by their tag, and those that close an open one of their kind.
NOISE = frozenset("script style textarea title xmp iframe noembed noframes head nav footer aside form button select option menu dialog noscript template svg canvas object map audio video".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body table ul ol dl div article main section td th".split())
#: Names in class, id or role of what is no content whatever it says: the site's parts, what readers add, and adverts.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "topbar toolbar pagination footer masthead sidebar aside rail widget widgets cookie cookies consent gdpr popup modal copyright "
    "signup newsletter share sharing contentinfo complementary comment comments replies reply disqus".split()
)
#: Of these, marks of what readers or the site add; an article in there is no main text.
ADDED = frozenset("comment comments replies reply disqus".split())
#: Names of what often is no content; the tree decides where it can.
WEAK = frozenset("banner notice notices alert overlay form search login subscribe pager discussion social related recommended trending skip respond".split())
#: Of all these, names that a paragraph of text can have; there they count only beside links.
OF_TEXT = frozenset("share sharing rail widget widgets menu toolbar navigation modal promo promotion signup reply form search alert discussion social related trending skip".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Names that in compounds are content's as often.
AMBIGUOUS = frozenset("menu share sharing related recommended trending discussion social search promo promotion rail reply replies respond alert skip modal navigation widget widgets".split())
#: Words that say nothing by themselves beside one of the names above.
NEUTRAL = frozenset("area bar block body box button buttons col container content cta group holder icon icons inner item items left link links list main module outer panel primary right row secondary section site slot text top bottom unit wrap wrapper respond header head section".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre td th tr table tbody thead figcaption figure dl dt dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
GAMMA = 0.9
#: From this importance on, an element with a weak name is content.
IMPORTANT = 0.6
#: Names say nothing, something that content can be called too, what is no content, what readers add.
WEAK_LEVEL, STRONG_LEVEL, ADDED_LEVEL = 1, 2, 3
NOTHING = (0, 0, 0, True)
#: Copied pages up to which their first ones are broadcast.
BROADCAST_COPIES = 20_000


class Page(NamedTuple):
    """Elements in page order (0 is the root) and blocks of text.

    noise: what an element's names say (a level, 0 is nothing): all of them, those that are not ambiguous, those by themselves; and whether text can have them all.
    """

    tag: list[str]
    parent: list[int]
    label: list[str]
    noise: list[tuple[int, int, int, bool]]
    blocks: list[tuple[int, str]]
    links: list[int]


def _level(words: set[str]) -> int:
    return ADDED_LEVEL if words & ADDED else STRONG_LEVEL if words & STRONG else WEAK_LEVEL if words & WEAK else 0


def _said(value: str) -> tuple[int, int, int, bool]:
    """What names say, what those say that aren't ambiguous, what those that no other word goes with, and whether text can have all that say something."""
    most = firm = alone = 0
    textual = True
    for token in value.split():
        words = {x.lower() for x in _NAME.findall(token)}
        level = _level(words)
        most, firm = max(most, level), max(firm, _level(words - AMBIGUOUS))
        if level and all(w in STRONG or w in WEAK or w in NEUTRAL or len(w) == 1 for w in words):
            alone = max(alone, level)
        textual = textual and words & (STRONG | WEAK) <= OF_TEXT
    return most, firm, alone, textual


def _marked(tag: str, attributes: str) -> tuple[str, tuple[int, int, int, bool]]:
    """Class and id as part of a label, and what names in them say."""
    label, noise = "", NOTHING
    for kind, a, b, c in _ATTRIBUTE.findall(attributes):
        value, kind = a or b or c, kind.lower()
        most, firm, alone, textual = _said(value)
        if kind == "id" and tag in HEADINGS:
            most = firm = 0
        if kind == "id" and (tag in HEADINGS or tag == "section"):
            alone = 0
        noise = max(noise[0], most), max(noise[1], firm), max(noise[2], alone), noise[3] and textual
        if kind != "role":
            label += f".{' '.join(sorted(re.sub('[0-9]+', '0', value).split()))}"
    return label, noise


class _Stack:
    """Open elements, with the places of each tag, so that none has to be looked for."""

    def __init__(self) -> None:
        self.numbers, self.tags, self.at = [0], [""], {}

    def push(self, number: int, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.numbers))
        self.numbers.append(number)
        self.tags.append(tag)

    def last(self, tags: frozenset | set | tuple) -> int:
        """The place of the innermost open element of these tags; 0 is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def cut(self, to: int) -> None:
        for tag in self.tags[to:]:
            self.at[tag].pop()
        del self.numbers[to:], self.tags[to:]


def parse(html: str) -> Page:
    page = Page([""], [-1], [""], [NOTHING], [], [0])
    stack, buffer = _Stack(), []
    linked, nested = 0, 0

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                page.blocks.append((stack.numbers[-1], text))
            buffer.clear()

    def close(to: int) -> None:
        flush()
        stack.cut(to)

    def said(text: str) -> None:
        if text:
            buffer.append(unescape(text) if "&" in text else text)
            if linked:
                page.links[stack.numbers[-1]] += len(text)

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            said(html[at:])
            break
        said(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "a":
            linked = 0 if m[1] else 1
        if m[1]:
            if tag in INLINE:  # only marked ones are open elements; plain ones inside them are counted
                if stack.tags[-1] == tag:
                    if nested:
                        nested -= 1
                    else:
                        close(len(stack.tags) - 1)
                continue
            i = stack.last((tag,))
            if i and (tag not in ("p", "li") or i >= stack.last(SCOPE - {tag})):
                close(i)
                nested = 0
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        label, noise = _marked(tag, m[3]) if m[3] and not m[3].isspace() else ("", NOTHING)
        if tag in INLINE and not noise[0]:
            nested += stack.tags[-1] == tag
            continue
        flush()
        if tag not in INLINE:
            shut = {"p", *CLOSES.get(tag, ())}
            scope = SCOPE - shut
            while (i := stack.last(shut)) and i > stack.last(scope):
                close(i)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        page.tag.append(tag)
        page.parent.append(stack.numbers[-1])
        page.label.append(tag + label)
        page.noise.append(noise)
        page.links.append(0)
        if not m[3].endswith("/") or tag not in ("svg", "path"):
            stack.push(len(page.tag) - 1, tag)
            nested = 0
    flush()
    return page


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", url or "")
    return m[1].lower() if m else ""


def keys_of(page: Page, host: str) -> list[int]:
    """A 64-bit number for each element: host and path."""
    from xxhash import xxh64_intdigest

    keys = [xxh64_intdigest(host)]
    for i in range(1, len(page.tag)):
        keys.append(xxh64_intdigest(page.label[i].encode(), keys[page.parent[i]]))
    return keys


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tree_features(html: str, host: str) -> set[tuple[int, int, int]]:
    """(element, 0 for presentation or 1 for content, its hash) of a page, each once."""
    from xxhash import xxh64_intdigest

    page = parse(html)
    keys = keys_of(page, host)
    children: list[list[str]] = [[] for _ in keys]
    for i in range(1, len(keys)):
        own = children[page.parent[i]]
        if not own or own[-1] != page.label[i]:
            own.append(page.label[i])
    styles: dict[int, list[str]] = {}
    for k, own in zip(keys, children, strict=True):
        styles.setdefault(k, []).append(" ".join(own))
    out = {(_signed(k), 0, _signed(xxh64_intdigest("\n".join(sorted(set(own)))))) for k, own in styles.items()}
    return out | {(_signed(keys[i]), 1, _signed(xxh64_intdigest(text))) for i, text in page.blocks}


def importances(page: Page, values: list[tuple[float, float, int] | None], own: list[list[str]]) -> list[float | None]:
    """Each element's importance, of its own presentation and the mean of its content and children; None where the tree has none."""
    n = len(values)
    total, count, known = [0.0] * n, [0] * n, [None] * n
    for i in range(n - 1, -1, -1):
        shape, content, styles = values[i] or (1.0, 1.0, 1)
        parts, number = total[i] + (content if own[i] else 0.0), count[i] + bool(own[i])
        weight = GAMMA**styles
        importance = (1 - weight) * shape + weight * parts / number if number else shape
        known[i] = importance if values[i] else None
        if i:
            total[page.parent[i]] += importance
            count[page.parent[i]] += 1
    return known


def main_text(html: str, host: str, values: dict[int, tuple[float, float, int]], threshold: float = 0.25) -> str:
    """The page's text without noise; values: presentation and content importance and number of presentations of elements that the tree knows."""
    page = parse(html)
    known = [values.get(_signed(k)) for k in keys_of(page, host)]
    n = len(known)
    own: list[list[str]] = [[] for _ in known]
    for i, text in page.blocks:
        own[i].append(text)
    importance = importances(page, known, own)
    low = [known[i] is not None and importance[i] < threshold and (not own[i] or known[i][1] < threshold) for i in range(n)]
    holds = [False] * n
    length, linked = [sum(map(len, x)) for x in own], list(page.links)  # of branches
    for i in range(n - 1, 0, -1):
        length[page.parent[i]] += length[i]
        linked[page.parent[i]] += linked[i]
        if page.tag[i] in MAIN or holds[i]:
            holds[page.parent[i]] = True
        if not low[i]:
            low[page.parent[i]] = False
    inside, article, gone = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        up, tag = page.parent[i], page.tag[i]
        inside[i] = inside[up] or tag in MAIN
        article[i] = tag == "article" or article[up] and tag != "main"
        compound, firm, level, textual = page.noise[i]
        if not inside[up]:
            level = max(level, firm)
        if compound > level and not inside[up] and (2 * linked[i] > length[i] or importance[i] is not None and importance[i] < IMPORTANT):
            level = compound
        if level == WEAK_LEVEL and importance[i] is not None and importance[i] >= IMPORTANT or tag in TEXT and textual and not linked[i]:
            level = 0
        by_name = level > 0 and tag not in ("html", "body", "main") and (level == ADDED_LEVEL or not holds[i])
        by_tag = tag in NOISE or tag == "header" and not article[up] and not holds[i]
        copied = low[i] and not holds[i] and not (inside[i] and (tag in MAIN or tag in PLAIN and "." not in page.label[i]))
        branch = up if tag == "li" else i  # a list is judged as a whole
        links = not inside[i] and linked[branch] > 0.8 * length[branch] > 0 and tag in ("ul", "ol", "li")
        gone[i] = gone[up] or by_tag or by_name or copied or links
    left = [(i, text) for i, text in page.blocks if not gone[i]]
    # <main> says where the content is; articles do if most of what is left is in them
    size = lambda of: sum(len(t) for i, t in left if of(i))
    if any(page.tag[i] == "main" and not gone[i] for i in range(n)) or 2 * size(lambda i: inside[i]) >= size(lambda i: True) > 0:
        left = [(i, t) for i, t in left if inside[i]] or left
    return " ".join(t for _, t in left)


def _features(pages: DataFrame) -> DataFrame:
    """pid, page (the same for pages of equal features), elements, kinds, hashes: a row a page, with arrays of its features."""
    from struct import pack

    names = ["pid", "page", "elements", "kinds", "hashes"]

    def seen(url: str | None, html: str | None) -> tuple:
        from xxhash import xxh64_intdigest

        found = sorted(tree_features(html or "", host_of(url)))
        return _pid(url, html), _signed(xxh64_intdigest(b"".join(pack("<qqq", *x) for x in found))), *map(list, zip(*found, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                rows.append(seen(url, html))
            if rows:
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), longs, pa.list_(pa.int8()), longs], strict=True)], names)

    # written once, so that a page is parsed once for the tree and its own elements
    made = parallel(pages.select("url", "html")).mapInArrow(run, "pid long, page long, elements array<long>, kinds array<tinyint>, hashes array<long>")
    return checkpointed(made.withColumn("row", F.monotonically_increasing_id()))


def different(features: DataFrame) -> DataFrame:
    """One row of features for each page that is not the same as another."""
    copies = checkpointed(features.groupBy("page").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    if copies.count() <= BROADCAST_COPIES:
        copies = F.broadcast(copies)
    return features.join(copies, "page", "left").where("first IS NULL OR first = row")


def _pid(url: str | None, html: str | None) -> int:
    from xxhash import xxh64_intdigest

    return _signed(xxh64_intdigest((html or "").encode("utf-8", "replace"), xxh64_intdigest((url or "").encode())))


def style_tree(features: DataFrame, least_pages: int) -> DataFrame:
    """element, shape, content, styles of the merged trees, for elements of least_pages different pages."""
    rows = different(features).select(F.inline(F.arrays_zip("elements", "kinds", "hashes"))).toDF("element", "kind", "feature")
    counts = rows.groupBy("element", "kind", "feature").agg(F.count(F.lit(1)).alias("n"))
    shape, content = F.col("kind") == 0, F.col("kind") == 1
    tree = counts.groupBy("element").agg(
        F.sum(F.when(shape, F.col("n"))).alias("m"),
        F.sum(F.when(shape, F.col("n") * F.log("n"))).alias("s"),
        F.count(F.when(shape, 1)).alias("styles"),
        F.avg(F.when(content, F.log("n"))).alias("c"),
    )
    m = F.log(F.col("m"))
    return tree.where(F.col("m") >= least_pages).select("element", ((m - F.col("s") / F.col("m")) / m).alias("shape"), F.coalesce(1 - F.col("c") / m, F.lit(1.0)).alias("content"), F.col("styles").cast("int").alias("styles"))


def extract(pages: DataFrame, least_pages: int = 4, threshold: float = 0.25) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    if least_pages < 2:
        raise ValueError("one page has no statistics")
    pages = pages.select("page_id", "url", "html")
    id_kind, url_kind = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            urls, htmls = (batch.column(c).to_pylist() for c in ("url", "html"))
            ids = [_pid(u, h) for u, h in zip(urls, htmls, strict=True)]
            packed = [squeeze.compress((h or "").encode("utf-8", "replace")) for h in htmls]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column("page_id"), batch.column("url"), pa.array(packed, pa.binary())], ["pid", "page_id", "url", "packed"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loose = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = []
            for url, packed, values in zip(*(batch.column(c).to_pylist() for c in ("url", "packed", "values")), strict=True):
                known = {v["element"]: (v["shape"], v["content"], v["styles"]) for v in values or ()}
                texts.append(main_text(loose.decompress(packed).decode("utf-8", "replace"), host_of(url), known, threshold))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    features = _features(pages)
    met = features.select("pid", F.explode(F.array_distinct("elements")).alias("element")).join(style_tree(features, least_pages), "element")
    values = met.groupBy("pid").agg(F.collect_set(F.struct("element", "shape", "content", "styles")).alias("values"))
    packed = parallel(pages).mapInArrow(pack, f"pid long, page_id {id_kind}, url {url_kind}, packed binary")
    return packed.join(values, "pid", "left").select("page_id", "url", "packed", "values").mapInArrow(read, f"page_id {id_kind}, url {url_kind}, text string, n_chars long")
