"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' figures."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from voxmill.llm import common

#: A quoted value may hold ``>`` but not ``<``: where a quote isn't closed, the tag ends at the next ``>`` all the same.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"<]*"|'[^'<]*'|[^>"']|["'](?![^"<]*"|[^'<]*'))*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"<>]*)"?|'([^'<>]*)'?|([^\s"'>]+)))?""", re.I)

#: Elements that run inside a line of text; every other tag ends the block, but for br, which is white space.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Their content isn't text of the page.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements that stand around an article, and words that occur in the names (class, id, role) of such parts.
CHROME_TAGS = frozenset("nav footer aside form menu button select dialog noscript template svg head object audio video header".split())
#: Those of them in which no article is the page's own.
APART_TAGS = CHROME_TAGS - {"form", "header", "object"}
CHROME_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus foot footer gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promoted related replies respond search share sharing sidebar sidebars signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Words that say nothing of a part, those that name an article, and those that deny what follows them.
PLAIN_WORDS = frozenset("area bar bottom box block col column container group inner item items left links list outer panel right row section site slot space text top unit wrap wrapper".split())
CONTENT_WORDS = frozenset("article body content entry main post prose story".split())
DENIALS = frozenset("has hide no non not with without".split())
#: Elements whose blocks belong together.
CONTAINERS = frozenset("address article aside blockquote body center dd details div fieldset footer form header main menu nav section td th".split())


@dataclass(frozen=True)
class Place:
    """What the elements around a block say of it, as counts over all of them, and the container that holds it."""

    tags: int = 0
    names: int = 0
    mixed: int = 0
    content: int = 0
    hidden: bool = False
    inside: bool = False
    apart: bool = False
    container: int = 0


@dataclass
class Block:
    """A run of text between two tags that end lines."""

    text: str
    words: int
    linked: int
    heading: bool
    place: Place


def _names(value: str) -> tuple[int, int, int]:
    """How many names of a class, id or role consist of words for surroundings, hold such a word among others, and name an article."""
    whole = mixed = content = 0
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        parts = [p for p in re.split(r"[^a-z]+", name) if p]
        if not parts or parts[0] in DENIALS:
            continue
        chrome = [p in CHROME_WORDS for p in parts]
        if any(chrome):
            plain = all(c or p in PLAIN_WORDS or p in CONTENT_WORDS for p, c in zip(parts, chrome, strict=True))
            whole, mixed = whole + plain, mixed + (not plain)
        elif any(p in CONTENT_WORDS for p in parts):
            content += 1
    return whole, mixed, content


def _within(place: Place, tag: str, attributes: str, number: int) -> Place:
    """The place of what an element holds. The outermost article starts anew, unless it lies in a part that stands apart by its tag or name (comments, asides, related pages);
    an article's own header belongs to it, and its own names count."""
    inside = tag in ("article", "main") and not place.inside and not place.apart
    if inside:
        place = Place(inside=True, container=number)
    tags, names, mixed, content, hidden, apart = place.tags, place.names, place.mixed, place.content, place.hidden, place.apart
    tags += tag in CHROME_TAGS and not (tag == "header" and place.inside)
    apart |= tag in APART_TAGS
    if tag not in ("html", "body"):
        for name, *values in _ATTRIBUTE.findall(attributes) if "=" in attributes or "hidden" in attributes.lower() else ():
            value, name = "".join(values), name.lower()
            hidden |= name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and bool(re.search(r"display\s*:\s*none", value, re.I))
            if name in ("class", "id", "role"):
                if place.inside:
                    value = re.sub(r"(?i)\b(header|masthead|topbar)\b", "", value)
                more = _names(value)
                names, mixed, content, apart = names + more[0], mixed + more[1], content + more[2] * (not inside), apart or more[0] > 0
    return Place(tags, names, mixed, content, hidden, place.inside, apart, number if tag in CONTAINERS else place.container)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in their order, character references decoded and white space made single spaces.

    Comments, scripts, styles and the head are no text. Markup may be cut off or badly nested: an end tag closes the nearest
    open element of its name, and what is open at the end counts as closed there.
    """
    out: list[Block] = []
    stack: list[tuple[str, Place]] = []
    parts: list[str] = []
    linked, links, heading, opened = 0, 0, False, 0
    at, end = 0, len(page)

    def place() -> Place:
        return stack[-1][1] if stack else Place()

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(raw)
            if links:
                linked += len(html.unescape(raw).split())

    def close() -> None:
        nonlocal linked
        words = html.unescape("".join(parts)).split()
        if words:
            out.append(Block(" ".join(words), len(words), min(linked, len(words)), heading, place()))
        parts.clear()
        linked = 0

    while at < end:
        found = _TAG.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag, closing = found[2].lower(), bool(found[1])
        if tag == "br":
            text(" ")
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if tag in INLINE:
            continue
        close()
        if tag in RAW and not closing:
            over = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = over.end() if over else end
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID:
            if tag == "body":
                stack.clear()  # a head that was never closed ends here
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag or re.fullmatch("h[1-6]", tag) and stack and stack[-1][0] == "p":
                stack.pop()
            elif tag != "p" and stack and stack[-1][0] == "p":
                stack.pop()
            opened += 1
            stack.append((tag, _within(place(), tag, found[3], opened)))
        links = 0 if tag in ("p", "div", "article") else links
        heading = bool(stack) and bool(re.fullmatch("h[1-6]", stack[-1][0]))
    close()
    return out


FIGURES = (
    "words", "link density", "words before", "link density before", "words after", "link density after", "words of the container", "link density of the container", "heading",
    "chrome tags", "chrome names", "mixed names", "content names", "hidden", "place",
)


def figures(found: list[Block]) -> np.ndarray:
    """A row for each block: its words and link density, those of the blocks before and after it and of its container, whether it is a heading, and what the
    elements around it say: counts of their tags and names, and where it is (1 inside an article, -1 outside, 0 where the page marks none)."""
    marked = any(b.place.inside for b in found)
    words, linked = Counter(), Counter()
    for b in found:
        words[b.place.container] += b.words
        linked[b.place.container] += b.linked
    own = [(b.words, b.linked / b.words) for b in found]
    none = (0, 0.0)
    rows = []
    for k, b in enumerate(found):
        p, c = b.place, b.place.container
        near = (*own[k], *(own[k - 1] if k else none), *(own[k + 1] if k + 1 < len(own) else none), words[c], linked[c] / words[c])
        rows.append((*near, b.heading, p.tags, p.names, p.mixed, p.content, p.hidden, (1 if p.inside else -1) if marked else 0))
    return np.array(rows, float).reshape(-1, len(FIGURES))


_SENTENCE = "It had rained for most of the week, and the river stood higher than anyone in the village could remember having seen it.".split()
#: Parts of the labelled pages: how the parts of an article are written, what may stand within one that is not of it, and what stands around it.
#: ``{n}`` stands for a number of words, ``{a}`` for linked words.
_BODY = ("<p>{60}</p>", "<p>{25}</p>", "<p>{40} <a href=x>{2}</a> {20}</p>", "<p>{3}</p>", "<h2>{4}</h2>", "<ul><li>{6}</li><li>{12}</li></ul>", "<blockquote>{18}</blockquote>", "<p><a href=x>{9}</a></p>", "<p>{1}</p>", "<div class=related-work>{35}</div>", "<p class=notice-of-death>{30}</p>")
_BETWEEN = ("<aside>{20}</aside>", "<div class=ad>{9}</div>", "<div class=\"share box\"><a>{1}</a> <a>{1}</a></div>", "<form>{5} <button>{1}</button></form>", "<div class=related><a>{6}</a> <a>{7}</a></div>", "<div id=comments><p>{30}</p><p>{8}</p></div>", "<section class=comments-list><h3>{2}</h3><p>{50}</p></section>", "<div class=newsletter-signup>{14}</div>", "<section class=comments><h2>{1}</h2><article class=comment><header>{1}</header><p>{35}</p></article><article><p>{12}</p></article></section>", "<aside><article class=teaser><h3><a>{5}</a></h3><p>{22}</p></article></aside>")
_BEFORE = ("<nav><ul><li><a>{1}</a></li><li><a>{2}</a></li></ul></nav>", "<header><h1>{3}</h1><p>{9}</p></header>", "<div id=menu><a>{1}</a> <a>{1}</a></div>", "<div class=cookie-notice>{25}</div>", "<div class=\"ad banner\">{11}</div>", "<ul><li><a>{1}</a></li><li><a>{2}</a></li><li><a>{1}</a></li></ul>", "<div><a>{2}</a> | <a>{1}</a> | <a>{2}</a></div>", "<div class=breadcrumbs>{2} <a>{1}</a></div>", "<div id=sidebar><p>{45}</p><p>{10}</p></div>", "<div class=topbar>{4}</div>", "<p><a>{1}</a> <a>{2}</a></p>", "<div hidden>{30}</div>", "<div class=ad>{16}</div>", "<header class=site-header>{5}</header>")
_AFTER = ("<footer>{8}</footer>", "<div class=comments><p>{40}</p><p>{3}</p></div>", "<footer><p>{30}</p><a>{1}</a></footer>", "<div><a>{4}</a> <a>{5}</a></div>", "<div class=sidebar><h3>{2}</h3><ul><li><a>{4}</a></li></ul></div>", "<h3><a>{2}</a></h3><ul><li><a>{18}</a></li><li><a>{12}</a></li></ul>", "<form>{6}</form>", "<p><a>{1}</a> <a>{1}</a> <a>{1}</a></p>", "<div id=footer>{7}</div>", "<aside><p>{55}</p></aside>", "<section id=comments><article class=comment><p>{45}</p></article><article class=comment><p>{6}</p></article></section>", "<article class=comment><p>{30}</p></article>", "<aside><article class=teaser><h3><a>{4}</a></h3><p>{30}</p></article></aside>", "<div role=contentinfo>{14}</div>", "<div role=complementary><p>{35}</p></div>", "<div class=pagination><a>{1}</a> <a>{1}</a></div>")
#: The last parts of a page come before what follows ``|``.
_FRAMES = ("<article><h1>{5}</h1>%s</article>", "<main><article><h1>{5}</h1>%s</article>|</main>", "<main class=site-main><article class=entry>%s</article>|</main>", "<main><article class=card><h2>{3}</h2>%s</article><article class=card><h2>{3}</h2><p>{30}</p></article></main>", "<main><h1>{5}</h1>%s</main>", "<article>%s</article>", "<div class=\"content no-sidebar\"><h1>{6}</h1>%s</div>", "<div id=post-body>%s</div>", "<div><h1>{5}</h1>%s</div>", "<h1>{7}</h1>%s", "<article class=post><header><h1>{6}</h1></header>%s</article>", "<table><tr><td>%s</td></tr></table>", "<section>%s</section>")


def labelled(pages: int = 1500, seed: int = 5) -> list[tuple[str, np.ndarray]]:
    """The labelled table: pages put together from the parts above, and for each of their blocks whether it belongs to the main text.

    A page has an article in one of the frames, or bare text, with or without surroundings; each part's blocks have the part's label.
    """
    draw = random.Random(seed)

    def words(n: int) -> str:
        return " ".join(draw.choice(_SENTENCE) for _ in range(max(1, round(n * draw.uniform(0.5, 1.6)))))

    def write(part: str) -> str:
        return re.sub(r"\{(\d+)\}", lambda m: words(int(m[1])), part)

    def count(page: str) -> int:
        return len(blocks(page))

    table = []
    for k in range(pages):
        if k % 15 == 0:  # nothing but a text
            page = write(draw.choice(("{4}", "{9}", "{30}", "<p>{5}</p>", "<p>{40}</p><p>{9}</p>", "<article><p>{2}</p></article>")))
            table.append((page, np.ones(count(page))))
            continue
        frame = draw.choice(_FRAMES)
        pieces = [(write(p), 0) for p in draw.sample(_BEFORE, draw.randint(0, 3))]
        head, tail = frame.split("%s")
        # without a frame that marks it, an article begins and ends with a long paragraph
        plain = "article" not in frame and "main" not in frame
        long = lambda: (write(draw.choice(("<p>{20}</p>", "<p>{30}</p>", "<p>{60}</p>"))), 1)
        body = [long() for _ in range(plain)] + [(write(draw.choice(_BODY)), 1) for _ in range(draw.randint(1, 6))]
        for _ in range(draw.randint(0, 1) * draw.randint(0, 2)):
            body.insert(draw.randint(1, len(body)), (write(draw.choice(_BETWEEN)), 0))
        body += [long() for _ in range(plain)]
        tail, _, end = tail.partition("|")
        pieces += [(write(head), 1), *body, (write(tail), 1), *[(write(p), 0) for p in draw.sample(_AFTER, draw.randint(0, 3))], (end, 1)]
        page, marks = "", []
        for piece, mark in pieces:
            page += piece
            marks += [mark] * (count(page) - len(marks))
        table.append((page, np.array(marks, float)))
    return table


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 4) -> tuple:
    """A decision tree by Gini impurity, ``least`` rows a leaf: ``(figure, threshold, left, right)`` or ``(label,)``; ties go to the first figure."""
    rate = y.mean()
    if depth == 0 or rate in (0, 1) or len(y) < 2 * least:
        return (bool(rate >= 0.5),)
    best = None
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v, ones = x[order, k], np.cumsum(y[order])
        n = np.arange(1, len(y))
        left, right = ones[:-1], ones[-1] - ones[:-1]
        cost = left * (1 - left / n) + right * (1 - right / (len(y) - n))
        cost[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        at = int(cost.argmin())
        if np.isfinite(cost[at]) and (best is None or cost[at] < best[0] - 1e-9):
            best = (cost[at], k, (v[at] + v[at + 1]) / 2)
    if best is None:
        return (bool(rate >= 0.5),)
    _, k, cut = best
    left = x[:, k] <= cut
    return (k, float(cut), grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least))


@cache
def default_tree() -> tuple:
    """The tree of :func:`labelled`, grown once a session."""
    return train(labelled())


def train(table: list[tuple[str, np.ndarray]]) -> tuple:
    """The tree of a labelled table: pages, and a 0 or 1 for each of their blocks."""
    found = [figures(blocks(page)) for page, _ in table]
    for x, (page, marks) in zip(found, table, strict=True):
        if len(x) != len(marks):
            raise ValueError(f"{len(marks)} labels for {len(x)} blocks: {page[:80]}")
    return grow(np.vstack(found), np.concatenate([marks for _, marks in table]))


def _is_text(tree: tuple, row: np.ndarray) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def main_text(page: str, tree: tuple) -> str:
    """The blocks of the main text, joined by line breaks."""
    found = blocks(page)
    return "\n".join(b.text for b, row in zip(found, figures(found), strict=True) if _is_text(tree, row))


def extract(pages: DataFrame, tree: tuple | None = None, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with ``text_col`` in place of ``html_col``: the main text of the whole page, empty if there is none.

    Null and empty pages have empty text. Each page is handled by itself, so nothing is shuffled. A column named as
    ``text_col`` in the input is replaced.
    """
    tree = default_tree() if tree is None else tree
    kept = [c for c in pages.columns if c not in (html_col, text_col)]
    schema = T.StructType([*pages.select(*kept).schema, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py() or "", tree) for p in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, text_col])

    return pages.select(*kept, html_col).mapInArrow(run, schema)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from pyspark.sql import functions as F

    texts = extract(common.read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op6_html_text": op6_html_text}
SQL: dict[str, str] = {}
