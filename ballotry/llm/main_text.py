"""Main text of web pages from flat text blocks.

A page is cut into flat text blocks; a decision tree decides from a block's word count and link
density, those of its neighbours, and the kinds of containers around it whether it is article text.
The tree is trained from the small labelled table below when the job is planned.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches

# Element names of the HTML standard by their role here.
RAW = frozenset("script style noscript template title textarea iframe object svg math select canvas audio video noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
CONTAINERS = frozenset("article main section div nav header footer aside form ul ol dl table figure fieldset dialog details menu button label".split())
BOILER = frozenset("nav footer aside form dialog menu fieldset button label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role attributes that name page furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright disqus footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices pagination pager "
    "popup promo promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "tags toolbar topbar widget widgets contentinfo complementary alert dialog legal discussion feedback responses bio byline".split()
)
# Those that also make a paragraph, heading or phrase furniture, and those that an article element must not have.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising cookie cookies gdpr newsletter popup promo promotion recommended share sharing social sponsor sponsored subscribe".split())
REPLIES = frozenset("comment comments reply replies response responses".split())
#: Elements that hold a whole page or article: their classes speak of its layout.
WHOLE = frozenset("html body main article".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

_TAG = re.compile(r"""<(?:!--(?P<comment>)|(?P<bang>[!?])|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^"'>]|"[^"]*"|'[^']*')*)>|(?P<odd>/?[a-zA-Z][^>]*>?))""")
_ATTR = re.compile(r"""\b(class|id|role|style|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(\bhidden\b(?!\s*=))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")


def _furniture(name: str, attrs: str) -> bool:
    """Whether an element is no main text by its name, its attributes, or words of its class, id or role."""
    if name in BOILER:
        return True
    if not attrs:
        return False
    words = REPLIES if name == "article" else frozenset() if name in WHOLE else FURNITURE if name in CONTAINERS else ADVERTS
    for key, value, hidden in _ATTR.findall(attrs):
        if hidden:
            return True
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "style":
            if "display:none" in value.replace(" ", "") or "visibility:hidden" in value.replace(" ", ""):
                return True
        elif key == "aria-hidden":
            if value == "true":
                return True
        elif not words.isdisjoint(_SPLIT.split(value)):
            return True
    return False


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: bool
    furniture: bool
    heading: bool


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a page in order, character references decoded and white space made single."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # container, inside an article, inside furniture
    text: list[str] = []
    linked: list[str] = []
    in_link = heading = False
    at, n = 0, len(page)

    def flush() -> None:
        if text:
            plain = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if plain:
                _, article, furniture = stack[-1] if stack else ("", False, False)
                out.append(Block(plain, plain.count(" ") + 1, len(" ".join(linked).split()), article, furniture, heading))
            text.clear()
            linked.clear()

    for_tag = _TAG.search
    while at < n:
        m = for_tag(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if in_link:
                linked.append(piece)
        at = m.end()
        if m["comment"] is not None:
            end = page.find("-->", at - 2 if page.startswith("-->", at - 2) else at)
            at = n if end < 0 else end + 3
            continue
        if m["bang"]:
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        if m["name"] is None:  # a tag whose quotes don't close
            continue
        name, closing = m["name"].lower(), bool(m["close"])
        if name in RAW:
            if not closing and not m["attrs"].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = n if end is None else end.end()
            continue
        if closing and stack and stack[-1][0] == name and name not in CONTAINERS:
            flush()
            stack.pop()
            continue
        marked = not closing and name not in CONTAINERS and name not in VOID and name not in WHOLE and _furniture(name, m["attrs"])
        if name in INLINE:
            if name == "a":
                in_link = not closing
            if marked:
                flush()
                stack.append((name, stack[-1][1] if stack else False, True))
            continue
        if name == "br" or name == "hr":
            text.append(" ")
            continue
        flush()
        in_link = False
        heading = name in HEADINGS and not closing
        while stack and stack[-1][0] not in CONTAINERS and stack[-1][0] not in WHOLE and (not closing or name in CONTAINERS):
            stack.pop()  # a marked paragraph or phrase ends where the next block begins
        if marked:
            stack.append((name, stack[-1][1] if stack else False, True))
        if name in CONTAINERS:
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            else:
                _, article, furniture = stack[-1] if stack else ("", False, False)
                own = _furniture(name, m["attrs"]) or name == "header" and not article
                stack.append((name, article or name in ("article", "main"), furniture or own))
        elif name == "html" or name == "body":
            hidden = not closing and _furniture(name, m["attrs"])
            stack.clear()
            if hidden:
                stack.append((name, False, True))
    flush()
    return out


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "in an article", "in furniture", "heading", "page has an article")


def features(page_blocks: list[Block]) -> np.ndarray:
    words = np.array([b.words for b in page_blocks], float)
    density = np.array([min(1.0, b.linked / b.words) for b in page_blocks])
    before = lambda x: np.concatenate(([0.0], x[:-1]))
    after = lambda x: np.concatenate((x[1:], [0.0]))
    flag = lambda name: np.array([float(getattr(b, name)) for b in page_blocks])
    article = flag("article")
    some = np.full(len(words), float((article > 0).any()))
    return np.column_stack([words, density, before(words), before(density), after(words), after(density), article, flag("furniture"), flag("heading"), some])


# The labelled table: small pages, and of each block in order whether it is main text.
_LONG = "The river rose slowly through the night and by morning the lower fields were under a foot of brown water."
_MORE = "Nobody in the village could remember a flood so early in the year, and few had moved their animals in time."
_SIDE = "Read more about the weather in your region and get the forecast by mail every morning for free."
LABELLED: list[tuple[str, str]] = [
    (f"<body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><article><h1>The flood</h1><p>{_LONG}<p>{_MORE}<p>Then it rained.</article><footer>Copyright by us</footer>", "00 1111 0"),
    (f"<body class='no-sidebar header-dark'><header><h2>The Daily Page</h2><p>{_SIDE}</header><main><h1>The flood</h1><p>{_LONG}</p><p>Yes.</p><p>{_MORE}</p></main><aside><h3>Other</h3><p>{_SIDE}</p></aside>", "00 1111 00"),
    (f"<div class=ad>{_SIDE}</div><article><p>One.</p><p>{_LONG}</p><p>Two words.</p></article><div id=comments><p>{_MORE}</p><p>Me too</p></div>", "0 111 00"),
    (f"<div class=top><a href=/>Home</a> <a href=/n>News</a></div><div class=text><p>{_LONG}</p><p>{_MORE}</p><p>It was late.</p><p>{_LONG}</p></div><div class=low><a href=/x>Imprint</a></div>", "0 1111 0"),
    (f"<table><tr><td><a href=1>One</a><td><a href=2>Two</a><td><a href=3>Three</a></table><div><p>{_MORE}</p><p>{_LONG}</p></div><p>Follow us</p><p><a href=/>Back to top</a></p>", "000 11 00"),
    (f"<article><div class=share><a href=t>Share this</a></div><h1>Title here</h1><p>{_LONG} <a href=q>with a link</a></p><ul><li>First point<li>Second point</ul><form><p>Your mail address please</p></form><p>{_MORE}</p></article>", "0 1111 0 1"),
    (f"<article><p>{_LONG}</p><blockquote>{_MORE}</blockquote><p><a href=s>{_SIDE}</a></p><table><tr><td>Rain<td>12 mm</table></article><div class='cookie notice'><p>{_SIDE} {_MORE}</p></div>", "11 1 11 0"),
    (f"<div class=sidebar><p>{_SIDE}</p><p>{_MORE}</p></div><div class=story><h1>A flood</h1><p>{_LONG}</p><p>{_MORE}</p></div><p>Imprint and terms</p>", "00 111 0"),
    (f"<p>{_LONG}</p><p>{_MORE}</p>", "11"),
    (f"<div><p>{_MORE} {_LONG}</p></div><div><a href=1>Older posts in the archive of this page and more</a></div><div><a href=2>Newer posts in the archive of this page</a></div>", "1 0 0"),
    ("<article><h1>Short</h1><p>Only this.</p></article><footer><p>All rights</p></footer>", "11 0"),
    ("<nav><a href=1>One</a></nav><article><p>Word.</p></article>", "0 1"),
    ("<p>Home</p><p>Menu</p><p>Sign in</p>", "000"),
    (f"<table><tr><td><a href=1>Start</a><td><a href=2>Archive</a><tr><td colspan=2><h1>A flood</h1><p>{_LONG}<p>{_MORE}<p>So it went.<p>{_LONG}<tr><td>Made by us<td>2020</table>", "00 11111 00"),
    (f"<div><div><a href=1>Politics</a></div><div><a href=2>Sport and games</a></div></div><div><h2>The water came at night</h2><div>{_LONG}</div><div>{_MORE} <a href=3>See the map</a></div></div><div><div><a href=4>Three more stories of the day</a></div><div>Terms of use</div></div>", "00 111 00"),
    (f"<center>Welcome</center><p>{_MORE}</p><ul><li>Boots are needed in the lower fields<li>Boats are kept at the mill</ul><p>{_LONG}</p><center>Last change in May</center>", "0 1111 0"),
    (f"<div><a href=1>Home</a></div><div><h1>Floods</h1><p>{_LONG}</p><p>{_MORE}</p></div><div><a href=2>Contact us</a></div>", "0 111 0"),
    (f"<article><h1>Title</h1><p>{_LONG}</p><button>Share now</button><p class=advert>{_SIDE}</p><label>Rate</label><p>{_MORE}</p></article>", "11 000 1"),
]


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled pages' blocks."""
    x, y = [], []
    for page, marks in LABELLED:
        own = blocks(page)
        told = [int(c) for c in marks if c != " "]
        assert len(own) == len(told), (page, [b.text for b in own], marks)
        x.append(features(own))
        y += told
    return np.concatenate(x), np.array(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1) -> tuple:
    """A decision tree by Gini impurity: (share of label 1,) or (feature, cut, below or equal, above)."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best: tuple = (len(y) * share * (1 - share) - 1e-9,)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            a, b = y[low], y[~low]
            if min(len(a), len(b)) < least:
                continue
            impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if impurity < best[0]:
                best = (impurity, f, float(cut), low)
    if len(best) == 1:
        return (share,)
    _, f, cut, low = best
    return (f, cut, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def decide(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    f, cut, low, high = tree
    below = x[:, f] <= cut
    out = np.empty(len(x))
    out[below], out[~below] = decide(low, x[below]), decide(high, x[~below])
    return out


def trained_tree() -> tuple:
    return grow(*labelled_table())


def main_text(page: str | None, tree: tuple) -> str:
    own = blocks(page) if page else []
    if not own:
        return ""
    keep = decide(tree, features(own)) >= 0.5
    return " ".join(b.text for b, k in zip(own, keep) if k)


def extract_main_text(pages: DataFrame, tree: tuple | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Defined results: null, empty or text-free pages give an empty text; repeated rows are worked on
    each for itself; an empty table gives no rows; other columns don't matter.
    """
    bound_batches(pages.sparkSession)
    tree = tree or trained_tree()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p, tree) for p in batch.column("html").to_pylist()], pa.string())
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])

    out = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType())])
    got = pages.select("page_id", "url", "html").mapInArrow(each, out)
    return got.withColumn("n_chars", F.char_length("text").cast("long"))
