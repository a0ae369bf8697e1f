"""Main text of web pages: the maximum-scoring contiguous run of words and tags."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, plus, small_batches, texts, without

# HTML element names by role, and class or id words that mark what isn't the article.
RAW = ("script", "style", "textarea", "title", "iframe")
SKIPPED = ("noscript", "template", "svg", "select", "math", "object", "canvas", "audio", "video")
NOT_ARTICLE = ("nav", "header", "footer", "aside", "form", "button", "label", "fieldset", "dialog", "menu", "head")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
MARKS = (
    "ad", "ads", "adbox", "adslot", "adunit", "advert", "adverts", "advertisement", "advertising", "alert", "announcement", "author-bio", "banner", "breadcrumb", "breadcrumbs", "byline-bar",
    "comment", "comments", "commentlist", "consent", "cookie", "cookies", "copyright", "dialog", "disclaimer", "disqus", "feedback", "footer", "form", "gdpr", "header", "hidden", "legal", "login", "masthead",
    "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "outbrain", "overlay", "pager", "pagination", "popup", "privacy", "promo", "promoted",
    "promotion", "reactions", "recommended", "related", "replies", "reply", "respond", "responses", "search", "share", "sharing", "sidebar", "signup", "site-info", "skip", "social", "sponsor", "sponsored",
    "subscribe", "subscription", "taboola", "tags", "toolbar", "topbar", "warning", "widget", "widgets",
)
#: First words of a compound that mark it if the last one names a part of a page, and last words that don't mark it.
LEADS = ("ad", "ads", "advert", "advertisement", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "footer", "header", "menu", "nav", "navbar", "newsletter", "promo", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget")
PARTS = (
    "area", "bar", "block", "bottom", "box", "button", "buttons", "card", "cards", "center", "col", "column", "container", "content", "count", "counter", "form", "group", "head", "heading", "holder", "icon", "icons", "inner",
    "item", "items", "label", "left", "link", "links", "list", "main", "module", "outer", "panel", "panels", "post", "posts", "primary", "right", "row", "secondary", "section", "slot", "thread", "title", "top", "tower", "unit",
    "us", "wrap", "wrapper", "zone",
)
NO_MARK = ("free", "none", "less", "off")
#: Words that say what a layout has or lacks, not what it is.
LAYOUT = ("has", "no", "with", "without")
#: Prefixes by which publishing systems write a page's topics, states and layout into classes.
TOPICS = ("author", "category", "entry", "format", "has", "is", "lang", "no", "page", "post", "postid", "single", "status", "subject", "tag", "taxonomy", "term", "topic", "type", "with", "without")
ROLES = ("alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search")
#: Start tags that end an open paragraph, and those that end an open element of their own kind.
BLOCKS = (
    "address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre",
    "section", "table", "ul",
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
LISTS = ("ul", "ol", "menu", "dl", "table", "select")

#: How an element is marked: not at all, by a compound name (or as a form, which can hold a whole page), by a plain name or
#: role, by its kind, as not shown.
PLAIN, COMPOUND, NAMED, KIND, UNSEEN = range(5)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*+[^>]*>|\Z", re.I) for t in RAW}
_SKIPPED = re.compile(rf"""<!--.*?(?:-->|\Z)|<({"|".join(RAW)})(?![^\s/>]).*?(?:</\1\s*+[^>]*>|\Z)|<(/?)({"|".join(SKIPPED)})(?![^\s/>])(?:((?:[^>"']|"[^"]*"|'[^']*')*+)>|([^>]*+)(?:>|\Z))""", re.S | re.I)
#: Features of a word: always, in a link, in a marked part, outside of the article element there is, in a list item.
#: Features of a tag: block, list or link, other inline, each in an unmarked part; any in a marked part.
WORD, TAG = 5, 4


def _mark(word: str) -> int:
    """Whether a class or id says that its element isn't the article: as a whole, by its last word, or by its first word where
    the last names a part of a page; topics of the page and words on its layout say nothing."""
    if word in MARKS:
        return NAMED
    parts = [p for p in re.split(r"[-_:]+", word) if p]
    if len(parts) < 2 or parts[0] in TOPICS or parts[-1] in NO_MARK or any(p in LAYOUT for p in parts):
        return PLAIN
    return COMPOUND if (parts[0] in LEADS and parts[-1] in PARTS) or parts[-1] in MARKS else PLAIN


def _marked(tag: str, attrs: str) -> int:
    found = COMPOUND if tag == "form" else KIND if tag in NOT_ARTICLE else PLAIN
    if tag in ("html", "body", "main") or not attrs:
        return found
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return UNSEEN
        if name == "role" and value.strip() in ROLES:
            found = max(found, NAMED)
        if name in ("class", "id"):
            found = max([found, *map(_mark, value.split())])
    return found


def _closed(tag: str, attrs: str) -> bool:
    """Only SVG and MathML elements close themselves; HTML ones have an end tag or none."""
    return tag in ("svg", "math") and attrs.endswith("/")


def _ends(source: str) -> dict[int, int]:
    """Start of each skipped element that has its end tag -> where that tag ends."""
    ends: dict[int, int] = {}
    starts: dict[str, list[int]] = {t: [] for t in SKIPPED}
    for m in _SKIPPED.finditer(source):
        if not m[3]:
            continue
        tag = m[3].lower()
        if not m[2]:
            if not _closed(tag, m[4] or m[5] or ""):
                starts[tag].append(m.start())
        elif starts[tag]:
            ends[starts[tag].pop()] = m.end()
    return ends


class Page:
    """A page as a run of nodes: words (with their text) and tags, each with its features.

    Elements are read first and judged when their words are known. Of article and main elements, the least marked ones first,
    the one with most words is the principal one; nothing around it counts as marked, whatever it is called.
    Without any, what holds over half of the page's words isn't marked by its name.
    """

    def __init__(self, source: str):
        self.text: list[str | None] = []  # decoded text of word nodes, None for tags
        self.breaks: list[bool] = []  # the node ends a block
        self.own: list[int] = []  # the element that the node is in
        self.kinds: list[tuple[int, bool, bool]] = []  # of a word node words, in a link, in a list item; of a tag kind - 3
        self.tags, self.parent, self.marks = [""], [0], [PLAIN]  # of each element; the first is the page
        stack, deep = [0], {}
        at = 0
        ends: dict[int, int] | None = None

        def close(upto: int) -> None:
            while len(stack) > upto:
                deep[self.tags[stack.pop()]] -= 1

        for m in iter(lambda: _TAG.search(source, at), None):
            if m.start() > at:
                self._words(source[at : m.start()], deep, stack[-1])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if tag in RAW and not (m[1] or m[4]):
                at = _RAW_END[tag].search(source, at).end()
                self._tag(tag, stack[-1])
                continue
            if tag in SKIPPED and not (m[1] or m[4]):  # without its end tag, only the tag itself goes
                ends = _ends(source) if ends is None else ends
                at = ends.get(m.start(), at)
                self._tag(tag, stack[-1])
                continue
            if m[1] or m[4]:  # an end tag closes down to its start tag, if there is one
                if deep.get(tag):
                    i = len(stack) - 1
                    while self.tags[stack[i]] != tag:
                        i -= 1
                    close(i)
                self._tag(tag, stack[-1])
                continue
            attrs = m[3] if m[2] else m[6]
            ended = ("p",) if tag in BLOCKS and deep.get("p") else SIBLINGS.get(tag, ())
            if ended:  # the open element that this one ends without an end tag, if no list or table stands between
                for i in range(len(stack) - 1, 0, -1):
                    open_ = self.tags[stack[i]]
                    if open_ in ended:
                        close(i)
                        if ended == ("p",) or tag not in ("tr",):
                            break
                    elif open_ in LISTS or (ended == ("p",) and open_ in BLOCKS):
                        break
            self._tag(tag, stack[-1])
            if tag in VOID or attrs.endswith("/"):
                continue
            self.parent.append(stack[-1])
            self.tags.append(tag)
            self.marks.append(_marked(tag, attrs))
            stack.append(len(self.tags) - 1)
            deep[tag] = deep.get(tag, 0) + 1
        if at < len(source):
            self._words(source[at:], deep, stack[-1])
        self._judge()

    def _words(self, raw: str, deep: dict[str, int], own: int) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.text.append(text)
        self.breaks.append(False)
        self.own.append(own)
        self.kinds.append((len(text.split()), bool(deep.get("a")), bool(deep.get("li"))))

    def _tag(self, tag: str, own: int) -> None:
        self.text.append(None)
        self.breaks.append(tag not in INLINE)
        self.own.append(own)
        self.kinds.append((-2 if tag in ("a", "li", "ul", "ol", "option", "dl") else -1 if tag in INLINE else -3, False, False))

    def _judge(self) -> None:
        size = len(self.tags)
        words = [0] * size  # outside of links and of what isn't shown, in each element
        for own, (n, link, _) in zip(self.own, self.kinds, strict=True):
            if n > 0 and not link:
                words[own] += n
        for i in range(size - 1, 0, -1):
            if self.marks[i] != UNSEEN:
                words[self.parent[i]] += words[i]
        worst = [PLAIN] * size  # of the marks around each element and its own
        for i in range(1, size):
            worst[i] = max(worst[self.parent[i]], self.marks[i])
        own = [i for i in range(1, size) if self.tags[i] in ("article", "main") and words[i] and worst[i] != UNSEEN]
        for level in (COMPOUND, NAMED, KIND):
            some = [i for i in own if worst[i] <= level]
            if some:
                break
        most = {t: max((i for i in some if self.tags[i] == t), key=lambda i: words[i], default=0) for t in ("article", "main")} if own else {"article": 0, "main": 0}
        a, b = most["article"], most["main"]
        self.principal = a if a and (not b or 2 * words[a] >= words[b]) else b
        around, i = set(), self.principal
        while i:
            around.add(i)
            i = self.parent[i]
        bad = [False] * size
        self.within = [0] * size  # the outermost element of the principal one's kind around each
        kind = self.tags[self.principal] if self.principal else None
        for i in range(1, size):
            p, m = self.parent[i], self.marks[i]
            spared = i in around if self.principal else m <= NAMED and 2 * words[i] > words[0]
            bad[i] = bad[p] or m == UNSEEN or (m != PLAIN and not spared)
            self.within[i] = self.within[p] or (i if self.tags[i] == kind else 0)
        if self.principal:
            self.principal = self.within[self.principal]
        self.skip = [bad[own] or text is None for own, text in zip(self.own, self.text, strict=True)]
        self.feats: list[tuple[int, ...]] = []
        for own, (n, link, item) in zip(self.own, self.kinds, strict=True):
            if n < 0:
                k = 3 if bad[own] else n + 3
                self.feats.append((0,) * WORD + tuple(int(k == j) for j in range(TAG)))
            else:
                outside = bool(kind) and not self.within[own]
                self.feats.append((n, n * link, n * bad[own], n * outside, n * item, 0, 0, 0, 0))

    def region(self, weights: np.ndarray) -> tuple[int, int]:
        """The run of nodes with the largest sum, the first and longest such; (0, 0) if no sum is over zero."""
        if not self.feats:
            return 0, 0
        total = np.concatenate([[0.0], np.cumsum(np.array(self.feats, np.float64) @ weights)])
        low = np.minimum.accumulate(total)
        gain = total - low
        hi = int(gain.argmax())
        if gain[hi] <= 0:
            return 0, 0
        return int(np.argmax(total[: hi + 1] == low[hi])), hi

    def whole(self, weights: np.ndarray) -> set[int]:
        """The article elements (or main ones) that count as a whole: the principal one, and others that score over zero."""
        score: dict[int, float] = {}
        if self.principal:
            for own, x in zip(self.own, np.array(self.feats, np.float64) @ weights, strict=True):
                if top := self.within[own]:
                    score[top] = score.get(top, 0.0) + x
        return {e for e, x in score.items() if x > 0 or e == self.principal}

    def extract(self, weights: np.ndarray) -> str:
        """The words of the best run and of whole articles, which the run's ends don't cut."""
        lo, hi = self.region(weights)
        whole = self.whole(weights)
        parts: list[str] = []
        for i, own in enumerate(self.own):
            if not (lo <= i < hi or self.within[own] in whole) or self.breaks[i]:
                parts.append(" ")
            elif not self.skip[i]:
                parts.append(self.text[i])
        return " ".join("".join(parts).split())


# --- labelled pages: parts with their label, dealt into pages; the weights are fitted to them ---


def labelled_pages(n: int = 60, seed: int = 11) -> list[list[tuple[int, str]]]:
    """Pages as (1 if article, else 0; html) parts: invented words in the usual arrangements of web pages."""
    rng = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choices("abdeghiklmnoprstuv", k=rng.randint(2, 9))) for _ in range(rng.randint(lo, hi)))

    def items(lo: int, hi: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(rng.randint(lo, hi)))

    def article() -> list[tuple[int, str]]:
        parts = [(1, f"<h1>{words(3, 10)}</h1>")]
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.7:
                parts.append((1, f"<p>{words(8, 80)} <a href='/x'>{words(1, 2)}</a> <b>{words(1, 4)}</b> {words(5, 30)}</p>"))
            elif kind < 0.8:
                parts.append((1, "<ul>" + "".join(f"<li>{words(4, 15)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"))
            elif kind < 0.9:
                parts.append((0, f'<div class="ad">{words(3, 20)}</div>'))
            else:
                parts.append((1, f"<blockquote>{words(5, 30)}</blockquote>"))
        return parts

    pages = []
    for i in range(n):
        open_, close = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post">', "</div>"), ("<article>", "</article>")])
        page = [(0, f"<head><title>{words(3, 9)}</title></head><body>"), (0, f"<nav><ul>{items(3, 9)}</ul></nav>")]
        if i % 3:
            page.append((0, rng.choice(["<div>{}</div>", "<header>{}</header>", '<div class="notice">{}</div>', '<div class="ad">{}</div>']).format(words(3, 14))))
        page += [(0, open_), *article(), (0, close)]
        if i % 2:
            page.append((0, f"<div><ul>{items(3, 8)}</ul></div>"))
        if i % 4 == 1:
            page.append((0, f'<section class="comments">{"".join(f"<p>{words(5, 40)}</p>" for _ in range(rng.randint(1, 6)))}</section>'))
        if i % 4 == 2:
            page.append((0, f'<aside>{words(5, 40)}</aside><form><label>{words(1, 3)}</label><input></form>'))
        page.append((0, f"<footer>{words(4, 20)}</footer></body>"))
        pages.append(page)
    return pages


@cache
def fitted_weights() -> tuple[float, ...]:
    """Log-odds of each feature, by logistic regression on the labelled pages; plain words stay over zero, tags under."""
    x, y = [], []
    for parts in labelled_pages():
        page = Page("".join(p for _, p in parts))
        ends = np.cumsum([len(Page(p).feats) for _, p in parts])
        label = np.repeat([lab for lab, _ in parts], np.diff([0, *ends]))
        if len(label) == len(page.feats):
            x.append(np.array(page.feats, np.float64))
            y.append(label)
    a, t = np.concatenate(x), np.concatenate(y)
    size = np.maximum(a[:, 0], a[:, WORD:].sum(1))
    unit = np.where(a > 0, 1.0, 0.0)
    w = np.zeros(a.shape[1])
    low = np.array([0.3, -2, -6, -6, -2, -2, -2, -2, -2])
    high = np.array([2, 0, -1.3, -1.0, 0, -0.1, -0.6, -0.02, -0.02])
    for _ in range(400):
        p = 1 / (1 + np.exp(-unit @ w))
        w = np.clip(w - 0.5 * (unit.T @ (size * (p - t)) / size.sum() + 1e-4 * w), low, high)
    return tuple(w)


def extract_text(pages: DataFrame, weights: tuple[float, ...] | None = None) -> DataFrame:
    """pages with text, the main text of html. Null, empty and article-less pages give ''. Cut-off tags, comments and
    elements end with the page. Repeated rows each get their text; an empty table gives an empty
    table. Other columns stay; one named text gives way. Pages are read whole, however long."""
    small_batches(pages.sparkSession)
    pages = without(pages, ["text"])
    w = np.array(weights or fitted_weights())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield appended(b, {"text": pa.array([Page(t.decode()).extract(w) for t in texts(b, "html")], pa.string())})

    return pages.mapInArrow(run, plus(pages, "text string"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
