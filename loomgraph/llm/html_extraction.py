"""HTML extraction by two-pass block rules.

The page is cut into text blocks. What a page says of itself (navigation, forms,
hidden elements) goes at once. The first pass decides the other blocks by link
density, length and stop-word density; short and middling blocks stay open. Class
names are hints: they hold as long as good text is left without the elements
that they name, and an article's good text makes all outside it boilerplate. The
second pass gives an open block the label of its nearest decided neighbours.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_WORD = re.compile(r"[^\W_]+")
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BOILER = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "head", "svg", "dialog", "object", "canvas", "audio", "video", "fieldset", "label"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "head",
}
#: Elements whose end tag may be left out before the next of their kind; elements whose names never speak of a part of the page.
SIBLINGS, WHOLE = {"p", "li", "td", "th", "tr", "dt", "dd", "option"}, {"html", "body", "main"}
HINTS = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "cookie", "cookies", "consent", "gdpr", "notice",
    "banner", "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "comment", "comments", "commentlist",
    "disqus", "reply", "replies", "share", "sharing", "social", "subscribe", "subscription", "newsletter", "signup", "login", "related", "recommended", "popup", "modal",
    "overlay", "toolbar", "pagination", "pager", "widget", "alert", "search", "complementary", "contentinfo", "form", "respond",
}
#: Parts of a class name that may stand beside a hint without changing what it names.
BESIDE = {"site", "global", "top", "bottom", "left", "right", "main", "primary", "secondary", "bar", "box", "list", "links", "buttons", "wrapper", "container"}
#: Parts that may stand beside a hint of STRONG: a comment's body or an advert's slot is no article, whereas an article's header or menu of contents is.
AROUND = {
    "area", "author", "avatar", "block", "body", "card", "content", "date", "entry", "feed", "group", "holder", "inner", "inline", "item", "meta", "module", "outer", "panel", "post",
    "posts", "reader", "readers", "row", "section", "slot", "text", "thread", "unit", "user", "users", "visitor", "visitors", "zone",
}
#: Classes, but not ids, which repeat a heading's words, that name what readers wrote.
TALK = {"discussion", "responses"}
#: Names that say the same of a paragraph, an item or a heading itself; the others speak of boxes that hold several.
STRONG = {
    "breadcrumb", "breadcrumbs", "cookie", "cookies", "consent", "gdpr", "notice", "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored",
    "promo", "promotion", "comment", "comments", "commentlist", "reply", "replies", "respond", "share", "sharing", "subscribe", "newsletter", "related",
}
TEXTUAL = {"p", "li", "td", "th", "dd", "dt", "blockquote", "pre", "figure", "figcaption", "caption", "address", "b", "i", "em", "strong", "span", "a", "h1", "h2", "h3", "h4", "h5", "h6"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Frequent function words of the languages that stop-word density is asked for.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so said what up its about than into them can only other time new some could these two may first then do any like my now over such our",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son cette aux ou mais comme on tout nous sa fait été aussi leur bien peut ces y deux même",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy",
}
_STOP = {w for words in STOP_WORDS.values() for w in words.split()}
#: First pass: link density above which a block is boilerplate, characters under which it stays open, stop-word densities under which it is bad and from which on it is good.
MAX_LINKS, SHORT, STOP_LOW, STOP_HIGH = 0.5, 80, 0.08, 0.2
#: Elements that may hold a sentence which is a link, and the words of a sentence; elements of running text whose words need not be those of a language.
SENTENCES, SENTENCE, CODE = {"p", "blockquote", "dd", "figcaption"}, 6, {"pre", "td", "th", "dd", "blockquote"}


class Block:
    """A run of text: boilerplate by its tags, inside an article, in an element with a hint; the tag of its block element; its link density."""

    __slots__ = ("anchors", "boiler", "hint", "inside", "link_chars", "links", "parts", "tag", "text")

    def __init__(self, boiler: bool, inside: bool, hint: bool, tag: str):
        self.parts: list[str] = []
        self.link_chars, self.boiler, self.inside, self.hint, self.tag = 0, boiler, inside, hint, tag
        self.text, self.links, self.anchors = "", 0.0, 0

    @property
    def heading(self) -> bool:
        return self.tag in HEADINGS


def attributes_of(text: str) -> dict[str, str]:
    """Attribute values by lower-cased name; the first of a repeated name holds."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), "".join(values))
    return out


def hinted(tag: str, attributes: dict[str, str]) -> bool:
    """Whether a whole name in class, id or role says that the element is not the article's; a heading's id only repeats its words."""
    names = STRONG if tag in TEXTUAL else HINTS
    if tag not in TEXTUAL and not TALK.isdisjoint(attributes.get("class", "").lower().split()):
        return True
    for key in ("class", "role") if tag in HEADINGS else ("class", "id", "role"):
        for name in attributes.get(key, "").lower().split():
            parts = {x for x in re.split(r"[-_]+", name) if x}
            beside = BESIDE if parts.isdisjoint(STRONG) else BESIDE | AROUND
            if not parts.isdisjoint(names) and parts <= HINTS | beside:
                return True
    return False


def hidden(attributes: dict[str, str]) -> bool:
    """Whether the element isn't shown: by an attribute of that name or by its style, not by what other values say."""
    return (
        attributes.get("hidden", "until-found").lower() != "until-found"
        or attributes.get("aria-hidden", "").lower() == "true"
        or bool(_NO_DISPLAY.search(attributes.get("style", "")))
    )


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text, in order; the work grows with the page alone."""
    out: list[Block] = []
    plain = ("", False, False, False, False)
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag, boilerplate, article, link, hint: of all that is open
    closable: list[str] = []  # the block elements of the stack
    opened: Counter[str] = Counter()
    boiler = inside = link = hint = False
    block = Block(False, False, False, "")
    at, end = 0, len(page)

    def text(a: int, b: int) -> None:
        if a < b:
            part = page[a:b]
            part = htmllib.unescape(part) if "&" in part else part
            block.parts.append(part)
            if link:
                block.link_chars += len("".join(part.split()))

    def cut() -> None:
        nonlocal block
        if block.parts:
            out.append(block)
        block = Block(boiler, inside, hint, closable[-1] if closable else "")

    def close(tag: str) -> None:
        """Everything up to the last open ``tag``."""
        nonlocal boiler, inside, link, hint
        while True:
            top = stack.pop()[0]
            opened[top] -= 1
            if top in BLOCK:
                closable.pop()
            if top == tag:
                break
        _, boiler, inside, link, hint = stack[-1] if stack else plain

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened[tag]:
                close(tag)
            if tag in BLOCK or boiler != block.boiler or hint != block.hint:
                cut()
            continue
        if tag in RAW:
            ends = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = ends.end() if ends else end
            continue
        if tag == "br":
            block.parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                cut()
            continue
        if tag in SIBLINGS and closable and closable[-1] == tag:  # an element that its next sibling closes
            close(tag)
        own_header = tag == "header" and inside and not boiler
        bad, named = tag in BOILER and not own_header, False
        if m[3] and not bad and tag not in WHOLE:
            attributes = attributes_of(m[3])
            bad = hidden(attributes)
            named = not bad and tag != "article" and not own_header and hinted(tag, attributes)
        boiler, link, hint = boiler or bad, link or tag == "a", hint or named
        inside = inside or tag in ("article", "main") and not boiler and not hint
        if m[3].endswith("/"):
            _, boiler, inside, link, hint = stack[-1] if stack else plain
        else:
            stack.append((tag, boiler, inside, link, hint))
            opened[tag] += 1
            if tag in BLOCK:
                closable.append(tag)
        if tag in BLOCK or boiler != block.boiler or hint != block.hint:
            cut()
        block.anchors += tag == "a"
    cut()
    for b in out:
        b.text = " ".join("".join(b.parts).split())
        b.links = b.link_chars / max(1, len(b.text.replace(" ", "")))
        b.parts.clear()
    return [b for b in out if b.text]


def first_pass(blocks: list[Block]) -> list[bool | None]:
    """Good, bad or open by link density, length and stop words, wherever a block stands.

    A paragraph of an article that is a sentence stays open though most of it is one link. If the long blocks together have hardly any stop words, the page's language
    is none of those in STOP_WORDS, and length alone decides.
    """
    words = [_WORD.findall(b.text.lower()) if not b.boiler and len(b.text) >= SHORT and b.links <= MAX_LINKS else [] for b in blocks]
    stops = [sum(w in _STOP for w in own) for own in words]
    told = sum(stops) >= STOP_LOW * sum(map(len, words))
    labels: list[bool | None] = []
    for b, own, n in zip(blocks, words, stops, strict=True):
        density = n / max(1, len(own))
        if b.boiler or b.links > MAX_LINKS:
            labels.append(None if not b.boiler and b.inside and b.tag in SENTENCES and b.anchors == 1 and len(_WORD.findall(b.text)) >= SENTENCE else False)
        elif len(b.text) < SHORT:
            labels.append(None)
        elif not told or density >= STOP_HIGH or density >= STOP_LOW and len(b.text) >= 2 * SHORT:
            labels.append(True)
        elif density >= STOP_LOW or b.inside:  # a table or a list of names in an article goes with what is around it
            labels.append(None)
        else:
            labels.append(False)
    return labels


def classify(blocks: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    labels = first_pass(blocks)
    good = [k for k, x in enumerate(labels) if x]
    article = any(b.inside and not b.hint and x is not False for b, x in zip(blocks, labels, strict=True))
    # a hint that would leave nothing good is no hint: its element holds the text itself
    hold = article or any(not blocks[k].hint for k in good) or not good
    region = [k for k, b in enumerate(blocks) if not b.boiler and not (b.hint and hold)]
    if any(blocks[k].inside and labels[k] is not False for k in region):
        region = [k for k in region if blocks[k].inside]
    out = [False] * len(blocks)
    decided = [j for j, k in enumerate(region) if labels[k] is not None]
    if not any(labels[region[j]] for j in decided) and (not decided or blocks[region[0]].inside):
        decided = []  # nothing to inherit: what is open is all the text there is
    right = 0
    for j, k in enumerate(region):
        own = labels[k]
        if own is None:
            while right < len(decided) and decided[right] < j:
                right += 1
            near = [decided[i] for i in (right - 1, right) if 0 <= i < len(decided)]
            if blocks[k].heading and right < len(decided):
                near = [decided[right]]  # a heading goes with what follows it
            least = len(region) if blocks[k].inside else min((abs(i - j) for i in near), default=0)
            own = not near or any(labels[region[i]] for i in near if abs(i - j) <= least)  # in an article the farther neighbour counts too
        elif not own and 0 < j < len(region) - 1 and blocks[k].tag in CODE and blocks[k].links <= MAX_LINKS:  # code or figures between good blocks
            own = out[region[j - 1]] and _next_decided(labels, region, j)
        out[k] = own
    return out


def _next_decided(labels: list[bool | None], region: list[int], j: int) -> bool:
    """Whether the block of the region after ``j`` is good by itself."""
    return labels[region[j + 1]] is True


def extract(page: str | None) -> str:
    """Main text of a page, blocks joined by one line feed; empty if none."""
    if not page:
        return ""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, keep in zip(blocks, classify(blocks), strict=True) if keep)


def extract_pages(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text, n_chars per row, from the whole html.

    Null html is empty and gives the empty text. Rows are independent: repeats and
    null ids or urls pass through; no rows give none; further columns are ignored.
    """

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(x) for x in batch], dtype="object")

    text = main_text(F.coalesce(pages[html].cast("string"), F.lit("")))
    out = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
