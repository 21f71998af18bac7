"""Main text of web pages by two-pass block rules.

Pass 1 cuts the page into blocks and labels each by length, link density and density of stop words:
good, bad, near-good, or short. What stands in page furniture (menus, footers, sidebars, adverts,
notices, forms, reader comments, by element, role, class or id) is bad whatever its words, unless a
form, header or class name turns out to wrap an article or most of the page's text. On pages that hardly
use the listed stop words, length and link density decide. Pass 2
gives the undecided blocks the label of their nearest decided neighbours on both sides; where these
disagree, the nearer one counts, and the block's own container where both are as near. On a page
without any good or near-good block, as of short paragraphs only, the largest run of undecided blocks is the text, if
it holds at least as much as the page's links. Characters of scripts that write a word in one or two count threefold.

Edge cases: null or empty html, and pages without good blocks, give an empty text; pages cut off in
the middle of a tag or reference are read as far as they go; unclosed elements end with the page;
every row is read by itself, so repeated rows and ids don't matter; null ids and urls pass through;
other columns are ignored. Time is in proportion to the page's length.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundtide.llm.common import map_columns

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+")
SPACE = re.compile(r"\s+")
#: Characters that stand for about three letters: kana, ideographs, syllables of Hangul.
DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0003ffff]")
SENTENCE_END = re.compile(r"[.!?。！？…][\"'»”’)\]]*\Z")

# Element names of HTML, and the commonest function words of four languages.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "canvas", "select", "option", "object", "annotation"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "ul",
}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "button", "dialog", "head"}
CONTENT = {"article", "main"}
#: Elements that may also wrap a whole page or the title of an article.
WRAPPERS = {"header", "form"}
#: Names that stay furniture whatever they hold.
FOREIGN_NAMES = {"comment", "comments", "disqus", "related"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"}
FURNITURE_NAMES = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "popup", "promo", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "widget",
}
STOP_WORDS = set(
    """a an and are as at be but by for from has have he her his in is it its not of on or that the their they this to was
    were which who will with you
    au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous ou par pas plus pour qui que sa se ses
    son sont sur un une vous
    als am auch auf aus bei das dem den der die ein eine einem einen einer er es für hat ich im ist mit nach nicht sich sie
    sind so und von vor war werden wie wird zu zum zur über
    al como con del el ella entre era esta este fue ha hay las lo los más me muy no para pero por se si sin sobre su sus
    también todo una uno y ya""".split()
)

GOOD, BAD, NEAR, SHORT = "good", "bad", "near", "short"


class Block:
    __slots__ = ("text", "linked", "furniture", "content", "within")

    def __init__(self, text: str, linked: int, furniture: bool, content: bool, within: int = 0):
        self.text, self.linked, self.furniture, self.content = text, linked, furniture, content
        self.within = within


def _furniture(name: str, attributes: str) -> str:
    """"" for none, "firm", or "loose" for what may turn out to be a wrapper of the main text."""
    kind = "" if name not in FURNITURE else "loose" if name in WRAPPERS else "firm"
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        words = re.split(r"[^a-z]+", value)
        if key.lower() == "role":
            if words[0] in FURNITURE_ROLES:
                return "firm"
        elif not FOREIGN_NAMES.isdisjoint(words):
            return "firm"
        elif not FURNITURE_NAMES.isdisjoint(words):
            kind = kind or "loose"
    return kind


def _lift(blocks: list[Block], parents: list[int], long: int = 200) -> None:
    """A loose container that holds most of the page's text outside links and firm furniture is a wrapper."""
    free = [0 if b.furniture else len(b.text) - min(b.linked, len(b.text)) for b in blocks]
    held = [0] * len(parents)
    for b, n in zip(blocks, free):
        held[b.within] += n
    for i in range(len(parents) - 1, 0, -1):
        if parents[i]:
            held[parents[i]] += held[i]
    whole, wrapper = sum(free), [True]
    for i in range(1, len(parents)):
        wrapper.append(wrapper[parents[i]] and held[i] >= long and 2 * held[i] > whole)
    for b in blocks:
        b.furniture = b.furniture or not wrapper[b.within]


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, with the characters inside links and the kind of their container."""
    blocks: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, firm furniture, content, loose furniture around
    opened: Counter[str] = Counter()  # how often a name is on the stack
    depth = {"furniture": 0, "content": 0, "a": 0}
    parents, within = [0], 0  # loose furniture: what is around each, and the innermost here

    def flush():
        text = SPACE.sub(" ", html_module.unescape("".join(parts))).strip()
        if text:
            n = len(SPACE.sub(" ", html_module.unescape("".join(linked))).strip())
            blocks.append(Block(text, n, depth["furniture"] > 0, depth["content"] > 0, within))
        parts.clear()
        linked.clear()

    def data(piece: str):
        if piece:
            parts.append(piece)
            if depth["a"]:
                linked.append(piece)

    def close(upto: int):
        nonlocal within
        while len(stack) > upto:
            name, furniture, content, within = stack.pop()
            opened[name] -= 1
            depth["furniture"] -= furniture
            depth["content"] -= content

    def open_(name: str, attributes: str):
        # an element marked as content is never furniture by its name alone, nor by what loosely wraps it
        nonlocal within
        content = name in CONTENT
        kind = "" if content or name in ("html", "body") else _furniture(name, attributes)
        if name == "header" and depth["content"] and kind == "loose":
            kind = ""
        stack.append((name, kind == "firm", content, within))
        opened[name] += 1
        depth["furniture"] += kind == "firm"
        depth["content"] += content
        if content:
            within = 0
        elif kind == "loose":
            parents.append(within)
            within = len(parents) - 1

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            cut = re.search(r"<(?:[a-zA-Z/!?][^<>]*)?\Z", rest)
            data(rest[: cut.start()] if cut else rest)
            break
        data(page[at : m.start()])
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):
            if name == "a":
                depth["a"] = max(0, depth["a"] - 1)
            if name in BLOCK:
                flush()
            if opened[name]:
                upto = len(stack) - 1
                while stack[upto][0] != name:
                    upto -= 1
                close(upto)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if name in BLOCK:
            flush()
            depth["a"] = 0
        if name == "br":
            data(" ")
        if name == "a":
            depth["a"] = 1
        if name in VOID or m.group(3).endswith("/"):
            continue
        if name in ("p", "li", "td", "th", "tr", "dd", "dt", "option") and stack and stack[-1][0] == name:
            close(len(stack) - 1)  # these end where the next of their kind begins
        if name in BLOCK or name == "button":
            open_(name, m.group(3))
    flush()
    _lift(blocks, parents)
    return blocks


def weight(text: str) -> int:
    """The length in letters."""
    return len(text) if text.isascii() else len(text) + 2 * len(DENSE.findall(text))


def known_language(blocks: list[Block]) -> bool:
    """Whether the longer texts of the page use the listed stop words at all."""
    words = [w for b in blocks if not b.furniture and weight(b.text) >= 70 for w in WORD.findall(b.text.lower())]
    return not words or sum(w in STOP_WORDS for w in words) >= 0.1 * len(words)


def first_label(b: Block, known: bool = True, short: int = 70, long: int = 200, stop_low: float = 0.15, stop_high: float = 0.25, links: float = 0.3) -> str:
    """Pass 1, without context."""
    if b.furniture:
        return BAD
    link_share = b.linked / len(b.text)
    if link_share > links:
        sentence = weight(b.text) >= 40 and SENTENCE_END.search(b.text)
        return NEAR if b.content and (link_share <= 0.8 or sentence) else BAD
    if "©" in b.text or "&copy" in b.text:
        return BAD if not b.content else SHORT
    words = WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    size = weight(b.text)
    if size < short:
        return SHORT
    if not known:  # length and link density decide
        return GOOD if size > long or b.content else NEAR
    if stops >= stop_high:
        return GOOD if size > long or b.content else NEAR
    if stops >= stop_low:
        return NEAR
    return NEAR if b.content else BAD


def largest_run(blocks: list[Block], first: list[str]) -> list[bool]:
    """Of a page without good blocks: the run of undecided ones with most text outside links, the first of equals."""
    runs = []
    for i, (b, label) in enumerate(zip(blocks, first)):
        if label == SHORT:
            if not i or first[i - 1] != SHORT:
                runs.append([0, i, i])
            runs[-1][0] += weight(b.text) - b.linked
            runs[-1][2] = i + 1
    size, start, end = max(runs, key=lambda r: r[0], default=(0, 0, 0))
    if size < sum(b.linked for b in blocks if not b.furniture):
        start = end = 0
    return [start <= i < end for i in range(len(blocks))]


def final_labels(blocks: list[Block]) -> list[bool]:
    """Pass 2: undecided blocks take the label of the nearest decided neighbours.

    Furniture inside a content element (a form in an article) says nothing about what stands around it.
    """
    known = known_language(blocks)
    first = [first_label(b, known) for b in blocks]
    if GOOD not in first and NEAR not in first:
        return largest_run(blocks, first)
    n = len(blocks)
    before: list[tuple[int, str] | None] = [None] * n
    after: list[tuple[int, str] | None] = [None] * n
    last = None
    for i in range(n):
        before[i] = last
        if first[i] in (GOOD, BAD) and not (blocks[i].content and blocks[i].furniture):
            last = (i, first[i])
    last = None
    for i in range(n - 1, -1, -1):
        after[i] = last
        if first[i] in (GOOD, BAD) and not (blocks[i].content and blocks[i].furniture):
            last = (i, first[i])
    labels = []
    for i, b in enumerate(blocks):
        if first[i] in (GOOD, BAD):
            labels.append(first[i] == GOOD)
            continue
        sides = [s for s in (before[i], after[i]) if s]
        kinds = {s[1] for s in sides}
        # neighbours outside the container say little about what stands inside it
        if b.content and not any(blocks[s[0]].content for s in sides):
            labels.append(True)
        elif len(kinds) == 1:
            labels.append(kinds == {GOOD})
        elif not kinds:
            labels.append(first[i] == NEAR)
        elif b.content:
            labels.append(True)
        else:
            left, right = i - sides[0][0], sides[1][0] - i
            nearer = sides[0][1] if left < right else sides[1][1] if right < left else BAD if first[i] == SHORT else GOOD
            labels.append(nearer == GOOD)
    return labels


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, good in zip(blocks, final_labels(blocks)) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
        F.coalesce(pages["html"], F.lit("")).alias("html"),
    )

    def make():
        def step(ids, url, html):
            text = [main_text(h) for h in html]
            return [ids, url, text, [len(t) for t in text]]

        return step

    return map_columns(rows, make, "page_id long, url string, text string, n_chars long", chunk=64)
