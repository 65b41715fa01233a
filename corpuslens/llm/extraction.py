"""HTML main-text extraction by scoring the element tree."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?|(?P<text>[^<]+|<)", re.S)
RAW_END = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes")}
ATTR = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that an opening tag of the key ends first, up to the nearest of the barrier elements.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = frozenset("ul ol dl table select article section div body td th blockquote main aside nav footer header form".split())
CLOSES_P = BLOCK - {"br", "body", "html", "head", "title", "option", "optgroup"}

DROP_TAGS = frozenset(
    "head nav header footer aside form script style noscript iframe template button select textarea input svg math canvas object embed audio video "
    "dialog menu map datalist title xmp noembed noframes label".split()
)
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets notice notices cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe subscription signup login comment comments commentlist reply replies disqus respond share sharing social related "
    "recommended recommendations toolbar pager pagination search copyright disclaimer legal alert skip hidden".split()
)
#: Of these, names that an article's own parts bear as well: inside it they go only if they are links or no sentences.
SOFT_WORDS = frozenset("header masthead widget widgets legal alert disclaimer search skip toolbar aside modal overlay signup login hidden respond".split())
#: Elements that wrap a page's or an article's own text as often as something beside it.
WRAPPERS = frozenset(["form", "header"])
SENTENCE = re.compile(r"[.!?…。！？]")
#: Compounds that tell of another element or of print.
ABOUT = re.compile(r"^(?:has|no|with|without)[-_]|[-_]print$")
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
NEVER_DROP = frozenset("html body article main".split())
PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 figcaption".split())
#: What an element is worth before its paragraphs pass it points.
START = {"article": 25.0, "main": 15.0, "section": 4.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "ul": -3.0, "ol": -3.0, "li": -3.0, "dl": -3.0, "table": -1.0}


class Node:
    __slots__ = ("tag", "parent", "parts", "drop", "named", "soft", "score", "chars", "linked", "scored")

    def __init__(self, tag: str, parent: "Node | None", drop: bool, named: bool = False, soft: bool = False):
        self.tag, self.parent, self.drop, self.named, self.soft = tag, parent, drop, named, soft
        self.parts: list = []  # texts and elements in page order
        self.score, self.chars, self.linked, self.scored = 0.0, 0, 0, False


def _dropped(tag: str, attrs: str) -> tuple[bool, bool, bool]:
    """Whether the element goes, whether it may wrap the page's text all the same, and whether an article may have such a part."""
    if (not attrs or attrs.isspace()) and tag not in DROP_TAGS:
        return False, False, False
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTR.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True, False, False
    if tag in DROP_TAGS and tag not in WRAPPERS:
        return True, False, False
    if tag in NEVER_DROP and not (tag == "article" and "comment" in found.get("class", "").lower()):
        return False, False, False
    if DROP_ROLES & set(found.get("role", "").lower().split()):
        return True, False, False
    names = re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{found.get('class', '')} {found.get('id', '')}").lower().split()
    words = set(re.split(r"[^a-z]+", " ".join(n for n in names if not ABOUT.search(n)))) & DROP_WORDS
    if tag in WRAPPERS:
        return True, True, tag == "header" and words <= SOFT_WORDS
    return bool(words), bool(words) and tag != "article", bool(words) and words <= SOFT_WORDS


class Open:
    """The elements that are open, by tag and by kind, so that a tag finds what it ends without a walk."""

    def __init__(self, root: Node):
        self.stack, self.of, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.of.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth: int) -> None:
        """Closes all elements from ``depth`` on."""
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.of[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def end(self, tag: str) -> None:
        """An end tag: the innermost element of that name closes; one without a partner does nothing."""
        if own := self.of.get(tag):
            if tag in BLOCK or not self.blocks or self.blocks[-1] < own[-1]:  # an inline end tag does not end a block
                self.cut(own[-1])

    def ends_before(self, ended: set[str]) -> None:
        """A start tag that ends elements: the outermost of ``ended`` closes, up to the nearest barrier."""
        wall = max((at[-1] for t in BARRIER if t not in ended and (at := self.of.get(t))), default=0)
        first = [at[i] for t in ended if (at := self.of.get(t)) and (i := bisect_right(at, wall)) < len(at)]
        if first:
            self.cut(min(first))


def parse(page: str) -> Node:
    """The element tree. Unclosed and crossing tags end where their container ends; raw text is skipped whole."""
    root = Node("#root", None, False)
    opened, pos = Open(root), 0
    while m := TOKEN.match(page, pos):
        pos = m.end()
        if (text := m["text"]) is not None or (text := m["cdata"]) is not None:
            opened.stack[-1].parts.append(entities.unescape(text))
        elif m["tag"]:
            tag = m["tag"].lower()
            if m["close"]:
                opened.end(tag)
                continue
            if tag in CLOSES_P or tag in ENDS:
                opened.ends_before(ENDS[tag] | {"p"} if tag in ENDS else {"p"})
            at = opened.stack[-1]
            node = Node(tag, at, *_dropped(tag, m["attrs"]))
            at.parts.append(node)
            if tag in RAW_END:
                pos = RAW_END[tag].search(page, pos).end()
            elif tag not in VOID and not (m["attrs"].endswith("/") and tag not in BLOCK):
                opened.push(node)
    return root


def _walk(root: Node) -> Iterator[Node]:
    """Elements that stay, in page order, parents first."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node) and not p.drop)


def _spare(root: Node) -> None:
    """Takes back elements that went by name, and forms and headers, where they wrap the page's text: they hold the largest article or main, or
    more than half of the text outside links that no other rule drops. If all text went so, it comes back."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in node.parts if isinstance(p, Node) and (not p.drop or p.named))
    if not any(n.named for n in order):
        return
    plain: dict[Node, int] = {}
    for node in reversed(order):  # children before parents
        own = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        plain[node] = 0 if node.tag == "a" else own + sum(plain.get(p, 0) for p in node.parts if isinstance(p, Node))
    article = max((n for n in order if n.tag in ("article", "main") and plain[n]), key=plain.__getitem__, default=None)
    while article is not None:
        if article.named:
            article.drop = False
        article = article.parent
    for node in order:
        if node.named and 2 * plain[node] > plain[root]:
            node.drop = False
    if plain[root] and not _text(root):
        for node in order:
            node.drop = node.drop and not node.named


def _take_back(top: Node) -> None:
    """Inside the article, parts that only a soft name speaks against stay: those with sentences that are not mostly
    links, and its header."""
    stack = [top]
    while stack:
        node = stack.pop()
        if node.drop:
            plain, linked, within = [], 0, [(node, False)]
            while within:
                x, link = within.pop()
                for part in x.parts:
                    if isinstance(part, str):
                        linked += len(part.strip()) if link else 0
                        plain += [] if link else [part.strip()]
                    elif not part.drop or part.soft:
                        within.append((part, link or part.tag == "a"))
            own = sum(map(len, plain))
            node.drop = linked > own or not own or not (node.tag == "header" or any(map(SENTENCE.search, plain)))
        if not node.drop:
            stack.extend(p for p in node.parts if isinstance(p, Node) and (not p.drop or p.soft))


def _text(node: Node) -> str:
    out: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.drop:
            if x.tag in BLOCK:
                out.append(" ")
                stack.append(" ")
            stack.extend(reversed(x.parts))
    return " ".join("".join(out).split())


def _drop_links(parent: Node, stays: Node) -> None:
    """Takes out the children of ``parent`` that are mostly links. Inline ones are judged with the text they run in."""
    kids = [p for p in parent.parts if isinstance(p, Node) and not p.drop and p is not stays]
    inline = [k for k in kids if k.tag not in BLOCK]
    run = sum(len(p.strip()) for p in parent.parts if isinstance(p, str)) + sum(k.chars for k in inline)
    listed = 2 * sum(k.linked for k in inline) > run
    for k in kids:
        if 2 * k.linked > k.chars and (k.tag in BLOCK or listed):
            k.drop = True


def main_text(page: str | None) -> str:
    """Text of the article, main or body next above the best container, without what is mostly links beside the
    container or its ancestors. A form or header that wraps the text stays, and so does an article's own header; inside
    the article a name such as legal or alert drops only what has no sentences or is mostly links. Beside an article, other articles and what scores like the container stay.

    A paragraph passes 1 point, 1 for each comma and 1 for each 100 characters (3 at most) to its parent, half of it
    to the next ancestor and a third to the one after; an element's points are discounted by the share of its
    characters that lie in links. Ties go to the element that comes first. If nothing scores, the whole body stands.
    """
    if not page:
        return ""
    root = parse(page)
    _spare(root)
    order = list(_walk(root))
    for node in reversed(order):  # children before parents
        own = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        kids = [p for p in node.parts if isinstance(p, Node) and not p.drop]
        node.chars = own + sum(k.chars for k in kids)
        node.linked = node.chars if node.tag == "a" else sum(k.linked for k in kids)
        if node.parent is not None and (node.tag in PARAGRAPH or node.tag == "div" and own) and node.chars:
            text = " ".join(p for p in node.parts if isinstance(p, str))
            points = 1.0 + text.count(",") + text.count("、") + min(node.chars / 100, 3.0)
            up = [node] if node.tag == "div" else []
            ancestor = node.parent
            while ancestor is not None and len(up) < 3:
                up.append(ancestor)
                ancestor = ancestor.parent
            for depth, x in enumerate(up):
                if x.tag in ("#root", "html"):
                    continue
                if not x.scored:
                    x.scored, x.score = True, x.score + START.get(x.tag, 0.0)
                x.score += points / (depth + 1)
    best, most = None, 0.0
    for node in order:
        if node.scored:
            node.score *= 1 - node.linked / max(node.chars, 1)
            if node.tag not in PARAGRAPH and (best is None or node.score > most):
                best, most = node, node.score
    if best is None:
        return _text(root)
    top = best
    while top.tag not in ("article", "main", "body") and top.parent is not None:
        at, top = top, top.parent
        _drop_links(top, at)
    _take_back(top if top.tag in ("article", "main") else best)
    kept, bar = [top], max(10.0, most * 0.2)
    if top.tag == "article":  # a page of several articles
        kept = []
        for sibling in top.parent.parts:
            if isinstance(sibling, str) or sibling.drop:
                continue
            links = sibling.linked / max(sibling.chars, 1)
            like = sibling.scored and sibling.score >= bar or sibling.tag == "p" and links < 0.25 and sibling.chars > 80
            if sibling is top or like or sibling.tag == "article" and links <= 0.5:
                kept.append(sibling)
    return " ".join(t for t in map(_text, kept) if t)


def extract(pages: DataFrame, text: str = "text") -> DataFrame:
    """page_id, url, the main text and its number of code points, one row per page.

    A null or empty page and one without text give an empty text; page_id and url are passed on, nulls too. Repeated
    rows give repeated rows, an empty table none; extra columns are not read. Whole pages are parsed, however long.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [main_text(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], text: found, "n_chars": [len(t) for t in found]})

    rows = pages.select(pages["page_id"].cast("long"), "url", "html")
    return rows.mapInPandas(run, f"page_id long, url string, {text} string, n_chars long")
