"""A small tolerant HTML reader: the block tree of a page and the text blocks in page order."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

TOKEN = re.compile(r"<!--(?:>|->|.*?--!?>)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>", re.S)
BROKEN = re.compile(r"<(?:!--|[!?/a-zA-Z])")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# HTML's void, raw-text and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main map menu nav noscript object ol optgroup option p pre script search section select style summary svg table tbody td template textarea tfoot th thead title tr ul video audio".split()
)
CLOSES_P = BLOCK - frozenset("button canvas iframe map noscript object option optgroup script select style svg template textarea title video audio".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"}}
SCOPES = frozenset("ul ol dl table select article section div aside nav main td th".split())
# What a page is dressed with, by element, ARIA role and words of class or id.
DRESS_TAGS = frozenset("head nav aside footer form script style noscript template iframe svg canvas object button select textarea dialog menu search title map video audio".split())
DRESS_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DRESS_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus submenu breadcrumb breadcrumbs masthead topbar footer footers footnav copyright sidebar sidebars aside rail widget widgets related recommended recommendations trending popular share sharing sharebar social follow newsletter subscribe subscription signup signin login register cookie cookies cookiebar consent gdpr notice notices notification notifications alert alerts popup popups modal overlay paywall comment comments commentlist disqus respond reply replies pagination pager toolbar search searchbar form forms skip skiplink announcement".split()
)
DEAD_TAGS = frozenset("head form script style noscript template iframe svg canvas object button select textarea title map video audio".split())
HEADER_WORDS = frozenset("header headers siteheader pageheader".split())
MAIN_WORDS = frozenset("article main".split())


@dataclass
class Node:
    tag: str
    key: str = ""
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    dressed: str = ""  # "tag", "word" or "header": by the rules it holds no main text
    dead: bool = False  # script, style, form and the like: no text that is read, whatever the rules
    main: bool = False
    chars: int = 0  # letters of its own text, and those of them in links
    links: int = 0


def _attributes(s: str) -> dict[str, str]:
    return {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(s)} if s.strip(" /") else {}


def _words(s: str) -> set[str]:
    return {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", s).lower()) if w}


def _node(tag: str, attributes: str, parent: Node) -> Node | None:
    """A node for a block, or for any element that is dress; None for other inline elements."""
    a = _attributes(attributes) if attributes else {}
    n = Node(tag, parent=parent)
    role = a.get("role", "").lower()
    words = _words(a.get("class", "") + " " + a.get("id", "")) if a else set()
    if tag in ("html", "body"):
        words = set()
    n.main = tag in MAIN_WORDS or role in MAIN_WORDS
    n.dead = tag in DEAD_TAGS or "hidden" in a
    if tag in DRESS_TAGS or role in DRESS_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        n.dressed = "tag"
    elif words & DRESS_WORDS:
        n.dressed = "word"
    elif tag == "header" or words & HEADER_WORDS:
        n.dressed = "header"
    if tag not in BLOCK and not n.dressed:
        return None
    name = re.sub(r"\d+", "0", " ".join(sorted((a.get("class", "") + " " + a.get("id", "")).split()))) if a else ""
    n.key = f"{tag}.{name}" if name else tag
    return n


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The root of a page's block tree, and its text blocks with their nodes, in page order."""
    root = Node("#root", "#root")
    stack: list[tuple[str, Node | None]] = [("#root", root)]  # open elements; inline ones have no node
    opened: Counter[str] = Counter()
    here, buffer, blocks, linked = root, [], [], 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            raw = "".join(buffer)
            text = " ".join(html.unescape(raw).split())
            buffer.clear()
            if text:
                here.texts.append(text)
                here.chars += len(text)
                here.links += min(len(text), round(len(text) * linked / len(raw)))
                blocks.append((here, text))
            linked = 0

    def add(text: str) -> None:
        nonlocal linked
        buffer.append(text)
        if opened["a"]:
            linked += len(text)

    def pop_to(k: int) -> None:
        nonlocal here
        if any(n or t in BLOCK for t, n in stack[k:]):
            flush()
        for t, n in reversed(stack[k:]):
            opened[t] -= 1
            here = n.parent if n else here
        del stack[k:]

    def close(tags: set[str] | frozenset[str], until: frozenset[str]) -> None:
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                pop_to(k)
                return
            if stack[k][0] in until:
                return

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        m = TOKEN.match(page, lt)
        if not m:
            if BROKEN.match(page, lt):  # cut off inside a tag or comment
                break
            add("<")
            at = lt + 1
            continue
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if stack[k][0] in ("td", "th", "article", "main", "body", "li") and tag not in BLOCK:
                    break
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in BLOCK:
            if tag in CLOSES_P:
                close({"p"}, SCOPES - {"section"} if tag == "p" else SCOPES)
            if tag in CLOSED_BY:
                close(CLOSED_BY[tag], SCOPES - CLOSED_BY[tag] if tag not in ("tr", "tbody", "tfoot") else frozenset({"table"}))
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        new = _node(tag, m[3], here)
        if new:
            flush()
            here.children.append(new)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if new:
            if m[3].endswith("/") and tag == "svg":
                continue
            here = new
        stack.append((tag, new))
        opened[tag] += 1
    flush()
    return root, blocks
