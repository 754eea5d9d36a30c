"""Items and links of pages by each source's own selectors, as table functions in a lateral join.

A page is parsed into a small tree; noise is cut off it, selectors pick the items, and each gives a row, so what a source
asks for reaches the parser as arguments and nothing else leaves it. Selectors are tags, .class, #id, [attr], [attr=value] and
[attr*=value], joined by blanks (descendants) and in lists by commas.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qsl, quote_plus, urljoin, urlsplit, urlunsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is cut off a page before it is read, where its text may be, and what may hold a linked card.
DROPPED = "script, style, noscript, svg, header, footer, nav, [aria-hidden='true'], .ads, .advertisement, .breadcrumb, .cookie, .menu, .modal, .pagination, .share, .social"
ROOTS = ("main", "article", "[role='main']", "body")
CARDS = "article, li, [data-testid*='card'], [data-testid*='listing'], [class*='card'], [class*='listing'], [class*='product']"
TEXT_CHARS = 24_000
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSE_P = {"p", "div", "section", "article", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "main", "header", "footer", "nav", "form", "blockquote", "pre"}


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def below(self) -> Iterator[Node]:
        todo = [iter(self.children)]
        while todo:
            x = next(todo[-1], None)
            if x is None:
                todo.pop()
            elif isinstance(x, Node):
                yield x
                todo.append(iter(x.children))

    def text(self) -> str:
        """Lines without surplus blanks; a br ends a line."""
        out, todo = [], [iter(self.children)]
        while todo:
            x = next(todo[-1], None)
            if x is None:
                todo.pop()
            elif isinstance(x, str):
                out.append(x)
            elif x.tag == "br":
                out.append("\n")
            else:
                todo.append(iter(x.children))
        lines = (re.sub(r"\s+", " ", line).strip() for line in "".join(out).split("\n"))
        return "\n".join(line for line in lines if line)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {}, None)

    def _close(self, tag: str, stops: frozenset[str] = frozenset()) -> None:
        at = self.now
        while at.parent is not None and at.tag != tag and at.tag not in stops:
            at = at.parent
        if at.tag == tag:
            self.now = at.parent

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSE_P:
            self._close("p", frozenset({"td", "th", "button"}))
        elif tag == "li":
            self._close("li", frozenset({"ul", "ol"}))
        made = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(made)
        if tag not in _VOID:
            self.now = made

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in _VOID and tag:
            self._close(tag)

    def handle_data(self, data):
        self.now.children.append(data)


def tree(html: str | None) -> Node:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


class Selector:
    def __init__(self, text: str | None):
        self.options = [[self._part(p) for p in one.split()] for one in (text or "").split(",") if one.strip()]

    @staticmethod
    def _part(text: str) -> tuple:
        bare = re.sub(r"\[[^\]]*\]", "", text)
        tag = re.match(r"[A-Za-z][\w-]*", bare)
        tests = re.findall(r"\[([\w-]+)(?:(\*?=)['\"]?([^'\"\]]*)['\"]?)?\]", text)
        return tag[0].lower() if tag else None, set(re.findall(r"\.([\w-]+)", bare)), re.findall(r"#([\w-]+)", bare), tests

    @staticmethod
    def _one(part: tuple, node: Node) -> bool:
        tag, classes, ids, tests = part
        if tag and tag != node.tag or not classes <= set(node.attrs.get("class", "").split()) or any(node.attrs.get("id") != i for i in ids):
            return False
        return all(k in node.attrs and (not op or (v in node.attrs[k] if op == "*=" else node.attrs[k] == v)) for k, op, v in tests)

    def fits(self, node: Node) -> bool:
        def chain(parts: list[tuple]) -> bool:
            if not self._one(parts[-1], node):
                return False
            at, left = node.parent, parts[:-1]
            while left and at is not None:
                if self._one(left[-1], at):
                    left = left[:-1]
                at = at.parent
            return not left

        return any(map(chain, self.options))

    def first(self, node: Node) -> Node | None:
        return next((x for x in node.below() if self.fits(x)), None)


def canonical(url: str) -> str:
    """Lower-case host, sorted parameters, no fragment, no slash at the end of a path."""
    s = urlsplit(url)
    query = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in sorted(parse_qsl(s.query, keep_blank_values=True), key=lambda p: p[0]))
    return urlunsplit((s.scheme.lower(), s.netloc.lower(), s.path.rstrip("/") or "/", query, ""))


def _absolute(href: str | None, base: str) -> str | None:
    if not href:
        return None
    try:
        full = urljoin(base, href.strip())
        return canonical(full) if full.lower().startswith(("http://", "https://")) else None
    except ValueError:
        return None


def _cut(root: Node, dropped: Selector) -> None:
    for node in [x for x in root.below() if dropped.fits(x)]:
        if node.parent is not None:
            node.parent.children.remove(node)


def _card(item: Node) -> Node:
    """The card around an item that is a link, else the item."""
    if not (item.tag == "a" and "href" in item.attrs) or item.parent is None:
        return item
    cards, at = Selector(CARDS), item.parent
    while at is not None and at.tag:
        if cards.fits(at):
            return at
        at = at.parent
    return item.parent


def items(html: str | None, url: str, item: str | None, link: str | None, content: str | None, drop: str | None = None, most: int | None = None) -> Iterator[tuple[int, str, str]]:
    """(place, ref, text) of a page's items: what ``item`` selects, or the page itself; the first of each reference."""
    root, page = tree(html), canonical(url)
    _cut(root, Selector(f"{DROPPED}, {drop}" if drop else DROPPED))
    most = TEXT_CHARS if most is None else most
    inside = Selector(content) if content else None
    if not item:
        own = (inside.first(root) if inside else None) or next((x for r in ROOTS if (x := Selector(r).first(root))), root)
        if text := own.text()[:most]:
            yield 1, page, text
        return
    picked, linked, anchor, seen = Selector(item), Selector(link) if link else None, Selector("a[href]"), set()
    for place, node in enumerate((x for x in root.below() if picked.fits(x)), 1):
        to = linked.first(node) if linked else node if anchor.fits(node) else anchor.first(node)
        where = inside.first(node) if inside else _card(node)
        text = where.text()[:most] if where else ""
        ref = _absolute(to.attrs.get("href") if to else None, url) or f"{page}#item-{place}"
        if text and ref not in seen:
            seen.add(ref)
            yield place, ref, text


def links(html: str | None, url: str, link: str | None) -> Iterator[tuple[int, str]]:
    """(place, link) of a page: absolute and canonical, each once."""
    root, picked, seen = tree(html), Selector(link or "a[href]"), set()
    for node in (x for x in root.below() if picked.fits(x)):
        href = node.attrs.get("href", "")
        if not href or href.startswith("#") or re.match(r"(?i)(?:mailto|tel|javascript):", href):
            continue
        if (full := _absolute(href, url)) and full not in seen:
            seen.add(full)
            yield len(seen), full


class _Items:
    def eval(self, html, url, item, link, content, drop, most):
        if url is not None:
            yield from items(html, url, item, link, content, drop, most)


class _Links:
    def eval(self, html, url, link):
        if url is not None:
            yield from links(html, url, link)


CONFIG = {"item_selector": "string", "link_selector": "string", "content_selector": "string", "drop_selectors": "string", "max_chars": "int"}


def page_items(pages: DataFrame) -> DataFrame:
    """page_id, place, ref, text: the items of pages (page_id, url, html and the columns of ``CONFIG``, null for the defaults)."""
    made = F.udtf(_Items, returnType="place int, ref string, text string", useArrow=True)
    o = lambda c: F.col(c).outer()
    rows = pages.select("page_id", "url", "html", *(F.col(c).cast(t).alias(c) for c, t in CONFIG.items()))
    return rows.lateralJoin(made(o("html"), o("url"), *map(o, CONFIG))).select("page_id", "place", "ref", "text")


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, place, link: the links of pages (page_id, url, html, link_selector)."""
    made = F.udtf(_Links, returnType="place int, link string", useArrow=True)
    o = lambda c: F.col(c).outer()
    rows = pages.select("page_id", "url", "html", "link_selector")
    return rows.lateralJoin(made(o("html"), o("url"), o("link_selector"))).select("page_id", "place", "link")
