"""Pages to items, links and text; verdicts; change detection; the link frontier."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.text import Text, _col
from pricetide.functions.urls import canonical_url
from pricetide.operators.dedup import numbered
from pricetide.session import cut

#: Texts and markup of walls that need a person.
WALL_TEXTS = (
    "captcha", "verify you are human", "verify you are not a robot", "are you a human", "unusual traffic", "access denied", "sign in to continue", "login to continue", "just a moment",
    "performing security verification", "checking your browser before accessing", "needs to review the security of your connection", "enable javascript and cookies to continue",
    "ddos protection by", "đăng nhập để tiếp tục", "xác minh bạn không phải", "vui lòng xác minh",
)
WALL_MARKUP = ("cf-browser-verification", "cf_chl_opt", "/cdn-cgi/challenge-platform", "challenge-platform", "__cf_chl", "_incapsula_resource")
#: The reasons that are given for a blocked page.
WALL_REASON, MARKUP_REASON, STATUS_REASON = "bot/auth wall: ", "anti-bot challenge: ", "HTTP "
#: Signals of a listing; two of them make one.
LISTING_SIGNALS = (
    r"(?u)\b\d+(?:[,.]\d+)?\s*(?:tỷ|ty|triệu|tr|vnd|₫|đ)(?![\p{L}\p{N}])",
    r"(?u)\b\d+(?:[,.]\d+)?\s*m(?:2|²)(?![\p{L}\p{N}])",
    r"(?u)\b(?:giá|gia|diện tích|dien tich|căn hộ|can ho|chung cư|chung cu|nhà đất|nha dat)\b",
    r"(?u)\b(?:bán|ban|cho thuê|cho thue|phòng ngủ|phong ngu|pn|apartment|listing)\b",
)
NOISE = {"script", "style", "noscript", "template", "svg", "nav", "header", "footer", "aside", "form", "iframe"}
_BLOCKS = {"p", "div", "section", "article", "li", "ul", "ol", "table", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "main", "body", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ITEM_CHARS = 12_000
AT_ONCE = 64  # pages that Python holds parsed


def looks_like_listing(text: Text) -> Column:
    lowered = F.lower(_col(text))
    return sum((lowered.rlike(p).cast("int") for p in LISTING_SIGNALS), F.lit(0)) >= 2


def verdict(html: Text, text: Text, status: Text) -> Column:
    """Struct (kind, reason): a wall in the text, one in the markup without a listing, a status that blocks, an error, or ok."""
    low_text, low_html, code = F.lower(_col(text)), F.lower(_col(html)), _col(status)
    first = lambda where, known: F.coalesce(*(F.when(where.contains(x), x) for x in known))
    told = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), reason.alias("reason"))
    wall, mark = first(low_text, WALL_TEXTS), first(low_html, WALL_MARKUP)
    http = F.concat(F.lit(STATUS_REASON), code.cast("string"))
    return (
        F.when(wall.isNotNull(), told("blocked", F.concat(F.lit(WALL_REASON), wall)))
        .when(mark.isNotNull() & ~looks_like_listing(text), told("blocked", F.concat(F.lit(MARKUP_REASON), mark)))
        .when(code.isin(401, 403, 429), told("blocked", http))
        .when(code >= 400, told("error", http))
        .otherwise(told("ok", F.lit(None).cast("string")))
    )


class _Selector:
    """Tag, .class, #id, [attr] and [attr*=value], joined in lists by commas."""

    def __init__(self, text: str):
        self.options = []
        for one in filter(None, map(str.strip, (text or "").split(","))):
            tag = re.match(r"[A-Za-z][\w-]*", one)
            classes, ids = re.findall(r"\.([\w-]+)", one), re.findall(r"#([\w-]+)", one)
            self.options.append((tag[0].lower() if tag else None, classes, ids, re.findall(r"\[([\w-]+)(?:(\*?=)['\"]?([^'\"\]]*)['\"]?)?\]", one)))

    def fits(self, tag: str, attrs: dict[str, str]) -> bool:
        def one(option: tuple) -> bool:
            name, classes, ids, tests = option
            own = attrs.get("class", "").split()
            if name and name != tag or not set(classes) <= set(own) or any(attrs.get("id") != i for i in ids):
                return False
            return all(k in attrs and (not op or (v in attrs[k] if op == "*=" else attrs[k] == v)) for k, op, v in tests)

        return any(map(one, self.options))


class _Page(HTMLParser):
    """Visible text, title, links and items of a page in one pass."""

    def __init__(self, item: _Selector, link: _Selector):
        super().__init__(convert_charrefs=True)
        self.item, self.link = item, link
        self.open: list[tuple[str, bool, dict | None]] = []
        self.hidden = 0
        self.text: list[str] = []
        self.title: list[str] = []
        self.links: list[str] = []
        self.items: list[dict] = []
        self.current: list[dict] = []

    def handle_starttag(self, tag, attrs):
        found = {k: v or "" for k, v in attrs}
        if tag in _BLOCKS:
            self._put("\n")
        if tag == "a" and found.get("href"):
            self.links.append(found["href"])
            for item in self.current:
                if item["link"] is None and (not self.link.options or self.link.fits(tag, found)):
                    item["link"] = found["href"]
        if tag in _VOID:
            return
        made = None
        if not self.hidden and self.item.options and self.item.fits(tag, found):
            made = {"text": [], "link": found.get("href") if tag == "a" else None}
            self.items.append(made)
            self.current.append(made)
        noise = tag in NOISE
        self.hidden += noise
        self.open.append((tag, noise, made))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _, _ in self.open):
            return
        while self.open:
            t, noise, made = self.open.pop()
            self.hidden -= noise
            if made is not None:
                self.current.remove(made)
            if t == tag:
                break
        if tag in _BLOCKS:
            self._put("\n")

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "title":
            self.title.append(data)
        else:
            self._put(data)

    def _put(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)
            for item in self.current:
                item["text"].append(data)


def _tidy(parts: list[str]) -> str:
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x)


def parsed(pages: DataFrame, item_selector: str = "", link_selector: str = "") -> DataFrame:
    """page_id, url, title, text, links (absolute, as they come) and items (ref, text) of pages (page_id, url, html)."""
    ddl = "page_id bigint, url string, title string, text string, links array<string>, items array<struct<ref: string, text: string>>"

    text = pa.string()
    made = pa.schema({"page_id": pa.int64(), "url": text, "title": text, "text": text, "links": pa.list_(text), "items": pa.list_(pa.struct({"ref": text, "text": text}))})

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, link = _Selector(item_selector), _Selector(link_selector)
        for batch in frames:
            out = []
            for page_id, url, html in ((r["page_id"], r["url"], r["html"]) for at in range(0, batch.num_rows, AT_ONCE) for r in batch.slice(at, AT_ONCE).to_pylist()):
                p = _Page(item, link)
                p.feed(html or "")
                p.close()
                links = [x for x in (_joined(url, h) for h in p.links) if x]
                items, seen = [], set()
                for x in p.items:
                    ref, text = (_joined(url, x["link"]) if x["link"] else None), _tidy(x["text"])[:ITEM_CHARS]
                    if text and (ref is None or ref not in seen):
                        seen.add(ref)
                        items.append({"ref": ref, "text": text})
                out.append({"page_id": page_id, "url": url, "title": _tidy(p.title) or None, "text": _tidy(p.text), "links": links, "items": items})
                if len(out) == AT_ONCE:
                    yield pa.RecordBatch.from_pylist(out, made)
                    out = []
            yield pa.RecordBatch.from_pylist(out, made)

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, ddl)


def _joined(base: str | None, href: str) -> str | None:
    try:
        full = urljoin(base or "", href.strip())
    except ValueError:
        return None
    return full if full.lower().startswith(("http://", "https://")) else None


def links(found: DataFrame) -> DataFrame:
    """(page_id, link): canonical and distinct by page."""
    return found.select("page_id", F.explode("links").alias("link")).select("page_id", canonical_url("link").alias("link")).where("link is not null").dropDuplicates(["page_id", "link"])


def metadata(html: Text) -> Column:
    """Struct of title, og_title, description and JSON-LD entries (five at most), read before scripts are dropped."""
    h = _col(html)
    attr = lambda key, name: F.nullif(F.trim(F.regexp_extract(h, rf"(?is)<meta[^>]*{key}=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)), F.lit(""))
    title = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit(""))
    data = F.slice(F.regexp_extract_all(h, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1)), 1, 5)
    return F.struct(title.alias("title"), attr("property", "og:title").alias("og_title"), attr("name", "description").alias("description"), data.alias("json_ld"))


def changes(snapshots: DataFrame, url: str, version: str, text: str) -> DataFrame:
    """url, version, text_hash and ``changed``: null for the first snapshot of a URL, else whether its text's hash differs from the one before.

    Hashes alone are moved. Snapshots are numbered within their URL, whatever its number, and each meets the one before.
    """
    placed = cut(numbered(snapshots.select(url, version, F.sha2(text, 256).alias("text_hash")), [url], version))
    before = placed.select(F.col(url).alias("_url"), (F.col("place") + 1).alias("_next"), F.col("text_hash").alias("_before"))
    joined = placed.join(before, F.col(url).eqNullSafe(F.col("_url")) & (F.col("place") == F.col("_next")), "left")
    changed = F.when(F.col("_next").isNotNull(), ~F.col("_before").eqNullSafe(F.col("text_hash")))
    return joined.select(url, version, "text_hash", changed.alias("changed"))


def frontier(edges: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """(url, depth): pages reached from the roots over (src, dst) edges, each at its least depth."""
    seen = level = cut(roots.select(F.col("url")).distinct().withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        step = level.join(edges, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        level = cut(step.join(seen, "url", "left_anti").withColumn("depth", F.lit(d)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def minimum_yield(items: DataFrame, by: str, least: int) -> DataFrame:
    """(by, items, failed): whether a crawl brought too few items."""
    return items.groupBy(by).agg(F.count("*").alias("items")).withColumn("failed", F.col("items") < least)
