"""Fields of listing, detail and maker pages: pages are parsed in Arrow batches; all else is left to Spark SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from catalog_jobs.functions import text as tx

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Labels of a detail page's fields, the first that is found counts.
FIELD_LABELS = {
    "release_date": ["Release Date", "Year:"],
    "censored": ["Censored", "Censored:", "Censorship:"],
    "os": ["OS", "Platforms:"],
    "language": ["Language", "Language:"],
    "translations": ["Translations"],
    "length": ["Length", "Length:"],
    "voice": ["Voices", "Voice:"],
    "vndb": ["VNDB:"],
    "updated": ["Thread Updated", "Updated"],
}


class Node:
    """An element: its children are elements and texts, in order; `at` is its place among its page's elements, `end` the place after its last descendant, `up` its parent's."""

    __slots__ = ("at", "attrs", "children", "end", "tag", "up")

    def __init__(self, tag: str, attrs: dict[str, str | None], at: int, up: int):
        self.tag, self.attrs, self.children, self.at, self.end, self.up = tag, attrs, [], at, at + 1, up

    def text(self) -> str:
        if len(self.children) == 1 and isinstance(self.children[0], str):
            return self.children[0]
        out, stack = [], list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in ("script", "style"):
                stack += reversed(node.children)
        return "".join(out)


class Page:
    """The elements of a page in document order, below a root without a tag. Nodes name others by place, so that a page that is done with is freed at once."""

    def __init__(self) -> None:
        self.nodes = [Node("", {}, 0, 0)]
        self._open = [self.nodes[0]]

    def start(self, tag: str, attrs: dict[str, str | None], closed: bool = False) -> None:
        at = self._open[-1]
        node = Node(tag, attrs, len(self.nodes), at.at)
        self.nodes.append(node)
        at.children.append(node)
        if not closed and tag not in _VOID:
            self._open.append(node)

    def end(self, tag: str) -> None:
        """An unclosed element ends with the ancestor that is closed; an end without a start is nothing."""
        if (last := self._open[-1]).tag == tag and last.at:  # as a rule
            last.end = len(self.nodes)
            self._open.pop()
            return
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i].tag == tag:
                self._close(i)
                return

    def data(self, text: str) -> None:
        self._open[-1].children.append(text)

    def finish(self) -> Page:
        self._close(0)
        return self

    def _close(self, i: int) -> None:
        for node in self._open[i:]:
            node.end = len(self.nodes)
        del self._open[i:]

    def all(self, tag: str | None = None, cls: str | None = None, id_: str | None = None, within: Node | None = None) -> list[Node]:
        found = self.nodes[1:] if within is None else self.nodes[within.at + 1 : within.end]
        if tag is not None:
            found = [n for n in found if n.tag == tag]
        if cls is not None:
            found = [n for n in found if cls in (n.attrs.get("class") or "").split()]
        return found if id_ is None else [n for n in found if n.attrs.get("id") == id_]

    def after(self, node: Node) -> str | Node | None:
        rest = self.nodes[node.up].children
        at = next(i for i, c in enumerate(rest) if c is node)
        return rest[at + 1] if at + 1 < len(rest) else None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()

    def handle_starttag(self, tag, attrs):
        self.page.start(tag, dict(attrs))

    def handle_startendtag(self, tag, attrs):
        self.page.start(tag, dict(attrs), closed=True)

    def handle_endtag(self, tag):
        self.page.end(tag)

    def handle_data(self, data):
        self.page.data(data)


#: Start tags (name, attributes), end tags and texts of pages that are written plainly.
_TOKEN = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*="[^"<>&]*")*)>|</([a-z][a-z0-9]*)>|([^<]+)')
_ATTRIBUTE = re.compile(r' ([a-z0-9-]+)="([^"]*)"')
#: Elements whose content isn't read as elements and texts.
_RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)?")


def _plain(html: str) -> Page | None:
    """What HTMLParser gives, several times faster; None for a page with anything else than plain tags and texts."""
    if "<!" in html:
        return None
    page = Page()
    start, end, data, length = page.start, page.end, page.data, 0
    for tag, attrs, ended, text in _TOKEN.findall(html):
        if text:
            data(unescape(text) if "&" in text else text)
            length += len(text)
        elif ended:
            end(ended)
            length += len(ended) + 3
        elif tag in _RAW:
            return None
        else:
            start(tag, dict(_ATTRIBUTE.findall(attrs)) if attrs else {})
            length += len(tag) + len(attrs) + 2
    return page.finish() if length == len(html) else None  # else something between the tokens was passed over


def _closed(html: str) -> str:
    """References without a semicolon, or with an unknown name, as plain text."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[0][1:]}", html)


def parse(html: str | None, closed_references: bool = False) -> Page:
    """closed_references: only references that end with a semicolon count; else also those that HTML reads without one."""
    html = html or ""
    if closed_references and "&" in html:
        html = _closed(html)
    if (page := _plain(html)) is not None:
        return page
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.page.finish()


def first(nodes: list[Node], n: int = 0) -> Node | None:
    return nodes[n] if len(nodes) > n else None


def labelled(page: Page, labels: list[str], bold: list[Node]) -> str | None:
    """The text right after the first of some <b> whose whole text is one of the labels, without colons; a tag there falls through to the next label."""
    for label in labels:
        node = next((b for b in bold if b.children == [label]), None)
        if node is not None and isinstance(value := page.after(node), str):
            return value.strip().replace(":", "").strip()
    return None


LISTING_ITEM = "array<struct<pos: int, anchors: array<struct<text: string, href: string>>, start_date: string, latest_date: string, replies: string, views: string, rating: string>>"


def _listing_items(html: str | None) -> list[dict]:
    out, page = [], parse(html)
    for pos, item in enumerate(page.all("div", "structItem")):
        title = first(page.all("div", "structItem-title", within=item))
        anchors = [{"text": a.text(), "href": a.attrs.get("href")} for a in (page.all("a", within=title) if title else [])]
        start = [t for li in page.all("li", "structItem-startDate", within=item) for t in page.all("time", within=li)]
        latest = page.all("time", "structItem-latestDate", within=item)
        counts = [dl.text() if not (dd := page.all("dd", within=dl)) else dd[0].text() for meta in page.all("div", "structItem-cell--meta", within=item)[:1] for dl in page.all("dl", within=meta)]
        stars = first(page.all("span", "ratingStars", within=item))
        out.append({
            "pos": pos, "anchors": anchors, "start_date": start[0].attrs.get("datetime") if start else None, "latest_date": latest[0].attrs.get("datetime") if latest else None,
            "replies": counts[0] if counts else None, "views": counts[1] if len(counts) > 1 else None, "rating": stars.text().strip() if stars else None,
        })
    return out


DETAILS = (
    "struct<has_post: boolean, overview_1: string, overview_2: string, tags: array<string>, hrefs: array<string>, dds: array<string>, banner_src: string, "
    + ", ".join(f"{f}: string" for f in FIELD_LABELS)
    + ">"
)


def _details(html: str | None) -> dict:
    page = parse(html)
    post = first(page.all("div", "bbWrapper"))
    blocks, bold = (page.all(tag, within=post) if post else [] for tag in ("div", "b"))
    tags, extras, image = first(page.all("span", "js-tagList")), first(page.all("div", "message-userExtras")), first(page.all("img", "bbImage"))
    return {
        "has_post": post is not None,
        "overview_1": blocks[0].text() if blocks else None, "overview_2": blocks[1].text() if len(blocks) > 1 else None,
        "tags": [a.text() for a in page.all("a", within=tags)] if tags else [], "hrefs": [a.attrs["href"] for a in (page.all("a", within=post) if post else []) if a.attrs.get("href")],
        "dds": [d.text() for d in page.all("dd", within=extras)] if extras else [], "banner_src": image.attrs.get("src") if image else None,
    } | {f: labelled(page, names, bold) for f, names in FIELD_LABELS.items()}


MAKERS = "array<struct<maker_id: string, name: string, url: string, img: string>>"


def _makers(html: str | None) -> list[dict]:
    page = parse(html)
    body = first(page.all(id_="maker_list_body"))
    out = []
    for row in (r for t in (page.all("tbody", within=body) if body else []) for r in page.all("tr", within=t)):
        cells = page.all("td", within=row)
        if len(cells) > 2:
            link, image = next((a for a in page.all("a", within=cells[2]) if a.attrs.get("href")), None), first(page.all("img", within=cells[2]))
            out.append({"maker_id": cells[0].text(), "name": cells[1].text(), "url": link.attrs["href"] if link else None, "img": image.attrs.get("src") if image else None})
    return out


LINKS = {"links": "array<struct<text: string, href: string>>", "bold": "array<string>", "title": "string"}


def _links(html: str | None, closed_references: bool = False, fields: Iterable[str] = LINKS) -> dict:
    page, out = parse(html, closed_references), {}
    if "links" in fields:
        out["links"] = [{"text": a.text(), "href": a.attrs["href"]} for a in page.all("a") if a.attrs.get("href")]
    if "bold" in fields:
        out["bold"] = [b.text() for b in page.all("b")]
    if "title" in fields:
        head = first(page.all("h1"))
        out["title"] = head.text() if head else None
    return out


#: Pages whose fields are held as Python objects at a time.
_CHUNK = 32


def _extract(schema: str, one: Callable) -> Callable[[Column], Column]:
    """A vectorised function from pages to a struct or array, one parse each. Of a batch, which Spark holds to 64 MB, only _CHUNK pages' fields are Python objects at a time."""
    kind = to_arrow_schema(T.StructType([T.StructField("x", T.DataType.fromDDL(schema))])).field("x").type

    @F.arrow_udf(schema)
    def run(html: pa.Array) -> pa.Array:
        parts = [pa.array([one(h.as_py()) for h in html.slice(at, _CHUNK)], kind) for at in range(0, len(html), _CHUNK)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run


def extract_listing_items(html: Column) -> Column:
    return _extract(LISTING_ITEM, _listing_items)(html)


def extract_maker_rows(html: Column) -> Column:
    return _extract(MAKERS, _makers)(html)


def page_links(html: Column, closed_references: bool = False, fields: Iterable[str] = tuple(LINKS)) -> Column:
    """struct(links(text, href), bold texts, first h1) of any page, or some of these fields; see parse() for references."""
    return _extract("struct<" + ", ".join(f"{f}: {LINKS[f]}" for f in fields) + ">", lambda h: _links(h, closed_references, fields))(html)


def labelled_field(html: Column, labels: list[str]) -> Column:
    """The value of one labelled field of any page; null where no label is found."""
    return labelled_fields(html, {"value": labels})["value"]


def labelled_fields(html: Column, fields: dict[str, list[str]]) -> Column:
    """struct(field: the value of its first label that is found): each page is parsed once for all fields."""
    def one(h: str | None) -> dict:
        page = parse(h)
        bold = page.all("b")
        return {f: labelled(page, labels, bold) for f, labels in fields.items()}

    return _extract("struct<" + ", ".join(f"`{f}`: string" for f in fields) + ">", one)(html)


def listing_items(crawl: DataFrame) -> DataFrame:
    """Listing pages (page_no, html) -> a row for each item, as it stands there: write it once where it is used more than once."""
    return crawl.select("page_no", F.explode(extract_listing_items(F.col("html"))).alias("i")).select("page_no", "i.*")


def listing_rows(items: DataFrame, base_url: str = "", version_match: str = "whole", label_brackets: bool = False, creator_rule: str = "keep_spaces") -> tuple[DataFrame, DataFrame]:
    """listing_items() -> (rows, rejects): parsed items by page_no, pos; rejects lack a start date or links."""
    labels = tx.parse_thread_labels(F.col("anchors"), version_match, label_brackets)
    good = F.col("start_date").isNotNull() & (F.size("anchors") > 0)
    rows = items.filter(good).select("*", labels.alias("l")).select(
        "page_no", "pos", *(F.coalesce(F.col(f"l.{c}"), F.lit("")).alias(c) for c in ("category", "engine", "status", "title", "version", "creator")),
        F.concat(F.lit(base_url), "l.href").alias("site_url"),
        tx.to_epoch(tx.iso_to_text(F.col("start_date"))).alias("thread_publish_date"), tx.to_epoch(tx.iso_to_text(F.col("latest_date"))).alias("last_thread_comment"),
        tx.compact_count(F.col("replies")).alias("replies"), tx.compact_count(F.col("views")).alias("views"), tx.rating_text(F.col("rating")).alias("rating"),
    )
    rows = rows.withColumns({
        "thread_id": tx.thread_id_from_url(F.col("site_url")).try_cast("long"), "short_name": tx.short_name(F.col("title")),
        "id_name": tx.entity_key(F.col("title"), F.col("creator"), creator_rule),
    })
    return rows, items.filter(~good).select("page_no", "pos", F.to_json("anchors").alias("anchors"))


def detail_items(crawl: DataFrame) -> DataFrame:
    """Detail pages (url, html) -> a row for each page with its texts: write it once where it is used more than once."""
    return crawl.select(F.col("url").alias("site_url"), _extract(DETAILS, _details)(F.col("html")).alias("d")).select("site_url", "d.*")


def detail_rows(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """detail_items() -> (details by site_url, rejects: pages without a post)."""
    fields = [F.coalesce(F.col(f), F.lit("")).alias(f) for f in FIELD_LABELS if f not in ("release_date", "updated")]
    rows = parsed.filter("has_post").select(
        "site_url", tx.overview(F.col("overview_1"), F.col("overview_2")).alias("overview"), tx.tag_list(F.col("tags")).alias("tags"), tx.attachment_links(F.col("hrefs")).alias("screens"),
        F.coalesce(F.replace(F.get("dds", 2), F.lit(",")), F.lit("")).alias("likes"), F.coalesce(tx.banner(F.col("banner_src")), F.lit("")).alias("banner_url"),
        tx.to_epoch(F.col("release_date")).alias("release_date"), *fields,
    )
    return rows, parsed.filter("not has_post").select("site_url")


def maker_rows(crawl: DataFrame) -> DataFrame:
    """Maker pages (html) -> maker_id, name, url, img, each maker once."""
    return crawl.select(F.explode(extract_maker_rows(F.col("html"))).alias("m")).select("m.*").filter("maker_id is not null").dropDuplicates(["maker_id"])
