"""Main text of web pages by removal of site templates.

Every page is parsed into elements; each block element's subtree (tag, class, id, texts, children) is hashed.
Spark counts on how many distinct pages of its host each subtree occurs, and subtrees found on many of them are
deleted.  Pages of a host with the same main content are copies and count once, by one of them.
Menus, headers, footers, sidebars, adverts, forms and comments that say what they are by tag, role, class or id are
deleted as well, so hosts with few pages need no counts.  What is left of the article (or main) element
is the text; a page without one gives what is left of its body.

Inside an article only containers are deleted by count: a paragraph that many articles quote is article text.

Defined results: null html is empty, and an empty page gives the empty text; a null or unreadable url has no host,
and such pages are compared with none; unclosed elements end with their parent or where HTML ends them; ``<br>``
is white space; repeated rows are separate rows; without pages there are no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger.functions.shipping import ship_by_value
from refledger.llm.common import arrow_map, only
from refledger.session import cut_lineage

ship_by_value(__name__)

#: A subtree is a template where it is on MANY distinct pages of its host, whatever the host's size; on small hosts
#: where it is on this share of them, and on LEAST at least.
MANY, SHARE, LEAST = 10, 0.5, 3

MARK = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)"
                  r"((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)

RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
         "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot",
         "thead", "tr", "caption", "ul", "search"}
SPACE = {"br", "td", "th", "option"}
#: Start tag -> open elements that it ends, up to the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}
SCOPE = {"article", "aside", "body", "button", "div", "footer", "header", "html", "li", "main", "nav", "section",
         "table", "td", "th", "blockquote", "form"}
#: Elements and names that are never article text.
APART = {"head", "script", "style", "textarea", "title", "noscript", "template", "iframe", "nav", "aside", "footer",
         "form", "button", "select", "svg", "canvas", "object", "audio", "video", "menu", "dialog", "search", "noembed",
         "noframes", "xmp", "fieldset", "datalist"}
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner",
         "sidebar", "aside", "widget", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert",
         "comment", "comments", "respond", "disqus", "menu", "nav", "navbar", "navigation", "breadcrumb",
         "breadcrumbs", "pagination", "pager", "share", "sharing", "social", "related", "newsletter", "subscribe",
         "popup", "modal", "overlay", "footer", "masthead", "topbar", "login", "signup", "search", "toolbar", "skip"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form",
         "menu", "menubar", "toolbar"}
MAIN = {"article", "main"}
#: Blocks that hold one text; inside an article these are not deleted by count.
TEXTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "figcaption", "tr", "dt", "dd", "caption"}


class Element:
    __slots__ = ("tag", "label", "apart", "parts", "mark")

    def __init__(self, tag: str, label: str, apart: bool) -> None:
        self.tag, self.label, self.apart = tag, label, apart
        self.parts: list[str | Element] = []
        self.mark = 0


def opened(tag: str, attributes: str, in_main: bool) -> Element:
    label, apart = "", tag in APART or (tag == "header" and not in_main)
    if attributes and tag not in ("html", "body", "article", "main"):
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            label += f" {name.lower()}={value}"
            if name.lower() == "role":
                apart = apart or value.strip() in ROLES
            else:
                apart = apart or not NAMES.isdisjoint(re.split(r"[\s_-]+", value))
    return Element(tag, label, apart)


def parse(page: str) -> Element:
    """Tree of the page; void elements become white space, unknown end tags are ignored."""
    root = Element("", "", False)
    stack, at, lower = [root], 0, None
    inside_main = 0
    while True:
        m = MARK.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            stack[-1].parts.append(html.unescape(text))
        if not m:
            return root
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    inside_main -= sum(e.tag in MAIN for e in stack[depth:])
                    del stack[depth:]
                    break
            continue
        if tag in VOID:
            stack[-1].parts.append(Element(tag, "", False) if tag == "hr" else " ")
            continue
        if tag in BLOCK or tag in ENDS:
            ended, upto = ({"p"}, SCOPE) if tag not in ENDS else ENDS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ended:
                    del stack[depth:]
                    break
                if stack[depth].tag in upto:
                    break
        element = opened(tag, attributes, inside_main > 0)
        stack[-1].parts.append(element)
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            lower = page.lower() if lower is None or len(lower) != len(page) else lower
            end = lower.find(f"</{tag}", at)
            at = len(page) if end < 0 else (page.find(">", end) + 1 or len(page))
            continue
        inside_main += tag in MAIN
        stack.append(element)


def in_order(root: Element) -> Iterator[tuple[Element, bool]]:
    """(element, inside an article) with children before parents, without recursion."""
    todo = [(root, False, False)]
    while todo:
        e, inside, seen = todo.pop()
        if seen:
            yield e, inside
            continue
        todo.append((e, inside, True))
        todo.extend((c, inside or e.tag in MAIN, False) for c in e.parts if isinstance(c, Element))


def marked(root: Element) -> list[int]:
    """Hashes every subtree; returns those that may be deleted by count, in order (as signed 64-bit integers)."""
    found = set()
    for e, inside in in_order(root):
        texts = [f"<{c.mark}>" if isinstance(c, Element) else " ".join(c.split()) for c in e.parts]
        e.mark = xxhash.xxh64_intdigest(f"{e.tag}{e.label}\0{chr(0).join(t for t in texts if t)}".encode()) - (1 << 63)
        if e.tag in BLOCK and e.tag not in ("html", "body") and e.tag not in MAIN and not (inside and e.tag in TEXTS):
            found.add(e.mark)
    return sorted(found)


def main_text(root: Element, templates: frozenset[int]) -> str:
    """Blocks of the article, or of the body where there is none, without what is apart or a template."""
    def gone(e: Element, inside: bool) -> bool:
        return e.apart or (bool(templates) and e.mark in templates and e.tag not in MAIN and e.tag not in ("html", "body", "")
                           and not (inside and e.tag in TEXTS))

    def blocks(tops: list[tuple[Element, bool]]) -> Iterator[str]:
        text: list[str] = []
        todo: list[tuple[object, bool]] = list(reversed(tops))
        while todo:
            e, inside = todo.pop()
            if isinstance(e, str):
                text.append(e)
            elif e is None:
                yield " ".join("".join(text).split())
                text.clear()
            elif not gone(e, inside):
                if e.tag in SPACE:
                    text.append(" ")
                block = e.tag in BLOCK
                if block:
                    yield " ".join("".join(text).split())
                    text.clear()
                    todo.append((None, inside))
                inside = inside or e.tag in MAIN
                todo.extend((c, inside) for c in reversed(e.parts))
        yield " ".join("".join(text).split())

    tops: list[tuple[Element, bool]] = []
    todo = [root]
    while todo:  # outermost articles that are not inside something deleted
        e = todo.pop()
        if gone(e, False):
            continue
        if e.tag in MAIN:
            tops.append((e, False))
        else:
            todo.extend(c for c in reversed(e.parts) if isinstance(c, Element))
    return "\n".join(b for b in blocks(tops or [(root, False)]) if b)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1))


def subtrees(batch: pa.RecordBatch) -> pa.RecordBatch:
    contents, marks = [], []
    for page in batch["html"].to_pylist():
        root = parse(page or "")
        marks.append(marked(root))
        contents.append(xxhash.xxh64_intdigest(main_text(root, frozenset()).encode()) - (1 << 63))
    return pa.RecordBatch.from_arrays(
        [batch["host"], batch["page"], pa.array(contents, pa.int64()), pa.array(marks, pa.list_(pa.int64()))],
        names=["host", "page", "content", "marks"])


def texts(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for page, known in zip(batch["html"].to_pylist(), batch["templates"].to_pylist()):
        root = parse(page or "")
        if known:
            marked(root)
        out.append(main_text(root, frozenset(known or ())))
    return pa.RecordBatch.from_arrays(
        [batch["page_id"], batch["url"], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
        names=["page_id", "url", "text", "n_chars"])


def page_key(url: Column, page: Column) -> Column:
    """Equal for equal pages of one host."""
    return F.xxhash64(host(url), page)


def site_templates(pages: DataFrame, share: float = SHARE, least: int = LEAST, many: int = MANY) -> DataFrame:
    """(page, templates): for each page key, those of its subtrees that are on ``many`` distinct pages of the host, or
    on at least ``share`` of them and on ``least``."""
    hosted = only(pages, "url", "html").select(host(F.col("url")).alias("host"), page_key(F.col("url"), F.col("html")).alias("page"),
                                               "html").filter("host <> ''")
    found = cut_lineage(arrow_map(hosted, subtrees, "host string, page long, content long, marks array<long>",
                                  rows=256).withColumn("host", F.xxhash64("host")))
    # one copy stands for all; the least marks, so that the choice does not depend on the order of rows
    distinct = found.groupBy("host", "content").agg(F.min("marks").alias("marks"))
    # the page itself is counted under a null subtree, so one aggregation gives both counts
    counted = distinct.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "marks")).alias("mark")).groupBy(
        "host", "mark").agg(F.count("*").alias("n"))
    counted = cut_lineage(counted.filter(F.col("mark").isNull() | (F.col("n") >= min(least, many))))
    of_host = counted.filter("mark IS NULL").select(F.col("host").alias("__h"), F.col("n").alias("pages"))
    often = counted.filter("mark IS NOT NULL").join(of_host, F.col("host") == F.col("__h")).filter(
        (F.col("n") >= many) | ((F.col("n") >= F.col("pages") * share) & (F.col("n") >= least))).select(
        F.col("host").alias("__h"), F.col("mark").alias("__m"))
    # a large host may have any number of templates, so every page gets its own ones only
    each = found.groupBy("host", "page").agg(F.min("marks").alias("marks")).select("host", "page", F.explode("marks").alias("mark"))
    return each.join(cut_lineage(often), (F.col("host") == F.col("__h")) & (F.col("mark") == F.col("__m"))).groupBy("page").agg(
        F.collect_list("mark").alias("templates"))


def extract(pages: DataFrame, **options) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    # written first, so that the join below has an exchange on either side and a page with many copies is split
    templates = cut_lineage(site_templates(pages, **options)).withColumnRenamed("page", "__p")
    # pages without a host have a null or empty one and are not among the templates
    rows = only(pages, "page_id", "url", "html").withColumn("page", page_key(F.col("url"), F.col("html")))
    joined = rows.join(templates, F.col("page") == F.col("__p"), "left").select("page_id", "url", "html", "templates")
    kinds = dict(pages.dtypes)
    return arrow_map(joined, texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long", rows=256)
