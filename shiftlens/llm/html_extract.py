"""HTML extraction by equivalence-class template deduction.

A page is a sequence of tokens: opening tags with the path of containers around them, and text runs. Over the pages of one
host, tokens that occur equally often on every page, so with equal occurrence vectors, form an equivalence class; a
vector is compared by its sum of hashes of (page, count), which Spark adds up before and after the shuffle, so
a host of any size is never gathered. Classes of enough tokens and pages are valid if they nest: each token's container
belongs to a valid class too, up to the root. The valid classes are the host's template; what its tokens enclose are slots.

From each page the template's slots are taken as follows. Where the template has an article (or main) element, that slot is
the text; else every slot is. Slots of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out, named by their element or by words of their class, id or role (inside an article only containers, by
a whole class or id that names a box), as are text runs of the template itself: those that occur once on nearly all of at least ``MANY_PAGES`` pages of the host and lie outside the article slot.

Character references are decoded; white space inside a block is one space; ``br`` is white space; blocks are joined by a
line break.

Defined cases: null or empty html has text ""; plain text without a tag is one block; unclosed and stray tags are tolerated; a host
of few pages, or a url without host, has a template of the elements' names only; rows that are equal are pages that
are equal, each with its row; a null url or page_id is kept; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.durable import cut
from shiftlens.llm.common import map_batches

LEAST_PAGES, SUPPORT = 3, 0.5  # pages of a valid class, and its share of the host's pages
MANY_PAGES, NEARLY_ALL = 10, 0.95
LEAST_TOKENS = 2

# Elements of HTML by their role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "td", "th"}
ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "blockquote", "pre", "figcaption", "caption", "address"}
ARTICLE = {"article", "main"}
BOILERPLATE = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "svg", "canvas", "object", "audio", "video"} | RAW
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promotion", "related", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
# With these a word of WORDS is the name of a box, not of a subject.
BOXES = {"area", "bar", "block", "box", "button", "buttons", "container", "content", "form", "icons", "inner", "item", "items", "links", "list", "outer", "panel", "section", "slot", "unit", "wrap", "wrapper"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An open element: its path in the template, the opening token of the slot it makes or lies in, and whether it
    lies in an article or in boilerplate."""

    __slots__ = ("tag", "path", "slot", "article", "dropped")

    def __init__(self, tag: str, path: str, slot: str, article: bool, dropped: bool) -> None:
        self.tag, self.path, self.slot, self.article, self.dropped = tag, path, slot, article, dropped


def attributes_of(source: str) -> dict[str, str]:
    """Attributes of a tag by their whole names, values consumed in order; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _names_box(name: str) -> bool:
    words = set(re.split("[-_]+", name))
    return not words.isdisjoint(WORDS) and words <= WORDS | BOXES


def _is_boilerplate(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in BOILERPLATE or tag == "header" and not in_article or "hidden" in attributes:
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
    if in_article:  # ids of headings and sections are often made of their subject
        return tag not in ARTICLE | HEADINGS | INLINE | {"p"} and any(map(_names_box, names.split()))
    named = _WORD.findall(names)
    return tag not in ARTICLE | {"html", "body"} and not WORDS.isdisjoint(named) or tag not in {"html", "body", "article", "main", "h1"} and "header" in named


def tokens(page: str) -> Iterator[tuple[str, Node, str]]:
    """("open", node, opening token of the slot around it), ("close", node, tag) and ("text", node around it, raw text) in page order."""
    stack, at = [Node("", "", "", False, False)], 0
    size = len(page)
    while at < size:
        found = _TAG.search(page, at)
        if found is None:
            yield "text", stack[-1], page[at:]
            return
        if found.start() > at:
            yield "text", stack[-1], page[at : found.start()]
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            for _ in range(len(stack) - depth if depth else 0):
                yield "close", stack.pop(), tag
            continue
        if tag in ENDS_PARAGRAPH or tag in {"li", "tr", "dt", "dd"}:
            ends = {"p"} if tag in ENDS_PARAGRAPH else {"dt", "dd"} if tag in {"dt", "dd"} else {tag}
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ends or stack[i].tag not in INLINE and stack[i].tag != "p"), 0)
            if depth and stack[depth].tag in ends:
                for _ in range(len(stack) - depth):
                    yield "close", stack.pop(), stack[-1].tag
        attributes = attributes_of(found[3] or found[6] or "")
        around = stack[-1]
        name = " ".join(filter(None, (tag, attributes.get("class"), attributes.get("id"))))
        article = around.article or tag in ARTICLE
        leaf = tag in INLINE or tag in LEAVES  # these don't name slots
        path = around.path if leaf else f"{around.path}/{name}"
        node = Node(tag, path, around.slot if leaf else f"<{path}|{tag}", article, around.dropped or _is_boilerplate(tag, attributes, around.article))
        yield "open", node, around.slot
        if tag in VOID:
            yield "close", node, tag
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            yield "close", node, tag
            continue
        stack.append(node)


def token_name(kind: str, node: Node, value: str) -> str:
    return f"<{node.path}|{node.tag}" if kind == "open" else f"#{node.path}|{_SPACE.sub(' ', value).strip()}"


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``page_id``, ``url``, ``html`` (null: empty) and ``host``."""
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return plain.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))))


def occurrences(keyed: DataFrame) -> DataFrame:
    """``host``, ``token``, ``parent``, ``is_text``, ``page``, ``n``: how often each token occurs on each page."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for host, page, source in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
                count, parent = Counter(), {}
                for kind, node, value in tokens(source):
                    if kind == "open" or kind == "text" and not node.dropped and value.strip():
                        name = token_name(kind, node, value)
                        count[name] += 1
                        parent[name] = value if kind == "open" else node.slot
                for name, n in count.items():
                    for column, item in zip(out, (host, _hash(name), _hash(parent[name]), name[0] == "#", page, n), strict=True):
                        column.append(item)
                if len(out[0]) > 1 << 16:
                    yield out
                    out = [[] for _ in range(6)]
            yield out

    source = keyed.filter("host <> ''").select("host", F.xxhash64("page_id", "url", "html").alias("page"), "html")
    return map_batches(source, run, "host string, token long, parent long, is_text boolean, page long, n long")


def templates(keyed: DataFrame) -> DataFrame:
    """``host`` and the ``tokens`` of its valid classes: array of (token, parent, is_text, vector, once)."""
    seen = occurrences(keyed).groupBy("host", "token").agg(
        F.min("parent").alias("parent"), F.max("is_text").alias("is_text"), F.count("*").alias("pages"), F.sum("n").alias("total"),
        F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector"))
    hosts = keyed.groupBy("host").agg(F.count("*").alias("host_pages"))
    # written, as it is read twice and the pages behind it should be parsed once
    often = cut(seen.filter(F.col("pages") >= LEAST_PAGES).join(hosts, "host").filter(F.col("pages") >= SUPPORT * F.col("host_pages")), "often")
    size = often.groupBy("host", "vector").agg(F.count("*").alias("tokens"))
    valid = often.join(size, ["host", "vector"]).filter(
        (F.col("tokens") >= LEAST_TOKENS) | F.col("is_text") & (F.col("pages") == F.col("total")) & (F.col("pages") >= NEARLY_ALL * F.col("host_pages")))
    nearly_all = F.col("is_text") & (F.col("pages") == F.col("total")) & (F.col("pages") >= NEARLY_ALL * F.col("host_pages")) & (F.col("host_pages") >= MANY_PAGES)
    # at most as many tokens as twice a page of the host has
    return valid.groupBy("host").agg(F.collect_list(F.struct("token", "parent", "is_text", F.col("vector").cast("string").alias("vector"), nearly_all.alias("constant"))).alias("tokens"))


class Template:
    """Valid nested classes of one host."""

    def __init__(self, found: list[dict] | None) -> None:
        by_vector: dict[str, list[dict]] = {}
        for t in found or []:
            by_vector.setdefault(t["vector"], []).append(t)
        names, grown = {_hash("")}, True
        while grown:  # a class nests once the containers of its tokens are in the template, or in the class itself
            grown = False
            for vector, members in list(by_vector.items()):
                own = {t["token"] for t in members}
                if all(t["parent"] in names or t["parent"] in own for t in members):
                    names |= own
                    del by_vector[vector]
                    grown = True
        self.tokens = names
        self.constant = {t["token"] for t in found or [] if t["constant"]}
        self.known = bool(found)


def extract_page(source: str, template: Template) -> str:
    """Text blocks of the page's slots."""
    blocks: list[tuple[bool, str]] = []
    held: list[str] = []
    inside, has_article = False, False

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        if text:
            blocks.append((inside, text))
        held.clear()

    for kind, node, value in tokens(source):
        if kind == "text":
            if node.dropped or template.constant and not node.article and _hash(token_name(kind, node, value)) in template.constant:
                continue
            if node.article != inside:
                flush()
                inside = node.article
            held.append(value)
        elif node.tag == "br":
            held.append(" ")
        elif node.tag not in INLINE:
            flush()
            if kind == "open" and node.tag in ARTICLE and not node.dropped and (not template.known or _hash(token_name(kind, node, "")) in template.tokens):
                has_article = True
        elif node.tag in {"td", "th"}:
            held.append(" ")
    flush()
    return "\n".join(text for article, text in blocks if article or not has_article)


RESULT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every row of ``pages``."""
    keyed = _keyed(pages, id_col, url_col, html_col)
    found = cut(templates(keyed), "templates").withColumnRenamed("host", "of")

    def run(batches):
        known: dict[str, Template] = {}
        for batch in batches:
            out: list[list] = [[], [], [], []]
            columns = [batch.column(c) for c in ("page_id", "url", "html", "host", "tokens")]
            for i in range(batch.num_rows):
                page, url, source, host = (c[i].as_py() for c in columns[:4])
                if host not in known:
                    if len(known) > 64:
                        known.clear()
                    known[host] = Template(columns[4][i].as_py())
                text = extract_page(source, known[host])
                for column, value in zip(out, (page, url, text, len(text)), strict=True):
                    column.append(value)
            yield out

    joined = keyed.join(found, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "host", "tokens")
    return map_batches(joined, run, RESULT)
