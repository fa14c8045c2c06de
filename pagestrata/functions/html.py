"""HTML to text structure: a small tolerant tree and what is read from it.

Spark calls :func:`capture_html` on Arrow batches; everything relational happens afterwards on its
typed result.
"""

from __future__ import annotations

import html as _entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagestrata.schemas import CAPTURE, LINK

# Fixed values, from the HTML standard: void elements, raw text elements, and the start tags before which an
# end tag may be left out; with them the elements whose text counts as copy here.
VOID = {
    "area", "base", "basefont", "br", "col", "command", "embed", "frame", "hr", "img", "input", "isindex",
    "keygen", "link", "meta", "param", "source", "track", "wbr",
}
RAW = {"script", "style", "title", "textarea"}
CLOSES = {
    "tr": {"tr", "th", "td"}, "th": {"th"}, "td": {"thead", "th", "td"}, "body": {"head", "link", "script"},
    "li": {"li"}, "option": {"option"}, "optgroup": {"optgroup", "option"}, "dd": {"dt", "dd"},
    "dt": {"dt", "dd"}, "tbody": {"thead", "tbody"}, "tfoot": {"thead", "tbody"},
    **{tag: {"p"} for tag in (
        "p h1 h2 h3 h4 h5 h6 address article aside blockquote details div dl fieldset figcaption figure footer "
        "form header hr main nav ol pre section table ul"
    ).split()},
}
NOT_COPY = {"script", "style", "noscript", "svg", "iframe", "form", "nav", "footer"}
COPY = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "button", "a"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# The characters a trim removes, as in the text functions.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_RUN = re.compile(f"[{SPACES}]+")


def clean(text: str | None) -> str:
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    if "  " in text or "\t" in text or "\f" in text or "\v" in text:
        text = re.sub(r"[\t\f\v ]+", " ", text)
    if "\n" in text:
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text))
    return text.strip(SPACES)


def collapse(text: str | None) -> str:
    return _RUN.sub(" ", text or "").strip(SPACES)


class Node:
    """An element with its parent, attributes and children (nodes and strings)."""

    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: dict, parent: "Node | None"):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def get(self, name: str) -> str:
        return self.attributes.get(name) or ""

    def walk(self):
        """Elements below this one in document order."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, Node):
                yield child
                stack.append(iter(child.children))

    def text(self, skip: frozenset | set = frozenset()) -> str:
        out, stack = [], [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, str):
                out.append(child)
            elif child.tag not in skip:
                stack.append(iter(child.children))
        return "".join(out)

    def ancestors(self):
        node = self
        while node is not None:
            yield node
            node = node.parent


def parse(source: str) -> Node:
    root = Node("#document", {}, None)
    here, at = root, 0
    length = len(source)
    while at < length:
        match = _TOKEN.search(source, at)
        if match is None:
            here.children.append(_entities.unescape(source[at:]))
            break
        if match.start() > at:
            here.children.append(_entities.unescape(source[at:match.start()]))
        at = match.end()
        tag = match.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if match.group(1):
            node = here
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                here = node.parent
            continue
        rest = match.group(3)
        while here.tag in CLOSES.get(tag, ()):
            here = here.parent
        attributes = {}
        for name, double, single, bare in _ATTRIBUTE.findall(rest):
            attributes.setdefault(name.lower(), _entities.unescape(double or single or bare))
        node = Node(tag, attributes, here)
        here.children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(source, at)
            stop = end.start() if end else length
            content = source[at:stop]
            node.children.append(content if tag in ("script", "style") else _entities.unescape(content))
            at = end.end() if end else length
        elif tag not in VOID and not rest.rstrip().endswith("/"):
            here = node
    return root


def _first(root: Node, tag: str) -> Node | None:
    return next((n for n in root.walk() if n.tag == tag), None)


def placement(anchor: Node, rendered: bool, heroes: set[int]) -> str:
    """Where on the page a link stands, by the elements around it."""
    around = list(anchor.ancestors())
    tags = {n.tag for n in around}
    if "footer" in tags:
        return "footer"
    nav = next((n for n in around if n.tag in ("nav", "header")), None)
    if nav is not None:
        marker = f"{nav.get('aria-label')} {nav.get('class')}".lower()
        if re.search("utility|secondary|account", marker):
            return "utility-nav"
        menu = any(
            "dropdown" in n.get("class") or "submenu" in n.get("class") or n.get("role") == "menu" for n in around
        )
        return "navigation-dropdown" if menu else "primary-nav"
    if any("hero" in n.get("class") or "hero" in n.get("id") for n in around):
        return "homepage-hero"
    if rendered and any(id(n) in heroes for n in around):
        return "homepage-hero"
    return "body" if "main" in tags else "other"


def _label(node: Node, tidy, skip=frozenset()) -> str:
    return tidy(node.text(skip) or node.get("aria-label"))


def _links(elements: list[Node], rendered: bool, tidy) -> list[dict]:
    """Links with address, text and placement."""
    main = next((n for n in elements if n.tag == "main"), None)
    heroes = {id(c) for c in main.children if isinstance(c, Node) and c.tag == "section"} if main and rendered else set()
    if len(heroes) > 1:
        heroes = {id(next(c for c in main.children if isinstance(c, Node) and c.tag == "section"))}
    return [
        {"href": n.get("href"), "text": _label(n, tidy), "placement": placement(n, rendered, heroes)}
        for n in elements if n.tag == "a" and "href" in n.attributes
    ]


def _release(root: Node, elements: list[Node]) -> None:
    """Unties a tree, whose nodes hold each other, so that it is freed at once and not some pages later."""
    for node in (root, *elements):
        node.parent, node.children = None, []


def links(source: str, rendered: bool = False) -> list[dict]:
    """The links of ``capture`` alone."""
    root = parse(source)
    elements = list(root.walk())
    found = _links(elements, rendered, collapse if rendered else clean)
    _release(root, elements)
    return found


def capture(source: str, rendered: bool = False) -> dict:
    """Title, description, canonical link, language, headings, breadcrumbs, links and sections.

    ``rendered`` reads a page the way a browser shows it: all whitespace collapses, and the first
    section of the main element is a hero too.
    """
    tidy = collapse if rendered else clean
    root = parse(source)
    elements = list(root.walk())
    title_node = next((n for n in elements if n.tag == "title"), None)
    title = tidy(title_node.text() if title_node else "")
    main = next((n for n in elements if n.tag == "main"), None)
    h1 = next((n for n in elements if n.tag == "h1"), None)
    html = next((n for n in elements if n.tag == "html"), None)
    description = next((n for n in elements if n.tag == "meta" and n.get("name") == "description"), None)
    canonical = next(
        (n for n in elements if n.tag == "link" and n.get("rel") == "canonical" and n.get("href")), None
    )
    crumbs = [
        text for n in elements if n.tag == "a"
        and any("breadcrumb" in a.get("aria-label").lower() or "breadcrumb" in a.get("class")
                for a in list(n.ancestors())[1:])
        and (text := tidy(n.text()))
    ]
    body = main or next((n for n in elements if n.tag == "body"), root)
    heading = tidy(h1.text() if h1 else "") or title or "Page"
    sections = []
    for node in _copy_elements(body):
        value = _label(node, tidy, NOT_COPY)
        if not value:
            continue
        if node.tag in HEADINGS:
            heading = value
        elif len(value) >= 2:
            sections.append({"heading": heading, "element": node.tag, "text": value})
    read = {
        "title": title,
        "meta_description": tidy(description.get("content") if description else ""),
        "canonical_url": canonical.get("href") if canonical else None,
        "language": (html.get("lang") if html else "") or None,
        "headings": [t for n in elements if n.tag in ("h1", "h2", "h3") and (t := tidy(n.text()))],
        "breadcrumbs": crumbs,
        "links": _links(elements, rendered, tidy),
        "sections": sections,
    }
    _release(root, elements)
    return read


def _copy_elements(body: Node):
    stack = [iter(body.children)]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        elif isinstance(child, Node) and child.tag not in NOT_COPY:
            if child.tag in COPY:
                yield child
            stack.append(iter(child.children))


def document_chunks(source: str) -> list[dict]:
    """Paragraphs, list items and table cells of a messaging document under their headings."""
    root = parse(source)
    title = _first(root, "title")
    heading = clean(title.text() if title else "") or "Document"
    chunks: list[dict] = []
    stack = [iter(root.children)]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            continue
        if not isinstance(child, Node) or child.tag in NOT_COPY:
            continue
        stack.append(iter(child.children))
        if child.tag not in HEADINGS and child.tag not in ("p", "li", "td", "th"):
            continue
        text = clean(child.text(NOT_COPY))
        if not text:
            continue
        if child.tag in HEADINGS:
            heading = text
        else:
            chunks.append({"kind": "section", "index": len(chunks) + 1, "label": heading, "text": text})
    return chunks


def _capture_udf(rendered: bool):
    fields = ["title", "meta_description", "canonical_url", "language", "headings", "breadcrumbs", "links", "sections"]

    def run(sources: pd.Series) -> pd.DataFrame:
        rows = [capture(s or "", rendered) for s in sources]
        return pd.DataFrame({name: [row[name] for row in rows] for name in fields}, columns=fields)

    return F.pandas_udf(run, CAPTURE)


def capture_html(source: Column, rendered: bool = False) -> Column:
    """The capture struct of an HTML column, computed on Arrow batches."""
    return _capture_udf(rendered)(source)


def html_links(source: Column, rendered: bool = False) -> Column:
    """The links of the capture alone, as an array; null and empty pages have none."""
    def run(sources: pd.Series) -> pd.Series:
        return pd.Series([links(s or "", rendered) for s in sources], dtype=object)

    return F.pandas_udf(run, f"array<{LINK}>")(source)
