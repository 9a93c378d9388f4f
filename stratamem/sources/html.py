"""Readable sections of one HTML page, for use inside Arrow-batched functions."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from stratamem import constants as K

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FONT = set("b i u s tt strike big small".split())
TITLES = set("h1 h2 h3 h4 h5 h6".split())
BLOCK = TITLES | set(
    "address article aside blockquote center dir div dl fieldset footer form header hr main menu nav ol "
    "p pre section table ul".split())
# Open tags that a start tag ends.
CLOSES = {
    "p": {"p"} | TITLES | FONT, "li": {"li", "p"} | TITLES, "a": {"a"}, "option": {"option"},
    "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"} | FONT, "th": {"td", "th", "p"} | FONT, "body": {"head"},
}


class Node:
    """An element with its children in order; text is kept as plain strings."""

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def parts(self):
        """Elements and strings below, in document order; depth costs no recursion."""
        ahead = [iter(self.children)]
        while ahead:
            child = next(ahead[-1], None)
            if child is None:
                ahead.pop()
                continue
            yield child
            if isinstance(child, Node):
                ahead.append(iter(child.children))

    def walk(self):
        return (part for part in self.parts() if isinstance(part, Node))

    def strings(self):
        return (part for part in self.parts() if not isinstance(part, Node))

    def text(self, separator: str) -> str:
        return separator.join(s for s in map(str.strip, self.strings()) if s)

    def first(self, wanted) -> Node | None:
        return next((n for n in self.walk() if wanted(n)), None)


class TreeBuilder(HTMLParser):
    """A forgiving tree builder: implied end tags, void tags, stray end tags ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag, {"p"} | (TITLES if tag in TITLES else set()) if tag in BLOCK else set())
        while len(self.open) > 1 and self.open[-1].tag in ends:
            self.open.pop()
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        names = [n.tag for n in self.open[1:]]
        if tag in names:
            at = len(names) - names[::-1].index(tag)
            del self.open[at:]

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def drop_noise(root: Node) -> None:
    ahead = [root]
    while ahead:
        node = ahead.pop()
        node.children = [c for c in node.children
                         if not (isinstance(c, Node) and c.tag in K.HTML_DROPPED)]
        ahead += [c for c in node.children if isinstance(c, Node)]


def page_sections(url: str, html: str, fallback_chars: int | None = None) -> list[dict]:
    """Sections of the page's main area under its h1 to h4 headings.

    A page without headings or blocks is one section with its whole text, or the first
    ``fallback_chars`` of it.
    """
    root = parse(html)
    drop_noise(root)
    named = re.compile(K.HTML_MAIN_ID, re.I)
    choices = (
        lambda n: n.tag == "main", lambda n: n.tag == "article",
        lambda n: n.attrs.get("id") and named.search(n.attrs["id"]), lambda n: n.tag == "body",
    )
    area = next(filter(None, map(root.first, choices)), None)
    title = root.first(lambda n: n.tag == "title")
    page_title = "".join(title.strings()).strip() if title else url

    groups: list[tuple[str, list[str]]] = [(page_title, [])]
    for node in area.walk() if area else ():
        if node.tag not in K.HTML_HEADINGS + K.HTML_BLOCKS:
            continue
        content = node.text(" ")
        if content and node.tag in K.HTML_HEADINGS:
            groups.append((content, []))
        elif content:
            groups[-1][1].append(content)
    found = [
        {"content": re.sub(r"\n{3,}", "\n\n", "\n".join(parts).strip()), "title": name,
         "metadata": {"url": url, "section": name}}
        for name, parts in groups if parts
    ]
    whole = (area or root).text("\n")[:fallback_chars]
    return found or [{"content": whole, "title": page_title, "metadata": {"url": url}}]
