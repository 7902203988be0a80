"""A small HTML tree with the selectors that extraction needs: tag, .class, [attr=v], descendant, comma."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

# Elements without content, and the open elements that a start tag ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure",
          "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Descendants in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, br: str = "") -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag == "br":
                out.append(br)
            else:
                stack += reversed(c.children)
        return "".join(out)

    def up(self) -> Iterator[Node]:
        """The node and its ancestors."""
        node: Node | None = self
        while node:
            yield node
            node = node.parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self._close({"p"}, {"button", "table", "td", "th"})
        if tag in ENDS:
            self._close(ENDS[tag], {"ul", "ol", "dl", "table", "select"})
        seen: dict[str, str] = {}
        for k, v in attrs:
            seen.setdefault(k, v or "")
        node = Node(tag, seen, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID and any(n.tag == tag for n in self.at.up()):
            self._close({tag}, set())

    def _close(self, tags: set[str], until: set[str]) -> None:
        for n in self.at.up():
            if n.tag in tags:
                self.at = n.parent or self.root
                return
            if n.tag in until:
                return

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    """Tree of `html`; None and "" give an empty one."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


_SIMPLE = re.compile(r"([\w-]+|\*)?((?:\.[\w-]+|#[\w-]+|\[[^\]]+\])*)")
_PARTS = re.compile(r"\.([\w-]+)|#([\w-]+)|\[\s*([\w:-]+)\s*(?:=\s*[\"']?([^\"'\]]*)[\"']?)?\s*\]")


def _matches_one(node: Node, simple: str) -> bool:
    m = _SIMPLE.fullmatch(simple)
    if not m or not node.tag or (m[1] and m[1] != "*" and m[1].lower() != node.tag):
        return False
    for cls, id_, attr, value in _PARTS.findall(m[2] or ""):
        if cls and cls not in node.attrs.get("class", "").split():
            return False
        if id_ and node.attrs.get("id") != id_:
            return False
        if attr and (attr not in node.attrs or (value and node.attrs[attr] != value)):
            return False
    return True


def matches(node: Node, selector: str) -> bool:
    """Whether `node` is selected."""
    for way in selector.split(","):
        *outer, own = way.split() or [""]
        if own and _matches_one(node, own):
            ancestors = list(node.up())[1:]
            while outer and ancestors:
                if _matches_one(ancestors.pop(0), outer[-1]):
                    outer.pop()
            if not outer:
                return True
    return False


def select(node: Node, selector: str) -> list[Node]:
    """Selected descendants in document order."""
    return [n for n in node.walk() if matches(n, selector)]
