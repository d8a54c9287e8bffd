"""A forgiving reader of HTML: block elements as a tree, inline elements as part of the text."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Comments, declarations, whole tags, a tag cut off by the end, text, and a lone angle bracket.
TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>"""
    r"""|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attributes2>[^>]*+)>|</?[a-zA-Z!?][^>]*+\Z|(?P<text>[^<]++)|<""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

#: Fixed lists of HTML: elements that begin and end blocks, whose content is no markup, and that have no content.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag ends, and the elements that the search for it does not leave.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: Inline elements that never hold running text.
CONTROLS = frozenset("button select option datalist audio video canvas object map label input".split())


@dataclass(slots=True)
class Node:
    tag: str
    names: tuple[str, ...] = ()
    """Class names and id."""
    role: str = ""
    hidden: bool = False
    children: list = field(default_factory=list)
    linked: int = 0
    """Characters of its own text that stand in links."""

    @property
    def signature(self) -> str:
        return ".".join((self.tag, *self.names))


def _node(tag: str, attributes: str) -> Node:
    if not attributes or attributes.isspace():
        return Node(tag)
    names: list[str] = []
    role, hidden = "", False
    for m in ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        value = html.unescape(m[2] or m[3] or m[4] or "")
        if key in ("class", "id"):
            # Numbers tell one page from the next, not one part of a page from another.
            names += [n for n in (re.sub(r"\d+", "", v).replace(".", "-").replace("/", "-") for v in value.split()) if n]
        elif key in ("role", "itemprop"):
            role = value.lower()
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            hidden = True
    return Node(tag, tuple(sorted(set(names))), role, hidden)


def parse(source: str | None) -> Node:
    """The tree of a whole page: children are nodes or pieces of decoded text. Scripts, styles and comments are left out;
    the title is a node in the head. Unclosed, crossed and cut-off tags are borne."""
    root = Node("#root")
    stack = [root]
    source = source or ""
    lowered = None
    place, links = 0, 0
    match = TOKEN.match
    while place < len(source):
        m = match(source, place)
        place = m.end()
        text = m["text"]
        if text is not None:
            if "&" in text:
                text = html.unescape(text)
            top = stack[-1]
            top.children.append(text)
            if links:
                top.linked += len(text.strip())
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m[0] == "<":
                stack[-1].children.append("<")
            continue
        tag = tag.lower()
        if m["close"] or m["close2"]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "p" and all(n.tag != "p" for n in stack):
                stack[-1].children.append(Node("p"))
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        links = 0 if tag in BLOCKS else links
                        break
                    if tag not in BLOCKS and stack[k].tag in BLOCKS:
                        break
            continue
        attributes = m["attributes"] or m["attributes2"] or ""
        if tag in RAW:
            lowered = source.lower() if lowered is None else lowered
            end = lowered.find(f"</{tag}", place)
            inside = source[place : end if end >= 0 else len(source)]
            if not attributes.rstrip().endswith("/") or tag not in ("svg", "math"):
                place = len(source) if end < 0 else (source.find(">", end) + 1 or len(source))
                if tag == "title":
                    stack[-1].children.append(Node("title", children=[html.unescape(inside)]))
            stack[-1].children.append(" ")
            continue
        if tag in BLOCKS:
            links = 0
            if tag in ENDS:
                ended, within = ENDS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ended:
                        del stack[k:]
                        break
                    if stack[k].tag in within:
                        break
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCKS and tag != "hr" and stack[k].tag not in HEADINGS:
                    break
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                stack.pop()
            if tag == "body":
                stack[:] = [n for n in stack if n.tag != "head"]
            node = _node(tag, attributes)
            stack[-1].children.append(node)
            if tag not in VOID:
                stack.append(node)
        elif tag in VOID:
            if tag == "br" or tag == "img":
                stack[-1].children.append(" ")
        elif tag == "a":
            links = 1
        else:
            nested = any(n.tag == tag for n in stack)
            node = _node(tag, attributes) if attributes or nested or tag in CONTROLS else None
            if node is not None and (nested or tag in CONTROLS or node.hidden or node.names) and not attributes.rstrip().endswith("/"):
                stack[-1].children.append(node)
                stack.append(node)
    return root


def own_text(node: Node) -> str:
    """Text of a block less that of the blocks in it; inline elements count as its own."""
    out: list[str] = []
    work = list(reversed(node.children))
    while work:
        child = work.pop()
        if isinstance(child, str):
            out.append(child)
        elif child.tag not in BLOCKS:
            work += reversed(child.children)
    return " ".join("".join(out).split())


def blocks(node: Node, skip: object) -> list[str]:
    """Texts of the blocks below `node` in page order, less what `skip` (a function of a node) leaves out; white space inside a
    block is one space."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(text)

    # An own stack, because a page may nest deeper than Python calls may.
    work: list = [iter([node])]
    open_blocks: list[bool] = []
    while work:
        child = next(work[-1], None)
        if child is None:
            work.pop()
            if open_blocks and open_blocks.pop():
                flush()
        elif isinstance(child, str):
            held.append(child)
        elif skip(child):
            if child.tag in BLOCKS:
                flush()
        else:
            block = child.tag in BLOCKS or child.tag == "#root"
            if block:
                flush()
            open_blocks.append(block)
            work.append(iter(child.children))
    flush()
    return out


def walk(node: Node) -> list[Node]:
    """All nodes below and with `node`, in page order."""
    out, work = [], [node]
    while work:
        n = work.pop()
        out.append(n)
        work += [c for c in reversed(n.children) if isinstance(c, Node)]
    return out
