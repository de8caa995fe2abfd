"""A forgiving reader of HTML into a tree of blocks, and a numeric description of its nodes."""

from __future__ import annotations

import html as _html
import re

import numpy as np

#: Fixed values of HTML: elements that start a block, that have no content, and whose content is no text of the page.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav object ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
#: Fixed values of HTML: elements whose content a browser reads as text up to their end tag, or to the page's end; and those it
#: reads so or doesn't show, but which are taken for nothing here where their end tag is missing.
RAW = frozenset("script style textarea title xmp".split())
UNSHOWN = frozenset("noscript template svg iframe noembed noframes canvas audio video annotation".split())
#: Fixed values of HTML: opening tags that end an open svg.
BREAKS_OUT = frozenset("b big br code em embed font i img meta nobr ruby s small span strike strong sub sup tt u var".split())
#: Fixed values of HTML: an opening tag ends an open one of these kinds.
_CELLS = frozenset({"td", "th"})
ENDS = {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": _CELLS, "th": _CELLS, "option": frozenset({"option"}), "optgroup": frozenset({"option", "optgroup"})}
#: Fixed values of HTML: an implied end looks no further up than these.
SCOPE = frozenset({"ul", "ol", "dl", "table", "select", "menu", "html", "body"})

#: A tag, read as browsers do: only a value's quotes hide a '>'. Nothing is ever gone back over.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_MARKS = re.compile(r"[.,;:!?]")


_END_OF = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW | UNSHOWN}
#: Those of them whose content is never read as markup.
RAW_UNSHOWN = frozenset("noscript iframe noembed noframes".split())


class Node:
    """A block element, or (tag '#text') a run of inline text between two block borders."""

    __slots__ = ("chars", "depth", "elements", "items", "kids", "link", "marks", "order", "paragraphs", "parent", "raw_link", "tag", "text", "tokens")

    def __init__(self, tag: str, parent: int, depth: int, tokens: tuple[str, ...] = ()):
        self.tag, self.parent, self.depth, self.tokens = tag, parent, depth, tokens
        self.text = ""
        self.kids: list[int] = []
        self.chars = self.link = self.marks = self.elements = self.paragraphs = self.items = self.raw_link = 0


def attribute_tokens(source: str) -> tuple[str, ...]:
    """Words of class, id and role, lower-cased, and 'hidden' for what is not shown."""
    if not source or "=" not in source and "hidden" not in source:
        return ()
    out = []
    for name, value in _ATTRIBUTE.findall(source):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            out += [t.lower() for t in _TOKEN.findall(_html.unescape(value.strip("\"'")))]
        elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower() or name == "aria-hidden" and "true" in value.lower():
            out.append("hidden")
    return tuple(dict.fromkeys(out))


def parse(source: str) -> list[Node]:
    """The nodes in page order; node 0 is the root. Unclosed, misnested and unknown tags are taken as browsers do, roughly.

    Time grows in proportion to the page, whatever it holds. Head and body need no tags: what stands
    in a head is never text. A tag that the page's end cuts off is dropped with what follows it.
    """
    nodes = [Node("#root", -1, 0)]
    stack: list[int] = [0]
    places: dict[str, list[int]] = {}  # of each tag's open elements in the stack
    hidden: list[tuple[str, int]] = []  # open elements that are not shown, and how high the stack was
    last_end: dict[str, int] = {}
    pieces: list[str] = []
    linked = 0
    in_link = False
    at, n = 0, len(source)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                leaf = Node("#text", stack[-1], len(stack))
                leaf.text, leaf.chars, leaf.link = text, len(text), min(linked, len(text))
                leaf.marks = len(_MARKS.findall(text))
                nodes[stack[-1]].kids.append(len(nodes))
                nodes.append(leaf)
            linked = 0

    def close(upto: int) -> None:
        flush()
        while len(stack) > upto:
            places[nodes[stack.pop()].tag].pop()
        while hidden and hidden[-1][1] > upto:
            hidden.pop()

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not hidden:
            piece = _html.unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            if in_link:
                linked += len(piece.strip())

    def innermost(tags: frozenset[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    while at < n:
        begin = source.find("<", at)
        if begin < 0:
            add(source[at:])
            break
        add(source[at:begin])
        after = source[begin + 1 : begin + 3]
        if after[:1] in ("!", "?") or after[:1] == "/" and not after[1:].isalpha():  # a comment, or what is read as one
            mark, skip = ("-->", 2) if source.startswith("<!--", begin) else (">", 1)
            end = source.find(mark, begin + skip)
            at = n if end < 0 else end + len(mark)
            continue
        found = _TAG.match(source, begin)
        if found is None:
            if not after[:1].isascii() or not after.lstrip("/")[:1].isalpha():
                add("<")
                at = begin + 1
                continue
            break  # a tag that the page's end cuts off
        at = found.end()
        name = found[2].lower()
        if found[1]:
            if hidden:
                k = next((k for k in range(len(hidden) - 1, max(-1, len(hidden) - 9), -1) if hidden[k][0] == name), -1)
                if k >= 0:
                    del hidden[k:]
                    pieces.append(" ")
                    continue
            if name == "a":
                in_link = False
            elif name in BLOCK:
                if not places.get(name):
                    if not hidden:
                        flush()
                elif not hidden or hidden[-1][0] != "template":
                    close(places[name][-1])
            continue
        if name in RAW:
            if not found[3].endswith("/"):
                end = _END_OF[name].search(source, at)
                at = n if end is None else end.end()
            pieces.append(" ")
            continue
        if hidden and hidden[-1][0] == "svg" and (name in BLOCK or name in BREAKS_OUT):
            hidden.pop()
        if name in UNSHOWN:
            if name not in last_end:
                last_end[name] = max((m.start() for m in _END_OF[name].finditer(source)), default=-1)
            if not found[3].endswith("/") and last_end[name] >= at:
                pieces.append(" ")
                if name in RAW_UNSHOWN:
                    at = _END_OF[name].search(source, at).end()
                else:
                    hidden.append((name, len(stack)))
            continue
        if hidden:
            continue
        if name == "br":
            pieces.append(" ")
        elif name == "a":
            in_link = not found[3].endswith("/")
        if name not in BLOCK:
            continue
        flush()
        if nodes[stack[-1]].tag == "p" and name not in ("button", "option"):
            close(len(stack) - 1)
        if name in ENDS:
            k = innermost(ENDS[name])
            if k > innermost(SCOPE):
                while k > 1 and nodes[stack[k - 1]].tag in ENDS[name]:
                    k -= 1
                close(k)
        if name == "hr":
            continue
        node = Node(name, stack[-1], len(stack), attribute_tokens(found[3]))
        nodes[stack[-1]].kids.append(len(nodes))
        if not found[3].endswith("/") or name in ("div", "p", "li"):
            places.setdefault(name, []).append(len(stack))
            stack.append(len(nodes))
        nodes.append(node)
    close(1)
    for i in range(len(nodes) - 1, 0, -1):
        node, up = nodes[i], nodes[nodes[i].parent]
        up.chars += node.chars
        up.link += node.link
        up.marks += node.marks
        up.elements += node.elements + (node.tag != "#text")
        up.paragraphs += node.paragraphs + (node.tag == "p")
        up.items += node.items + (node.tag == "li")
    return nodes


FEATURES = 33


def describe(nodes: list[Node], odds: dict[str, float]) -> np.ndarray:
    """A row of numbers for each node: its own and its ancestors' tag and attribute tokens, the density of its subtree, depth, and its siblings."""
    n = len(nodes)
    out = np.zeros((n, FEATURES), np.float32)
    chain: list[tuple[float, float, float, float]] = [(0.0, 0.0, 0.0, 0.0)] * n
    page = max(1, nodes[0].chars)
    at = [0.0] * n
    seen = 0
    rank, same = [0] * n, [0] * n
    for node in nodes:
        by_tag: dict[str, int] = {}
        for k, kid in enumerate(node.kids):
            rank[kid] = k
            by_tag[nodes[kid].tag] = by_tag.get(nodes[kid].tag, 0) + 1
        for kid in node.kids:
            same[kid] = by_tag[nodes[kid].tag]
    get = odds.get
    for i, node in enumerate(nodes):
        at[i] = seen / page
        if node.tag == "#text":
            seen += node.chars
        up = nodes[node.parent] if i else node
        low, high, tag_low, tag_high = chain[node.parent] if i else chain[0]
        own = [get(t, 0.0) for t in node.tokens] or [0.0]
        tag = get("<" + node.tag, 0.0)
        chain[i] = min(low, min(own)), max(high, max(own)), min(tag_low, tag), max(tag_high, tag)
        kids = up.kids
        before = nodes[kids[rank[i] - 1]].chars if i and rank[i] else 0
        after = nodes[kids[rank[i] + 1]].chars if i and rank[i] + 1 < len(kids) else 0
        out[i] = (
            sum(own), min(own), max(own), tag, low, high, tag_low, tag_high,
            node.depth, len(kids) if i else 1, rank[i] / max(1, len(kids)), node.chars, node.link / max(1, node.chars), node.elements,
            node.chars / (1 + node.elements), node.marks / max(1, node.chars), node.chars / page, up.chars, up.link / max(1, up.chars), before, after, same[i],
            at[i], node.tag == "#text", node.paragraphs, node.items, len(node.kids), up.paragraphs / (1 + up.elements), len(node.tokens), node.chars / max(1, up.chars),
            get("<" + up.tag, 0.0), sum(get(t, 0.0) for t in up.tokens), nodes[up.parent].paragraphs if up.parent >= 0 else 0,
        )
    return out


def text_of(nodes: list[Node], keep) -> str:
    return "\n".join(node.text for i, node in enumerate(nodes) if node.tag == "#text" and keep[i])
