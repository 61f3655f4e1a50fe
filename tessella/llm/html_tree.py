"""A small forgiving reader of HTML: elements, their text blocks and a hash of each subtree."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import xxhash

# Element names by their part in a page.
RAW = frozenset("script style noscript template iframe noembed noframes xmp svg math object canvas audio video select button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Names whose start ends an open element of these names, up to the nearest of the last set.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
BOILERPLATE = frozenset("nav footer aside form head menu dialog search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup sidebar sidebars aside menu menus nav navbar navigation navigations breadcrumb breadcrumbs footer masthead topbar comment comments commentlist disqus respond replies share sharing social related recommended recommendations popup modal overlay widget widgets toolbar pagination pager login search skip".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(\bhidden\b)", re.S)
SPLIT = re.compile(r"[\s_]+|-+|(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Element:
    name: str
    words: frozenset[str]  # words of class and id
    role: str
    hidden: bool
    children: list = field(default_factory=list)  # elements and strings
    digest: int = 0  # of the subtree's names and text
    shape: int = 0  # of the subtree's names, classes and roles; runs of equal children count once
    size: int = 0  # characters of text in the subtree
    linked: int = 0  # of these, those inside links

    def kind(self) -> bytes:
        """The element without what is in it; words with digits number it and are left out."""
        return f"{self.name}|{'.'.join(sorted(w for w in self.words if w.isalpha())) if self.words else ''}|{self.role}".encode("utf-8", "replace")


def attributes(name: str, text: str) -> Element:
    if "=" not in text and "hidden" not in text:
        return Element(name, frozenset(), "", False)
    words: set[str] = set()
    role, hidden = "", False
    for key, a, b, c, bare in ATTRIBUTE.findall(text):
        key, value = key.lower(), html.unescape(a or b or c)
        if key in ("class", "id"):
            words.update(w.lower() for w in SPLIT.split(value) if w)
        elif key == "role":
            role = value.strip().lower()
        elif bare or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return Element(name, frozenset(words), role, hidden)


def parse(page: str) -> Element:
    """The tree of a page; text stays as written, references and all."""
    root = Element("", frozenset(), "", False)
    stack, at, n = [root], 0, len(page)
    while at < n:
        found = TOKEN.search(page, at)
        if found is None:
            stack[-1].children.append(page[at:])
            break
        if found.start() > at:
            stack[-1].children.append(page[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            if name == "br":
                stack[-1].children.append(" ")
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            continue
        if name in RAW or name in ("title", "textarea"):
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if not found[3].rstrip().endswith("/") or name in ("script", "style", "title", "textarea"):
                at = n if end is None else page.find(">", end.start()) + 1 or n
            stack[-1].children.append(" ")
            continue
        if name in VOID:
            if name in ("br", "hr"):
                stack[-1].children.append(Element(name, frozenset(), "", False) if name == "hr" else " ")
            continue
        if name in BLOCK:
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k].name == "p":
                    del stack[k:]
                    break
                if stack[k].name in BLOCK:
                    break
        if name in IMPLIED:
            ends, within = IMPLIED[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in within:
                    break
                if stack[k].name in ends:
                    del stack[k:]
                    break
        element = attributes(name, found[3])
        stack[-1].children.append(element)
        stack.append(element)
    return root


def words(text: str) -> str:
    return " ".join(text.split())


def hash_subtrees(root: Element) -> None:
    """Set the digests and sizes of every element, children first."""
    order, todo = [], [root]
    while todo:
        element = todo.pop()
        order.append(element)
        todo.extend(c for c in element.children if not isinstance(c, str))
    for element in reversed(order):
        kind = element.kind()
        h, shape, size, linked, before = xxhash.xxh64(kind), xxhash.xxh64(kind, seed=1), 0, 0, None
        for child in element.children:
            if isinstance(child, str):
                if text := words(child):
                    h.update(b"\0" + text.encode("utf-8", "replace"))
                    size += len(text)
                    now = 0
                else:
                    continue
            else:
                h.update(b"\1%d" % child.digest)
                size += child.size
                linked += child.linked
                now = child.shape
            if now != before:
                shape.update(b"%d," % now)
                before = now
        element.digest, element.shape, element.size = h.intdigest(), shape.intdigest(), size
        element.linked = size if element.name == "a" else linked


def ruled_out(element: Element, inside: bool) -> bool:
    """Whether an element is boilerplate by what it is. ``inside``: it stands in the main part, whose own header and figures stay."""
    if element.name in BOILERPLATE or element.hidden or element.role in ROLES or element.name == "header" and not inside:
        return True
    return bool(element.words & MARKED) and element.name not in ("html", "body", "main", "article", "p", "span", "h1")


def is_main(element: Element) -> bool:
    return element.name in ("main", "article") or element.role in ("main", "article")


def main_parts(root: Element) -> list[Element]:
    """The outermost main elements that are not ruled out, else the outermost articles, else the whole page."""
    for wanted in (lambda e: e.name == "main" or e.role == "main", lambda e: e.name == "article" or e.role == "article"):
        found, todo = [], [root]
        while todo:
            element = todo.pop()
            if wanted(element):
                found.append(element)
            elif not ruled_out(element, False):
                todo.extend(c for c in reversed(element.children) if not isinstance(c, str))
        if any(e.size for e in found):
            return found
    return [root]


#: Elements of running text: inside the main part these are never taken for template.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd blockquote pre figcaption caption summary".split())


def candidates(root: Element) -> list[tuple[Element, bool, bool]]:
    """The subtrees that may be a site's template, with whether what they are named says so and whether most of their text is links.

    These are all block elements with text but main elements and what they
    stand in, running text inside a main element, and, where the page has no
    main element, boxes that hold half of its text or more.
    """
    order, todo = [], [(root, None, False)]
    while todo:
        element, parent, inside = todo.pop()
        inside = inside or is_main(element)
        order.append((element, parent, inside))
        todo.extend((c, element, inside) for c in element.children if not isinstance(c, str))
    kept = {id(root)}
    for element, parent, _ in reversed(order):
        if (id(element) in kept or is_main(element) and element.size) and parent is not None:
            kept |= {id(element), id(parent)}
    whole = len(kept) == 1  # no main element
    most = root.size / 2
    out = []
    for element, _, inside in order:
        if not element.size or element.name not in BLOCK or id(element) in kept:
            continue
        named = ruled_out(element, inside)
        if named or not (inside and element.name in FLOW or (inside or whole) and element.size >= most):
            out.append((element, named, not inside and 2 * element.linked >= element.size))
    return out


def blocks(parts: list[Element], dropped: set[int], ruled: Callable[[Element], bool]) -> list[str]:
    """The text blocks of ``parts`` in page order without what ``ruled`` rules out; ``dropped``: ids of template elements."""
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        if line and (text := words(html.unescape("".join(line)))):
            out.append(text)
        line.clear()

    for part in parts:
        todo: list = [(part, False)]
        while todo:
            node, ended = todo.pop()
            if isinstance(node, str):
                line.append(node)
            elif ended:
                close()
            elif id(node) not in dropped and not (node is not part and ruled(node)):
                if node.name in BLOCK:
                    close()
                    todo.append((node, True))
                todo.extend((c, False) for c in reversed(node.children))
        close()
    return out
