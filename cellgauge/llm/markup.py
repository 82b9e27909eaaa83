"""Web pages as trees of block elements and runs of text, from markup as it is found."""

from __future__ import annotations

import html
import re

# Element names of HTML by their role here, and words by which pages name their parts.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr output q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe noembed noframes noscript script style textarea title xmp".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
TABLE_PARTS = {"caption", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: An opening tag closes open elements of these names, up to the element that holds them all.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": (TABLE_PARTS, {"table"}), "thead": (TABLE_PARTS, {"table"}), "tfoot": (TABLE_PARTS, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
OUTSIDE_TAGS = set("aside audio button canvas datalist dialog footer head menu nav object search select svg template video".split())
OUTSIDE_ROLES = set("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search status toolbar".split())
OUTSIDE_WORDS = set(
    "ad adbox ads adsense adslot adunit advert advertisement advertisements advertising adverts alert aside banner breadcrumb breadcrumbs comment comments consent"
    " cookie cookies copyright disclaimer disqus footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices"
    " notification overlay pager pagination popup promo promotion recommended related replies respond search share sharing sidebar"
    " signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
NEGATORS = set("has hide hides no not show shows with without".split())

#: Last character of a key: never main text, page header, form, or marked as the main text.
OUTSIDE, HEADER, FORM, MAIN = "!", "%", "~", "^"
TEXT = "#"
DEEPEST = 64  # elements nested deeper open no level of their own

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?/](?![A-Za-z])[^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+[^>]*+)(?:>|\Z)|<![^>]*+(?:>|\Z)""",
    re.S,
)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")


def names_outside(token: str) -> bool:
    """Whether a class or id names a part beside the main text: by its first or last word, unless it says "no" or "with"."""
    words = [w.lower() for w in WORD.findall(token)]
    return bool(words) and not NEGATORS & set(words) and (words[0] in OUTSIDE_WORDS or words[-1] in OUTSIDE_WORDS)


def key_of(name: str, attributes: str) -> str:
    """An element's key: its name, its class, id and role without digits, and the character for its part in a page."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    tokens = found.get("class", "").split()
    if name not in HEADING and name not in ("p", "li", "tr", "td", "th"):  # there, ids tell rows apart rather than parts
        tokens += found.get("id", "").split()
    role = found.get("role", "").lower().strip()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", ""))
    if hidden or name in OUTSIDE_TAGS or role in OUTSIDE_ROLES or any(map(names_outside, tokens)):
        kind = OUTSIDE
    elif name in ("article", "main") or role in ("article", "main") or found.get("itemprop", "").lower() == "articlebody":
        kind = MAIN
    elif name == "header" or any("header" in (words[:1] + words[-1:]) for words in ([w.lower() for w in WORD.findall(t)] for t in tokens)):
        kind = HEADER
    else:
        kind = FORM if name == "form" else ""
    plain = sorted({re.sub(r"\d+", "0", t.lower()) for t in [*tokens, *([role] if role else [])]})
    return ".".join([name, *plain]) + kind


class Node:
    """An element with its children in page order: nodes and runs of text."""

    __slots__ = ("key", "children")

    def __init__(self, key: str):
        self.key, self.children = key, []


class Run:
    """Text without block elements inside: white space as single spaces, and how many characters are links."""

    __slots__ = ("text", "linked")
    key = TEXT

    def __init__(self, text: str, linked: int):
        self.text, self.linked = text, linked


class Reader:
    """Turns pages into trees; remembers the keys of start tags it has seen, a bounded number."""

    REMEMBER = 50_000

    def __init__(self):
        self.keys: dict[tuple[str, str], str] = {}

    def key(self, name: str, attributes: str) -> str:
        if not attributes or attributes == "/":
            attributes = ""
        key = self.keys.get((name, attributes))
        if key is None:
            key = key_of(name, attributes)
            if len(self.keys) >= self.REMEMBER:
                self.keys.clear()
            self.keys[name, attributes] = key
        return key

    def read(self, page: str | None) -> Node:
        """The tree of a page. Inline elements are no nodes, br is a space, unclosed elements end with their parent."""
        page = page or ""
        root = Node("page")
        stack: list[tuple[str, Node, int]] = [("", root, 0)]  # name, node, depth; deep elements share a node
        opened: dict[str, int] = {}
        run: list[str] = []
        linked, link_at, mute = 0, 0, None  # stack heights of the open link and of an inline element that does not count

        def flush():
            nonlocal linked
            if run:
                text = " ".join("".join(run).split())
                if text:
                    stack[-1][1].children.append(Run(text, min(linked, len(text))))
                run.clear()
            linked = 0

        def close(height: int):
            """Close the elements from ``height`` upwards."""
            nonlocal link_at, mute
            for name, _, _ in stack[height:]:
                opened[name] -= 1
            del stack[height:]
            if link_at > height:
                link_at = 0
            if mute is not None and mute[1] > height:
                mute = None

        def add(text: str):
            nonlocal linked
            if text and mute is None:
                text = html.unescape(text) if "&" in text else text
                run.append(text)
                if link_at:
                    linked += len(text)

        at, end = 0, len(page)
        while at < end:
            token = TOKEN.search(page, at)
            if token is None:
                add(page[at:])
                break
            add(page[at : token.start()])
            at = token.end()
            slash, name, attributes = token[1], token[2], token[3]
            if name is None:
                continue
            name = name.lower()
            if name in INLINE:
                if name == "a":
                    link_at = 0 if slash else len(stack)
                if slash:
                    if mute is not None and mute[0] == name:
                        mute = (name, mute[1], mute[2] - 1) if mute[2] > 1 else None
                elif mute is not None:
                    if mute[0] == name:
                        mute = (name, mute[1], mute[2] + 1)
                elif attributes and self.key(name, attributes if name != "a" or "class" in attributes or "hidden" in attributes else "").endswith(OUTSIDE):
                    mute = (name, len(stack), 1)
                continue
            if name in ("br", "wbr"):
                if name == "br":
                    add(" ")
                continue
            if name in RAW:
                if not slash:
                    last = RAW_END[name].search(page, at)
                    at = last.end() if last else end
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                    if stack[-1][0] == "p":
                        close(len(stack) - 1)
                continue
            flush()
            if name in ("html", "body"):
                if not slash and opened.get("head"):
                    close(next(i for i, s in enumerate(stack) if s[0] == "head"))
                continue
            if slash:
                if opened.get(name):
                    for height in range(len(stack) - 1, 0, -1):
                        if stack[height][0] == name:
                            close(height)
                            break
                        if stack[height][0] in ("td", "th", "table") and name not in TABLE_PARTS and name != "table":
                            break
                continue
            if stack[-1][0] == "p" or (name in HEADING and stack[-1][0] in HEADING):
                close(len(stack) - 1)
            if opened.get("head") and name != "head":
                close(next(i for i, s in enumerate(stack) if s[0] == "head"))
            if name in CLOSES:
                ends, holders = CLOSES[name]
                if any(opened.get(e) for e in ends):
                    lowest = None
                    for height in range(len(stack) - 1, 0, -1):
                        if stack[height][0] in holders:
                            break
                        if stack[height][0] in ends:
                            lowest = height
                            if name in ("li", "dt", "dd", "option"):
                                break
                    if lowest is not None:
                        close(lowest)
            _, parent, depth = stack[-1]
            key = self.key(name, attributes)
            if depth < DEEPEST or (key.endswith((OUTSIDE, MAIN)) and depth < 2 * DEEPEST):
                node = Node(key)
                parent.children.append(node)
            else:
                node = parent
            if not attributes.endswith("/") or not name.startswith(("svg", "path")):
                stack.append((name, node, depth + (node is not parent)))
                opened[name] = opened.get(name, 0) + 1
        flush()
        return root
