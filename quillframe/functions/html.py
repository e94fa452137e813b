"""A tolerant HTML tree: parser, selectors, text, serializer and sanitizer. It never fails on markup."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAX_DEPTH = 512
TOKEN = re.compile(r"<!--(?P<comment>.*?)(?:-->|$)|<!doctype[^>]*>|<[!?](?P<bogus>[^>]*)>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s=\"'/>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("attrs", "children", "kind", "parent", "tag", "text")

    def __init__(self, kind: str, tag: str | None = None, attrs: dict | None = None, text: str | None = None):
        self.kind, self.tag, self.attrs, self.text = kind, tag, attrs or {}, text
        self.parent: Node | None = None
        self.children: list[Node] = []

    def append(self, node: Node) -> Node:
        node.parent = self
        self.children.append(node)
        return node

    def descendants(self) -> Iterator[Node]:
        stack = self.children[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack += n.children[::-1]

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.kind == "element"]

    def text_content(self) -> str:
        return "".join(n.text for n in self.descendants() if n.kind == "text")


def parse(source: str) -> Node:
    root = Node("document")
    html = root.append(Node("element", "html"))
    head, body = html.append(Node("element", "head")), html.append(Node("element", "body"))
    builder, at = _Builder(head, body), 0
    for _ in range(len(source) + 1):
        m = TOKEN.search(source, at)
        if not m:
            break
        builder.characters(entities.unescape(source[at : m.start()]))
        at = m.end()
        if m["comment"] is not None or m["bogus"] is not None:
            builder.top.append(Node("comment", text=m["comment"] if m["comment"] is not None else m["bogus"]))
        elif m["end"]:
            builder.end(m["end"].lower())
        elif m["start"]:
            tag = m["start"].lower()
            attrs: dict[str, str] = {}
            for a in ATTRIBUTE.finditer(m["attrs"] or ""):
                attrs.setdefault(a[1].lower(), entities.unescape(next((g for g in a.groups()[1:] if g is not None), "")))
            builder.start(tag, attrs)
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*/?>", re.I).search(source, at)
                inside = source[at : close.start() if close else len(source)]
                if inside:
                    builder.top.append(Node("text", text=entities.unescape(inside) if tag in ("title", "textarea") else inside))
                builder.end(tag)
                at = close.end() if close else len(source)
    builder.characters(entities.unescape(source[at:]))
    return root


class _Builder:
    def __init__(self, head: Node, body: Node):
        self.head, self.body, self.open, self.in_head = head, body, [], True

    @property
    def top(self) -> Node:
        return self.open[-1] if self.open else (self.head if self.in_head else self.body)

    def characters(self, text: str) -> None:
        if self.in_head and not self.open:
            text = text.lstrip()
            if text:
                self.in_head = False
        if text:
            last = self.top.children[-1] if self.top.children else None
            if last is not None and last.kind == "text":
                last.text += text
            else:
                self.top.append(Node("text", text=text))

    def _close_to(self, tags: frozenset | set, stop: tuple[str, ...]) -> None:
        """Closes the nearest open element of tags and all within it, unless a stop is nearer."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in stop:
                return

    def start(self, tag: str, attrs: dict) -> None:
        if tag in ("html", "head", "body"):
            if tag == "body":
                self.in_head = False
                self.open.clear()
            target = {"html": self.head.parent, "head": self.head, "body": self.body}[tag]
            for k, v in attrs.items():
                target.attrs.setdefault(k, v)
            return
        if self.in_head and tag not in ("title", "base", "link", "meta", "style", "script", "noscript", "template"):
            self.in_head = False
        if tag in CLOSES_P:
            self._close_to({"p"}, ("table", "td", "th", "button"))
        if tag in HEADINGS and self.open and self.open[-1].tag in HEADINGS:
            self.open.pop()
        implied = {"li": ({"li"}, ("ul", "ol")), "dt": ({"dt", "dd"}, ("dl",)), "dd": ({"dt", "dd"}, ("dl",)), "option": ({"option"}, ("select",)), "tr": ({"tr"}, ("table",)), "td": ({"td", "th"}, ("tr", "table")), "th": ({"td", "th"}, ("tr", "table")), "tbody": ({"tbody", "thead", "tfoot"}, ("table",)), "thead": ({"tbody", "thead", "tfoot"}, ("table",)), "tfoot": ({"tbody", "thead", "tfoot"}, ("table",))}
        if tag in implied:
            self._close_to(*implied[tag])
        if tag == "tr" and self.top.tag == "table":
            self.open.append(self.top.append(Node("element", "tbody")))
        if tag in ("td", "th") and self.top.tag in ("table", "tbody", "thead", "tfoot"):
            if self.top.tag == "table":
                self.open.append(self.top.append(Node("element", "tbody")))
            self.open.append(self.top.append(Node("element", "tr")))
        node = self.top.append(Node("element", tag, attrs))
        if tag not in VOID and len(self.open) < MAX_DEPTH:
            self.open.append(node)

    def end(self, tag: str) -> None:
        if tag == "head":
            self.in_head = False
            return
        if tag in ("html", "body") or tag in VOID:
            return
        if any(n.tag == tag for n in self.open):
            while self.open.pop().tag != tag:
                pass
        elif tag == "p":
            self.start("p", {})
            self.end("p")


def rows(root: Node) -> Iterator[tuple]:
    """(node_id, parent_id, ord, depth, kind, tag, attrs, text) in document order, the root being 0."""
    stack, n = [(root, None, 0, 0)], 0
    while stack:
        node, parent, ordinal, depth = stack.pop()
        yield n, parent, ordinal, depth, node.kind, node.tag, node.attrs, node.text
        stack += [(c, n, i, depth + 1) for i, c in reversed(list(enumerate(node.children)))]
        n += 1


def title(root: Node) -> str:
    return next((n.text_content().strip() for n in root.descendants() if n.tag == "title"), "")


def escape(text: str, attribute: bool = False) -> str:
    out = text.replace("&", "&amp;").replace(" ", "&nbsp;")
    return out.replace('"', "&quot;") if attribute else out.replace("<", "&lt;").replace(">", "&gt;")


def serialize(node: Node) -> str:
    """Inner markup of a node."""
    out: list[str] = []
    stack: list = list(node.children[::-1])
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.kind == "text":
            raw = n.parent is not None and n.parent.tag in ("script", "style", "xmp", "iframe", "noembed", "noframes")
            out.append(n.text if raw else escape(n.text))
        elif n.kind == "comment":
            out.append(f"<!--{n.text}-->")
        else:
            out.append("<" + n.tag + "".join(f' {k}="{escape(v, True)}"' for k, v in n.attrs.items()) + ">")
            if n.tag not in VOID:
                stack.append(f"</{n.tag}>")
                stack += n.children[::-1]
    return "".join(out)


# What the sanitizer lets through.
ALLOWED = frozenset("a abbr b blockquote br caption cite code col colgroup dd del details dfn div dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr i img ins kbd li mark ol p pre q s samp small span strong sub summary sup table tbody td tfoot th thead tr u ul var".split())
ALLOWED_ATTRIBUTES = frozenset("alt cite class colspan datetime height href lang rowspan src title width".split())
URL_ATTRIBUTES = frozenset("action background cite data formaction href longdesc poster src xlink:href".split())
SCHEMES = frozenset("http https mailto".split())
DROPPED_WHOLE = frozenset("script style iframe object embed template noscript textarea title svg math".split())


def safe_url(url: str) -> bool:
    """Relative, or of an allowed scheme once controls and blanks are gone."""
    bare = re.sub(r"[\x00-\x20\x7f-\xa0]", "", url)
    m = re.match(r"([^/?#:]*):", bare)
    return not m or m[1].lower() in SCHEMES


def sanitise(source: str) -> str:
    """Allowed elements and attributes only; other elements leave their content, script-like ones nothing."""
    root = parse(source)
    body = root.children[0].children[1]

    def clean(node: Node, into: Node) -> None:
        stack = [(c, into) for c in reversed(node.children)]
        while stack:
            n, to = stack.pop()
            if n.kind == "text":
                to.append(Node("text", text=n.text))
            elif n.kind == "element" and n.tag not in DROPPED_WHOLE:
                if n.tag in ALLOWED:
                    kept = {k: v for k, v in n.attrs.items() if k in ALLOWED_ATTRIBUTES and (k not in URL_ATTRIBUTES or safe_url(v))}
                    to = to.append(Node("element", n.tag, kept))
                stack += [(c, to) for c in reversed(n.children)]

    out = Node("document")
    clean(body, out)
    return serialize(out)


class Selector:
    """A group of selectors: types, ids, classes, attributes, child positions, :not, and the four combinators."""

    COMPOUND = re.compile(r"\*|[a-zA-Z][\w-]*|#[\w-]+|\.[\w-]+|\[\s*[\w-]+\s*(?:[~|^$*]?=\s*(?:\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*i?\s*)?\]|:not\([^)]*\)|:nth-child\([^)]*\)|:[\w-]+")

    def __init__(self, text: str):
        self.chains = [self._chain(part.strip()) for part in self._groups(text)]

    @staticmethod
    def _groups(text: str) -> list[str]:
        parts, depth, now = [], 0, ""
        for c in text:
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 0:
                parts.append(now)
                now = ""
            else:
                now += c
        return [*parts, now]

    def _chain(self, text: str) -> list[tuple[str, list[str]]]:
        chain, at, combinator = [], 0, " "
        while at < len(text):
            if m := re.compile(r"\s*([>+~])\s*|\s+").match(text, at):
                combinator, at = m[1] or " ", m.end()
                continue
            simple = []
            while m := self.COMPOUND.match(text, at):
                simple.append(m[0])
                at = m.end()
            if not simple:
                raise ValueError(f"selector: {text}")
            chain.append((combinator, simple))
            combinator = " "
        if not chain:
            raise ValueError("empty selector")
        return chain

    def select(self, root: Node) -> list[Node]:
        return [n for n in root.descendants() if n.kind == "element" and self.matches(n)]

    def matches(self, node: Node) -> bool:
        return any(self._matches(node, c, len(c) - 1) for c in self.chains)

    def _matches(self, node: Node, chain: list, k: int) -> bool:
        combinator, simple = chain[k]
        if not all(self._simple(node, s) for s in simple):
            return False
        if k == 0:
            return True
        if combinator in (">", " "):
            up = node.parent
            while up is not None and up.kind == "element":
                if self._matches(up, chain, k - 1):
                    return True
                up = None if combinator == ">" else up.parent
            return False
        siblings = node.parent.elements()
        before = siblings[: siblings.index(node)]
        return any(self._matches(s, chain, k - 1) for s in (before[-1:] if combinator == "+" else before))

    def _simple(self, n: Node, s: str) -> bool:
        if s == "*":
            return True
        if s[0] == "#":
            return n.attrs.get("id") == s[1:]
        if s[0] == ".":
            return s[1:] in n.attrs.get("class", "").split()
        if s[0] == "[":
            return self._attribute(n, s[1:-1].strip())
        if s.startswith(":not("):
            return not all(self._simple(n, m) for m in self.COMPOUND.findall(s[5:-1].strip()))
        if s[0] == ":":
            return self._position(n, s[1:])
        return n.tag == s.lower()

    @staticmethod
    def _attribute(n: Node, s: str) -> bool:
        m = re.fullmatch(r"([\w-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+?))\s*(i?))?", s)
        if not m:
            raise ValueError(f"selector: [{s}]")
        have = n.attrs.get(m[1].lower())
        if have is None or m[2] is None:
            return have is not None
        want = next(g for g in (m[3], m[4], m[5]) if g is not None)
        if m[6]:
            have, want = have.lower(), want.lower()
        return {"=": have == want, "~=": want in have.split(), "|=": have == want or have.startswith(want + "-"), "^=": want != "" and have.startswith(want), "$=": want != "" and have.endswith(want), "*=": want != "" and want in have}[m[2]]

    @staticmethod
    def _position(n: Node, s: str) -> bool:
        siblings = n.parent.elements()
        at = next(k for k, c in enumerate(siblings, 1) if c is n)
        if s in ("first-child", "last-child", "only-child"):
            return {"first-child": at == 1, "last-child": at == len(siblings), "only-child": len(siblings) == 1}[s]
        if s == "empty":
            return not any(c.kind == "element" or c.kind == "text" and c.text for c in n.children)
        if m := re.fullmatch(r"nth-child\(\s*(odd|even|\d+)\s*\)", s):
            return at % 2 == 1 if m[1] == "odd" else at % 2 == 0 if m[1] == "even" else at == int(m[1])
        raise ValueError(f"selector: :{s}")
