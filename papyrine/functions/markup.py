"""Markup trees as node rows: HTML and XML parsing, serializing, sanitizing, escaping.

A tree is a list of ``Row`` in document order.  ``pre`` numbers the nodes from 0,
``post`` is the ``pre`` after the node's last descendant, so that descendants of
a are exactly the nodes with ``a.pre < pre < a.post``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from xml.parsers import expat
from zlib import crc32

from . import html_tree
from .errors import Limits, TextError

NODE_TYPE = (
    "array<struct<pre:int,post:int,parent:int,depth:int,sib_idx:int,sib_count:int,kind:string,name:string,attrs:map<string,string>,text:string,above:bigint>>"
)
#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TEXT = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_RAW = frozenset("textarea title".split())
BOOLEAN_ATTRIBUTES = frozenset(
    "allowfullscreen async autofocus autoplay checked controls default defer disabled formnovalidate hidden inert ismap itemscope loop multiple muted nomodule novalidate open playsinline readonly required reversed selected".split()
)


@dataclass
class Tree:
    """A node while a tree is built."""

    kind: str
    name: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    text: str = ""
    children: list[Tree] = field(default_factory=list)


def parse_html(text: str, limits: Limits = Limits(depth=512, items=10_000_000), context: str | None = None) -> list[dict]:
    """Node rows of an HTML document, or of a fragment inside a ``context`` element, by the tree construction of the standard."""
    if len(text) > limits.total:
        raise TextError("limit", "document is too long", text[:1], 0)
    root = html_tree.build(text, limits, context)
    return rows(Tree("document", children=root.children) if context else root)


def parse_xml(text: str, limits: Limits = Limits(depth=256, items=10_000_000)) -> list[dict]:
    """Node rows of a well-formed XML document; names keep their prefixes, external entities are refused."""
    root = Tree("document")
    stack = [root]
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.ordered_attributes = True
    cdata = [False]

    def start(name: str, attrs: list[str]) -> None:
        if len(stack) > limits.depth:
            raise TextError("limit", "nested too deeply", text[:1], 0)
        node = Tree("element", name, dict(zip(attrs[::2], attrs[1::2], strict=True)))
        stack[-1].children.append(node)
        stack.append(node)

    def data(value: str) -> None:
        stack[-1].children.append(Tree("cdata" if cdata[0] else "text", text=value))

    def external(*_args) -> int:
        raise TextError("external", "external entities are not read", text[:1], 0)

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _name: stack.pop()
    parser.CharacterDataHandler = data
    parser.CommentHandler = lambda value: stack[-1].children.append(Tree("comment", text=value))
    parser.ProcessingInstructionHandler = lambda target, value: stack[-1].children.append(Tree("pi", target, text=value))
    parser.StartDoctypeDeclHandler = lambda name, *_: root.children.append(Tree("doctype", name))
    parser.StartCdataSectionHandler = lambda: cdata.__setitem__(0, True)
    parser.EndCdataSectionHandler = lambda: cdata.__setitem__(0, False)
    parser.ExternalEntityRefHandler = external
    try:
        parser.Parse(text.encode("utf-8") if not re.match(r"<\?xml[^>]*encoding=", text) else re.sub(r"(<\?xml[^>]*?)\s+encoding=(\"[^\"]*\"|'[^']*')", r"\1", text, count=1).encode(), True)
    except expat.ExpatError as e:
        error = TextError("not-well-formed", expat.ErrorString(e.code), text, 0)
        error.line, error.col = e.lineno, e.offset + 1
        error.offset = sum(len(x) + 1 for x in text.split("\n")[: e.lineno - 1]) + e.offset
        raise error from None
    return rows(root)


@lru_cache(1 << 16)
def _bit(key: str) -> int:
    return 1 << (crc32(key.encode()) & 63)


def key_bits(keys: Iterable[str]) -> int:
    """Bloom filter of 64 bits of element keys: ``#id``, ``.class``, type in lower case."""
    out = 0
    for key in keys:
        out |= _bit(key)
    return out


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def element_keys(name: str, attrs: dict[str, str]) -> list[str]:
    return [name.lower(), *(["#" + attrs["id"]] if attrs.get("id") else []), *("." + c for c in attrs.get("class", "").split())]


def rows(root: Tree | html_tree.Node) -> list[dict]:
    """Node rows of a tree in document order; ``above`` is the filter of the keys of all ancestors."""
    below: list[int] = []  # for each node the filter of its own keys and those above it
    out: list[dict] = []
    pending: list[tuple | int] = [(root, -1, 0, 0, 1)]
    while pending:
        item = pending.pop()
        if isinstance(item, int):
            out[item]["post"] = len(out)
            continue
        node, parent, depth, index, count = item
        pre = len(out)
        out.append({"pre": pre, "post": pre + 1, "parent": parent, "depth": depth, "sib_idx": index, "sib_count": count, "kind": node.kind, "name": node.name, "attrs": node.attrs, "text": node.text, "above": signed(below[parent] if parent >= 0 else 0)})
        above = below[parent] if parent >= 0 else 0
        below.append(above | key_bits(element_keys(node.name, node.attrs)) if node.kind == "element" else above)
        pending.append(pre)
        elements = sum(c.kind == "element" for c in node.children)
        place = elements
        for child in reversed(node.children):
            if child.kind == "element":
                place -= 1
            pending.append((child, pre, depth + 1, place if child.kind == "element" else -1, elements if child.kind == "element" else 0))
    return out


def escape(text: str, attribute: bool = False) -> str:
    """HTML escaping of text or of a double-quoted attribute value."""
    text = text.replace("&", "&amp;").replace("\xa0", "&nbsp;")
    return text.replace('"', "&quot;") if attribute else text.replace("<", "&lt;").replace(">", "&gt;")


def serialize_html(nodes: list[dict]) -> str:
    """HTML text of node rows, by the serialization algorithm of the standard."""
    out: list[str] = []
    open_tags: list[tuple[int, str]] = []
    by_pre = {n["pre"]: n for n in nodes}
    for n in sorted(nodes, key=lambda x: x["pre"]):
        while open_tags and n["pre"] >= open_tags[-1][0]:
            out.append(f"</{open_tags.pop()[1]}>")
        kind = n["kind"]
        if kind == "element":
            attrs = n["attrs"].items() if isinstance(n["attrs"], dict) else n["attrs"] or ()
            out.append(f"<{n['name']}" + "".join(f' {k}="{escape(v, True)}"' for k, v in attrs) + ">")
            if n["name"] not in VOID:
                open_tags.append((n["post"], n["name"]))
        elif kind == "text":
            parent = by_pre.get(n["parent"])
            out.append(n["text"] if parent and parent["name"] in RAW_TEXT | {"plaintext"} else escape(n["text"]))
        elif kind == "cdata":
            out.append(f"<![CDATA[{n['text']}]]>")
        elif kind == "comment":
            out.append(f"<!--{n['text']}-->")
        elif kind == "doctype":
            out.append(f"<!DOCTYPE {n['name']}>")
        elif kind == "pi":
            out.append(f"<?{n['name']} {n['text']}>")
    out += [f"</{name}>" for _, name in reversed(open_tags)]
    return "".join(out)


def serialize_xml(nodes: list[dict], declaration: bool = False) -> str:
    """XML text of node rows; empty elements are self-closed."""
    out = ['<?xml version="1.0" encoding="UTF-8"?>'] if declaration else []
    open_tags: list[tuple[int, str]] = []

    def text(value: str, attribute: bool = False) -> str:
        value = value.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#13;")
        return value.replace('"', "&quot;").replace("\t", "&#9;").replace("\n", "&#10;") if attribute else value

    for n in sorted(nodes, key=lambda x: x["pre"]):
        while open_tags and n["pre"] >= open_tags[-1][0]:
            out.append(f"</{open_tags.pop()[1]}>")
        kind = n["kind"]
        if kind == "element":
            attrs = n["attrs"].items() if isinstance(n["attrs"], dict) else n["attrs"] or ()
            out.append(f"<{n['name']}" + "".join(f' {k}="{text(v, True)}"' for k, v in attrs))
            out.append("/>" if n["post"] == n["pre"] + 1 else ">")
            if n["post"] > n["pre"] + 1:
                open_tags.append((n["post"], n["name"]))
        elif kind in ("text", "cdata"):
            out.append(text(n["text"]) if kind == "text" else f"<![CDATA[{n['text']}]]>")
        elif kind == "comment":
            if "--" in n["text"] or n["text"].endswith("-"):
                raise TextError("unwritable", "a comment holds '--' or ends in '-'")
            out.append(f"<!--{n['text']}-->")
        elif kind == "pi":
            out.append(f"<?{n['name']} {n['text']}?>")
        elif kind == "doctype":
            out.append(f"<!DOCTYPE {n['name']}>")
    out += [f"</{name}>" for _, name in reversed(open_tags)]
    return "".join(out)


#: What the sanitizer lets through.
SAFE_TAGS = frozenset(
    "a abbr b blockquote br caption cite code col colgroup dd del details dfn div dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr i img ins kbd li mark ol p pre q rp rt ruby s samp small span strong sub summary sup table tbody td tfoot th thead time tr u ul var".split()
)
SAFE_ATTRIBUTES = {"a": "href", "img": "src alt width height", "td": "colspan rowspan", "th": "colspan rowspan scope", "ol": "start reversed", "time": "datetime", "q": "cite", "blockquote": "cite", "del": "cite datetime", "ins": "cite datetime", "*": "title lang dir"}
SAFE_SCHEMES = frozenset(("http", "https", "mailto"))
DROP_WITH_CONTENT = frozenset("script style iframe object embed noscript template title textarea svg math head noembed noframes xmp select".split())


def sanitize(text: str, images: bool = False) -> str:
    """HTML with only allowed elements, attributes and link schemes; links get rel=nofollow, images stay only if asked for."""
    nodes = parse_html(text)
    out: list[str] = []
    open_tags: list[tuple[int, str]] = []
    skip_to = -1
    for n in nodes:
        while open_tags and n["pre"] >= open_tags[-1][0]:
            out.append(f"</{open_tags.pop()[1]}>")
        if n["pre"] < skip_to:
            continue
        if n["kind"] == "text":
            out.append(escape(n["text"]))
        elif n["kind"] == "element":
            name = n["name"]
            if name in DROP_WITH_CONTENT:
                skip_to = n["post"]
            elif name in SAFE_TAGS and (images or name != "img"):
                allowed = set(f"{SAFE_ATTRIBUTES.get(name, '')} {SAFE_ATTRIBUTES['*']}".split())
                kept = {k: v for k, v in n["attrs"].items() if k in allowed and (k not in ("href", "src", "cite") or safe_url(v))}
                if name == "a" and "href" in kept:
                    kept["rel"] = "nofollow"
                out.append(f"<{name}" + "".join(f' {k}="{escape(v, True)}"' for k, v in kept.items()) + ">")
                if name not in VOID:
                    open_tags.append((n["post"], name))
    out += [f"</{name}>" for _, name in reversed(open_tags)]
    return "".join(out)


def safe_url(url: str) -> bool:
    """Whether a URL is relative or of an allowed scheme, read as browsers do (controls and spaces ignored)."""
    clean = re.sub(r"[\0-\x20]", "", url)
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", clean)
    return not (":" in clean.split("/")[0].split("?")[0].split("#")[0]) if not m else m[1].lower() in SAFE_SCHEMES


_NAME_START = r":A-Z_a-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000EFFFF"
_XML_NAME = re.compile(f"[{_NAME_START}][{_NAME_START}\\-.0-9·̀-ͯ‿-⁀]*")


def is_xml_name(text: str) -> bool:
    return bool(_XML_NAME.fullmatch(text))


def xml_chars_ok(text: str) -> bool:
    return not re.search(r"[^\t\n\r\x20-퟿-�\U00010000-\U0010FFFF]", text)


def equal(a: str, b: str, xml: bool = False) -> bool:
    """Whether two texts have the same tree: attributes in any order, adjacent texts joined, comments counted."""
    parse = parse_xml if xml else parse_html
    keep = ("parent", "depth", "kind", "name", "attrs", "text")
    x, y = ([tuple(n[k] for k in keep) for n in parse(t)] for t in (a, b))
    return x == y
