"""Tree construction of HTML: insertion modes, active formatting elements, templates, foreign content.

``build`` reads a text once and returns the tree of a document or of a fragment.  A
token goes to the rules of the current insertion mode, or to those of foreign
content inside svg and math; a rule inserts, closes, changes the mode, or asks for
the token to be handled again.  The tree never fails to come out, whatever the
text; only limits raise an error.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

from .errors import Limits, TextError

HTML, SVG, MATH = "html", "svg", "math"
_SPACE = " \t\n\f\r"


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


# Fixed values of the HTML standard: groups of elements by the rules that hold for them.
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
FORMATTING = _set("a b big code em font i nobr s small strike strong tt u")
SPECIAL = _set(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure "
    "footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p "
    "param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp"
)
BLOCKS = _set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul")
CLOSED_BY_NAME = BLOCKS - {"p"} | _set("button listing pre")
HEAD_PARTS = _set("base basefont bgsound link meta noframes script style template title")
IMPLIED_END = _set("dd dt li optgroup option p rb rp rt rtc")
THOROUGH_END = IMPLIED_END | _set("caption colgroup tbody td tfoot th thead tr")
TABLE_BODIES, CELLS = _set("tbody tfoot thead"), _set("td th")
TABLE_STRUCTURE = TABLE_BODIES | {"table", "tr"}
TABLE_ONLY = _set("caption col colgroup frame head tbody td tfoot th thead tr")
VOID = _set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr")
RAW = _set("script style xmp iframe noembed noframes")
ESCAPABLE = _set("textarea title")
MARKED = _set("applet marquee object")
SCOPE = _set("applet caption html table td th marquee object template select")
FOREIGN_SCOPE = {MATH: _set("mi mo mn ms mtext annotation-xml"), SVG: _set("foreignObject desc title")}
MATH_TEXT, SVG_HOLDERS = _set("mi mo mn ms mtext"), FOREIGN_SCOPE[SVG]
BREAKOUT = _set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var"
)
SVG_NAMES = {
    n.lower(): n
    for n in (
        "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer feComposite feConvolveMatrix feDiffuseLighting "
        "feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting "
        "feSpotLight feTile feTurbulence foreignObject glyphRef linearGradient radialGradient textPath"
    ).split()
}
SVG_ATTRIBUTES = {
    n.lower(): n
    for n in (
        "attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef gradientTransform gradientUnits kernelMatrix kernelUnitLength "
        "keyPoints keySplines keyTimes lengthAdjust limitingConeAngle markerHeight markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength patternContentUnits patternTransform "
        "patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur requiredExtensions requiredFeatures specularConstant "
        "specularExponent spreadMethod startOffset stdDeviation stitchTiles surfaceScale systemLanguage tableValues targetX targetY textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan"
    ).split()
}
QUIRKY_PUBLIC = re.compile(r"html\Z|-//(?:w3c//dtd (?:html 3|html 4\.0 (?:frameset|transitional)|w3 html)|ietf//dtd html|netscape|microsoft|sun microsystems|softquad|webtechs|o'reilly|metrius|spyglass|advasoft|as//dtd)", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?|[\"'])*?)(/?)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass(eq=False, slots=True)
class Node:
    """A node of the tree."""

    kind: str
    name: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    text: str = ""
    children: list[Node] = field(default_factory=list)
    parent: Node | None = None
    space: str = HTML

    def add(self, node: Node, at: int | None = None) -> None:
        if node.parent is not None:
            node.parent.children.remove(node)
        node.parent = self
        self.children.insert(len(self.children) if at is None else at, node)

    def integrates_html(self) -> bool:
        if self.space == SVG:
            return self.name in SVG_HOLDERS
        return self.space == MATH and self.name == "annotation-xml" and self.attrs.get("encoding", "").lower() in ("text/html", "application/xhtml+xml")

    def integrates_text(self) -> bool:
        return self.space == MATH and self.name in MATH_TEXT


@dataclass(slots=True)
class Token:
    kind: str
    name: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    text: str = ""
    closed: bool = False


class Builder:
    """State of one parse."""

    def __init__(self, limits: Limits, context: str | None = None):
        self.limits = limits
        self.root = Node("document")
        self.stack: list[Node] = []
        self.formatting: list[Node | None] = []
        self.templates: list[str] = []
        self.mode, self.before_text, self.quirks = "initial", "", False
        self.head = self.form = None
        self.foster = self.skip_line = self.plain = False
        self.raw: Node | None = None
        self.context = Node("element", context.lower()) if context else None
        self.count = 0
        if self.context:
            self.stack = [self.insert_into(self.root, "html")]
            if self.context.name == "template":
                self.templates.append("in_template")
            self.reset_mode()

    # stack and places

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def adjusted(self) -> Node:
        return self.context if self.context and len(self.stack) == 1 else self.top

    def in_scope(self, names, extra: frozenset[str] = frozenset(), base: frozenset[str] = SCOPE) -> bool:
        names = (names,) if isinstance(names, str) else names
        for node in reversed(self.stack):
            if node.space == HTML:
                if node.name in names:
                    return True
                if node.name in base or node.name in extra:
                    return False
            elif node.name in FOREIGN_SCOPE[node.space]:
                return False
        return False

    def in_button_scope(self, name: str) -> bool:
        return self.in_scope(name, frozenset(("button",)))

    def in_table_scope(self, names) -> bool:
        return self.in_scope(names, base=frozenset(("html", "table", "template")))

    def has(self, name: str) -> bool:
        return any(n.name == name and n.space == HTML for n in self.stack)

    def pop_until(self, names) -> None:
        names = (names,) if isinstance(names, str) else names
        while len(self.stack) > 1:
            node = self.stack.pop()
            if node.space == HTML and node.name in names:
                return

    def clear_to(self, names: frozenset[str]) -> None:
        while not (self.top.space == HTML and (self.top.name in names or self.top.name in ("html", "template"))):
            self.stack.pop()

    def imply_end(self, but: str = "", of: frozenset[str] = IMPLIED_END) -> None:
        while self.top.space == HTML and self.top.name in of and self.top.name != but:
            self.stack.pop()

    def close_p(self) -> None:
        if self.in_button_scope("p"):
            self.imply_end("p")
            self.pop_until("p")

    def place(self, target: Node | None = None) -> tuple[Node, int | None]:
        """Where a new node goes: in the target (the current node), or before the table around it."""
        target = target or self.top
        if not (self.foster and target.space == HTML and target.name in TABLE_STRUCTURE):
            return target, None
        table = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].name == "table" and self.stack[i].space == HTML), -1)
        template = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].name == "template" and self.stack[i].space == HTML), -1)
        if template > table:
            return self.stack[template], None
        if table < 0:
            return self.stack[0], None
        own = self.stack[table]
        if own.parent is not None:
            return own.parent, own.parent.children.index(own)
        return self.stack[table - 1], None

    def insert_into(self, parent: Node, name: str, attrs: dict[str, str] | None = None, at: int | None = None, space: str = HTML) -> Node:
        self.count += 1
        if self.count > self.limits.items:
            raise TextError("limit", "too many nodes")
        node = Node("element", name, attrs or {}, space=space)
        parent.add(node, at)
        return node

    def insert(self, token: Token | str, space: str = HTML) -> Node:
        token = Token("start", token) if isinstance(token, str) else token
        parent, at = self.place()
        node = self.insert_into(parent, token.name, dict(token.attrs), at, space)
        if len(self.stack) >= self.limits.depth:
            raise TextError("limit", "too many open elements")
        self.stack.append(node)
        return node

    def insert_void(self, token: Token | str) -> None:
        self.insert(token)
        self.stack.pop()

    def insert_text(self, text: str) -> None:
        parent, at = self.place()
        if parent.kind == "document" or not text:
            return
        before = len(parent.children) - 1 if at is None else at - 1
        if before >= 0 and parent.children[before].kind == "text":
            parent.children[before].text += text
            return
        self.count += 1
        if self.count > self.limits.items:
            raise TextError("limit", "too many nodes")
        parent.add(Node("text", text=text), at)

    def comment(self, text: str, parent: Node | None = None) -> None:
        where, at = (parent, None) if parent else self.place()
        where.add(Node("comment", text=text), at)

    def merge(self, node: Node, attrs: dict[str, str]) -> None:
        for k, v in attrs.items():
            node.attrs.setdefault(k, v)

    # active formatting elements

    def remember(self, node: Node) -> None:
        """Add a formatting element; of equal ones after the last marker three stay."""
        same = []
        for i in range(len(self.formatting) - 1, -1, -1):
            other = self.formatting[i]
            if other is None:
                break
            if other.name == node.name and other.attrs == node.attrs:
                same.append(i)
        if len(same) >= 3:
            del self.formatting[same[-1]]
        self.formatting.append(node)

    def reconstruct(self) -> None:
        """Open again the formatting elements that were closed without their end tags."""
        at = len(self.formatting)
        while at and self.formatting[at - 1] is not None and self.formatting[at - 1] not in self.stack:
            at -= 1
        for i in range(at, len(self.formatting)):
            self.formatting[i] = self.insert(Token("start", self.formatting[i].name, self.formatting[i].attrs))

    def clear_formatting(self) -> None:
        while self.formatting and self.formatting.pop() is not None:
            pass

    def formatting_element(self, name: str) -> Node | None:
        for node in reversed(self.formatting):
            if node is None:
                return None
            if node.name == name:
                return node
        return None

    def adopt(self, name: str) -> bool:
        """Close a formatting element across blocks that opened inside it; False if the tag is an ordinary one."""
        if self.top.name == name and self.top.space == HTML and self.top not in self.formatting:
            self.stack.pop()
            return True
        for _ in range(8):
            element = self.formatting_element(name)
            if element is None:
                return False
            if element not in self.stack:
                self.formatting.remove(element)
                return True
            if not self.in_scope(name):
                return True
            at = self.stack.index(element)
            block = next((i for i in range(at + 1, len(self.stack)) if self._special(self.stack[i])), None)
            if block is None:
                del self.stack[at:]
                self.formatting.remove(element)
                return True
            self._move_across(element, at, self.stack[block])
        return True

    def _move_across(self, element: Node, at: int, block: Node) -> None:
        """One round of the adoption agency: the block leaves the element, which is opened again inside it."""
        ancestor = self.stack[at - 1]
        bookmark = self.formatting.index(element)
        last, i, rounds = block, self.stack.index(block), 0
        while True:
            i -= 1
            node = self.stack[i]
            if node is element:
                break
            rounds += 1
            if rounds > 3 and node in self.formatting:
                place = self.formatting.index(node)
                del self.formatting[place]
                bookmark -= place < bookmark
            if node not in self.formatting:
                del self.stack[i]
                continue
            copy = Node("element", node.name, dict(node.attrs))
            place = self.formatting.index(node)
            self.formatting[place] = self.stack[i] = copy
            if last is block:
                bookmark = place + 1
            copy.add(last)
            last = copy
        if last.parent is not None:
            last.parent.children.remove(last)
            last.parent = None
        kept, self.foster = self.foster, True
        parent, where = self.place(ancestor)
        self.foster = kept
        parent.add(last, where)
        copy = Node("element", element.name, dict(element.attrs))
        for child in list(block.children):
            copy.add(child)
        block.add(copy)
        place = self.formatting.index(element)
        del self.formatting[place]
        self.formatting.insert(bookmark - (place < bookmark), copy)
        self.stack.remove(element)
        self.stack.insert(self.stack.index(block) + 1, copy)

    @staticmethod
    def _special(node: Node) -> bool:
        return node.name in SPECIAL if node.space == HTML else node.name in FOREIGN_SCOPE[node.space]

    def reset_mode(self) -> None:
        """Insertion mode that fits the open elements."""
        for i in range(len(self.stack) - 1, -1, -1):
            last = i == 0
            node = self.context if last and self.context else self.stack[i]
            name = node.name if node.space == HTML else ""
            if name == "select":
                above = [n.name for n in self.stack[:i]]
                self.mode = "in_select_in_table" if "table" in above and "template" not in above[above.index("table") :] else "in_select"
                return
            if name in CELLS and not last:
                self.mode = "in_cell"
            elif name in TABLE_BODIES:
                self.mode = "in_table_body"
            elif name in ("tr", "caption", "table", "body"):
                self.mode = {"tr": "in_row"}.get(name, f"in_{name}")
            elif name == "colgroup":
                self.mode = "in_column_group"
            elif name == "template":
                self.mode = self.templates[-1]
            elif name == "head" and not last:
                self.mode = "in_head"
            elif name == "html":
                self.mode = "before_head" if self.head is None else "after_head"
            elif last:
                self.mode = "in_body"
            else:
                continue
            return

    # dispatch

    def process(self, token: Token) -> None:
        """Give a token to the rules that hold now, again as long as a rule asks for it."""
        for _ in range(len(self.stack) + 40):
            if not getattr(self, "foreign" if self._is_foreign(token) else self.mode)(token):
                return

    def _is_foreign(self, token: Token) -> bool:
        if not self.stack:
            return False
        node = self.adjusted()
        if node.space == HTML or token.kind == "eof":
            return False
        if node.integrates_text() and (token.kind in ("text",) or token.kind == "start" and token.name not in ("mglyph", "malignmark")):
            return False
        if node.space == MATH and node.name == "annotation-xml" and token.kind == "start" and token.name == "svg":
            return False
        return not (node.integrates_html() and token.kind in ("start", "text"))

    @staticmethod
    def _lead(token: Token) -> tuple[str, str]:
        rest = token.text.lstrip(_SPACE)
        return token.text[: len(token.text) - len(rest)], rest

    # modes before the body

    def initial(self, token: Token) -> bool:
        if token.kind == "text":
            token.text = self._lead(token)[1]
            if not token.text:
                return False
        elif token.kind == "comment":
            self.comment(token.text, self.root)
            return False
        elif token.kind == "doctype":
            self.root.add(Node("doctype", token.name))
            self.quirks = token.closed
            self.mode = "before_html"
            return False
        self.quirks = True
        self.mode = "before_html"
        return True

    def before_html(self, token: Token) -> bool:
        if token.kind == "doctype":
            return False
        if token.kind == "comment":
            self.comment(token.text, self.root)
            return False
        if token.kind == "text":
            token.text = self._lead(token)[1]
            if not token.text:
                return False
        if token.kind == "start" and token.name == "html":
            self.stack.append(self.insert_into(self.root, "html", token.attrs))
            self.mode = "before_head"
            return False
        if token.kind == "end" and token.name not in ("head", "body", "html", "br"):
            return False
        self.stack.append(self.insert_into(self.root, "html"))
        self.mode = "before_head"
        return True

    def before_head(self, token: Token) -> bool:
        if token.kind == "comment":
            self.comment(token.text)
            return False
        if token.kind == "text":
            token.text = self._lead(token)[1]
            if not token.text:
                return False
        if token.kind == "doctype" or token.kind == "end" and token.name not in ("head", "body", "html", "br"):
            return False
        if token.kind == "start" and token.name == "html":
            return self.in_body(token)
        own = token.kind == "start" and token.name == "head"
        self.head = self.insert(token if own else "head")
        self.mode = "in_head"
        return not own

    def in_head(self, token: Token) -> bool:
        if token.kind == "text":
            lead, token.text = self._lead(token)
            self.insert_text(lead)
            if not token.text:
                return False
        elif token.kind == "comment":
            self.comment(token.text)
            return False
        elif token.kind == "doctype":
            return False
        elif token.kind == "start":
            if token.name == "html":
                return self.in_body(token)
            if token.name in ("base", "basefont", "bgsound", "link", "meta"):
                self.insert_void(token)
                return False
            if token.name == "noscript":
                self.insert(token)
                self.mode = "in_head_noscript"
                return False
            if token.name in ("title", "noframes", "style", "script"):
                self.insert_raw(token)
                return False
            if token.name == "template":
                self.insert(token)
                self.formatting.append(None)
                self.mode = "in_template"
                self.templates.append("in_template")
                return False
            if token.name == "head":
                return False
        elif token.kind == "end":
            if token.name == "head":
                self.stack.pop()
                self.mode = "after_head"
                return False
            if token.name == "template":
                if self.has("template"):
                    self.imply_end(of=THOROUGH_END)
                    self.pop_until("template")
                    self.clear_formatting()
                    self.templates.pop()
                    self.reset_mode()
                return False
            if token.name not in ("body", "html", "br"):
                return False
        self.stack.pop()
        self.mode = "after_head"
        return True

    def in_head_noscript(self, token: Token) -> bool:
        if token.kind == "end" and token.name == "noscript":
            self.stack.pop()
            self.mode = "in_head"
            return False
        if token.kind == "comment" or token.kind == "text" and not token.text.strip(_SPACE) or token.kind == "start" and token.name in ("basefont", "bgsound", "link", "meta", "noframes", "style"):
            return self.in_head(token)
        if token.kind == "doctype" or token.kind == "start" and token.name in ("head", "noscript") or token.kind == "end" and token.name != "br":
            return False
        self.stack.pop()
        self.mode = "in_head"
        return True

    def after_head(self, token: Token) -> bool:
        if token.kind == "text":
            lead, token.text = self._lead(token)
            self.insert_text(lead)
            if not token.text:
                return False
        elif token.kind == "comment":
            self.comment(token.text)
            return False
        elif token.kind == "doctype":
            return False
        elif token.kind == "start":
            if token.name == "html":
                return self.in_body(token)
            if token.name == "body":
                self.insert(token)
                self.mode = "in_body"
                return False
            if token.name in HEAD_PARTS:
                self.stack.append(self.head)
                self.in_head(token)
                if self.head in self.stack:
                    self.stack.remove(self.head)
                return False
            if token.name == "head":
                return False
        elif token.kind == "end":
            if token.name == "template":
                return self.in_head(token)
            if token.name not in ("body", "html", "br"):
                return False
        self.insert("body")
        self.mode = "in_body"
        return True

    # body

    def in_body(self, token: Token) -> bool:
        match token.kind:
            case "text":
                if text := token.text.replace("\0", ""):
                    self.reconstruct()
                    self.insert_text(text)
                return False
            case "comment":
                self.comment(token.text)
                return False
            case "start":
                return self.body_start(token)
            case "end":
                return self.body_end(token)
            case "eof":
                return self.in_template(token) if self.templates else False
        return False

    def body_start(self, token: Token) -> bool:
        name = token.name
        if name == "html":
            if not self.has("template"):
                self.merge(self.stack[0], token.attrs)
        elif name in HEAD_PARTS:
            return self.in_head(token)
        elif name == "body":
            if len(self.stack) > 1 and self.stack[1].name == "body" and not self.has("template"):
                self.merge(self.stack[1], token.attrs)
        elif name in BLOCKS:
            self.close_p()
            self.insert(token)
        elif name in HEADINGS:
            self.close_p()
            if self.top.space == HTML and self.top.name in HEADINGS:
                self.stack.pop()
            self.insert(token)
        elif name in ("pre", "listing"):
            self.close_p()
            self.insert(token)
            self.skip_line = True
        elif name == "form":
            if self.form is None or self.has("template"):
                self.close_p()
                node = self.insert(token)
                self.form = self.form if self.has("template") else node
        elif name in ("li", "dd", "dt"):
            self.close_items(("li",) if name == "li" else ("dd", "dt"))
            self.close_p()
            self.insert(token)
        elif name == "plaintext":
            self.close_p()
            self.insert(token)
            self.plain = True
        elif name == "button":
            if self.in_scope("button"):
                self.imply_end()
                self.pop_until("button")
            self.reconstruct()
            self.insert(token)
        elif name in FORMATTING:
            self.start_formatting(token)
        elif name in MARKED:
            self.reconstruct()
            self.insert(token)
            self.formatting.append(None)
        elif name == "table":
            if not self.quirks:
                self.close_p()
            self.insert(token)
            self.mode = "in_table"
        elif name in ("area", "br", "embed", "img", "keygen", "wbr", "input", "image"):
            token.name = "img" if name == "image" else name
            self.reconstruct()
            self.insert_void(token)
        elif name in ("param", "source", "track"):
            self.insert_void(token)
        elif name == "hr":
            self.close_p()
            self.insert_void(token)
        elif name in ("textarea", "iframe", "noembed"):
            self.insert_raw(token)
        elif name == "xmp":
            self.close_p()
            self.reconstruct()
            self.insert_raw(token)
        elif name == "select":
            self.reconstruct()
            self.insert(token)
            self.mode = "in_select_in_table" if self.mode in ("in_table", "in_caption", "in_table_body", "in_row", "in_cell") else "in_select"
        elif name in ("optgroup", "option"):
            if self.top.name == "option":
                self.stack.pop()
            self.reconstruct()
            self.insert(token)
        elif name in ("rb", "rtc", "rp", "rt"):
            if self.in_scope("ruby"):
                self.imply_end("" if name in ("rb", "rtc") else "rtc")
            self.insert(token)
        elif name in (MATH, SVG):
            self.reconstruct()
            self.insert_foreign(token, name)
        elif name not in TABLE_ONLY and name != "frameset":
            self.reconstruct()
            self.insert(token)
        return False

    def start_formatting(self, token: Token) -> None:
        if token.name == "a" and (open_link := self.formatting_element("a")) is not None:
            self.adopt("a")
            if open_link in self.formatting:
                self.formatting.remove(open_link)
            if open_link in self.stack:
                self.stack.remove(open_link)
        self.reconstruct()
        if token.name == "nobr" and self.in_scope("nobr"):
            self.adopt("nobr")
            self.reconstruct()
        self.remember(self.insert(token))

    def close_items(self, names: tuple[str, ...]) -> None:
        """Close the list item that a new one ends, unless another special element lies between."""
        for node in reversed(self.stack):
            if node.space == HTML and node.name in names:
                self.imply_end(node.name)
                self.pop_until(node.name)
                return
            if self._special(node) and node.name not in ("address", "div", "p"):
                return

    def body_end(self, token: Token) -> bool:
        name = token.name
        if name == "template":
            return self.in_head(token)
        if name in ("body", "html"):
            if self.in_scope("body"):
                self.mode = "after_body"
                return name == "html"
        elif name in CLOSED_BY_NAME:
            if self.in_scope(name):
                self.imply_end()
                self.pop_until(name)
        elif name == "form":
            self.end_form()
        elif name == "p":
            if not self.in_button_scope("p"):
                self.insert("p")
            self.close_p()
        elif name in ("li", "dd", "dt"):
            if self.in_scope(name, frozenset(("ol", "ul")) if name == "li" else frozenset()):
                self.imply_end(name)
                self.pop_until(name)
        elif name in HEADINGS:
            if self.in_scope(HEADINGS):
                self.imply_end()
                self.pop_until(HEADINGS)
        elif name in FORMATTING:
            if not self.adopt(name):
                self.end_other(name)
        elif name in MARKED:
            if self.in_scope(name):
                self.imply_end()
                self.pop_until(name)
                self.clear_formatting()
        elif name == "br":
            return self.body_start(Token("start", "br"))
        else:
            self.end_other(name)
        return False

    def end_form(self) -> None:
        if self.has("template"):
            if self.in_scope("form"):
                self.imply_end()
                self.pop_until("form")
            return
        node, self.form = self.form, None
        if node is not None and node in self.stack and self.in_scope("form"):
            self.imply_end()
            self.stack.remove(node)

    def end_other(self, name: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            node = self.stack[i]
            if node.name == name and node.space == HTML:
                self.imply_end(name)
                del self.stack[i:]
                return
            if self._special(node):
                return

    def insert_raw(self, token: Token) -> None:
        """An element whose content is text up to its own end tag."""
        self.raw = self.insert(token)

    def after_body(self, token: Token) -> bool:
        if token.kind == "comment":
            self.comment(token.text, self.stack[0])
            return False
        if token.kind == "text" and not token.text.strip(_SPACE) or token.kind == "start" and token.name == "html":
            return self.in_body(token)
        if token.kind == "end" and token.name == "html":
            self.mode = "after_html"
            return False
        if token.kind in ("eof", "doctype"):
            return False
        self.mode = "in_body"
        return True

    def after_html(self, token: Token) -> bool:
        if token.kind == "comment":
            self.comment(token.text, self.root)
            return False
        return self.after_body(token) if token.kind != "end" or token.name != "html" else False

    # tables

    def in_table(self, token: Token) -> bool:
        if token.kind == "text" and self.top.name in TABLE_STRUCTURE:
            if token.text.strip(_SPACE):
                return self.fostered(token)
            self.insert_text(token.text)
            return False
        if token.kind == "comment":
            self.comment(token.text)
            return False
        if token.kind == "doctype":
            return False
        if token.kind == "start":
            name = token.name
            if name in ("caption", "colgroup") or name in TABLE_BODIES:
                self.clear_to(frozenset(("table",)))
                if name == "caption":
                    self.formatting.append(None)
                self.insert(token)
                self.mode = {"caption": "in_caption", "colgroup": "in_column_group"}.get(name, "in_table_body")
                return False
            if name == "col":
                self.clear_to(frozenset(("table",)))
                self.insert("colgroup")
                self.mode = "in_column_group"
                return True
            if name in CELLS or name == "tr":
                self.clear_to(frozenset(("table",)))
                self.insert("tbody")
                self.mode = "in_table_body"
                return True
            if name == "table":
                if not self.in_table_scope("table"):
                    return False
                self.pop_until("table")
                self.reset_mode()
                return True
            if name in ("style", "script", "template"):
                return self.in_head(token)
            if name == "input" and token.attrs.get("type", "").lower() == "hidden":
                self.insert_void(token)
                return False
            if name == "form":
                if self.form is None and not self.has("template"):
                    self.form = self.insert(token)
                    self.stack.pop()
                return False
        elif token.kind == "end":
            if token.name == "table":
                if self.in_table_scope("table"):
                    self.pop_until("table")
                    self.reset_mode()
                return False
            if token.name == "template":
                return self.in_head(token)
            if token.name in ("body", "html") or token.name in THOROUGH_END - IMPLIED_END or token.name == "col":
                return False
        elif token.kind == "eof":
            return self.in_body(token)
        return self.fostered(token)

    def fostered(self, token: Token) -> bool:
        self.foster = True
        again = self.in_body(token)
        self.foster = False
        return again

    def in_caption(self, token: Token) -> bool:
        ends = token.kind == "end" and token.name in ("caption", "table") or token.kind == "start" and token.name in TABLE_ONLY - {"frame", "head"}
        if ends:
            if self.in_table_scope("caption"):
                self.imply_end()
                self.pop_until("caption")
                self.clear_formatting()
                self.mode = "in_table"
                return not (token.kind == "end" and token.name == "caption")
            return False
        if token.kind == "end" and token.name in THOROUGH_END - IMPLIED_END | {"body", "col", "html"}:
            return False
        return self.in_body(token)

    def in_column_group(self, token: Token) -> bool:
        if token.kind == "text":
            lead, token.text = self._lead(token)
            self.insert_text(lead)
            if not token.text:
                return False
        elif token.kind == "comment":
            self.comment(token.text)
            return False
        elif token.kind == "doctype":
            return False
        elif token.kind == "start" and token.name == "col":
            self.insert_void(token)
            return False
        elif token.name == "template" or token.kind == "eof":
            return self.in_head(token) if token.kind != "eof" else self.in_body(token)
        elif token.kind == "end" and token.name == "col":
            return False
        if self.top.name != "colgroup":
            return False
        self.stack.pop()
        self.mode = "in_table"
        return not (token.kind == "end" and token.name == "colgroup")

    def in_table_body(self, token: Token) -> bool:
        name = token.name
        if token.kind == "start" and (name == "tr" or name in CELLS):
            self.clear_to(TABLE_BODIES)
            self.insert(token if name == "tr" else "tr")
            self.mode = "in_row"
            return name != "tr"
        if token.kind == "end" and name in TABLE_BODIES:
            if self.in_table_scope(name):
                self.clear_to(TABLE_BODIES)
                self.stack.pop()
                self.mode = "in_table"
            return False
        if token.kind == "start" and (name in ("caption", "col", "colgroup") or name in TABLE_BODIES) or token.kind == "end" and name == "table":
            if not self.in_table_scope(TABLE_BODIES):
                return False
            self.clear_to(TABLE_BODIES)
            self.stack.pop()
            self.mode = "in_table"
            return True
        if token.kind == "end" and name in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            return False
        return self.in_table(token)

    def in_row(self, token: Token) -> bool:
        name = token.name
        if token.kind == "start" and name in CELLS:
            self.clear_to(frozenset(("tr",)))
            self.insert(token)
            self.mode = "in_cell"
            self.formatting.append(None)
            return False
        leaves = token.kind == "start" and (name in ("caption", "col", "colgroup", "tr") or name in TABLE_BODIES) or token.kind == "end" and name == "table"
        if leaves or token.kind == "end" and (name == "tr" or name in TABLE_BODIES):
            if name in TABLE_BODIES and token.kind == "end" and not self.in_table_scope(name) or not self.in_table_scope("tr"):
                return False
            self.clear_to(frozenset(("tr",)))
            self.stack.pop()
            self.mode = "in_table_body"
            return not (token.kind == "end" and name == "tr")
        if token.kind == "end" and name in ("body", "caption", "col", "colgroup", "html", "td", "th"):
            return False
        return self.in_table(token)

    def in_cell(self, token: Token) -> bool:
        name = token.name
        if token.kind == "end" and name in CELLS:
            if self.in_table_scope(name):
                self.imply_end()
                self.pop_until(name)
                self.clear_formatting()
                self.mode = "in_row"
            return False
        if token.kind == "start" and name in TABLE_ONLY - {"frame", "head"} or token.kind == "end" and name in TABLE_STRUCTURE:
            if token.kind == "end" and not self.in_table_scope(name) or not self.in_table_scope(CELLS):
                return False
            self.imply_end()
            self.pop_until(CELLS)
            self.clear_formatting()
            self.mode = "in_row"
            return True
        if token.kind == "end" and name in ("body", "caption", "col", "colgroup", "html"):
            return False
        return self.in_body(token)

    # select, template

    def in_select(self, token: Token) -> bool:
        name = token.name
        if token.kind == "text":
            self.insert_text(token.text.replace("\0", ""))
        elif token.kind == "comment":
            self.comment(token.text)
        elif token.kind == "start":
            if name == "html":
                return self.in_body(token)
            if name in ("option", "optgroup", "hr"):
                if self.top.name == "option":
                    self.stack.pop()
                if name != "option" and self.top.name == "optgroup":
                    self.stack.pop()
                self.insert(token)
                if name == "hr":
                    self.stack.pop()
            elif name in ("script", "template"):
                return self.in_head(token)
            elif name in ("select", "input", "keygen", "textarea"):
                if self.has("select"):
                    self.pop_until("select")
                    self.reset_mode()
                    return name != "select"
        elif token.kind == "end":
            if name == "optgroup":
                if self.top.name == "option" and len(self.stack) > 1 and self.stack[-2].name == "optgroup":
                    self.stack.pop()
                if self.top.name == "optgroup":
                    self.stack.pop()
            elif name == "option":
                if self.top.name == "option":
                    self.stack.pop()
            elif name == "select":
                if self.has("select"):
                    self.pop_until("select")
                    self.reset_mode()
            elif name == "template":
                return self.in_head(token)
        elif token.kind == "eof":
            return self.in_body(token)
        return False

    def in_select_in_table(self, token: Token) -> bool:
        if token.kind in ("start", "end") and token.name in TABLE_STRUCTURE | CELLS | {"caption"}:
            if token.kind == "start" or self.in_table_scope(token.name):
                self.pop_until("select")
                self.reset_mode()
                return True
            return False
        return self.in_select(token)

    def in_template(self, token: Token) -> bool:
        if token.kind == "start" and token.name not in HEAD_PARTS:
            fits = {"caption": "in_table", "colgroup": "in_table", "col": "in_column_group", "tr": "in_table_body", "td": "in_row", "th": "in_row"}
            self.templates[-1] = self.mode = "in_table" if token.name in TABLE_BODIES else fits.get(token.name, "in_body")
            return True
        if token.kind in ("start", "end"):
            return self.in_head(token) if token.kind == "start" or token.name == "template" else False
        if token.kind == "eof":
            if not self.has("template"):
                return False
            self.pop_until("template")
            self.clear_formatting()
            self.templates.pop()
            self.reset_mode()
            return True
        return self.in_body(token)

    # foreign content

    def insert_foreign(self, token: Token, space: str) -> None:
        names = {"definitionurl": "definitionURL"} if space == MATH else SVG_ATTRIBUTES
        attrs = {names.get(k, k): v for k, v in token.attrs.items()}
        name = SVG_NAMES.get(token.name, token.name) if space == SVG else token.name
        self.insert(Token("start", name, attrs), space)
        if token.closed:
            self.stack.pop()

    def foreign(self, token: Token) -> bool:
        if token.kind == "text":
            self.insert_text(token.text.replace("\0", "�"))
        elif token.kind == "comment":
            self.comment(token.text)
        elif token.kind == "start":
            breaks = token.name in BREAKOUT or token.name == "font" and not {"color", "face", "size"}.isdisjoint(token.attrs)
            if breaks:
                return self._leave_foreign(token)
            self.insert_foreign(token, self.adjusted().space)
        elif token.kind == "end":
            if token.name in ("br", "p"):
                return self._leave_foreign(token)
            for i in range(len(self.stack) - 1, 0, -1):
                node = self.stack[i]
                if node.space == HTML:
                    return getattr(self, self.mode)(token)
                if node.name.lower() == token.name:
                    del self.stack[i:]
                    return False
        return False

    def _leave_foreign(self, token: Token) -> bool:
        while len(self.stack) > 1 and not (self.top.space == HTML or self.top.integrates_html() or self.top.integrates_text()):
            self.stack.pop()
        if self.adjusted().space != HTML:  # a fragment inside svg or math has nothing to leave
            return getattr(self, self.mode)(token)
        return True


def _decoded(text: str) -> str:
    return entities.unescape(text) if "&" in text else text


def _lines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def _doctype(text: str) -> Token:
    """Name of a doctype, and (as ``closed``) whether it asks for quirks."""
    name, _, rest = text.strip().partition(" ")
    m = re.match(r"\s*public\s*(?:\"([^\"]*)\"|'([^']*)')\s*(\"|')?", rest, re.I)
    public = (m[1] or m[2] or "") if m else ""
    no_system = bool(m) and not m[3] and public.lower().startswith(("-//w3c//dtd html 4.01 frameset", "-//w3c//dtd html 4.01 transitional"))
    return Token("doctype", name.lower(), closed=name.lower() != "html" or bool(QUIRKY_PUBLIC.match(public)) or no_system)


def build(text: str, limits: Limits, context: str | None = None) -> Node:
    """Document node of ``text``; of a fragment inside a ``context`` element the node whose children are the fragment."""
    own = Builder(limits, context)
    if own.context and own.context.name in RAW | ESCAPABLE:
        own.insert_text(_lines(_decoded(text) if own.context.name in ESCAPABLE else text))
        return own.stack[0]
    at, n = 0, len(text)
    while at < n:
        if own.raw is not None:
            at = _raw_text(own, text, at)
            continue
        lt = n if own.plain else text.find("<", at)
        lt = n if lt < 0 else lt
        if lt > at:
            _text(own, text[at:lt] if own.plain else _decoded(text[at:lt]))
        at = lt if lt == n else _markup(own, text, lt)
    if own.raw is not None:
        _raw_text(own, text, n)
    own.process(Token("eof"))
    return own.stack[0] if context else own.root


def _text(own: Builder, value: str) -> None:
    value = _lines(value)
    if own.skip_line and value.startswith("\n"):
        value = value[1:]
    own.skip_line = False
    if value:
        own.process(Token("text", text=value))


def _raw_text(own: Builder, text: str, at: int) -> int:
    """Content of a raw text element, up to and with its end tag."""
    node, own.raw = own.raw, None
    end = re.compile(rf"</{node.name}(?=[\s/>])", re.I).search(text, at)
    stop = end.start() if end else len(text)
    value = _lines(text[at:stop])
    if node.name in ESCAPABLE:
        value = _lines(_decoded(value))
        value = value[1:] if node.name == "textarea" and value.startswith("\n") else value
    own.insert_text(value.replace("\0", "�"))
    own.stack.pop()
    gt = text.find(">", stop) if end else -1
    return len(text) if gt < 0 else gt + 1


def _markup(own: Builder, text: str, lt: int) -> int:
    """Handle what begins with "<" at ``lt``; the place after it."""
    n = len(text)
    following = text[lt + 1 : lt + 2]
    own.skip_line = False
    if text.startswith("<!--", lt):
        end = re.compile(r"(?<=<!--)-?>|--!?>").search(text, lt + 4)
        own.process(Token("comment", text=_lines(text[lt + 4 : end.start() if end else n])))
        return end.end() if end else n
    if text.startswith("<![CDATA[", lt) and own.stack and own.adjusted().space != HTML:
        end = text.find("]]>", lt)
        own.process(Token("text", text=_lines(text[lt + 9 : end if end >= 0 else n])))
        return end + 3 if end >= 0 else n
    if following in ("!", "?") or following == "/" and not text[lt + 2 : lt + 3].isalpha():
        end = text.find(">", lt)
        end = n if end < 0 else end
        if text[lt + 1 : lt + 9].lower() == "!doctype":
            own.process(_doctype(text[lt + 9 : end]))
        elif text[lt + 1 : lt + 3] != "/>" and (following != "/" or lt + 2 < n):
            own.process(Token("comment", text=_lines(text[lt + 1 + (following != "?") : end])))
        elif lt + 2 >= n:
            _text(own, "</")
        return end + 1
    m = _TAG.match(text, lt) if following == "/" or following.isascii() and following.isalpha() else None
    if not m:
        if following == "/" or following.isascii() and following.isalpha():
            return n  # the text ends within a tag
        _text(own, "<")
        return lt + 1
    name = m[2].lower().replace("\0", "�")
    if m[1]:
        own.process(Token("end", name))
        return m.end()
    attrs: dict[str, str] = {}
    if m[3]:
        for k, a, b, c in _ATTRIBUTE.findall(m[3]):
            attrs.setdefault(k.lower(), _lines(_decoded(a or b or c)))
    own.process(Token("start", name, attrs, closed=bool(m[4])))
    return m.end()
