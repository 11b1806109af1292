"""Value grammars of CSS: definitions compiled to a graph, values matched with a memo and a step budget.

A definition (``<length-percentage>{1,2} || [ a && b ]# | none``) is read into nodes;
the types and properties it names are read in turn, each once, so the graph may
recurse, but only behind something that consumes a value (left recursion is refused
when the grammar is compiled).  A match walks the graph over component values and
remembers for each node and place all ends it can reach, best parse first: written
order for alternatives, as much as possible for the earlier parts of a sequence.
Work is counted in steps; an exhausted budget is an error, never "no match".
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from .errors import TextError

# --- component values ---

_ESCAPE = r"\\(?:[0-9a-fA-F]{1,6}[ \t\n\r\f]?|[^\n\r\f0-9a-fA-F])"
_NAME = rf"(?:[\w\-\u0080-\U0010ffff]|{_ESCAPE})"
_IDENT = rf"(?:--{_NAME}*|-?(?:[A-Za-z_\u0080-\U0010ffff]|{_ESCAPE}){_NAME}*)"
_NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_TOKEN = re.compile(
    rf"""(?P<space>(?:[ \t\n\r\f]|/\*.*?(?:\*/|\Z))+)
    |(?P<url>[uU][rR][lL]\([ \t\n\r\f]*(?!["' \t\n\r\f])(?P<address>(?:[^"'()\\ \t\n\r\f]|{_ESCAPE})*)[ \t\n\r\f]*\))
    |(?P<number>{_NUMBER})(?:(?P<percent>%)|(?P<unit>{_IDENT}))?
    |(?P<ident>{_IDENT})(?P<call>\()?
    |\#(?P<hash>{_NAME}+)
    |@(?P<at>{_IDENT})
    |"(?P<double>(?:[^"\\\n\r\f]|\\(?:\r\n|.))*)(?:"|\Z)
    |'(?P<single>(?:[^'\\\n\r\f]|\\(?:\r\n|.))*)(?:'|\Z)
    |(?P<sign>.)""",
    re.S | re.X,
)
_CLOSING = {"(": ")", "[": "]", "{": "}"}


def unescape(text: str) -> str:
    """Text of an identifier or string with its escapes resolved."""

    def one(m: re.Match) -> str:
        body = m[0][1:]
        if body in ("\n", "\r\n", "\r", "\f"):
            return ""
        if m[1]:
            code = int(m[1], 16)
            return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "\ufffd"
        return body

    return re.sub(r"\\(?:([0-9a-fA-F]{1,6})(?:\r\n|[ \t\n\r\f])?|\r\n|.)", one, text, flags=re.S) if "\\" in text else text


@dataclass(slots=True)
class Component:
    """A component value; a function or block has its own values in ``inner``."""

    kind: str
    text: str
    at: int
    number: float = 0.0
    unit: str = ""
    whole: bool = False
    spaced: bool = False
    inner: list[Component] | None = None


def components(text: str, depth: int = 64) -> list[Component]:
    """Component values of ``text``; white space and comments only mark the value after them."""
    stack: list[tuple[list[Component], str]] = [([], "")]
    at, n, spaced = 0, len(text), False
    while at < n:
        m = _TOKEN.match(text, at)
        kind = m.lastgroup
        start, at = at, m.end()
        out, closing = stack[-1]
        if m["space"] is not None:
            spaced = True
            continue
        if m["number"] is not None:
            kind = "percentage" if m["percent"] else "dimension" if m["unit"] else "number"
            made = Component(kind, m[0], start, float(m["number"]), unescape(m["unit"] or "").lower(), not re.search("[.eE]", m["number"]), spaced)
        elif m["url"] is not None:
            made = Component("url", unescape(m["address"]), start, spaced=spaced)
        elif m["ident"] is not None:
            made = Component("function" if m["call"] else "ident", unescape(m["ident"]), start, spaced=spaced, inner=[] if m["call"] else None)
        elif m["hash"] is not None:
            made = Component("hash", unescape(m["hash"]), start, spaced=spaced)
        elif m["at"] is not None:
            made = Component("at", unescape(m["at"]), start, spaced=spaced)
        elif kind in ("double", "single"):
            made = Component("string", unescape(m[kind]), start, spaced=spaced)
        else:
            sign = m["sign"]
            if sign == closing:
                stack.pop()
                spaced = False
                continue
            bad = sign in ")]}" or sign in "\"'"
            made = Component("bad" if bad else "block" if sign in _CLOSING else "sign", sign, start, spaced=spaced, inner=[] if sign in _CLOSING else None)
        out.append(made)
        spaced = False
        if made.inner is not None:
            if len(stack) > depth:
                raise TextError("limit", "nested too deeply", text, start)
            stack.append((made.inner, ")" if made.kind == "function" else _CLOSING[made.text]))
    return stack[0][0]


def number_text(value: float) -> str:
    """Shortest decimal of a number, without exponent where that is short."""
    if value == int(value) and abs(value) < 1e15:
        return str(int(value))
    found = format(round(value, 6), "f").rstrip("0").rstrip(".")
    return found if found not in ("0", "-0") else "0"


def written(values: list[Component]) -> str:
    """Canonical text of component values."""
    out: list[str] = []
    for i, v in enumerate(values):
        glued = v.kind == "sign" and v.text in ",;" or i and values[i - 1].kind == "sign" and values[i - 1].text in "!:@" or not out
        out.append(("" if glued else " ") + _one(v))
    return "".join(out)


def _one(v: Component) -> str:
    match v.kind:
        case "number" | "percentage" | "dimension":
            return number_text(v.number) + ("%" if v.kind == "percentage" else v.unit)
        case "string":
            return '"' + v.text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\a ") + '"'
        case "url":
            return 'url("' + v.text.replace("\\", "\\\\").replace('"', '\\"') + '")'
        case "hash":
            return "#" + v.text
        case "at":
            return "@" + v.text
        case "function":
            return f"{v.text.lower()}({written(v.inner)})"
        case "block":
            return v.text + written(v.inner) + _CLOSING[v.text]
    return v.text


# --- definitions ---


@dataclass(slots=True)
class Node:
    """A node of the graph; ``of`` holds places of other nodes."""

    kind: str
    text: str
    of: list[int] = field(default_factory=list)
    name: str = ""
    low: float = 0.0
    high: float = float("inf")


_NOTATION = re.compile(
    r"""\s*(?:(?P<property><'(?P<prop>[\w-]+)'>)|(?P<type><(?P<tname>[\w+-]+(?:\(\))?)(?:\s*\[\s*(?P<low>[^,\]]+?)\s*,\s*(?P<high>[^\]]+?)\s*\])?\s*>)
    |'(?P<quoted>[^'])'|(?P<call>-?-?[A-Za-z][\w-]*)\(|(?P<word>-?-?[A-Za-z0-9][\w-]*)|(?P<bar>\|\|)|(?P<and>&&)|(?P<count>\#?\{\s*\d+\s*(?:,\s*\d*\s*)?\}|[?*+\#!])|(?P<sign>[\[\]|(){},/:;=]))""",
    re.X,
)
_SUBSTITUTING = frozenset("var env attr if inherit ident random-item".split())
MATH = frozenset("calc min max clamp round mod rem sin cos tan asin acos atan atan2 pow sqrt hypot log exp abs sign progress".split())
WIDE = frozenset("initial inherit unset revert revert-layer revert-rule".split())
#: Units by type, as factors of the canonical unit (none for relative ones).
UNITS_OF: dict[str, dict[str, float | None]] = {
    "length": {"px": 1.0, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4, "q": 96 / 101.6, "pt": 96 / 72, "pc": 16.0} | dict.fromkeys(
        "em rem ex rex cap rcap ch rch ic ric lh rlh vw vh vi vb vmin vmax svw svh svi svb svmin svmax lvw lvh lvi lvb lvmin lvmax dvw dvh dvi dvb dvmin dvmax cqw cqh cqi cqb cqmin cqmax".split()
    ),
    "angle": {"deg": 1.0, "grad": 0.9, "rad": 57.29577951308232, "turn": 360.0},
    "time": {"s": 1.0, "ms": 0.001},
    "frequency": {"hz": 1.0, "khz": 1000.0},
    "resolution": {"dppx": 1.0, "x": 1.0, "dpi": 1 / 96, "dpcm": 2.54 / 96},
    "flex": {"fr": 1.0},
}
_NUMERIC = frozenset(("integer", "number", "percentage", *UNITS_OF))
_AN_PLUS_B = re.compile(r"(?:odd|even|[+-]?\d+|[+-]?\d*n(?:\s*[+-]\s*\d+)?)\Z", re.I)


def _native(name: str) -> bool:
    return name in _NUMERIC or name in _TERMINALS or name in ("any-value", "declaration-value", "declaration-list", "an+b", "ratio")


#: Types of one component value.
_TERMINALS: dict[str, Callable[[Component], bool]] = {
    "dimension": lambda v: v.kind == "dimension",
    "zero": lambda v: v.kind == "number" and v.number == 0,
    "string": lambda v: v.kind == "string",
    "url": lambda v: v.kind == "url" or v.kind == "function" and v.text.lower() in ("url", "src") and bool(v.inner) and v.inner[0].kind == "string",
    "ident": lambda v: v.kind == "ident",
    "custom-ident": lambda v: v.kind == "ident" and v.text.lower() not in WIDE and v.text.lower() != "default",
    "dashed-ident": lambda v: v.kind == "ident" and v.text.startswith("--"),
    "hex-color": lambda v: v.kind == "hash" and bool(re.fullmatch("[0-9a-fA-F]{3,4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8}", v.text)),
    "hash-token": lambda v: v.kind == "hash",
    "ident-token": lambda v: v.kind == "ident",
    "string-token": lambda v: v.kind == "string",
    "number-token": lambda v: v.kind == "number",
    "dimension-token": lambda v: v.kind == "dimension",
    "percentage-token": lambda v: v.kind == "percentage",
    "function-token": lambda v: v.kind == "function",
    "at-keyword-token": lambda v: v.kind == "at",
}


class Grammar:
    """A compiled definition.  ``types`` and ``properties`` give the definitions of the names it uses."""

    def __init__(self, definition: str, types: dict[str, str] | None = None, properties: dict[str, str] | None = None, max_nodes: int = 20_000):
        self.nodes: list[Node] = []
        self.types, self.properties, self.max_nodes = types or {}, properties or {}, max_nodes
        self._known: dict[tuple, int] = {}
        self._waiting: list[tuple[int, str]] = []
        self.root = self._read(definition)
        while self._waiting:
            place, text = self._waiting.pop()
            self.nodes[place].of = [self._read(text)]
        self._refuse_left_recursion()
        self.can_be_empty = [i in self._empty for i in range(len(self.nodes))]

    # reading

    def _add(self, kind: str, text: str, of: list[int] | None = None, **more) -> int:
        if len(self.nodes) >= self.max_nodes:
            raise TextError("limit", "grammar has too many nodes", text, 0)
        self.nodes.append(Node(kind, text, of or [], **more))
        return len(self.nodes) - 1

    def _read(self, text: str) -> int:
        tokens, at = [], 0
        stripped = text.rstrip()
        while at < len(stripped):
            m = _NOTATION.match(stripped, at)
            if not m:
                raise TextError("grammar", "not a definition", text, at)
            tokens.append(m)
            at = m.end()
        reader = _Reader(self, text, tokens)
        found = reader.alternatives()
        if reader.at < len(tokens):
            reader.fail("unexpected text")
        return found

    def _named(self, key: tuple, text: str, definition: str | None, **more) -> int:
        """Node of a type or property; its definition is read once, after the text that names it."""
        if key not in self._known:
            if definition is None:
                raise TextError("reference", f"{text} is not defined", text, 0)
            self._known[key] = self._add("named", text, name=key[0], **more)
            self._waiting.append((self._known[key], definition))
        return self._known[key]

    # analysis

    def _refuse_left_recursion(self) -> None:
        empty: set[int] = set()
        grew = True
        while grew:
            grew = False
            for i, node in enumerate(self.nodes):
                if i not in empty and self._is_empty(node, empty):
                    empty.add(i)
                    grew = True
        self._empty = empty
        state: dict[int, int] = {}
        for start in range(len(self.nodes)):
            pending: list[tuple[int, bool]] = [(start, False)]
            while pending:
                i, leave = pending.pop()
                if leave:
                    state[i] = 2
                elif i not in state:
                    state[i] = 1
                    pending.append((i, True))
                    for j in self._first_of(self.nodes[i]):
                        if state.get(j) == 1:
                            raise TextError("left-recursion", f"{self.nodes[j].text} can match itself without consuming a value", self.nodes[j].text, 0)
                        pending.append((j, False))

    @staticmethod
    def _is_empty(node: Node, empty: set[int]) -> bool:
        match node.kind:
            case "sequence" | "all" | "named":
                return bool(node.of) and all(i in empty for i in node.of)
            case "one" | "some":
                return any(i in empty for i in node.of)
            case "times":
                return node.low == 0 or node.of[0] in empty
        return False

    def _first_of(self, node: Node) -> list[int]:
        if node.kind in ("function", "block"):
            return []
        if node.kind != "sequence":
            return node.of
        out = []
        for i in node.of:
            out.append(i)
            if i not in self._empty:
                break
        return out

    def match(self, value: str | list[Component], budget: int = 200_000) -> Match:
        """Match all of a value."""
        return _Matcher(self, budget).run(value)


class _Reader:
    """Recursive descent over the notation; each rank of combinators binds tighter than the one before."""

    def __init__(self, grammar: Grammar, text: str, tokens: list[re.Match]):
        self.grammar, self.text, self.tokens, self.at, self.depth = grammar, text, tokens, 0, 0

    def fail(self, message: str):
        at = self.tokens[self.at].start() if self.at < len(self.tokens) else len(self.text)
        raise TextError("grammar", message, self.text, at)

    def peek(self, *groups: str) -> re.Match | None:
        if self.at < len(self.tokens):
            m = self.tokens[self.at]
            if any(m[g] is not None for g in groups):
                return m
        return None

    def sign(self, *signs: str) -> bool:
        m = self.peek("sign")
        return m is not None and m["sign"] in signs

    def span(self, first: int) -> str:
        return self.text[self.tokens[first].start() : self.tokens[self.at - 1].end()].strip()

    def _joined(self, part: Callable[[], int], kind: str, more: Callable[[], bool]) -> int:
        first = self.at
        of = [part()]
        while more():
            self.at += 1
            of.append(part())
        if kind in ("all", "some") and len(of) > 64:
            self.fail("more than 64 members")
        nodes = self.grammar.nodes
        if kind == "one" and len(of) > 16 and all(nodes[i].kind == "keyword" for i in of):  # a long list of keywords is looked up at once
            return self.grammar._add("keywords", self.span(first), name=" ".join(nodes[i].name for i in of))
        return of[0] if len(of) == 1 else self.grammar._add(kind, self.span(first), of)

    def alternatives(self) -> int:
        self.depth += 1
        if self.depth > 100:
            raise TextError("limit", "groups nested too deeply", self.text, 0)
        out = self._joined(self.somes, "one", lambda: self.sign("|"))
        self.depth -= 1
        return out

    def somes(self) -> int:
        return self._joined(self.alls, "some", lambda: self.peek("bar") is not None)

    def alls(self) -> int:
        return self._joined(self.sequence, "all", lambda: self.peek("and") is not None)

    def sequence(self) -> int:
        first, of = self.at, []
        while self.at < len(self.tokens) and not (self.sign("|", "]", ")", "}") or self.peek("bar", "and")):
            of.append(self.counted())
        if not of:
            self.fail("a component is missing")
        return of[0] if len(of) == 1 else self.grammar._add("sequence", self.span(first), of)

    def counted(self) -> int:
        first = self.at
        grouped = self.sign("[")
        out = self.component()
        while m := self.peek("count"):
            self.at += 1
            sign = m["count"]
            if sign == "!":
                if not grouped:
                    self.fail("only a group takes '!'")
                out = self.grammar._add("needed", self.span(first), [out])
                continue
            comma, low, high = "#" in sign, 0.0, float("inf")
            if "{" in sign:
                bounds = re.findall(r"\d+", sign)
                low = float(bounds[0])
                high = low if "," not in sign else float(bounds[1]) if len(bounds) > 1 else high
                if low > high or low > 65_535:
                    self.fail("counts out of order")
            elif sign in "+#":
                low = 1.0
            elif sign == "?":
                high = 1.0
            if sign == "#" and (brace := self.peek("count")) and brace["count"].startswith("{"):
                continue
            out = self.grammar._add("times", self.span(first), [out], name="," if comma else "", low=low, high=high)
        return out

    def component(self) -> int:
        m, add = self.tokens[self.at], self.grammar._add
        first = self.at
        self.at += 1
        if m["property"]:
            return self.grammar._named(("property", m["prop"]), m["property"], self.grammar.properties.get(m["prop"]))
        if m["type"]:
            name, bounds = m["tname"], {}
            if m["low"] is not None:
                bounds = {"low": self._bound(name, m["low"]), "high": self._bound(name, m["high"])}
                if bounds["low"] > bounds["high"]:
                    self.fail("range is empty")
            if _native(name):
                if bounds and name not in _NUMERIC:
                    self.fail(f"<{name}> takes no range")
                return add("type", m["type"].strip(), name=name, **(bounds or {"low": float("-inf")}))
            definition = self.grammar.types.get(name)
            if bounds and definition is not None:
                definition = re.sub(r"<(\w+)>", lambda t: f"<{t[1]} [{m['low']},{m['high']}]>" if t[1] in _NUMERIC and self._fits(t[1], m["low"], m["high"]) else t[0], definition)
            return self.grammar._named(("type", name, *bounds.values()), m["type"].strip(), definition)
        if m["quoted"]:
            if m["quoted"] == "[":
                return self._block("[", first)
            return add("sign", m[0].strip(), name=m["quoted"])
        if m["call"]:
            inner = [] if self.sign(")") else [self.alternatives()]
            self._close(")")
            return add("function", self.span(first), inner, name=m["call"].lower())
        if m["word"]:
            return add("keyword", m["word"], name=m["word"].lower())
        if m["sign"] in ("{", "("):
            return self._block(m["sign"], first)
        if m["sign"] == "[":
            found = self.alternatives()
            self._close("]")
            return found
        if m["sign"] in (",", "/", ":", ";", "="):
            return add("sign", m["sign"], name=m["sign"])
        self.at = first
        self.fail("unexpected text")

    def _block(self, opening: str, first: int) -> int:
        ended = (lambda: (q := self.peek("quoted")) is not None and q["quoted"] == "]") if opening == "[" else (lambda: self.sign(_CLOSING[opening]))
        inner = [] if ended() else [self.alternatives() if opening != "[" else self._until(ended)]
        if not ended():
            self.fail("a block is not closed")
        self.at += 1
        return self.grammar._add("block", self.span(first), inner, name=opening)

    def _until(self, ended: Callable[[], bool]) -> int:
        first, of = self.at, []
        while self.at < len(self.tokens) and not ended():
            of.append(self.counted())
        return of[0] if len(of) == 1 else self.grammar._add("sequence", self.span(first), of)

    def _close(self, sign: str) -> None:
        if not self.sign(sign):
            self.fail(f"{sign!r} is expected")
        self.at += 1

    @staticmethod
    def _fits(name: str, *bounds: str) -> bool:
        units = {re.sub(r"^[-+.\d−∞]+", "", b.strip()) for b in bounds} - {""}
        return not units or name in UNITS_OF and all(u.lower() in UNITS_OF[name] for u in units) or name == "percentage" and units == {"%"}

    def _bound(self, name: str, text: str) -> float:
        text = text.replace("−", "-")
        if text in ("∞", "+∞", "-∞"):
            return float("-inf") if text[0] == "-" else float("inf")
        m = re.fullmatch(r"([+-]?(?:\d+\.?\d*|\.\d+))(%|[a-zA-Z]*)", text)
        if not m or not (self._fits(name, text) or not _native(name)):
            self.at -= 1
            self.fail("not a bound of this type")
        return float(m[1]) * (next((u[m[2].lower()] for u in UNITS_OF.values() if m[2].lower() in u), None) or 1.0)


# --- matching ---

#: A parse: canonical text, and (property or type, text) of every name that matched in it.
Parse = tuple[str, tuple[tuple[str, str], ...]]
_NOTHING: Parse = ("", ())


@dataclass(frozen=True)
class Match:
    """``status`` is match, no-match, pending (holds a substitution function) or empty.

    ``branch`` is the text of the alternative that matched, ``text`` the value in
    canonical form, ``names`` the (name, text) pairs matched in it, ``offset`` of a value
    that does not match the place where no parse gets further.
    """

    status: str
    branch: str | None = None
    text: str | None = None
    names: tuple[tuple[str, str], ...] = ()
    offset: int | None = None
    steps: int = 0


def substitutes(values: list[Component]) -> bool:
    """Whether a substitution function (``var()``, ``env()``, ...) stands anywhere in the values."""
    return any(v.kind == "function" and v.text.lower() in _SUBSTITUTING or v.inner and substitutes(v.inner) for v in values)


def _join(a: Parse, b: Parse, between: str = " ") -> Parse:
    if not a[0] or not b[0]:
        return (a[0] or b[0], a[1] + b[1])
    return a[0] + between + b[0], a[1] + b[1]


class _Matcher:
    def __init__(self, grammar: Grammar, budget: int):
        self.grammar, self.nodes, self.budget = grammar, grammar.nodes, budget
        self.memo: dict[tuple, dict[int, Parse]] = {}
        self.steps = self.depth = self.furthest = 0

    def run(self, value: str | list[Component]) -> Match:
        values = components(value) if isinstance(value, str) else value
        if substitutes(values):
            return Match("pending", text=written(values))
        self.top = values
        names: list[Node] = []
        root = self.grammar.root
        while self.nodes[root].kind == "named":  # a grammar that is one name has the branches of that name
            names.append(self.nodes[root])
            root = self.nodes[root].of[0]
        branches = self.nodes[root].of if self.nodes[root].kind == "one" else [root]
        for branch in branches:
            found = self.ends(branch, values, 0)
            if len(values) in found:
                text, inner = found[len(values)]
                outer = tuple((n.text[2:-2], text) for n in reversed(names) if n.name == "property")
                return Match("match", self.nodes[branch].text, text, inner + outer, steps=self.steps)
        at = values[self.furthest].at if self.furthest < len(values) else None
        return Match("no-match", offset=at, steps=self.steps)

    def step(self) -> None:
        self.steps += 1
        if self.steps > self.budget:
            raise TextError("limit", f"more than {self.budget} steps")

    def ends(self, i: int, values: list[Component], at: int) -> dict[int, Parse]:
        """Ends that node ``i`` reaches from ``at``, with the best parse of each; the best end comes first."""
        key = (i, id(values), at)
        if key not in self.memo:
            self.step()
            self.depth += 1
            if self.depth > 200:
                raise TextError("limit", "values nested too deeply for the grammar")
            self.memo[key] = getattr(self, "_" + self.nodes[i].kind)(self.nodes[i], values, at)
            self.depth -= 1
        return self.memo[key]

    def _sequence(self, node: Node, values: list[Component], at: int) -> dict[int, Parse]:
        """Parts in order.  A comma between parts is left out together with a part that is absent beside it."""
        last = len(node.of) - 1
        states: dict[tuple, Parse] = {(at, False, False): _NOTHING}
        for place, i in enumerate(node.of):
            part, reached = self.nodes[i], {}
            optional_comma = part.kind == "sign" and part.name == "," and 0 < place < last
            for (p, wants, any_part), parse in states.items():
                self.step()
                if optional_comma:
                    reached.setdefault((p, any_part, any_part), parse)
                    continue
                if wants:
                    if i in self.grammar._empty:
                        reached.setdefault((p, True, any_part), parse)
                    comma = p < len(values) and values[p].kind == "sign" and values[p].text == ","
                    if not comma:
                        self.furthest = max(self.furthest, p) if values is self.top else self.furthest
                        continue
                    for e, found in self.ends(i, values, p + 1).items():
                        if e > p + 1:
                            reached.setdefault((e, False, True), _join(parse, found, ", "))
                    continue
                for e, found in self.ends(i, values, p).items():
                    reached.setdefault((e, False, any_part or e > p), _join(parse, found, " "))
            states = reached
        out: dict[int, Parse] = {}
        for (p, _, _), parse in states.items():
            out.setdefault(p, parse)
        return out

    def _one(self, node: Node, values: list[Component], at: int) -> dict[int, Parse]:
        out: dict[int, Parse] = {}
        for i in node.of:
            for e, parse in self.ends(i, values, at).items():
                out.setdefault(e, parse)
        return out

    def _all(self, node: Node, values: list[Component], at: int) -> dict[int, Parse]:
        return self._members(node, values, at, every=True)

    def _some(self, node: Node, values: list[Component], at: int) -> dict[int, Parse]:
        return self._members(node, values, at, every=False)

    def _members(self, node: Node, values: list[Component], at: int, every: bool) -> dict[int, Parse]:
        """Members in any order; their parses are joined in the order of the grammar."""
        found: dict[tuple[int, int], dict[int, dict[int, Parse]]] = {}

        def rest(p: int, used: int) -> dict[int, dict[int, Parse]]:
            if (p, used) in found:
                return found[p, used]
            self.step()
            out: dict[int, dict[int, Parse]] = {}
            left = [m for m in range(len(node.of)) if not used >> m & 1]
            for m in left:
                for e, parse in self.ends(node.of[m], values, p).items():
                    if e > p:
                        for end, more in rest(e, used | 1 << m).items():
                            out.setdefault(end, {m: parse, **more})
            absent = [node.of[m] in self.grammar._empty for m in left]
            if all(absent) if every else used or any(absent):
                out.setdefault(p, {})
            found[p, used] = out
            return out

        joined = {}
        for end, members in rest(at, 0).items():
            parse = _NOTHING
            for m in sorted(members):
                parse = _join(parse, members[m])
            joined[end] = parse
        return joined

    def _times(self, node: Node, values: list[Component], at: int) -> dict[int, Parse]:
        """Repetitions by breadth: a place reached once with enough repetitions is not expanded again."""
        child, between = node.of[0], ", " if node.name else " "
        out: dict[int, list] = {at: []} if node.low == 0 else {}
        reached: dict[int, list] = {at: []}
        count = 0
        while reached and count < node.high:
            following: dict[int, list] = {}
            for p, parses in reached.items():
                self.step()
                start = p
                if node.name and count:
                    if p >= len(values) or values[p].kind != "sign" or values[p].text != ",":
                        self.furthest = max(self.furthest, p) if values is self.top else self.furthest
                        continue
                    start += 1
                for e, parse in self.ends(child, values, start).items():
                    if e > start:
                        following.setdefault(e, [parses, parse])
                    elif count < node.low and start == p:
                        following.setdefault(p, parses)
            count += 1
            if count >= node.low:
                reached = {e: v for e, v in following.items() if e not in out}
                out |= reached
            else:
                reached = following
        return {e: self._flat(out[e], between) for e in sorted(out, reverse=True)}

    @staticmethod
    def _flat(chain: list, between: str) -> Parse:
        parses = []
        while chain:
            chain, parse = chain
            parses.append(parse)
        return between.join(p[0] for p in reversed(parses) if p[0]), tuple(n for p in reversed(parses) for n in p[1])

    def _needed(self, node: Node, values: list[Component], at: int) -> dict[int, Parse]:
        return {e: parse for e, parse in self.ends(node.of[0], values, at).items() if e > at}

    def _named(self, node: Node, values: list[Component], at: int) -> dict[int, Parse]:
        name = node.text[1:-1].strip("'")
        own = node.name == "property"
        return {e: (text, (*names, (name, text)) if own else names) for e, (text, names) in self.ends(node.of[0], values, at).items()}

    def _at(self, values: list[Component], at: int) -> Component | None:
        if values is self.top:
            self.furthest = max(self.furthest, at)
        return values[at] if at < len(values) else None

    def _keyword(self, node: Node, values: list[Component], at: int) -> dict[int, Parse]:
        v = self._at(values, at)
        return {at + 1: (node.name, ())} if v and v.kind == "ident" and v.text.lower() == node.name else {}

    def _keywords(self, node: Node, values: list[Component], at: int) -> dict[int, Parse]:
        v = self._at(values, at)
        return {at + 1: (v.text.lower(), ())} if v and v.kind == "ident" and f" {v.text.lower()} " in f" {node.name} " else {}

    def _sign(self, node: Node, values: list[Component], at: int) -> dict[int, Parse]:
        v = self._at(values, at)
        return {at + 1: (node.name, ())} if v and v.kind == "sign" and v.text == node.name else {}

    def _function(self, node: Node, values: list[Component], at: int) -> dict[int, Parse]:
        v = self._at(values, at)
        if not v or v.kind != "function" or v.text.lower() != node.name:
            return {}
        inner = self._within(node, v)
        return {} if inner is None else {at + 1: (f"{node.name}({inner[0]})", inner[1])}

    def _block(self, node: Node, values: list[Component], at: int) -> dict[int, Parse]:
        v = self._at(values, at)
        if not v or v.kind != "block" or v.text != node.name:
            return {}
        inner = self._within(node, v)
        return {} if inner is None else {at + 1: (f"{node.name}{inner[0]}{_CLOSING[node.name]}", inner[1])}

    def _within(self, node: Node, v: Component) -> Parse | None:
        if not node.of:
            return None if v.inner else _NOTHING
        return self.ends(node.of[0], v.inner, 0).get(len(v.inner))

    def _type(self, node: Node, values: list[Component], at: int) -> dict[int, Parse]:
        v = self._at(values, at)
        name = node.name
        if name == "declaration-list":
            return {len(values): (written(values[at:]), ())}
        if v is None:
            return {}
        if name in ("any-value", "declaration-value"):
            return self._any(name, values, at)
        if name == "an+b":
            found = {}
            for e in range(min(len(values), at + 5), at, -1):
                if _AN_PLUS_B.match("".join(("" if not x.spaced or j == 0 else " ") + _one_raw(x) for j, x in enumerate(values[at:e]))):
                    found[e] = (written(values[at:e]), ())
            return found
        if name == "ratio":
            return self._ratio(values, at)
        if name in _NUMERIC:
            text = self._numeric(node, v)
            return {} if text is None else {at + 1: (text, ())}
        return {at + 1: (_one(v), ())} if _TERMINALS[name](v) else {}

    def _any(self, name: str, values: list[Component], at: int) -> dict[int, Parse]:
        e = at
        while e < len(values) and not _bad(values[e]) and not (name == "declaration-value" and values[e].kind == "sign" and values[e].text in ";!"):
            e += 1
            self.step()
        return {end: (written(values[at:end]), ()) for end in range(e, at, -1)}

    def _ratio(self, values: list[Component], at: int) -> dict[int, Parse]:
        part = Node("type", "<number [0,∞]>", name="number")
        first = self._numeric(part, values[at])
        if first is None:
            return {}
        out = {}
        if at + 2 < len(values) and values[at + 1].text == "/" and (second := self._numeric(part, values[at + 2])) is not None:
            out[at + 3] = (f"{first} / {second}", ())
        return out | {at + 1: (f"{first} / 1", ())}

    @staticmethod
    def _numeric(node: Node, v: Component) -> str | None:
        """Canonical text of a number of the node's type within its range; math functions match by name."""
        name = node.name
        if v.kind == "function" and v.text.lower() in MATH:
            return _one(v)
        if v.kind == "number" and (name == "number" or name == "integer" and v.whole):
            size = v.number
        elif v.kind == "percentage" and name == "percentage":
            size = v.number
        elif v.kind == "number" and v.number == 0 and name == "length":
            return "0px" if node.low <= 0 <= node.high else None
        elif v.kind == "dimension" and v.unit in UNITS_OF.get(name, ()):
            factor = UNITS_OF[name][v.unit]
            if factor is None:  # a relative unit has some value of its sign
                inside = node.high >= 0 if v.number == 0 else node.high > 0 if v.number > 0 else node.low < 0
                return _one(v) if inside else None
            size = v.number * factor
        else:
            return None
        return _one(v) if node.low <= size <= node.high else None


def _bad(v: Component) -> bool:
    return v.kind == "bad" or bool(v.inner) and any(map(_bad, v.inner))


def _one_raw(v: Component) -> str:
    return v.text
