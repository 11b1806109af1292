"""CSS selectors over a node table, lowered to joins and windows.

A selector list is parsed on the driver.  Every compound becomes a filter on the
element rows of the node table; every combinator one join within the document:
child on (doc, parent), descendant a window in document order (see ``structural``),
siblings on (doc, parent) with the sibling index.  ``:not()`` is an anti join, ``:is()`` and
``:has()`` semi joins; ``:nth-*`` tests a sibling index (a window where it counts
by type or ``of S``).  The subjects of a list are united distinct.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.columns import value_udf
from ..functions.errors import TextError
from . import structural

_IDENT = r"-?(?:[_a-zA-Z\u0080-\U0010ffff]|\\[^\n])(?:[-\w\u0080-\U0010ffff]|\\[^\n])*|--(?:[-\w\u0080-\U0010ffff]|\\[^\n])*"


#: Pseudo-classes without arguments that a node table can answer; a rule with another one is dropped, like any that does not parse.
PLAIN_PSEUDO = frozenset(
    "root first-child last-child only-child first-of-type last-of-type only-of-type empty link any-link checked disabled enabled required optional defined visited hover active focus target".split()
)


@dataclass
class Compound:
    """Simple selectors on one element; each is (kind, argument)."""

    parts: list[tuple[str, object]] = field(default_factory=list)


@dataclass
class Complex:
    """Compounds from left to right and the combinators between them; ``lead`` is a relative selector's first one."""

    compounds: list[Compound]
    combinators: list[str]
    lead: str | None = None


class _Parser:
    def __init__(self, text: str):
        self.t, self.at = text, 0

    def fail(self, message: str):
        raise TextError("selector", message, self.t, self.at)

    def space(self) -> bool:
        m = re.compile(r"(?:[ \t\r\n\f]|/\*.*?\*/)*", re.S).match(self.t, self.at)
        moved = m.end() > self.at
        self.at = m.end()
        return moved

    def take(self, pattern: str) -> str | None:
        m = re.compile(pattern).match(self.t, self.at)
        if m:
            self.at = m.end()
            return m[0]
        return None

    def ident(self) -> str:
        raw = self.take(_IDENT)
        if raw is None:
            self.fail("a name is expected")
        return unescape(raw)

    def list(self, relative: bool = False, end: str = "") -> list[Complex]:
        out = []
        while True:
            self.space()
            out.append(self.complex(relative))
            self.space()
            if self.take(","):
                continue
            if end and not self.t.startswith(end, self.at) or not end and self.at < len(self.t):
                self.fail("unexpected text")
            return out

    def complex(self, relative: bool) -> Complex:
        lead = None
        if relative:
            lead = self.take(r"[>+~]") or " "
            self.space()
        made = Complex([self.compound()], [], lead)
        while True:
            gap = self.space()
            sign = self.take(r"[>+~](?!=)")
            if sign:
                self.space()
            elif not gap or self.at >= len(self.t) or self.t[self.at] in ",)":
                return made
            made.combinators.append(sign or " ")
            made.compounds.append(self.compound())

    def compound(self) -> Compound:
        out = Compound()
        if self.take(r"\*"):
            out.parts.append(("universal", None))
        elif re.compile(_IDENT).match(self.t, self.at):
            out.parts.append(("type", self.ident()))
        while self.at < len(self.t):
            if self.take("#"):
                out.parts.append(("id", self.ident()))
            elif self.take(r"\."):
                out.parts.append(("class", self.ident()))
            elif self.take(r"\["):
                out.parts.append(self.attribute())
            elif self.take("::"):
                self.fail("pseudo-elements select no node of the table")
            elif self.take(":"):
                out.parts.append(self.pseudo())
            else:
                break
        if not out.parts:
            self.fail("a selector is expected")
        return out

    def attribute(self) -> tuple:
        self.space()
        name = self.ident()
        self.space()
        op = self.take(r"[~|^$*]?=")
        value, fold = None, False
        if op:
            self.space()
            quoted = self.take(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
            value = unescape(quoted[1:-1]) if quoted else self.ident()
            if self.space() and (flag := self.take(r"[iIsS]")):
                fold = flag in "iI"
                self.space()
        if not self.take(r"\]"):
            self.fail("']' is expected")
        return "attribute", (name, op, value, fold)

    def pseudo(self) -> tuple:
        name = self.ident().lower()
        if not self.take(r"\("):
            if name not in PLAIN_PSEUDO:
                self.fail(f":{name} is not supported")
            return "pseudo", (name, None)
        self.space()
        if name in ("not", "is", "where", "matches", "has"):
            arg: object = self.list(relative=name == "has", end=")")
        elif name.startswith("nth-"):
            raw = self.take(r"[^()]*?(?=\s+of\s|\))") or ""
            of = None
            if self.space() and self.take(r"of\s"):
                of = self.list(end=")")
            arg = (an_plus_b(raw), of)
        elif name == "lang":
            arg = [x.strip().strip("\"'") for x in (self.take(r"[^()]*") or "").split(",")]
        else:
            self.fail(f"unknown function :{name}()")
        self.space()
        if not self.take(r"\)"):
            self.fail("')' is expected")
        return "pseudo", (name, arg)


def unescape(text: str) -> str:
    """CSS escapes resolved."""

    def one(m: re.Match) -> str:
        if m[1]:
            code = int(m[1], 16)
            return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "�"
        return m[2]

    return re.sub(r"\\(?:([0-9a-fA-F]{1,6})[ \t\r\n\f]?|(.))", one, text, flags=re.S)


def an_plus_b(text: str) -> tuple[int, int]:
    """(a, b) of An+B notation."""
    raw = text.strip().lower()
    if raw in ("odd", "even"):
        return 2, int(raw == "odd")
    m = re.fullmatch(r"([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+)", raw)
    if not m:
        raise TextError("selector", "An+B is expected", text, 0)
    if m[4]:
        return 0, int(m[4])
    a = int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
    return a, int(f"{m[2]}{m[3]}") if m[3] else 0


def parse(text: str) -> list[Complex]:
    """Compile a selector list; raises ``TextError`` with its offset."""
    return _Parser(text).list()


def specificity(selectors: list[Complex]) -> tuple[int, int, int]:
    """The largest (ids, classes, types) of a list."""

    def of(c: Complex) -> tuple[int, int, int]:
        a = b = t = 0
        for compound in c.compounds:
            for kind, arg in compound.parts:
                if kind == "id":
                    a += 1
                elif kind in ("class", "attribute"):
                    b += 1
                elif kind == "type":
                    t += 1
                elif kind == "pseudo":
                    name, inner = arg
                    if name in ("not", "is", "matches", "has"):
                        x = specificity(inner)
                        a, b, t = a + x[0], b + x[1], t + x[2]
                    elif name != "where":
                        x = specificity(inner[1]) if name.startswith("nth-") and inner[1] else (0, 0, 0)
                        a, b, t = a + x[0], b + 1 + x[1], t + x[2]
        return a, b, t

    return max(map(of, selectors))


def node_table(df: DataFrame, id_cols: list[str], text_col: str, xml: bool = False, on_error: str = "row", context: str | None = None) -> DataFrame:
    """One row for each node of each document: the id columns, pre, post, parent, depth, sib_idx, sib_count, kind, name, attrs, text, above.

    A document that cannot be parsed (too deep, not well-formed) gives one row of
    kind ``error`` with the message as text; ``on_error="raise"`` fails the job.
    ``context`` names the element in which the texts are HTML fragments.
    """

    def run(text: str):
        try:
            found = markup.parse_xml(text) if xml else markup.parse_html(text, context=context)
        except TextError as e:
            if on_error == "raise":
                raise
            found = [{"pre": 0, "post": 1, "parent": None, "depth": 0, "sib_idx": 0, "sib_count": 0, "kind": "error", "name": e.code, "attrs": {}, "text": str(e), "above": 0}]
        return [n | {"attrs": list(n["attrs"].items())} for n in found]

    nodes = value_udf(run, markup.NODE_TYPE, text_col)
    return df.select(*id_cols, F.explode(nodes).alias("n")).select(*id_cols, "n.*")


class Matcher:
    """Matches selectors on the elements of a node table keyed by ``id_cols``."""

    def __init__(self, nodes: DataFrame, id_cols: list[str]):
        self.ids = id_cols
        self.elements = nodes.where("kind = 'element'")
        self.nodes = nodes
        self.key = [*id_cols, "pre"]

    def select(self, selector: str) -> DataFrame:
        """Element rows that a selector list matches, each once."""
        return self._list(parse(selector))

    def _list(self, selectors: list[Complex]) -> DataFrame:
        found = [self._complex(c) for c in selectors]
        return found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).dropDuplicates(self.key)

    def _complex(self, c: Complex) -> DataFrame:
        left = self._compound(c.compounds[0])
        for sign, compound in zip(c.combinators, c.compounds[1:], strict=True):
            left = self._step(left, sign, self._compound(compound))
        return left

    def _step(self, left: DataFrame, sign: str, right: DataFrame) -> DataFrame:
        """Rows of ``right`` with a row of ``left`` on the other side of the combinator."""
        if sign == " ":
            return structural.with_ancestor(right, left.select(*self.ids, "pre", "post"), self.ids)
        l = left.select(*self.ids, F.col("pre").alias("_pre"), F.col("parent").alias("_parent"), F.col("sib_idx").alias("_sib"))  # noqa: E741
        if sign == "~":
            l = l.groupBy(*self.ids, "_parent").agg(F.min("_sib").alias("_sib"))  # noqa: E741
        same = reduce(Column.__and__, [l[c].eqNullSafe(right[c]) for c in self.ids])
        link = {
            ">": lambda: right["parent"] == l["_pre"],
            "+": lambda: (right["parent"] == l["_parent"]) & (right["sib_idx"] == l["_sib"] + 1),
            "~": lambda: (right["parent"] == l["_parent"]) & (right["sib_idx"] > l["_sib"]),
        }[sign]()
        return right.join(l, same & link, "left_semi")

    def _compound(self, compound: Compound) -> DataFrame:
        out = self.elements
        for kind, arg in compound.parts:
            if kind == "pseudo":
                out = self._pseudo(out, *arg)
            else:
                out = out.where(self._simple(kind, arg))
        return out

    @staticmethod
    def _simple(kind: str, arg: object) -> Column:
        attrs = F.col("attrs")
        if kind == "universal":
            return F.lit(True)
        if kind == "type":
            return F.lower("name") == arg.lower()
        if kind == "id":
            return attrs["id"] == arg
        words = lambda a: F.split(F.trim(F.regexp_replace(a, r"[ \t\n\f\r]+", " ")), " ")
        if kind == "class":
            return F.array_contains(words(attrs["class"]), arg)
        name, op, value, fold = arg
        own = attrs[name.lower()]
        if op is None:
            return own.isNotNull()
        if fold:
            own, value = F.lower(own), value.lower()
        if op == "=":
            return own == value
        if op == "~=":
            return F.array_contains(words(own), value) if value and not re.search(r"\s", value) else F.lit(False)
        if op == "|=":
            return (own == value) | own.startswith(value + "-")
        if not value:
            return F.lit(False)
        return {"^=": own.startswith, "$=": own.endswith, "*=": own.contains}[op](value)

    def _pseudo(self, df: DataFrame, name: str, arg: object) -> DataFrame:
        children = self.nodes.where("kind in ('element', 'text', 'cdata') and not (kind <> 'element' and text = '')")
        simple = {
            "root": F.col("depth") == 1, "first-child": F.col("sib_idx") == 0, "last-child": F.col("sib_idx") == F.col("sib_count") - 1, "only-child": F.col("sib_count") == 1,
            "link": F.col("name").isin("a", "area") & F.col("attrs")["href"].isNotNull(), "any-link": F.col("name").isin("a", "area") & F.col("attrs")["href"].isNotNull(),
            "checked": F.col("attrs")["checked"].isNotNull() | F.col("attrs")["selected"].isNotNull(),
            "disabled": F.col("name").isin("button", "input", "select", "textarea", "optgroup", "option", "fieldset") & F.col("attrs")["disabled"].isNotNull(),
            "enabled": F.col("name").isin("button", "input", "select", "textarea", "optgroup", "option", "fieldset") & F.col("attrs")["disabled"].isNull(),
            "required": F.col("name").isin("input", "select", "textarea") & F.col("attrs")["required"].isNotNull(),
            "optional": F.col("name").isin("input", "select", "textarea") & F.col("attrs")["required"].isNull(),
            "defined": F.lit(True), "visited": F.lit(False), "hover": F.lit(False), "active": F.lit(False), "focus": F.lit(False), "target": F.lit(False),
        }
        if name in simple and arg is None:
            return df.where(simple[name])
        same = lambda other: other.select(*self.ids, F.col("parent").alias("pre")).distinct()
        if name == "empty":
            return self._kept(df, same(children), "left_anti")
        if name in ("is", "where", "matches"):
            return self._kept(df, self._list(arg).select(*self.key), "left_semi")
        if name == "not":
            return self._kept(df, self._list(arg).select(*self.key), "left_anti")
        if name == "has":
            found = [self._kept(df, self._has(df, c), "left_semi") for c in arg]
            return found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).dropDuplicates(self.key)
        if name in ("first-of-type", "last-of-type", "only-of-type"):
            index, count = self._counted(True, False), self._counted(True, True)
            out = df if name == "last-of-type" else self._kept(df, index.where("_n = 1").select(*self.key), "left_semi")
            return out if name == "first-of-type" else self._kept(out, count.where("_n = 1").select(*self.key), "left_semi")
        if name.startswith("nth-"):
            (a, b), of = arg
            last, typed = "last" in name, name.endswith("of-type")
            if of is None and not typed:
                n = F.col("sib_count") - F.col("sib_idx") if last else F.col("sib_idx") + 1
                return df.where(_nth(n, a, b))
            counted = self._counted(typed, last, self._list(of) if of else None)
            return self._kept(df, counted.where(_nth(F.col("_n"), a, b)).select(*self.key), "left_semi")
        if name == "lang":
            langs = self.elements.where(F.col("attrs")["lang"].isNotNull()).select(*self.ids, "pre", "post", F.lower(F.col("attrs")["lang"]).alias("_lang"))
            close = structural.nearest_ancestor(df.select(*self.key), langs, self.ids, "_lang", or_self=True)
            wanted = reduce(Column.__or__, [(F.col("_lang") == x.lower()) | F.col("_lang").startswith(x.lower() + "-") for x in arg])
            return self._kept(df, close.where(wanted).select(*self.key), "left_semi")
        raise TextError("selector", f":{name} is not supported")

    def _has(self, df: DataFrame, c: Complex) -> DataFrame:
        """Keys of rows of ``df`` from which the relative selector reaches an element."""
        if c.lead == " " and len(c.compounds) == 1:
            return structural.with_descendant(df.select(*self.key, "post"), self._compound(c.compounds[0]).select(*self.key), self.ids).select(*self.key)
        anchors = df.select(*self.ids, F.col("pre").alias("_a"), F.col("post").alias("_z"), F.col("parent").alias("_p"), F.col("sib_idx").alias("_s"))
        signs = [c.lead, *c.combinators]
        current, first = anchors, True
        for sign, compound in zip(signs, c.compounds, strict=True):
            right = self._compound(compound)
            if first:
                l = current.withColumnsRenamed({"_z": "_post", "_p": "_parent", "_s": "_sib"}).withColumn("_pre", F.col("_a"))  # noqa: E741
            else:
                l = current.withColumnsRenamed({"pre": "_pre", "post": "_post", "parent": "_parent", "sib_idx": "_sib"})  # noqa: E741
            link = {
                ">": "parent = _pre", " ": "pre > _pre and pre < _post",
                "+": "parent = _parent and sib_idx = _sib + 1", "~": "parent = _parent and sib_idx > _sib",
            }[sign]
            current = l.join(right.select(*self.ids, "pre", "post", "parent", "sib_idx"), self.ids).where(link).select(*self.ids, "_a", "pre", "post", "parent", "sib_idx").distinct()
            first = False
        return current.select(*self.ids, F.col("_a").alias("pre")).distinct()

    def _kept(self, df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        """Semi or anti join on the element's key; null ids equal each other."""
        other = keys.select(*[F.col(c).alias(f"_k_{c}") for c in self.key])
        return df.join(other, reduce(Column.__and__, [df[c].eqNullSafe(other[f"_k_{c}"]) for c in self.key]), how)

    def _counted(self, typed: bool, last: bool, among: DataFrame | None = None) -> DataFrame:
        """Element keys with _n, their place among siblings (of one type; among a selection)."""
        order = F.col("sib_idx").desc() if last else F.col("sib_idx")
        window = Window.partitionBy(*self.ids, "parent", *(["name"] if typed else [])).orderBy(order)
        return (self.elements if among is None else among).select(*self.key, F.row_number().over(window).alias("_n"))


def _nth(n: Column, a: int, b: int) -> Column:
    if a == 0:
        return n == b
    return (F.pmod(n - b, F.lit(abs(a))) == 0) & ((n >= b) if a > 0 else (n <= b))


def select_all(nodes: DataFrame, id_cols: list[str], selector: str) -> DataFrame:
    """Matching element rows, each once (order by the id columns and pre for document order)."""
    return Matcher(nodes, id_cols).select(selector)


def select_first(nodes: DataFrame, id_cols: list[str], selector: str) -> DataFrame:
    """The first matching element of each document."""
    first = select_all(nodes, id_cols, selector).groupBy(*id_cols).agg(F.min("pre").alias("pre"))
    return nodes.join(first, [*id_cols, "pre"], "left_semi")


def text_content(nodes: DataFrame, id_cols: list[str], elements: DataFrame) -> DataFrame:
    """(ids, pre, text): the texts under each element, in order."""
    texts = nodes.where("kind in ('text', 'cdata')").select(*id_cols, "pre", "text")
    return structural.text_within(elements.select(*id_cols, "pre", "post"), texts, id_cols)
