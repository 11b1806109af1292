"""CSS: style sheets to rule rows, media conditions, and the cascade as a window.

``compile_sheet`` reads a sheet on the driver into declarations.  Rules meet
elements by their selectors (see ``selectors``: joins on the node table); the
winner of each (document, element, property) is rank 1 of a window over origin
and importance, inline style, layer, specificity and order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import css_properties
from ..functions.css_grammar import WIDE
from ..functions.errors import TextError
from . import rule_index, selectors, structural

#: Properties that inherit (those the computed subset knows).
INHERITED = frozenset("color cursor direction font-family font-size font-style font-weight letter-spacing line-height list-style-type quotes text-align text-indent text-transform visibility white-space word-spacing".split())
#: Initial values of the same subset.
INITIAL = {"color": "canvastext", "display": "inline", "font-size": "medium", "font-weight": "normal", "font-style": "normal", "margin-top": "0", "margin-right": "0", "margin-bottom": "0", "margin-left": "0", "text-align": "start", "visibility": "visible", "background-color": "transparent"}


@dataclass(frozen=True)
class Declaration:
    """One declaration of one rule; ``layer`` is None outside layers."""

    selector: str
    prop: str
    value: str
    important: bool
    layer: str | None
    order: int
    media: tuple[str, ...]


def _strip(css: str) -> str:
    return re.sub(r"/\*.*?(?:\*/|\Z)", " ", css, flags=re.S)


def _blocks(css: str) -> Iterator[tuple[str, str | None, int]]:
    """(prelude, body, offset) of each rule at the top level; body is None for statements ended by ';'."""
    at, begin, n = 0, 0, len(css)
    while at < n:
        c = css[at]
        if c in "\"'":
            at = _string(css, at)
        elif c == ";":
            yield css[begin:at].strip(), None, begin
            at += 1
            begin = at
        elif c == "{":
            depth, i = 1, at + 1
            while i < n and depth:
                if css[i] in "\"'":
                    i = _string(css, i)
                    continue
                depth += (css[i] == "{") - (css[i] == "}")
                i += 1
            yield css[begin:at].strip(), css[at + 1 : i - 1 if not depth else i], begin
            at = begin = i
        else:
            at += 1
    if css[begin:].strip():
        yield css[begin:].strip(), None, begin


def _string(css: str, at: int) -> int:
    quote, i = css[at], at + 1
    while i < len(css) and css[i] != quote and css[i] != "\n":
        i += 2 if css[i] == "\\" else 1
    return i + 1


def declarations(body: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of a declaration block, shorthands of the box expanded."""
    out = []
    for part in re.split(r";(?=(?:[^\"'()]|\"[^\"]*\"|'[^']*'|\([^()]*\))*$)", body):
        name, colon, value = part.partition(":")
        if not colon:
            continue
        name, value = name.strip(), value.strip()
        name = name if name.startswith("--") else name.lower()
        m = re.search(r"\s*!\s*important\s*$", value, re.I)
        value = value[: m.start()] if m else value
        if not value or not re.fullmatch(r"-?-?[\w-]+", name):
            continue
        out += [(p, v, bool(m)) for p, v in expand(name, value)]
    return out


def expand(name: str, value: str) -> list[tuple[str, str]]:
    """Longhands of margin, padding, inset and overflow; other properties as they are."""
    sides = ("top", "right", "bottom", "left")
    if name in ("margin", "padding", "inset"):
        parts = re.findall(r"[^\s()]+(?:\([^()]*\))?", value)
        if 1 <= len(parts) <= 4:
            t = parts[0]
            r = parts[1] if len(parts) > 1 else t
            b = parts[2] if len(parts) > 2 else t
            left = parts[3] if len(parts) > 3 else r
            return [(s if name == "inset" else f"{name}-{s}", v) for s, v in zip(sides, (t, r, b, left), strict=True)]
    if name == "overflow":
        parts = value.split()
        return [("overflow-x", parts[0]), ("overflow-y", parts[-1])]
    return [(name, value)]


def _layer_order(named: list[str]) -> list[str]:
    """Layers from the weakest: sub-layers by first mention, then the rules of the layer that holds them."""
    out: list[str] = []

    def visit(parent: str | None) -> None:
        for name in named:
            if name.rpartition(".")[0] == (parent or ""):
                visit(name)
                out.append(name)

    visit(None)
    return out


def compile_sheet(css: str) -> tuple[list[Declaration], list[str]]:
    """Declarations of a sheet in order, and its layers from the weakest.

    Nested rules, ``@media``, ``@supports`` (tested at once) and ``@layer`` are
    resolved; a rule whose selector does not parse is dropped, as the standard has it.
    """
    out: list[Declaration] = []
    layers: list[str] = []

    def declare_layer(name: str) -> None:
        parts = name.split(".")
        for i in range(1, len(parts) + 1):
            if (n := ".".join(parts[:i])) not in layers:
                layers.append(n)

    def walk(text: str, layer: str | None, media: tuple[str, ...], parent: str | None) -> None:
        for prelude, body, _ in _blocks(text):
            if prelude.startswith("@"):
                name, _, rest = prelude[1:].partition(" ")
                name, rest = name.lower(), rest.strip()
                if name == "layer":
                    for one in rest.split(",") if rest else [f"anonymous-{len(layers)}"]:
                        full = f"{layer}.{one.strip()}" if layer else one.strip()
                        declare_layer(full)
                    if body is not None:
                        walk(body, full, media, parent)
                elif name == "media" and body is not None:
                    walk(body, layer, (*media, rest), parent)
                elif name == "supports" and body is not None and supports(rest):
                    walk(body, layer, media, parent)
                continue
            if body is None:
                continue
            text_of = prelude if parent is None else ", ".join(s.replace("&", f":is({parent})") if "&" in s else f":is({parent}) {s}" for s in map(str.strip, prelude.split(",")))
            try:
                selectors.parse(text_of)
            except TextError:
                continue
            flat, nested = [], []
            for head, inner, _ in _blocks(body):
                (flat if inner is None else nested).append(head if inner is None else f"{head} {{{inner}}}")
            for prop, value, important in declarations(";".join(flat)):
                out.append(Declaration(text_of, prop, value, important, layer, len(out), media))
            if nested:
                walk("\n".join(nested), layer, media, text_of)

    walk(_strip(css), None, (), None)
    return out, _layer_order(layers)


def sheet_errors(css: str) -> list[tuple[str, str]]:
    """(code, prelude) of every part of a sheet that ``compile_sheet`` leaves out.

    ``selector``: a rule whose selector does not parse; ``at-rule``: one that is not
    applied (``@import``, ``@scope``, ``@container``, ...); ``declaration``: a value that its
    property's grammar refuses.  Parts that ``@supports`` rules out are no errors.
    """
    found: list[tuple[str, str]] = []

    def walk(text: str, inside: bool) -> None:
        for prelude, body, _ in _blocks(text):
            if prelude.startswith("@"):
                name = re.match(r"@([\w-]*)", prelude)[1].lower()
                if name not in ("layer", "media", "supports", "charset"):
                    found.append(("at-rule", prelude))
                elif body is not None and (name != "supports" or supports(prelude.partition(" ")[2].strip())):
                    walk(body, inside)
            elif body is None:
                name, _, value = prelude.partition(":")
                if inside and _refused(name, value):
                    found.append(("declaration", prelude))
            else:
                try:
                    selectors.parse(prelude.replace("&", ":is(*)") if inside else prelude)
                except TextError:
                    found.append(("selector", prelude))
                    continue
                walk(body, True)

    walk(_strip(css), False)
    return found


def supports(condition: str) -> bool:
    """``@supports``: a declaration is supported if it parses and its property's grammar, where one is known, takes its value; unknown functions are false."""
    c = condition.strip()
    if m := re.fullmatch(r"not\s+(.*)", c, re.S | re.I):
        return not supports(m[1])
    for word, join in (("and", all), ("or", any)):
        parts = _split(c, word)
        if len(parts) > 1:
            return join(map(supports, parts))
    if m := re.fullmatch(r"selector\((.*)\)", c, re.S | re.I):
        try:
            selectors.parse(m[1])
            return True
        except TextError:
            return False
    if c.startswith("(") and c.endswith(")"):
        inner = c[1:-1].strip()
        if m := re.fullmatch(r"((?:--)?[\w-]+)\s*:\s*(\S.*)", inner, re.S):
            return not _refused(m[1], m[2])
        return inner.startswith(("(", "not ")) and supports(inner)
    return False


def _refused(name: str, value: str) -> bool:
    """Whether the grammar of a property refuses a value."""
    grammar = css_properties.grammar(name.strip().lower())
    plain = re.sub(r"\s*!\s*important\s*$", "", value, flags=re.I).strip()
    return grammar is not None and plain.lower() not in WIDE and grammar.match(plain).status == "no-match"


def _split(text: str, word: str) -> list[str]:
    out, depth, begin = [], 0, 0
    for m in re.finditer(rf"[()]|\s{word}\s", text, re.I):
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            depth -= 1
        elif not depth:
            out.append(text[begin : m.start()].strip())
            begin = m.end()
    return [*out, text[begin:].strip()]


def media_matches(query: str, environment: dict[str, object]) -> bool:
    """Media query list against feature values; unknown features are unknown (Kleene), at the top unknown is false."""

    def feature(text: str) -> bool | None:
        m = re.fullmatch(r"\(\s*(min-|max-)?([\w-]+)\s*(?::\s*([^)]+?))?\s*\)", text)
        r = re.fullmatch(r"\(\s*([\w-]+)\s*(<=|>=|<|>|=)\s*([^)<>=]+?)\s*\)", text)
        if r:
            own, wanted = environment.get(r[1]), _length(r[3])
            return None if own is None or wanted is None else {"<=": own <= wanted, ">=": own >= wanted, "<": own < wanted, ">": own > wanted, "=": own == wanted}[r[2]]
        if not m or m[2] not in environment:
            return None
        own = environment[m[2]]
        if m[3] is None:
            return bool(own) and own != "none"
        wanted = _length(m[3]) if isinstance(own, (int, float)) else m[3].strip().lower()
        if wanted is None:
            return None
        return own >= wanted if m[1] == "min-" else own <= wanted if m[1] == "max-" else own == wanted

    def condition(text: str) -> bool | None:
        text = text.strip()
        if m := re.fullmatch(r"not\s+(.*)", text, re.S | re.I):
            found = condition(m[1])
            return None if found is None else not found
        for word in ("and", "or"):
            parts = [condition(p) for p in _split(text, word)] if len(_split(text, word)) > 1 else None
            if parts:
                if word == "and":
                    return False if False in parts else None if None in parts else True
                return True if True in parts else None if None in parts else False
        if text.startswith("((") or text.startswith("(not"):
            return condition(text[1:-1])
        if text.startswith("("):
            return feature(text)
        return {"all": True, "screen": environment.get("type", "screen") == "screen", "print": environment.get("type") == "print"}.get(text.lower(), False)

    def one(text: str) -> bool | None:
        m = re.match(r"(not|only)\s+(?=[a-z])(.*)", text.strip(), re.S | re.I)
        if m:
            found = condition(m[2])
            return found if m[1].lower() == "only" or found is None else not found
        return condition(text)

    return not query.strip() or any(one(q) is True for q in query.split(","))


def _length(text: str) -> float | None:
    """A number, a length in px or a resolution in dppx."""
    m = re.fullmatch(r"([+-]?[\d.]+)(px|em|rem|in|cm|mm|pt|pc|dppx|x|dpi)?", text.strip().lower())
    per = {None: 1, "px": 1, "em": 16, "rem": 16, "in": 96, "cm": 96 / 2.54, "mm": 96 / 25.4, "pt": 96 / 72, "pc": 16, "dppx": 1, "x": 1, "dpi": 1 / 96}
    return float(m[1]) * per[m[2]] if m else None


def simple_keys(selector: str) -> list[str] | None:
    """What an element must have (``#id``, ``.class``, tag name), id first, for a selector of these alone; else None."""
    (one,) = selectors.parse(selector)
    if one.combinators or one.lead or any(kind not in ("universal", "type", "class", "id") for kind, _ in one.compounds[0].parts):
        return None
    mark = {"id": "#", "class": ".", "type": ""}
    keys = [mark[kind] + (arg.lower() if kind == "type" else arg) for kind, arg in one.compounds[0].parts if kind in mark]
    return sorted(set(keys), key=lambda k: (k[:1] not in "#", k[:1] != ".", k))


def indexed_hits(nodes: DataFrame, id_cols: list[str], rules: dict[str, list[str]]) -> DataFrame:
    """(ids, pre, selector) of simple selectors in one pass: rules are bucketed by their rarest key and meet the keys of every element."""
    spark = nodes.sparkSession
    index = spark.createDataFrame([(s, keys[0] if keys else "*", keys) for s, keys in rules.items()], "selector string, bucket string, need array<string>")
    classes = F.filter(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"[ \t\n\f\r]+"), lambda c: c != "")
    own = F.concat(F.array(F.lit("*"), F.lower("name"), F.concat(F.lit("#"), F.coalesce(F.col("attrs")["id"], F.lit("")))), F.transform(classes, lambda c: F.concat(F.lit("."), c)))
    elements = nodes.where("kind = 'element'").select(*id_cols, "pre", F.array_distinct(own).alias("own"))
    met = elements.select(*id_cols, "pre", "own", F.explode("own").alias("bucket")).join(F.broadcast(index), "bucket")  # the rules of one sheet
    return met.where(F.size(F.array_except("need", "own")) == 0).select(*id_cols, "pre", "selector")


def candidates(nodes: DataFrame, id_cols: list[str], css: str, origin: str = "author", environment: dict | None = None) -> DataFrame:
    """Declarations by the elements they apply to: ids, pre, prop, value, important, origin, attached, layer, a, b, c, ord."""
    found, layers = compile_sheet(css)
    found = [d for d in found if all(media_matches(m, environment or {}) for m in d.media)]
    spark = nodes.sparkSession
    schema = "selector string, prop string, value string, important boolean, layer int, a int, b int, c int, ord int"
    rows, matched = [], {}
    for d in found:
        rank = len(layers) if d.layer is None else layers.index(d.layer)
        for single in _split_list(d.selector):
            a, b, c = selectors.specificity(selectors.parse(single))
            rows.append((single, d.prop, d.value, d.important, rank, a, b, c, d.order))
            matched.setdefault(single, None)
    rules = spark.createDataFrame(rows, schema)
    joined = rule_index.hits(nodes, id_cols, list(matched)).join(F.broadcast(rules), "selector")  # the rules of one sheet
    return joined.select(*id_cols, "pre", "prop", "value", "important", F.lit(origin).alias("origin"), F.lit(False).alias("attached"), "layer", "a", "b", "c", "ord")


def _split_list(selector: str) -> list[str]:
    out, depth, begin = [], 0, 0
    for i, c in enumerate(selector):
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            out.append(selector[begin:i].strip())
            begin = i + 1
    return [*out, selector[begin:].strip()]


def inline_candidates(nodes: DataFrame, id_cols: list[str]) -> DataFrame:
    """Declarations of style attributes."""
    from ..functions.columns import value_udf

    style = nodes.where("kind = 'element' and attrs['style'] is not null")
    listed = value_udf(lambda s: [{"prop": p, "value": v, "important": i} for p, v, i in declarations(s)], "array<struct<prop:string,value:string,important:boolean>>", F.col("attrs")["style"])
    one = style.select(*id_cols, "pre", F.posexplode(listed).alias("ord", "d"))
    zero = F.lit(0)
    return one.select(*id_cols, "pre", "d.prop", "d.value", "d.important", F.lit("author").alias("origin"), F.lit(True).alias("attached"), F.lit(1 << 30).alias("layer"), zero.alias("a"), zero.alias("b"), zero.alias("c"), "ord")


def cascade(found: DataFrame, id_cols: list[str]) -> DataFrame:
    """``found`` with rank: 1 wins; later ranks are the losers in order.

    Importance turns the order of origins and of layers round.
    """
    origin = F.when(F.col("origin") == "user-agent", 0).when(F.col("origin") == "user", 1).otherwise(2)
    level = F.when(F.col("important"), 6 - origin).otherwise(origin)
    layer = F.when(F.col("important"), -F.col("layer")).otherwise(F.col("layer"))
    order = Window.partitionBy(*id_cols, "pre", "prop").orderBy(level.desc(), F.col("attached").desc(), layer.desc(), F.desc("a"), F.desc("b"), F.desc("c"), F.desc("ord"))
    return found.withColumn("rank", F.row_number().over(order))


def resolved(ranked: DataFrame, id_cols: list[str]) -> DataFrame:
    """(ids, pre, prop, value): the winner after ``revert`` and ``revert-layer``; null if nothing is left.

    ``revert`` sets aside all declarations of its origin, ``revert-layer`` those of its
    layer, and the next candidate decides.  The candidates of one property of one
    element are one array, walked by a fold.
    """
    own = F.struct("rank", "origin", F.concat_ws("/", "origin", F.when(F.col("attached"), F.lit("style")).otherwise(F.col("layer").cast("string"))).alias("layer"), "value")
    listed = ranked.groupBy(*id_cols, "pre", "prop").agg(F.array_sort(F.collect_list(own)).alias("_all"))
    nothing = F.array().cast("array<string>")
    begin = F.struct(F.lit(False).alias("done"), F.lit(None).cast("string").alias("value"), nothing.alias("aside"))

    def step(state: Column, x: Column) -> Column:
        skip = state["done"] | F.array_contains(state["aside"], x["origin"]) | F.array_contains(state["aside"], x["layer"])
        back, layer_back = F.lower(x["value"]) == "revert", F.lower(x["value"]) == "revert-layer"
        more = F.when(back, F.concat(state["aside"], F.array(x["origin"]))).when(layer_back, F.concat(state["aside"], F.array(x["layer"]))).otherwise(state["aside"])
        return F.struct(
            F.when(skip, state["done"]).otherwise(~(back | layer_back)).alias("done"),
            F.when(skip | back | layer_back, state["value"]).otherwise(x["value"]).alias("value"),
            F.when(skip, state["aside"]).otherwise(more).alias("aside"),
        )

    return listed.select(*id_cols, "pre", "prop", F.aggregate("_all", begin, step, lambda s: s["value"]).alias("value"))


def style_hash(winners: DataFrame, id_cols: list[str]) -> DataFrame:
    """(ids, pre, hash) of each element's winning declarations, whatever their order."""
    own = F.sort_array(F.collect_list(F.concat_ws(":", "prop", "value")))
    return winners.where("rank = 1").groupBy(*id_cols, "pre").agg(F.xxhash64(F.array_join(own, ";")).alias("hash"))


def computed(nodes: DataFrame, id_cols: list[str], winners: DataFrame, prop: str) -> DataFrame:
    """(ids, pre, value) of one property on every element, after inheritance and defaulting.

    The value of an inherited property comes from the nearest ancestor-or-self
    with a winner of its own: two windows in document order, whatever the depth.
    """
    own = winners.where((F.col("prop") == prop) & (F.col("rank") == 1)).select(*id_cols, "pre", "value")
    elements = nodes.where("kind = 'element'").select(*id_cols, "pre", "post", "depth")
    initial = INITIAL.get(prop, "")
    keep = ~F.col("value").isin("inherit", "unset", "initial")
    if prop not in INHERITED:
        joined = elements.join(own, [*id_cols, "pre"], "left")
        return joined.select(*id_cols, "pre", F.when(keep, F.col("value")).otherwise(F.lit(initial)).alias("value"))
    own = own.where(~F.col("value").isin("inherit", "unset")).withColumn("value", F.when(F.col("value") == "initial", F.lit(initial)).otherwise(F.col("value")))
    sources = elements.join(own, [*id_cols, "pre"]).select(*id_cols, "pre", "post", "value")
    found = structural.nearest_ancestor(elements.select(*id_cols, "pre"), sources, id_cols, "value", or_self=True)
    return found.withColumn("value", F.coalesce("value", F.lit(initial)))
