"""All selectors of a sheet matched at once: a rule index, ancestor filters, and one step a combinator level.

A sheet's selectors share their beginnings: they are read into states, where a state
is a selector's prefix (``nav``, ``nav ul``, ``nav ul > li``) and its parent the prefix
before it.  Compounds and states are small tables, so the plan does not grow with
the number of rules, only with the number of compounds in the longest one:

1. Compounds are bucketed by their rarest key (id, class, type) and meet the keys of
   every element in one join; what else they ask for (attributes, places among
   siblings) is data, tested by one expression.
2. A node row carries a 64-bit Bloom filter of its ancestors' keys (``above``), written
   while the page is parsed.  A state whose prefix needs ancestors with keys that the
   filter lacks is dropped before any join.
3. Survivors of level n meet the matches of level n - 1: children and neighbours by an
   equality join, descendants by a window in document order.

Selectors with ``:is()``, ``:not()``, ``:has()``, ``:lang()``, ``of S`` or types among
siblings are left to ``selectors``, one plan each.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..runtime import drop, stash
from . import selectors, structural

_PLACES = {"first-child": (0, 1, False), "last-child": (0, 1, True)}
_FLAGS = frozenset("root only-child link any-link checked disabled enabled required optional defined visited hover active focus target".split())
_COMPOUND = "compound int, bucket string, need array<string>, tests array<struct<kind: string, name: string, value: string, fold: boolean, a: int, b: int>>"
_STATE = "state int, parent_state int, sign string, compound int, level int, need_above long"


@dataclass
class RuleIndex:
    """Compounds, states and the state of each selector; ``others`` are the selectors it does not hold."""

    compounds: list[tuple] = field(default_factory=list)
    states: list[tuple] = field(default_factory=list)
    finals: list[tuple[int, str]] = field(default_factory=list)
    others: list[str] = field(default_factory=list)

    @property
    def levels(self) -> int:
        return max((s[4] for s in self.states), default=0)


def _tests(compound: selectors.Compound) -> list[tuple] | None:
    """What a compound asks for besides keys, as rows; None if that cannot be told from one node row."""
    out = []
    for kind, arg in compound.parts:
        if kind == "attribute":
            name, op, value, fold = arg
            out.append((op or "has", name.lower(), value.lower() if fold and value else value, fold, 0, 0))
        elif kind == "pseudo":
            name, inner = arg
            if name in _PLACES:
                a, b, last = _PLACES[name]
                out.append(("last" if last else "nth", None, None, False, a, b))
            elif name in ("nth-child", "nth-last-child") and inner[1] is None:
                out.append(("last" if "last" in name else "nth", None, None, False, *inner[0]))
            elif name in _FLAGS and inner is None:
                out.append(("flag", name, None, False, 0, 0))
            else:
                return None
    return out


def _keys(compound: selectors.Compound) -> list[str]:
    """Keys that an element must have, the rarest kind first."""
    mark = {"id": "#", "class": ".", "type": ""}
    keys = {mark[kind] + (arg.lower() if kind == "type" else arg) for kind, arg in compound.parts if kind in mark}
    return sorted(keys, key=lambda k: (k[:1] != "#", k[:1] != ".", k))


def compile_rules(texts: list[str]) -> RuleIndex:
    """Index of single selectors (no lists)."""
    index = RuleIndex()
    compound_of: dict[str, int] = {}
    state_of: dict[tuple, int] = {}
    for text in dict.fromkeys(texts):
        (one,) = selectors.parse(text)
        tests = [_tests(c) for c in one.compounds]
        if one.lead or any(t is None for t in tests):
            index.others.append(text)
            continue
        state, needs, chain = 0, 0, []
        for level, (compound, asked) in enumerate(zip(one.compounds, tests, strict=True), 1):
            sign = one.combinators[level - 2] if level > 1 else ""
            keys = _keys(compound)
            place = compound_of.setdefault(repr((keys, asked)), len(compound_of))
            if place == len(index.compounds):
                index.compounds.append((place, keys[0] if keys else "*", keys, asked))
            if sign in (">", " "):
                needs |= chain[-1]
            chain.append(markup.key_bits(keys))
            before = (state, sign, place)
            if before not in state_of:
                state_of[before] = len(state_of) + 1
                index.states.append((state_of[before], state, sign, place, level, markup.signed(needs)))
            state = state_of[before]
        index.finals.append((state, text))
    return index


def _holds(t: Column) -> Column:
    """Whether a test holds for the current node row."""
    attrs, n = F.col("attrs"), F.when(t["kind"] == "last", F.col("sib_count") - F.col("sib_idx")).otherwise(F.col("sib_idx") + 1)
    raw = attrs[t["name"]]
    own, value = F.when(t["fold"], F.lower(raw)).otherwise(raw), t["value"]
    words = F.split(F.trim(F.regexp_replace(own, r"[ \t\n\f\r]+", " ")), " ")
    some = F.length(value) > 0
    flag = F.lit(False)
    link = F.lower("name").isin("a", "area") & attrs["href"].isNotNull()
    form = F.col("name").isin("button", "input", "select", "textarea", "optgroup", "option", "fieldset")
    field_ = F.col("name").isin("input", "select", "textarea")
    flags = {
        "root": F.col("depth") == 1, "only-child": F.col("sib_count") == 1, "link": link, "any-link": link, "checked": attrs["checked"].isNotNull() | attrs["selected"].isNotNull(),
        "disabled": form & attrs["disabled"].isNotNull(), "enabled": form & attrs["disabled"].isNull(), "required": field_ & attrs["required"].isNotNull(), "optional": field_ & attrs["required"].isNull(), "defined": F.lit(True),
    }
    for name, holds in flags.items():
        flag = F.when(t["name"] == name, holds).otherwise(flag)
    step = F.abs(t["a"])
    nth = F.when(t["a"] == 0, n == t["b"]).otherwise((F.pmod(n - t["b"], F.nullif(step, F.lit(0))) == 0) & F.when(t["a"] > 0, n >= t["b"]).otherwise(n <= t["b"]))
    found = (
        F.when(t["kind"].isin("nth", "last"), nth).when(t["kind"] == "flag", flag).when(t["kind"] == "has", own.isNotNull()).when(t["kind"] == "=", own == value)
        .when(t["kind"] == "~=", some & ~value.rlike(r"\s") & F.array_contains(words, value)).when(t["kind"] == "|=", (own == value) | own.startswith(F.concat(value, F.lit("-"))))
        .when(t["kind"] == "^=", some & own.startswith(value)).when(t["kind"] == "$=", some & own.endswith(value)).otherwise(some & own.contains(value))
    )
    return F.coalesce(found, F.lit(False))


def compound_hits(nodes: DataFrame, id_cols: list[str], index: RuleIndex) -> DataFrame:
    """(ids, pre, post, parent, sib_idx, above, compound): elements and the compounds they match, by one join."""
    table = nodes.sparkSession.createDataFrame(index.compounds, _COMPOUND)
    classes = F.filter(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"[ \t\n\f\r]+"), lambda c: c != "")
    own = F.concat(F.array(F.lit("*"), F.lower("name"), F.concat(F.lit("#"), F.coalesce(F.col("attrs")["id"], F.lit("")))), F.transform(classes, lambda c: F.concat(F.lit("."), c)))
    elements = nodes.where("kind = 'element'").withColumn("_own", F.array_distinct(own)).withColumn("bucket", F.explode("_own"))
    met = elements.join(F.broadcast(table), "bucket").where(F.size(F.array_except("need", "_own")) == 0)
    return met.where((F.size("tests") == 0) | F.forall("tests", _holds)).select(*id_cols, "pre", "post", "parent", "sib_idx", "above", "compound")


def hits(nodes: DataFrame, id_cols: list[str], texts: list[str]) -> DataFrame:
    """(ids, pre, selector) of all selectors: every element that one matches, once a selector."""
    index = compile_rules(texts)
    spark = nodes.sparkSession
    parts = [selectors.select_all(nodes, id_cols, s).select(*id_cols, "pre", F.lit(s).alias("selector")) for s in index.others]
    if index.states:
        states = spark.createDataFrame(index.states, _STATE)
        finals = F.broadcast(spark.createDataFrame(index.finals, "state int, selector string"))
        own = compound_hits(nodes, id_cols, index)
        if index.levels > 1:
            own = stash(own, "compounds")
        before = None
        for level in range(1, index.levels + 1):
            of = states.where(F.col("level") == level)
            met = own.join(F.broadcast(of), "compound").where(F.col("above").bitwiseAND(F.col("need_above")) == F.col("need_above"))
            found = met if before is None else _follow(met, before, id_cols, {s[2] for s in index.states if s[4] == level})
            found = found.select(*id_cols, "pre", "post", "parent", "sib_idx", "state")
            if index.levels > 1:
                found = stash(found, "states")
            parts.append(found.join(finals, "state").select(*id_cols, "pre", "selector"))
            before = found
        if index.levels > 1:
            drop(own)
    if not parts:
        return nodes.select(*id_cols, "pre", F.lit("").alias("selector")).where("false")
    return reduce(DataFrame.unionByName, parts)


def _follow(met: DataFrame, before: DataFrame, id_cols: list[str], signs: set[str]) -> DataFrame:
    """Rows of ``met`` whose parent state matches on the other side of their combinator."""
    keys = [*id_cols, "parent_state"]
    last = before.withColumnRenamed("state", "parent_state")
    out = []
    for sign in sorted(signs):
        rows = met.where(F.col("sign") == sign)
        if sign == " ":
            out.append(structural.with_ancestor(rows, last.select(*keys, "pre", "post"), keys))
            continue
        other = last.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("pre").alias("_pre"), F.col("parent").alias("_parent"), F.col("sib_idx").alias("_sib"))
        if sign == "~":
            other = other.groupBy(*[f"_k_{k}" for k in keys], "_parent").agg(F.min("_sib").alias("_sib"))
        link = {
            ">": lambda r, o: r["parent"] == o["_pre"], "+": lambda r, o: (r["parent"] == o["_parent"]) & (r["sib_idx"] == o["_sib"] + 1), "~": lambda r, o: (r["parent"] == o["_parent"]) & (r["sib_idx"] > o["_sib"]),
        }[sign]
        out.append(rows.join(other, structural.same_keys(rows, other, keys, "_k_") & link(rows, other), "left_semi"))
    return reduce(DataFrame.unionByName, out)
