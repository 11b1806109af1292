"""Declarations checked against the grammars of their properties, and shorthands as rows of longhands.

Style sheets repeat themselves: of all declarations only the distinct (property,
value) pairs are matched, each once, and meet the rows again by a join.  The pairs
are combined before they shuffle, so a value that a third of all rows have is one
row a task; the join back broadcasts the pairs while they are few and is left to
adaptive skew handling beyond.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import css_properties, css_shorthand
from ..functions.css_grammar import WIDE
from ..functions.errors import TextError
from ..runtime import arrow_map, stash

_MATCHED = "property string, value string, status string, branch string, text string, offset long"
_LONGHANDS = "property string, value string, status string, longhands array<struct<name: string, value: string>>"
_BROADCAST_BYTES = 16 << 20


def _pairs(declarations: DataFrame) -> DataFrame:
    return declarations.select(F.col("property").cast("string").alias("property"), F.col("value").cast("string").alias("value")).where("property is not null and value is not null").distinct()


def _join_back(declarations: DataFrame, found: DataFrame) -> DataFrame:
    made = stash(found, "declared")
    size = made.agg(F.sum(F.octet_length("property") + F.octet_length("value") + 200)).first()[0] or 0
    taken = [c for c in made.columns if c not in ("property", "value")]
    return declarations.drop(*taken).join(F.broadcast(made) if size <= _BROADCAST_BYTES else made, ["property", "value"], "left")


def check_one(name: str, value: str, budget: int) -> tuple[str, str | None, str | None, int | None]:
    """(status, branch, canonical text, offset) of one declaration."""
    grammar = None if name.startswith("--") else css_properties.grammar(name)
    if name.startswith("--"):
        return "custom", None, value.strip(), None
    if grammar is None:
        return "unknown-property", None, None, None
    if value.strip().lower() in WIDE:
        return "wide", None, value.strip().lower(), None
    try:
        found = grammar.match(value, budget)
    except TextError as e:
        return e.code, None, None, e.offset
    return found.status, found.branch, found.text, found.offset


def match(declarations: DataFrame, budget: int = 200_000) -> DataFrame:
    """``declarations`` (property, value, ...) with status, branch, text and offset.

    ``status`` is match, no-match, pending (a substitution function is in it), wide (a
    CSS-wide keyword), custom, unknown-property or limit (budget exhausted, nested too
    deeply); ``branch`` is the alternative of the grammar that matched, ``text`` the
    canonical value, ``offset`` where a value stops to match.  A null property or value
    has null columns; columns of these names are replaced, others are kept.
    """

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [check_one(name.lower() if not name.startswith("--") else name, value, budget) for name, value in zip(b.column("property").to_pylist(), b.column("value").to_pylist(), strict=True)]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)] if rows else [pa.array([], k) for k in (pa.string(),) * 3 + (pa.int64(),)]
            return pa.RecordBatch.from_arrays([b.column("property"), b.column("value"), *columns], names=["property", "value", "status", "branch", "text", "offset"])

        return step

    return _join_back(declarations, arrow_map(_pairs(declarations), make, _MATCHED))


def longhands(declarations: DataFrame) -> DataFrame:
    """A row for each longhand of every declaration that matches: columns of ``declarations``, longhand, longhand_value.

    A declaration of a longhand is its own longhand in canonical text; what does not
    match gives no row; a value with a substitution function gives a row with a null
    longhand_value for each longhand it will set.
    """

    def one(name: str, value: str) -> tuple[str, list[dict]]:
        if name in css_properties.SHORTHANDS:
            try:
                status, found = css_shorthand.expand(name, value)
            except TextError as e:
                return e.code, []
            if status == "pending":
                return status, [{"name": n, "value": None} for n in css_shorthand.longhand_names(name)]
            return status, [{"name": n, "value": v} for n, v in found]
        status, _, text, _ = check_one(name, value, 200_000)
        kept = status in ("match", "wide", "custom", "pending")
        return status, [{"name": name, "value": None if status == "pending" else text}] if kept else []

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [one(name.lower() if not name.startswith("--") else name, value) for name, value in zip(b.column("property").to_pylist(), b.column("value").to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
            return pa.RecordBatch.from_arrays([b.column("property"), b.column("value"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], kind)], names=["property", "value", "status", "longhands"])

        return step

    names = [c for c in declarations.columns if c not in ("status", "longhands", "longhand", "longhand_value")]
    found = _join_back(declarations.select(names), arrow_map(_pairs(declarations), make, _LONGHANDS))
    return found.select(*names, F.explode("longhands").alias("_set")).select(*names, F.col("_set.name").alias("longhand"), F.col("_set.value").alias("longhand_value"))


def physical(declarations: DataFrame, writing_mode: str = "horizontal-tb", direction: str = "ltr", name_col: str = "longhand") -> DataFrame:
    """``declarations`` with logical property names replaced by physical ones, by a literal map in the plan."""
    names = css_shorthand.physical_names(writing_mode, direction)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return declarations.withColumn(name_col, F.coalesce(F.try_element_at(table, F.col(name_col)), F.col(name_col)))
