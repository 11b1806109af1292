"""SQL names: ``register(spark)`` makes the text functions callable from SQL.

Arguments that are query texts (pointers, paths) are columns here and are
compiled once a distinct text in each worker.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .functions import csv_text, encoding_text, json_path, json_text, markup, toml_text, yaml_text
from .functions.errors import TextError
from .runtime import ship

_path = lru_cache(256)(json_path.compile_path)
_tokens = lru_cache(256)(json_text.pointer_tokens)
_MISSING = object()


def _get(text: str, pointer: str) -> str | None:
    found = json_text.pointer_get(json_text.parse(text), _tokens(pointer), _MISSING)
    return None if found is _MISSING else json_text.write(found)


def _query(text: str, query: str) -> list[str]:
    value = json_text.parse(text)
    return [json_text.write(v) for _, v in _path(query).nodes(value, value)]


def _paths(text: str, query: str) -> list[str]:
    value = json_text.parse(text)
    return [json_path.normalized(p) for p, _ in _path(query).nodes(value, value)]


#: name: (function, number of arguments, type)
FUNCTIONS: dict[str, tuple[Callable, int, str]] = {
    "json_canon": (lambda t: json_text.write(json_text.parse(t), json_text.CANONICAL), 1, "string"),
    "json_pretty": (lambda t: json_text.write(json_text.parse(t), json_text.JsonStyle(indent=2)), 1, "string"),
    "json5_to_json": (lambda t: json_text.write(json_text.parse(t, json_text.JSON5), json_text.JsonStyle(numbers="canonical")), 1, "string"),
    "json_kind": (lambda t: json_text.type_name(json_text.parse(t)), 1, "string"),
    "json_at": (_get, 2, "string"),
    "json_query": (_query, 2, "array<string>"),
    "json_query_paths": (_paths, 2, "array<string>"),
    "json_same": (lambda a, b: json_text.equal(json_text.parse(a), json_text.parse(b)), 2, "boolean"),
    "json_patched": (lambda t, p: json_text.write(json_text.patch(json_text.parse(t), json_text.parse(p))), 2, "string"),
    "json_merged": (lambda t, p: json_text.write(json_text.merge_patch(json_text.parse(t), json_text.parse(p))), 2, "string"),
    "csv_rows": (csv_text.parse, 1, "array<array<string>>"),
    "csv_line": (csv_text.record, 1, "string"),
    "yaml_json": (lambda t: json_text.write(yaml_text.parse(t)), 1, "string"),
    "json_yaml": (lambda t: yaml_text.write(json_text.parse(t)), 1, "string"),
    "toml_json": (lambda t: json_text.write(toml_text.to_json(toml_text.parse(t))), 1, "string"),
    "json_toml": (lambda t: toml_text.write(toml_text.from_json(json_text.parse(t))), 1, "string"),
    "html_clean": (markup.sanitize, 1, "string"),
    "html_text_escape": (markup.escape, 1, "string"),
    "encoding_name": (encoding_text.for_label, 1, "string"),
    "is_xml_name": (markup.is_xml_name, 1, "boolean"),
}


def _udf(fn: Callable, arguments: int, kind: str):
    result = T._parse_datatype_string(kind)
    arrow = to_arrow_type(result)

    def one(*args):
        if any(a is None for a in args):
            return None
        try:
            return fn(*args)
        except TextError:
            return None

    if arguments == 1:
        def single(a: pa.Array) -> pa.Array:
            return pa.array(map(one, a.to_pylist()), arrow)

        return F.arrow_udf(single, result)

    def double(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(map(one, a.to_pylist(), b.to_pylist()), arrow)

    return F.arrow_udf(double, result)


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Register every function as ``prefix + name``; a bad text gives null. Returns the names."""
    ship(spark)
    for name, (fn, arguments, kind) in FUNCTIONS.items():
        spark.udf.register(prefix + name, _udf(fn, arguments, kind))
    return [prefix + name for name in FUNCTIONS]
