"""Column functions over text formats: Arrow UDFs that map whole batches.

Every parse has a strict form (a bad text fails the job) and a ``try_`` form that
returns ``struct<value, error>``.  Query texts (pointers, paths, patches,
selectors) are compiled on the driver, so that their errors surface before a job
starts.  Null in, null out.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..runtime import ship
from . import json_path, json_text
from .errors import ERROR_TYPE, TextError


def value_udf(fn: Callable, kind: str | T.DataType, *columns: Column | str, on_error: str = "raise") -> Column:
    """``fn`` over the values of ``columns``; ``on_error``: raise, null or try (struct of value and error)."""
    kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    result = T.StructType([T.StructField("value", kind), T.StructField("error", T._parse_datatype_string(ERROR_TYPE))]) if on_error == "try" else kind
    arrow = to_arrow_type(result)
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)

    def one(args: tuple):
        if any(a is None for a in args):
            return None
        try:
            found = fn(*args)
        except TextError as e:
            if on_error == "raise":
                raise
            return {"value": None, "error": e.row()} if on_error == "try" else None
        return {"value": found, "error": None} if on_error == "try" else found

    def run(*arrays: pa.Array) -> pa.Array:
        return pa.array([one(row) for row in zip(*(a.to_pylist() for a in arrays), strict=True)], arrow)

    run.__annotations__ = {"return": pa.Array}
    if len(columns) == 1:
        def single(a: pa.Array) -> pa.Array:
            return run(a)

        return F.arrow_udf(single, result)(*columns)
    if len(columns) == 2:
        def double(a: pa.Array, b: pa.Array) -> pa.Array:
            return run(a, b)

        return F.arrow_udf(double, result)(*columns)
    raise ValueError("one or two columns")


Options = json_text.JsonOptions


def json_canonical(column: Column | str, options: Options = Options(), on_error: str = "raise") -> Column:
    """Canonical text: sorted members, one spelling for equal numbers."""
    return value_udf(lambda t: json_text.write(json_text.parse(t, options), json_text.CANONICAL), "string", column, on_error=on_error)


def json_format(column: Column | str, style: json_text.JsonStyle, options: Options = Options(), on_error: str = "raise") -> Column:
    return value_udf(lambda t: json_text.write(json_text.parse(t, options), style), "string", column, on_error=on_error)


def json_valid(column: Column | str, options: Options = Options()) -> Column:
    """Whether the text is one value under the options; null for null."""
    return F.when(F.col(column).isNull() if isinstance(column, str) else column.isNull(), F.lit(None)).otherwise(
        F.coalesce(value_udf(lambda t: json_text.parse(t, options) is not t, "boolean", column, on_error="null"), F.lit(False))
    )


def json_pointer(column: Column | str, pointer: str, options: Options = Options(), on_error: str = "null") -> Column:
    """JSON text of the value at an RFC 6901 pointer, null if nothing is there."""
    tokens = json_text.pointer_tokens(pointer)
    missing = object()

    def get(text: str):
        found = json_text.pointer_get(json_text.parse(text, options), tokens, missing)
        return None if found is missing else json_text.write(found)

    return value_udf(get, "string", column, on_error=on_error)


def json_get(column: Column | str, pointer: str, kind: str = "string") -> Column:
    """Typed value at an RFC 6901 pointer by Spark's own VARIANT functions; no Python runs.

    Null where nothing is there, the value does not convert to ``kind``, or the text
    is no JSON (a repeated member name is an error too).  Strings come without their
    quotes, objects and arrays as JSON text (``kind`` string), numbers in the
    spelling of VARIANT.  A token of digits is an array index, or else a member name.
    """
    value = F.try_parse_json(F.col(column) if isinstance(column, str) else column)
    paths = ["$"]
    for token in json_text.pointer_tokens(pointer):
        mark = '"' if "'" in token else "'"
        if mark in token:
            raise TextError("pointer", f"{token!r} has both kinds of quotes, which a VARIANT path cannot hold")
        quoted = f"[{mark}{token}{mark}]"
        paths = [p + step for p in paths for step in ([f"[{token}]", quoted] if re.fullmatch(r"0|[1-9][0-9]*", token) else [quoted])]
    found = [F.try_variant_get(value, p, kind) for p in paths]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def json_typeof(column: Column | str, options: Options = Options()) -> Column:
    return value_udf(lambda t: json_text.type_name(json_text.parse(t, options)), "string", column, on_error="null")


def json_path(column: Column | str, query: str, options: Options = Options(), on_error: str = "null") -> Column:
    """JSON texts of the nodes of an RFC 9535 query, in document order."""
    made = _compiled(query)

    def run(text: str):
        value = json_text.parse(text, options)
        return [json_text.write(v) for _, v in made().nodes(value, value)]

    return value_udf(run, "array<string>", column, on_error=on_error)


def json_path_nodes(column: Column | str, query: str, options: Options = Options(), on_error: str = "null") -> Column:
    """Nodes as structs of normalized path and JSON text."""
    made = _compiled(query)

    def run(text: str):
        value = json_text.parse(text, options)
        return [{"path": json_path_module.normalized(p), "value": json_text.write(v)} for p, v in made().nodes(value, value)]

    return value_udf(run, "array<struct<path:string,value:string>>", column, on_error=on_error)


json_path_module = __import__(f"{__package__}.json_path", fromlist=["json_path"])


def _compiled(query: str) -> Callable:
    json_path_module.compile_path(query)  # refuse a bad query on the driver
    cache: list = []

    def made():
        if not cache:
            cache.append(json_path_module.compile_path(query))
        return cache[0]

    return made


def json_patch(column: Column | str, operations: Column | str, on_error: str = "null") -> Column:
    """RFC 6902 patch, as JSON text; all operations or none."""
    return value_udf(lambda t, p: json_text.write(json_text.patch(json_text.parse(t), json_text.parse(p))), "string", column, operations, on_error=on_error)


def json_merge_patch(column: Column | str, change: Column | str, on_error: str = "null") -> Column:
    """RFC 7386 merge patch, as JSON text."""
    return value_udf(lambda t, p: json_text.write(json_text.merge_patch(json_text.parse(t), json_text.parse(p))), "string", column, change, on_error=on_error)


def json_equal(a: Column | str, b: Column | str) -> Column:
    return value_udf(lambda x, y: json_text.equal(json_text.parse(x), json_text.parse(y)), "boolean", a, b, on_error="null")


def json_records(column: Column | str, mode: str, options: Options = Options(), on_error: str = "raise") -> Column:
    """JSON texts of the records of a sequence (off, whitespace, line, seq)."""
    return value_udf(lambda t: [json_text.write(v) for v in json_text.records(t, mode, options)], "array<string>", column, on_error=on_error)


def json_error(column: Column | str, options: Options = Options()) -> Column:
    """Why a text is refused (code, message, offset, line, col), null if it is one value."""
    return value_udf(lambda t: json_text.parse(t, options) is t, "boolean", column, on_error="try")["error"]


def yaml_pointer(column: Column | str, pointer: str, options=None, on_error: str = "null") -> Column:
    """JSON text of the value at an RFC 6901 pointer of a YAML text, null if nothing is there."""
    from . import yaml_text

    tokens, chosen, missing = json_text.pointer_tokens(pointer), options or yaml_text.YamlOptions(), object()

    def get(text: str):
        found = json_text.pointer_get(yaml_text.parse(text, chosen), tokens, missing)
        return None if found is missing else json_text.write(found)

    return value_udf(get, "string", column, on_error=on_error)


def json_put(column: Column | str, pointer: str, value: Column | str, on_error: str = "null") -> Column:
    """JSON text with the member or item at the pointer set to a JSON text."""
    json_text.pointer_tokens(pointer)
    return value_udf(lambda t, v: json_text.write(json_text.put(json_text.parse(t), pointer, json_text.parse(v))), "string", column, value, on_error=on_error)


def json_insert(column: Column | str, pointer: str, value: Column | str, on_error: str = "null") -> Column:
    """JSON text with a JSON text put before the item at the pointer."""
    json_text.pointer_tokens(pointer)
    return value_udf(lambda t, v: json_text.write(json_text.insert(json_text.parse(t), pointer, json_text.parse(v))), "string", column, value, on_error=on_error)


def json_remove(column: Column | str, pointer: str, on_error: str = "null") -> Column:
    """JSON text without the member or item at the pointer."""
    json_text.pointer_tokens(pointer)
    return value_udf(lambda t: json_text.write(json_text.remove(json_text.parse(t), pointer)), "string", column, on_error=on_error)


def json_merge(a: Column | str, b: Column | str, policy: str = "last", on_error: str = "null") -> Column:
    """JSON text of the members of two objects."""
    return value_udf(lambda x, y: json_text.write(json_text.merge(json_text.parse(x), json_text.parse(y), policy)), "string", a, b, on_error=on_error)


def json_events(column: Column | str, on_error: str = "raise") -> Column:
    """Parse events in document order, repeated members kept: rows of a stream of events by ``posexplode``."""
    return value_udf(json_text.events, "array<struct<event:string,depth:int,key:string,value:string>>", column, on_error=on_error)


# --- other formats ---


def yaml_to_json(column: Column | str, options=None, on_error: str = "raise") -> Column:
    """JSON text of a YAML text of one document."""
    from . import yaml_text

    chosen = options or yaml_text.YamlOptions()
    return value_udf(lambda t: json_text.write(yaml_text.parse(t, chosen)), "string", column, on_error=on_error)


def yaml_documents(column: Column | str, options=None, on_error: str = "raise") -> Column:
    """JSON texts of the documents of a YAML stream."""
    from . import yaml_text

    chosen = options or yaml_text.YamlOptions()
    return value_udf(lambda t: [json_text.write(v) for v in yaml_text.documents(t, chosen)], "array<string>", column, on_error=on_error)


def json_to_yaml(column: Column | str, indent: int = 2, on_error: str = "raise") -> Column:
    from . import yaml_text

    return value_udf(lambda t: yaml_text.write(json_text.parse(t), indent), "string", column, on_error=on_error)


def toml_to_json(column: Column | str, nonfinite: str = "error", on_error: str = "raise") -> Column:
    from . import toml_text

    return value_udf(lambda t: json_text.write(toml_text.to_json(toml_text.parse(t), nonfinite)), "string", column, on_error=on_error)


def json_to_toml(column: Column | str, nulls: str = "error", on_error: str = "raise") -> Column:
    from . import toml_text

    return value_udf(lambda t: toml_text.write(toml_text.from_json(json_text.parse(t), nulls)), "string", column, on_error=on_error)


def toml_events(column: Column | str, on_error: str = "raise") -> Column:
    """Leaf assignments of a TOML text in document order."""
    from . import toml_text

    return value_udf(toml_text.events, "array<struct<path:string,kind:string,value:string>>", column, on_error=on_error)


def ini_entries(column: Column | str, dialect: str = "generic", on_error: str = "raise") -> Column:
    """Entries of an INI text in file order, duplicates kept."""
    from . import ini_text

    chosen = ini_text.DIALECTS[dialect]
    return value_udf(lambda t: ini_text.entries(t, chosen), "array<struct<group:string,subsection:string,key:string,value:string,line:int>>", column, on_error=on_error)


def json_validate(column: Column | str, schema: str, draft: str = "2020-12", formats: bool = False, options: Options = Options()) -> Column:
    """Verdict, pointer of the first failure and message; the schema is compiled on the driver."""
    from . import json_schema

    compiled = json_schema.Schema(json_text.parse(schema), draft, formats=formats)
    return value_udf(lambda t: compiled.validate(json_text.parse(t, options)), "struct<valid:boolean,pointer:string,message:string>", column, on_error="null")


def yaml_validate(column: Column | str, schema: str, draft: str = "2020-12", formats: bool = False) -> Column:
    """JSON Schema over a YAML text."""
    from . import json_schema, yaml_text

    compiled = json_schema.Schema(json_text.parse(schema), draft, formats=formats)
    return value_udf(lambda t: compiled.validate(yaml_text.parse(t)), "struct<valid:boolean,pointer:string,message:string>", column, on_error="null")


def html_sanitize(column: Column | str, images: bool = False) -> Column:
    from . import markup

    return value_udf(lambda t: markup.sanitize(t, images), "string", column)


def html_normalize(column: Column | str) -> Column:
    """HTML text of the parsed tree."""
    from . import markup

    return value_udf(lambda t: markup.serialize_html(markup.parse_html(t)), "string", column)


def xml_normalize(column: Column | str, on_error: str = "raise") -> Column:
    """XML text of the parsed tree; a text that is not well-formed is an error with its place."""
    from . import markup

    return value_udf(lambda t: markup.serialize_xml(markup.parse_xml(t)), "string", column, on_error=on_error)


def decode(column: Column | str, label: str, errors: str = "replacement", on_error: str = "raise") -> Column:
    """Text of a binary column in the encoding of a label."""
    from . import encoding_text

    name = encoding_text.for_label(label)
    if name is None:
        raise TextError("encoding", f"unknown label {label!r}")
    return value_udf(lambda b: encoding_text.decode(bytes(b), name, errors), "string", column, on_error=on_error)


def encode(column: Column | str, label: str, errors: str = "fatal", on_error: str = "raise") -> Column:
    from . import encoding_text

    name = encoding_text.for_label(label)
    if name is None:
        raise TextError("encoding", f"unknown label {label!r}")
    return value_udf(lambda t: encoding_text.encode(t, name, errors), "binary", column, on_error=on_error)


def css_color(column: Column | str) -> Column:
    """Serialized sRGB colour, null if it is none."""
    from . import css_values

    return value_udf(lambda t: css_values.serialize_color(css_values.color(t)), "string", column, on_error="null")


def css_substitute(value: Column | str, properties: Column | str, environment: dict[str, str] | None = None) -> Column:
    """Value with ``var()`` and ``env()`` replaced; null if it is invalid at computed-value time.

    ``properties`` is a map of custom properties of the element, ``environment`` the ``env()`` names.
    """
    from . import css_values

    return value_udf(lambda v, p: css_values.substitute(v, dict(p), environment or {}), "string", value, properties, on_error="null")


def markup_equal(a: Column | str, b: Column | str, xml: bool = False) -> Column:
    """Whether two markup texts have the same tree; null if one of them is refused."""
    from . import markup

    return value_udf(lambda x, y: markup.equal(x, y, xml), "boolean", a, b, on_error="null")


def html_is_void(name: Column | str) -> Column:
    """Whether an element never has content."""
    from . import markup

    return F.lower(F.col(name) if isinstance(name, str) else name).isin(*sorted(markup.VOID))


def html_is_boolean_attribute(name: Column | str) -> Column:
    from . import markup

    return F.lower(F.col(name) if isinstance(name, str) else name).isin(*sorted(markup.BOOLEAN_ATTRIBUTES))


def _uri_parts(uri: Column) -> dict[str, Column]:
    """Components of a URI reference; null where one is absent (a path is never absent)."""
    pattern = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    at = lambda i: F.regexp_extract(uri, pattern, i)
    rest = F.regexp_replace(uri, r"^[^:/?#]+:", "")
    return {
        "scheme": F.when(uri.rlike(r"^[^:/?#]+:"), at(1)), "authority": F.when(rest.startswith("//"), at(2)), "path": at(3),
        "query": F.when(uri.rlike(r"^[^#?]*\?"), at(4)), "fragment": F.when(F.contains(uri, F.lit("#")), at(5)),
    }


def _without_dots(path: Column) -> Column:
    """A path without "." and ".." segments, by a fold over its segments; each piece but the first keeps its slash."""
    segments = F.split(F.regexp_replace(path, r"^(?:\.\.?/)+|^\.\.?$", ""), "/")
    pieces = F.transform(segments, lambda s, i: F.struct(s.alias("s"), F.when(i == 0, s).otherwise(F.concat(F.lit("/"), s)).alias("p"), F.lit(False).alias("end")))
    marked = F.concat(F.slice(pieces, F.lit(1), F.size(segments) - 1), F.transform(F.slice(pieces, -1, 1), lambda x: F.struct(x["s"].alias("s"), x["p"].alias("p"), F.lit(True).alias("end"))))

    def step(kept: Column, x: Column) -> Column:
        up = F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
        slash = F.when(x["end"], F.array(F.lit("/"))).otherwise(F.array().cast("array<string>"))
        return F.when(x["s"] == ".", F.concat(kept, slash)).when(x["s"] == "..", F.concat(up, slash)).otherwise(F.concat(kept, F.array(x["p"])))

    return F.array_join(F.aggregate(marked, F.array().cast("array<string>"), step), "")


def uri_resolve(base: Column | str, reference: Column | str) -> Column:
    """RFC 3986, 5.2: a reference resolved against an absolute base, by column expressions; null if neither has a scheme."""
    base, reference = (F.col(x) if isinstance(x, str) else x for x in (base, reference))
    b, r = _uri_parts(base), _uri_parts(reference)
    merged = F.when(b["authority"].isNotNull() & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(F.regexp_replace(b["path"], r"[^/]*$", ""), r["path"]))
    own = r["scheme"].isNotNull() | r["authority"].isNotNull()
    path = (
        F.when(own, _without_dots(r["path"])).when(r["path"] == "", b["path"]).when(r["path"].startswith("/"), _without_dots(r["path"])).otherwise(_without_dots(merged))
    )
    query = F.when(own | (r["path"] != ""), r["query"]).otherwise(F.coalesce(r["query"], b["query"]))
    scheme, authority = F.coalesce(r["scheme"], b["scheme"]), F.when(own, r["authority"]).otherwise(b["authority"])
    part = lambda mark, value: F.coalesce(F.concat(F.lit(mark), value), F.lit(""))
    return F.when(scheme.isNotNull(), F.concat(scheme, F.lit(":"), part("//", authority), path, part("?", query), part("#", r["fragment"])))


def unicode_normalize(column: Column | str, form: str = "NFC") -> Column:
    """Unicode normalization form of a text."""
    import unicodedata

    return value_udf(lambda t: unicodedata.normalize(form, t), "string", column)
