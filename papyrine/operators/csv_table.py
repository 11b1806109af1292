"""CSV tables as DataFrames of ``row_idx`` and ``fields`` (array of strings).

Row and column edits, normalisation and checks are column expressions; only
``parse`` and ``write`` run a UDF over the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import csv_text
from ..functions.columns import value_udf
from ..functions.csv_text import Dialect


def parse(df: DataFrame, text_col: str, dialect: Dialect = Dialect(), on_error: str = "raise") -> DataFrame:
    """One row for each record of each text, with row_idx from 0; ragged rows are kept."""
    rows = value_udf(lambda t: csv_text.parse(t, dialect), "array<array<string>>", text_col, on_error=on_error)
    return df.withColumn("_rows", rows).select(*df.columns, F.posexplode("_rows").alias("row_idx", "fields"))


def record(fields: Column, dialect: Dialect = Dialect(), quoting: str = "minimal") -> Column:
    """One CSV record, built from column expressions; ``none`` refuses a field that needs quotes."""
    d, q = dialect.delimiter, dialect.quote
    special = f"[{_class(d)}{_class(q)}\\r\\n]"

    def one(x: Column) -> Column:
        x = F.coalesce(x, F.lit(""))
        quoted = F.concat(F.lit(q), F.replace(x, F.lit(q), F.lit(q + q)), F.lit(q))
        if quoting == "all":
            return quoted
        if quoting == "nonnumeric":
            return F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x).otherwise(quoted)
        if quoting == "none":
            return F.when(x.rlike(special), F.raise_error(F.concat(F.lit("unwritable without quotes: "), x)).cast("string")).otherwise(x)
        return F.when(x.rlike(special) | ((F.size(fields) == 1) & (x == "")), quoted).otherwise(x)

    return F.array_join(F.transform(fields, one), d)


def _class(c: str) -> str:
    return "\\" + c if not c.isalnum() else c


def field(index: int) -> Column:
    """Cell by ordinal from 0, null beyond the row's width."""
    return F.get("fields", F.lit(index))


def header_indices(header: Column, name: str) -> Column:
    """All ordinals (from 0) of a header name, in order."""
    return F.filter(F.transform(header, lambda x, i: F.when(x == name, i)), lambda i: i.isNotNull())


def widths(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n_rows, min_cols, max_cols and whether rows are irregular."""
    size = F.size("fields")
    return table.groupBy(*(by or [])).agg(F.count("*").alias("n_rows"), F.min(size).alias("min_cols"), F.max(size).alias("max_cols"), (F.min(size) != F.max(size)).alias("irregular"))


def normalize(table: DataFrame, width: int | str = "max", fill: str = "") -> DataFrame:
    """Rows padded or cut to one width: a number, ``max`` or ``min`` of the table."""
    if isinstance(width, str):
        found = table.agg((F.max if width == "max" else F.min)(F.size("fields")).alias("_width"))
        table = table.crossJoin(F.broadcast(found))  # one row
        target: Column = F.col("_width")
    else:
        target = F.lit(width)
    padded = F.slice(F.concat("fields", F.array_repeat(F.lit(fill), target)), F.lit(1), target)
    return table.withColumn("fields", padded).drop("_width")


def insert_row(table: DataFrame, at: int, fields: list[str]) -> DataFrame:
    """A row put before ordinal ``at``."""
    moved = table.withColumn("row_idx", F.when(F.col("row_idx") >= at, F.col("row_idx") + 1).otherwise(F.col("row_idx")))
    new = table.sparkSession.createDataFrame([(at, fields)], "row_idx int, fields array<string>")
    return moved.select("row_idx", "fields").unionByName(new)


def remove_row(table: DataFrame, at: int) -> DataFrame:
    return table.where(F.col("row_idx") != at).withColumn("row_idx", F.when(F.col("row_idx") > at, F.col("row_idx") - 1).otherwise(F.col("row_idx")))


def set_field(table: DataFrame, row: int, column: int, value: str) -> DataFrame:
    changed = F.transform("fields", lambda x, i: F.when(i == column, F.lit(value)).otherwise(x))
    return table.withColumn("fields", F.when(F.col("row_idx") == row, changed).otherwise(F.col("fields")))


def insert_column(table: DataFrame, at: int, value: Column | str = "") -> DataFrame:
    """A column put before ordinal ``at`` (or appended where rows are narrower)."""
    new = F.lit(value) if isinstance(value, str) else value
    head, tail = F.slice("fields", 1, at), F.when(F.size("fields") > at, F.slice("fields", F.lit(at + 1), F.greatest(F.size("fields") - at, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return table.withColumn("fields", F.concat(head, F.array(new), tail))


def remove_column(table: DataFrame, at: int) -> DataFrame:
    return table.withColumn("fields", F.filter("fields", lambda x, i: i != at))


def with_header(table: DataFrame, names: list[str]) -> DataFrame:
    """One string column for each name."""
    return table.select("row_idx", *[field(i).alias(n) for i, n in enumerate(names)])


def sniff(column: Column | str) -> Column:
    """Delimiter and quote of a sample; null where no single dialect fits."""

    def run(text: str):
        found = csv_text.sniff(text)
        return {"delimiter": found.delimiter, "quote": found.quote}

    return value_udf(run, "struct<delimiter:string,quote:string>", column, on_error="null")
