"""Readers and writers of text formats over files.

Files are read through Spark's own text reader, so any path that Spark reads
works; formats whose records may span lines are read file by file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import csv_text, ini_text
from ..functions.columns import value_udf
from ..operators import csv_table


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def read_csv(spark: SparkSession, path: str, dialect: csv_text.Dialect = csv_text.Dialect(), header: bool = False) -> DataFrame:
    """(file, row_idx, fields) of CSV files, ragged rows kept.

    With ``header`` the first row of each file names the cells: ``record`` maps each
    name to its cell (a repeated name to its first), ``fields`` has all cells in
    order and ``surplus`` those beyond the header, so that no cell is lost.
    """
    rows = csv_table.parse(_files(spark, path), "text", dialect).drop("text")
    if not header:
        return rows
    names = rows.where("row_idx = 0").select("file", F.col("fields").alias("names"))
    body = rows.where("row_idx > 0").join(names, "file")
    width = F.least(F.size("names"), F.size("fields"))
    pairs = F.arrays_zip(F.slice("names", F.lit(1), width).alias("k"), F.slice("fields", F.lit(1), width).alias("v"))
    first = F.filter(pairs, lambda x, i: F.array_position("names", x["k"]) == i + 1)
    surplus = F.slice("fields", width + 1, F.greatest(F.size("fields") - width, F.lit(0)))
    return body.select("file", (F.col("row_idx") - 1).alias("row_idx"), F.map_from_entries(first).alias("record"), "fields", surplus.alias("surplus"))


def read_json_records(spark: SparkSession, path: str, mode: str = "line") -> DataFrame:
    """(file, record) of JSON record files; line mode splits files at line breaks, so a file is no unit of work."""
    from ..functions.columns import json_canonical, json_records

    if mode == "line":
        lines = spark.read.text(path).where(F.trim("value") != "")
        return lines.select(F.input_file_name().alias("file"), json_canonical("value").alias("record"))
    return _files(spark, path).select("file", F.explode(json_records("text", mode)).alias("record"))


def read_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, doc_idx, value, error): whole files of json, yaml or toml as JSON text; a bad file is a row with its error.

    A YAML file gives a row for each of its documents, the others one row a file.
    """
    from ..functions import json_text, toml_text, yaml_text

    of = {
        "json": lambda t: [json_text.parse(t)], "yaml": yaml_text.documents, "toml": lambda t: [toml_text.to_json(toml_text.parse(t))],
    }[kind]
    parsed = value_udf(lambda t: [json_text.write(v) for v in of(t)], "array<string>", "text", on_error="try")
    files = _files(spark, path).select("file", parsed.alias("p")).select("file", F.col("p.value").alias("values"), F.col("p.error").alias("error"))
    return files.select("file", F.posexplode_outer("values").alias("doc_idx", "value"), "error")


def read_markup(spark: SparkSession, path: str, xml: bool = False) -> DataFrame:
    """Node table of HTML or XML files, keyed by file; a file that cannot be parsed gives a row of kind ``error``."""
    from ..operators import selectors

    return selectors.node_table(_files(spark, path), ["file"], "text", xml=xml)


def read_ini(spark: SparkSession, path: str, dialect: str = "generic") -> DataFrame:
    """(file, group, subsection, key, value, line) of INI files."""
    d = ini_text.DIALECTS[dialect]
    kind = "array<struct<group:string,subsection:string,key:string,value:string,line:int>>"
    found = _files(spark, path).select("file", F.explode(value_udf(lambda t: ini_text.entries(t, d), kind, "text")).alias("e"))
    return found.select("file", "e.*")


def write_csv(df: DataFrame, path: str, dialect: csv_text.Dialect = csv_text.Dialect(), quoting: str = "minimal", columns: list[str] | None = None) -> None:
    """CSV part files of string columns; committed by Spark's own protocol (all or nothing)."""
    fields = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or df.columns])
    df.select(csv_table.record(fields, dialect, quoting).alias("value")).write.text(path)
