"""CSV import: strict, atomic, in file order.

Files are read by Spark's tasks alone. One pass over the lines checks that they are
UTF-8 and whether a quoted field goes on over a line's end; only where one does is
the file a single task's work. Fields and their numbers are checked as records are read.
"""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import SPARK_ERRORS, SchemaError
from tessera.sources.schema import DataType, Schema
from tessera.sources.writer import publish_file, publish_folder

_INTEGER = r"[+-]?[0-9]+"


def import_csv(spark: SparkSession, source: str, destination: str, schema: Schema, header: bool = True, parts: bool = False) -> int:
    """Write source as a table at destination; the row count. A failure leaves nothing.

    Strings are kept byte for byte, integers may be padded. The header must equal
    the schema's names in order. With parts the table is a folder that all tasks
    write, else one file that one task writes.
    """
    if os.path.exists(destination):
        raise SchemaError(f"{destination} already exists")
    try:
        frame = read_csv(spark, source, schema, header)
        (publish_folder if parts else publish_file)(frame, destination)
        return spark.read.parquet(destination).count()
    except SPARK_ERRORS as e:
        raise SchemaError(f"{source}: {_reason(str(e))}") from e


def _reason(text: str) -> str:
    """The line of an error that says what is wrong with the file."""
    lines = text.splitlines() or [text]
    told = [line for line in lines if "column" in line or "alformed" in line or "MALFORMED" in line]
    return (told or lines)[0].strip()


def read_csv(spark: SparkSession, source: str, schema: Schema, header: bool = True) -> DataFrame:
    """The rows of a CSV file, typed; a bad field or record is an error when it is read."""
    names = list(schema)
    try:
        first, end, broken = _layout(spark, source)
    except SPARK_ERRORS as e:
        raise SchemaError(f"cannot read {source}: {_reason(str(e))}") from e
    if header and first != names:
        raise SchemaError(f"the header is {first}, the schema has {names}")
    raw = (
        spark.read.schema(T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]))
        .option("mode", "FAILFAST").option("multiLine", broken).option("quote", '"').option("escape", '"')
        .option("header", header).option("enforceSchema", True).option("lineSep", end)
        .option("maxCharsPerColumn", -1).option("nullValue", "\0").option("emptyValue", "")
        .csv(source)
    )
    columns = []
    for i, (name, kind) in enumerate(schema.items()):
        text = F.coalesce(F.col(f"c{i}"), F.lit(""))
        if kind is DataType.INT64:
            trimmed = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
            number = F.when(trimmed.rlike(f"^{_INTEGER}$"), trimmed.try_cast("bigint"))
            bad = F.raise_error(F.concat(F.lit(f"column {name}: not an integer: "), text)).cast("bigint")
            columns.append(F.coalesce(number, bad).alias(name))
        else:
            columns.append(text.alias(name))
    return raw.select(*columns)


def _layout(spark: SparkSession, source: str) -> tuple[list[str], str, bool]:
    """The first record, what ends lines, and whether a quoted field holds a line's end; SchemaError unless UTF-8."""
    lines = spark.read.option("lineSep", "\n").text(source)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd, bad = lines.agg(F.count_if(quotes % 2 != 0), F.count_if(~F.is_valid_utf8("value"))).first()
    if bad:
        raise SchemaError(f"{source} is not UTF-8")
    taken, head = 1, None
    while head is None:
        rows = lines.take(taken)
        head = _first_record(rows)
        if head is None and len(rows) < taken:
            head = ""  # no quote closes: no header is found, and reading fails
        taken *= 4
    end = "\r\n" if head.endswith("\r") else "\n"
    return next(csv.reader([head.removesuffix("\r")]), []), end, odd > 0


def _first_record(rows: list) -> str | None:
    """The lines of the first record, if its quotes close within rows."""
    head = ""
    for i, row in enumerate(rows):
        head += ("\n" if i else "") + row.value
        if head.count('"') % 2 == 0:
            return head
    return None
