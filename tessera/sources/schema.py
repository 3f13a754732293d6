"""The data model: 64-bit integers and UTF-8 strings, never null."""

from __future__ import annotations

import re
from enum import Enum

from pyspark.sql import types as T

from tessera.errors import SchemaError
from tessera.plans.lexer import is_keyword


class DataType(Enum):
    """Stored types: label, Python type of a value, Spark type."""

    INT64 = ("Int64", int, T.LongType())
    UTF8 = ("Utf8", str, T.StringType())

    def __init__(self, label: str, python: type, spark: T.DataType):
        self.label, self.python, self.spark = label, python, spark


#: Column name to type, in order. Names are case-sensitive.
Schema = dict[str, DataType]

#: The spellings of a type in a schema spec.
TYPE_NAMES = {
    "int": DataType.INT64, "int64": DataType.INT64,
    "str": DataType.UTF8, "utf8": DataType.UTF8, "string": DataType.UTF8,
}
_NAME = re.compile(r"[^\W\d]\w*")


def validate(columns: list[tuple[str, DataType]]) -> Schema:
    """SchemaError unless there is a column, and each name is an identifier, unreserved and unique."""
    if not columns:
        raise SchemaError("a schema needs at least one column")
    schema: Schema = {}
    for name, kind in columns:
        if not _NAME.fullmatch(name):
            raise SchemaError(f"invalid column name {name!r}")
        if is_keyword(name):
            raise SchemaError(f"column name {name} is a reserved word")
        if name in schema:
            raise SchemaError(f"duplicate column {name}")
        schema[name] = kind
    return schema


def parse_schema(spec: str) -> Schema:
    """From text like id:int,name:str."""
    columns = []
    for part in spec.split(","):
        name, colon, kind = part.partition(":")
        if not colon or kind.strip().lower() not in TYPE_NAMES:
            raise SchemaError(f"expected name:type with type int or str, found {part!r}")
        columns.append((name.strip(), TYPE_NAMES[kind.strip().lower()]))
    return validate(columns)


def spark_schema(schema: Schema) -> T.StructType:
    return T.StructType([T.StructField(n, k.spark, False) for n, k in schema.items()])


def covered(found: T.StructType) -> Schema:
    """The columns of a Parquet table that the data model covers; narrower integers count as 64-bit."""
    out: Schema = {}
    for field in found:
        if isinstance(field.dataType, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
            out[field.name] = DataType.INT64
        elif isinstance(field.dataType, T.StringType):
            out[field.name] = DataType.UTF8
    return out
