"""Tables written: row groups of up to 8,192 rows, published only when whole."""

from __future__ import annotations

import os
import shutil
import tempfile
from glob import glob

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import SchemaError
from tessera.sources.schema import DataType, Schema, spark_schema, validate
from tessera.sources.session import CASE, settings

ROW_GROUP_ROWS = 8192


def write_table(frame: DataFrame, path: str, row_group_rows: int = ROW_GROUP_ROWS) -> None:
    """A directory of Parquet files; refuses an existing path. For tables of any size."""
    with settings(frame.sparkSession, CASE):
        _writer(frame, row_group_rows).mode("errorifexists").parquet(path)


def _writer(frame: DataFrame, rows: int):
    if not 1 <= rows <= ROW_GROUP_ROWS:
        raise SchemaError(f"row group size must be in 1..{ROW_GROUP_ROWS}: {rows}")
    options = {
        "parquet.block.row.count.limit": rows,
        "parquet.page.row.count.limit": rows,
        "parquet.writer.version": "v2",
    }
    return frame.write.options(**options)


def publish_file(frame: DataFrame, path: str, row_group_rows: int = ROW_GROUP_ROWS) -> None:
    """One Parquet file at a local path, in frame's order: staged beside it, then linked.

    A link fails if the path exists, so nothing is overwritten, and a failure
    leaves nothing behind.
    """
    if os.path.exists(path):
        raise SchemaError(f"{path} already exists")
    parent = os.path.dirname(os.path.abspath(path))
    staging = tempfile.mkdtemp(prefix=".staging-", dir=parent)
    try:
        with settings(frame.sparkSession, CASE):
            _writer(frame.coalesce(1), row_group_rows).mode("overwrite").parquet(f"file://{staging}/out")
        (part,) = glob(f"{staging}/out/part-*.parquet")
        try:
            os.link(part, path)
        except FileExistsError:
            raise SchemaError(f"{path} already exists") from None
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def publish_folder(frame: DataFrame, path: str, row_group_rows: int = ROW_GROUP_ROWS) -> None:
    """A folder of Parquet files at a local path, in frame's order: staged beside it by all tasks, then renamed.

    A rename fails if the path exists with something in it, and a failure leaves nothing behind.
    """
    parent = os.path.dirname(os.path.abspath(path))
    staging = tempfile.mkdtemp(prefix=".staging-", dir=parent)
    try:
        with settings(frame.sparkSession, CASE):
            _writer(frame, row_group_rows).mode("overwrite").parquet(f"file://{staging}/out")
        if os.path.exists(path):
            raise SchemaError(f"{path} already exists")
        os.rename(f"{staging}/out", path)
    finally:
        shutil.rmtree(staging, ignore_errors=True)


class TableWriter:
    """Rows appended one by one, for small tables; finish() publishes the file."""

    def __init__(self, spark: SparkSession, path: str, columns: Schema | list[tuple[str, DataType]]):
        self.schema = validate(list(columns.items()) if isinstance(columns, dict) else columns)
        if os.path.exists(path):
            raise SchemaError(f"{path} already exists")
        self.spark, self.path, self.rows, self.group_rows = spark, path, [], ROW_GROUP_ROWS

    def with_row_group_size(self, rows: int) -> TableWriter:
        if not 1 <= rows <= ROW_GROUP_ROWS:
            raise SchemaError(f"row group size must be in 1..{ROW_GROUP_ROWS}: {rows}")
        self.group_rows = rows
        return self

    def add_row(self, row: tuple) -> None:
        """SchemaError, and no change, unless row has a value of the right type for each column."""
        if len(row) != len(self.schema):
            raise SchemaError(f"expected {len(self.schema)} values, got {len(row)}")
        for value, (name, kind) in zip(row, self.schema.items(), strict=True):
            if type(value) is not kind.python or (kind is DataType.INT64 and not -(2**63) <= value < 2**63):
                raise SchemaError(f"column {name} is {kind.label}; {value!r} is not")
        self.rows.append(tuple(row))

    def finish(self) -> None:
        frame = self.spark.createDataFrame(self.rows, spark_schema(self.schema), verifySchema=False)
        publish_file(frame, self.path, self.group_rows)
