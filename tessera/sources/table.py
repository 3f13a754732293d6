"""A table: one Parquet file or directory, or a DataFrame."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import SPARK_ERRORS, SchemaError
from tessera.sources import footer
from tessera.sources.schema import DataType, Schema, covered, validate
from tessera.sources.session import CASE, settings

#: Names of the columns that hold a row's place in the input.
POSITION = ("__file", "__row")


class Table:
    """Rows of 64-bit integers and strings, with their place in the input.

    Narrower integers are widened; columns of other types are not part of the
    table. A null in a covered column breaks the model: from_parquet refuses it
    by the footers or, where they are not read, by the scan of check_nulls().
    """

    def __init__(self, spark: SparkSession, frame: DataFrame, schema: Schema, path: str | None):
        self.spark, self.schema, self.path = spark, schema, path
        self._frame = frame

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str) -> Table:
        with settings(spark, CASE):
            return cls._from_parquet(spark, path)

    @classmethod
    def _from_parquet(cls, spark: SparkSession, path: str) -> Table:
        try:
            frame = spark.read.parquet(path)
        except SPARK_ERRORS as e:
            raise SchemaError(f"{path} is not a readable table: {str(e).splitlines()[0]}") from e
        schema = covered(frame.schema)
        validate(list(schema.items()))
        # a wider read schema widens in the reader itself, and keeps filters pushed down
        wide = T.StructType([T.StructField(f.name, schema[f.name].spark if f.name in schema else f.dataType) for f in frame.schema])
        table = cls(spark, spark.read.schema(wide).parquet(path), schema, path)
        if table.footers is None:
            table.check_nulls()
        else:
            for name in schema:
                if any(g.nulls.get(name) for g in table.footers.groups):
                    raise SchemaError(f"column {name} of {path} holds nulls")
        return table

    @classmethod
    def from_rows(cls, spark: SparkSession, schema: Schema, rows: list[tuple]) -> Table:
        """A small table in memory, in the order given."""
        types = T.StructType(
            [T.StructField(n, k.spark, False) for n, k in schema.items()] + [T.StructField(POSITION[1], T.LongType(), False)]
        )
        frame = spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], types)
        return cls(spark, frame.withColumn(POSITION[0], F.lit("")), schema, None)

    @classmethod
    def from_dataframe(cls, frame: DataFrame) -> Table:
        """Any DataFrame; a row's place is its partition and its place there."""
        schema = covered(frame.schema)
        validate(list(schema.items()))
        wide = frame.select(*(_quoted(n).cast(k.spark).alias(n) for n, k in schema.items()))
        placed = wide.withColumn(POSITION[0], F.lit("")).withColumn(POSITION[1], F.monotonically_increasing_id())
        return cls(frame.sparkSession, placed, schema, None)

    @cached_property
    def footers(self) -> footer.Footers | None:
        files = footer.local_files(self.path) if self.path else None
        return footer.read(files, list(self.schema)) if files else None

    def frame(self, positions: bool = False) -> DataFrame:
        """The covered columns, and the place of each row if positions."""
        names = [_quoted(n) for n in self.schema]
        if not positions:
            return self._frame.select(*names)
        if self.path is None:
            return self._frame.select(*names, *POSITION)
        place = (F.col("_metadata.file_path").alias(POSITION[0]), F.col("_metadata.row_index").alias(POSITION[1]))
        return self._frame.select(*names, *place)

    def check_nulls(self) -> None:
        """SchemaError if a covered column holds a null. One scan."""
        counts = self.frame().agg(*(F.count_if(_quoted(n).isNull()).alias(f"n{i}") for i, n in enumerate(self.schema)))
        for name, count in zip(self.schema, counts.first(), strict=True):
            if count:
                raise SchemaError(f"column {name} holds {count} nulls")

    @property
    def row_count(self) -> int:
        return self.footers.rows if self.footers else self.frame().count()

    def column_type(self, name: str) -> DataType:
        return self.schema[name]


def _quoted(name: str):
    return F.col(f"`{name}`")
