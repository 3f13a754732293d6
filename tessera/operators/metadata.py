"""COUNT, MIN and MAX of a whole table from its footers alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans import ast
from tessera.plans.binder import Bound
from tessera.sources.schema import DataType
from tessera.sources.session import CASE, settings
from tessera.sources.table import Table

#: Footers may hold cut string bounds; ours are written whole up to far beyond this many characters.
MAX_STRING = 60
#: With these Spark's own reader answers from the footers.
PUSHED = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def metadata_aggregates(bound: Bound, table: Table) -> DataFrame | None:
    """One row, or None if the footers don't hold the answer."""
    values = metadata_values(bound, table)
    if values is None:
        return None
    kinds = [T.LongType() if item.func == "count" else bound.schema[item.column].spark for item, _ in bound.outputs]
    columns = [F.lit(v).cast(k).alias(f"c{i}") for i, (v, k) in enumerate(zip(values, kinds, strict=True))]
    one = table.spark.range(1 if bound.limit is None or bound.limit > 0 else 0, numPartitions=1)
    return one.select(*columns).toDF(*(n for _, n in bound.outputs))


def metadata_values(bound: Bound, table: Table) -> tuple | None:
    """The outputs' values, or None if the footers don't hold them."""
    if not bound.is_aggregate or bound.where is not None or bound.group_by or table.path is None:
        return None
    items = [item for item, _ in bound.outputs]
    if table.footers is None:
        return _pushed(items, table)
    values = [_value(item, table) for item in items]
    return None if None in values else tuple(v for (v,) in values)


def _pushed(items: list[ast.AggregateItem], table: Table) -> tuple | None:
    """The same where the driver doesn't read the footers: tasks read them, wherever the files are.

    Strings are left out, as footers may hold cut bounds.
    """
    if any(i.func not in ("count", "min", "max") for i in items):
        return None
    if any(i.func != "count" and table.schema[i.column] is DataType.UTF8 for i in items):
        return None
    # nulls are refused when a table is opened, so that every COUNT counts rows
    made = [F.count(F.lit(1)) if i.func == "count" else getattr(F, i.func)(F.col(f"`{i.column}`")) for i in items]
    with settings(table.spark, CASE | PUSHED):
        found = table.spark.read.parquet(table.path).agg(*(c.alias(f"c{n}") for n, c in enumerate(made)))
        return tuple(found.first())


def _value(item: ast.AggregateItem, table: Table) -> tuple | None:
    """A tuple of the value, or None if it isn't known."""
    if item.func == "count":
        return (table.footers.rows,)
    if item.func not in ("min", "max"):
        return None
    groups = [g for g in table.footers.groups if g.rows]
    if not all(item.column in g.ranges for g in groups):
        return None
    pick = min if item.func == "min" else max
    found = pick((g.ranges[item.column][item.func == "max"] for g in groups), default=None)
    if found is not None and table.schema[item.column] is DataType.UTF8 and len(found) > MAX_STRING:
        return None
    return (found,)
