"""Projection, grouping, order and limit of a bound statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.exact import exact_avg, exact_sum
from tessera.operators.predicate import predicate, source_column
from tessera.plans import ast
from tessera.plans.binder import Bound
from tessera.sources.table import POSITION, Table

#: Spark takes a limit as a 32-bit integer; rows are numbered for a larger one.
MAX_LIMIT = 2**31 - 1


def compile_statement(bound: Bound, table: Table, ordered: bool) -> DataFrame:
    """The statement as a lazy DataFrame.

    ordered: rows come in the language's order (input order or group key order,
    and ties so) even where there is neither ORDER BY nor LIMIT to need it.
    """
    ordered = ordered or bool(bound.order_by) or bound.limit is not None
    frame, hidden = _rows(bound, table, ordered)
    if ordered:
        keys = [_key(k.output, k.column, bound) for k in bound.order_by]
        keys = [k.desc_nulls_last() if o.descending else k.asc_nulls_first() for k, o in zip(keys, bound.order_by, strict=True)]
        keys += [F.col(h).asc_nulls_first() for h in hidden]
        frame = _cut(frame, keys, bound.limit)
    return frame.select(*_outputs(bound)).toDF(*(n for _, n in bound.outputs))


def compile_unsorted(bound: Bound, table: Table) -> tuple[DataFrame, int]:
    """A statement without ORDER BY or LIMIT: its outputs, then the columns whose order is the language's, and how many outputs."""
    frame, hidden = _rows(bound, table, True)
    outputs = _outputs(bound)
    return frame.select(*outputs, *hidden), len(outputs)


def _outputs(bound: Bound) -> list[str]:
    return [f"__o{i}" for i in range(len(bound.outputs))]


def _rows(bound: Bound, table: Table, ordered: bool) -> tuple[DataFrame, list[str]]:
    return _aggregate(bound, table) if bound.is_aggregate else _project(bound, table, ordered)


def _cut(frame: DataFrame, keys: list[Column], limit: int | None) -> DataFrame:
    """frame sorted by keys, the first limit rows of it."""
    if limit is not None and limit > MAX_LIMIT:
        # a running count is a single task's work, so only if there is something to cut
        if frame.count() > limit:
            place = F.count(F.lit(1)).over(Window.orderBy(*(keys or [F.lit(0)])).rowsBetween(Window.unboundedPreceding, 0))
            frame = frame.withColumn("__place", place).where(F.col("__place") <= limit).drop("__place")
        limit = None
    frame = frame.orderBy(*keys) if keys else frame
    return frame if limit is None else frame.limit(limit)


def _key(output: int | None, column: str | None, bound: Bound) -> Column:
    return F.col(f"__o{output}") if output is not None else F.col(f"__s{list(bound.schema).index(column)}")


def _filtered(bound: Bound, table: Table, positions: bool) -> DataFrame:
    frame = table.frame(positions)
    return frame if bound.where is None else frame.filter(predicate(bound.where))


def _project(bound: Bound, table: Table, ordered: bool) -> tuple[DataFrame, list[str]]:
    """Outputs are named by place, so that equal names don't clash; sort columns come along hidden."""
    columns = [source_column(item.name).alias(f"__o{i}") for i, (item, _) in enumerate(bound.outputs)]
    names = list(bound.schema)
    sources = dict.fromkeys(k.column for k in bound.order_by if k.column is not None)
    columns += [source_column(n).alias(f"__s{names.index(n)}") for n in sources]
    hidden = list(POSITION) if ordered else []
    return _filtered(bound, table, ordered).select(*columns, *hidden), hidden


def _aggregate(bound: Bound, table: Table) -> tuple[DataFrame, list[str]]:
    frame = _filtered(bound, table, False)
    keys = list(dict.fromkeys(bound.group_by))
    grouped = [source_column(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    made = [_function(item).alias(f"__o{i}") for i, (item, _) in enumerate(bound.outputs) if isinstance(item, ast.AggregateItem)]
    if not keys:
        return frame.agg(*made), []
    used = [source_column(n) for n in sorted(bound.columns)]
    frame = frame.select(*used).groupBy(*grouped)
    frame = frame.agg(*made) if made else frame.agg(F.lit(0).alias("__none"))
    copies = [F.col(f"__k{keys.index(item.name)}").alias(f"__o{i}") for i, (item, _) in enumerate(bound.outputs) if isinstance(item, ast.ColumnItem)]
    return frame.select("*", *copies), [f"__k{i}" for i in range(len(keys))]


def _function(item: ast.AggregateItem) -> Column:
    if item.column is None:
        return F.count(F.lit(1))
    column = source_column(item.column)
    return {"count": F.count, "sum": exact_sum, "avg": exact_avg, "min": F.min, "max": F.max}[item.func](column)
