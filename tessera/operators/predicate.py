"""A predicate as one Column, so that Catalyst can push it into the scan."""

from __future__ import annotations

from collections.abc import Callable
from operator import and_, eq, ge, gt, le, lt, ne, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans import ast

_OPS: dict[str, Callable] = {"=": eq, "!=": ne, "<": lt, "<=": le, ">": gt, ">=": ge}


def source_column(name: str) -> Column:
    return F.col(f"`{name}`")


def _literal(value: ast.Literal) -> Column:
    return F.lit(value) if isinstance(value, str) else F.lit(value).cast("bigint")


def _balanced(columns: list[Column], fold: Callable) -> Column:
    """A tree of logarithmic depth: Catalyst walks predicates recursively."""
    while len(columns) > 1:
        columns = [fold(*columns[i : i + 2]) if i + 1 < len(columns) else columns[i] for i in range(0, len(columns), 2)]
    return columns[0]


def predicate(expr: ast.Expr) -> Column:
    if isinstance(expr, ast.Not):
        return ~predicate(expr.operand)
    if isinstance(expr, ast.And | ast.Or):
        return _balanced([predicate(e) for e in expr.operands], and_ if isinstance(expr, ast.And) else or_)
    column = source_column(expr.column)
    if isinstance(expr, ast.In):
        return column.isin([_literal(v) for v in expr.values])
    if isinstance(expr, ast.Between):
        return column.between(_literal(expr.low), _literal(expr.high))
    return _OPS[expr.op](column, _literal(expr.value))
