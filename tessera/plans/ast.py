"""Statement tree. It is public: a statement may be built without SQL text."""

from __future__ import annotations

from dataclasses import dataclass, field

Literal = int | str


@dataclass(frozen=True)
class Compare:
    """column op literal; op is one of = != < <= > >=."""

    column: str
    op: str
    value: Literal


@dataclass(frozen=True)
class In:
    column: str
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Between:
    column: str
    low: Literal
    high: Literal


@dataclass(frozen=True)
class Not:
    operand: Expr


@dataclass(frozen=True)
class And:
    operands: tuple[Expr, ...]


@dataclass(frozen=True)
class Or:
    operands: tuple[Expr, ...]


Expr = Compare | In | Between | Not | And | Or

AGGREGATES = ("count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class ColumnItem:
    name: str
    alias: str | None = None

    @property
    def output_name(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class AggregateItem:
    """func(column), or count(*) when column is None."""

    func: str
    column: str | None
    alias: str | None = None

    @property
    def output_name(self) -> str:
        return self.alias or f"{self.func}({self.column or '*'})"


@dataclass(frozen=True)
class OrderKey:
    """target: an output position from 1, or a name."""

    target: int | str
    descending: bool = False


@dataclass(frozen=True)
class Select:
    """items None means *."""

    items: tuple[ColumnItem | AggregateItem, ...] | None
    table: str = "t"
    where: Expr | None = None
    group_by: tuple[str, ...] = ()
    order_by: tuple[OrderKey, ...] = field(default=())
    limit: int | None = None

    @property
    def is_aggregate(self) -> bool:
        return bool(self.group_by) or any(isinstance(i, AggregateItem) for i in self.items or ())


FLIPPED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
