"""Values and results as text."""

from __future__ import annotations

import csv
from decimal import Decimal
from typing import TextIO


def render_value(value) -> str:
    """NULL, integers and strings as they are; floats in the fewest digits, without exponent or .0."""
    if value is None:
        return "NULL"
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return {"nan": "NaN", "inf": "inf", "-inf": "-inf"}[repr(value)]
        text = format(Decimal(repr(value)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    return str(value)


def render_table(names: list[str], rows: list[tuple]) -> str:
    """Aligned columns, a rule under the header, and the row count."""
    cells = [names, *([render_value(v) for v in row] for row in rows)]
    widths = [max(len(row[i]) for row in cells) for i in range(len(names))]
    numeric = [bool(rows) and all(isinstance(r[i], int | float | None) for r in rows) for i in range(len(names))]
    line = lambda row: "  ".join(
        c.rjust(w) if n else c.ljust(w) for c, w, n in zip(row, widths, numeric, strict=True)
    ).rstrip()
    body = [line(cells[0]), "  ".join("-" * w for w in widths), *map(line, cells[1:])]
    return "\n".join([*body, f"({len(rows)} row{'' if len(rows) == 1 else 's'})"])


def write_csv(names: list[str], rows: list[tuple], out: TextIO) -> None:
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(names)
    writer.writerows([render_value(v) for v in row] for row in rows)


def render_bytes(count: int) -> str:
    size, unit = float(count), "B"
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):  # noqa: B007
        if size < 1024 or unit == "TiB":
            break
        size /= 1024
    return f"{count} B" if unit == "B" else f"{size:.2f} {unit}"
