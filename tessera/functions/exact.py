"""Exact integer totals.

sum(bigint) fails on a total that only leaves the range for a while, and avg
adds doubles. Three sums of 21- and 22-bit parts stay in the JVM's fast path, and
none can overflow below 2**41 rows a group.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = 21
_MASK = (1 << _PART) - 1


def _total(x: Column) -> Column:
    """Sum as decimal(38,0); null over no rows."""
    high = F.sum(F.shiftright(x, 2 * _PART)).cast("decimal(20,0)")
    middle = F.sum(F.shiftright(x, _PART).bitwiseAND(F.lit(_MASK))).cast("decimal(20,0)")
    low = F.sum(x.bitwiseAND(F.lit(_MASK))).cast("decimal(20,0)")
    scale = lambda bits: F.lit(1 << bits).cast("decimal(14,0)")
    return high * scale(2 * _PART) + middle * scale(_PART) + low


def exact_sum(x: Column) -> Column:
    """Sum as bigint; an error that names the overflow if the final total does not fit."""
    total = _total(x)
    fits = total.between(F.lit(str(-(2**63))).cast("decimal(20,0)"), F.lit(str(2**63 - 1)).cast("decimal(20,0)"))
    return F.when(total.isNull() | fits, total.cast("bigint")).otherwise(
        F.raise_error(F.lit("integer overflow in SUM")).cast("bigint")
    )


def exact_avg(x: Column) -> Column:
    """The exact sum as a double, divided by the count; null over no rows."""
    count = F.count(x)
    return F.when(count > 0, _total(x).cast("double") / count.cast("double"))
