"""Documents in ranges of ascending id, each sorted in one task; an id of very many rows has several."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A range has about so many documents, or more beyond MAX_RANGES ranges: their bounds
#: travel through the driver. Sorting a large range spills.
RANGE_ROWS, MAX_RANGES = 8_192, 65_536


@dataclass(frozen=True)
class Ranges:
    """Ranges by ascending (id, tie), nulls first; tie is a hash that spreads the rows of one id.

    An id that fills several ranges by itself, or null, gets slices of its own by tie.
    """

    #: Ascending ids that end all ranges but the last.
    bounds: list[int]
    #: By place in bounds, the slices of the ids that need some; the slices of null, 0 where it needs none.
    hot: dict[int, int]
    nulls: int

    @property
    def count(self) -> int:
        return len(self.bounds) + 1 + sum(self.hot.values()) + self.nulls

    def of(self, key: Column, tie: Column) -> Column:
        """The number of a row's range, an int from 0."""
        found = range_of(key, self.bounds)
        if self.hot:
            at = lambda values: F.element_at(F.split(F.lit(",".join(map(str, values))), ","), found + 1).try_cast("bigint")
            slices = [self.hot.get(i, 0) for i in range(len(self.bounds) + 1)]
            own = F.when(key == at([b if m else "" for b, m in zip([*self.bounds, ""], slices, strict=True)]), 1 + _slice(tie, at(slices)))
            found = found + at([0, *accumulate(slices[:-1])]) + F.coalesce(own, F.lit(0))
        if self.nulls:
            found = F.when(key.isNull(), _slice(tie, F.lit(self.nulls))).otherwise(found + self.nulls)
        return found.cast("int")


def _slice(tie: Column, slices: Column) -> Column:
    """Which of so many equal slices of all 64-bit integers tie is in."""
    return F.shiftright((F.shiftright(tie, 32) + (1 << 31)) * slices.cast("bigint"), 32)


def ranges_of(docs: DataFrame, key: str = "doc_id") -> Ranges:
    """Ranges of about RANGE_ROWS rows of docs; reads the ids alone. Rows alike in id and tie share a range."""
    rows, known = docs.agg(F.count(F.lit(1)), F.count(key)).first()
    wanted = min(MAX_RANGES, max(1, -(-known // RANGE_ROWS)))
    nulls = min(MAX_RANGES, -(-(rows - known) // RANGE_ROWS))
    found = []
    if wanted > 1:
        shares = [i / wanted for i in range(1, wanted)]
        found = docs.agg(F.percentile_approx(key, shares, max(10_000, 10 * wanted))).first()[0]
    times = Counter(found)
    bounds = sorted(times)
    # an id that ends several ranges fills all of them but the first and perhaps a part of one more
    hot = {i: times[b] for i, b in enumerate(bounds) if times[b] > 1}
    return Ranges(bounds, hot, nulls if nulls > 1 else 0)


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are below key, as int; 0 for null. Two steps of at most 256 comparisons."""
    if not bounds:
        return F.lit(0)
    width = max(1, -(-len(bounds) // 256))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    array = lambda of: F.split(F.lit(",".join(map(str, of))), ",").cast("array<bigint>")
    below = lambda of: F.size(F.filter(of, lambda b: b < key))
    full = below(array([g[-1] for g in groups]))  # groups that are below key as a whole
    text = ";".join(",".join(map(str, g)) for g in groups)
    inside = F.split(F.element_at(F.split(F.lit(text), ";"), F.least(full + 1, F.lit(len(groups)))), ",").cast("array<bigint>")
    rest = F.when(full < len(groups), below(inside)).otherwise(0)
    return F.coalesce(F.when(key.isNotNull(), full * width + rest), F.lit(0)).cast("int")
