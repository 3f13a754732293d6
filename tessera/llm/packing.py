"""Best-fit packing of documents into sequences of a fixed capacity.

Documents above a third of the capacity share a sequence with one other such at
most: each, largest first, is matched with the largest that still fits. Smaller
documents, largest first, then go to the tightest gap, or open a sequence.

Only lengths matter, so the packing is planned on the histogram of all lengths,
which has as many entries as the capacity at most, whatever the number of rows:
equal lengths are matched and placed many at a time. Each row then finds its
place by its rank among the rows of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.scratch import Scratch
from tessera.llm.tokens import SpaceTokenizer, tokenizer
from tessera.llm.workers import fresh, prepare

CAPACITY = 2048
END_ID = 0
#: Rows of one length that are ranked in one task, about.
RANKED = 1 << 16


class Plan:
    """Where the items of each length go, by their ranks.

    A step (length, first rank, end, each, first sequence, offset) puts the items of
    these ranks into successive sequences, each of them side by side.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.steps: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self._left = {n: c for n, c in counts.items() if c}
        self._rank = dict.fromkeys(self._left, 0)
        self._capacity = capacity
        #: gap to runs (first sequence, how many) that have it, and the gaps as bits
        self._gaps: dict[int, list[tuple[int, int]]] = {}
        self._open = 0
        self._match_large()
        for length in sorted(self._left, reverse=True):
            self._fit(length)

    def _put(self, length: int, items: int, each: int, first: int, gap: int) -> None:
        at = self._rank[length]
        self.steps.append((length, at, at + items, each, first, self._capacity - gap))
        self._rank[length] += items
        self._left[length] -= items
        if not self._left[length]:
            del self._left[length]

    def _leave(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            self._gaps.setdefault(gap, []).append((first, count))
            self._open |= 1 << gap

    def _match_large(self) -> None:
        capacity = self._capacity
        waiting = sum(1 << n for n in self._left if 3 * n > capacity)
        while waiting:
            one = waiting.bit_length() - 1
            # the largest that fits beside it; itself only if there are two
            others = waiting if self._left[one] > 1 else waiting & ~(1 << one)
            other = (others & ((1 << (capacity - one + 1)) - 1)).bit_length() - 1
            if other == one:
                count = self._left[one] // 2
                self._put(one, 2 * count, 2, self.sequences, capacity)
            else:
                count = min(self._left[one], self._left[other]) if other > 0 else self._left[one]
                self._put(one, count, 1, self.sequences, capacity)
                if other > 0:
                    self._put(other, count, 1, self.sequences, capacity - one)
            self._leave(capacity - one - max(other, 0), self.sequences, count)
            self.sequences += count
            for n in (one, max(other, 0)):
                if n not in self._left:
                    waiting &= ~(1 << n)

    def _fit(self, length: int) -> None:
        while length in self._left:
            fitting = self._open >> length
            left = self._left[length]
            if not fitting:
                needed = -(-left // (self._capacity // length))
                self._leave(self._capacity, self.sequences, needed)
                self.sequences += needed
                continue
            gap = length + (fitting & -fitting).bit_length() - 1
            first, count = self._gaps[gap].pop()
            if not self._gaps[gap]:
                self._open &= ~(1 << gap)
            # a sequence is the tightest for the next item of this length, too, until it is full
            each = min(gap // length, left)
            used = min(count, left // each)
            self._put(length, used * each, each, first, gap)
            self._leave(gap, first + used, count - used)
            self._leave(gap - each * length, first, used)

    def places(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of items."""
        steps = np.array(sorted(self.steps), np.int64).reshape(-1, 6)
        width = int(steps[:, 2].max(initial=0)) + 1
        # a step is found by length and rank as one number; Python's integers where that is too large for 64 bits
        kind = np.int64 if width * (self._capacity + 1) < 2**63 else object
        at = np.searchsorted(steps[:, 0].astype(kind) * width + steps[:, 1], lengths.astype(kind) * width + ranks, side="right") - 1
        _, start, _, each, first, offset = steps[at].T
        within = ranks - start
        return first + within // each, offset + within % each * lengths


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each item; lengths are 1 to capacity."""
    order = np.argsort(lengths, kind="stable")
    found, starts, counts = np.unique(lengths[order], return_index=True, return_counts=True)
    ranks = np.empty(len(lengths), np.int64)
    ranks[order] = np.arange(len(lengths)) - np.repeat(starts, counts)
    return Plan(dict(zip(found.tolist(), counts.tolist(), strict=True)), capacity).places(lengths, ranks)


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all are full but maybe the first."""
    head = length % capacity
    starts = [0] * bool(head) + list(range(head, length, capacity))
    return [(s, head if s == 0 and head else capacity) for s in starts]


_PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and ids as binary if asked for.

    A null or empty text is the end id alone. doc_id may be null or repeat.
    """
    prepare(docs.sparkSession)
    schema = T.StructType([*_PIECES.fields, *[T.StructField("ids", T.BinaryType())] * keep_ids])
    end = np.array([END_ID], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(SpaceTokenizer, vocabulary).encode
        for batch in batches:
            columns: list[list] = [[] for _ in schema.fields]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                data = np.concatenate([ids, end])
                for n, (start, length) in enumerate(cut(len(data), capacity)):
                    own = data[start : start + length].tobytes()
                    row = (doc_id, n, start, length, zlib.crc32(own), *[own] * keep_ids)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found, which has a column length of 1 to capacity, with sequence_id and offset.

    Sequence ids are 0 and up without gaps. All columns are kept as they are, but for
    two of these names, which are replaced. Repeated rows are packed as often. An empty
    table gives an empty result.
    """
    prepare(found.sparkSession)
    found = found.drop("sequence_id", "offset")
    row, part, base, rank = (fresh(found, name) for name in ("row", "part", "base", "rank"))
    names = found.columns
    # written once, so that row numbers hold
    found = Scratch(found.sparkSession).write(found.withColumn(row, F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in found.groupBy(F.col("length").cast("bigint")).count().collect()}
    plan = Plan(counts, capacity)
    # a length's rows are ranked in parts; a part's ranks begin after those of the parts before
    parts = F.lit([-(-counts.get(n, 0) // RANKED) or 1 for n in range(capacity + 1)])
    count = F.get(parts, F.col("length").cast("int"))
    dealt = found.withColumn(part, F.pmod(F.xxhash64(row), count))
    sizes = dealt.groupBy("length", part).agg(F.count(F.lit(1)).alias(base))
    before = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("length", part).orderBy(row)) - 1
    ranked = dealt.withColumn(rank, within).join(bases, ["length", part]).withColumn(rank, (F.col(rank) + F.col(base)).cast("bigint"))
    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    schema = T.StructType([*found.select(*(F.col(f"`{c}`") for c in names)).schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", rank))
            placed = [pa.array(x) for x in plan.places(lengths, ranks)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *placed], names=[*names, "sequence_id", "offset"])

    return ranked.select(*(F.col(f"`{c}`") for c in names), rank).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of docs with its place: tokenized once, then packed by length alone."""
    return pack(pieces(docs, vocabulary, capacity), capacity)


def sequences(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids as binary, and the pieces in them."""
    packed = pack(pieces(docs, vocabulary, capacity, keep_ids=True), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "start", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    return grouped.select("sequence_id", ids.alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("pieces"))


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
