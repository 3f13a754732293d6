"""Document fingerprints by winnowing.

A text's code points give a rolling hash of each k-gram. Of every window of
consecutive hashes the smallest is chosen, of equal ones the rightmost. Texts
that share at least K + WINDOW - 1 characters in a row share a chosen hash, and
the positions kept tell where. A text of fewer k-grams than a window gives its
smallest hash, one shorter than a k-gram the hash of all of it, an empty one nothing.

Shorter texts have smaller windows and very short ones smaller k-grams, see scale().
Two texts are compared at the smaller k-gram and the larger window of their scales:
what a window chooses, every smaller window chooses too. So a text of seven
characters or more has a hash in common with any text that keeps half of it in a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ranges
from tessera.llm.workers import prepare

#: Powers of two: hashes and minima double their width step by step.
K, WINDOW = 16, 64
#: The k-gram of texts of fewer than 4 * K code points, whose halves hold few longer ones.
SHORT_K = 4
#: Code points of a text for each hash that its window spans, up to WINDOW.
WINDOW_SHARE = 16
#: Windows looked at together; bounds memory for very long texts.
CHUNK = 1 << 20
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_PLACE_BITS = 24


def scale(chars: int) -> tuple[int, int]:
    """(k, window) of a text of so many code points."""
    window = min(WINDOW, max(1, chars // WINDOW_SHARE))
    return K if chars >= 4 * K else SHORT_K, 1 << window.bit_length() - 1


def _hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k codes: their polynomial in _BASE, mixed."""
    found, factor, width = codes.astype(np.uint64) * np.uint64(_MIX), _BASE, 1
    while width < k:
        found = found[:-width] * np.uint64(factor) + found[width:]
        factor, width = factor * factor % 2**64, 2 * width
    found ^= found >> np.uint64(29)
    return found * np.uint64(_MIX)


def winnow(text: str, at_scale: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the chosen k-grams, hashes of 40 bits, positions in code points, ascending.

    The scale is the text's own where none is given.
    """
    k, window = at_scale or scale(len(text))
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(codes) < k:
        # no padding character: 0x110000 and more are not code points
        codes = np.concatenate([codes, np.arange(0x110000, 0x110000 + k - len(codes), dtype=np.uint32)])
    grams = len(codes) - k + 1
    chunks = range(0, max(1, grams - window + 1), CHUNK)
    found = [_chosen(codes[at : at + CHUNK + window + k - 2], at, k, window) for at in chunks]
    hashes, places = (np.concatenate(x) for x in zip(*found, strict=True))
    fresh = np.flatnonzero(np.diff(places, prepend=-1))
    return hashes[fresh], places[fresh]


def _chosen(codes: np.ndarray, at: int, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    hashes = _hashes(codes, k)
    most = (1 << _PLACE_BITS) - 1
    # later places have smaller low bits, so the rightmost of equal hashes is the minimum
    low = np.arange(most, most - len(hashes), -1, dtype=np.int64).astype(np.uint64)
    least = (hashes & ~np.uint64(most)) | low
    if len(least) < window:
        least = least.min(keepdims=True)
    else:
        width = 1
        while width < window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = least[np.flatnonzero(np.diff(least, prepend=~least[:1]))]
    places = most - (least & np.uint64(most)).astype(np.int64)
    return least >> np.uint64(_PLACE_BITS), places + at


def as_text(found: tuple[np.ndarray, np.ndarray]) -> str:
    """position:hash in hexadecimal, by position."""
    return " ".join(f"{p}:{h:010x}" for h, p in zip(found[0].tolist(), found[1].tolist(), strict=True))


class Print:
    """A text with its fingerprint and the hashes in it."""

    def __init__(self, text: str):
        self.text, self.scale = text, scale(len(text))
        self.found = winnow(text, self.scale)
        self.hashes = set(self.found[0].tolist())

    def hashes_at(self, at_scale: tuple[int, int]) -> set[int]:
        return self.hashes if at_scale == self.scale else set(winnow(self.text, at_scale)[0].tolist())


def likeness(a: Print, b: Print) -> float:
    """Jaccard similarity of the hashes at the scale that a and b have in common; two empty texts are alike."""
    common = min(a.scale[0], b.scale[0]), max(a.scale[1], b.scale[1])
    one, other = a.hashes_at(common), b.hashes_at(common)
    return len(one & other) / len(one | other) if one or other else 1.0


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, hashes and positions (arrays) of each row; a null text is empty."""
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [winnow(t) for t in texts]
            arrays = [
                batch.column(0),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())),
                pa.array([p for _, p in found], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "n_chars", "hashes", "positions"])

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(
        run, f"`{key}` {kind}, n_chars long, hashes array<long>, positions array<long>"
    )


_EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, and their likeness and that to the next document's.

    The next document is the one with the next lower doc_id (of equal doc_ids in
    the order of a hash of the text, null last), after the last the first. The
    edited text has the last floor(n_chars / 2) code points replaced by the first
    as many of the next document. Ranges of doc_id are sorted by one task each; the
    first document of a range also goes to the range that it follows.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt, tie = ranges.ranges_of(docs), F.xxhash64("text")
    # ranges ascend where documents descend, but for the tie
    placed = docs.withColumn("range", dealt.of(F.col("doc_id"), F.bitwise_not(tie)))
    # a range's first row: the highest doc_id there, of equal ones the smallest hash. There are
    # a few times MAX_RANGES at most, so they travel through the driver and no join moves the texts
    first = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", (-tie.cast("decimal(20,0)")).alias("tie")))
    firsts = {r.range: r.first for r in placed.groupBy("range").agg(first.alias("first")).collect()}
    order = sorted(firsts)
    above = dict(zip(order, order[1:] + order[:1], strict=True))
    of = lambda values: F.element_at(
        F.split(F.lit(",".join(str(values.get(r, "")) for r in range(dealt.count))), ","), F.col("range") + 1
    ).try_cast("bigint")
    is_first = F.col("doc_id").eqNullSafe(of({r: f.doc_id for r, f in firsts.items() if f.known}))
    is_first &= tie == of({r: -int(f.tie) for r, f in firsts.items()})
    placed = placed.withColumn("also", F.when(is_first, of(above).cast("int")))
    own = F.struct(F.col("range"), F.lit(0).alias("carried"))
    carried = F.struct(F.col("also").alias("range"), F.lit(1).alias("carried"))
    copies = F.filter(F.array(own, carried), lambda c: c["range"].isNotNull())
    rows = placed.select("doc_id", "text", F.explode(copies).alias("at")).select("at.range", "at.carried", "doc_id", "text")
    rows = rows.repartitionById(dealt.count, F.col("range"))
    rows = rows.sortWithinPartitions("range", "carried", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return rows.mapInArrow(_compare, _EDITS)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; a carried row ends its range and is only looked at as the next one."""
    before = None
    names = [part.split()[0] for part in _EDITS.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        columns = (batch.column(i).to_pylist() for i in range(4))
        for where, carried, doc_id, text in zip(*columns, strict=True):
            here = (where, doc_id, Print(text))
            if before is not None and before[0] == where:
                out.append(_row(before, here))
            before = None if carried else here
        arrays = [pa.array(column) for column in zip(*out, strict=True)] if out else []
        if out:
            arrays[0] = pa.array([r[0] for r in out], pa.int64())
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def _row(here: tuple, after: tuple) -> tuple:
    _, doc_id, own = here
    half = len(own.text) // 2
    edited = Print(own.text[: len(own.text) - half] + after[2].text[:half])
    return (
        doc_id,
        len(own.text),
        hashlib.sha256(edited.text.encode()).hexdigest(),
        as_text(own.found),
        as_text(edited.found),
        likeness(own, edited),
        likeness(own, after[2]),
    )


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
