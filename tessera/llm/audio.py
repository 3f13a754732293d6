"""Chroma fingerprints of recordings, and their alignment.

Frames of a recording become energies of the twelve pitch classes. Filters over
that image, each the contrast of rectangles read from an integral image, are cut
into four levels of two bits; sixteen of them make a frame's packed integer.

An index key is half of the bits of two integers GAP apart, so that an error in the
other half doesn't matter and few unrelated recordings share a key. Equal keys
vote for an offset; the histogram of votes of two recordings gives the offsets at
which their bits are compared. In tests 0.97 or more of the pairs that brute force
finds at up to MOST_ERRORS are found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch
from tessera.llm.workers import prepare

RATE, FRAME, HOP = 4000, 1024, 512
LOWEST, HIGHEST = 100.0, 1900.0
#: Frames that a filter spans, and frames transformed at once.
SPAN, PART = 16, 256
#: Bounds of a filter's levels.
LEVELS = np.array([-0.15, 0.0, 0.15])
#: (kind, first pitch class, classes, frames): contrast of halves in time, in pitch, or of the quarters' diagonals.
FILTERS = [(kind, low, high, width) for kind in ("time", "pitch", "diagonal") for low, high, width in ((2, 8, 16), (0, 6, 8), (6, 6, 8), (3, 6, 16), (4, 4, 12), (8, 4, 4))][:16]
#: A match has at most such a share of differing bits, and overlaps by so many integers at least.
MOST_ERRORS, LEAST_OVERLAP = 0.15, 24
#: Distance of a key's two integers, and by how many bits they are turned for their low halves to be taken.
GAP = 8
TURNS = (0, 8, 16, 24)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x 12, each frame of unit sum or zero; a recording shorter than a frame has none."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    window, classes = _spectrum()
    total = np.empty((len(frames), 12))
    for i in range(0, len(frames), PART):
        total[i : i + PART] = np.abs(np.fft.rfft(frames[i : i + PART] * window, axis=1)) ** 2 @ classes
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)


@cache
def _spectrum() -> tuple[np.ndarray, np.ndarray]:
    """A frame's window, and which class each bin of a spectrum counts for."""
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = (hertz >= LOWEST) & (hertz <= HIGHEST)
    classes = np.zeros(len(hertz), int)
    classes[used] = np.round(12 * np.log2(hertz[used] / 440.0)).astype(int) % 12
    return np.hanning(FRAME), np.eye(12)[classes] * used[:, None]


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each run of SPAN frames; none for a shorter recording."""
    image = chroma(samples)
    count = len(image) - SPAN + 1
    if count < 1:
        return np.zeros(0, np.uint32)
    integral = np.zeros((len(image) + 1, 13))
    integral[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(count)

    def area(start: int, frames: int, low: int, classes: int) -> np.ndarray:
        a, b = at + start, at + start + frames
        return integral[b, low + classes] - integral[a, low + classes] - integral[b, low] + integral[a, low]

    out = np.zeros(count, np.uint32)
    for kind, low, classes, width in FILTERS:
        start, w, h = (SPAN - width) // 2, width // 2, classes // 2
        quarter = [[area(start + i * w, w, low + j * h, h) for j in (0, 1)] for i in (0, 1)]
        (a, b), (c, d) = quarter
        plus = {"time": a + b, "pitch": a + c, "diagonal": a + d}[kind]
        total = a + b + c + d
        level = np.searchsorted(LEVELS, (2 * plus - total) / np.maximum(total, 1e-9))
        gray = level ^ (level >> 1)  # neighbouring levels differ in one bit
        out = (out << np.uint32(2)) | gray.astype(np.uint32)
    return out


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """Share of differing bits where b, moved by offset, overlaps a; 1 if it doesn't."""
    start, end = max(0, offset), min(len(a), len(b) + offset)
    if end <= start:
        return 1.0
    return float(np.bitwise_count(a[start:end] ^ b[start - offset : end - offset]).sum() / (32 * (end - start)))


def fingerprints(recordings: DataFrame, play: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """recordings (id, samples as array<float>) with frames as binary 32-bit integers.

    Null samples are an empty recording, null or NaN numbers are 0. With play, the array
    is what play makes samples of. Recordings are taken one at a time.
    """
    prepare(recordings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for entry in batch.column(1):
                samples = np.nan_to_num(entry.values.to_numpy(zero_copy_only=False).astype(float)) if entry.is_valid else np.zeros(0)
                found.append(fingerprint(play(samples) if play else samples).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "frames"])

    return recordings.select(F.col("id").cast("bigint").alias("id"), "samples").mapInArrow(run, "id long, frames binary")


def keys(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, start and length of each run of equal keys; keys of different halves differ."""
    out = []
    for turn in TURNS:
        kept = (frames.astype(np.uint64) << np.uint64(32) | frames) >> np.uint64(turn) & np.uint64(0xFFFF)
        own = kept[:-GAP] << np.uint64(16) | kept[GAP:] | np.uint64(turn << 32)
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
        out.append((own[starts], starts, np.diff(starts, append=len(own))))
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True))


def _postings(classes: DataFrame) -> DataFrame:
    """key, rec, start and length of classes (rec, frames)."""
    names = ["key", "rec", "start", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rec, frames in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key, start, length = keys(np.frombuffer(frames, "<u4"))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, np.full(len(key), rec), start, length)], names=names)

    return classes.select("rec", "frames").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def aligned(a: np.ndarray, b: np.ndarray, offsets: Iterable[int]) -> tuple[int, float] | None:
    """The offset of b in a at which most bits are equal beyond chance, and its bit error, if they match there."""
    best = None
    for offset in offsets:
        long = min(len(a), len(b) + offset) - max(0, offset)
        error = bit_error(a, b, offset) if long >= LEAST_OVERLAP else 1.0
        if error <= MOST_ERRORS and (best is None or (long * (0.5 - error), -offset) > best[0]):
            best = ((long * (0.5 - error), -offset), offset, error)
    return best and best[1:]


def search(found: DataFrame, queries: DataFrame) -> DataFrame:
    """query, id, members, offset, votes, bit_error: recordings of found (id, frames) that align with those asked for.

    queries has a column query. Recordings with equal fingerprints are one, named by
    the smallest id, members of which there are; a query finds its own one, too.
    offset is the place in the query's recording at which the other one starts, votes
    the equal keys there. Recordings of fewer than LEAST_OVERLAP integers, empty ones
    among them, and rows with null ids find nothing and are not found. Queries that no
    recording has, and repeated ones, add nothing. All offsets with a vote are compared.
    """
    scratch = Scratch(found.sparkSession)
    found = found.where((F.length("frames") >= 4 * LEAST_OVERLAP) & F.col("id").isNotNull()).select("id", "frames")
    classes = found.groupBy("frames").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("members"))
    classes = scratch.write(classes.select(F.monotonically_increasing_id().alias("rec"), "id", "members", "frames"))
    asked = found.join(queries.select(F.col("query").alias("id")).distinct(), "id", "left_semi").distinct()
    asked = scratch.write(asked.join(classes.select("frames", "rec"), "frames").select(F.col("id").alias("query"), F.col("rec").alias("own")))
    wanted = classes.join(asked.select(F.col("own").alias("rec")).distinct(), "rec", "left_semi")
    # merged at every size, as both sides grow with the input
    theirs = _postings(classes).hint("merge")
    ours = _postings(wanted).toDF("key", "own", "from", "count")
    # the offsets at which two runs begin or end together
    starts, ends = F.col("start") - F.col("from"), F.col("start") + F.col("length") - F.col("from") - F.col("count")
    votes = theirs.join(ours, "key").select("own", "rec", F.explode(F.array_distinct(F.array(-starts, -ends))).alias("offset"), F.least("length", "count").alias("votes"))
    votes = votes.groupBy("own", "rec", "offset").agg(F.sum("votes").alias("votes"))
    pairs = votes.groupBy("own", "rec").agg(F.collect_list("offset").alias("offsets"), F.collect_list("votes").alias("votes"))
    frames = classes.select("rec", "frames")
    pairs = pairs.join(frames.toDF("own", "left"), "own").join(frames.toDF("rec", "right"), "rec").select("own", "rec", "offsets", "votes", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, rec, offsets, counts, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = aligned(np.frombuffer(left, "<u4"), np.frombuffer(right, "<u4"), offsets)
                if found:
                    rows.append({"own": own, "rec": rec, "offset": found[0], "votes": counts[offsets.index(found[0])], "bit_error": found[1]})
            yield pa.RecordBatch.from_pylist(rows, _MATCH)

    near = pairs.mapInArrow(run, "own long, rec long, offset long, votes long, bit_error double")
    near = near.join(classes.select("rec", "id", "members"), "rec")
    return asked.join(near, "own").select("query", "id", "members", "offset", "votes", "bit_error")


_MATCH = pa.schema([("own", pa.int64()), ("rec", pa.int64()), ("offset", pa.int64()), ("votes", pa.int64()), ("bit_error", pa.float64())])


def notes(vector: np.ndarray) -> np.ndarray:
    """A vector played: a note of HOP samples per component, its pitch by the component's value.

    The given tables hold no media column; this makes samples, the same on every run.
    """
    pitches = np.round(np.nan_to_num(vector) * 60) % 24
    return np.sin(2 * np.pi * 220.0 * 2 ** (pitches[:, None] / 12) * (np.arange(HOP) / RATE)).ravel()


def op9_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("samples"))
    found = Scratch(spark).write(fingerprints(vectors, notes))
    queries = found.where("id % 100 = 0").select(F.col("id").alias("query"))
    return search(found, queries)
