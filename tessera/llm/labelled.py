"""Labelled documents to learn from, and those held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most: those with the smallest hashes.
MAX_TRAIN = 20_000


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training(docs: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most MAX_TRAIN labelled rows that are not held out.

    Null labels and ids are left out. Of an id's labels the largest counts, of its
    texts the first by code units, so that an id is one row however often it repeats.
    Whatever the labels' number, this many rows at most are broadcast.
    """
    known = labels.select("doc_id", F.col(target).alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
