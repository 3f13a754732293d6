"""The corpus pipeline: filter, deduplicate, mix and pack documents.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; what it decides takes effect. All but the last return documents' columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import dedup, mixing, packing, quality, toxicity
from tessera.llm.scratch import Scratch
from tessera.llm.workers import fresh

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that score as clean, with all their columns.

    A null text scores as an empty one, which is clean; rows with a null doc_id are scored, too.
    Repeated rows go or stay together. An empty table gives an empty result.
    """
    grammar = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(docs, toxicity.score, grammar, lambda score: score < toxicity.THRESHOLD)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that score as good, with all their columns; nulls, repeats and empty tables as for drop_toxic."""
    trees = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(docs, quality.score, trees, lambda score: score >= quality.THRESHOLD)


def _kept(docs: DataFrame, score: Callable, model: object, keep: Callable[[Column], Column]) -> DataFrame:
    """docs whose score is to be kept; the score's column is none of docs' own."""
    name = fresh(docs, "score")
    return score(docs, model, name).where(keep(F.col(name))).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, with all its columns; rows with null ids and empty texts all stay."""
    return dedup.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes several times comes as often, with all its columns.

    Null texts have no words, a null source is a source of its own, repeated rows are
    mixed as rows of their own. An empty table gives an empty result.
    """
    mixed = mixing.mix(docs.withColumnsRenamed(own := {c: fresh(docs, f"own_{c}") for c in ("mix_shard", "mix_order") if c in docs.columns}))
    return mixed.drop("mix_shard", "mix_order").withColumnsRenamed({v: k for k, v in own.items()})


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all docs and their places. A null text is an empty one; ids may be null or repeat."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read back by the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name == STAGES[-1][0] else scratch.write(docs)
    return docs
