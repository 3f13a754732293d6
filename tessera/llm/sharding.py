"""Sharding by jump consistent hashing.

A key jumps through shard counts: from shard b the next jump goes to
floor((b + 1) / u) with u uniform in (0, 1], drawn from the key and b. Its shard
among n is the last stop below n, so one more shard changes only the keys whose
next stop is that shard. The draws depend on the key and b alone, so no ring or
table is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.scratch import Scratch
from tessera.llm.workers import fresh

#: Rows numbered by one task, about.
SLOT_ROWS = 65_536
SHARDS = 40


def _next_stop(key: Column, shard: Column) -> Column:
    """A jump's end as a double; over any shard count if the draw is small."""
    draw = F.shiftrightunsigned(F.xxhash64(key, shard.cast("bigint")), 33) + 1  # 1 to 2**31
    return F.floor((shard + 1).cast("double") * F.lit(2.0**31) / draw.cast("double")).cast("bigint")


def jump_shards(key: Column, counts: list[int]) -> Column:
    """A struct with the shard s0, s1, ... of key for each of the shard counts; null keys hash like any other.

    Each step ends at a later shard, so as many steps as the largest count reach
    it; a key takes about its logarithm and rests from there on.
    """
    most = max(counts)
    start = F.struct(
        F.lit(0).cast("bigint").alias("next"), *(F.lit(0).cast("bigint").alias(f"s{i}") for i in range(len(counts)))
    )

    def step(state: Column, _: Column) -> Column:
        here = state["next"]
        moved = F.struct(
            _next_stop(key, here).alias("next"),
            *(F.when(here < n, here).otherwise(state[f"s{i}"]).alias(f"s{i}") for i, n in enumerate(counts)),
        )
        return F.when(here < most, moved).otherwise(state)

    return F.aggregate(F.sequence(F.lit(0), F.lit(most)), start, step)


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """docs with columns shard, grown_shard (with one more shard) and slot, a place in the shard from 0.

    Columns of those names are replaced. Slots are gapless and follow a hash of
    the key: shards are cut into buckets by that hash, rows are numbered in each
    bucket, and bucket sizes are summed up beforehand, so no task sees a whole
    shard. Rows with the same key share a shard by law; other columns salt their
    buckets. Rows alike in all columns are numbered in any order. An empty table
    gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    docs = docs.drop("shard", "grown_shard", "slot")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    jump, hash_, bucket, count, start, place = (fresh(docs, n) for n in ("jump", "hash", "bucket", "count", "start", "place"))
    plain = [f.name for f in docs.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)]
    buckets = max(1, -(-docs.count() // SLOT_ROWS))
    placed = docs.withColumns({jump: jump_shards(F.col(f"`{key}`"), [shards, shards + 1]), hash_: F.xxhash64(*(F.col(f"`{c}`") for c in plain))})
    number = lambda i: F.col(jump)[f"s{i}"].cast("int")
    placed = placed.withColumns({"shard": number(0), "grown_shard": number(1), bucket: F.pmod(F.shiftright(hash_, 20), F.lit(buckets))})
    sizes = placed.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias(count))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", bucket, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy("shard", bucket).orderBy(hash_, F.col(f"`{key}`"))
    numbered = placed.withColumn(place, F.row_number().over(inside)).join(starts, ["shard", bucket])
    slot = (F.col(start) + F.col(place) - 1).alias("slot")
    return numbered.select(*columns, "shard", "grown_shard", slot)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; rows of a shard are spread over files by slot."""
    files = F.floor(F.col("slot") / SLOT_ROWS)
    sharded.repartition(F.col("shard"), files).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # narrow rows, written once: they are counted, dealt and numbered
    placed = shard(Scratch(spark).write(rows), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
