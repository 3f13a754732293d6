"""Mixing sources to target weights by a splitting tree.

Each source gets a share of the words by weight, at most MAX_REPEATS times its
own size. A source is cut into blocks of documents by a hash; a long document is a
block of its own. Whole passes take every block; the rest of the target takes blocks
in a permuted order, skipping long documents that don't fit, and documents of one
last block until the target is met. Every (pass, block) of a
source is one draw. A tree splits all draws among the output shards: at each
node a random subset of exact size goes left, so the counts per source on the
left are one multivariate hypergeometric sample and those on the right the rest.
Block identities are then dealt by each source's permutation, in runs per shard,
and each shard is put in a hash order of its own.

All randomness comes from hashes of keys and a seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.scratch import Scratch

#: No document is taken more often.
MAX_REPEATS = 3
#: A source has a block for each so many documents, but MAX_BLOCKS at most. A document of
#: more than 1 / LONG of a mean block (or, so that there are fewer than MAX_BLOCKS of them,
#: 1 / MAX_BLOCKS of the source) is a block of its own. Draws are numbered in one window, so
#: this bounds them to sources x 2 MAX_BLOCKS x MAX_REPEATS.
BLOCK_DOCS, MAX_BLOCKS, LONG = 256, 4096, 16
SHARDS = 16
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
_FIRST = Window.unboundedPreceding


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, size) with columns weight and target.

    Sources by code point, null last, weigh 1, 2, 3, repeating. A target is the
    lesser of MAX_REPEATS sizes and weight x level, and the level makes the
    targets' total that of the sizes. The capped sources are those with the
    smallest cap / weight, so running totals in that order give the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    cap = F.col("size") * MAX_REPEATS
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    everything = order.rowsBetween(_FIRST, Window.unboundedFollowing)
    capped_before = F.coalesce(F.sum(cap).over(order.rowsBetween(_FIRST, -1)), F.lit(0))
    weight_from = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("size").over(everything) - capped_before) / weight_from
    # the level if all earlier sources are capped; the true one is the first that its own source can take
    fits = F.when(level * F.col("weight") <= cap, level)
    found = weighed.withColumns({"__cap": cap, "__fit": fits})
    level = F.first("__fit", ignorenulls=True).over(order.rowsBetween(_FIRST, Window.unboundedFollowing))
    target = F.least(F.col("__cap").cast("double"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return found.withColumn("target", F.when(F.col("size") > 0, target).otherwise(F.lit(0.0))).drop("__cap", "__fit")


def _hash(*columns: Column | str | int) -> Column:
    return F.xxhash64(*(F.lit(c) if isinstance(c, int) else c if isinstance(c, Column) else F.col(c) for c in columns))


def _join(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """An inner join on keys that may be null; the right side adds its other columns."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    equal = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(right, equal).drop(*(f"__{k}" for k in keys))


def place(sized: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """sized (source, size, id, ...) with source_size, target and placements.

    id is a hash of the row; rows alike in it are told apart nowhere else.
    placements: an array of (pass, shard), one for each time the row is taken; a
    row of no words is taken with its block. An empty table gives an empty result.
    """
    scratch = Scratch(sized.sparkSession)
    sized = scratch.write(sized)
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")))
    passes = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size") + 1e-9)).otherwise(0)
    sources = scratch.write(
        sources.select(
            "source",
            F.col("size").alias("source_size"),
            "target",
            F.least(F.ceil(F.col("docs") / BLOCK_DOCS), F.lit(MAX_BLOCKS)).alias("blocks"),
            passes.cast("int").alias("passes"),
        )
    )
    rows = _join(sized, sources, "source")
    drawn = F.shiftright(_hash("id", seed), 7)
    long = F.col("size") * F.least(F.col("blocks") * LONG, F.lit(MAX_BLOCKS)) > F.col("source_size")
    rows = rows.withColumn("block", F.when(long, -1 - F.pmod(drawn, F.lit(1 << 50))).otherwise(F.pmod(drawn, F.col("blocks"))))
    blocks = scratch.write(_choose_blocks(rows, seed, scratch))
    rows = _join(rows.drop("passes"), blocks.drop("turn"), "source", "block")
    rest = rows.where(F.col("cut").isNull()).withColumn("extra", F.col("whole"))
    columns = [*sized.columns, "source_size", "target", "block", "passes", "extra"]
    rows = rest.select(*columns).unionByName(_cut(rows.where(F.col("cut").isNotNull()), seed, scratch).select(*columns))
    placements = F.filter("draws", lambda d: d["pass"] < F.col("passes") + F.col("extra"))
    placed = _join(rows, _deal(blocks, shards, seed), "source", "block").withColumn("placements", placements)
    return placed.select(*sized.columns, "source_size", "target", "placements")


def _choose_blocks(rows: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """Blocks (source, block, turn, passes, whole, cut), taken in permuted order until the target is met.

    whole: 1 if the block is taken once more than passes. cut: words still wanted of it, or null.
    """
    same = ("source_size", "target", "passes")
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("size"), *(F.first(c).alias(c) for c in same))
    wanted = F.greatest(F.round(F.col("target") - F.col("passes") * F.col("source_size")), F.lit(0.0)).cast("bigint")
    can_cut = (F.col("block") >= 0) & (F.col("size") > 0)
    permuted = [_hash("block", "source", seed + 1), F.col("block")]
    blocks = _choose(blocks.withColumns({"wanted": wanted, "can_cut": can_cut}), permuted, scratch)
    own = Window.partitionBy("source")
    # what is missing comes from the first block not taken, what is too much goes from the last one taken
    side = F.col("can_cut") & (F.col("extra") == (F.col("off") < 0).cast("int"))
    at = F.when(F.col("off") > 0, F.min(F.when(side, F.col("turn"))).over(own))
    at = F.when(F.col("off") < 0, F.max(F.when(side, F.col("turn"))).over(own)).otherwise(at)
    cut = F.when(F.col("turn") == at, F.when(F.col("off") > 0, F.col("off")).otherwise(F.col("size") + F.col("off")))
    blocks = blocks.withColumn("cut", cut.cast("double"))
    whole = F.when(F.col("cut").isNull(), F.col("extra")).otherwise(0)
    return blocks.select("source", "block", "turn", "passes", whole.alias("whole"), "cut")


def _cut(rows: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """rows of each source's last block with extra: 1 for those that the target still takes."""
    rows = rows.withColumns({"wanted": F.col("cut").cast("bigint"), "can_cut": F.lit(False)})
    return _choose(rows, [_hash("id", seed + 9), F.col("size")], scratch)


def _choose(items: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """items (source, size, wanted, can_cut, ...) with turn, extra (1 if taken) and off, what the taken ones lack of wanted.

    Those before the first that overshoots are taken in the given order; then, largest first,
    all that fit, until none does. If words are missing then and no item that can be cut is
    left, the smallest of the rest is taken and what it overshoots is given back, largest
    first, if that comes nearer or leaves an item to cut. wanted 0 takes nothing.
    """
    own = Window.partitionBy("source")
    by = own.orderBy(*order)
    items = items.withColumns({"turn": F.row_number().over(by) - 1, "__sum": F.sum("size").over(by.rowsBetween(_FIRST, 0))})
    items = items.withColumn("extra", ((F.col("wanted") > 0) & (F.col("__sum") <= F.col("wanted"))).cast("int")).drop("__sum")
    off = F.col("wanted") - F.sum(F.col("extra") * F.col("size")).over(own)
    items = _largest_first(items.withColumn("off", off), F.col("extra") == 0, F.col("off"), scratch)
    items = items.withColumn("extra", F.greatest("extra", F.col("picked").cast("int"))).drop("picked").withColumn("off", off)
    open_ = F.max((F.col("can_cut") & (F.col("extra") == 0)).cast("int")).over(own)
    least = F.min(F.when(F.col("extra") == 0, F.struct("size", "turn"))).over(own)
    items = items.withColumn("__in", F.when((F.col("off") > 0) & (open_ == 0), least))
    over = F.col("__in")["size"] - F.col("off")
    items = _largest_first(items.withColumn("__over", over), F.col("extra") == 1, F.col("__over"), scratch)
    kept = (F.col("extra") == 1) & ~F.col("picked")
    swapped = (kept | (F.col("turn") == F.col("__in")["turn"])).cast("int")
    left = F.col("__over") - F.sum(F.col("picked").cast("bigint") * F.col("size")).over(own)
    better = (left < F.col("off")) | (F.max((F.col("can_cut") & kept).cast("int")).over(own) == 1)
    better = F.coalesce(F.col("__in").isNotNull() & better, F.lit(False))
    items = items.withColumns({"__left": left, "__swapped": swapped, "__better": better})
    items = items.withColumn("extra", F.when(F.col("__better"), F.col("__swapped")).otherwise(F.col("extra")))
    items = items.withColumn("off", F.when(F.col("__better"), -F.col("__left")).otherwise(F.col("off")))
    return items.drop("__in", "__over", "__left", "__swapped", "__better", "picked")


def _largest_first(items: DataFrame, free: Column, room: Column, scratch: Scratch) -> DataFrame:
    """items (source, size, turn, ...) with picked: the free ones that fit into a source's room, largest first, then by turn.

    Items of a size differ in turn alone, so it is decided by size how many of them are picked.
    """
    items = items.withColumn("__room", F.when(free & (F.col("size") > 0) & (F.col("size") <= room), room))
    of_size = Window.partitionBy("source", "size", F.col("__room").isNull()).orderBy("turn")
    items = scratch.write(items.withColumn("__nth", F.row_number().over(of_size)))
    fitting = items.where(F.col("__room").isNotNull())
    sizes = fitting.groupBy("source", "size").agg(F.max("__room").alias("room"), F.count(F.lit(1)).alias("many"))
    sizes = sizes.groupBy("source").agg(F.max("room").alias("room"), F.sort_array(F.collect_list(F.struct("size", "many")), False).alias("sizes"))

    def step(state: Column, entry: Column) -> Column:
        many = F.least(entry["many"], F.floor(state["room"] / entry["size"]))
        picks = F.when(many > 0, F.concat(state["picks"], F.array(F.struct(entry["size"].alias("size"), many.alias("many"))))).otherwise(state["picks"])
        return F.struct((state["room"] - many * entry["size"]).alias("room"), picks.alias("picks"))

    none = F.array().cast("array<struct<size:bigint,many:bigint>>")
    picks = F.aggregate("sizes", F.struct(F.col("room").alias("room"), none.alias("picks")), step)["picks"]
    picks = sizes.select(F.col("source").alias("__source"), F.explode(picks).alias("__pick"))
    match = [F.col("source").eqNullSafe(F.col("__source")), F.col("size") == F.col("__pick.size")]
    picked = F.col("__room").isNotNull() & (F.col("__nth") <= F.col("__pick.many"))
    items = items.join(picks, match, "left").withColumn("picked", F.coalesce(picked, F.lit(False)))
    return items.drop("__source", "__pick", "__room", "__nth")


def _deal(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """blocks (source, block) with draws, an array of (pass, shard) in order of pass."""
    count = F.col("passes") + F.col("whole") + F.col("cut").isNotNull().cast("int")
    passes = F.when(count > 0, F.sequence(F.lit(0), count - 1))
    draws = blocks.select("source", "block", "turn", F.explode_outer(passes).alias("pass"))
    number = F.row_number().over(Window.partitionBy("source").orderBy(F.col("pass").asc_nulls_last(), "turn"))
    draws = draws.withColumn("number", number)
    # the tree splits counts: its leaves are told apart by source alone
    tokens = draws.where(F.col("pass").isNotNull()).select("source", "number")
    tokens = tokens.withColumns({"low": F.lit(0), "high": F.lit(shards)})
    for depth in range((shards - 1).bit_length()):
        node = Window.partitionBy("low", "high")
        shuffled = node.orderBy(_hash("source", "number", seed + 20 + depth), "source", "number")
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        quota = F.round(F.count(F.lit(1)).over(node) * (middle - F.col("low")) / (F.col("high") - F.col("low")))
        left = F.row_number().over(shuffled) <= quota
        leaf = F.col("high") - F.col("low") == 1
        tokens = tokens.withColumns({"__middle": middle, "__left": left}).withColumns(
            {
                "low": F.when(leaf | F.col("__left"), F.col("low")).otherwise(F.col("__middle")),
                "high": F.when(~leaf & F.col("__left"), F.col("__middle")).otherwise(F.col("high")),
            }
        )
    # a shard takes as long a run of its source's draws, in permuted block order, as it has quota
    run = Window.partitionBy("source").orderBy("low", "number")
    dealt = tokens.select("source", F.col("low").alias("shard"), F.row_number().over(run).alias("number"))
    dealt = dealt.withColumnsRenamed({"source": "__source", "number": "__number"})
    match = [F.col("source").eqNullSafe(F.col("__source")), F.col("number") == F.col("__number")]
    pair = F.when(F.col("pass").isNotNull(), F.struct("pass", "shard"))
    return draws.join(dealt, match, "left").groupBy("source", "block").agg(F.sort_array(F.collect_list(pair)).alias("draws"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs, each as often as the mix takes it, with columns mix_shard and mix_order.

    Rows of a shard come in the order of mix_order; columns of those two names are
    replaced. Null texts have no words, a null source is a source of its own.
    """
    docs = docs.drop("mix_shard", "mix_order")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    id_ = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")))
    sized = docs.select(row.alias("row"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"), id_.alias("id"))
    taken = place(sized, shards, seed).select("row", "id", F.explode("placements").alias("at"))
    return taken.select("row.*", F.col("at.shard").alias("mix_shard"), _order(F.col("at"), seed).alias("mix_order"))


def _order(at: Column, seed: int) -> Column:
    """The place of a row's placement in the shuffle of its shard."""
    return _hash("id", at["pass"], at["shard"], seed + 50)


def write_mix(mixed: DataFrame, path: str) -> None:
    """Files of whole, shuffled rows, one folder per shard."""
    ranged = mixed.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")
    ranged.write.partitionBy("mix_shard").parquet(path)


def op3_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))).alias("id")
    )
    taken = F.col("size") * F.size("placements")
    placed = F.transform("placements", lambda at: F.struct(at["pass"].alias("pass"), at["shard"].alias("shard"), _order(at, SEED).alias("order")))
    return place(sized).select("doc_id", "size", "source_size", "target", taken.alias("taken"), placed.alias("placements"))
