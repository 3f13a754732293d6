"""Near-duplicate groups by MinHash bands and sequential Bayesian verification.

1. A document becomes its set of distinct word shingles (64-bit hashes), a
   signature of HASHES minima, and BANDS keys of ROWS minima each. Documents with
   equal sets are one from here on, a node.
2. Nodes that share a band's key are a bucket. A bucket belongs to its hub, the
   member that shares most keys with others. All buckets of a hub make a cell, so
   that a node's full set travels once per hub and not once per key.
3. A cell is split into blocks of LIMIT weight, each with the hub. Within a block
   the signatures are compared in batches. After n hashes with m matches the
   similarity's posterior is Beta(m + 1, n - m + 1); a pair is dropped once its
   chance of reaching the threshold is below MISS. Survivors are verified on the
   full sets, closest first, unless they are connected by then. Only confirmed
   links leave a block, fewer than it has members.
4. Cells of several blocks are dealt anew where their nodes are not all connected:
   by whether a node is connected with the hub, and by size class. Blocks meet in
   pairs if their sizes can be alike and not all of both are connected with the
   hub. So every two nodes of a bucket are either connected or compared, and pairs
   that don't link leave no row.
5. Confirmed links give components by label propagation.

At a similarity of 0.75 two documents share no band's key with probability
(1 - 0.75**4)**32 = 5e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch
from tessera.llm.workers import fresh, prepare

SHINGLE = 5
#: Similarity that links, in hundredths.
THRESHOLD = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Hashes compared at once, and the posterior chance at which a pair is given up.
BATCH, MISS = 16, 1e-6
#: A block's weight at most, but for its last member; a node weighs its set's size and BASE_WEIGHT.
LIMIT, BASE_WEIGHT = 1_500_000, 1024
#: Survivors verified at once, first and at most.
FIRST_TESTS, MOST_TESTS = 8, 1024
#: Shingles hashed at once; bounds memory for very long texts.
CHUNK = 4096
#: Bytes of text taken at once.
GROUP_BYTES = 8_000_000

_random = np.random.default_rng(20)
_FACTORS = _random.integers(0, 2**64, HASHES, np.uint64) | np.uint64(1)
_SHIFTS = _random.integers(0, 2**64, HASHES, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A-Z are lower-cased, and words are what stands between ASCII white space. A text
    of fewer words is one shingle, one of none (or null) has an empty set.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_BYTES, side="right")))
        yield from _group_sets(texts.slice(at, end - at), size)
        at = end


def _group_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    numbered = cut.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in numbered.dictionary.to_pylist()], np.uint64)
    words = hashes[numbered.indices.to_numpy(zero_copy_only=False)]
    edges = cut.offsets.to_numpy(zero_copy_only=False)
    edges = edges - edges[0]
    real = words != 0  # splitting leaves empty strings at a text's ends
    edges = np.concatenate([[0], np.cumsum(real)])[edges]
    words = words[real]
    rolled = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for i in range(size):
        rolled = rolled * _BASE + words[i : i + len(rolled)]
    rolled = _mixed(rolled)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            short = hashlib.blake2b(words[a:b].tobytes(), digest_size=8, salt=b"short").digest()
            yield np.frombuffer(short, np.uint64)
        else:
            yield rolled[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima, 32 bits each, of a set that isn't empty."""
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), CHUNK):
        part = _FACTORS[:, None] * shingles[None, i : i + CHUNK] + _SHIFTS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


_SIGNED = "doc_id long, text_key long, n_shingles long, set_key binary, short binary, bands array<long>"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text: rows that agree in id and hash are one document."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, a hash of the set, the minima's low bytes, and the bands' keys; null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in shingle_sets(batch.column(1)):
                if not len(found):
                    rows.append((0, None, None, None))
                    continue
                own = signature(found)
                bands = [xxhash.xxh3_64_intdigest(b.tobytes(), i) for i, b in enumerate(own.reshape(BANDS, ROWS))]
                key = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                rows.append((len(found), key, own.astype(np.uint8).tobytes(), np.array(bands, np.uint64).astype(np.int64)))
            types = pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            made = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made], names=["doc_id", "text_key", "n_shingles", "set_key", "short", "bands"])

    return _keyed(docs).mapInArrow(run, _SIGNED)


def least_matches() -> np.ndarray:
    """Matches that a pair needs after each batch to be kept.

    P(similarity >= t) under Beta(m + 1, n - m + 1) is P(Binomial(n + 1, t) <= m). The
    signatures' low bytes also agree by chance, once in 256.
    """
    t = THRESHOLD / 100
    t += (1 - t) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        k = np.arange(n + 2)
        logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 2)))])
        chance = np.exp(logs[n + 1] - logs[k] - logs[n + 1 - k] + k * np.log(t) + (n + 1 - k) * np.log(1 - t))
        out.append(int(np.searchsorted(np.cumsum(chance), MISS)))
    return np.array(out)


def settle(signs: np.ndarray, sizes: np.ndarray, sets: np.ndarray, ends: np.ndarray, labels: np.ndarray, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all that can be connected, as pairs of places; labels come to name what is.

    sets holds the full sets one after another, ends their ends. Pairs with equal labels,
    and of one side if there are sides, are not compared. The first row goes first.
    """
    needed = least_matches()
    steps = [np.ascontiguousarray(signs[:, i : i + BATCH]) for i in range(0, HASHES, BATCH)]
    starts = ends - sizes
    out = []
    order = np.concatenate([[0], 1 + np.argsort(-sizes[1:], kind="stable")])
    later = np.ones(len(order), bool)
    for i in order.tolist():
        later[i] = False
        can = later & (labels != labels[i]) & (100 * np.minimum(sizes, sizes[i]) >= THRESHOLD * np.maximum(sizes, sizes[i]))
        if sides is not None:
            can &= sides != sides[i]
        alive = np.flatnonzero(can)
        matches = np.zeros(len(alive), np.int64)
        for step, least in zip(steps, needed.tolist(), strict=True):
            if not len(alive):
                break
            matches += (step[alive] == step[i]).sum(axis=1)
            keep = matches >= least
            alive, matches = alive[keep], matches[keep]
        alive = alive[np.argsort(-matches, kind="stable")]
        own, count = sets[starts[i] : ends[i]], FIRST_TESTS
        while len(alive):
            tested, alive = alive[:count], alive[count:]
            flat = np.concatenate([sets[starts[j] : ends[j]] for j in tested.tolist()])
            place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            both = np.add.reduceat((own[place] == flat).astype(np.int64), np.cumsum(sizes[tested]) - sizes[tested])
            for j in tested[100 * both >= THRESHOLD * (sizes[i] + sizes[tested] - both)].tolist():
                if labels[j] != labels[i]:
                    labels[labels == labels[j]] = labels[i]
                    out.append((i, j))
            alive = alive[labels[alive] != labels[i]]
            count = min(4 * count, MOST_TESTS)
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each key, the first so many columns, from batches in which equal keys are neighbours."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1).tolist(), len(columns)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(columns[a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _linked(dealt: DataFrame, sets: DataFrame, keys: list[str]) -> DataFrame:
    """The links a, b found within each group of dealt, which has the keys, node, label, side (0 for the hub) and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, len(keys)):
            node, label, side, short, shingles = (group.column(c).combine_chunks() for c in ("node", "label", "side", "short", "shingles"))
            node, label, side = (c.to_numpy(zero_copy_only=False) for c in (node, label, side))
            order = np.lexsort((node, side))
            order = order[np.concatenate([[True], np.diff(node[order]) != 0])]  # a repeated row counts once
            signs = np.frombuffer(b"".join(short.take(pa.array(order)).to_pylist()), np.uint8).reshape(-1, HASHES)
            own = shingles.take(pa.array(order))
            sizes = pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int64) // 8
            flat = np.frombuffer(b"".join(own.to_pylist()), np.uint64)
            apart = side[order] if (side > 1).any() else None
            found = settle(signs, sizes, flat, np.cumsum(sizes), label[order].copy(), apart)
            ids = node[order]
            a, b = (pa.array([int(ids[pair[i]]) for pair in found], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    joined = dealt.join(sets.hint("merge"), "node").select(*keys, "node", "label", "side", "short", "shingles")
    # few bytes, much work: partitions that are small must not be merged
    count = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return joined.repartition(count, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the nodes in links (a, b): the smallest node reachable.

    Labels take the least of their neighbours', then their label's label, until
    none changes; paths shorten by more than half a round.
    """
    links = links.select("a", "b").distinct()
    both = scratch.write(links.union(links.select("b", "a")))
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("seen"))
        nearer = labels.join(seen, labels["node"] == seen["a"]).select("node", F.least("component", "seen").alias("near"), "component")
        jump = nearer.select(F.col("node").alias("near"), F.col("near").alias("jumped"))
        found = scratch.write(nearer.join(jump, "near").select("node", F.least("near", "jumped").alias("component"), F.col("component").alias("was")))
        done = found.where("component <> was").isEmpty()
        scratch.drop(labels)
        labels = found.drop("was")
        if done:
            return labels


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, short and shingles, the full set, of wanted (doc_id, text_key, node, short)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            node = batch.column(0).to_numpy()
            fresh = np.diff(node, prepend=-1 if last is None else last) != 0  # repeated rows stand together
            last = node[-1] if len(node) else last
            batch = batch.filter(pa.array(fresh))
            found = pa.array([s.tobytes() for s in shingle_sets(batch.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["node", "short", "shingles"])

    # merged at every size: the texts move once, whatever the number of nodes
    joined = _keyed(docs).hint("merge").join(wanted, ["doc_id", "text_key"])
    return joined.select("node", "short", "text").mapInArrow(run, "node long, short binary, shingles binary")


def _cells(members: DataFrame) -> DataFrame:
    """Distinct (hub, node) of members (key, node, others)."""
    score = members.groupBy("node").agg(F.sum("others").alias("score"))
    hubs = members.join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node")).alias("hub"))
    return members.join(hubs.select("key", F.col("hub.node").alias("hub")), "key").select("hub", "node").distinct()


def _blocks_needed() -> Column:
    """How many blocks a group's nodes fill, from their sets' sizes n."""
    return F.ceil(F.sum(F.col("n") + BASE_WEIGHT) / LIMIT).cast("int")


def _blocks(cells: DataFrame, scratch: Scratch, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links found within blocks of cells (hub, node, n), and the cells of several blocks."""
    total = cells.groupBy("hub").agg(_blocks_needed().alias("blocks"))
    cells = scratch.write(cells.join(total, "hub"))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    block = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)
    side = F.when(F.col("node") == F.col("hub"), 0).otherwise(1).alias("side")
    dealt = cells.select("hub", F.explode(block).alias("block"), "node", F.col("node").alias("label"), side)
    return scratch.write(_linked(dealt, sets, ["hub", "block"])), cells.where("blocks > 1").drop("blocks")


def _across(cells: DataFrame, labels: DataFrame, scratch: Scratch, sets: DataFrame) -> DataFrame:
    """The links between the nodes of cells (hub, node, n) that have different labels so far."""
    named = _labelled(_labelled(cells, labels, "node", "label"), labels, "hub", "main")
    class_ = F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / THRESHOLD))).cast("int").alias("class")
    named = named.select("hub", "node", "label", "n", (F.col("label") == F.col("main")).alias("main"), class_)
    part = ["hub", "main", "class"]
    total = named.groupBy(*part).agg(_blocks_needed().alias("parts"))
    total = scratch.write(total.join(total.where("NOT main").select("hub").distinct(), "hub", "left_semi"))
    named = scratch.write(named.join(total, part).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    blocks = total.select(*part, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    one, other = (blocks.select("hub", F.struct("main", "class", "part").alias(name)) for name in ("low", "high"))
    # blocks that can hold a link: their sizes are alike, and one of them is not all connected with the hub
    met = one.join(other, "hub").where("low <= high AND high.class - low.class BETWEEN -1 AND 1 AND NOT (low.main AND high.main)")
    met = met.select("hub", "low", "high", F.xxhash64("low", "high").alias("pair"))
    own = F.struct("main", "class", "part")
    sides = met.select("hub", "pair", F.explode(F.array_distinct(F.array("low", "high"))).alias("own"), "low", "high")
    side = F.when(F.col("low") == F.col("high"), 1).when(F.col("own") == F.col("low"), 2).otherwise(3)
    sides = sides.select("hub", "pair", "own", side.alias("side"))
    dealt = named.withColumn("own", own).join(sides, ["hub", "own"]).select("hub", "pair", "node", "label", "side")
    return scratch.write(_linked(dealt, sets, ["hub", "pair"]))


def _labelled(frame: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    """frame with column name: the component of the node in column key, which is alone if it has no label."""
    labels = labels.select(F.col("node").alias(key), F.col("component").alias(name))
    return frame.join(labels, key, "left").withColumn(name, F.coalesce(name, key))


def _grouped(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, text_key, n_shingles, component_id, and first.

    first is whether the row's id and text are those that stand for its component: the
    smallest id, of several texts of that id the one with the smallest hash. Rows with
    empty sets or null ids stand for themselves.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    signed = scratch.write(sign(docs))
    full = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    rows = F.min(F.struct("doc_id", "text_key")).alias("row")
    nodes = full.groupBy("set_key").agg(rows, *(F.first(c).alias(c) for c in ("n_shingles", "short", "bands")))
    # written once, so that the numbers hold
    nodes = scratch.write(nodes.select(F.monotonically_increasing_id().alias("node"), "set_key", "row", F.col("n_shingles").alias("n"), "short", "bands"))
    banded = nodes.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    # merged at every size, as both sides grow with the input
    members = scratch.write(banded.hint("merge").join(shared, "key"))
    cells = scratch.write(_cells(members))
    wanted = nodes.join(cells.select("node").distinct(), "node", "left_semi").select("row.*", "node", "short")
    sets = scratch.write(_sets(docs, wanted))
    links, hot = _blocks(cells.join(nodes.select("node", "n"), "node"), scratch, sets)
    labels = components(links, scratch)
    if not hot.isEmpty():
        links = links.union(_across(hot, labels, scratch, sets))
        labels = components(links, scratch)
    scratch.drop(members, cells, sets)
    known = _labelled(nodes.select("node", "set_key", "row"), labels, "node", "component")
    firsts = known.groupBy("component").agg(F.min("row").alias("least"))
    known = known.join(firsts, "component").select("set_key", "least")
    found = signed.select("doc_id", "text_key", "n_shingles", "set_key").join(known, "set_key", "left")
    alone = F.col("least").isNull() | F.col("doc_id").isNull()
    first = alone | (F.struct("doc_id", "text_key") == F.col("least"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "doc_id"))
    return found.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), first.alias("first"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text).

    Texts whose 5-word shingle sets have a Jaccard similarity of 0.75 or more are
    linked; component_id is the smallest doc_id reachable, and kept whether it is the
    row's own. Empty texts are linked with nothing. A row with a null doc_id takes no
    part: its component is null and it is kept. Rows that repeat an id and a text
    share a component; different texts of one id are linked by their texts alone. An
    empty table gives an empty result, columns other than these two are not read.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return _grouped(docs).select("doc_id", "n_shingles", "component_id", kept)


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the near duplicates, with all their columns: one document of each group stays.

    It is the one with the smallest doc_id, of several texts with that id one by a fixed
    order, and of rows that repeat id and text one by a hash of all columns. Rows with a
    null doc_id and rows with empty texts all stay.
    """
    scratch = Scratch(docs.sparkSession)
    found = _grouped(docs).where("doc_id IS NOT NULL AND first")
    counted = found.groupBy("doc_id", "text_key").agg((F.count(F.lit(1)) > 1).alias("repeated"), F.max("n_shingles").alias("n"))
    key, id_, again = (fresh(docs, name) for name in ("text_key", "id", "repeated"))
    again_ = (F.col("repeated") & (F.col("n") > 0)).alias(again)
    counted = scratch.write(counted.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), again_))
    named = docs.where("doc_id IS NOT NULL").withColumns({id_: F.col("doc_id").cast("bigint"), key: F.xxhash64("text")})
    named = named.hint("merge").join(counted, [id_, key])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    stay = named.where(f"NOT `{again}`").select(*columns).union(docs.where("doc_id IS NULL"))
    if counted.where(f"`{again}`").isEmpty():
        return stay
    row = F.struct(*columns)
    one = named.where(f"`{again}`").groupBy(id_, key).agg(F.min_by(row, F.xxhash64(row.cast("string"))).alias(again))
    return stay.union(one.select(f"`{again}`.*"))


def op1_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM words UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id, w.doc_id = min(other) AS kept
FROM words w JOIN reached r ON r.doc_id = w.doc_id LEFT JOIN sizes z ON z.doc_id = w.doc_id GROUP BY w.doc_id, n
"""
