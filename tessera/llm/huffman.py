"""Token ids as files: canonical length-limited Huffman codes in independent blocks.

Documents are tokenized once, and ids counted over the whole corpus; the driver gets at most one count
per id of the vocabulary and makes code lengths of up to MAX_BITS by
package-merge. Documents are then sorted by id in ranges and encoded
in blocks of whole documents. A block holds its documents' ids and lengths, the
code bits, and a checkpoint, the bit offset, at every SEGMENT ids. Blocks decode
on their own, and a block's segments decode side by side through one table of
2**MAX_BITS entries.

Files: a folder with codes/ (id, bits) and blocks/, both Parquet, so that Spark's
commit protocol covers them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import ranges
from tessera.llm.scratch import Scratch
from tessera.llm.tokens import WordTokenizer, tokenizer
from tessera.llm.workers import prepare

#: Longest code; a vocabulary may have up to 2**MAX_BITS ids.
MAX_BITS = 16
#: Ids between two checkpoints.
SEGMENT = 512
#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 65_536
END_ID = 1
#: Ids decoded at once, so that blocks of a batch don't add up.
DECODE_IDS = 4_000_000


def code_lengths(counts: np.ndarray, longest: int = MAX_BITS) -> np.ndarray:
    """Bits of each id's code, 0 for a count of 0: the shortest total with none above longest."""
    used = np.flatnonzero(counts)
    bits = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids need codes longer than {longest} bits")
    if len(used) < 2:
        bits[used] = 1
        return bits
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    # at each level leaves and the packages of the level before are merged by weight
    is_leaf, weights = [], leaves
    flags = np.ones(len(leaves), bool)
    is_leaf.append(flags)
    for _ in range(longest - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, pairs])
        sort = np.argsort(merged, kind="stable")
        weights = merged[sort]
        is_leaf.append(sort < len(leaves))
    take = 2 * len(leaves) - 2
    for flags in reversed(is_leaf):
        chosen = int(flags[:take].sum())
        bits[order[:chosen]] += 1
        take = 2 * (take - chosen)
    return bits


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(bits), np.uint64)
    code = last = 0
    for i in np.lexsort((np.arange(len(bits)), bits)):
        if bits[i]:
            code <<= int(bits[i]) - last
            last = int(bits[i])
            codes[i] = code
            code += 1
    return codes


def decode_table(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for each value of the next MAX_BITS bits."""
    ids, lengths = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.uint8)
    used = np.flatnonzero(bits)
    used = used[np.lexsort((used, bits[used]))]
    spans = 1 << (MAX_BITS - bits[used].astype(np.int64))
    filled = int(spans.sum())
    ids[:filled], lengths[:filled] = np.repeat(used, spans), np.repeat(bits[used], spans)
    return ids, lengths


def encode(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(code bits, padded to 32-bit words and one more; the bit offset of each SEGMENT ids)."""
    lengths = bits[ids].astype(np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    words = np.zeros(int(ends[-1] if len(ends) else 0) // 32 + 2, np.uint64)
    if len(ids):
        # a code lies in the 64 bits from its first word on
        placed = codes[ids] << (64 - (starts & 31) - lengths).astype(np.uint64)
        word = starts >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] |= np.bitwise_or.reduceat(placed >> np.uint64(32), first)
        words[word[first] + 1] |= np.bitwise_or.reduceat(placed & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes(), starts[::SEGMENT]


def decode(payload: bytes, offsets: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of segments that start at offsets (in bits) and hold counts ids, in order."""
    symbols, lengths = table
    words = np.frombuffer(payload, ">u4").astype(np.uint64)
    order = np.argsort(-counts, kind="stable")  # long segments first, so that those at work are a prefix
    at, sizes = offsets[order].astype(np.int64), counts[order]
    out = np.empty((len(order), int(sizes[0]) if len(sizes) else 0), np.uint32)
    for step in range(out.shape[1]):
        active = int(np.searchsorted(-sizes, -step, side="left"))
        here = at[:active]
        word = here >> 5
        window = (words[word] << np.uint64(32)) | words[word + 1]
        window = (window >> (64 - MAX_BITS - (here & 31)).astype(np.uint64)) & np.uint64((1 << MAX_BITS) - 1)
        out[:active, step] = symbols[window]
        here += lengths[window]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    out = out[back]
    return out[np.arange(out.shape[1]) < counts[:, None]]


# -- writing and reading ----------------------------------------------------


def tokenize(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs (range, doc_id, tie, text) with ids, 16 bits each and the end id last, in place of text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = tokenizer(WordTokenizer, vocabulary)
        if found.library.get_vocab_size() > 1 << MAX_BITS:
            raise ValueError(f"the vocabulary has more than {1 << MAX_BITS} ids")
        end = np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            ids = [i.astype("<u2").tobytes() + end for i in found.encode(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], names=["range", "doc_id", "tie", "ids"])

    return docs.select("range", "doc_id", "tie", "text").mapInArrow(run, "range int, doc_id long, tie long, ids binary")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << MAX_BITS, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2")
            total += np.bincount(ids, minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counted = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(max((r.id for r in counted), default=0) + 1, np.int64)
    for r in counted:
        total[r.id] = r.n
    return total


_BLOCKS = "range int, block int, first long, doc_ids array<long>, lengths array<long>, checkpoints array<long>, payload binary"


def write(docs: DataFrame, vocabulary: str, path: str) -> None:
    """Encode docs (doc_id, text) in ascending doc_id order, nulls first, under path, which must not exist.

    A null or empty text is its end id alone. Of equal doc_ids the order is that of
    a hash of their texts. No documents make no blocks.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    dealt = ranges.ranges_of(docs)
    scratch = Scratch(spark)
    tokens = scratch.write(tokenize(docs.withColumn("range", dealt.of(F.col("doc_id"), F.col("tie"))), vocabulary))
    bits = code_lengths(count_ids(tokens))
    codes = canonical_codes(bits)
    listed = F.split(F.lit(",".join(map(str, bits.tolist()))), ",")
    spark.range(1, numPartitions=1).select(F.posexplode(listed).alias("id", "bits")).select(
        "id", F.col("bits").cast("int").alias("bits")
    ).write.parquet(f"{path}/codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, first, held, size = 0, 0, [], 0
        own = None

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(d for _, d in held), "<u2")
            payload, checkpoints = encode(ids, bits, codes)
            row = [own], [block], [first], [[i for i, _ in held]], [[len(d) // 2 for _, d in held]], [checkpoints], [payload]
            types = pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()
            arrays = [pa.array(v, t) for v, t in zip(row, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["range", "block", "first", "doc_ids", "lengths", "checkpoints", "payload"])

        for batch in batches:
            for part, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "ids")), strict=True):
                if part != own or size >= BLOCK_IDS:
                    if held:
                        yield flush()
                    block, first = (block + 1, first + size) if part == own else (0, 0)
                    own, held, size = part, [], 0
                held.append((doc_id, ids))
                size += len(ids) // 2
        if held:
            yield flush()

    placed = tokens.repartitionById(dealt.count, F.col("range"))
    ranged = placed.sortWithinPartitions("range", "doc_id", "tie")
    ranged.mapInArrow(run, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    scratch.drop(tokens)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents written under path: doc_id, start (ids before it), n_tokens, ids as binary."""
    prepare(spark)
    blocks = spark.read.parquet(f"{path}/blocks")
    coded = {r.id: r.bits for r in spark.read.parquet(f"{path}/codes").collect()}  # an id of the vocabulary each
    bits = np.array([coded[i] for i in range(len(coded))], np.uint8)
    sizes = blocks.groupBy("range").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("ids"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("range").alias("__range"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    placed = blocks.join(bases, F.col("range") == F.col("__range")).withColumn("first", F.col("first") + F.col("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(bits)
        for batch in batches:
            group, size = [], 0
            for row in batch.to_pylist():
                more = sum(row["lengths"])
                if group and size + more > DECODE_IDS:
                    yield _decoded(group, table)
                    group, size = [], 0
                group.append(row)
                size += more
            if group:
                yield _decoded(group, table)

    return placed.select("first", "doc_ids", "lengths", "checkpoints", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _decoded(blocks: list[dict], table: tuple) -> pa.RecordBatch:
    """All segments of all blocks side by side."""
    offsets, counts, bit = [], [], 0
    for b in blocks:
        size = sum(b["lengths"])
        offsets.append(np.array(b["checkpoints"], np.int64) + bit)
        counts.append(np.minimum(SEGMENT, size - np.arange(0, size, SEGMENT)))
        bit += 8 * len(b["payload"])
    ids = decode(b"".join(b["payload"] for b in blocks), np.concatenate(offsets), np.concatenate(counts), table)
    data = ids.astype("<u4").tobytes()
    lengths = np.concatenate([b["lengths"] for b in blocks]).astype(np.int64)
    ends = np.cumsum(lengths)
    starts = np.concatenate([b["first"] + np.cumsum([0, *b["lengths"][:-1]]) for b in blocks]).astype(np.int64)
    texts = [data[4 * a : 4 * b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
    doc_ids = pa.array([i for b in blocks for i in b["doc_ids"]], pa.int64())
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(lengths), pa.array(texts, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def op7_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{Scratch(spark).folder}/ids"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
