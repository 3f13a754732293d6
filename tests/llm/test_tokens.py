import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import huffman, packing, ranges, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
KINDS = [(tokens.SpaceTokenizer, BYTES), (tokens.WordTokenizer, WORDS)]
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n\n b", "a \n \n b", "\n", " \n", "it's we'll 'tis", "x\x00y \x00 \x00\x00", "a\x1cb \x85c d  e",
    "Σας ΣΑΣ İi ǅ ﬁ é ́x Å", "<|endoftext|> <|startoftext|>", "日本語 テキスト", "1234 5 ٣٤", "z" * 5000, "w " * 3000, "é" * 70 + " " + "é" * 70,
]


def library(path, texts):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def encoded(tokenizer, texts):
    return [ids.tolist() for ids in tokenizer.encode(pa.array(texts, pa.string()))]


@pytest.mark.parametrize(("kind", "path"), KINDS)
def test_ids_are_the_librarys(spark, sf001, kind, path):
    texts = [r.text for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()] + ODD
    ours = kind(path)
    for _ in range(2):  # the second time from what is kept
        assert encoded(ours, texts) == library(path, texts)
    assert encoded(kind(path), [None, "a"]) == library(path, ["", "a"])


_TEXT = st.lists(st.sampled_from([*"ab'sT,.1\n\té\x00\x1c \u0301\u00a0\u2003", "  "]), max_size=30).map("".join)


@pytest.mark.parametrize(("kind", "path"), KINDS)
def test_any_text(kind, path):
    ours, theirs = kind(path), Tokenizer.from_file(path)
    theirs.encode_special_tokens = True

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.one_of(_TEXT, st.text(max_size=20)), max_size=6))
    def check(texts):
        expected = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
        assert encoded(ours, texts) == expected

    check()


def test_few_chunks_kept(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_CHUNKS", 3)
    monkeypatch.setattr(tokens, "MAX_WORDS", 3)
    monkeypatch.setattr(tokens, "MAX_KEPT_CHARS", 2)
    monkeypatch.setattr(tokens, "CALL_WORDS", 2)
    monkeypatch.setattr(tokens, "GROUP_BYTES", 5)
    texts = ["a b c d e", "b c dddd", "f g h i", "a b dddd", "x, yyyy."]
    for kind, path in KINDS:
        assert encoded(kind(path), texts) == library(path, texts)


def test_only_mixed_chunks_are_cut_one_by_one(monkeypatch):
    texts = ["Plain words, (and) 12 numbers-½² of Été übers×Ÿ!", None, "", "of Plain; it's WORDS plain", "übers 日本 " + "z" * 200]
    one_by_one, words = [], tokens.WordTokenizer._words
    monkeypatch.setattr(tokens.WordTokenizer, "_words", lambda self, chunks: one_by_one.extend(chunks) or words(self, chunks))
    ours = tokens.WordTokenizer(WORDS)
    for _ in range(2):
        assert encoded(ours, texts) == library(WORDS, [t or "" for t in texts])
    assert sorted(one_by_one) == ["it's", "日本"]


_LATIN = st.text(st.sampled_from("aAsStérEÉlL'’.,-1²½ªº×µßİıŸſŉ\xad\xa0\x85¡ \t\n\x1c\x7fΣσ\u0301\u0331H日😀"), max_size=24)


def test_any_latin_text():
    ours, theirs = tokens.WordTokenizer(WORDS), Tokenizer.from_file(WORDS)

    @settings(max_examples=600, deadline=None)
    @given(st.lists(_LATIN, max_size=8))
    def check(texts):
        expected = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
        assert encoded(ours, texts) == expected
        assert encoded(ours, texts + texts)[len(texts) :] == expected
        part = pa.array(["skipped é", *texts], pa.string()).slice(1)
        assert [ids.tolist() for ids in ours.encode(part)] == expected

    check()


# -- packing ----------------------------------------------------------------


def check_packing(lengths, sequence, offset, capacity):
    runs = defaultdict(list)
    for length, s, o in zip(lengths, sequence, offset, strict=True):
        runs[s].append((o, length))
    for run in runs.values():
        at = 0
        for o, length in sorted(run):
            assert o == at
            at += length
        assert at <= capacity
    return len(runs)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80))
def test_packing_rules(lengths):
    sequence, offset = packing.pack_lengths(np.array(lengths, np.int64), 60)
    used = check_packing(lengths, sequence, offset, 60)
    large = Counter(s for length, s in zip(lengths, sequence, strict=True) if 3 * length > 60)
    assert max(large.values(), default=0) <= 2
    assert used <= max(1, -(-sum(lengths) // 60)) * 4 / 3 + 2


def plain_fills(lengths, capacity):
    """The sequences' fill levels, items taken one at a time."""
    large, fills = sorted((n for n in lengths if 3 * n > capacity), reverse=True), []
    while large:
        one = large.pop(0)
        second = next((n for n in large if one + n <= capacity), 0)
        if second:
            large.remove(second)
        fills.append(one + second)
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fitting = [f for f in fills if f + n <= capacity]
        if fitting:
            fills.remove(max(fitting))
        fills.append(max(fitting, default=0) + n)
    return sorted(fills)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 60), st.sampled_from([1, 7, 19, 20, 21, 30, 41])), max_size=120))
def test_packing_equals_one_at_a_time(lengths):
    sequence, offset = packing.pack_lengths(np.array(lengths, np.int64), 60)
    fills = Counter()
    for s, n in zip(sequence.tolist(), lengths, strict=True):
        fills[s] += n
    assert sorted(fills.values()) == plain_fills(lengths, 60)
    assert sorted(fills) == list(range(len(fills)))
    check_packing(lengths, sequence, offset, 60)


def test_packing_keeps_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 500)
    big = 2**53 + 1
    rows = [(None, 100, "a", 1, None)] + [(big + 2 * i, 700, "b", 2, 0.5) for i in range(30)] + [(7, 512, "c", 3, None)] * 4000
    names = ["doc_id", "length", "bucket", "rank", "row"]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, length long, bucket string, rank int, row double").repartition(3)).collect()
    assert Counter(tuple(r[n] for n in names) for r in found) == Counter(rows)
    used = check_packing([r.length for r in found], [r.sequence_id for r in found], [r.offset for r in found], 2048)
    assert used == len(plain_fills([r[1] for r in rows], 2048))


def test_packing_is_tight():
    lengths = np.random.default_rng(1).integers(1, 2049, 8000)
    small = np.random.default_rng(2).integers(1, 300, 8000)
    for found in (lengths, np.concatenate([lengths, small])):
        sequence, offset = packing.pack_lengths(found)
        used = check_packing(found.tolist(), sequence.tolist(), offset.tolist(), 2048)
        assert used <= 1.01 * found.sum() / 2048 + 1


def test_pieces(spark, sf001):
    rows = packing.op4_best_fit(spark, sf001).collect()
    docs = dict(spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect())
    expected = {k: [*i, 0] for k, i in zip(docs, library(BYTES, list(docs.values())), strict=True)}
    by_doc = defaultdict(list)
    for r in rows:
        own = expected[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
    assert set(by_doc) == set(docs)
    for doc_id, found in by_doc.items():
        found.sort()
        assert [p for p, _, _ in found] == list(range(len(found)))
        assert [s for _, s, _ in found] == np.cumsum([0, *(n for _, _, n in found)]).tolist()[:-1]
        assert sum(n for _, _, n in found) == len(expected[doc_id]) and all(n == 2048 for _, _, n in found[1:])
    used = check_packing([r.length for r in rows], [r.sequence_id for r in rows], [r.offset for r in rows], 2048)
    assert used <= 1.01 * sum(r.length for r in rows) / 2048 + 1


def test_sequences_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 2)
    rows = [(1, None, 5), (1, "a b", 5), (1, "a b", 5), (None, "", None), (2, "word " * 5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset long")
    found = packing.sequences(docs, BYTES).collect()
    texts = library(BYTES, [r[1] or "" for r in rows])
    assert sum(len(r.ids) // 4 for r in found) == sum(len(t) + 1 for t in texts)
    for r in found:
        assert len(r.ids) == 4 * sum(p.length for p in r.pieces) <= 4 * 2048
    assert packing.pack_documents(docs.limit(0), BYTES).collect() == []
    with_ids = packing.pieces(docs, BYTES, keep_ids=True).collect()
    assert [r.start for r in with_ids if r.doc_id == 2] == np.cumsum([0, *(r.length for r in with_ids if r.doc_id == 2)]).tolist()[:-1]


# -- Huffman files ----------------------------------------------------------


def shortest(counts, longest):
    """Package-merge by its definition, with lists of symbols."""
    leaves = sorted((c, (i,)) for i, c in enumerate(counts) if c)
    level = leaves
    for _ in range(longest - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = sorted(leaves + pairs, key=lambda x: x[0])
    bits = Counter(i for _, symbols in level[: 2 * len(leaves) - 2] for i in symbols)
    return sum(counts[i] * n for i, n in bits.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=2, max_size=30), st.integers(5, 8))
def test_code_lengths(counts, longest):
    counts = np.array(counts, np.int64)
    bits = huffman.code_lengths(counts, longest).astype(int)
    used = counts > 0
    assert (bits[used] > 0).all() and (bits[~used] == 0).all() and bits.max(initial=0) <= longest
    assert sum(2.0 ** -bits[used]) <= 1
    if used.sum() > 1:
        assert (bits * counts).sum() == shortest(counts.tolist(), longest)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.integers(1, 400), st.integers(0, 9))
def test_codes_round_trip(n, symbols, seed):
    rng = np.random.default_rng(seed)
    ids = (rng.pareto(0.4, n).astype(np.int64) % symbols).astype(np.uint32)
    bits = huffman.code_lengths(np.bincount(ids, minlength=symbols))
    payload, checkpoints = huffman.encode(ids, bits, huffman.canonical_codes(bits))
    counts = np.minimum(huffman.SEGMENT, n - np.arange(0, n, huffman.SEGMENT))
    assert (huffman.decode(payload, checkpoints, counts, huffman.decode_table(bits)) == ids).all()
    if n > huffman.SEGMENT:  # a segment decodes on its own
        one = huffman.decode(payload, checkpoints[1:2], counts[1:2], huffman.decode_table(bits))
        assert (one == ids[huffman.SEGMENT : 2 * huffman.SEGMENT]).all()


def test_codes_of_the_limit():
    counts = np.array([2**i for i in range(40)])
    assert huffman.code_lengths(counts).max() == huffman.MAX_BITS
    with pytest.raises(ValueError, match="longer"):
        huffman.code_lengths(np.ones(9, np.int64), 3)


def expected_files(docs, texts):
    ids = [[*i, 1] for i in library(WORDS, texts)]
    order = sorted(range(len(docs)), key=lambda i: docs[i])
    out, start = {}, 0
    for i in order:
        out[docs[i]] = (start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes()))
        start += len(ids[i])
    return out


@pytest.mark.parametrize(("rows", "block"), [(8192, 65_536), (30, 5000)])
def test_files_round_trip(spark, sf001, monkeypatch, rows, block):
    monkeypatch.setattr(ranges, "RANGE_ROWS", rows)
    monkeypatch.setattr(huffman, "BLOCK_IDS", block)
    docs = spark.read.parquet(f"{sf001}/documents.parquet").collect()
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in huffman.op7_huffman(spark, sf001).collect()}
    assert found == expected_files([d.doc_id for d in docs], [d.text for d in docs])


def test_files_of_odd_rows(spark, tmp_path):
    rows = [(3, None, 1), (1, "", 2), (1, "", 2), (None, "x", 3), (2, "long words " * 30_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, range long")
    huffman.write(docs, WORDS, f"{tmp_path}/a")
    found = sorted((r.start, r.doc_id, r.n_tokens) for r in huffman.read(spark, f"{tmp_path}/a").collect())
    assert found == [(0, None, 2), (2, 1, 1), (3, 1, 1), (4, 2, 60_001), (60_005, 3, 1)]
    huffman.write(docs.limit(0), WORDS, f"{tmp_path}/b")
    assert huffman.read(spark, f"{tmp_path}/b").collect() == []


def test_files_of_hot_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 10)
    monkeypatch.setattr(huffman, "DECODE_IDS", 100)
    rows = [([None, 50, i][i % 3], f"text number {i * i} " * (i % 7)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64("text")).collect()]
    order.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    huffman.write(docs, WORDS, f"{tmp_path}/a")
    found = sorted((tuple(r) for r in huffman.read(spark, f"{tmp_path}/a").collect()), key=lambda r: r[1])
    wanted, start = [], 0
    for (doc_id, _, _), ids in zip(order, library(WORDS, [r[1] for r in order]), strict=True):
        wanted.append((doc_id, start, len(ids) + 1, np.array([*ids, 1], "<u4").tobytes()))
        start += len(ids) + 1
    assert found == wanted
