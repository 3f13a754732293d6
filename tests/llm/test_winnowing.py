import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import ranges, winnowing
from tessera.llm.winnowing import K, WINDOW, Print, likeness, scale, winnow


def plain(text, at_scale=None):
    """By definition: hash each k-gram on its own, choose in each window."""
    if not text:
        return []
    k, window = at_scale or scale(len(text))
    codes = [ord(c) for c in text]
    codes += [0x110000 + i for i in range(k - len(codes))]
    hashes = []
    for i in range(len(codes) - k + 1):
        h = 0
        for c in codes[i : i + k]:
            h = (h * winnowing._BASE + c * winnowing._MIX) % 2**64
        hashes.append((h ^ (h >> 29)) * winnowing._MIX % 2**64 >> 24)
    chosen = set()
    for i in range(max(1, len(hashes) - window + 1)):
        seen = hashes[i : i + window]
        chosen.add(i + max(j for j, h in enumerate(seen) if h == min(seen)))
    return [(hashes[p], p) for p in sorted(chosen)]


def found(text):
    return list(zip(*(a.tolist() for a in winnow(text)), strict=True))


_TEXTS = st.one_of(st.text(max_size=300), st.text(st.sampled_from("ab"), max_size=300), st.integers(0, 200).map(lambda n: "x" * n))


@settings(max_examples=150, deadline=None)
@given(_TEXTS, st.sampled_from([None, (4, 1), (4, 64), (16, 2), (16, 64)]))
def test_definition(text, at_scale):
    hashes, places = winnow(text, at_scale)
    assert list(zip(hashes.tolist(), places.tolist(), strict=True)) == plain(text, at_scale)


def test_chunks(monkeypatch):
    text = "".join(chr(97 + i * i % 7 + i % 5) for i in range(3000)) + "z" * 500
    whole = found(text)
    monkeypatch.setattr(winnowing, "CHUNK", 100)
    assert found(text) == whole == plain(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80), st.text(min_size=K + WINDOW - 1, max_size=150), st.text(max_size=80), st.text(max_size=80))
def test_shared_passages_are_found(before, passage, after, other):
    a, b = found(before + passage + after), found(other + passage)
    places = {(h, p - len(before)) for h, p in a} & {(h, p - len(other)) for h, p in b}
    assert places


@pytest.mark.parametrize("chars", [0, 1, 3, 31, 32, 63, 64, 127, 128, 157, 158, 512, 1023, 1024, 10**6])
def test_scale(chars):
    k, window = scale(chars)
    assert k == (16 if chars >= 64 else 4) and window & (window - 1) == 0
    assert max(1, min(64, chars // 16)) // 2 < window <= max(1, min(64, chars // 16))
    if chars >= 7:
        assert k + window - 1 <= chars - chars // 2  # a kept half holds a whole window


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=7, max_size=400), st.text(max_size=400))
def test_a_text_that_keeps_half_is_found(text, after):
    half = len(text) // 2
    assert likeness(Print(text), Print(text[: len(text) - half] + after[:half])) > 0


@settings(max_examples=100, deadline=None)
@given(_TEXTS, st.sampled_from([1, 2, 4, 8, 16, 32]))
def test_smaller_windows_choose_what_larger_ones_do(text, window):
    assert len(text) < 4 + 2 * window or set(plain(text, (4, 2 * window))) <= set(plain(text, (4, window)))


def test_short_texts_differ_from_unlike_ones(sf001):
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{sf001}/documents.parquet").column("text").to_pylist() if t]
    texts = [t[i : i + n] for t in texts[:60] for n in (24, 40, 70, 120, 157) for i in [len(t) // 3] if len(t) > 3 * n]
    edited, after = [], []
    for i, text in enumerate(texts):
        other = texts[(i + 7) % len(texts)]
        half = len(text) // 2
        edited.append(likeness(Print(text), Print(text[: len(text) - half] + other[:half])))
        after.append(likeness(Print(text), Print(other)))
    assert min(edited) > 0.1 and sum(e > a for e, a in zip(edited, after, strict=True)) >= 0.97 * len(texts)


def expected(rows):
    """Rows of (doc_id, text) in descending order."""
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1] or ""
        text = text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        near = []
        for other in (edited, after):
            (k, window), (k2, window2) = scale(len(text)), scale(len(other))
            a, b = (set(winnow(t, (min(k, k2), max(window, window2)))[0].tolist()) for t in (text, other))
            near.append(len(a & b) / len(a | b) if a | b else 1.0)
        shown = [" ".join(f"{p}:{h:010x}" for h, p in found(t)) for t in (text, edited)]
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), *shown, *near)
    return out


@pytest.mark.parametrize("size", [8192, 30])
def test_edits(spark, sf001, monkeypatch, size):
    monkeypatch.setattr(ranges, "RANGE_ROWS", size)
    rows = winnowing.op8_winnowing(spark, sf001).collect()
    docs = sorted(map(tuple, spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    assert {r.doc_id: tuple(r)[1:] for r in rows} == expected(docs) and len(rows) == len(docs)


@pytest.mark.parametrize("size", [8192, 2, 1])
def test_edits_of_odd_rows(spark, monkeypatch, size):
    monkeypatch.setattr(ranges, "RANGE_ROWS", size)
    rows = [(9, "alpha " * 40), (7, None), (5, "é" * 51), (4, ""), (2, "word " * 40_000), (None, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in winnowing.compare_with_edits(docs).collect()} == expected(rows)
    same = spark.createDataFrame([(1, "a")] * 3, docs.schema)
    assert len(winnowing.compare_with_edits(same).collect()) == 3
    assert len(winnowing.compare_with_edits(same.limit(1)).collect()) == 1
    assert winnowing.compare_with_edits(docs.limit(0)).collect() == []


def hot_rows(spark, n=240):
    """A third of the rows have no id, a third share one; with the hashes of their texts."""
    rows = [([None, 50, i][i % 3], f"text number {i * i} " * (i % 7)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64("text")).collect()]


def test_hot_ids_have_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 10)
    docs, rows = hot_rows(spark)
    dealt = ranges.ranges_of(docs)
    found = [(tuple(r)[:2], r.r) for r in docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").withColumn("r", dealt.of(F.col("doc_id"), F.col("tie"))).select("doc_id", "tie", "r").collect()]
    found.sort(key=lambda x: (x[0][0] is not None, x[0]))
    numbers = [r for _, r in found]
    assert numbers == sorted(numbers) and 0 <= numbers[0] and numbers[-1] < dealt.count
    for hot in (None, 50):
        own = {(r, tie) for (i, tie), r in found if i == hot}  # rows alike in both can't be split
        assert len({r for r, _ in own}) >= 5 and max(sum(r == n for r, _ in own) for n in numbers) <= 30


def test_edits_of_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 10)
    docs, rows = hot_rows(spark)
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    wanted = expected([(i, text) for i, (_, text, _) in enumerate(rows)])
    found = Counter((r.doc_id, tuple(r)[1:]) for r in winnowing.compare_with_edits(docs).collect())
    assert found == Counter((r[0], wanted[i]) for i, r in enumerate(rows))


def test_fingerprint_arrays(spark):
    docs = spark.createDataFrame([("k", None, 1), (None, "some text " * 30, 2)], "doc_id string, text string, hashes int")
    rows = winnowing.fingerprint(docs).collect()
    assert (rows[0].hashes, rows[0].positions, rows[0].n_chars) == ([], [], 0)
    assert list(zip(rows[1].hashes, rows[1].positions, strict=True)) == found("some text " * 30)


@pytest.mark.parametrize("count", [0, 1, 5, 300, 3000])
def test_ranges(spark, count):
    bounds = list(range(10, 10 + 3 * count, 3))
    keys = spark.range(0, 3 * count + 30).select("id", ranges.range_of(F.col("id"), bounds).alias("r"))
    assert all(r == sum(b < i for b in bounds) for i, r in keys.sample(0.1, 3).collect())
