import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import audio, dedup, quality, toxicity

ROWS = "doc_id long, text string, score int"


# -- near duplicates --------------------------------------------------------


def plain_set(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(docs):
    sets = {i: plain_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dedup, "LIMIT", 20 * dedup.BASE_WEIGHT)
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    # a hot group of copies that are near each other or not quite, exact copies, and a shared passage
    texts = [edited(rng, base, rng.randint(0, 6)) for _ in range(120)] + ["same text of the very same words"] * 10
    texts += [" ".join([*base[:20], *(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60)))]) for _ in range(60)]
    texts += ["", None, "A", "a", "one two", "ONE Two", "one\xa0two three", " ".join(["x"] * 9000), " ".join(["x"] * 9001)]
    rng.shuffle(texts)
    docs = [(7 * i, t) for i, t in enumerate(texts)]
    found = dedup.groups(spark.createDataFrame([(*d, 0) for d in docs], ROWS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == plain_groups(docs)


def test_groups_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c", 1), (None, None, 1), (4, "a b c", 1), (4, "a b c", 2), (9, "a b c", 3)], ROWS)
    found = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in dedup.groups(docs).collect())
    assert found == {(None, 1, None, True): 1, (None, 0, None, True): 1, (4, 1, 4, True): 2, (9, 1, 4, False): 1}
    assert sorted(str(r.doc_id) for r in dedup.keep_first(docs).collect()) == ["4", "None", "None"]
    assert dedup.groups(docs.limit(0)).collect() == []


def test_shingles_in_small_pieces(monkeypatch):
    texts = pa.array(["a b c d e f g", None, " a  b c d e f G\n", "", "a b"])
    whole = [s.tolist() for s in dedup.shingle_sets(texts)]
    monkeypatch.setattr(dedup, "GROUP_BYTES", 3)
    assert [s.tolist() for s in dedup.shingle_sets(texts)] == whole
    assert whole[0] == whole[2] and [len(s) for s in whole] == [3, 0, 3, 0, 1]


def test_posterior_bounds():
    needed = dedup.least_matches()
    assert (np.diff(needed) > 0).all() and 60 < needed[-1] < 80


# -- quality ----------------------------------------------------------------


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize(("query", "column", "least"), [(quality.op2_quality_trees, "quality", 0.95), (toxicity.op5_toxic_grammar, "toxic", 0.94)])
def test_held_out_accuracy(spark, query, column, least):
    folder = "/root/testdata/sf0.01"
    labels = dict(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", column).collect())
    rows = query(spark, folder).collect()
    assert len(rows) == 1000 and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.doc_id in labels and r.held_out]
    assert sum(r.predicted == labels[r.doc_id] for r in own) >= least * len(own)


def test_trees_walk_as_they_split():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(2000, 5))
    labels = ((rows[:, 0] > 0.3) ^ (rows[:, 3] < -0.2)).astype(float)
    trees = quality.fit(rows[:1500], labels[:1500])
    assert ((trees.score(rows[1500:]) > 0.5) == labels[1500:]).mean() > 0.97
    one = rows[1500]
    total = trees.base
    for root in trees.roots:
        node = root
        while trees.children[node][0] != node:
            node = trees.children[node][int(one[trees.feature[node]] > trees.threshold[node])]
        total += trees.value[node]
    assert trees.score(one[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))


@pytest.mark.parametrize("module", [quality, toxicity])
def test_models_of_odd_rows(spark, module):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 2), (1, "idiot " * 20_000, 3), (2, "fine words", None)], ROWS)
    for labels in ([], [(1, None), (2, 1), (2, 0), (None, 1)]):
        frame = spark.createDataFrame(labels, f"doc_id long, {module.train.__defaults__[0]} int")
        rows = module.score(docs, module.train(docs, frame)).collect()
        assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
        assert rows[0].score == rows[1].score
    assert module.score(docs.limit(0), module.train(docs, frame)).collect() == []


# -- toxicity ---------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "patterns"),
    [
        ("what a lovely day", []),
        ("Idiot!", ["plain"]),
        ("you are an idiot", ["targeted"]),
        ("the idiot hurt you", ["targeted"]),
        ("he is not an idiot", ["negated"]),
        ("they said he is a moron", ["reported"]),
        ("not here. scum", ["plain"]),
        ("I will kill you", ["threat"]),
        ("I will not kill you", []),
        ("kill the light", []),
        ("they said: I will kill you", ["reported"]),
        ("idiot; loser\nclown", ["plain"] * 3),
    ],
)
def test_clauses(text, patterns):
    assert [p for p, _, _ in toxicity.match(text, toxicity.Lexicon({}))] == patterns


def test_learned_stems():
    lexicon = toxicity.Lexicon({"grumf*": 5.0, "blorp": 3.0})
    assert lexicon.look_up("grumfing") == ("insult", 5.0)
    assert lexicon.look_up("blorps") is None and lexicon.look_up("blorp") == ("insult", 3.0)
    names = ["bad", "even", "rare"]
    found = toxicity.learn_lexicon(np.array([40.0, 20, 2]), np.array([1.0, 180, 0]), names, 100, 900)
    assert list(found) == ["bad"]


def every_path(machine, symbols):
    """(written, weight) of all paths, by recursion."""

    def go(state, rest):
        if not rest:
            return [((), 0.0)] if state in machine.ends else []
        return [((w, *more), x + y) for w, x, n in machine.arcs[state].get(rest[0], ()) for more, y in go(n, rest[1:])]

    return go(machine.start, tuple(symbols))


def test_composition_equals_paths_one_after_another():
    machines = [toxicity.negation_machine(), toxicity.report_machine(), toxicity.threat_machine(), toxicity.target_machine(), toxicity.insult_machine()]
    rng = random.Random(8)
    for _ in range(400):
        symbols = rng.choices("oityynr", k=rng.randint(0, 8))
        found = {tuple(symbols): 0.0}
        for machine in machines:
            step = {}
            for written, weight in found.items():
                for more, extra in every_path(machine, written):
                    step[more] = max(step.get(more, -1.0), weight + extra)
            found = step
        written, weight = toxicity.grammar_machine().best(symbols)
        assert weight == max(found.values()) and found[tuple(written)] == weight, symbols


def test_equal_texts_and_repeated_ids_train_alike(spark):
    docs = spark.createDataFrame([(1, "same text", 0), (2, "same text", 0), (3, "b", 0), (3, "a", 0)] * 50, ROWS)
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.training(docs, labels, "toxic").collect())) == [(i, t, v) for i, t, v in ((1, "same text", 0), (2, "same text", 1), (3, "a", 1)) if not held(i)]


# -- audio ------------------------------------------------------------------


def recording(seed, seconds=8, noise=0.0):
    rng = np.random.default_rng(seed)
    time = np.arange(1000) / audio.RATE
    notes = [np.sin(2 * np.pi * 220 * 2 ** (n / 12) * time) for n in rng.integers(0, 24, 4 * seconds)]
    return np.concatenate(notes) + noise * rng.normal(size=4000 * seconds)


def test_integral_image_filters():
    image = audio.chroma(recording(1))
    found = audio.fingerprint(recording(1))
    assert len(found) == len(image) - audio.SPAN + 1
    kind, low, classes, width = audio.FILTERS[0]
    part = image[:width, low : low + classes]
    contrast = (2 * part[: width // 2].sum() - part.sum()) / part.sum()
    level = int(np.searchsorted(audio.LEVELS, contrast))
    assert found[0] >> 30 == level ^ (level >> 1)


def test_recordings_align(spark):
    song = recording(1, 12)
    rows = [(0, song), (1, recording(1, 12, 0.01)), (2, song), (3, song[4 * audio.HOP :]), (4, recording(9, 12)), (5, song[:500]), (6, None), (7, np.zeros(20_000))]
    frame = spark.createDataFrame([(i, s if s is None else s.tolist()) for i, s in rows], "id long, samples array<double>")
    found = audio.fingerprints(frame)
    queries = spark.createDataFrame([(2,), (5,), (8,)], "query long")
    hits = {r.id: r for r in audio.search(found, queries).collect()}
    assert {r.query for r in hits.values()} == {2}
    assert hits[0].members >= 2 and hits[0].bit_error == 0
    assert hits[3].offset == 4 and hits[3].bit_error < 0.05 and 4 not in hits
    assert audio.search(found.limit(0), queries).collect() == []
    assert audio.bit_error(np.zeros(3, np.uint32), np.zeros(3, np.uint32), 3) == 1.0


def best_match(a, b):
    """Over every offset: the equal bits beyond chance where enough of two recordings overlaps with few errors, or None."""
    best = None
    for offset in range(1 - len(b), len(a)):
        start, end = max(0, offset), min(len(a), len(b) + offset)
        error = audio.bit_error(a, b, offset)
        if end - start >= audio.LEAST_OVERLAP and error <= audio.MOST_ERRORS:
            best = max(best or 0, round(32 * (end - start) * (1 - 2 * error)))
    return best


def test_noisy_shifted_and_cut_recordings_are_found(spark):
    rows, rng = [], np.random.default_rng(2)
    for i in range(60):
        song = recording(100 + i, 12)
        moved = (song, song[3 * audio.HOP :], song[: len(song) * 2 // 3], song[200:])[i % 4]
        rows += [(2 * i, song), (2 * i + 1, moved + 0.8 * i / 60 * rng.normal(size=len(moved)))]
    rows += [(200, np.zeros(30_000)), (201, np.zeros(34_000)), (202, song[:9000]), (203, recording(7, 30))]
    found = audio.fingerprints(spark.createDataFrame([(i, s.tolist()) for i, s in rows], "id long, samples array<double>"))
    frames = {r.id: np.frombuffer(r.frames, "<u4") for r in found.collect()}
    asked = [*range(0, 120, 2), 200, 202, 203]
    hits = {(r.query, r.id): r for r in audio.search(found, spark.createDataFrame([(i,) for i in asked], "query long")).collect()}
    wanted = {(a, b): m for a in asked for b in frames if (m := best_match(frames[a], frames[b]))}
    assert set(hits) <= set(wanted) and (200, 201) in hits and (200, 200) in hits and (202, 202) not in hits
    pairs = {k for k in wanted if k[0] != k[1]}
    assert len(pairs) > 40 and len(pairs & set(hits)) >= 0.97 * len(pairs)
    best = 0
    for (a, b), hit in hits.items():
        start, end = max(0, hit.offset), min(len(frames[a]), len(frames[b]) + hit.offset)
        assert hit.bit_error == pytest.approx(audio.bit_error(frames[a], frames[b], hit.offset)) and hit.votes > 0
        best += round(32 * (end - start) * (1 - 2 * hit.bit_error)) == wanted[a, b]
    assert best >= 0.97 * len(hits)


def test_recordings_of_odd_rows(spark):
    song = recording(3, 12).tolist()
    rows = [(1, song, "x"), (1, song, "y"), (1, recording(4, 12).tolist(), "z"), (None, song, ""), (2, [None, *song], ""), (3, [], ""), (4, None, "")]
    found = audio.fingerprints(spark.createDataFrame(rows, "id long, samples array<double>, frames string"))
    assert found.columns == ["id", "frames"] and found.count() == 7
    hits = audio.search(found, spark.createDataFrame([(1,), (1,), (3,), (None,), (77,)], "query long")).collect()
    # two recordings go by the id 1; row 2 is row 1 a sample later
    assert Counter((r.query, r.id, r.members) for r in hits if r.id == 1) == {(1, 1, 2): 1, (1, 1, 1): 1}
    assert {(r.query, r.id) for r in hits} == {(1, 1), (1, 2)}


def test_the_query_plays_all_vectors(spark, sf001):
    vectors = spark.read.parquet(f"{sf001}/embeddings.parquet").select("vec_id", "embedding").collect()
    frames = {r.vec_id: audio.fingerprint(audio.notes(np.array(r.embedding))) for r in vectors}
    wanted = {(a, b) for a in frames if a % 100 == 0 for b in frames if best_match(frames[a], frames[b])}
    hits = {(r.query, r.id): r for r in audio.op9_chroma(spark, sf001).collect()}
    assert set(hits) <= wanted and len(hits) >= 0.9 * len(wanted)
    assert all(hits[a, a].bit_error == 0 and hits[a, a].offset == 0 and hits[a, a].votes >= 100 for a in frames if a % 100 == 0)


# -- pipeline ---------------------------------------------------------------


def test_pipeline_stages(spark, sf001, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    names, labels = docs.columns, {r.doc_id: r for r in spark.read.parquet(f"{sf001}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near-dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, sf001)
        docs.write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        ids, old = Counter(r.doc_id for r in docs.select("doc_id").collect()), Counter(r.doc_id for r in before.select("doc_id").collect())
        assert docs.count() and set(ids) <= set(old)
        if name != "packing":
            assert docs.columns == names
        if name in ("toxicity", "quality"):
            wanted = {i for i in old if i in labels and (labels[i].toxic == 0 if name == "toxicity" else labels[i].quality == 1)}
            assert len(wanted & set(ids)) >= 0.93 * len(wanted)
        if name == "near-dedup":
            assert set(ids) == {i for i, (_, _, kept) in plain_groups(before.select("doc_id", "text").collect()).items() if kept}
        if name == "mixing":
            assert max(ids.values()) <= 3
        if name == "packing":
            assert docs.where("piece = 0").count() == sum(old.values())


def test_pipeline_stages_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    text = "the quiet harbour town kept a long and careful record of every ship that came in. " * 30
    rows = [(1, text, "a", "x"), (2, text, None, "y"), (2, text, None, "y"), (None, text, "a", "z"), (5, None, "b", "n"), (6, "", "b", "e"), (7, "you idiot, you stupid worthless moron!", "b", "t")]
    docs = spark.createDataFrame([(*r, 0.25, 3, "k") for r in rows], "doc_id long, text string, source string, mark string, score double, mix_order int, text_key string")
    empty = docs.limit(0)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []
        found = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert found.columns == docs.columns
        kept[name] = found.collect()
    assert {r.mark for r in kept["toxicity"]} == {"x", "y", "z", "n", "e"} and len(kept["toxicity"]) == 6
    assert Counter(r.mark for r in kept["near-dedup"]) == Counter("xznet")
    assert all((r.score, r.mix_order, r.text_key) == (0.25, 3, "k") for name in ("toxicity", "quality", "near-dedup", "mixing") for r in kept[name])
    assert {r.mark: n for r, n in Counter(kept["quality"]).items()}.get("y", 2) == 2
    assert Counter(r.doc_id for r in kept["packing"] if r.piece == 0) == Counter(r[0] for r in rows)
