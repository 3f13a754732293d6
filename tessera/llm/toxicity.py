"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon maps words to their kinds: insult, threat, target, negation, report, or other.
Five transducers, given as tables of arcs, read a clause's kinds, a symbol each, one after another:
negation marks what is denied, report what is quoted, threat what is aimed at a
target, target the insults that go at someone, and insult names the patterns. They
are composed into one machine by code; the best path through it gives a clause's
patterns, each with its word's weight. A logistic model adds up the patterns of a
document.

The seed lexicon is fixed. Labelled documents add words and stems that mark the
toxic ones, with their log odds as weights. Pattern weights are fitted out of
fold: each half of the labelled documents is matched with the lexicon of the
other, so words that only fitted by chance don't count.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Hashable, Iterator
from dataclasses import dataclass, field
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.labelled import held_out, training
from tessera.llm.workers import prepare

#: A document scoring as much is rejected.
THRESHOLD = 0.5

#: Seed words by kind.
INSULTS = frozenset(
    "idiot idiots moron morons stupid scum trash loser losers pathetic disgusting worthless clown clowns dumb fool jerk "
    "imbecile vermin bastard bitch asshole dumbass filth idiota estúpido imbécil basura crétin connard ordure salaud "
    "dummkopf arschloch trottel abschaum versager".split()
)
THREATS = frozenset("kill murder strangle stab shoot destroy töten umbringen tuer matar".split())
TARGETS = frozenset(
    "you your yours he she him her his they them their these those du dich dir ihr euch tu te toi vous usted tú ti ustedes".split()
)
NEGATIONS = frozenset("not no never neither nor without isn aren wasn weren don doesn nicht kein keine nie pas jamais nunca".split())
REPORTS = frozenset(
    "said says say called calls wrote writes claimed claims reported quoted quote allegedly sagte sagt nannte dit disait dijo dice".split()
)

#: A stem is a word's first so many characters.
STEMS = (4, 5, 6, 7)
#: A learned form needs so many toxic documents, such a share of its documents (a stem more, as it also
#: starts words that are harmless), and to be so many deviations above chance.
LEAST_DOCS, LEAST_SHARE, LEAST_STEM_SHARE, LEAST_Z = 4, 0.75, 0.92, 6.0
SEED_WEIGHT = 4.0
#: Words between a negation or a target and what it bears on.
REACH = 3
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;\n]")
PATTERNS = ("plain", "targeted", "negated", "reported", "threat")


# -- transducers ------------------------------------------------------------


@dataclass(frozen=True)
class Machine:
    """A weighted transducer: arcs of a state by what they read, as (written, weight, next state).

    It starts in state start and may end in the states of ends. Of a string's paths the
    one with the largest sum of weights counts.
    """

    start: Hashable
    ends: frozenset
    arcs: dict[Hashable, dict[str, list[tuple[str, float, Hashable]]]]

    def compose(self, other: Machine) -> Machine:
        """The machine whose paths are a path of this one and one of other that reads what it writes."""
        start = (self.start, other.start)
        arcs, waiting = {}, [start]
        while waiting:
            state = waiting.pop()
            if state in arcs:
                continue
            arcs[state] = own = {}
            for read, found in self.arcs[state[0]].items():
                pairs = [(w2, x + y, (a, b)) for w1, x, a in found for w2, y, b in other.arcs[state[1]].get(w1, ())]
                if pairs:
                    own[read] = pairs
                    waiting += [p[2] for p in pairs]
        return Machine(start, frozenset(s for s in arcs if s[0] in self.ends and s[1] in other.ends), arcs)

    def numbered(self) -> Machine:
        """The same machine with numbers for states."""
        names = {s: i for i, s in enumerate(self.arcs)}
        arcs = {names[s]: {r: [(w, x, names[n]) for w, x, n in found] for r, found in own.items()} for s, own in self.arcs.items()}
        return Machine(names[self.start], frozenset(names[s] for s in self.ends), arcs)

    def best(self, symbols: list[str]) -> tuple[list[str], float]:
        """What the best path for symbols writes, and its weight; of equal ones the first by the order of arcs."""
        reached: dict[Hashable, tuple[float, tuple | None]] = {self.start: (0.0, None)}
        for symbol in symbols:
            step: dict[Hashable, tuple[float, tuple | None]] = {}
            for state, (weight, path) in reached.items():
                for written, more, after in self.arcs[state].get(symbol, ()):
                    if after not in step or weight + more > step[after][0]:
                        step[after] = (weight + more, (written, path))
            reached = step
        weight, path = max((v for s, v in reached.items() if s in self.ends), key=lambda v: v[0])
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        return out[::-1], weight


#: Symbols: other, insult, threat, target, negation, report; then as marked by the machines.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "oitynr"
SYMBOLS = {"other": OTHER, "insult": INSULT, "threat": THREAT, "target": TARGET, "negation": NEGATION, "report": REPORT}
DENIED, QUOTED, AIMED, QUOTED_THREAT, HIT, QUOTED_HIT = "i-", "i'", "i+", "t'", "y!", "y'"


def negation_machine() -> Machine:
    """States: words that the last negation still reaches. Denied threats are no threats."""
    arcs = {}
    for left in range(REACH + 1):
        after = max(left - 1, 0)
        own = {s: [(s, 0.0, after)] for s in (OTHER, TARGET, REPORT)}
        own[NEGATION] = [(OTHER, 0.0, REACH)]
        own[INSULT] = [(DENIED if left else INSULT, 0.0, after)]
        own[THREAT] = [(OTHER if left else THREAT, 0.0, after)]
        arcs[left] = own
    return Machine(0, frozenset(arcs), arcs)


def report_machine() -> Machine:
    """States: whether the clause reports speech by now."""
    arcs = {}
    for reported in (False, True):
        own = {s: [(s, 0.0, reported)] for s in (OTHER, TARGET, DENIED)}
        own[REPORT] = [(OTHER, 0.0, True)]
        own[INSULT] = [(QUOTED if reported else INSULT, 0.0, reported)]
        own[THREAT] = [(QUOTED_THREAT if reported else THREAT, 0.0, reported)]
        arcs[reported] = own
    return Machine(False, frozenset(arcs), arcs)


def threat_machine() -> Machine:
    """States: the words left in which a threat must meet its target, and how that is written; () waits for none.

    A threat may also be let go, which weighs less than one that meets a target.
    """
    same = (OTHER, INSULT, DENIED, QUOTED)
    begin = {THREAT: (HIT, REACH), QUOTED_THREAT: (QUOTED_HIT, REACH)}
    free = {s: [(s, 0.0, ())] for s in (*same, TARGET)} | {t: [(OTHER, 0.0, ()), (OTHER, 0.0, owed)] for t, owed in begin.items()}
    arcs = {(): free}
    for hit, _ in begin.values():
        for left in range(1, REACH + 1):
            own = {TARGET: [(hit, 1.0, ())]}
            if left > 1:
                own |= {s: [(OTHER if s in begin else s, 0.0, (hit, left - 1))] for s in (*same, *begin)}
            arcs[hit, left] = own
    return Machine((), frozenset([()]), arcs)


def target_machine() -> Machine:
    """States: words that the last target still reaches, and words left in which a target must follow (0: none must).

    An insult is aimed if a target stands before it, or if one follows, which its path has to make good.
    """
    arcs = {}
    for back in range(REACH + 1):
        for owed in range(REACH + 1):
            own = {s: [(s, 0.0, (REACH, 0))] for s in (TARGET, HIT, QUOTED_HIT)}
            if owed != 1:
                after, still = max(back - 1, 0), max(owed - 1, 0)
                own |= {s: [(s, 0.0, (after, still))] for s in (OTHER, DENIED, QUOTED)}
                if back:
                    own[INSULT] = [(AIMED, 1.0, (after, still))]
                else:
                    own[INSULT] = [(INSULT, 0.0, (after, still)), (AIMED, 1.0, (after, still or REACH))]
            arcs[back, owed] = own
    return Machine((0, 0), frozenset(s for s in arcs if not s[1]), arcs)


def insult_machine() -> Machine:
    """One state; it names the patterns."""
    names = {INSULT: "plain", AIMED: "targeted", DENIED: "negated", QUOTED: "reported", HIT: "threat", QUOTED_HIT: "reported"}
    return Machine(0, frozenset([0]), {0: {s: [(names.get(s, ""), 0.0, 0)] for s in (*names, OTHER, TARGET)}})


@cache
def grammar_machine() -> Machine:
    """All five composed."""
    machines = [negation_machine(), report_machine(), threat_machine(), target_machine(), insult_machine()]
    return reduce(Machine.compose, machines).numbered()


# -- lexicon and clauses ----------------------------------------------------


def forms(word: str) -> list[str]:
    """What a word may be learned as: itself, and stems marked with *."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)]


@dataclass
class Lexicon:
    """Words to (kind, weight), None for other words; what was looked up is kept."""

    learned: dict[str, float]
    seen: dict[str, tuple[str, float] | None] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"learned": self.learned, "seen": {}}

    def look_up(self, word: str) -> tuple[str, float] | None:
        """The word's kind and weight; a function word is that, whatever was learned."""
        if word not in self.seen:
            if len(self.seen) > 300_000:
                self.seen.clear()
            self.seen[word] = self._kind(word)
        return self.seen[word]

    def _kind(self, word: str) -> tuple[str, float] | None:
        for kind, words in (("negation", NEGATIONS), ("report", REPORTS), ("target", TARGETS)):
            if word in words:
                return kind, 0.0
        weight = max((self.learned[f] for f in forms(word) if f in self.learned), default=0.0)
        if word in INSULTS:
            weight = max(weight, SEED_WEIGHT)
        if word in THREATS and not weight:
            return "threat", SEED_WEIGHT
        return ("insult", weight) if weight else None


def match(text: str, lexicon: Lexicon) -> list[tuple[str, float, int]]:
    """(pattern, weight, number of its clause) of each matched clause part, in order."""
    low = text.lower()
    look_up = lexicon.look_up
    bad = {w for w in set(_WORD.findall(low)) if (found := look_up(w)) and found[0] in ("insult", "threat")}
    if not bad:
        return []
    out: list[tuple[str, float, int]] = []
    for number, clause in enumerate(_CLAUSE.split(low)):
        words = _WORD.findall(clause)
        if bad.isdisjoint(words):
            continue
        found = [look_up(w) or ("other", 0.0) for w in words]
        written, _ = grammar_machine().best([SYMBOLS[kind] for kind, _ in found])
        out += [(pattern, weight or SEED_WEIGHT, number) for pattern, (_, weight) in zip(written, found, strict=True) if pattern]
    return out


def features(found: list[tuple[str, float, int]]) -> list[float]:
    """By pattern the total weight of matched clauses, dampened, and their number; then the largest weight of all."""
    best: dict[tuple[str, int], float] = {}
    for pattern, weight, clause in found:
        best[pattern, clause] = max(best.get((pattern, clause), 0.0), weight)
    total, clauses = dict.fromkeys(PATTERNS, 0.0), Counter(p for p, _ in best)
    for (pattern, _), weight in best.items():
        total[pattern] += weight
    return [*(math.log1p(total[p]) for p in PATTERNS), *(math.log1p(clauses[p]) for p in PATTERNS), max((w for _, w, _ in found), default=0.0)]


@dataclass
class Grammar:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        rows = np.array([features(match(t, self.lexicon)) for t in texts]).reshape(len(texts), len(self.weights))
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights + self.bias, -30, 30)))


def learn_lexicon(toxic: np.ndarray, clean: np.ndarray, names: list[str], toxic_docs: int, clean_docs: int) -> dict[str, float]:
    """Forms that mark toxic documents, with their log odds."""
    n = toxic + clean
    expected = n * toxic_docs / max(toxic_docs + clean_docs, 1)
    z = (toxic - expected) / np.sqrt(np.maximum(expected, 1e-9))
    share = np.array([LEAST_STEM_SHARE if f.endswith("*") else LEAST_SHARE for f in names])
    keep = (toxic >= LEAST_DOCS) & (toxic >= share * n) & (z >= LEAST_Z)
    odds = np.log((toxic + 0.5) / (toxic_docs + 1)) - np.log((clean + 0.5) / (clean_docs + 1))
    return {names[i]: float(odds[i]) for i in np.flatnonzero(keep)}


def fit_logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Newton's method; the bias is not shrunk."""
    x = np.column_stack([rows, np.ones(len(rows))])
    shrink = np.diag([ridge] * rows.shape[1] + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + shrink, x.T @ (labels - p) - shrink @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> Grammar:
    """From at most MAX_TRAIN labelled rows, equal texts counted once, with the largest of their labels.

    Form counts are summed by Spark, and only forms that pass the thresholds in all
    documents or in a half of them come to the driver: that number is bounded as the
    labelled rows are. Without both labels only the seed words count.
    """
    spark = docs.sparkSession
    prepare(spark)
    found = training(docs, labels, target).groupBy("text").agg(F.max("label").alias("label"))
    found = found.select("text", "label", (F.xxhash64("text") % 2 == 0).alias("fold"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter() for _ in range(4)]
        for batch in batches:
            for text, label, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = counts[2 * fold + label]
                own[""] += 1  # documents
                own.update({f for w in set(_WORD.findall(text.lower())) if len(w) > 2 for f in forms(w)})
        names = sorted(set().union(*counts))
        for i in range(0, len(names), 20_000):
            part = names[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([c[f] for f in part], pa.int64()) for c in counts)], names=["form", "c0", "t0", "c1", "t1"])

    counted = found.mapInArrow(count, "form string, c0 long, t0 long, c1 long, t1 long")
    counted = counted.groupBy("form").agg(*(F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")))
    c0, t0, c1, t1 = (F.col(c) for c in ("c0", "t0", "c1", "t1"))
    telling = F.col("form") == ""
    for toxic, clean in ((t0, c0), (t1, c1), (t0 + t1, c0 + c1)):
        telling |= (toxic >= LEAST_DOCS) & (toxic >= LEAST_SHARE * (toxic + clean))
    rows = sorted(counted.where(telling).collect())
    docs_of = rows.pop(0) if rows and rows[0].form == "" else None
    names = [r.form for r in rows]
    c0, t0, c1, t1 = (np.array([r[k] for r in rows], float).reshape(-1) for k in ("c0", "t0", "c1", "t1"))
    n = [docs_of[k] for k in ("c0", "t0", "c1", "t1")] if docs_of else [0] * 4
    both = Lexicon(learn_lexicon(t0 + t1, c0 + c1, names, n[1] + n[3], n[0] + n[2]))
    halves = [Lexicon(learn_lexicon(t1, c1, names, n[3], n[2])), Lexicon(learn_lexicon(t0, c0, names, n[1], n[0]))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, given, folds = (c.to_pylist() for c in batch.columns)
            out = [features(match(t, halves[fold])) for t, fold in zip(texts, folds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())), pa.array(given, pa.int32())], names=["row", "label"])

    rows = sorted(found.mapInArrow(measure, "row array<double>, label int").collect(), key=lambda r: (r.label, r.row))
    given = np.array([r.label for r in rows], float)
    if len(set(given.tolist())) < 2:
        weights = np.array([1.5, 2.0, 0.3, 0.3, 2.0, *[0.0] * len(PATTERNS), 0.0])
        return Grammar(both, weights, -2.0)
    return Grammar(both, *fit_logistic(np.array([r.row for r in rows]), given))


def score(docs: DataFrame, grammar: Grammar, name: str = "score") -> DataFrame:
    """docs with the score in column name; one of that name is replaced. A null text scores as an empty one.

    Other columns are kept as they are, repeated rows score alike, and an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    docs = docs.drop(name)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(grammar.score([t or "" for t in batch.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, f"{fields}, `{name}` double")


def op5_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    grammar = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), grammar)
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)
