"""Quality by histogram gradient-boosted trees over document statistics.

Statistics are shares and averages of a whole text's characters, words and
lines. Trees split on bins of them; fitted trees are flattened into arrays, and
all rows of a batch walk a tree level by level in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.labelled import held_out, training
from tessera.llm.workers import prepare

#: A document scoring less is rejected.
THRESHOLD = 0.3
BINS, ROUNDS, DEPTH, RATE, LEAST_ROWS, RIDGE = 64, 80, 4, 0.15, 8, 1.0
_MARKS = "*#$%&!|.,?:;-_()[]{}<>/\\@+=~^'\""


def statistics(texts: list[str]) -> np.ndarray:
    """A row of numbers per text; an empty text gives zeros."""
    bytes_ = np.zeros((len(texts), 256))
    rest = np.zeros((len(texts), 14))
    for i, text in enumerate(texts):
        if not text:
            continue
        bytes_[i] = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        words, lines = text.split(), text.split("\n")
        n = max(len(words), 1)
        counts, lengths = Counter(words), list(map(len, words)) or [0]
        pairs = set(zip(words, words[1:], strict=False))
        rest[i] = (
            np.log1p(len(text)), np.log1p(len(words)), sum(lengths) / n, max(lengths),
            len(counts) / n, max(counts.values(), default=0) / n, sum(map(eq, words, words[1:])) / n, len(pairs) / n,
            sum(map(str.isupper, words)) / n, sum(map(str.isalpha, words)) / n, sum(map(str.isdigit, words)) / n,
            np.log1p(len(lines)), len(set(lines)) / len(lines), len(words) / len(lines),
        )
    total = np.maximum(bytes_.sum(axis=1, keepdims=True), 1)
    share = bytes_ / total
    classes = [share[:, a:b].sum(axis=1) for a, b in ((65, 91), (97, 123), (48, 58), (128, 256), (9, 33))]
    marks = share[:, [ord(c) for c in _MARKS]]
    entropy = -(share * np.log2(np.maximum(share, 1e-12))).sum(axis=1)
    return np.column_stack([rest, *classes, entropy, marks.sum(axis=1), marks])


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees in a row. children: of a node's left and right child; a leaf is its own."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    children: np.ndarray
    value: np.ndarray
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        total, at = np.full(len(rows), self.base), np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(DEPTH):
                right = rows[at, self.feature[node]] > self.threshold[node]
                node = self.children[node, right.astype(int)]
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Boosted trees on the logistic loss. Without both labels the score is their smoothed mean."""
    rate = (labels.sum() + 1) / (len(labels) + 2)
    base = float(np.log(rate / (1 - rate)))
    feature, threshold, children, value, roots = [], [], [], [], []
    if len(set(labels.tolist())) == 2:
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in rows.T]
        binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, rows.T, strict=True)])
        total = np.full(len(rows), base)

        def grow(own: np.ndarray, depth: int) -> int:
            node = len(feature)
            feature.append(0)
            threshold.append(np.inf)
            children.append([node, node])
            value.append(-RATE * gradient[own].sum() / (weight[own].sum() + RIDGE))
            found = _split(binned[own], gradient[own], weight[own], edges) if depth else None
            if found:
                j, bin_ = found
                left = binned[own, j] <= bin_
                feature[node], threshold[node] = j, edges[j][bin_]
                children[node] = [grow(own[left], depth - 1), grow(own[~left], depth - 1)]
            return node

        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-total))
            gradient, weight = p - labels, p * (1 - p)
            roots.append(grow(np.arange(len(rows)), DEPTH))
            found = Trees(np.array(roots[-1:]), np.array(feature), np.array(threshold), np.array(children), np.array(value), 0.0)
            p = found.score(rows)
            total += np.log(p / (1 - p))
    return Trees(
        np.array(roots, int), np.array(feature, int), np.array(threshold), np.array(children, int).reshape(-1, 2), np.array(value), base
    )


def _split(binned: np.ndarray, gradient: np.ndarray, weight: np.ndarray, edges: list[np.ndarray]) -> tuple[int, int] | None:
    """The (feature, last bin on the left) that gains most, from histograms of all features at once."""
    if len(binned) < 2 * LEAST_ROWS:
        return None
    columns = binned.shape[1]
    flat = (binned + np.arange(columns) * BINS).ravel()
    sums = [
        np.bincount(flat, np.repeat(w, columns) if w is not None else None, columns * BINS).reshape(columns, BINS).cumsum(axis=1)
        for w in (gradient, weight, None)
    ]
    g, h, n = (s[:, :-1] for s in sums)
    all_g, all_h, all_n = gradient.sum(), weight.sum(), len(binned)
    gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
    within = np.arange(BINS - 1) < np.array([[len(e)] for e in edges])
    gain[(n < LEAST_ROWS) | (all_n - n < LEAST_ROWS) | ~within] = 0
    best = int(gain.argmax())
    return divmod(best, BINS - 1) if gain.ravel()[best] > 1e-6 else None


def train(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Trees:
    """Statistics are computed where the texts are; the driver gets at most MAX_TRAIN rows of numbers."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(list(statistics(batch.column(1).to_pylist())), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found, batch.column(2)], names=["doc_id", "row", "label"])

    found = training(docs, labels, target).select("doc_id", "text", "label")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = found.mapInArrow(run, f"doc_id {kind}, row array<double>, label int").collect()
    rows.sort(key=lambda r: (r.doc_id, r.row))
    if not rows:
        return fit(np.zeros((0, statistics([]).shape[1])), np.zeros(0))
    return fit(np.array([r.row for r in rows]), np.array([r.label for r in rows], float))


def score(docs: DataFrame, trees: Trees, name: str = "score") -> DataFrame:
    """docs with the score in column name; one of that name is replaced. A null text scores as an empty one.

    Other columns are kept as they are, repeated rows score alike, and an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    docs = docs.drop(name)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = pa.array(trees.score(statistics(texts)))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, f"{fields}, `{name}` double")


def op2_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), trees)
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)
