"""Quality classifier: histogram gradient-boosted trees over document statistics.

A document becomes a fixed vector of statistics of its whole text. Trees of
one depth are grown on histograms of at most ``BINS`` quantile bins per
statistic (logistic loss, second-order gains) and kept as flat arrays:
feature and threshold of each inner node in heap order, value of each leaf. Scoring
walks all rows of a batch down a tree at once with numpy.

Fitting uses about ``per_class`` labelled documents of each class at most;
scoring reads every whole text once, without a shuffle.

Cases: a null text counts as empty and gets a score like any other; without
labels every score is 0.5; without one class the score is near the other's
label; null ids are carried as null and never learned from; repeated rows
are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.llm import common, labelled

#: labelled documents of each class that the trees are fitted on.
PER_CLASS = 6000
BINS, DEPTH, TREES, RATE, L2 = 64, 4, 80, 0.2, 1.0

LOWER, UPPER, DIGIT = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"))
PLAIN = np.isin(np.arange(256), np.frombuffer(b".,;:'\"-()", np.uint8))
HIGH = np.arange(256) >= 128
SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
ODD = ~(LOWER | UPPER | DIGIT | PLAIN | HIGH | SPACE)
KINDS = np.array([LOWER, UPPER, DIGIT, PLAIN, HIGH, SPACE, ODD], float).T

FEATURES = 24


def statistics(text: bytes | None) -> list[float]:
    """The statistics of one whole text."""
    text = text or b""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0, np.log1p(size), *[0.0] * (FEATURES - 2)]
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lower, upper, digit, plain, high, space, odd = histogram @ KINDS
    letters = lower + upper + high
    seen = Counter(words)
    top = max(seen.values())
    repeats = sum(map(operator.eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    p = histogram[histogram > 0] / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        np.log1p(n), np.log1p(size), size / n, upper / (letters + 1), digit / size, plain / size, odd / size, high / (letters + 1),
        space / size, len(seen) / n, top / n, pairs / n, repeats / n, -float(p @ np.log(p)), np.log1p(len(lines)),
        len(set(lines)) / len(lines), n / len(lines), *worst_lines(lines), n / np.sqrt(1.0 + len(seen)) / 100, max(map(len, words)) / size,
    ]


def worst_lines(lines: list[bytes]) -> list[float]:
    """Extremes over the lines of five words and more: upper case, odd characters, digits, repeats, and their share of the words."""
    upper = odd = digits = repeats = 0.0
    bad = total = 0
    for line in lines:
        words = line.split()
        n = len(words)
        total += n
        if n < 5:
            continue
        letters = line.translate(None, b" \t\r\x0b\x0c")
        size = len(letters)
        u = 1 - len(letters.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / size
        d = 1 - len(letters.translate(None, b"0123456789")) / size
        o = 1 - len(letters.translate(None, b"!#$%&*+/<=>?@[\\]^_`{|}~")) / size
        r = sum(map(operator.eq, words, words[1:])) / n
        upper, odd, digits, repeats = max(upper, u), max(odd, o), max(digits, d), max(repeats, r)
        bad += n * (u > 0.5 or o > 0.08 or r > 0.3 or d > 0.3)
    return [upper, odd, digits, repeats, bad / max(1, total)]


class Trees(NamedTuple):
    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, leaves)


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosted trees for labels y in {0, 1}."""
    n, width = x.shape
    if n == 0:
        return Trees(0.0, np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
    slots = binned + np.arange(width) * BINS
    rate0 = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(rate0 / (1 - rate0)))
    margin = np.full(n, base)
    out = Trees(base, np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            count = 2**level
            where = ((node - (count - 1))[:, None] * (width * BINS) + slots).ravel()
            shape = (count, width, BINS)
            g = np.bincount(where, np.repeat(gradient, width), count * width * BINS).reshape(shape)
            h = np.bincount(where, np.repeat(hessian, width), count * width * BINS).reshape(shape)
            gl, hl = g.cumsum(axis=2)[:, :, :-1], h.cumsum(axis=2)[:, :, :-1]
            gt, ht = g.sum(axis=2)[:, :1, None], h.sum(axis=2)[:, :1, None]
            gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
            gain[(hl < 0.5) | (ht - hl < 0.5)] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), BINS - 1)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    out.feature[t, count - 1 + k], out.threshold[t, count - 1 + k] = f, cuts[f][b]
            node = step(x, node, out.feature[t], out.threshold[t])
        leaf = node - (2**depth - 1)
        g, h = np.bincount(leaf, gradient, 2**depth), np.bincount(leaf, hessian, 2**depth)
        out.leaf[t] = -rate * g / (h + L2)
        margin += out.leaf[t][leaf]
    return out


def step(x: np.ndarray, node: np.ndarray, feature: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    return 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])


def score_rows(trees: Trees, x: np.ndarray) -> np.ndarray:
    margin, depth = np.full(len(x), trees.base), (trees.leaf.shape[1]).bit_length() - 1
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(depth):
            node = step(x, node, feature, threshold)
        margin += leaf[node - (2**depth - 1)]
    return 1 / (1 + np.exp(-margin))


def vectors(texts: list[bytes | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), FEATURES)


def fit(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", *, label_col: str = "quality", per_class: int = PER_CLASS) -> Trees:
    """Trees from at most ``per_class`` labelled documents of each class; ``learn`` maps the id column to a condition."""
    chosen = labelled.sample(docs, labels, label_col, id_col, text_col, per_class=per_class, learn=learn)
    names = [f"f{i}" for i in range(FEATURES)]

    def features(batch: pa.RecordBatch) -> dict:
        x = vectors(common.text_bytes(batch.column(1)))
        return {"id": batch.column(0).cast(pa.string()), "y": batch.column(2)} | {c: x[:, i] for i, c in enumerate(names)}

    rows = common.map_batches(chosen, "id string, y int, " + ", ".join(f"{c} double" for c in names), features)
    found = rows.orderBy("id", *names).toArrow()  # 2 * per_class rows at most; in order, so that sums repeat
    x = np.stack([found.column(c).to_numpy() for c in names], axis=1)
    return grow(x, found.column("y").to_numpy().astype(float))


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "score": score_rows(trees, vectors(common.text_bytes(batch.column(1))))}

    return common.map_batches(docs.select(id_col, text_col), schema, run)


def keep_good(docs: DataFrame, trees: Trees, text_col: str = "text", *, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their own columns; nothing is shuffled."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = score_rows(trees, vectors(common.text_bytes(batch.column(at)))) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, schema)
