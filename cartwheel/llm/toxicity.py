"""Toxicity: a learned lexicon, found through misspellings, weighed by context.

The lexicon is learned from labelled documents: words, and stems that
begin several words, which occur in toxic documents far more often than in
others. It becomes a trie. Levenshtein automata for all its terms are
walked along the trie at once: a state is the set of (trie node, edits
used), made deterministic on demand and remembered, so a word costs one
look-up per letter and most words die after a few letters.

Every hit has the learned log odds of its (term, edits), so a misspelling
that is an ordinary word elsewhere counts for little. A hit between
quotation marks within ``WINDOW`` words counts as quoted. A logistic regression over the sums of abusive
and quoted hits gives the score; the weight of quoted hits may not exceed
that of the others.

Fitting uses about ``per_class`` labelled documents of each class at most;
scoring reads every whole text once, without a shuffle.

Cases: a null or empty text has no hits and the score of such texts;
without labelled documents every score is 0; null ids are carried as null
and never learned from; repeated rows are scored alike; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.llm import common, labelled

PER_CLASS = 6000
#: terms in the lexicon at most, the best by support and odds; documents a term must be in, and its log odds.
MAX_TERMS, MIN_DOCS, MIN_ODDS = 4000, 3, 2.5
#: different surroundings (word before, word after) in toxic texts that a term needs, and as a share of those texts.
MIN_CONTEXTS, CONTEXT_SHARE = 4, 0.005
STEMS = range(4, 8)
#: words to each side in which quotation marks are looked for.
WINDOW = 12
MEMO_WORDS = 400_000

# fixed values: look-alikes written for letters, and marks that open or close a quotation
LOOKALIKES = str.maketrans("0134578@$", "oieastbas")
OPENING, CLOSING = "\"“«„‹", "\"”»“›"

LETTERS = re.compile(r"[^\W\d_]+")
DISGUISED = re.compile(r"[^\W_]+(?:[@$][^\W_]+)*")


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """All terms' Levenshtein automata, run along their trie. A stem ends in ``*`` and matches a word's beginning."""

    def __init__(self, terms: list[str], remembered: int = 200_000):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[tuple[str | None, str | None]] = [(None, None)]  # whole word, stem
        for t in terms:
            node = 0
            for c in t.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append((None, None))
                node = self.children[node][c]
            word, stem = self.term[node]
            self.term[node] = (word, t) if t.endswith("*") else (t, stem)
        self.slack = self._slack()
        self.remembered = remembered
        self._forget()

    def _slack(self) -> list[int]:
        """Per node the most edits that any term at or below it allows."""
        slack = [max((allowed_edits(t.removesuffix("*")) for t in pair if t), default=-1) for pair in self.term]
        for node in range(len(slack) - 1, -1, -1):  # children come after their parent
            for child in self.children[node].values():
                slack[node] = max(slack[node], slack[child])
        return slack

    def _forget(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.stems: list[tuple[tuple[str, int], ...]] = []
        self.start = self._number({(0, 0)})

    def _number(self, positions: set[tuple[int, int]]) -> int:
        least: dict[int, int] = {}
        todo = sorted(positions, key=lambda p: p[1])
        while todo:  # letters of the term that the word lacks
            node, edits = todo.pop(0)
            if edits > self.slack[node] or least.get(node, 99) <= edits:
                continue
            least[node] = edits
            todo.extend((child, edits + 1) for child in self.children[node].values())
        key = tuple(sorted(least.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.stems.append(tuple((self.term[n][1], e) for n, e in key if self.term[n][1] and e <= allowed_edits(self.term[n][1][:-1])))
        return self.numbers[key]

    def _move(self, state: int, c: str) -> int:
        after = set()
        for node, edits in self.states[state]:
            if c in self.children[node]:
                after.add((self.children[node][c], edits))
            after.add((node, edits + 1))
            after.update((child, edits + 1) for child in self.children[node].values())
        number = self._number(after)
        self.moves[state][c] = number
        return number

    def match(self, word: str) -> tuple[str, int] | None:
        """The term with the fewest edits (then the longest, then the first) that ``word`` or its beginning spells."""
        if len(self.states) > self.remembered:
            self._forget()
        state, found = self.start, []
        for c in word:
            state = self.moves[state][c] if c in self.moves[state] else self._move(state, c)
            if not self.states[state]:
                break
            found.extend(self.stems[state])
        else:
            found.extend((self.term[n][0], e) for n, e in self.states[state] if self.term[n][0] and e <= allowed_edits(self.term[n][0]))
        return min(found, key=lambda m: (m[1], -len(m[0]), m[0])) if found else None


def words_of(chunk: str) -> list[str]:
    """The lower-case words of a chunk; look-alikes inside a word of letters are read as the letters."""
    runs = LETTERS.findall(chunk)
    if any(c in chunk for c in "0134578@$"):
        read = [d.translate(LOOKALIKES) for d in DISGUISED.findall(chunk) if sum(map(str.isalpha, d)) >= 2]
        runs += [w for r in read for w in LETTERS.findall(r) if w not in runs]
    return runs


class Model(NamedTuple):
    odds: dict[tuple[str, int], float]  # (term, edits) -> log odds
    terms: list[str]
    weights: np.ndarray  # bias and FEATURES weights
    prior: bool  # whether anything was learned


FEATURES = ("abusive hits", "quoted hits", "strongest abusive", "strongest quoted", "abusive share")


class Reader:
    """Finds and weighs the hits of texts, remembering chunks."""

    def __init__(self, terms: list[str], odds: dict[tuple[str, int], float] | None = None, memo_words: int = MEMO_WORDS):
        self.automaton, self.odds, self.limit = Automaton(terms), odds, memo_words
        self.known: dict[str, tuple[str, int] | None] = {}

    def chunk_hit(self, chunk: str) -> tuple[str, int] | None:
        found = [m for m in map(self.automaton.match, words_of(chunk)) if m]
        if self.odds is not None:
            found = [m for m in found if self.odds.get(m, 0.0) > 0]
            return max(found, key=lambda m: (self.odds[m], m)) if found else None
        return min(found, key=lambda m: (m[1], m[0])) if found else None

    def hits(self, text: str | None) -> tuple[list[str], list[tuple[int, str, int]]]:
        """(chunks, [(chunk number, term, edits)]) of a whole text."""
        chunks = (text or "").lower().split()
        if len(self.known) > self.limit:
            self.known.clear()
        new = set(chunks).difference(self.known)
        for c in new:
            self.known[c] = self.chunk_hit(c)
        known = self.known.__getitem__
        found = [(i, *m) for i, m in enumerate(map(known, chunks)) if m]
        return chunks, found

    def vector(self, text: str | None) -> list[float]:
        chunks, found = self.hits(text)
        sums, best = [0.0, 0.0], [0.0, 0.0]
        for i, term, edits in found:
            weight = self.odds[term, edits]
            side = is_quoted(chunks, i)
            sums[side] += weight
            best[side] = max(best[side], weight)
        share = sums[0] / math.sqrt(len(chunks) + 1.0)
        return [math.log1p(sums[0]), math.log1p(sums[1]), *best, share]


def is_quoted(chunks: list[str], at: int) -> bool:
    """Whether a quotation opens at or before chunk ``at`` and closes at or after it, within ``WINDOW`` words."""
    opened = None
    for i in range(at, max(-1, at - WINDOW), -1):
        if i < at and chunks[i].rstrip(".,;:!?")[-1:] in CLOSING and len(chunks[i].rstrip(".,;:!?")) > 1:
            return False  # the last quotation before has ended
        if chunks[i].lstrip("([")[:1] in OPENING and chunks[i].lstrip("(["):
            opened = i
            break
    if opened is None:
        return False
    return any(c.rstrip(".,;:!?)]")[-1:] in CLOSING and c.rstrip(".,;:!?)]") for c in chunks[at : at + WINDOW])


def term_counts(rows: DataFrame, per_doc) -> DataFrame:
    """(term, bad, good): documents of each class with each of ``per_doc``'s terms."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = per_doc()
        for batch in batches:
            counts = (Counter(), Counter())
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[y].update(find(text))
            terms = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_pydict(
                {"term": pa.array(terms, pa.string()), "bad": pa.array([counts[1][t] for t in terms], pa.int64()), "good": pa.array([counts[0][t] for t in terms], pa.int64())}
            )

    found = rows.select("text", "y").mapInArrow(count, "term string, bad long, good long")
    return found.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def words_and_stems():
    """A function from a text to its distinct words, and the stems of those words ending in ``*``."""

    def find(text: str | None) -> set[str]:
        words = {w for c in set((text or "").lower().split()) for w in words_of(c)}
        return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}

    return find


def log_odds(bad, good, n_bad, n_good):
    return np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))


def choose_terms(bad: dict[str, int]) -> list[str]:
    """The most telling of nested terms, given the toxic documents that have each.

    A stem goes if a longer stem or a word that it begins has nearly all its
    documents; what a remaining stem begins goes.
    """
    best_below: dict[str, int] = {}
    for term, n in bad.items():
        body = term.removesuffix("*")
        for k in STEMS:
            if k < len(body) or (k == len(body) and not term.endswith("*")):
                best_below[body[:k] + "*"] = max(n, best_below.get(body[:k] + "*", 0))
    stems = {t for t in bad if t.endswith("*") and best_below.get(t, 0) < 0.9 * bad[t]}
    words = {t for t in bad if not t.endswith("*")} | stems
    return sorted(t for t in words if not any(t.removesuffix("*")[:k] + "*" in stems - {t} for k in STEMS if k <= len(t.removesuffix("*"))))


def contexts(rows: DataFrame, terms: list[str]) -> dict[str, int]:
    """In how many different surroundings each term occurs in toxic texts.

    Abuse turns up in ever new places; a word that only belongs to one
    text keeps its neighbours in all near copies of that text.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(terms))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, found = shared.value, set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = ["", *LETTERS.findall(text.lower()), ""]
                for before, word, after in zip(words, words[1:], words[2:], strict=False):
                    for term in (word, *(word[:n] + "*" for n in STEMS if len(word) > n)):
                        if term in wanted:
                            found.add((term, f"{before} {after}"))
        yield pa.RecordBatch.from_pydict({"term": pa.array([f[0] for f in found], pa.string()), "around": pa.array([f[1] for f in found], pa.string())})

    pairs = rows.filter("y = 1 and text is not null").select("text").mapInArrow(find, "term string, around string").distinct()
    return {r.term: r.n for r in pairs.groupBy("term").agg(F.count("*").alias("n")).collect()}


def fit(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", *, label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Lexicon, odds and weights from at most ``per_class`` labelled documents of each class."""
    spark = docs.sparkSession
    rows = common.staged(labelled.sample(docs, labels, label_col, id_col, text_col, per_class=per_class, learn=learn)
                         .groupBy("text").agg(F.max("y").alias("y")))  # copies of a text count once
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    counted = term_counts(rows, words_and_stems).filter(F.col("bad") >= MIN_DOCS).withColumn("odds", odds).filter(F.col("odds") >= MIN_ODDS)
    best = counted.orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "term").limit(MAX_TERMS)
    support = {r.term: r.bad for r in best.collect()}
    around = contexts(rows, list(support))
    terms = choose_terms({t: n for t, n in support.items() if around.get(t, 0) >= max(MIN_CONTEXTS, CONTEXT_SHARE * n_bad)})
    if not terms:
        return Model({}, [], np.array([-20.0 if not n_bad else 0.0, *[0.0] * len(FEATURES)]), bool(n_bad))
    shared = spark.sparkContext.broadcast(terms)

    def matches():
        reader = Reader(shared.value)
        return lambda text: {f"{term}\t{edits}" for _, term, edits in reader.hits(text)[1]}

    matched = term_counts(rows, matches).collect()  # three edit counts per term at most
    found = {tuple(r.term.split("\t")): (r.bad, r.good) for r in matched}
    known = {(t, int(e)): float(log_odds(bad, good, n_bad, n_good)) for (t, e), (bad, good) in found.items()}
    for t in terms:  # an edit count that no document of the sample has, so no clean one either
        for e in range(allowed_edits(t.removesuffix("*")) + 1):
            known.setdefault((t, e), known.get((t, 0), 0.0) / 2**e)
    everything = spark.sparkContext.broadcast((terms, known))

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*everything.value)
        for batch in batches:
            x = np.array([reader.vector(t) for t in batch.column(0).to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_pydict({"y": batch.column(1)} | {f"f{i}": pa.array(x[:, i]) for i in range(len(FEATURES))})

    names = [f"f{i}" for i in range(len(FEATURES))]
    table = rows.select("text", "y").mapInArrow(vectors, "y int, " + ", ".join(f"{n} double" for n in names)).orderBy("y", *names).toArrow()
    x = np.stack([table.column(n).to_numpy() for n in names], axis=1)
    return Model(known, terms, regress(x, table.column("y").to_numpy().astype(float)), True)


def newton(x: np.ndarray, y: np.ndarray, *, l2: float = 0.05, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps, classes weighed alike; bias first."""
    full = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    importance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    penalty = np.diag([1e-3, *[l2] * x.shape[1]])
    w = np.zeros(full.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        gradient = full.T @ (importance * (p - y)) + penalty @ w
        hessian = (full * (importance * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ full + penalty
        move = np.linalg.solve(hessian, gradient)
        w -= move * min(1.0, 5.0 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-8:
            break
    return w


def regress(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, bias first: none negative, and quoted hits weigh at most half of what the others do."""
    used = list(range(x.shape[1]))
    while True:
        fitted = newton(x[:, used], y)
        if (fitted[1:] >= 0).all():
            break
        used = [f for f, w in zip(used, fitted[1:], strict=True) if w >= 0]
    w = np.zeros(x.shape[1] + 1)
    w[0], w[[f + 1 for f in used]] = fitted[0], fitted[1:]
    w[2], w[4] = min(w[2], w[1] / 2), min(w[4], w[3] / 2)
    return w


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, and hits: array of (word number, term, edits, quoted) of every row."""
    kind = "doc_id long, score double, hits array<struct<word: long, term: string, edits: int, quoted: boolean>>"
    schema = T.StructType.fromDDL(kind)
    schema.fields[0].dataType = docs.schema[id_col].dataType
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, m = common.arrow_schema(schema), shared.value
        reader = Reader(m.terms, m.odds)
        for batch in batches:
            scores, hits = [], []
            for text in batch.column(1).to_pylist():
                z = float(m.weights[0] + np.dot(m.weights[1:], reader.vector(text))) if m.prior else -np.inf
                scores.append(1 / (1 + math.exp(min(700.0, -z))) if z > -np.inf else 0.0)
                chunks, found = reader.hits(text)
                hits.append([{"word": i, "term": t, "edits": e, "quoted": is_quoted(chunks, i)} for i, t, e in found])
            yield common.record_batch({"doc_id": batch.column(0), "score": scores, "hits": hits}, kinds)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
