"""Language ID by unigram pieces, summed over all segmentations.

Pieces are those of a fixed public vocabulary that consist of lower-case
letters (a word starts with the mark U+2581); a letter outside it is one
unknown piece. Each language has a probability per piece, fitted by
expectation maximisation over all segmentations of its words. A text's
likelihood in a language is the sum over all segmentations of all its
words, by the forward algorithm; as no piece crosses a word's end, it is
the product over words, and a word's forward sum is computed once per task
and remembered. Any word may, with probability ``BORROWED``, come from all
languages alike, so a passage quoted from another language does not
outweigh the rest of a text. ``score`` is the posterior of the best language under
equal priors.

Fitting uses about ``fit_docs`` documents per language at most (chosen by hash);
scoring reads every whole text once, without a shuffle.

Cases: ``und`` with score 0 for a null text, one without letters, or when
nothing was learned; null languages and ids are never learned from; a null
id is carried as null; ties go to the language first in sort order; an
empty table gives no rows.
"""

from __future__ import annotations

import collections
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.llm import common

MARK = "▁"
#: documents per language that the probabilities are fitted on.
FIT_DOCS = 1500
ROUNDS = 4
#: share of a text's words that may be of any language.
BORROWED = 0.5
#: pseudo-count of each piece.
PRIOR = 0.05
#: words whose forward sums a task remembers.
MEMO_WORDS = 400_000
_RUN = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """A word is a run of letters; signs that only count as numbers (½, ², ①) are none."""
    runs = _RUN.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [part for run in runs for part in "".join(c if c.isalpha() else " " for c in run).split()]


def letter_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece vocabulary that are lower-case letters, maybe after the mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    fits = (p for p in pieces if (p.removeprefix(MARK).isalpha() or p == MARK) and p == p.lower())
    return sorted(set(fits))


class Lattice:
    """Piece numbers of all spans of words; words of a length are worked on together.

    Spans are looked up by a 64-bit polynomial hash of their characters, which
    grows with the span, so a column of spans is a few numpy operations.
    """

    def __init__(self, pieces: list[str]):
        self.unknown, self.none = len(pieces), len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        hashes = np.array([span_hashes(code_points([p], len(p)))[-1][0] for p in pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if len(np.unique(hashes)) < len(pieces):
            raise ValueError("two pieces share a hash")

    def spans(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """(start, end) -> the piece number of that span in each word; all words have one length."""
        n = len(words[0])
        codes, out = code_points(words, n), {}
        for start in range(n):
            for size, found in enumerate(span_hashes(codes[:, start : start + self.longest]), 1):
                at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
                known = self.hashes[at] == found
                if size == 1 or known.any():
                    out[start, start + size] = np.where(known, self.order[at], self.unknown if size == 1 else self.none)
        return out

    def log_sums(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """log of the sum over all segmentations; (words, languages). ``table`` is (pieces + 2, languages), last row 0."""
        out = np.zeros((len(words), table.shape[1]))
        for n, at in by_length(words).items():
            for low in range(0, len(at), 4096):
                rows = at[low : low + 4096]
                out[rows] = self._forward([words[i] for i in rows], n, table)[0]
        return out

    def _forward(self, words: list[str], n: int, table: np.ndarray) -> tuple[np.ndarray, list, dict]:
        spans = self.spans(words)
        sums = [np.ones((len(words), table.shape[1]))]
        scale = np.zeros((len(words), table.shape[1]))
        for end in range(1, n + 1):
            total = np.zeros_like(scale)
            for start in range(max(0, end - self.longest), end):
                if (start, end) in spans:
                    total += sums[start] * table[spans[start, end]]
            sums.append(total)
            if end % 16 == 0:  # a common factor keeps long words within floats
                factor = total.copy()
                for k in range(max(0, end - self.longest + 1), end + 1):
                    sums[k] = sums[k] / factor
                scale += np.log(factor)
        return scale + np.log(sums[n]), sums, spans

    def expected(self, words: list[str], counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations."""
        table, uses = probs[:, None], np.zeros(len(probs))
        for n, at in by_length(words).items():
            if n > 15:  # beyond the first factor of ``_forward``: in logarithms
                for low in range(0, len(at), 4096):
                    rows = at[low : low + 4096]
                    self._expected_long([words[i] for i in rows], n, counts[rows], probs, uses)
                continue
            for low in range(0, len(at), 4096):
                rows = at[low : low + 4096]
                _, sums, spans = self._forward([words[i] for i in rows], n, table)
                back = {n: np.ones(len(rows))}
                for start in range(n - 1, -1, -1):
                    back[start] = sum(back[e] * probs[p] for (s, e), p in spans.items() if s == start)
                weight = counts[rows] / sums[n][:, 0]
                for (s, e), p in spans.items():
                    uses += np.bincount(p, weights=weight * sums[s][:, 0] * probs[p] * back[e], minlength=len(probs))
        uses[self.none] = 0
        return uses


    def _expected_long(self, words: list[str], n: int, counts: np.ndarray, probs: np.ndarray, uses: np.ndarray) -> None:
        """Adds the expected uses of words of ``n`` characters; no product of theirs leaves the range of floats."""
        spans = self.spans(words)
        with np.errstate(divide="ignore"):
            logs = np.log(probs)
        until = [np.zeros(len(words))]
        for end in range(1, n + 1):
            ways = [until[start] + logs[spans[start, end]] for start in range(max(0, end - self.longest), end) if (start, end) in spans]
            until.append(np.logaddexp.reduce(ways, axis=0))
        behind = {n: np.zeros(len(words))}
        for start in range(n - 1, -1, -1):
            ways = [logs[spans[start, end]] + behind[end] for end in range(start + 1, min(n, start + self.longest) + 1) if (start, end) in spans]
            behind[start] = np.logaddexp.reduce(ways, axis=0)
        for (start, end), p in spans.items():
            share = np.exp(until[start] + logs[p] + behind[end] - until[n])
            uses += np.bincount(p, weights=counts * share, minlength=len(probs))


def by_length(words: list[str]) -> dict[int, np.ndarray]:
    lengths = np.array([len(w) for w in words])
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}


def code_points(words: list[str], n: int) -> np.ndarray:
    """(words, n) character codes of words of ``n`` characters."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n).astype(np.uint64)


def span_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first 1, 2, ... columns."""
    out, h = [], np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for column in range(codes.shape[1]):
            h = (h + codes[:, column] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            out.append(h)
    return out


class Model(NamedTuple):
    languages: list[str]
    pieces: list[str]
    probs: np.ndarray  # (pieces + 2, languages); the last two rows: an unknown letter, no piece


def start_probs(lattice: Lattice, languages: int) -> np.ndarray:
    probs = np.full((lattice.none + 1, languages), 1.0 / (lattice.none))
    probs[lattice.none] = 0
    return probs


def word_counts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, word, n): marked letter runs of the lower-cased texts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, collections.Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, collections.Counter()).update((text or "").lower().split())
            rows = collections.Counter()
            for lang, chunks in found.items():
                for chunk, n in chunks.items():
                    for run in letter_runs(chunk):
                        rows[lang, MARK + run] += n
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([k[0] for k in rows], pa.string()), "word": pa.array([k[1] for k in rows], pa.string()),
                 "n": pa.array(list(rows.values()), pa.int64())}
            )

    counted = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, may_learn: Column, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        *, fit_docs: int = FIT_DOCS, rounds: int = ROUNDS) -> Model:
    """Piece probabilities per language, from about ``fit_docs`` documents each at most where ``may_learn``."""
    spark = docs.sparkSession
    usable = docs.filter(may_learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    usable = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = common.staged(usable.groupBy("lang").agg(F.count("*").alias("n")))
    chosen = usable.select("id", "lang").join(sizes, "lang").filter(common.part_of("id", F.lit(float(fit_docs)) / F.col("n")))
    chosen = common.staged(chosen.select(F.col("id").alias("chosen_id")).distinct())  # about fit_docs ids per language at most
    sample = usable.join(F.broadcast(chosen), F.col("id") == F.col("chosen_id"), "left_semi")
    lang_col, text_col = "lang", "text"
    words = common.staged(word_counts(sample, lang_col, text_col))
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())
    pieces = letter_pieces(vocabulary)
    lattice = Lattice(pieces)
    probs = start_probs(lattice, max(1, len(languages)))
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast((languages, pieces, probs))

        def expect(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, known, now = shared.value
            paths, uses = Lattice(known), np.zeros_like(now)
            for batch in batches:
                langs = np.array([names.index(x) for x in batch.column(0).to_pylist()], np.int64)
                texts, counts = batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
                for lang in np.unique(langs):
                    at = np.flatnonzero(langs == lang)
                    uses[:, lang] += paths.expected([texts[i] for i in at], counts[at], now[:, lang])
            piece, lang = np.nonzero(uses)
            yield pa.RecordBatch.from_pydict(
                {"piece": pa.array(piece, pa.int32()), "lang": pa.array(lang, pa.int32()), "n": pa.array(uses[piece, lang], pa.float64())}
            )

        found = words.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        uses = np.full_like(probs, PRIOR)  # pieces x languages: its size is the vocabulary's
        uses[found.column("piece").to_numpy(), found.column("lang").to_numpy()] += found.column("n").to_numpy()
        uses[lattice.none] = 0
        probs = uses / uses.sum(axis=0)
    return Model(languages, pieces, probs)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, m = common.arrow_schema(schema), shared.value
        scorer = Scorer(m)
        for batch in batches:
            # slices keep the chunks of few texts in memory at once
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                names, scores = scorer.score(part.column(1).to_pylist())
                yield common.record_batch({"doc_id": part.column(0), "lang_pred": names, "score": scores}, kinds)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


class Scorer:
    """Scores texts, remembering the sums of white-space chunks."""

    def __init__(self, model: Model, memo_words: int = MEMO_WORDS):
        self.model, self.lattice, self.limit = model, Lattice(model.pieces), memo_words
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.model.languages) + 1))

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.model.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        chunks = [(t or "").lower().split() for t in texts]
        if len(self.row) > self.limit:
            self._forget()
        self._learn([c for c in set().union(*chunks) if c not in self.row])
        row = self.row.__getitem__
        totals = np.array([self.sums[list(map(row, c))].sum(axis=0) if c else np.zeros(self.sums.shape[1]) for c in chunks])
        logs, letters = totals[:, :-1], totals[:, -1]
        shares = np.exp(logs - logs.max(axis=1, keepdims=True))
        best = shares.argmax(axis=1)
        scores = np.where(letters > 0, 1.0 / shares.sum(axis=1), 0.0)
        names = [self.model.languages[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, scores

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        runs, owner = [], []
        for i, chunk in enumerate(new):
            for run in letter_runs(chunk):
                runs.append(MARK + run)
                owner.append(i)
        rows = np.zeros((len(new), self.sums.shape[1]))
        if runs:
            logs = self.lattice.log_sums(runs, self.model.probs)
            common_ = np.logaddexp.reduce(logs, axis=1, keepdims=True) - np.log(logs.shape[1])
            logs = np.logaddexp(np.log(1 - BORROWED) + logs, np.log(BORROWED) + common_)
            np.add.at(rows[:, :-1], np.array(owner), logs)
            np.add.at(rows[:, -1], np.array(owner), np.array([len(r) - 1.0 for r in runs]))
        start = len(self.row)
        while start + len(new) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[start : start + len(new)] = rows
        self.row.update((c, start + i) for i, c in enumerate(new))
