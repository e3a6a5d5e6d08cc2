import itertools
import math
import zlib

import numpy as np
import pytest
from llm_support import SF
from pyspark.sql import functions as F

from cartwheel.llm import common, language_id as L, queries, tokens

PIECES = tokens.vocabulary("piece_bpe_32k.model")


def segmentations(word):
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        out, start = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                out.append(word[start:i])
                start = i
        yield [*out, word[start:]]


def test_forward_sums_over_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba"]
    lattice = L.Lattice(pieces)
    rng = np.random.default_rng(1)
    table = rng.random((lattice.none + 1, 3)) / 5
    table[lattice.none] = 0
    number = {p: i for i, p in enumerate(pieces)}
    for word in ("▁ab", "▁aba", "▁babx", "▁", "▁abababab"):
        expected = np.zeros(3)
        for parts in segmentations(word):
            ids = [number.get(p, lattice.unknown if len(p) == 1 else lattice.none) for p in parts]
            expected += np.prod(table[ids], axis=0)
        assert np.allclose(np.exp(lattice.log_sums([word], table)[0]), expected)


def test_expected_uses():
    pieces = ["▁", "a", "b", "▁a", "ab"]
    lattice = L.Lattice(pieces)
    probs = np.array([0.2, 0.2, 0.2, 0.15, 0.2, 0.05, 0.0])
    number = {p: i for i, p in enumerate(pieces)}
    expected, total = np.zeros(len(probs)), 0.0
    weighed = []
    for parts in segmentations("▁aab"):
        ids = [number.get(p, lattice.unknown if len(p) == 1 else lattice.none) for p in parts]
        weighed.append((float(np.prod(probs[ids])), ids))
    total = sum(w for w, _ in weighed)
    for w, ids in weighed:
        for i in ids:
            expected[i] += 3 * w / total
    expected[lattice.none] = 0
    assert np.allclose(lattice.expected(["▁aab"], np.array([3.0]), probs), expected)


def test_long_words_teach_what_all_their_segmentations_say():
    """Words of 16 to 40 letters count in learning; equal to the product form within floats."""
    pieces = ["▁", "a", "b", "▁a", "ab", "abb", "ba"]
    lattice = L.Lattice(pieces)
    rng = np.random.default_rng(8)
    probs = rng.random(lattice.none + 1)
    probs[lattice.none] = 0
    number = {p: i for i, p in enumerate(pieces)}
    for n in (16, 23, 40):
        word = L.MARK + "".join(rng.choice(list("abx"), n))
        ids = {(s, e): number.get(word[s:e], lattice.unknown if e - s == 1 else None) for s in range(n + 1) for e in range(s + 1, min(n + 1, s + 3) + 1)}
        ids = {k: v for k, v in ids.items() if v is not None}
        until, behind = [1.0] + [0.0] * (n + 1), [0.0] * (n + 1) + [1.0]
        for e in range(1, n + 2):
            until[e] = sum(until[s] * probs[p] for (s, x), p in ids.items() if x == e)
        for s in range(n, -1, -1):
            behind[s] = sum(probs[p] * behind[e] for (x, e), p in ids.items() if x == s)
        want = np.zeros(len(probs))
        for (s, e), p in ids.items():
            want[p] += 2 * until[s] * probs[p] * behind[e] / until[-1]
        assert np.allclose(lattice.expected([word], np.array([2.0]), probs), want), word


def test_numbers_are_no_letters():
    assert L.letter_runs("½ ² ① a½b x²y Ⅷ") == ["a", "b", "x", "y"]
    pieces = L.letter_pieces(PIECES)
    probs = np.ones((len(pieces) + 2, 2)) / len(pieces)
    probs[-1] = 0
    names, scores = L.Scorer(L.Model(["x", "y"], pieces, probs)).score(["½ ²", "①", "3½", "a"])
    assert names[:3] == ["und"] * 3 and scores[:3].tolist() == [0, 0, 0] and names[3] != "und"


def test_long_words_do_not_underflow():
    pieces = L.letter_pieces(PIECES)
    lattice = L.Lattice(pieces)
    assert lattice.longest > 12 and max(pieces, key=len) in pieces  # no piece of letters is left out
    table = L.start_probs(lattice, 2)
    word = L.MARK + "abc" * 4000
    got = lattice.log_sums([word, word], table)
    assert np.isfinite(got).all() and got[0, 0] < -1000
    short = L.MARK + "abc" * 11  # past two common factors, still within floats without them
    alpha = [1.0]
    number = {p: i for i, p in enumerate(pieces)}
    for end in range(1, len(short) + 1):
        alpha.append(sum(alpha[s] * table[number.get(short[s:end], lattice.unknown if end - s == 1 else lattice.none), 0] for s in range(max(0, end - lattice.longest), end)))
    assert math.isclose(lattice.log_sums([short], table)[0, 0], math.log(alpha[-1]), rel_tol=1e-9)


def test_memo_gives_the_same_scores(corpus):
    rng = np.random.default_rng(2)
    pieces = L.letter_pieces(PIECES)
    probs = rng.random((len(pieces) + 2, 3))
    probs[-1] = 0
    model = L.Model(["x", "y", "z"], pieces, probs / probs.sum(axis=0))
    texts = [t for _, t in corpus[:40]] + ["", None, "12 34"]
    tiny, big = L.Scorer(model, memo_words=5), L.Scorer(model)
    parts = [tiny.score(texts[i : i + 3]) for i in range(0, len(texts), 3)]
    names, scores = big.score(texts)
    assert sum((p[0] for p in parts), []) == names
    assert np.allclose(np.concatenate([p[1] for p in parts]), scores)
    assert names[-3:] == ["und"] * 3 and scores[-3:].tolist() == [0, 0, 0]


@pytest.fixture(scope="module")
def predicted(spark):
    return queries.queries()["op2_language_id"](spark, SF).collect()


def test_held_out_accuracy(spark, predicted):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(predicted) == len(truth)
    held = [r for r in predicted if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in predicted)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held if truth[r.doc_id]]) > 0.98
    assert all(0 <= r.score <= 1 for r in predicted)


def test_awkward(spark, awkward, no_docs):
    model = L.fit(awkward, common.crc_bucket("doc_id", 4) != 2, PIECES)
    got = L.predict(awkward, model).collect()
    assert len(got) == awkward.count()
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {5, 6, 7} <= und and 1 not in und
    none = L.fit(no_docs, F.lit(True), PIECES)
    assert L.predict(no_docs, none).count() == 0
    assert {r.lang_pred for r in L.predict(awkward, none).collect()} == {"und"}
