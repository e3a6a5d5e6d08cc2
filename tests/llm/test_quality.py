import zlib

import numpy as np
import pytest
from llm_support import SF

from cartwheel.llm import common, quality as Q, queries


def plain_score(trees, row):
    z = trees.base
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
        node, inner = 0, len(feature)
        while node < inner:
            node = 2 * node + 1 + (row[feature[node]] > threshold[node])
        z += leaf[node - inner]
    return 1 / (1 + np.exp(-z))


def test_flat_trees_equal_walking_them_row_by_row():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] * x[:, 1] > 0)).astype(float)
    trees = Q.grow(x, y, trees=20, depth=3)
    scores = Q.score_rows(trees, x)
    assert np.allclose(scores, [plain_score(trees, r) for r in x])
    assert ((scores > 0.5) == y).mean() > 0.9


def test_one_class_and_no_rows():
    x = np.arange(10.0)[:, None]
    assert (Q.score_rows(Q.grow(x, np.ones(10)), x) > 0.9).all()
    assert (Q.score_rows(Q.grow(x, np.zeros(10)), x) < 0.1).all()
    assert (Q.score_rows(Q.grow(np.zeros((0, 1)), np.zeros(0)), x) == 0.5).all()


def test_statistics_are_finite_for_awkward_texts():
    texts = [None, b"", b" \n\t ", b"x", b"!!!", b"\n\n", "é".encode() * 9, b"a b " * 50_000, b"\x1c \x1c"]
    x = Q.vectors(texts)
    assert x.shape == (len(texts), Q.FEATURES) and np.isfinite(x).all()


@pytest.fixture(scope="module")
def scored(spark):
    return queries.queries()["op4_quality"](spark, SF).collect()


def test_held_out_accuracy(spark, scored):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in scored)
    held = [r for r in scored if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_awkward(spark, awkward, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (5, 0, 0), (None, 1, 1), (3, None, 1), (8, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    trees = Q.fit(awkward, labels, lambda i: common.crc_bucket(i, 5) >= 0)
    got = Q.score(awkward, trees).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 2}) == 1
    kept = Q.keep_good(awkward, trees)
    assert kept.columns == awkward.columns
    assert kept.count() == sum(r.score >= 0.3 for r in got)
    none = Q.fit(no_docs, labels, lambda i: common.crc_bucket(i, 5) >= 0)
    assert Q.score(no_docs, none).count() == 0 and {r.score for r in Q.score(awkward, none).collect()} == {0.5}
