import math
import re
from collections import Counter

import numpy as np
import pytest
from compare import compare
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_support import DOCS, SF

from cartwheel.llm import queries
from cartwheel.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [] if text is None else TERM.findall(text.translate(LOWER))


def brute(docs, items, k):
    """The contract as it reads: [(item_id, rank, doc_id, score)]."""
    counted = [(d, Counter(words(t)), len(words(t))) for d, t in docs]
    n_docs, occurrences = sum(n > 0 for _, _, n in counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for d, c, n in counted:
            if n:
                m = 75 + (25 * n * n_docs) // occurrences
                score = sum(
                    math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if c[t]
                )
                if score > 0:
                    scored.append((-score, d is None, d or 0, d))
        out += [(item_id, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_terms(text):
    assert [t.decode() for t in R.terms(text.encode())] == words(text)


def test_query_equals_sql(spark, duck_check):
    assert compare(queries.op13_ranked_search(spark, SF), duck_check, queries.OP13_SQL) is None


def test_bounds_are_never_below_the_score():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}".encode() for i in range(60)]
    texts = [b" ".join(vocabulary[int(i)] for i in rng.zipf(1.4, int(rng.integers(1, 400))) % 60) for _ in range(150)]
    df = Counter(t for x in texts for t in set(R.terms(x)))
    total = sum(len(R.terms(x)) for x in texts)
    items = {str(i): b" ".join(rng.choice(vocabulary, 6)) for i in range(20)}
    query = R.make_query(items, dict(df), len(texts), total)
    exact = R.score_matrix(query, texts)
    block = R._Block(14)
    for x in texts:
        tf = Counter(R.terms(x))
        block.add(None, sum(tf.values()), np.array([R.term_hash(t) for t in tf], np.uint64), np.array([R.bisect_right(R.STEPS, n) for n in tf.values()]))
    row = block.close()
    above = R.bounds(query, 14, row["steps"][0], np.array(row["sizes"][0]), row["slices"][0])
    assert (above >= exact).all()
    assert np.median(above / np.maximum(exact, 1)) < 1.1  # and not far above


ITEMS = "item_id long, text string, doc_id string, rank string, score string, item string"


def items_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in texts], ITEMS)


@pytest.mark.parametrize("group_terms, counted", [(10**6, 10**6), (5, 0)])
def test_awkward_documents_and_items(spark, awkward, group_terms, counted, monkeypatch):
    texts = [(1, "quick Brown fox"), (2, None), (3, ""), (4, "!?"), (1, "the lazy dog the river"), (None, "schöner Ende élan"), (5, "absent"), (6, "alpha1 beta2 alpha1")]
    items = items_of(spark, texts)
    docs = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    for k in (2, 20):
        assert rows_of(R.search(awkward, items, k, group_terms=group_terms, counted_terms=counted)) == brute(docs, texts, k)


def test_ties_go_by_id_and_small_blocks_agree(spark, monkeypatch):
    rows = [(i, f"same words here {'and more' if i % 3 else ''}", None, None, None) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    texts = [(1, "same words"), (2, "more")]
    for limit in (10**6, 3):  # ids broadcast, and not
        monkeypatch.setattr(R, "BROADCAST_IDS", limit)
        assert rows_of(R.search(docs, items_of(spark, texts), 7)) == brute([r[:2] for r in rows], texts, 7)


def test_empty_tables(spark, awkward, no_docs):
    some = items_of(spark, [(1, "quick")])
    assert rows_of(R.search(no_docs, some, 5)) == [] == rows_of(R.search(awkward, some.limit(0), 5))
    assert R.search(no_docs, some, 5).columns == ["item_id", "rank", "doc_id", "score"]
