import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_support import SF

from cartwheel.llm import common, queries, toxicity as X


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, cb in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (ca != cb))
    return row[-1]


def plain_match(terms, word):
    found = []
    for t in terms:
        body = t.removesuffix("*")
        ends = range(len(word) + 1) if t.endswith("*") else [len(word)]
        edits = min(levenshtein(word[:e], body) for e in ends)
        if edits <= X.allowed_edits(body):
            found.append((t, edits))
    return min(found, key=lambda m: (m[1], -len(m[0]), m[0])) if found else None


TERMS = ["abba", "abcab", "bacab*", "cabbage", "abcabcabc", "aab", "abca*", "bbbbbbbbb*"]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abcg", min_size=1, max_size=11))
def test_automaton_is_the_edit_distance(word):
    assert X.Automaton(TERMS).match(word) == plain_match(TERMS, word)


def test_forgetting_states_changes_nothing():
    words = ["abcab", "acab", "cabage", "abcabcacb", "zzz", "bacabzz"]
    small, big = X.Automaton(TERMS, remembered=3), X.Automaton(TERMS)
    assert [small.match(w) for w in words * 3] == [big.match(w) for w in words * 3]


def test_quotation():
    def quoted(text):
        chunks = text.split()
        return X.is_quoted(chunks, next(i for i, c in enumerate(chunks) if "fool" in c))

    assert quoted('he wrote "you fool" to them') and quoted("sagte: „du fool hier“ und") and quoted('a "fool," he said')
    assert not quoted("you fool go away") and not quoted('he said "hello" you fool and left') and not quoted('"never closed you fool go')


def test_lookalikes():
    assert "idiot" in X.words_of("1d1ot") and "trash" in X.words_of("tr@sh!") and X.words_of("2024") == []


def test_choose_terms_prefers_the_most_telling():
    bad = {"lowe*": 50, "lowei*": 50, "loweix": 6, "idio*": 40, "idiot": 39, "lose*": 60, "loser": 40, "loses": 20}
    assert X.choose_terms(bad) == ["idiot", "lose*", "lowei*"]


def test_quoted_hits_weigh_less():
    odds = {("fooled", 0): 5.0}
    reader = X.Reader(["fooled"], odds)
    plain, quoted = reader.vector("you fooled us"), reader.vector('it said "you fooled us" then')
    assert plain[0] > 0 and plain[1] == 0 and quoted[0] == 0 and quoted[1] > 0


@pytest.fixture(scope="module")
def scored(spark):
    return queries.queries()["op10_toxicity"](spark, SF).collect()


def test_held_out(spark, scored):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in scored)
    known = [r for r in scored if r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in known]) > 0.95
    assert sum(r.predicted for r in known if truth[r.doc_id] == 0) <= 3


def test_awkward(spark, awkward, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (5, 0, 0), (None, 1, 1), (3, None, 1), (8, 0, 1), (99, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    model = X.fit(awkward, labels, lambda i: common.crc_bucket(i, 5) >= 0)
    got = X.score(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    none = X.fit(no_docs, labels, lambda i: common.crc_bucket(i, 5) >= 0)
    assert X.score(no_docs, none).count() == 0 and {r.score for r in X.score(awkward, none).collect()} == {0.0}
