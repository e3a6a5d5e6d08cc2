import collections
import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_support import SF
from pyspark.sql import functions as F

from cartwheel.llm import exact_dedup as X


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_golomb_round_trip(values):
    sent = np.array(sorted(values), np.uint64)
    assert X.golomb_decode(X.golomb_encode(sent)).tolist() == sent.tolist()


def test_golomb_is_compact():
    sent = np.sort(np.random.default_rng(1).integers(0, 2**64, 20_000, dtype=np.uint64))
    assert len(X.golomb_encode(sent)) < 20_000 * 6.8  # log2(2**64 / n) + about 1.6 bits each


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \t\n\x0b\x0c\r\x1c ab", max_size=12))
def test_normalise_is_the_run_rule(text):
    assert X.normalise(text.encode()) == re.sub(rb"[\x20\x09-\x0D]+", b" ", text.encode())


def brute(rows):
    members = collections.defaultdict(list)
    for doc_id, text in rows:
        members[X.normalise((text or "").encode())].append(doc_id)
    out = []
    for norm, ids in members.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(norm).hexdigest()) for i in ids]
    return sorted(out, key=repr), len(members)


def check(found, rows):
    expected, groups = brute(rows)
    got = found.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got), key=repr) == expected
    kept = [r for r in got if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)


def test_awkward(awkward):
    check(X.exact_dedup(awkward), [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])


def test_clashing_digests_are_told_apart_by_their_bytes(awkward):
    """A digest of one byte value for all texts: the byte comparison alone decides."""
    docs = awkward.select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = X.exact_dedup(docs, hashed=lambda norm: b"same").collect()
    expected, groups = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == sorted((e[:3] for e in expected), key=repr)
    assert sum(r.kept for r in got) == groups


def test_small_filter_only_lets_more_texts_through(awkward):
    check(X.exact_dedup(awkward, filter_bits=6), [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])


def test_empty(no_docs):
    assert X.exact_dedup(no_docs).count() == 0
    assert X.keep_first(no_docs).count() == 0


def test_keep_first(awkward):
    kept = X.keep_first(awkward)
    assert kept.columns == awkward.columns
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=repr)
    assert ids == [1, 10, 11, 3, 5, 7, 8, 9]


def test_every_group_in_one_partition_or_in_many(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), F.col("id") % 700)).alias("text"))
    for width in (1, 7):
        check(X.exact_dedup(docs.repartition(width)), [(r.doc_id, r.text) for r in docs.collect()])


def test_query_against_sql(spark, duck_check):
    from compare import compare

    from cartwheel.llm import queries as Q

    assert compare(Q.op9_exact_dedup(spark, SF), duck_check, Q.OP9_SQL) is None
