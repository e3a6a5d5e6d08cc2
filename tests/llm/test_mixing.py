import collections
import math

import pytest

from cartwheel.llm import mixing as M


def plain_exponent(tokens, entropy_share, max_passes):
    tokens = [t for t in tokens if t]
    total = sum(tokens)

    def weights(a):
        raw = [(t / total) ** a for t in tokens]
        return [r / sum(raw) for r in raw]

    def entropy(a):
        return -sum(w * math.log(w) for w in weights(a))

    def passes(a):
        w = weights(a)
        whole = max(t / x for t, x in zip(tokens, w, strict=True))
        return max(whole * x / t for t, x in zip(tokens, w, strict=True))

    grid = [i / 100_000 for i in range(100_001)]
    by_entropy = max((a for a in grid if entropy(a) >= entropy_share * math.log(len(tokens)) - 1e-9), default=0.0)
    by_passes = min((a for a in grid if passes(a) <= max_passes + 1e-9), default=1.0)
    return max(by_entropy, by_passes)


@pytest.mark.parametrize("limits", [(0.95, 2.0), (0.95, 50.0), (0.5, 2.0), (1.0, 1e9), (1.0, 1.0)])
def test_exponent(spark, limits):
    tokens = [100_000, 9000, 8000, 7000, 100, 0]
    table = spark.createDataFrame(list(zip("abcdef", tokens, strict=True)), "source string, tokens long")
    got = M.exponent(table, entropy_share=limits[0], max_passes=limits[1])
    assert abs(got - plain_exponent(tokens, *limits)) < 3e-5


def docs_of(spark, sizes):
    rows = [(i * 100 + j, " ".join(["w"] * (1 + (i * 7 + j) % 9)), source) for i, (source, n) in enumerate(sizes.items()) for j in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def test_blocks_are_whole_permutations_cut_at_the_budget(spark):
    rows, docs = docs_of(spark, {"big": 90, "mid": 30, "small": 12})
    got = M.mix(docs, entropy_share=1.0, max_passes=3.0).collect()
    size = {r[0]: len(r[1].split()) for r in rows}
    members = collections.defaultdict(set)
    for doc_id, _, source in rows:
        members[source].add(doc_id)
    for source, ids in members.items():
        mine = sorted((r for r in got if r.source == source), key=lambda r: r.start)
        tokens, at = sum(size[i] for i in ids), 0
        by_pass = collections.defaultdict(list)
        for r in mine:
            assert r.start == at and r.n_tokens == size[r.doc_id] and 0 <= r.turn <= 1
            at += r.n_tokens
            by_pass[r["pass"]].append(r.doc_id)
        assert set(by_pass[1]) == ids  # nothing is left out
        last = max(by_pass)
        assert all(sorted(by_pass[p]) == sorted(ids) for p in range(1, last))
        assert len(set(by_pass[last])) == len(by_pass[last]) and at / tokens <= 3.0 + 1e-6
        assert last == 1 or by_pass[1][: len(by_pass[2])] != by_pass[2]
    whole = sum(r.n_tokens for r in got)
    for source in members:
        share = sum(r.n_tokens for r in got if r.source == source) / whole
        weight = next(r.weight for r in got if r.source == source)
        assert abs(share - weight) < 0.05


def test_stated_budget(spark):
    rows, docs = docs_of(spark, {"big": 60, "small": 20})
    got = M.mix(docs, entropy_share=0.0, max_passes=9.0, budget=100).collect()
    assert 80 <= sum(r.n_tokens for r in got) <= 100


def test_same_mix_again(spark):
    _, docs = docs_of(spark, {"a": 40, "b": 10, "c": 5})
    one, two = (sorted(tuple(r) for r in M.mix(d).collect()) for d in (docs, docs.repartition(2)))
    assert one == two


def test_awkward(spark, awkward, no_docs):
    got = M.mix(awkward).collect()
    units = {(r.doc_id, r.source) for r in awkward.select("doc_id", "source").collect()}
    assert {(r.doc_id, r.source) for r in got} == units
    assert M.mix(no_docs).count() == 0
    again = M.repeat_documents(awkward)
    assert again.columns == awkward.columns
    assert {(r.doc_id, r.text) for r in again.select("doc_id", "text").collect()} == {(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()}
    assert M.repeat_documents(no_docs).count() == 0


def test_word_count(spark):
    df = spark.createDataFrame([(None,), ("",), (" \n ",), ("a",), (" a  b\tc\n",)], "t string")
    assert [r[0] for r in df.select(M.word_count(df.t)).collect()] == [0, 0, 0, 1, 3]


def stretches(rows, n, tokens):
    """The rows cut into ``n`` stretches of about as many tokens."""
    whole, at, out = sum(map(tokens, rows)), 0, [[] for _ in range(n)]
    for r in rows:
        out[min(n - 1, at * n // whole)].append(r)
        at += tokens(r)
    return out


def assert_shares(got, drawn, n):
    def tokens(r):
        return len(r.text.split())

    whole = collections.Counter()
    for r in drawn:
        whole[r.source] += r.n_tokens
    for part in stretches(got, n, tokens):
        here = collections.Counter()
        for r in part:
            here[r.source] += tokens(r)
        assert all(abs(here[s] / sum(here.values()) - whole[s] / sum(whole.values())) < 0.05 for s in whole)


def test_repeated_documents_come_in_the_order_of_the_mix(spark, tmp_path):
    rows, _ = docs_of(spark, {"big": 900, "mid": 300, "small": 120})
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)  # sorted by source
    limits = {"entropy_share": 1.0, "max_passes": 3.0}
    drawn = M.mix(docs, **limits).collect()
    again = M.repeat_documents(docs, **limits)
    got = again.collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in sorted(drawn, key=lambda r: (r.turn, r.doc_id))]
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r.doc_id for r in drawn)
    assert {(r.doc_id, r.text, r.source) for r in got} == set(rows)
    assert len(got) > len(rows) and all(a.doc_id != b.doc_id for a, b in zip(got, got[1:], strict=False))
    assert_shares(got, drawn, 10)
    again.write.parquet(str(tmp_path / "mixed"))  # as the pipeline does
    files = sorted((tmp_path / "mixed").glob("part-*"))
    assert [r.doc_id for f in files for r in spark.read.parquet(str(f)).collect()] == [r.doc_id for r in got]


def test_rows_that_share_an_id_are_spread_over_their_stretch(spark):
    rows = [(None, f"w{i} " * (1 + i % 5), "a") for i in range(600)] + [(i, f"v{i} " * (1 + i % 5), "a" if i % 2 else "b") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    drawn = M.mix(docs).collect()
    times = collections.Counter((r.doc_id, r.source) for r in drawn)
    got = M.repeat_documents(docs).collect()
    assert collections.Counter(got) == collections.Counter({r: times[r[0], r[2]] for r in rows})
    assert_shares(got, drawn, 8)
