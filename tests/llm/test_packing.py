import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_support import SF

from cartwheel.llm import packing as P
from cartwheel.llm import tokens

WORDS = tokens.vocabulary("word_bpe_49k.json")


def rebuild(sizes, window, max_open=P.MAX_OPEN):
    packer, windows, ids = P.SumOfSquares(window, max_open), [], []
    for n, size in enumerate(sizes):
        ids.append(np.arange(size) + 1000 * n)
        windows += packer.add(n, ids[-1])
    return windows + list(packer.finish()), ids


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40), st.integers(2, 16), st.integers(1, 5))
def test_each_id_once_and_windows_full_or_a_power_of_two(sizes, window, max_open):
    windows, ids = rebuild(sizes, window, max_open)
    seen = {}
    for pieces in windows:
        total = sum(len(p[2]) for p in pieces)
        assert total <= window and (total == window or total & (total - 1) == 0)
        for n, start, part in pieces:
            assert len(part) and part.tolist() == ids[n][start : start + len(part)].tolist()
            seen.setdefault(n, []).append((start, len(part)))
    for n, size in enumerate(sizes):
        at = 0
        for start, length in sorted(seen[n]):
            assert start == at
            at += length
        assert at == size


def test_level_is_the_one_with_the_least_sum_of_squares():
    rng = np.random.default_rng(4)
    for _ in range(300):
        w = int(rng.integers(2, 12))
        packer = P.SumOfSquares(w)
        packer.counts[1:w] = rng.integers(0, 4, w - 1)
        size = int(rng.integers(1, w))
        costs = {}
        for h in range(0, w + 1 - size):
            if h and not packer.counts[h]:
                continue
            after = packer.counts.copy()
            after[h] -= h > 0
            if h + size < w:
                after[h + size] += 1
            costs[h] = int((after**2).sum())
        assert packer.best_level(size) == max(h for h in costs if costs[h] == min(costs.values()))


def check(df, rows, window=2048, end_id=1):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    pieces = df.collect()
    sequences, docs = {}, {}
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert len(ids) == p.length
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        docs.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)
    wanted = {}
    for doc_id, text in rows:
        wanted.setdefault(doc_id, []).append([*library.encode(text or "", add_special_tokens=False).ids, end_id])
    assert set(docs) == set(wanted)
    for doc_id, texts in wanted.items():
        if len(texts) == 1 or len({len(t) for t in texts}) == 1:
            got = sorted(docs[doc_id])
            copies = len(texts)
            whole = sum((g[1] for g in got[::copies]), []) if copies == 1 else None
            assert all(g[2] == len(texts[0]) for g in got)
            if whole is not None:
                assert whole == texts[0]
        assert sum(len(g[1]) for g in docs[doc_id]) == sum(map(len, texts))


def test_awkward(awkward):
    check(P.pack(awkward, WORDS), [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])


def test_small_table(spark, corpus):
    check(P.pack(spark.read.parquet(f"{SF}/documents.parquet"), WORDS), corpus)


def test_empty(no_docs):
    assert P.pack(no_docs, WORDS).count() == 0
