import hashlib
import random
import tempfile
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_support import DOCS, SF

from cartwheel.llm import induced, queries
from cartwheel.llm import suffix_dedup as S


def suffixes(symbols, cap):
    """Suffix array and common prefixes, by comparing suffixes."""
    order, prefix = sorted(range(len(symbols)), key=lambda i: symbols[i:]), [0] * len(symbols)
    for j in range(1, len(symbols)):
        a, b = order[j - 1], order[j]
        while prefix[j] < cap and max(a, b) + prefix[j] < len(symbols) and symbols[a + prefix[j]] == symbols[b + prefix[j]]:
            prefix[j] += 1
    return order, prefix


def a_text(rng):
    n, sigma = rng.randint(0, rng.choice([5, 60, 300])), rng.choice([1, 2, 3, 30])
    if rng.random() < 0.5:
        return [rng.randint(1, sigma) for _ in range(n)] + [0]
    base, out = [rng.randint(1, sigma) for _ in range(rng.randint(1, 12))], []
    while len(out) < n:
        out += base if rng.random() < 0.8 else [rng.randint(1, sigma)]
    return out + [0]


@pytest.mark.parametrize("memory", [1 << 26, 600, 64])
@pytest.mark.parametrize("range_size, part, batch", [(1024, 1024, 1 << 17), (1, 7, 3), (3, 1, 16)])
def test_induced_sorting_equals_comparing(memory, range_size, part, batch, monkeypatch):
    for name, value in (("RANGE_SIZE", range_size), ("PART", part), ("BATCH", batch)):
        monkeypatch.setattr(induced, name, value)
    rng = random.Random(memory + range_size)
    for _ in range(60):
        text, cap = a_text(rng), rng.choice([2, 5, 200])
        with tempfile.TemporaryDirectory() as folder:
            order, prefix = induced.suffix_array(np.array(text, np.uint16), induced.Scratch(folder, memory), cap)
            assert (order.tolist(), prefix.tolist()) == suffixes(text, cap), (text, cap)


def test_files_go_when_done(tmp_path):
    text = np.append(np.random.default_rng(0).integers(1, 4, 3000), 0).astype(np.uint16)
    scratch = induced.Scratch(str(tmp_path), 500)
    for _ in induced.descending(text, scratch, 200):
        pass
    assert scratch.files > 10 and not list(tmp_path.iterdir())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=80), st.integers(1, 12))
def test_range_min(values, width):
    values = np.array(values, np.uint16)
    low = np.arange(len(values))
    high = np.minimum(low + width - 1, len(values) - 1)
    assert induced.range_min(values, low, high).tolist() == [min(values[a : b + 1]) for a, b in zip(low, high, strict=True)]


def brute(rows, window):
    """The contract as it reads, with a count of every window."""
    texts = [(d, b"" if t is None else t.encode()) for d, t in rows]
    seen = Counter(t[i : i + window] for _, t in texts for i in range(len(t) - window + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=repr)


def test_equal_windows_have_equal_keys():
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 100, 400).astype(np.uint8)
    keys = []
    for _ in range(5):
        text = np.concatenate([rng.integers(97, 100, int(rng.integers(0, 500))), passage, rng.integers(97, 100, 300)]).astype(np.uint8)
        at = {i: int(k) for a, b, k in zip(*S.runs(text, np.array([len(text)]), 200, 64), strict=True) for i in range(a, b + 1)}
        assert sorted(at) == list(range(len(text) - 199))
        start = text.tobytes().index(passage.tobytes())
        keys.append([at[start + i] for i in range(201)])
    assert all(k == keys[0] for k in keys)


@pytest.mark.parametrize("block, shard, memory", [(2 << 20, 2 << 20, 1 << 26), (300, 500, 1 << 26), (2000, 1 << 20, 4000)])
def test_small_windows_against_brute_force(spark, block, shard, memory):
    rng = random.Random(block)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), None, None, None) for i in range(60)]
    rows += [(i, rows[i % 7][1], None, None, None) for i in range(60, 80)] + [(80, "é" * 40, None, None, None), (81, "a" * 90, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = S.dedup(docs, window=20, gram=8, block_bytes=block, shard_bytes=shard, sort_memory=memory)
    assert result(got) == brute([r[:2] for r in rows], 20)


def test_awkward(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert result(S.dedup(awkward, window=30, gram=16)) == brute(rows, 30)


def test_spans_and_kept_bytes_fit_together(awkward):
    for r in S.dedup(awkward, window=30, gram=16).collect():
        assert len(r.starts) == len(r.ends) == r.n_spans and sum(b - a for a, b in zip(r.starts, r.ends, strict=True)) == r.n_removed
        assert len(r.kept) == r.n_bytes - r.n_removed


def test_query_against_brute_force(spark, corpus):
    df = queries.op11_suffix_dedup(spark, SF)
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == brute(corpus, 200)
    assert any(r[2] for r in got)


def test_empty(no_docs):
    assert S.dedup(no_docs).count() == 0


def slices_of(texts, window, gram):
    """(key, digest, slice, copies) by key, as a shard gets them."""
    rows = {}
    for text in texts:
        for a, n, *name in zip(*(x.tolist() for x in S.block_runs(text, [len(text)], window, gram)), strict=True):
            rows.setdefault(tuple(name), []).append(text[a : a + n])
    return [(*name, found[0], min(len(found), 2)) for name, found in sorted(rows.items())]


def spans_by_counting(slices, window):
    seen = Counter()
    for _, _, piece, copies in slices:
        for i in range(len(piece) - window + 1):
            seen[piece[i : i + window]] += copies
    out = []
    for key, digest, piece, _ in slices:
        at = [i for i in range(len(piece) - window + 1) if seen[piece[i : i + window]] > 1]
        starts = [i for i in at if i - 1 not in at]
        if at:
            out.append((key, digest, starts, [i + window for i in at if i + 1 not in at]))
    return sorted(out)


@pytest.mark.parametrize("memory", [1 << 26, 2000, 200])
def test_spans_of_slices_equal_counting(memory, tmp_path):
    rng = random.Random(memory)
    for _ in range(150):
        window = rng.choice([1, 2, 5, 12, 33])
        gram, sigma = rng.randint(1, window), rng.choice([1, 2, 3, 10])  # byte 0 included
        base, texts = bytes(rng.randrange(sigma) for _ in range(rng.randint(0, 150))), []
        for _ in range(rng.randint(1, 12)):
            text = bytearray(base[rng.randint(0, 20) :] + bytes(rng.randrange(sigma) for _ in range(rng.randint(0, 30))))
            for _ in range(rng.randint(0, 4) if text else 0):
                text[rng.randrange(len(text))] = rng.randrange(sigma)
            texts.append(bytes(text))
        slices = slices_of(texts, window, gram)
        assert sorted(S.repeated_spans(iter(slices), window, gram, str(tmp_path), memory)) == spans_by_counting(slices, window)


def test_near_copies_take_little_time_and_no_files(tmp_path):
    # sorting all suffixes of these slices took 0.67 microseconds a byte
    rng = np.random.default_rng(3)
    base, texts = rng.integers(97, 123, 2000).astype(np.uint8), []
    for _ in range(400):
        text = base.copy()
        text[rng.integers(0, 2000, 12)] = rng.integers(97, 123, 12)
        texts.append(text.tobytes())
    slices = slices_of(texts, 200, 64)
    before = time.process_time()
    got = list(S.repeated_spans(iter(slices), 200, 64, str(tmp_path), S.SORT_MEMORY))
    assert time.process_time() - before < 3e-7 * sum(len(s[2]) for s in slices)
    assert sorted(got) == spans_by_counting(slices, 200) and not list(tmp_path.iterdir())
