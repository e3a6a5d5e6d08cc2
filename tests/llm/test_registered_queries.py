"""The registered queries without SQL against brute force, columns included."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from llm_support import SF

from cartwheel.llm import queries, tokens

QUERIES = queries.queries()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(name, corpus, end_id):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary(name))
    found = library.encode_batch([t or "" for _, t in corpus], add_special_tokens=False)
    return {d: [*e.ids, end_id] for (d, _), e in zip(corpus, found, strict=True)}


def test_op7_equals_the_library(spark, corpus):
    df = QUERIES["op7_token_files"](spark, SF)
    assert sorted(df.columns) == ["doc_id", "ids_crc32", "n_tokens", "start"]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in df.collect()}
    want, at = {}, 0
    for d, ids in sorted(encoded("byte_bpe_50k.json", corpus, 0).items()):
        want[d] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want


def test_op6_pieces_are_the_documents_ids(spark, corpus):
    df = QUERIES["op6_packing"](spark, SF)
    assert df.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ids, sequences, covered = encoded("word_bpe_49k.json", corpus, 1), defaultdict(list), defaultdict(list)
    for r in df.collect():
        mine = ids[r.doc_id]
        assert r.doc_tokens == len(mine) and r.ids_crc32 == crc(mine[r.start : r.start + r.length]) and r.length > 0
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts, total in [(covered[d], len(mine)) for d, mine in ids.items()] + [(p, None) for p in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == total if total is not None else at == 2048 or (at < 2048 and at & (at - 1) == 0)


def fingerprint(text):
    lower = (text or "").translate({c: c + 32 for c in range(0x41, 0x5B)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op3_equals_all_pairs(spark, corpus):
    df = QUERIES["op3_simhash_dedup"](spark, SF)
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    prints = {d: fingerprint(t) for d, t in corpus}
    parent = {d: d for d in prints}

    def root(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    ids = sorted(prints)
    values = np.array([prints[d] for d in ids], np.uint64)
    for i, d in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 3).tolist():
            a, b = sorted((root(d), root(ids[j])))
            parent[b] = a
    assert sorted(tuple(r) for r in df.collect()) == [(d, f"{prints[d]:016x}", root(d)) for d in ids]


def test_op5_draws_fit_their_source(spark, corpus):
    df = QUERIES["op5_mixing"](spark, SF)
    assert df.columns == ["doc_id", "source", "pass", "n_tokens", "start", "turn", "weight"]
    rows, texts = df.collect(), dict(corpus)
    assert len({(r.doc_id, r["pass"]) for r in rows}) == len(rows) and {r.doc_id for r in rows} <= set(texts)
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    for mine in by_source.values():
        at = 0
        for r in sorted(mine, key=lambda r: (r.start, r.n_tokens)):
            assert r.start == at and r["pass"] <= 2
            at += r.n_tokens
    weights = {s: mine[0].weight for s, mine in by_source.items()}
    assert sum(weights.values()) == pytest.approx(1, abs=1e-6)
    total = sum(r.n_tokens for r in rows)
    for s, mine in by_source.items():
        assert sum(r.n_tokens for r in mine) / total == pytest.approx(weights[s], abs=0.02)
