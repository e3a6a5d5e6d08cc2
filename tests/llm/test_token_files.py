import tempfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_support import SF

from cartwheel.llm import token_files as TF
from cartwheel.llm import tokens

BYTES = tokens.vocabulary("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_hash_is_minimal_and_perfect(keys):
    keys = np.array(sorted(keys), np.uint64)
    assert sorted(TF.PerfectHash.build(keys).slots(keys).tolist()) == list(range(len(keys)))


def test_hash_lists_what_its_levels_leave(monkeypatch):
    monkeypatch.setattr(TF, "LEVELS", 1)
    monkeypatch.setattr(TF, "GAMMA", 0.2)
    keys = np.arange(5000, dtype=np.uint64) * np.uint64(7)
    built = TF.PerfectHash.build(keys)
    assert len(built.rest) and sorted(built.slots(keys).tolist()) == list(range(5000))


def test_index_refuses_unknown_keys():
    keys = np.arange(0, 4000, 2).astype(np.int64).view(np.uint64)
    n = np.arange(len(keys))
    index = TF.Index(TF.index_bytes(keys, n % 7, n, n * 0 + 1, (3, 4, 5)))
    found, entry = index.find(np.arange(4000).astype(np.int64).view(np.uint64))
    assert found.tolist() == [i % 2 == 0 for i in range(4000)]
    assert entry["first"][found].tolist() == n.tolist()
    assert (index.null["shard"], index.null["first"], index.null["count"]) == (3, 4, 5)


@pytest.fixture
def folder():
    return f"file://{tempfile.mkdtemp(prefix='tokens-')}/files"


def check(spark, docs, rows, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    files = TF.write(docs, folder, BYTES, end_id=0)
    got = sorted((r.start, r.key, r.n_tokens, r.ids_crc32) for r in TF.read(files, files.keys).collect())
    at, expected = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((at, doc_id, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == expected
    return files


def test_awkward(spark, awkward, folder):
    files = check(spark, awkward, [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()], folder)
    asked = spark.createDataFrame([(9,), (9,), (12345,), (None,)], "key long")
    assert sorted((r.key for r in TF.read(files, asked).collect()), key=repr) == [9, None, None]


def test_small_table(spark, corpus, folder, monkeypatch):
    monkeypatch.setattr(TF, "BUCKET_KEYS", 100)
    check(spark, spark.read.parquet(f"{SF}/documents.parquet"), corpus, folder)


def test_empty(no_docs, folder):
    files = TF.write(no_docs, folder, BYTES)
    assert TF.read(files, files.keys).count() == 0
