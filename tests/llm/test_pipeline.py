import numpy as np
import pytest
from llm_support import SF
from test_simhash_dedup import plain_components, plain_fingerprint

import corpus_pipeline as P
from cartwheel.llm import exact_dedup as X
from cartwheel.llm import queries


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_schema(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_quality_stage_is_the_query(spark, stages):
    good = {r.doc_id for r in queries.queries()["op4_quality"](spark, SF).collect() if r.predicted}
    assert {i for i, _ in rows(stages[1])} == good


def test_exact_stage(stages):
    first = {}
    for doc_id, text in sorted(rows(stages[1])):
        first.setdefault(X.normalise((text or "").encode()), doc_id)
    assert sorted(i for i, _ in rows(stages[2])) == sorted(first.values())


def test_near_stage(stages):
    before = sorted(rows(stages[2]))
    comp = plain_components([plain_fingerprint(t) for _, t in before], 3)
    keep = {}
    for (doc_id, _), c in zip(before, comp, strict=True):
        keep[c] = min(doc_id, keep.get(c, doc_id))
    assert sorted(i for i, _ in rows(stages[3])) == sorted(keep.values())


def test_mixing_keeps_every_document(stages):
    assert {i for i, _ in rows(stages[4])} == {i for i, _ in rows(stages[3])}


def test_packing_stage(stages):
    copies = {}
    for i, _ in rows(stages[4]):
        copies[i] = copies.get(i, 0) + 1
    got = {}
    for p in stages[5].collect():
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
        assert p.length <= 2048 and len(np.frombuffer(bytes(p.ids), "<u4")) == p.length
        total = p.doc_tokens * copies[p.doc_id]
        copies.setdefault(("t", p.doc_id), total)
    assert all(got[i] == copies["t", i] for i in got) and set(got) == {i for i, _ in rows(stages[4])}


def test_empty_documents(spark, no_docs):
    docs = no_docs
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
