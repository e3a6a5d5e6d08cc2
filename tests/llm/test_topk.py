import math

import numpy as np
from llm_support import SF
from pyspark.sql import functions as F

from cartwheel.llm import queries, topk as K

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k=5):
    usable = [(i, r[0], [math.floor(256 * float(np.float32(x))) for x in r[1]]) for i, r in enumerate(rows)
              if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for i, q, x in usable:
        if q % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), c) for j, c, y in usable if j != i)[:k]
        out += [(q, n, c, -s) for n, (s, c) in enumerate(scores, 1)]
    return sorted(out)


def check(spark, rows, every=3, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = K.top_k(df, F.col("vec_id") % every == 0, **kw).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, every, **kw)


def small(monkeypatch):
    for name, value in (("SEEDS", 8), ("GROUP_ROWS", 40), ("BLOCK_ROWS", 16), ("QUERY_ROWS", 8)):
        monkeypatch.setattr(K, name, value)


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (3, [0.5, -0.1], 1), (3, [0.5, -0.1], 1), (6, None, 1), (9, [1.0, None], 1), (12, [float("nan"), 1.0], 1),
            (15, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (18, [], 1), (21, [1.0], 1), (24, [0.0, 0.0], None), (25, [1.0, 2.0], 1), (26, [1.0, 2.0], 1), (-27, [3.0, 3.0], 1)]
    check(spark, rows)


def test_random_with_ties(spark, monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 6)) * rng.lognormal(size=(300, 1)) * 4) / 4
    check(spark, [(int(i), [float(v) for v in row], 0) for i, row in enumerate(x)])


def test_large_components_stay_exact(spark, monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(2)
    x = rng.integers(-(2**20), 2**20, (60, 4)) * 3.0
    check(spark, [(int(i), [float(np.float32(v)) for v in row], 0) for i, row in enumerate(x)])


def test_fewer_than_k_and_empty(spark):
    check(spark, [(0, [1.0], 0), (1, [2.0], 0), (2, [-1.0], 0)])
    assert K.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 2 == 0).count() == 0


def test_bounds_leave_most_products_out(monkeypatch):
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(size=(4000, 32)) * np.geomspace(200, 1, 32)[None, :] * rng.lognormal(sigma=0.5, size=(4000, 1)))
    done = []
    plain = K.products
    monkeypatch.setattr(K, "products", lambda a, b: done.append(len(a) * len(b)) or plain(a, b))
    turn = K.rotation(v[:500])
    group = K.Group(np.arange(4000), np.arange(4000), v, turn)
    floors = np.partition(v[:50] @ v.T, -6, axis=1)[:, -6]
    list(group.search(np.arange(50), v[:50], turn, floors, 5))
    assert sum(done) < 0.5 * 50 * 4000


def test_query_against_sql(spark, duck_check):
    from compare import compare

    assert compare(queries.queries()["op8_top_k"](spark, SF), duck_check, queries.OP8_SQL) is None
