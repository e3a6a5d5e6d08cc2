"""Exact top-k inner products: vectors by descending length, rotated partial sums, Cauchy-Schwarz bounds.

Components become integers floor(256 x), scores are integer inner products.

* A rotation from the singular vectors of a bounded sample gathers most
  of every vector's length in its first coordinates; inner products stay.
* Candidates are range-partitioned into groups by descending length. A
  query's k-th best score among the ``SEEDS`` longest vectors is its first
  threshold; groups whose longest vector times the query's length stay
  below it are never visited.
* Within a group, blocks are visited in the same order. The sum over the
  first coordinates plus the product of the two remaining lengths bounds
  the score; only pairs whose bound reaches the query's threshold are
  computed, exactly, in integers. The threshold rises as results come in.

Queries are a stated set, dealt to the groups they can reach; a task holds
one group of candidates and one batch of queries.

Cases: vectors that are null or hold null or non-finite components, and rows
without an id, take no part; missing components of shorter vectors
count as zero; rows that repeat an id are vectors of their own, and a query
leaves out its own row only; ties go to the smaller id; an empty table
gives no rows. Scores beyond a long are held to its range.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwheel.llm import common

SEEDS, GROUP_ROWS, BLOCK_ROWS, QUERY_ROWS = 2048, 8192, 2048, 512
#: vectors that the rotation is fitted on; any rotation gives the same results.
ROTATION_SAMPLE = 4096
#: sums below this are exact in doubles.
EXACT = 2.0**52
LONG_MAX = 2**63 - 1


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, v, length): components floor(256 x) as little-endian doubles, and their length."""
    bad = F.exists(F.col(vector_col).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(True)))

    def pack(batch: pa.RecordBatch) -> dict:
        lists = [np.floor(np.asarray(x, float) * 256.0) for x in batch.column(1).to_pylist()]
        return {"vec_id": batch.column(0), "v": [x.astype("<f8").tobytes() for x in lists], "length": [float(np.sqrt(x @ x)) for x in lists]}

    packed = common.map_batches(usable.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")), "vec_id long, v binary, length double", pack)
    return packed.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", "length")


def matrix(values: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        x = np.frombuffer(v, "<f8")
        out[i, : len(x)] = x
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` with all of ``b``, as int64."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    reach = np.sqrt((a * a).sum(axis=1).max()) * np.sqrt((b * b).sum(axis=1).max())
    if reach < EXACT:
        return (a @ b.T).astype(np.int64)
    whole_a, whole_b = ([[int(x) for x in row] for row in m] for m in (a, b))
    return np.array([[max(-LONG_MAX, min(LONG_MAX, sum(map(int.__mul__, x, y)))) for y in whole_b] for x in whole_a], np.int64)


def rotation(sample: np.ndarray) -> np.ndarray:
    """Orthogonal matrix whose first columns carry most of the sample's length."""
    if not len(sample):
        return np.eye(sample.shape[1])
    scale = np.abs(sample).max() or 1.0
    return np.linalg.svd(sample / scale, full_matrices=len(sample) < sample.shape[1])[2].T


class Group:
    """Candidates by descending length, searched for batches of queries."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rotate: np.ndarray):
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        order = np.lexsort((rows, -lengths))
        self.rows, self.ids, self.vectors, self.lengths = rows[order], ids[order], vectors[order], lengths[order]
        self.rotated = self.vectors @ rotate
        self.head = max(1, vectors.shape[1] // 4)
        self.rest = np.sqrt((self.rotated[:, self.head :] ** 2).sum(axis=1))

    def search(self, rows: np.ndarray, vectors: np.ndarray, rotate: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple]:
        """(query number, row, id, score) of the k best per query among scores of at least its floor."""
        floors = floors.copy()
        rotated, lengths = vectors @ rotate, np.sqrt((vectors * vectors).sum(axis=1))
        rest = np.sqrt((rotated[:, self.head :] ** 2).sum(axis=1))
        best: list[list[tuple]] = [[] for _ in rows]
        for low in range(0, len(self.rows), BLOCK_ROWS):
            block = slice(low, low + BLOCK_ROWS)
            longest = self.lengths[low]
            slack = 1e-9 * (lengths * longest) + 1e-6  # rounding of the bounds; scores themselves are exact
            live = np.flatnonzero(lengths * longest + slack >= floors)
            if not len(live):
                break  # lengths only fall from here on
            bound = rotated[live, : self.head] @ self.rotated[block, : self.head].T + np.outer(rest[live], self.rest[block])
            near = bound + slack[live, None] >= floors[live, None]
            near &= rows[live][:, None] != self.rows[block][None, :]
            self._block(live, near, vectors, block, floors, best, k)
        for q, found in enumerate(best):
            for score, vec_id, row in found:
                yield q, row, vec_id, -score

    def _block(self, live: np.ndarray, near: np.ndarray, vectors: np.ndarray, block: slice, floors: np.ndarray, best: list, k: int) -> None:
        columns = np.flatnonzero(near.any(axis=0))
        queries = np.flatnonzero(near.any(axis=1))
        if not len(columns):
            return
        scores = products(vectors[live[queries]], self.vectors[block][columns])
        wanted = near[np.ix_(queries, columns)] & (scores >= floors[live[queries]][:, None])
        ids, rows = self.ids[block][columns], self.rows[block][columns]
        for i in np.flatnonzero(wanted.any(axis=1)):
            at = np.flatnonzero(wanted[i])
            if len(at) > k:  # the k-th score and its ties
                at = at[scores[i, at] >= np.partition(scores[i, at], -k)[-k]]
            q = int(live[queries[i]])
            merged = best[q] + list(zip((-scores[i, at]).tolist(), ids[at].tolist(), rows[at].tolist(), strict=True))
            best[q] = sorted(merged)[:k]
            if len(best[q]) == k:
                floors[q] = max(floors[q], -best[q][-1][0])


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores. ``is_query`` is a condition on the column vec_id."""
    spark = vectors.sparkSession
    points = common.staged(integers(vectors, id_col, vector_col))
    facts = points.agg(F.count("*").alias("n"), F.max(F.length("v")).alias("bytes")).first()
    width, total = max(1, (facts["bytes"] or 0) // 8), facts["n"]
    longest = points.orderBy(F.desc("length"), "row").limit(SEEDS).toArrow()  # SEEDS vectors, as the name says
    part = math.ceil(min(1.0, ROTATION_SAMPLE / max(1, total)) * 1_000_000)
    sample = points.filter(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < part).limit(ROTATION_SAMPLE).toArrow()
    rotate = rotation(matrix(sample.column("v").to_pylist(), width))

    groups = max(1, math.ceil(total / GROUP_ROWS))
    ranged = points.repartitionByRange(groups, F.desc("length"), F.asc("row")).withColumn("g", F.spark_partition_id())
    dealt = common.staged(ranged)
    reach = dict(dealt.groupBy("g").agg(F.max("length")).toArrow().to_pandas().itertuples(index=False))  # a number per group of GROUP_ROWS
    shared = spark.sparkContext.broadcast((rotate, longest.column("row").to_numpy(), matrix(longest.column("v").to_pylist(), width), reach))

    def ask(batch: pa.RecordBatch) -> dict:
        _, seed_rows, seeds, far = shared.value
        names = np.array(sorted(far), np.int64)
        lengths = np.array([far[g] for g in names])
        rows, values = batch.column(0).to_numpy(), batch.column(2).to_pylist()
        out: dict[str, list] = {c: [] for c in ("g", "row", "vec_id", "v", "floor")}
        for low in range(0, len(rows), QUERY_ROWS):
            at = slice(low, low + QUERY_ROWS)
            q = matrix(values[at], width)
            scores = products(q, seeds).astype(float)
            scores[rows[at][:, None] == seed_rows[None, :]] = -np.inf
            floors = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q), -np.inf)
            size = np.sqrt((q * q).sum(axis=1))
            for i in range(len(q)):
                for g in names[size[i] * lengths * (1 + 1e-9) + 1e-6 >= floors[i]].tolist():
                    for c, x in (("g", g), ("row", int(rows[low + i])), ("vec_id", batch.column(1)[low + i].as_py()), ("v", values[low + i]), ("floor", float(floors[i]))):
                        out[c].append(x)
        return out

    queries = dealt.filter(is_query).select("row", "vec_id", "v")
    asked = common.map_batches(queries, "g int, row long, vec_id long, v binary, floor double", ask)
    both = dealt.select("g", F.lit(0).alias("kind"), "row", "vec_id", "v", F.lit(0.0).alias("floor")).unionByName(asked.withColumn("kind", F.lit(1)))
    ordered = both.repartition(groups, "g").sortWithinPartitions("g", "kind", "row")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = shared.value[0]
        now, held, group = None, [], None
        for batch in batches:
            gs, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(gs) != 0) | (np.diff(kinds) != 0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(gs)], strict=True):
                part = batch.slice(low, high - low)
                if not part.num_rows:
                    continue
                if gs[low] != now:
                    now, held, group = gs[low], [], None
                if kinds[low] == 0:
                    held.append(part)
                    continue
                if group is None:
                    mine = pa.Table.from_batches(held)
                    group = Group(mine.column("row").to_numpy(), mine.column("vec_id").to_numpy(), matrix(mine.column("v").to_pylist(), width), turn)
                    held = []
                for at in range(0, part.num_rows, QUERY_ROWS):
                    some = part.slice(at, QUERY_ROWS)
                    rows = some.column(2).to_numpy()
                    found = list(group.search(rows, matrix(some.column(4).to_pylist(), width), turn, some.column(5).to_numpy(), k))
                    numbers = np.array([f[0] for f in found], np.int64)
                    yield pa.RecordBatch.from_pydict(
                        {"query": pa.array(rows[numbers]), "query_id": some.column(3).take(pa.array(numbers)),
                         "row": pa.array([f[1] for f in found], pa.int64()), "vec_id": pa.array([f[2] for f in found], pa.int64()),
                         "score": pa.array([f[3] for f in found], pa.int64())}
                    )

    found = ordered.select("g", "kind", "row", "vec_id", "v", "floor").mapInArrow(search, "query long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
