"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds documents in blocks. A block is a bit matrix: one slice (a
bitmap over the block's documents) per signature position. A document's
signature has a few hashed positions for every pair (term, step): step s
is set where the term occurs at least ``STEPS[s]`` times. Documents of a
block have about equally many pairs (same power of two), and the signature is
at least 16 bits per pair.

A search ANDs the slices of each query term, step after step. The bitmap
of a step holds every document that reaches it, and a few more, so the
highest step found bounds the term's occurrences from above, and the sum
over the item's terms of weight times bounded saturation bounds the
document's score. Two passes over the index:

1. the documents with the highest bounds of each item are scored exactly;
   the k-th best of them is a score that the result reaches at least;
2. every document whose bound reaches that score is scored exactly.

So a document is left out only if its bound proves it to be outside the
top k. Items are searched in groups of bounded size, each against all
blocks; scores are exact integers (``score_matrix``).

Cases: null and empty texts have no terms, are in no block and match nothing;
an item without terms gets no rows; equal scores go by document id, null
ids last; rows that repeat an id are documents of their own; items that
repeat an id are ranked each; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.llm import common

#: occurrences that get a step of their own; a term found up to step s occurs less often than STEPS[s + 1].
STEPS = [1, 2, 3, 4, 5, 6, *(b << e for e in range(2, 29) for b in (2, 3))]
BITS_PER_PAIR, PROBES = 16, 5
#: bits of one block's matrix while it is built (one byte each), and its documents at most.
BLOCK_BITS, BLOCK_ROWS = 1 << 23, 4096
#: query terms (with repeats) searched together; more are searched in several groups.
GROUP_TERMS = 50_000
#: distinct query terms up to which a build counts only them; beyond, it counts every term.
COUNTED_TERMS = 500_000
#: candidate ids up to which they are broadcast (8 bytes each); beyond, the join is a shuffle.
BROADCAST_IDS = 500_000

# fixed values: bytes that end a term, and A-Z in lower case
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters; A-Z in lower case."""
    return text.translate(_TABLE).split() if text else []


# -- the index ---------------------------------------------------------------


class Index(NamedTuple):
    blocks: DataFrame  # bits, steps, doc_ids, sizes, slices
    counts: DataFrame  # term, df
    documents: int  # with at least one term
    occurrences: int


def term_hash(term: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(term)


def probes(hashes: np.ndarray, step: np.ndarray | int, bits: int) -> np.ndarray:
    """Signature positions (pairs x PROBES) of (term hash, step)."""
    with np.errstate(over="ignore"):
        x = hashes + (np.asarray(step, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        stride = (x >> np.uint64(32)) | np.uint64(1)
        places = x[..., None] + np.arange(PROBES, dtype=np.uint64) * stride[..., None]
    return (places & np.uint64((1 << bits) - 1)).astype(np.int64)


class _Block:
    """Documents of one size class on their way into a bit matrix."""

    def __init__(self, bits: int):
        self.bits, self.rows = bits, max(8, min(BLOCK_ROWS, BLOCK_BITS >> bits))
        self.ids: list = []
        self.sizes: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.steps: list[np.ndarray] = []

    def add(self, doc_id, size: int, hashes: np.ndarray, steps: np.ndarray) -> bool:
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.hashes.append(hashes)
        self.steps.append(steps)
        return len(self.ids) == self.rows

    def close(self) -> dict:
        row = np.repeat(np.arange(len(self.ids)), [len(h) for h in self.hashes])
        hashes, steps = np.concatenate(self.hashes), np.concatenate(self.steps)
        grid = np.zeros((1 << self.bits, -(-len(self.ids) // 8) * 8), bool)
        for step in range(int(steps.max())):
            reached = steps > step
            grid[probes(hashes[reached], step, self.bits), row[reached][:, None]] = True
        return {
            "bits": [self.bits], "steps": [int(steps.max())], "doc_ids": [self.ids], "sizes": [self.sizes],
            "slices": [np.packbits(grid, axis=1).tobytes()], "term": [None], "df": [None],
        }


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, counted: Iterable[bytes] | None = None) -> Index:
    """Indexes every document; document frequencies are counted for ``counted`` terms, or for all."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    schema = T.StructType.fromDDL("bits int, steps int, sizes array<int>, slices binary, term binary, df long")
    schema = schema.add("doc_ids", T.ArrayType(kind))
    wanted = None if counted is None else spark.sparkContext.broadcast(frozenset(counted))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, blocks, df = common.arrow_schema(schema), {}, Counter()

        def frequencies() -> pa.RecordBatch:
            n = len(df)
            empty = dict.fromkeys(("bits", "steps", "sizes", "slices", "doc_ids"), [None] * n)
            batch = common.record_batch(empty | {"term": list(df), "df": list(df.values())}, kinds)
            df.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), common.text_bytes(batch.column(1)), strict=True):
                words = terms(text)
                if not words:
                    continue
                tf = Counter(words)
                df.update(tf.keys() if wanted is None else wanted.value & tf.keys())
                steps = np.array([bisect_right(STEPS, n) for n in tf.values()], np.int64)
                bits = max(6, math.ceil(math.log2(BITS_PER_PAIR * int(steps.sum()))))
                block = blocks.get(bits)
                if block is None:
                    block = blocks[bits] = _Block(bits)
                if block.add(doc_id, len(words), np.array(list(map(term_hash, tf)), np.uint64), steps):
                    yield common.record_batch(blocks.pop(bits).close(), kinds)
            if len(df) > 200_000:
                yield frequencies()
        for block in blocks.values():
            yield common.record_batch(block.close(), kinds)
        yield frequencies()

    rows = common.stored(docs.select(id_col, text_col).mapInArrow(run, schema), "ranked-search")
    blocks = rows.filter("slices is not null").select("bits", "steps", "doc_ids", "sizes", "slices")
    sums = blocks.agg(F.sum(F.size("sizes")).alias("n"), F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")).alias("l")).first()
    counts = rows.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    return Index(blocks, counts, sums.n or 0, sums.l or 0)


# -- queries -------------------------------------------------------------------


class Query(NamedTuple):
    """A group of items: their distinct terms, and per item the weight of each."""

    keys: list[str]
    terms: dict[bytes, int]
    hashes: np.ndarray
    weights: np.ndarray  # items x terms: occurrences in the item times weight
    documents: int
    occurrences: int


def make_query(items: dict[str, bytes], df: dict[bytes, int], documents: int, occurrences: int) -> Query:
    number: dict[bytes, int] = {}
    held = {key: Counter(t for t in terms(text) if t in df) for key, text in items.items()}
    for found in held.values():
        for t in found:
            number.setdefault(t, len(number))
    weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) for t in number}
    matrix = np.zeros((len(held), len(number)), np.int64)
    for i, found in enumerate(held.values()):
        for t, n in found.items():
            matrix[i, number[t]] = n * weight[t]
    # sums below 2**53 are exact in doubles, whose products are fast
    exact = int(matrix.sum(axis=1).max(initial=0)) * 1_000_000 < 2**53
    return Query(list(held), number, np.array([term_hash(t) for t in number], np.uint64), matrix.astype(np.float64 if exact else np.int64), documents, occurrences)


def saturation(tf: np.ndarray, sizes: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 12 * m) with m of the documents' sizes; 64-bit integers."""
    m = 100 - 25 + (25 * sizes.astype(np.int64) * documents) // occurrences
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def bounds(query: Query, bits: int, steps: int, sizes: np.ndarray, slices: bytes) -> np.ndarray:
    """Items x documents of a block: at least the score."""
    n = len(sizes)
    grid = np.frombuffer(slices, np.uint8).reshape(1 << bits, -1)
    highest = np.zeros((len(query.hashes), n), np.uint8)
    alive, there = np.arange(len(query.hashes)), None
    for step in range(steps):
        found = np.bitwise_and.reduce(grid[probes(query.hashes[alive], step, bits)], axis=1)
        there = found if there is None else there & found  # a step counts only above the ones below it
        some = there.any(axis=1)
        alive, there = alive[some], there[some]
        if not len(alive):
            break
        highest[alive] += np.unpackbits(there, axis=1, count=n)
    most = np.array([0, *(s - 1 for s in STEPS[1:]), 2**31])
    by_step = saturation(most[: steps + 1, None], sizes, query.documents, query.occurrences)  # steps x documents
    seen = highest.any(axis=1)
    values = by_step[highest[seen], np.arange(n)]
    return query.weights[:, seen] @ values.astype(query.weights.dtype)


class Best:
    """The k best (value, document id) of each item so far; ties by id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.held = k, [[] for _ in range(items)]

    def add(self, scores: np.ndarray, ids: list) -> None:
        """``scores``: items x documents."""
        for i, row in enumerate(scores):
            held = self.held[i]
            floor = held[-1][0] if len(held) == self.k else 1
            at = np.flatnonzero(row >= max(1, floor))
            if len(at) > 4 * self.k:  # all that tie with the k-th stay in
                at = at[row[at] >= np.partition(row[at], -self.k)[-self.k]]
            if len(at):
                merged = held + [(int(row[j]), ids[j]) for j in at]
                merged.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
                self.held[i] = merged[: self.k]

    def columns(self, keys: list[str]) -> dict:
        rows = [(keys[i], d, s) for i, held in enumerate(self.held) for s, d in held]
        return {"item": [r[0] for r in rows], "doc_id": [r[1] for r in rows], "score": [r[2] for r in rows]}


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _found_schema(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("item", T.StringType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])


def best_bounds(blocks: DataFrame, query, k: int) -> DataFrame:
    """(item, doc_id, score): per task the documents with the highest bounds of each item."""
    schema = _found_schema(blocks.schema["doc_ids"].dataType.elementType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, kinds = query.value, common.arrow_schema(schema)
        best = Best(len(q.keys), k)
        for row in (r for b in batches for r in b.to_pylist()):
            best.add(bounds(q, row["bits"], row["steps"], np.array(row["sizes"]), row["slices"]), row["doc_ids"])
        yield common.record_batch(best.columns(q.keys), kinds)

    return blocks.mapInArrow(run, schema)


def reaching(blocks: DataFrame, query, least: dict[str, int]) -> DataFrame:
    """(doc_id) of every document whose bound for some item reaches that item's least score."""
    schema = T.StructType([T.StructField("doc_id", blocks.schema["doc_ids"].dataType.elementType)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, kinds = query.value, common.arrow_schema(schema)
        floor = np.array([max(1, least.get(key, 1)) for key in q.keys])[:, None]
        for row in (r for b in batches for r in b.to_pylist()):
            hit = (bounds(q, row["bits"], row["steps"], np.array(row["sizes"]), row["slices"]) >= floor).any(axis=0)
            yield common.record_batch({"doc_id": [row["doc_ids"][j] for j in np.flatnonzero(hit)]}, kinds)

    return blocks.mapInArrow(run, schema).distinct()


def score_matrix(query: Query, texts: list[bytes | None]) -> np.ndarray:
    """Items x texts: the exact scores."""
    words = [terms(t) for t in texts]
    tf = np.zeros((len(query.terms), len(texts)), np.int64)
    for j, found in enumerate(words):
        for t, n in Counter(found).items():
            at = query.terms.get(t)
            if at is not None:
                tf[at, j] = n
    values = saturation(tf, np.array([len(w) for w in words]), query.documents, query.occurrences)
    return query.weights @ values.astype(query.weights.dtype)


def rescored(docs: DataFrame, ids: DataFrame, query, k: int) -> DataFrame:
    """(item, doc_id, score, rank): the exact top k of each item among all rows of ``docs`` (id, text) with one of ``ids``."""
    schema = _found_schema(docs.schema["id"].dataType)
    ids = common.staged(ids.select(F.col("doc_id").alias("wanted")))
    small = ids.count() <= BROADCAST_IDS
    chosen = docs.join(F.broadcast(ids) if small else ids, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, kinds = query.value, common.arrow_schema(schema)
        best = Best(len(q.keys), k)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                best.add(score_matrix(q, common.text_bytes(part.column(1))), part.column(0).to_pylist())
        yield common.record_batch(best.columns(q.keys), kinds)

    return _ranked(chosen.mapInArrow(run, schema), k)


# -- search --------------------------------------------------------------------


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, term, n) of every distinct item text."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = [(k, t, n) for k, text in zip(batch.column(0).to_pylist(), common.text_bytes(batch.column(1)), strict=True)
                for t, n in Counter(terms(text)).items()]
        return {c: [r[i] for r in rows] for i, c in enumerate(("item", "term", "n"))}

    return common.map_batches(items, "item string, term binary, n long", run)


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", group_terms: int = GROUP_TERMS, counted_terms: int = COUNTED_TERMS,
) -> DataFrame:
    """The ``k`` best documents of each item: ``item_col``, rank, doc_id, score."""
    spark = docs.sparkSession
    key: Column = F.sha2(F.col(item_text).cast("binary"), 256)
    texts = common.staged(items.filter(F.col(item_text).isNotNull()).select(key.alias("item"), F.col(item_text).alias("words")).distinct())
    asked = common.staged(_item_terms(texts))
    distinct = asked.select("term").distinct()
    few = distinct.count() <= counted_terms
    index = build(docs, id_col, text_col, counted=[bytes(r.term) for r in distinct.collect()] if few else None)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    groups = max(1, math.ceil((asked.agg(F.sum("n")).first()[0] or 0) / group_terms))
    in_group = lambda g: F.pmod(F.xxhash64("item"), F.lit(groups)) == g
    found = None
    for g in range(groups if index.documents else 0):
        # bounded by the size of a group
        held = {r.item: r.words.encode() for r in texts.filter(in_group(g)).collect()}
        df = {bytes(r.term): r.df for r in index.counts.join(asked.filter(in_group(g)).select("term").distinct(), "term", "left_semi").collect()}
        made = make_query(held, df, index.documents, index.occurrences)
        if not made.terms:
            continue
        query = spark.sparkContext.broadcast(made)
        first = _ranked(best_bounds(index.blocks, query, k), k).select("doc_id").distinct()
        least = {r.item: r.score for r in rescored(plain, first, query, k).filter(F.col("rank") == k).select("item", "score").collect()}
        rows = common.staged(rescored(plain, reaching(index.blocks, query, least), query, k))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], _found_schema(docs.schema[id_col].dataType)).withColumn("rank", F.lit(0))
    named = items.select(F.col(item_col).alias("asked_id"), key.alias("item"))
    return named.join(found, "item").select(F.col("asked_id").alias(item_col), "rank", "doc_id", "score")
