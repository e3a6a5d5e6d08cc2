"""SimHash near-dedup: fingerprints linked at a few differing bits, found with vantage-point trees.

A fingerprint has a bit set where over half of the text's shingle hashes
have it. Two fingerprints within ``max_bits`` differ in at most half of
that in their low or in their high 32 bits, so each half gets a
vantage-point tree of its own with that smaller radius r:

* an inner node holds a vantage point and the median distance m to it;
  d <= m goes inside, the rest outside;
* every fingerprint has one home shard (leaf). By the triangle inequality
  two within r have distances to the vantage point within r, so only
  points with m - r < d <= m are sent outside as queries too, and queries
  follow every branch that m and r don't rule out;
* a shard compares its homes with each other and with its queries, again
  through a tree of its own, on all 64 bits, and returns a spanning forest
  of the links: at most one link per row, with the same components as all
  pairs.

Equal fingerprints are one point from the start, so copies cost nothing.

Cases: null text and text without words have fingerprint zero; a null id takes
part, but ``component_id`` is null only if no member has an id; repeated
rows share a component; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.llm import common
from cartwheel.llm.components import connected_components

SEED = 42
#: fingerprints whose medians shape a tree: 2 MB on the driver at most.
TREE_SAMPLE = 2**18
#: a tree has 2**MAX_DEPTH leaves at most: 80 KB to broadcast.
MAX_DEPTH = 14
#: home rows per shard that the depth aims at.
SHARD_ROWS = 4096
#: home rows below which a shard compares directly.
DIRECT_ROWS = 128


def fingerprint(text: bytes | None, shingle: int) -> int:
    """64-bit SimHash of ASCII-lower-cased words (split at ASCII white space) in ``shingle``-word shingles."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    join = b" ".join
    hashes = np.array([digest(join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)), strict=False)], "<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of ``hashes`` (little-endian uint64)."""
    n, block = len(hashes), 255  # counts of 255 rows fit a byte
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    full = n // block * block
    counts = bits[full:].sum(axis=0, dtype=np.int64)
    if full:
        counts += bits[:full].reshape(-1, block, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, fp) of every row; fp as a signed long."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def prints(batch: pa.RecordBatch) -> dict:
        values = [fingerprint(t, shingle) for t in common.text_bytes(batch.column(1))]
        return {"doc_id": batch.column(0), "fp": np.array(values, np.uint64).view(np.int64)}

    return common.map_batches(docs.select(id_col, text_col), schema, prints)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def grow_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and median distances of the inner nodes, in heap order."""
    rng = np.random.default_rng(SEED)
    points = np.zeros(2**depth - 1, sample.dtype)
    medians = np.full(2**depth - 1, sample.dtype.itemsize * 4, np.int64)
    members = {0: sample}
    for node in range(2**depth - 1):
        mine = members.pop(node)
        if len(mine):
            points[node] = mine[rng.integers(len(mine))]
            d = distance(mine, points[node])
            medians[node] = split_at(d)
            inside = d <= medians[node]
            members[2 * node + 1], members[2 * node + 2] = mine[inside], mine[~inside]
        else:
            members[2 * node + 1] = members[2 * node + 2] = mine
    return points, medians


def split_at(distances: np.ndarray) -> int:
    """The distance m whose split into d <= m and d > m is the most even."""
    below = np.cumsum(np.bincount(distances, minlength=65))
    return int(np.argmin(np.abs(2 * below - len(distances))))


def route(values: np.ndarray, points: np.ndarray, medians: np.ndarray, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, leaf, home) of every copy: one home each, and queries where a neighbour may live."""
    index, node, home = np.arange(len(values)), np.zeros(len(values), np.int64), np.ones(len(values), bool)
    for _ in range(depth):
        d, m = distance(values[index], points[node]).astype(np.int64), medians[node]
        inside = np.where(home, d <= m, d <= m + radius)
        outside = np.where(home, d > m, d > m - radius)
        crossing = home & inside & (d > m - radius)
        index, node, home = (
            np.concatenate([index[inside], index[outside], index[crossing]]),
            np.concatenate([2 * node[inside] + 1, 2 * node[outside] + 2, 2 * node[crossing] + 2]),
            np.concatenate([home[inside], home[outside], np.zeros(crossing.sum(), bool)]),
        )
    return index, node - (2**depth - 1), home


def hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the classes of each a[i] and b[i]; ``parent`` points every row at its root."""
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return parent
        a, b = a[open_], b[open_]
        np.minimum.at(parent, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def link_shard(prints: np.ndarray, home: np.ndarray, half: np.ndarray, max_bits: int) -> np.ndarray:
    """For each row of a shard the row that stands for its class of links (home-home and query-home)."""
    parent = np.arange(len(prints))
    rng = np.random.default_rng(SEED)
    radius = max_bits // 2
    stack = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while stack:
        homes, queries = stack.pop()
        if len(homes) > DIRECT_ROWS:
            chosen = homes[rng.integers(len(homes))]
            for values, r in ((half, radius), (prints, max_bits)):
                dh = distance(values[homes], values[chosen]).astype(np.int64)
                m = split_at(dh)
                inside = dh <= m
                if not inside.all() and inside.any():
                    dq = distance(values[queries], values[chosen]).astype(np.int64)
                    crossing = homes[inside & (dh > m - r)]
                    stack.append((homes[inside], queries[dq <= m + r]))
                    stack.append((homes[~inside], np.concatenate([queries[dq > m - r], crossing])))
                    break
            else:
                parent = compare(parent, prints, homes, queries, max_bits)
        elif len(homes):
            parent = compare(parent, prints, homes, queries, max_bits)
    return parent


def compare(parent: np.ndarray, prints: np.ndarray, homes: np.ndarray, queries: np.ndarray, max_bits: int) -> np.ndarray:
    """Direct comparison in blocks of bounded size."""
    others = np.concatenate([homes, queries])
    for i in range(0, len(homes), 256):
        mine = homes[i : i + 256]
        for j in range(0, len(others), 4096):
            theirs = others[j : j + 4096]
            near = distance(prints[mine][:, None], prints[theirs][None, :]) <= max_bits
            a, b = np.nonzero(near & (parent[mine][:, None] != parent[theirs][None, :]))
            if len(a):
                parent = hook(parent, mine[a], theirs[b])
    return parent


def near_links(points: DataFrame, max_bits: int) -> DataFrame:
    """``points`` (fp, distinct and staged) -> (a, b): links with the components of all pairs within ``max_bits``."""
    spark = points.sparkSession
    total = points.count()
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, total) / SHARD_ROWS))))
    # a uniform part of the points, by hash, bounded by TREE_SAMPLE: it shapes the tree and drops nothing
    share = min(1.0, TREE_SAMPLE / 2 / max(1, total))
    picked = points.filter(F.pmod(F.xxhash64("fp", F.lit("tree")), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000))).limit(TREE_SAMPLE)
    sample = np.sort(picked.toArrow().column("fp").to_numpy().astype(np.int64)).view(np.uint64)
    radius = max_bits // 2
    trees = spark.sparkContext.broadcast([grow_tree(halves(sample)[h], depth) for h in (0, 1)])

    def deal(batch: pa.RecordBatch) -> dict:
        prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = [route(values, *trees.value[h], depth, radius) for h, values in enumerate(halves(prints.view(np.uint64)))]
        return {
            "shard": np.concatenate([leaf * 2 + h for h, (_, leaf, _) in enumerate(parts)]).astype(np.int32),
            "fp": prints[np.concatenate([index for index, _, _ in parts])],
            "home": np.concatenate([home for _, _, home in parts]),
        }

    def search(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("fp").to_numpy(), kind="stable")
        signed = rows.column("fp").to_numpy()[order]
        prints, home = signed.view(np.uint64), rows.column("home").to_numpy()[order]
        parent = link_shard(prints, home, halves(prints)[key[0].as_py() % 2], max_bits)
        linked = np.flatnonzero(parent != np.arange(len(parent)))
        return pa.table({"a": pa.array(signed[linked]), "b": pa.array(signed[parent[linked]])})

    dealt = common.map_batches(points, "shard int, fp long, home boolean", deal)
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def halves(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (prints & np.uint64(0xFFFFFFFF)).astype(np.uint32), (prints >> np.uint64(32)).astype(np.uint32)


def components(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root, component_id) of each fingerprint in ``rows``; ``root`` tells components apart where ids repeat or are null."""
    points = common.staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = common.staged(connected_components(near_links(points.select("fp"), max_bits)))
    placed = common.staged(points.join(roots, points["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    ))
    # staged, so that Spark can split a large component in the join
    least = common.staged(placed.groupBy("root").agg(F.min("first_id").alias("component_id")))
    return placed.join(least, "root").select("fp", "root", "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (least id reachable over links)."""
    rows = common.staged(fingerprints(docs, id_col, text_col, shingle))
    return rows.join(components(rows, max_bits).drop("root"), "fp").select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, max_bits: int = 3, keep_null_ids: bool = True,
) -> DataFrame:
    """``docs`` with one row of each component: one with the least id, of several the one with the least digest of its text.

    Rows with a null id all stay, or, without ``keep_null_ids``, come after
    all ids: one stays of a component whose members have no id.
    """
    of, own, key, least_id, least_digest = common.unused(docs, "of", "own_digest", "key", "least_id", "least_digest")
    rows = common.staged(fingerprints(docs, id_col, text_col, shingle))
    named = common.staged(components(rows, max_bits))
    ids = rows.join(named, "fp").groupBy(F.col("doc_id").alias(of)).agg(F.every(F.col("doc_id") != F.col("component_id")).alias("gone"), F.count("*").alias("n"))
    # ids without a row to keep, and those whose rows must be told apart; the others have one row, which stays
    special = common.staged(ids.filter(F.col("gone") | (F.col("n") > 1) | F.col(of).isNull()))
    plain = docs.join(special.select(of), F.col(id_col) == F.col(of), "left_anti")
    several = special.filter(F.col(of).isNull() | ~F.col("gone"))
    if keep_null_ids:
        several = several.filter(F.col(of).isNotNull())
    else:
        plain = plain.filter(F.col(id_col).isNotNull())
    if several.isEmpty():
        return plain
    marked = docs.join(several.select(of), F.col(id_col).eqNullSafe(F.col(of)), "left_semi")
    marked = marked.withColumn(own, F.coalesce(F.sha2(F.col(text_col).cast("binary"), 256), F.lit("")))
    keyed = marked.select(F.struct(F.col(id_col).alias("id"), F.col(own).alias("digest")).alias(key), text_col)
    found = fingerprints(keyed, key, text_col, shingle).select("fp", "doc_id.id", "doc_id.digest").join(named, "fp")
    least = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root", "id").agg(F.min("digest").alias("digest"))
    least = common.staged(least.select(F.col("id").alias(least_id), F.col("digest").alias(least_digest)))
    chosen = marked.join(least, F.col(id_col).eqNullSafe(F.col(least_id)) & (F.col(own) == F.col(least_digest)), "left_semi")
    return plain.unionByName(chosen.dropDuplicates([id_col, own]).select(*docs.columns))
