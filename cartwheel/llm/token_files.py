"""Token files: raw ids in shards, with a minimal-perfect-hash index from document key to shard position.

``write`` lays documents out in ascending key order:

* ``tokens-<shard>.bin``: 8 bytes magic; ids of all documents, little-endian,
  2 or 4 bytes each; n + 1 offsets (u8, in ids) of the n documents; trailer
  of documents (u8), ids (u8), bytes per id (u8).
* ``index-<bucket>.bin``: keys of one hash bucket. A cascade of bit arrays
  is a minimal perfect hash: a key's slot is the rank of its first set bit.
  Each slot stores the key's 64-bit fingerprint, its shard, the number of
  its first document there and how many documents have that key.

A lookup reads one bucket, then two offsets and the ids of the document:
constant time, whatever the size of the corpus. Files are written under
a name of the attempt and moved into place, so a repeated task replaces
its own file with an equal one. The folder must be one that all executors
reach; any file system that ``pyarrow.fs`` knows will do.

Cases: a null text is the end id alone; null keys come first and are looked up as
one key; rows that repeat a key are adjacent, in text order, under one
slot; an empty table gives no files and no rows. Keys are integers.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwheel.llm import common, tokens

MAGIC = b"CWTOKEN1"
#: keys per index bucket that the number of buckets aims at.
BUCKET_KEYS = 65_536
#: bits per key and level of the hash cascade, and its levels; keys left after them are listed.
GAMMA, LEVELS = 2.0, 32
CHUNK_IDS = 1 << 20


class Files(NamedTuple):
    folder: str
    buckets: int
    shards: DataFrame  # shard, documents, n_ids
    keys: DataFrame  # key, one row each


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def put(folder: str, name: str, parts: Iterable[bytes]) -> None:
    """Writes a file whole or not at all."""
    where, path = open_folder(folder)
    where.create_dir(path, recursive=True)
    attempt = f"{path}/_{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(attempt) as out:
        for part in parts:
            out.write(part)
    where.move(attempt, f"{path}/{name}")


# -- minimal perfect hash -------------------------------------------------


def mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A bijection of 64-bit keys per level (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys -> 0..n-1, each number once."""

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        counts = np.bitwise_count(bits).astype(np.int64)
        self.ranks = np.cumsum(counts) - counts
        self.ranked = int(counts.sum())
        self.starts = np.cumsum([0, *sizes])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, levels = keys.astype(np.uint64), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, math.ceil(GAMMA * len(left) / 64) * 64)
            slots = (mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slots, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[slots]]
        bits = np.concatenate(levels) if levels else np.zeros(0, "<u8")
        return cls(sizes, bits, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot per key; a key it was not built for gets any slot, or -1."""
        keys = keys.astype(np.uint64)
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            place = self.starts[level] + (mix(keys[todo], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.bits[place >> 6], (place & 63).astype(np.uint64)
            hit = ((word >> bit) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = (self.ranks[place >> 6] + below)[hit]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            listed = self.rest[at] == keys[todo]
            out[todo[listed]] = self.ranked + at[listed]
        return out


#: marks the null key's entry in its bucket
NULL_ENTRY = np.dtype([("there", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("count", "<u4")])
SLOT = np.dtype([("fingerprint", "<u8"), ("shard", "<u4"), ("first", "<u8"), ("count", "<u4")])


def index_bytes(keys: np.ndarray, shard: np.ndarray, first: np.ndarray, count: np.ndarray, null: tuple[int, int, int] | None) -> bytes:
    hashed = PerfectHash.build(keys)
    slots = np.zeros(len(keys), SLOT)
    at = hashed.slots(keys)
    for name, values in (("fingerprint", mix(keys, LEVELS)), ("shard", shard), ("first", first), ("count", count)):
        slots[name][at] = values
    head = np.array([len(hashed.sizes), len(hashed.bits), len(hashed.rest), len(keys)], "<u8")
    entry = np.array([(1, *null) if null else (0, 0, 0, 0)], NULL_ENTRY)
    return b"".join(x.tobytes() for x in (head, entry, np.array(hashed.sizes, "<u8"), hashed.bits, hashed.rest.astype("<u8"), slots))


class Index:
    """One index bucket, read back."""

    def __init__(self, data: bytes):
        levels, words, rest, n = (int(x) for x in np.frombuffer(data, "<u8", 4))
        at = 32
        self.null = np.frombuffer(data, NULL_ENTRY, 1, at)[0]
        at += NULL_ENTRY.itemsize
        sizes = np.frombuffer(data, "<u8", levels, at)
        at += 8 * levels
        bits = np.frombuffer(data, "<u8", words, at)
        at += 8 * words
        self.hash = PerfectHash([int(s) for s in sizes], bits, np.frombuffer(data, "<u8", rest, at))
        self.slots = np.frombuffer(data, SLOT, n, at + 8 * rest)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, entry) per key: unknown keys fail the fingerprint."""
        if not len(self.slots):
            return np.zeros(len(keys), bool), np.zeros(len(keys), SLOT)
        at = self.hash.slots(keys)
        entry = self.slots[np.maximum(at, 0)]
        return (at >= 0) & (entry["fingerprint"] == mix(keys, LEVELS)), entry


def bucket_of(key: str, buckets: int) -> F.Column:
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(buckets)).cast("int"))


# -- writing and reading ----------------------------------------------------


def write(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 0) -> Files:
    """Encodes ``docs`` into ``folder`` (a new one) and returns what is needed to read it."""
    spark = docs.sparkSession
    width = common.shuffle_width(spark)
    keyed = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.col("text").asc_nulls_first()]
    laid_out = keyed.repartitionByRange(width, F.col("key").asc_nulls_first()).sortWithinPartitions(*order)

    def shard_file(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder = TaskContext.get().partitionId(), tokens.encoder(vocabulary)
        end = np.array([end_id], encoder.dtype).tobytes()
        keys, firsts, counts, lengths = [], [], [], []

        def payload() -> Iterator[bytes]:
            yield MAGIC
            for batch in tokens.gathered(batches, 1):
                for key, ids in zip(batch.column(0).to_pylist(), encoder.all_ids(batch.column(1)), strict=True):
                    ids += end
                    if keys and keys[-1] == key:
                        counts[-1] += 1
                    else:
                        keys.append(key)
                        firsts.append(len(lengths))
                        counts.append(1)
                    lengths.append(len(ids) // encoder.dtype.itemsize)
                    yield ids
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
            yield offsets.tobytes()
            yield np.array([len(lengths), offsets[-1], encoder.dtype.itemsize], "<u8").tobytes()

        first = next(batches, None)
        if first is None:
            return
        batches = _chain(first, batches)
        put(folder, f"tokens-{shard:05d}.bin", payload())
        n = len(keys)
        yield pa.RecordBatch.from_pydict(
            {"key": pa.array(keys, pa.int64()), "shard": pa.array([shard] * n, pa.int32()), "first": pa.array(firsts, pa.int64()),
             "count": pa.array(counts, pa.int64()), "n_ids": pa.array([sum(lengths[f : f + c]) for f, c in zip(firsts, counts, strict=True)], pa.int64())}
        )

    entries = common.staged(laid_out.mapInArrow(shard_file, "key long, shard int, first long, count long, n_ids long"))
    buckets = max(1, math.ceil(entries.count() / BUCKET_KEYS))

    def index_file(key: tuple, rows: pa.Table) -> pa.Table:
        bucket, ids = key[0].as_py(), rows.column("key")
        there = np.asarray(ids.is_valid())
        columns = [rows.column(c).to_numpy() for c in ("shard", "first", "count")]
        null = tuple(int(c[~there][0]) for c in columns) if (~there).any() else None
        keys = ids.drop_null().to_numpy().astype(np.int64).view(np.uint64)
        put(folder, f"index-{bucket:05d}.bin", [index_bytes(keys, *(c[there] for c in columns), null)])
        return pa.table({"bucket": pa.array([bucket], pa.int32())})

    done = entries.withColumn("bucket", bucket_of("key", buckets)).groupBy("bucket").applyInArrow(index_file, "bucket int")
    done.agg(F.count("*")).first()  # the index is written when this returns
    shards = entries.groupBy("shard").agg(F.sum("count").alias("documents"), F.sum("n_ids").alias("n_ids"))
    return Files(folder, buckets, shards, entries.select("key"))


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def read(files: Files, keys: DataFrame) -> DataFrame:
    """The documents of ``keys`` (column key) from the files alone: key, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before; the checksum is
    over the ids as little-endian u4. Unknown keys give no row.
    """
    folder, buckets = files.folder, files.buckets

    def look_up(key: tuple, rows: pa.Table) -> pa.Table:
        where, path = open_folder(folder)
        with where.open_input_stream(f"{path}/index-{key[0].as_py():05d}.bin") as f:
            index = Index(f.read())
        asked = rows.column("key").unique()
        some = asked.drop_null().to_numpy().astype(np.int64)
        found, entry = index.find(some.view(np.uint64))
        null = [index.null] if asked.null_count and index.null["there"] else []
        return pa.table(
            {"key": pa.array([None] * len(null) + some[found].tolist(), pa.int64())}
            | {c: pa.array([int(e[c]) for e in null] + entry[c][found].tolist(), pa.int64()) for c in ("shard", "first", "count")}
        )

    def fetch(key: tuple, rows: pa.Table) -> pa.Table:
        where, path = open_folder(folder)
        shard = key[0].as_py()
        out: dict[str, list] = {"key": [], "at": [], "n_tokens": [], "ids_crc32": []}
        with where.open_input_file(f"{path}/tokens-{shard:05d}.bin") as f:
            size = f.size()
            documents, _, width = (int(x) for x in np.frombuffer(f.read_at(24, size - 24), "<u8"))
            table = size - 24 - 8 * (documents + 1)
            for k, first, count in zip(*(rows.column(c).to_pylist() for c in ("key", "first", "count")), strict=True):
                offsets = np.frombuffer(f.read_at(8 * (count + 1), table + 8 * first), "<u8").astype(np.int64)
                for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    crc = 0
                    for at in range(low, high, CHUNK_IDS):
                        ids = np.frombuffer(f.read_at((min(high, at + CHUNK_IDS) - at) * width, len(MAGIC) + at * width), f"<u{width}")
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                    for name, value in (("key", k), ("at", low), ("n_tokens", high - low), ("ids_crc32", crc)):
                        out[name].append(value)
        return pa.table({"shard": pa.array([shard] * len(out["key"]), pa.int32())} | {c: pa.array(v, pa.int64()) for c, v in out.items()})

    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    bases = files.shards.select("shard", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("base"))
    placed = keys.select("key").withColumn("bucket", bucket_of("key", buckets)).groupBy("bucket").applyInArrow(
        look_up, "key long, shard long, first long, count long"
    )
    found = placed.groupBy("shard").applyInArrow(fetch, "shard int, key long, at long, n_tokens long, ids_crc32 long")
    return found.join(bases, "shard").select("key", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
