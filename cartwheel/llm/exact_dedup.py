"""Exact dedup by an exchange of Golomb-coded fingerprints.

Texts are equal when identical after every run of ASCII white space became
one space; a null text counts as empty. The exchange finds the few rows
that can have an equal anywhere without moving any text:

1. each input partition hashes its texts (SHA-256; its first 64 bits are
   the fingerprint) and stages id and digest;
2. it sends every owner the sorted distinct fingerprints of the owner's
   range as Golomb-coded gaps;
3. the owner decodes all lists and answers each with a bitmap of those
   that another partition sent too;
4. rows with such a fingerprint, or one seen twice in their own partition,
   are suspects. Their texts, and those of a bounded bit table's false
   positives, are shuffled once per distinct text and map task and
   compared byte by byte.

Cases: null text = empty text = a text class of its own; null ids sort after all
ids, and ``keep_id`` is null only if no member has an id; of rows that
repeat id and text exactly one is kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.llm import common

#: log2 of the bits of the table that keeps non-suspect texts out of the shuffle (1 MB).
FILTER_BITS = 23
#: fingerprints per owner that the exchange aims at; 8 bytes each once decoded.
OWNER_ROWS = 2_000_000


def normalise(text: bytes | None) -> bytes:
    """Runs of ``[\\x20\\x09-\\x0D]`` as one space; ``bytes.split`` splits at exactly these."""
    if not text:
        return b""
    lead = b" " if text[:1].isspace() else b""
    words = text.split()
    if not words:
        return b" "
    return lead + b" ".join(words) + (b" " if text[-1:].isspace() else b"")


def digest(norm: bytes) -> bytes:
    return hashlib.sha256(norm).digest()


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 values as Golomb-coded gaps (power-of-two divisor).

    Layout: count (u4), divisor exponent (u1), bytes of the unary stream
    (u4), unary quotients, remainders.
    """
    n = len(values)
    if n == 0:
        return np.array([0], "<u4").tobytes() + b"\0" + np.array([0], "<u4").tobytes()
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    mean = int(values[-1]) // n
    k = max(0, min(63, mean.bit_length() - 1))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    remainders = ((gaps[:, None] >> shifts[None, :]) & np.uint64(1)).astype(np.uint8) if k else np.zeros((n, 0), np.uint8)
    head = np.packbits(unary).tobytes()
    return (
        np.array([n], "<u4").tobytes() + bytes([k]) + np.array([len(head)], "<u4").tobytes()
        + head + np.packbits(remainders.ravel()).tobytes()
    )


def golomb_decode(data: bytes) -> np.ndarray:
    n, k = int(np.frombuffer(data, "<u4", 1)[0]), data[4]
    if n == 0:
        return np.zeros(0, np.uint64)
    size = int(np.frombuffer(data, "<u4", 1, 5)[0])
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, 9)))[:n]
    gaps = (np.diff(ones, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -1, 9 + size))[: n * k].reshape(n, k)
        for b in range(k):
            gaps |= bits[:, b].astype(np.uint64) << np.uint64(k - 1 - b)
    return np.cumsum(gaps, dtype=np.uint64)


def signatures(docs: DataFrame, id_col: str, text_col: str, hashed: Callable[[bytes], bytes]) -> DataFrame:
    """(part, row, doc_id, digest) of every row; ``part`` is the input partition."""
    schema = T.StructType.fromDDL("part int, row long, digest binary").add("doc_id", docs.schema[id_col].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, part, row = common.arrow_schema(schema), TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            out = [hashed(normalise(t)) for t in common.text_bytes(batch.column(1))]
            yield common.record_batch(
                {"part": np.full(n, part, np.int32), "row": np.arange(row, row + n), "digest": out, "doc_id": batch.column(0)}, kinds
            )
            row += n

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def fingerprints(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8].ljust(8, b"\0") for d in digests), ">u8").astype(np.uint64)


def owner_edges(owners: int) -> np.ndarray:
    return np.array([(o << 64) // owners for o in range(owners)], dtype=np.uint64)


def messages(rows: DataFrame, owners: int) -> DataFrame:
    """Golomb-coded fingerprints of each input partition for each owner."""

    def encode(key: tuple, part_rows: pa.Table) -> pa.Table:
        prints = np.unique(fingerprints(part_rows.column("digest").to_pylist()))
        cuts = np.append(np.searchsorted(prints, owner_edges(owners)), len(prints))
        sent = [o for o in range(owners) if cuts[o + 1] > cuts[o]]
        return pa.table(
            {
                "owner": pa.array(sent, pa.int32()),
                "part": pa.array([key[0].as_py()] * len(sent), pa.int32()),
                "payload": pa.array([golomb_encode(prints[cuts[o] : cuts[o + 1]]) for o in sent], pa.binary()),
            }
        )

    return rows.select("part", "digest").groupBy("part").applyInArrow(encode, "owner int, part int, payload binary")


def answers(sent: DataFrame) -> DataFrame:
    """Each owner's reply to each partition: a bit per fingerprint it sent, set where another sent it too."""

    def reply(key: tuple, lists: pa.Table) -> pa.Table:
        parts, decoded = lists.column("part").to_pylist(), [golomb_decode(p) for p in lists.column("payload").to_pylist()]
        values, counts = np.unique(np.concatenate(decoded), return_counts=True)
        shared = values[counts > 1]
        marks = [np.packbits(np.isin(d, shared, assume_unique=True)).tobytes() for d in decoded]
        return pa.table(
            {"part": pa.array(parts, pa.int32()), "owner": pa.array([key[0].as_py()] * len(parts), pa.int32()), "bitmap": pa.array(marks, pa.binary())}
        )

    return sent.groupBy("owner").applyInArrow(reply, "part int, owner int, bitmap binary")


def mark_suspects(rows: DataFrame, replies: DataFrame, owners: int) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, T.StructField("suspect", T.BooleanType())])

    def mark(key: tuple, mine: pa.Table, bitmaps: pa.Table) -> pa.Table:
        prints, inverse, counts = np.unique(fingerprints(mine.column("digest").to_pylist()), return_inverse=True, return_counts=True)
        cuts = np.append(np.searchsorted(prints, owner_edges(owners)), len(prints))
        flags = counts > 1
        for owner, bitmap in zip(bitmaps.column("owner").to_pylist(), bitmaps.column("bitmap").to_pylist(), strict=True):
            low, high = cuts[owner], cuts[owner + 1]
            flags[low:high] |= np.unpackbits(np.frombuffer(bitmap, np.uint8))[: high - low].astype(bool)
        out = {c: mine.column(c) for c in mine.column_names}
        out["suspect"] = pa.array(flags[inverse]) if len(inverse) else pa.array([], pa.bool_())
        return pa.table([out[f.name].cast(f.type) for f in common.arrow_schema(schema)], schema=common.arrow_schema(schema))

    return rows.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(mark, schema)


def suspect_table(suspects: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value of the top ``bits`` fingerprint bits that some suspect has: 2**bits / 8 bytes at most."""
    top = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    slot = F.shiftright(top, 32 - bits)
    words = (
        suspects.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 5).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("mask"))
        .toArrow()
    )
    table = np.zeros(max(1, 2**bits // 32), "<u4")
    table[words.column("word").to_numpy()] = words.column("mask").to_numpy().astype(np.uint64).astype(np.uint32)
    return table


def classes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with equal ``keys`` as one class: keep_id, group_size, kept."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "part", "row")).alias("first")
    # staged, so that both sides of the join come from plain shuffles and Spark can split a hot class
    groups = common.staged(rows.groupBy(*keys).agg(first, F.count("*").alias("group_size")))
    return rows.join(groups, keys).select(
        "doc_id", "digest", F.col("first.doc_id").alias("keep_id"), "group_size",
        ((F.col("part") == F.col("first.part")) & (F.col("row") == F.col("first.row"))).alias("kept"),
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    hashed: Callable[[bytes], bytes] = digest, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest (of the normalised text).

    ``hashed`` may be any function to bytes: rows whose digests agree but
    whose texts differ are told apart by the byte comparison.
    """
    rows = common.staged(signatures(docs, id_col, text_col, hashed))
    total = rows.count()
    owners = max(1, min(common.shuffle_width(docs.sparkSession), 1 + total // 1000), 1 + total // OWNER_ROWS)
    marked = common.staged(mark_suspects(rows, answers(messages(rows, owners)), owners))
    suspects = marked.filter("suspect")
    table = docs.sparkSession.sparkContext.broadcast(suspect_table(suspects, filter_bits))

    def passing(texts: Iterable[bytes | None]) -> Iterator[tuple[int, bytes, bytes]]:
        for i, text in enumerate(texts):
            norm = normalise(text)
            sign = hashed(norm)
            slot = int.from_bytes(sign[:4].ljust(4, b"\0"), "big") >> (32 - filter_bits)
            if (table.value[slot >> 5] >> (slot & 31)) & 1:
                yield i, sign, norm

    def suspect_texts(batch: pa.RecordBatch) -> dict:
        hits = list(passing(common.text_bytes(batch.column(0))))
        return {"digest": [h[1] for h in hits], "norm": [h[2] for h in hits]}

    texts = common.map_batches(docs.select(text_col), "digest binary, norm binary", suspect_texts)
    distinct = texts.groupBy("digest", "norm").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("variants"))
    clashing = common.staged(distinct.filter("variants > 1").select("digest"))
    single = marked.filter("not suspect").select(
        "doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    if clashing.isEmpty():  # always so with SHA-256; then a digest stands for its text
        return single.unionByName(classes(suspects, ["digest"]))

    schema = T.StructType.fromDDL("part int, row long, digest binary, norm binary").add("doc_id", docs.schema[id_col].dataType)

    def with_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, part, row = common.arrow_schema(schema), TaskContext.get().partitionId(), 0
        for batch in batches:
            hits = list(passing(common.text_bytes(batch.column(1))))
            at = [h[0] for h in hits]
            yield common.record_batch(
                {"part": np.full(len(at), part, np.int32), "row": np.array(at, np.int64) + row, "digest": [h[1] for h in hits],
                 "norm": [h[2] for h in hits], "doc_id": batch.column(0).take(pa.array(at, pa.int64()))}, kinds
            )
            row += batch.num_rows

    again = docs.select(id_col, text_col).mapInArrow(with_texts, schema).join(clashing, "digest", "left_semi")
    told = suspects.join(clashing, "digest", "left_anti")
    return single.unionByName(classes(told, ["digest"])).unionByName(classes(common.staged(again), ["digest", "norm"]))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    Dropped ids go by an anti join; rows that repeat an id are then cut to
    one per text.
    """
    kept_id, kept_digest, own = common.unused(docs, "kept_id", "kept_digest", "own_digest")
    verdict = exact_dedup(docs, id_col, text_col).select("doc_id", "kept", "digest")
    kept = common.staged(verdict.filter("kept").select(F.col("doc_id").alias(kept_id), F.col("digest").alias(kept_digest)).distinct())
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    marked = docs.withColumn(own, F.sha2(norm.cast("binary"), 256))
    same = F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(own) == F.lower(F.hex(kept_digest)))
    return marked.join(kept, same, "left_semi").dropDuplicates([id_col, own]).select(*docs.columns)
