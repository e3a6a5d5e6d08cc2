"""Removal of long repeated strings, by suffix sorting in shards.

A byte goes if a string of ``window`` bytes that covers it also starts
anywhere else, in the same document or another. Which windows repeat is
read from suffix orders with common prefixes (``induced``): a window
repeats exactly where a suffix shares ``window`` bytes with a neighbour.

The corpus is dealt to shards so that equal windows meet. The key of a
window is the least hash among its 64-byte strings, so equal windows have
equal keys, and runs of some 70 windows share one. Then:

1. texts are written in blocks. A slice is the bytes of a run of windows
   with one key; each block gives its distinct (key, slice digest);
2. keys that occur once in the corpus belong to windows that occur once.
   A key with one slice, several times, belongs to windows that all repeat
   (a window is in its slice only once). Only slices of the other keys,
   which have several, can share a part, and need their bytes compared;
3. each of those slices is given by one block to the shard of its key, with
   its number of copies;
4. a shard takes its slices by key. All windows of a slice hold the 64 bytes
   with its key, so only suffixes at one distance from them can share a
   window: those at the 64 bytes are sorted, the order of those further left
   is induced from it byte by byte, with common prefixes. The slices of a key
   too large for memory are written in a row and their suffixes sorted by
   external induced sorting, in bounded memory whatever their size;
5. each block gets back which bytes of its slices repeat, and gives its
   documents without them.

Slices with one key are told apart by a 64-bit digest (XXH3).

Nothing but counts reaches the driver and nothing is broadcast; all that
goes by key or slice is aggregated before it is shuffled, so a passage that
a third of all documents hold is one slice in its shard.

Cases: a null text has no bytes, like an empty one; texts shorter than the
window keep all; the repeated rows of one document are repeats of each
other; a null id is carried as null; an empty table gives no rows.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.llm import common, induced
from cartwheel.session import checkpoint_dir

WINDOW = 200
#: bytes of the strings whose least hash is a window's key.
GRAM = 64
#: bytes of text in a block and in a shard, about; both only size the work.
BLOCK_BYTES, SHARD_BYTES = 2 << 20, 2 << 20
#: bytes a task's suffix sorter holds of an array or queue before it uses files.
SORT_MEMORY = 1 << 26
#: windows looked at together.
STRETCH = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
#: masks of the first 0 to 8 bytes of a big-endian word.
_FIRST_BYTES = np.array([2**64 - (1 << 64 - 8 * k) for k in range(9)], np.uint64)


@lru_cache(4)
def _all_powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers; lengths are rounded up so that few tables are kept."""
    return _all_powers(base, max(STRETCH, 1 << (n - 1).bit_length()))[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position on."""
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
        x = (sums[gram:] - sums[:-gram]) * _powers(_BASE_INVERSE, n)[: n - gram + 1]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the (first) least of the top 40 bits in every ``width`` values."""
    n, places = len(values), np.uint64((1 << 24) - 1)
    keyed = (values & ~places) | np.arange(n, dtype=np.uint64)
    rows = np.concatenate([keyed, np.full(-n % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (least & places).astype(np.int64)


def runs(data: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, key) of the runs of windows with one key place; no window crosses an end."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none
    hashes = gram_hashes(data, gram)
    place = sliding_argmin(hashes, window - gram + 1)
    whole = np.ones(len(place), bool)
    for end in ends.tolist():
        whole[max(0, end - window + 1) : end] = False
    change = place[1:] != place[:-1]
    opens, closes = whole.copy(), whole.copy()
    opens[1:] &= change | ~whole[:-1]
    closes[:-1] &= change | ~whole[1:]
    first = np.flatnonzero(opens)
    return first, np.flatnonzero(closes), hashes[place[first]].view(np.int64)


def stretches(sizes: list[int], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (document, from, to) that cover every window once, each group of bounded bytes."""
    group, held = [], 0
    for number, size in enumerate(sizes):
        for start in range(0, max(0, size - window + 1), STRETCH):
            stop = min(size, start + STRETCH + window - 1)
            group.append((number, start, stop))
            held += stop - start
            if held >= STRETCH:
                yield group
                group, held = [], 0
    if group:
        yield group


def block_runs(body: bytes, sizes: list[int], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, bytes, key, digest) of the slices of a block, in order."""
    at, found = np.cumsum([0, *sizes]).tolist(), []
    for group in stretches(sizes, window):
        joined = np.frombuffer(b"".join([body[at[n] + a : at[n] + b] for n, a, b in group]), np.uint8)
        lengths = np.array([b - a for _, a, b in group])
        ends = np.cumsum(lengths)
        first, last, key = runs(joined, ends, window, gram)
        shift = np.array([at[n] + a for n, a, _ in group]) - (ends - lengths)
        found.append((first + shift[np.searchsorted(ends, first, side="right")], last - first + window, key))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    start, size, key = map(np.concatenate, zip(*found, strict=True))
    view = memoryview(body)
    digests = (xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), (start + size).tolist(), strict=True))
    return start, size, key, np.fromiter(digests, np.uint64, len(start)).view(np.int64)


# -- blocks ------------------------------------------------------------------


def _blocks(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, block_bytes: int) -> DataFrame:
    """One row per block (key is null), and one per distinct slice of a block."""
    schema = T.StructType.fromDDL("block long, sizes array<long>, body binary, key long, digest long, times int")
    schema = schema.add("doc_ids", T.ArrayType(docs.schema[id_col].dataType))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, block = common.arrow_schema(schema), TaskContext.get().partitionId() << 24
        ids, texts, held = [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            body, sizes = b"".join(texts), list(map(len, texts))
            yield common.record_batch(
                {"block": [block], "sizes": [sizes], "body": [pack(body)], "key": [None], "digest": [None], "times": [None], "doc_ids": [ids]}, kinds
            )
            _, _, key, digest = block_runs(body, sizes, window, gram)
            order = np.lexsort((digest, key))
            key, digest = key[order], digest[order]
            first = np.flatnonzero(induced.starts_of(key) | induced.starts_of(digest))
            n, times = len(first), np.diff(np.append(first, len(key)))
            yield common.record_batch(
                {"block": np.full(n, block), "key": key[first], "digest": digest[first], "times": np.minimum(times, 2).astype(np.int32)}
                | dict.fromkeys(("sizes", "body", "doc_ids"), [None] * n), kinds
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), common.text_bytes(batch.column(1)), strict=True):
                ids.append(doc_id)
                texts.append(text or b"")
                held += len(texts[-1])
                if held >= block_bytes:
                    yield from close()
                    ids, texts, held, block = [], [], 0, block + 1
        if ids:
            yield from close()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack(body: bytes) -> bytes:
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _slices(blocks: DataFrame, wanted: DataFrame, window: int, gram: int) -> DataFrame:
    """The bytes of the ``wanted`` slices (block, key, digest, copies), each cut from its block."""
    schema = T.StructType.fromDDL("key long, digest long, slice binary, copies int")

    def cut(group: tuple, texts: pa.Table, slices: pa.Table) -> pa.Table:
        kinds = common.arrow_schema(schema)
        rows: dict[str, list] = {f.name: [] for f in schema}
        if texts.num_rows and slices.num_rows:
            body = unpack(texts.column("body")[0].as_py())
            copies = dict(zip(_names(slices), slices.column("copies").to_pylist(), strict=True))
            start, size, key, digest = (x.tolist() for x in block_runs(body, texts.column("sizes")[0].as_py(), window, gram))
            for a, n, *name in zip(start, size, key, digest, strict=True):
                many = copies.pop(tuple(name), 0)
                if many:
                    _add(rows, key=name[0], digest=name[1], slice=body[a : a + n], copies=many)
        return pa.table([pa.array(rows[f.name], f.type) for f in kinds], schema=kinds)

    texts = blocks.select(F.col("block").alias("of"), "sizes", "body")
    return texts.groupBy("of").cogroup(wanted.groupBy("block")).applyInArrow(cut, schema)


def _names(slices: pa.Table) -> list[tuple[int, int]]:
    return list(zip(slices.column("key").to_pylist(), slices.column("digest").to_pylist(), strict=True))


def _add(rows: dict[str, list], **values) -> None:
    for name, column in rows.items():
        column.append(values.get(name))


# -- shards ------------------------------------------------------------------


def scratch_root(spark: SparkSession) -> str | None:
    """Where the sorter's files go: the shared folder where it is mounted, else where Spark itself spills."""
    shared = checkpoint_dir(spark)
    return shared.removeprefix("file://") if shared.startswith(("/", "file:///")) else None


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Where in ``data`` the string lies whose hash is the key of each slice: in all its windows, at the first such place."""
    out = np.empty(len(starts), np.int64)
    part = (starts - starts[0]) // STRETCH
    cuts = [*np.flatnonzero(induced.starts_of(part)).tolist(), len(starts)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        low, reach = starts[a:b] - starts[a], window - gram + 1
        hashes = gram_hashes(data[starts[a] : starts[b - 1] + sizes[b - 1]], gram)
        of = np.repeat(np.arange(b - a), np.minimum(sizes[a:b] - gram + 1, reach))
        many = np.bincount(of, minlength=b - a)
        at = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + low[of]
        found = np.flatnonzero(hashes[at].view(np.int64) == keys[a:b][of])[::-1]
        out[a:b][of[found]] = at[found] + starts[a]  # the first place is written last
    return out


def sorted_anchors(data: np.ndarray, anchor: np.ndarray, right: np.ndarray, group: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at the anchors inside their groups, and each one's common prefix with the one before, up to ``window``.

    A suffix counts as followed by zeros behind its ``right`` bytes.
    """
    n = len(anchor)
    order, head, prefix = np.arange(n), induced.starts_of(group), np.full(n, window, np.int64)
    prefix[head] = 0
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    todo = np.arange(n)
    for offset in range(0, window, 8):
        sizes = np.diff(np.append(np.flatnonzero(head), n))
        todo = todo[np.repeat(sizes, sizes)[todo] > 1]
        if not len(todo):
            break
        k = order[todo]
        inside = np.clip(right[k] - offset, 0, 8)
        word = words[np.where(inside > 0, anchor[k] + offset, 0)].astype(np.uint64)
        word &= _FIRST_BYTES[inside]
        run = np.cumsum(head[todo])
        inner = ~head[todo][1:]
        if not np.any((word[1:] != word[:-1]) & inner):
            continue
        by = np.lexsort((word, run))
        order[todo], word = k[by], word[by]
        split = 1 + np.flatnonzero((word[1:] != word[:-1]) & inner)
        differ, equal = word[split] ^ word[split - 1], np.zeros(len(split), np.int64)
        for count in range(1, 8):
            equal += differ >> np.uint64(64 - 8 * count) == 0
        head[todo[split]] = True
        prefix[todo[split]] = np.minimum(offset + equal, window)
    return order, prefix


def repeated_windows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Where in ``data`` a window starts that another slice of the same key holds too; slices of one key are in a row.

    All windows of a slice hold its anchor, the string with the key, and
    equal windows hold it at the same distance. So only suffixes at one
    distance from their anchors are compared: those at the anchors are
    sorted, and the order of those one byte further left is induced from it
    by a stable sort by that byte. Two neighbours there share one byte more
    than the least on the way from the one to the other.
    """
    again = np.zeros(len(data), bool)
    anchor, group = anchors(data, starts, sizes, keys, window, gram), np.cumsum(induced.starts_of(keys))
    left, right = anchor - starts, starts + sizes - anchor
    order, prefix = sorted_anchors(data, anchor, right, group, window)
    for distance in range(window - gram + 1):
        # windows of one class are equal, zeros behind the slices included
        if np.any(prefix >= window):
            same = np.cumsum(prefix < window)
            whole = right[order] >= window - distance
            several = np.bincount(same[whole], minlength=same[-1] + 1) > 1
            again[anchor[order[whole & several[same]]] - distance] = True
        # those whose slice goes on to the left, and that can still come to share a window
        most = prefix.copy()
        np.maximum(most[:-1], prefix[1:], out=most[:-1])
        more = left[order] - distance
        stay = np.flatnonzero((more > 0) & (most + more >= window))
        if len(stay) < 2:
            break
        least = np.zeros(len(stay), np.int64)
        least[1:] = np.minimum.reduceat(prefix[: stay[-1] + 1], stay[:-1] + 1)
        order = order[stay]
        symbol = group[order] << 8 | data[anchor[order] - distance - 1]
        by = np.argsort(symbol, kind="stable")
        order, symbol = order[by], symbol[by]
        pair = 1 + np.flatnonzero(symbol[1:] == symbol[:-1])
        prefix = np.zeros(len(order), np.int64)
        prefix[pair] = 1 + induced.range_min(least, by[pair - 1] + 1, by[pair])
    return again


def repeated_spans(slices: Iterable[tuple], window: int, gram: int, folder: str, memory: int) -> Iterator[tuple]:
    """(key, digest, starts, ends) of the bytes that lie in repeated windows, per (key, digest, slice, copies) with any.

    The slices come by key. Keys are taken together up to half of ``memory``
    bytes; the slices of a larger key are sorted in files.
    """
    held, size = [], 0
    for _, group in groupby(slices, itemgetter(0)):
        mine, own = [], 0
        for row in group:
            mine.append(row)
            own += len(row[2])
            if 2 * own > memory:
                yield from _spans_by_files(chain(mine, group), window, folder, memory)
                mine, own = [], 0
        if held and 2 * (size + own) > memory:
            yield from _spans_in_memory(held, window, gram)
            held, size = [], 0
        held += mine
        size += own
    if held:
        yield from _spans_in_memory(held, window, gram)


def _spans_in_memory(slices: list[tuple], window: int, gram: int) -> Iterator[tuple]:
    sizes = np.array([len(row[2]) for row in slices])
    starts = np.cumsum(sizes + 1) - sizes - 1  # one byte between them
    data = np.frombuffer(b"\0".join([*[row[2] for row in slices], bytes(window + 8)]), np.uint8)
    again = repeated_windows(data, starts, sizes, np.array([row[0] for row in slices], np.int64), window, gram)
    for i in np.flatnonzero(np.array([row[3] for row in slices]) > 1).tolist():
        again[starts[i] : starts[i] + sizes[i] - window + 1] = True
    edges = np.flatnonzero(again[1:] != again[:-1]) + 1
    if again[0]:
        edges = np.append(0, edges)
    low, high = edges[::2], edges[1::2] - 1 + window
    of = np.searchsorted(starts, low, side="right") - 1
    low, high, first = (low - starts[of]).tolist(), (high - starts[of]).tolist(), np.flatnonzero(induced.starts_of(of))
    for i, a, b in zip(of[first].tolist(), first.tolist(), np.append(first, len(of))[1:].tolist(), strict=True):
        yield slices[i][0], slices[i][1], low[a:b], high[a:b]


def _spans_by_files(slices: Iterable[tuple], window: int, folder: str, memory: int) -> Iterator[tuple]:
    """The slices are written in a row, 1 between them and 0 at the end. Each
    suffix stands for as many as its slice has copies; a window is repeated
    if a neighbour in suffix order shares ``window`` bytes, or a copy does.
    """
    path, starts, sizes, names, many, n = os.path.join(folder, "slices.bin"), [], [], [], [], 0
    with open(path, "wb") as out:
        for key, digest, piece, copies in slices:
            starts.append(n)
            sizes.append(len(piece))
            names.append((key, digest))
            many.append(copies > 1)
            symbols = np.ones(len(piece) + 1, np.uint16)
            symbols[:-1] = np.frombuffer(piece, np.uint8)
            symbols[:-1] += 2
            out.write(symbols.tobytes())
            n += len(symbols)
        out.write(np.zeros(1, np.uint16).tobytes())
    scratch = induced.Scratch(folder, memory)
    text = np.fromfile(path, np.uint16) if 2 * n <= memory else np.memmap(path, np.uint16, "r")
    again = scratch.empty(n + 1, bool)
    again[:] = False
    for start, size, copied in zip(starts, sizes, many, strict=True):
        again[start : start + size - window + 1] = copied
    before = np.zeros(0, np.int64)
    for positions, common_prefix in induced.descending(text, scratch, window):
        long_ = common_prefix >= window
        again[positions[long_]] = True
        again[np.append(before, positions[:-1])[long_ if len(before) else long_[1:]]] = True
        before = positions[-1:]
    for name, start, size in zip(names, starts, sizes, strict=True):
        mine = again[start : start + size - window + 1]
        if mine.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
            yield *name, edges[::2].tolist(), (edges[1::2] - 1 + window).tolist()


def _repeats(slices: DataFrame, shards: int, window: int, gram: int, root: str | None, memory: int) -> DataFrame:
    """(key, digest, starts, ends) of every slice with repeated windows."""
    schema = T.StructType.fromDDL("key long, digest long, starts array<int>, ends array<int>")

    def sort_shard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = common.arrow_schema(schema)
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
        where = root or os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        with tempfile.TemporaryDirectory(prefix="suffixes-", dir=where) as folder:
            out: list[tuple] = []
            for row in repeated_spans(rows, window, gram, folder, memory):
                out.append(row)
                if len(out) == 1000:
                    yield common.record_batch(dict(zip(schema.names, zip(*out, strict=True), strict=True)), kinds)
                    out = []
            if out:
                yield common.record_batch(dict(zip(schema.names, zip(*out, strict=True), strict=True)), kinds)

    dealt = slices.repartition(shards, "key").sortWithinPartitions("key")
    return dealt.select("key", "digest", "slice", "copies").mapInArrow(sort_shard, schema)


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, sort_memory: int = SORT_MEMORY,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, starts, ends (of the removed runs), kept (the bytes that stay)."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    gram = min(gram, window)
    rows = common.stored(_blocks(docs, id_col, text_col, window, gram, block_bytes), "suffix-blocks")
    blocks = rows.filter("body is not null").select("block", "sizes", "body", "doc_ids")
    held = rows.filter("key is not null").select("block", "key", "digest", "times")
    keys = held.groupBy("key").agg(F.sum("times").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")).filter("n > 1")
    keys = common.staged(keys.select("key", F.expr("low <> high").alias("several")))
    uses = common.staged(held.join(keys, "key"))
    compared = uses.filter("several").groupBy("key", "digest").agg(F.expr("cast(least(sum(times), 2) as int)").alias("copies"), F.min("block").alias("block"))
    slices = common.stored(_slices(blocks, compared, window, gram), "suffix-slices", "zstd")
    common.drop_finished_shuffles(spark)  # the texts' way to their keys
    size = slices.agg(F.sum(F.length("slice"))).first()[0] or 0
    found = common.staged(_repeats(slices, max(1, math.ceil(size / shard_bytes)), window, gram, scratch_root(spark), sort_memory))
    common.drop_finished_shuffles(spark)  # the slices' way to their shards
    whole = uses.filter("not several").select("block", "key", "digest", *[F.lit(None).cast("array<int>").alias(c) for c in ("starts", "ends")])
    spans = whole.union(uses.filter("several").join(found, ["key", "digest"]).select("block", "key", "digest", "starts", "ends"))
    schema = T.StructType([T.StructField("doc_id", kind)])
    schema = T.StructType(schema.fields + T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept binary").fields)

    def remove(group: tuple, texts: pa.Table, covered: pa.Table) -> pa.Table:
        kinds = common.arrow_schema(schema)
        out: dict[str, list] = {f.name: [] for f in schema}
        if texts.num_rows:
            body, sizes, ids = unpack(texts.column("body")[0].as_py()), texts.column("sizes")[0].as_py(), texts.column("doc_ids")[0].as_py()
            at = np.cumsum([0, *sizes])
            change = np.zeros(len(body) + 1, np.int32)
            if covered.num_rows:
                row_of = {name: i for i, name in enumerate(_names(covered))}
                start, size, key, digest = block_runs(body, sizes, window, gram)
                row = np.array([row_of.get(name, -1) for name in zip(key.tolist(), digest.tolist(), strict=True)], np.int64)
                start, size, row = start[row >= 0], size[row >= 0], row[row >= 0]
                whole = covered.column("starts").combine_chunks().is_null().to_numpy(zero_copy_only=False)[row]
                np.add.at(change, start[whole], 1)
                np.add.at(change, (start + size)[whole], -1)
                for column, step in (("starts", 1), ("ends", -1)):
                    lists = covered.column(column).combine_chunks()
                    many = lists.value_lengths().fill_null(0).to_numpy()
                    before, mine = np.cumsum(many) - many, many[row]
                    inside = np.arange(mine.sum()) - np.repeat(np.cumsum(mine) - mine, mine)
                    np.add.at(change, lists.flatten().to_numpy()[np.repeat(before[row], mine) + inside] + np.repeat(start, mine), step)
            gone = np.cumsum(change[:-1]) > 0
            for doc_id, low, high in zip(ids, at[:-1].tolist(), at[1:].tolist(), strict=True):
                mine = gone[low:high]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
                starts, ends = edges[::2].tolist(), edges[1::2].tolist()
                kept = b"".join([body[low + a : low + b] for a, b in zip([0, *ends], [*starts, high - low], strict=True)])
                _add(out, doc_id=doc_id, n_bytes=high - low, n_removed=high - low - len(kept), n_spans=len(starts), starts=starts, ends=ends, kept=kept)
        return pa.table([pa.array(out[f.name], f.type) for f in kinds], schema=kinds)

    texts = blocks.select(F.col("block").alias("of"), "sizes", "body", "doc_ids")
    return texts.groupBy("of").cogroup(spans.groupBy("block")).applyInArrow(remove, schema)
