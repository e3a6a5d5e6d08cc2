"""Packing by sum of squares: documents into windows of at most ``window`` tokens.

Each task packs the documents of its own input partition, in their order,
without any shuffle. A document's full windows stand alone; its remainder
goes to the fill level where the sum of squared counts of partially
filled windows, over all levels, becomes smallest (ties: the fuller
level). A level array holds the counts, so a placement costs one pass over
the levels. Only partially filled windows are held; at the end of the task,
or when ``max_open`` are held, their pieces are joined and cut again
into full windows, and what remains into windows whose sizes are powers of
two, which need no padding.

Cases: a null or empty text is the end id alone; a null id is carried as null;
rows that repeat an id are documents of their own; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartwheel.llm import common, tokens

#: partially filled windows a task holds at most (each at most ``window`` ids).
MAX_OPEN = 4096
#: ids returned per Arrow batch, about.
BATCH_IDS = 4_000_000

Piece = tuple  # (doc number, start, ids)


class SumOfSquares:
    """Online packer: ``add`` and ``finish`` yield closed windows, lists of pieces."""

    def __init__(self, window: int, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.counts = np.zeros(window + 1, np.int64)
        self.levels: dict[int, list[list[Piece]]] = {}
        self.open = 0

    def add(self, number: int, ids: np.ndarray) -> Iterator[list[Piece]]:
        full = len(ids) // self.window * self.window
        for start in range(0, full, self.window):
            yield [(number, start, ids[start : start + self.window])]
        if full < len(ids):
            yield from self._place((number, full, ids[full:]))
        if self.open >= self.max_open:
            yield from self.finish()

    def _place(self, piece: Piece) -> Iterator[list[Piece]]:
        size = len(piece[2])
        level = self.best_level(size)
        if level:
            held = self.levels[level].pop()
            self.counts[level] -= 1
            self.open -= 1
        else:
            held = []
        held.append(piece)
        if level + size == self.window:
            yield held
        else:
            self.levels.setdefault(level + size, []).append(held)
            self.counts[level + size] += 1
            self.open += 1

    def best_level(self, size: int) -> int:
        """The level h (0: a new window) whose move to h + size adds least to the sum of squares."""
        w = self.window
        change = 2 * (self.counts[size : w + 1] - self.counts[: w + 1 - size]) + 2
        change[0] -= 1  # nothing leaves level 0
        change[-1] -= 1  # a full window is in no count
        usable = self.counts[: w + 1 - size] > 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def finish(self) -> Iterator[list[Piece]]:
        """Cuts the pieces of all open windows anew: full windows, then powers of two."""
        pieces = [p for level in sorted(self.levels, reverse=True) for held in self.levels[level] for p in held]
        self.levels, self.open = {}, 0
        self.counts[:] = 0
        left = sum(len(p[2]) for p in pieces)
        room = self._next_size(left)
        held: list[Piece] = []
        for number, start, ids in pieces:
            at = 0
            while at < len(ids):
                part = ids[at : at + room]
                held.append((number, start + at, part))
                at += len(part)
                room -= len(part)
                left -= len(part)
                if not room:
                    yield held
                    held, room = [], self._next_size(left)

    def _next_size(self, left: int) -> int:
        return self.window if left >= self.window else 1 << (left.bit_length() - 1) if left else 0


def pack(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 1, window: int = 2048,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian u4)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)])
    schema = T.StructType.fromDDL("start long, length long, doc_tokens long, sequence_id long, offset long, ids binary").add(schema.fields[0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, encoder, packer = common.arrow_schema(schema), tokens.encoder(vocabulary), SumOfSquares(window)
        sequence = TaskContext.get().partitionId() << 40  # room for 2**40 windows per partition
        rows: dict[str, list] = {f.name: [] for f in schema}
        known: dict[int, tuple] = {}  # of documents with pieces in open windows, and of this batch
        held, number = 0, 0

        def close(windows: Iterable[list[Piece]]) -> int:
            nonlocal sequence
            size = 0
            for window_pieces in windows:
                offset = 0
                for n, start, ids in window_pieces:
                    doc_id, total = known[n]
                    for name, value in (("doc_id", doc_id), ("start", start), ("length", len(ids)), ("doc_tokens", total),
                                        ("sequence_id", sequence), ("offset", offset), ("ids", ids.astype("<u4").tobytes())):
                        rows[name].append(value)
                    offset += len(ids)
                size += offset
                sequence += 1
            return size

        def flush() -> pa.RecordBatch:
            batch = common.record_batch(rows, kinds)
            for values in rows.values():
                values.clear()
            return batch

        for batch in tokens.gathered(batches, 1):
            for doc_id, found in zip(batch.column(0).to_pylist(), encoder.all_ids(batch.column(1)), strict=True):
                ids = np.append(np.frombuffer(found, encoder.dtype), encoder.dtype.type(end_id))
                known[number] = (doc_id, len(ids))
                held += close(packer.add(number, ids))
                number += 1
                if held >= BATCH_IDS:
                    yield flush()
                    held = 0
            waiting = {p[0] for level in packer.levels.values() for w in level for p in w}
            known = {n: known[n] for n in waiting}
        close(packer.finish())
        yield flush()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
