"""Alignment of two tokenizers over the same text, and how often their ids meet.

Tokenizer A is a byte-level vocabulary of the tokenizers library, B a
sentencepiece model; A reads a space and the text, B adds that space
itself. The spans that the libraries report are the coarse cuts: A's
character offsets, B's byte spans. Where several tokens share one
character (bytes of a multibyte character in A, byte-fallback pieces in B)
the spans only say where the whole character ends, so the cuts inside come
from the tokens' decoded bytes. Byte offsets where both end a token cut
the text into groups; the two tokens that end there are a link.

Both vocabularies always cut where a line feed or a space follows a
character that is no white space, and between a Latin letter and
punctuation, so texts are aligned chunk by chunk between such places, and
chunks are remembered as in ``tokens``. The ids equal those of whole texts
(tested); a piece vocabulary that joins such characters is read in whole texts.

Counts of linked id pairs are over the whole corpus and grow with it, so
they are never broadcast: the first pass writes documents in blocks of
bounded size and, per block, its distinct pairs with their number. The
pairs are summed by Spark, and each block gets back the counts of the pairs
that it holds, as one small table beside its documents.

Cases: a null or empty text, and one whose tokens' bytes are not a space and
the text (a text with U+2581, for one), has no tokens: zeros and an empty
digest; a null id is carried as null; rows that repeat an id are documents
of their own; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.llm import common
from cartwheel.llm.tokens import LETTERS, byte_alphabet

#: links after which a block is closed (4 bytes each).
BLOCK_LINKS = 1_000_000
MEMO_CHUNKS = 200_000
#: characters of chunks that are encoded as one text.
UNIT_CHARS = 4000

# before a space or a line feed that follows no white space, and between a letter and ASCII punctuation
_CUT = re.compile(rf"(?<=\S)(?=[ \n])|(?<=[{LETTERS}])(?=[!-/:-@\[-`{{-~])")


Aligned = tuple  # (groups, links, tokens of A, tokens of B)


class Generations:
    """What was computed lately, in two generations of about ``limit`` keys; long keys are not kept."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that have to be computed; the others are in ``young`` then."""
        new = [k for k in keys if k not in self.young]
        self.young.update((k, self.old[k]) for k in new if k in self.old)
        return [k for k in new if k not in self.young]

    def turn(self) -> None:
        if len(self.young) > self.limit:
            self.old, self.young = {k: v for k, v in self.young.items() if len(k) <= 64}, {}


def even_words(text: str) -> list[str] | None:
    """The words, each after a single space, or beginning with the line feed before it; None for texts with other white space."""
    if text.replace("\n", " ").split(" ") != text.split():
        return None
    return text.replace("\n", " \n").split(" ") if "\n" in text else text.split(" ")


def joined(parts: list[Aligned | None]) -> Aligned | None:
    """The alignment of texts in a row."""
    if None in parts:
        return None
    groups, links, n_a, n_b = zip(*parts, strict=True)
    return ";".join(groups), b"".join(links), sum(n_a), sum(n_b)


class Aligner:
    """``texts(texts)``: per text its ``Aligned``, or None where the bytes do not agree."""

    def __init__(self, byte_level: str, pieces: str, memo_chunks: int = MEMO_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        byte_of = {c: b for b, c in byte_alphabet().items()}
        specials = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = {
            i: token.encode() if token in specials else bytes(byte_of[c] for c in token) for token, i in self.a.get_vocab().items()
        }
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_sizes = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)], np.int64)
        self.b_sizes = np.array([len(b) for b in self.b_bytes], np.int64)
        self.space = self.b.piece_to_id("▁")
        # a piece that crosses such a place would make chunks differ from whole texts
        plain = [p.replace("▁", " ") for i, p in enumerate(names) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.chunked = not any(_CUT.search(p) or "\n" in p for p in plain)
        # an id and what follows it in the digest's text
        self.written = [f"{i}{mark}" for i in range(1 << 16) for mark in ",|;\n"]
        self.words, self.parts = Generations(memo_chunks), Generations(memo_chunks // 2)

    def texts(self, texts: list[str | None]) -> list[Aligned | None]:
        # the memory's tuples hold no cycles, and walking them again and again costs a tenth of the time
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._texts(texts)
        finally:
            if collecting:
                gc.enable()

    def _texts(self, texts: list[str | None]) -> list[Aligned | None]:
        # most texts are words with one space or line feed before each; their words are looked up whole
        words = [even_words(text) if text and self.chunked else None for text in texts]
        rest = [(_CUT.split(" " + text) if self.chunked else [" " + text]) if text and word is None else None for text, word in zip(texts, words, strict=True)]
        new = {w: [" " + w] if w.isalnum() else _CUT.split(w if w[:1] == "\n" else " " + w) for w in self.words.missing(set().union(*filter(None, words)))}
        cut = self.parts.missing(set().union(*new.values(), *filter(None, rest)))
        at, size = 0, 0
        for k, chunk in enumerate(cut, 1):
            size += len(chunk)
            if size > 1_000_000 or k == len(cut):
                self.parts.young.update(zip(cut[at:k], self.chunks(cut[at:k]), strict=True))
                at, size = k, 0
        known = self.parts.young
        self.words.young.update((w, known[c[0]] if len(c) == 1 else joined(list(map(known.__getitem__, c)))) for w, c in new.items())
        out = []
        for word, chunks in zip(words, rest, strict=True):
            if word is None and chunks is None:
                out.append(None)
                continue
            whole = joined(list(map(self.words.young.__getitem__, word)) if word is not None else list(map(known.__getitem__, chunks)))
            out.append(whole and (whole[0].encode(), *whole[1:]))
        self.words.turn()
        self.parts.turn()
        return out

    def chunks(self, chunks: list[str]) -> list[Aligned | None]:
        """Chunks that are a space and what is no white space are encoded in a row: the libraries cut between them."""
        units, size = [], UNIT_CHARS
        for k in sorted(range(len(chunks)), key=lambda k: not _plain(chunks[k])):
            if size + len(chunks[k]) > UNIT_CHARS or not _plain(chunks[k]):
                units.append([])
                size = 0
            units[-1].append(k)
            size += len(chunks[k])
        out: list[Aligned | None] = [None] * len(chunks)
        for _ in range(2):
            bad = self._units(units, chunks, out)
            units = [[k] for unit in bad if len(unit) > 1 for k in unit]  # seldom: which of them it is
            if not units:
                return out
        return out

    def _units(self, units: list[list[int]], chunks: list[str], out: list[Aligned | None]) -> list[list[int]]:
        """Fills ``out`` for the chunks of each unit, encoded as one text; the units whose bytes do not agree."""
        texts = ["".join(map(chunks.__getitem__, unit)) for unit in units]
        raw = [t.encode() for t in texts]
        sides = [self._a_spans(texts, raw), self._b_spans(texts)]
        good = np.ones(len(units), bool)
        for (ids, _, _, sizes), table in zip(sides, (self.a_bytes, self.b_bytes), strict=True):
            good &= agree(ids, sizes, table, raw)
        bad = [units[k] for k in np.flatnonzero(~good)]
        if bad:
            units, raw = [u for u, g in zip(units, good, strict=True) if g], [r for r, g in zip(raw, good, strict=True) if g]
            sides = [(*(np.asarray(v)[np.repeat(good, sizes)] for v in (ids, starts, ends)), np.array(sizes, np.int64)[good]) for ids, starts, ends, sizes in sides]
        if not units:
            return bad
        # all units in a row, offsets counted on
        unit_base = np.cumsum([0, *map(len, raw)])
        rows = []
        for (ids, starts, ends, sizes), lengths in zip(sides, (self.a_sizes, self.b_sizes), strict=True):
            ids, sizes = np.asarray(ids, np.int64), np.asarray(sizes, np.int64)
            rows.append((ids, refine(np.asarray(starts, np.int64), np.asarray(ends, np.int64), lengths[ids], sizes) + np.repeat(unit_base[:-1], sizes)))
        (a_ids, a_ends), (b_ids, b_ends) = rows
        members = [k for unit in units for k in unit]
        base = np.cumsum([0, *(len(c) if c.isascii() else len(c.encode()) for c in map(chunks.__getitem__, members))])
        a_sizes, b_sizes = (np.diff(np.searchsorted(ends, base, side="right")).tolist() for ends in (a_ends, b_ends))
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        links = (a_ids[np.searchsorted(a_ends, cuts)] << 16 | b_ids[np.searchsorted(b_ends, cuts)]).astype("<u4").tobytes()
        side = np.concatenate([2 * np.searchsorted(cuts, a_ends), 2 * np.searchsorted(cuts, b_ends) + 1])
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate([a_ids, b_ids])[order]
        last_of_chunk = np.isin(cuts, base)
        mark = np.where(np.append(side[1:] == side[:-1], False), 0, np.where(side % 2 == 0, 1, 2 + last_of_chunk[side // 2]))
        groups = "".join(map(self.written.__getitem__, (ids * 4 + mark).tolist())).split("\n")
        at = (4 * np.searchsorted(cuts, base, side="right")).tolist()
        for j, k in enumerate(members):
            out[k] = (groups[j], links[at[j] : at[j + 1]], a_sizes[j], b_sizes[j])
        return bad

    def _a_spans(self, texts: list[str], raw: list[bytes]) -> Spans:
        """A's tokens with the bytes of the characters that they touch."""
        found = self.a.encode_batch(texts, add_special_tokens=False)
        ids = list(chain.from_iterable([f.ids for f in found]))
        spans = np.fromiter(chain.from_iterable(chain.from_iterable([f.offsets for f in found])), np.int64, 2 * len(ids)).reshape(-1, 2)  # of characters
        sizes = [len(f) for f in found]
        if any(len(t) != len(r) for t, r in zip(texts, raw, strict=True)):
            codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
            place = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])
            first = np.cumsum([0, *map(len, texts)])[:-1]
            spans = place[spans + np.repeat(first, sizes)[:, None]] - np.repeat(place[first], sizes)[:, None]
        return ids, spans[:, 0], spans[:, 1], sizes

    def _b_spans(self, texts: list[str]) -> Spans:
        """B's pieces with their byte spans; the space before the text counts as one byte."""
        # the space that B adds is a text's own, or goes with a line feed, which no piece joins
        found = self.b.encode([t[1:] if t[0] == " " else "\n" + t for t in texts], return_type="proto", num_threads=1)
        ids, starts, ends, sizes = [], [], [], []
        for text, proto in zip(texts, found, strict=True):
            if text == " ":
                mine, stops = [self.space], [1]
            else:
                pieces = list(proto.pieces)
                if text[0] == " ":
                    mine, stops = [p.id for p in pieces], [p.end + 1 for p in pieces]
                else:
                    mine, stops = [p.id for p in pieces[2:]], [p.end - 1 for p in pieces[2:]]
            ids += mine
            sizes.append(len(mine))
            starts.append(0)
            starts += stops[:-1]  # spans follow one another
            ends += stops
        return ids, starts, ends, sizes


def _plain(chunk: str) -> bool:
    return chunk[0] == " " and len(chunk) > 1 and chunk[1] != "\n" and not chunk[-1].isspace()


Spans = tuple  # (ids, starts, ends, tokens per text)


def agree(ids: list[int], sizes: list[int], table, raw: list[bytes]) -> np.ndarray:
    """Per chunk, whether its tokens' bytes are its own."""
    decoded = list(map(table.__getitem__, ids))
    at = np.cumsum([0, *sizes]).tolist()
    lengths = np.cumsum([0, *map(len, decoded)])[at]
    if b"".join(decoded) == b"".join(raw) and np.array_equal(np.diff(lengths), [len(r) for r in raw]):
        return np.ones(len(raw), bool)
    return np.array([b"".join(decoded[a:b]) == r for a, b, r in zip(at[:-1], at[1:], raw, strict=True)], bool)


def refine(starts: np.ndarray, ends: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ends of tokens in their chunk from coarse byte spans and the lengths of their decoded bytes.

    A span is a cut where the next token starts at its end or later and it
    is not empty. Tokens that share a character report the character's
    span (or an empty one), and end where their decoded bytes do.
    """
    before = np.cumsum(lengths) - lengths
    first = np.cumsum(sizes) - sizes
    at = before - np.repeat(before[np.minimum(first, len(before) - 1)], sizes)
    following = np.append(starts[1:], 0)
    following[(first + sizes - 1)[sizes > 0]] = np.iinfo(np.int64).max
    clean = (starts <= at) & (at < ends) & (ends <= following)
    return np.where(clean, ends, at + lengths)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_level: str, pieces: str) -> Aligner:
    """The worker's aligner, kept over its tasks."""
    if (byte_level, pieces) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[byte_level, pieces] = Aligner(byte_level, pieces)
    return _ALIGNERS[byte_level, pieces]


def _aligned(docs: DataFrame, byte_level: str, pieces: str, id_col: str, text_col: str, block_links: int) -> DataFrame:
    """Rows of documents (pair is null) and of a block's distinct pairs, both with ``block``."""
    schema = T.StructType.fromDDL("block long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pair long, times long")
    schema = schema.add("doc_id", docs.schema[id_col].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, align = common.arrow_schema(schema), aligner(byte_level, pieces)
        block, held, seen = TaskContext.get().partitionId() << 24, 0, []

        def pairs() -> pa.RecordBatch:
            found, times = np.unique(np.frombuffer(b"".join(seen), "<u4"), return_counts=True)
            n = len(found)
            seen.clear()
            empty = dict.fromkeys(("n_a", "n_b", "n_groups", "groups_sha256", "links", "doc_id"), [None] * n)
            return common.record_batch(empty | {"block": np.full(n, block), "pair": found.astype(np.int64), "times": times}, kinds)

        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in schema}
            for doc_id, aligned in zip(batch.column(0).to_pylist(), align.texts(batch.column(1).to_pylist()), strict=True):
                groups, links, n_a, n_b = aligned or (None, b"", 0, 0)
                digest = "" if groups is None else hashlib.sha256(groups).hexdigest()
                for name, value in (("block", block), ("n_a", n_a), ("n_b", n_b), ("n_groups", len(links) // 4), ("groups_sha256", digest),
                                    ("links", links), ("pair", None), ("times", None), ("doc_id", doc_id)):
                    rows[name].append(value)
                seen.append(links)
                held += len(links) // 4
                if held >= block_links:
                    yield common.record_batch(rows, kinds)
                    yield pairs()
                    rows, held, block = {f.name: [] for f in schema}, 0, block + 1
            yield common.record_batch(rows, kinds)
        yield pairs()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair over the corpus, and whether it is its B id's highest."""
    counts = common.staged(pairs.groupBy("pair").agg(F.sum("times").alias("count")))
    b = F.expr("pair & 65535").alias("b")
    highest = counts.groupBy(b).agg(F.max("count").alias("highest"))
    return counts.withColumn("b", b).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(
    docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", *, block_links: int = BLOCK_LINKS,
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, links.

    ``links`` holds the linked ids of each group in order, as little-endian u4 ``A << 16 | B``.
    """
    rows = common.stored(_aligned(docs, byte_level, pieces, id_col, text_col, block_links), "alignment")
    pairs = rows.filter("pair is not null").select("block", "pair", "times")
    known = pairs.join(pair_counts(pairs), "pair").select("block", "pair", "count", "best")
    told = rows.filter("pair is null").select(F.col("block").alias("of"), *[c for c in rows.columns if c not in ("block", "pair", "times")])
    schema = T.StructType([*told.drop("of").schema.fields]).add("n_links", "long").add("n_best", "long").add("count_sum", "long")

    def look_up(key: tuple, documents: pa.Table, counts: pa.Table) -> pa.Table:
        pair = counts.column("pair").to_numpy()
        order = np.argsort(pair)
        pair, count, best = pair[order], counts.column("count").to_numpy()[order], np.asarray(counts.column("best").combine_chunks().cast(pa.int8()))[order]
        sizes, n_best, total = [], [], []
        for links in documents.column("links").to_pylist():
            at = np.searchsorted(pair, np.frombuffer(links, "<u4").astype(np.int64))
            sizes.append(len(at))
            n_best.append(int(best[at].sum()) if len(at) else 0)
            total.append(int(count[at].sum()) if len(at) else 0)
        kinds = common.arrow_schema(schema)
        out = {c: documents.column(c) for c in documents.column_names if c != "of"}
        out |= {"n_links": pa.array(sizes, pa.int64()), "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        return pa.table([out[f.name].cast(f.type) for f in kinds], schema=kinds)

    return told.groupBy("of").cogroup(known.groupBy("block")).applyInArrow(look_up, schema)
