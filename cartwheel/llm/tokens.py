"""Token ids of whole texts with the tokenizers library, memoised by white-space chunk.

Both vocabularies split text before their merges, never across a change
from a non-space to a space character. So the ids of a text are the ids of
its chunks (each with the white space before it) in a row, and a chunk's
ids are computed by the library's own model once per worker. Chunks that
differ only in punctuation share their words, so the pieces inside chunks
are remembered as well. Both memories are bounded and forget what was not
used lately. Of many texts at once, Arrow finds the distinct chunks, so that
Python handles each only once, and puts their ids in a row.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: chunks remembered per Python worker, in two generations of this size; about 200 bytes each with the dict.
MEMO_CHUNKS = 300_000
#: bytes of text that are encoded at once, about; a worker holds some sixteen times as much for it.
GATHERED_BYTES = 8_000_000

# fixed values: white space as both vocabularies' patterns know it, and the
# two patterns themselves, for text of ASCII and the letters of Latin-1 and
# Latin Extended A (but for U+0130, whose lower case is two characters)
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
LATIN = re.compile(rf"[\x00-\x7f{LETTERS}]*")
BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+", re.ASCII)
WORD_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+", re.ASCII)

CHUNK = re.compile(f"[{re.escape(SPACE)}]*[^{re.escape(SPACE)}]+|[{re.escape(SPACE)}]+")
RARE_SPACE = [c for c in SPACE if c not in " \n"]
# what can follow a word as one piece: no apostrophe (contractions) and no "<" (special tokens)
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"


def byte_alphabet() -> dict[int, str]:
    """Byte -> the printable character that stands for it in a byte-level vocabulary.

    Printable Latin-1 stands for itself, the rest for the characters from U+0100 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


class Memo(dict):
    """Key -> ids as little-endian bytes; computes what is missing and keeps the lately used.

    Two generations of at most ``limit`` keys: when the young one is full
    it becomes the old one, and a key found there moves back. So a key
    used again within ``limit`` others stays, on any length of input.
    """

    def __init__(self, compute: Callable[[str], bytes], limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, max(1, limit), {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.compute(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids


class Encoder:
    """``ids(text)``: the token ids as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, memo_chunks: int = MEMO_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 2**16 else "<u4")
        self.alphabet = byte_alphabet()
        self.lowers = self.tokenizer.normalizer is not None
        self.chunks = Memo(self._chunk, memo_chunks // 10 if not self.lowers else memo_chunks)
        self.spaced = Memo(self._after_space, memo_chunks)
        self.tokenize, self.code = self.tokenizer.model.tokenize, "H" if self.dtype.itemsize == 2 else "I"
        self.pieces = Memo(self._piece, memo_chunks // 4)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.lowers:
            # str.split also splits at four separators that are no space to the vocabulary
            odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
            return b"".join(map(self.chunks.__getitem__, CHUNK.findall(text) if odd else text.split()))
        if any(s in text for s in ("  ", " \n", "\n ", "\n\n")) or any(c in text for c in RARE_SPACE):
            return b"".join(map(self.chunks.__getitem__, CHUNK.findall(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return (self.chunks[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))

    def all_ids(self, texts: pa.Array) -> list[bytes]:
        """``ids`` of each text, with the distinct chunks of all texts looked up once."""
        texts = texts.cast(pa.large_string()).fill_null("")
        rare = "".join(RARE_SPACE)
        if self.lowers:  # white space only parts the words
            texts, odd = pc.replace_substring_regex(texts, f"[{rare}\n]", " "), pa.array([False] * len(texts), pa.bool_())
        else:  # white space that may be one piece; of two before a word, each is a piece or the word's
            odd = pc.match_substring_regex(texts, rf"[{rare}]|[ \n]{{3}}|[ \n]{{2}}(\z|<\|)")
        starts, codes, words = self._words(pc.if_else(odd, "", texts))
        memo, compute = (self.chunks, self._chunk) if self.lowers else (self.spaced, self._after_space)
        # Latin words with marks are put together from remembered pieces, but are not remembered themselves
        ids = [compute(w) if not w.isalpha() and LATIN.fullmatch(w) else memo[w] for w in words]
        # the first chunk has no space before it; an odd text is all one chunk
        firsts = codes[starts[:-1]].tolist()
        codes[starts[:-1]] = np.arange(len(words), len(words) + len(texts))
        ids += [self.ids(texts[i].as_py()) if o else self.chunks[words[f]] for i, (o, f) in enumerate(zip(odd.to_pylist(), firsts, strict=True))]
        _, offsets, data = pa.array(ids, pa.large_binary()).take(pa.array(codes)).buffers()
        ends = np.frombuffer(offsets, np.int64)[starts]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), data]).to_pylist()

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Where each text's chunks start, the number of each chunk's word, and the distinct words."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        words = split.flatten().dictionary_encode()
        return split.offsets.to_numpy(), words.indices.to_numpy().copy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()

    def _model(self, piece: str) -> bytes:
        return array(self.code, [t.id for t in self.tokenize(piece)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of one match of the vocabulary's pattern."""
        return self._model(piece.encode().decode("latin-1").translate(self.alphabet))

    def _after_space(self, chunk: str) -> bytes:
        word = chunk.rstrip(MARKS)
        if word.isalpha() and LATIN.fullmatch(word):
            if word != chunk:
                return self.spaced[word] + self.pieces[chunk[len(word) :]]
            return self._model(self.alphabet[0x20] + word) if word.isascii() else self._piece(" " + word)
        return self._chunk(chunk if chunk[:1] == "\n" else " " + chunk)

    def _chunk(self, chunk: str) -> bytes:
        if "<|" in chunk:  # may hold a special token
            return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.dtype).tobytes()
        if not LATIN.fullmatch(chunk):
            if self.lowers:
                chunk = self.tokenizer.normalizer.normalize_str(chunk)
            return b"".join([self._model(p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chunk)])
        # a word among the pieces is a chunk that may be remembered
        if self.lowers:
            low = chunk.lower()
            word = low.rstrip(MARKS)
            if word.isalpha():
                if word != low:
                    return self.chunks[word] + self.pieces[low[len(word) :]]
                return self._piece(low) if low == chunk else self.chunks[low]
            return b"".join([self.chunks[p] if p.isalpha() else self.pieces[p] for p in WORD_PIECES.findall(low)])
        return b"".join(
            [self.spaced[p[1:]] if p != chunk and p[0] == " " and p[1:].isalpha() else self.pieces[p] for p in BYTE_PIECES.findall(chunk)]
        )


def gathered(batches: Iterable[pa.RecordBatch], column: int, size: int = GATHERED_BYTES) -> Iterator[pa.RecordBatch]:
    """``batches`` put together while their texts in ``column`` are ``size`` bytes at most; none is cut."""
    held, held_bytes = [], 0
    for batch in batches:
        more = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and held_bytes + more > size:
            yield pa.concat_batches(held)
            held, held_bytes = [], 0
        held.append(batch)
        held_bytes += more
    if held:
        yield pa.concat_batches(held)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, kept over its tasks."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
