import itertools

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartwheel.llm import tokens

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TRICKY = st.text(alphabet=" \n\t\r\x0b\x1c\x1f\x85\xa0  　aB'sé1٣!_Σσ́ü<|>ﬁ日", max_size=25)


@pytest.fixture(scope="module", params=NAMES)
def pair(request):
    from tokenizers import Tokenizer

    path = tokens.vocabulary(request.param)
    return tokens.Encoder(path), Tokenizer.from_file(path)


def same(pair, text):
    own, library = pair
    assert np.frombuffer(own.ids(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_whole_documents(pair, corpus):
    for _, text in corpus[:400]:
        same(pair, text or "")


def test_null_and_empty(pair):
    assert pair[0].ids(None) == pair[0].ids("") == b""


@settings(max_examples=600, deadline=None)
@given(TRICKY)
def test_tricky_spaces(text):
    for name in NAMES:
        same(_pair(name), text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_any_text(text):
    for name in NAMES:
        same(_pair(name), text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=0x20, max_codepoint=0x25F), max_size=40))
def test_latin_text(text):
    for name in NAMES:
        same(_pair(name), text)


_PAIRS = {}


def _pair(name):
    from tokenizers import Tokenizer

    if name not in _PAIRS:
        path = tokens.vocabulary(name)
        _PAIRS[name] = tokens.Encoder(path, memo_chunks=50), Tokenizer.from_file(path)
    return _PAIRS[name]


def test_special_token_in_text(pair):
    for text in ("a<|endoftext|>b", " <|startoftext|> x <|endoftext|>", "<|end oftext|>"):
        same(pair, text)


def test_memo_is_bounded_and_keeps_what_is_used():
    asked = []
    memo = tokens.Memo(lambda c: asked.append(c) or c.encode(), 3)
    for c in "abcdefgh" * 2:
        assert memo[c] == c.encode() and memo["a"] == b"a"
        assert len(memo) <= 3 and len(memo.old) <= 3
    assert asked.count("a") == 1 and asked.count("h") == 2


def same_at_once(pair, texts):
    own, library = pair
    got = [np.frombuffer(ids, own.dtype).tolist() for ids in own.all_ids(pa.array(texts, pa.string()))]
    assert got == [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)], repr(texts)


def test_whole_documents_at_once(pair, corpus):
    same_at_once(pair, [text for _, text in corpus[:400]])


def test_no_text_at_once(pair):
    assert pair[0].all_ids(pa.array([], pa.string())) == []
    assert pair[0].all_ids(pa.array([None, "", None], pa.string())) == [b"", b"", b""]


def test_part_of_an_array_at_once(pair):
    texts = pa.array(["no", None, " a b.", "x\ny", "two  spaces", "no"], pa.string()).slice(1, 4)
    assert pair[0].all_ids(texts) == [pair[0].ids(t) for t in texts.to_pylist()]


def test_marks_after_words_at_once(pair):
    words = ["word", "Été", "über", "日本", "1a", "a1", "İ", "it's"]
    marks = [*tokens.MARKS, "'", "'s", "!'s", "...", "<|endoftext|>", "|>", "<", "\x1c.", "\u0301!", ",1", ".b"]
    same_at_once(pair, [f"{a}{w}{m} {w}{m}\n{w}{m}" for w in words for m in marks for a in ("", " ", "\n", "(")])


def test_white_space_in_a_row_at_once(pair):
    runs = ["".join(r) for n in range(4) for r in itertools.product(" \n\t", repeat=n)]
    words = ["", "Word.", "it's", "Été", "日本", "1", "...", "<|endoftext|>", "<|", "<"]
    same_at_once(pair, [f"{a}{run}{b}" for run in runs for a in words for b in words])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | TRICKY, max_size=6))
def test_tricky_spaces_at_once(texts):
    for name in NAMES:
        same_at_once(_pair(name), texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_any_text_at_once(texts):
    for name in NAMES:
        same_at_once(_pair(name), texts)


def test_a_chunk_is_looked_up_once_for_all_texts(pair):
    asked = []

    class Asked(tokens.Memo):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    own = tokens.Encoder(tokens.vocabulary(NAMES[1] if pair[0].lowers else NAMES[0]))
    for name in ("chunks", "spaced"):
        memo = getattr(own, name)
        setattr(own, name, Asked(memo.compute, memo.limit))
    own.all_ids(pa.array(["x often often often"] * 50, pa.string()))
    assert asked.count("often") == 1


def test_gathered_keeps_every_row_and_the_size():
    sizes = [3, 0, 5, 20, 1, 1, 1]
    batches = [pa.RecordBatch.from_pydict({"k": pa.array([i, i]), "t": pa.array(["x" * n, None])}) for i, n in enumerate(sizes)]
    got = list(tokens.gathered(iter(batches), 1, 8))
    assert [b.column(0).to_pylist()[::2] for b in got] == [[0, 1, 2], [3], [4, 5, 6]]
    assert list(tokens.gathered(iter([]), 1, 8)) == []
