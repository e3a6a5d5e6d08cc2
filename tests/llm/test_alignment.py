import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_support import SF

from cartwheel.llm import alignment, queries, tokens

BYTES, PIECES = tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("piece_bpe_32k.model")
TRICKY = " \n\t\r\x0b\x1c\x85\xa0 　aB'sé1٣!_Σσ́ü<|>ﬁ日𝒳▁"


class Brute:
    """Whole texts, decoded token bytes only: no spans, no chunks."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(BYTES)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        kept = alignment.aligner(BYTES, PIECES)
        self.a_bytes, self.b_bytes = kept.a_bytes, kept.b_bytes

    def __call__(self, text):
        """(groups as id lists, links, n_a, n_b) or None."""
        if not text:
            return None
        whole = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if b"".join(self.a_bytes[i] for i in a) != whole or b"".join(self.b_bytes[i] for i in b) != whole:
            return None
        ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((self.a_bytes, a), (self.b_bytes, b))]
        where_b = {e: j for j, e in enumerate(ends[1])}
        groups, links, a_from, b_from = [], [], 0, 0
        for i, e in enumerate(ends[0]):
            if e in where_b:
                j = where_b[e]
                groups.append((a[a_from : i + 1], b[b_from : j + 1]))
                links.append((a[i], b[j]))
                a_from, b_from = i + 1, j + 1
        return groups, links, len(a), len(b)


BRUTE = Brute()


@pytest.fixture
def brute():
    return BRUTE


def written(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups).encode()


def same(brute, texts):
    align = alignment.aligner(BYTES, PIECES)
    align.words.limit = align.parts.limit = 40
    for text, got in zip(texts, align.texts(texts), strict=True):
        want = brute(text)
        if want is None:
            assert got is None, repr(text)
        else:
            packed = np.array([a << 16 | b for a, b in want[1]], "<u4").tobytes()
            assert got == (written(want[0]), packed, want[2], want[3]), repr(text)


def table_of(brute, rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of every row."""
    found = [(doc_id, brute(text)) for doc_id, text in rows]
    counts = Counter(link for _, f in found if f for link in f[1])
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for doc_id, f in found:
        groups, links, n_a, n_b = f or ([], [], 0, 0)
        best = sum(counts[link] == highest[link[1]] for link in links)
        digest = hashlib.sha256(written(groups)).hexdigest() if f else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), best, sum(counts[link] for link in links), digest))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=TRICKY, max_size=25), max_size=6))
def test_tricky_text(texts):
    same(BRUTE, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_any_text(texts):
    same(BRUTE, texts)


def test_multibyte_and_byte_fallback(brute):
    same(brute, ["é日𝒳 a  b\n\tc ", "𝒳𝒳", "Ａﬁ́", "\x00\x01", " ", "a ", "\n", "a\nb, c.", "a, \n b", "don't (stop)", "\nx", "x\n\ny", "<|endoftext|> <s></s> <unk>", "x▁y", "日" * 300])


def test_long_run_without_a_cut(brute):
    same(brute, ["ab" * 20_000 + "é" * 500])


def test_chunks_are_used_and_memory_is_bounded(brute, corpus):
    align = alignment.Aligner(BYTES, PIECES, memo_chunks=100)
    assert align.chunked
    for at in range(0, 60, 20):
        align.texts([t for _, t in corpus[at : at + 20]])
        assert len(align.words.young) <= 100 and len(align.parts.young) <= 50


def test_refine_takes_spans_where_they_are_clean_and_bytes_inside_a_character():
    lengths, sizes = np.array([1, 1, 2, 3]), np.array([3, 1])  # "a日" in three tokens, then a chunk of one
    for starts, ends in (([0, 1, 1, 0], [1, 4, 4, 3]), ([0, 1, 1, 0], [1, 1, 4, 3])):
        assert alignment.refine(np.array(starts), np.array(ends), lengths, sizes).tolist() == [1, 2, 4, 3]


def test_chunks_whose_bytes_differ_are_told(brute):
    table = [b"a", b"b", b"cd"]
    assert alignment.agree([0, 1, 2, 0], [2, 1, 1], table, [b"ab", b"cd", b"a"]).tolist() == [True] * 3
    assert alignment.agree([0, 1, 2, 0], [2, 1, 1], table, [b"ab", b"c", b"da"]).tolist() == [True, False, False]


def test_query_against_brute_force(spark, corpus, brute):
    df = queries.op12_alignment(spark, SF)
    assert df.columns == COLUMNS
    assert sorted((tuple(r) for r in df.collect()), key=repr) == table_of(brute, corpus)


@pytest.mark.parametrize("block_links", [1, 300, 10**6])
def test_awkward(awkward, brute, block_links):
    rows = alignment.align(awkward, BYTES, PIECES, block_links=block_links).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == table_of(brute, [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])


def test_empty(no_docs):
    assert alignment.align(no_docs, BYTES, PIECES).count() == 0
