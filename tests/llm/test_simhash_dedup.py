import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_support import SF

from cartwheel.llm import simhash_dedup as S


def plain_fingerprint(text, shingle=3):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, max_bits):
    """Component number of each fingerprint by comparing all pairs."""
    values = np.array(prints, np.uint64)
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= max_bits):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def check(found, rows, max_bits=3):
    prints = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components(prints, max_bits)
    least = {}
    for (doc_id, _), c in zip(rows, comp, strict=True):
        if doc_id is not None:
            least[c] = min(doc_id, least.get(c, doc_id))
    expected = sorted(((i, p, least.get(c)) for (i, _), p, c in zip(rows, prints, comp, strict=True)), key=repr)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in found.collect()), key=repr)
    assert got == expected


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aBÉ \t\x0b\x1c", max_size=30))
def test_fingerprint(text):
    assert S.fingerprint(text.encode(), 3) == plain_fingerprint(text)


def test_majority_counts_past_a_byte():
    rng = np.random.default_rng(3)
    for n in (1, 254, 255, 256, 511, 2000):
        h = rng.integers(0, 2**64, n, dtype=np.uint64)
        assert S.majority(h) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > n)


def test_awkward(awkward):
    check(S.simhash_dedup(awkward), [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])


def test_whole_small_table(spark, corpus):
    check(S.simhash_dedup(spark.read.parquet(f"{SF}/documents.parquet")), corpus)


def clustered(n=6000, seed=5):
    """Random fingerprints, and clusters whose members are a few flips apart, in chains too."""
    rng = np.random.default_rng(seed)
    out = list(rng.integers(0, 2**64, n // 2, dtype=np.uint64))
    while len(out) < n:
        base = out[rng.integers(len(out))]
        for _ in range(rng.integers(1, 40)):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                base ^= np.uint64(1) << np.uint64(b)
            out.append(base)
    return np.unique(np.array(out, np.uint64))


def labels_of(links, prints):
    parent = {int(p): int(p) for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return [root(int(p)) for p in prints]


def test_trees_lose_no_link(spark, monkeypatch):
    prints = clustered()
    monkeypatch.setattr(S, "SHARD_ROWS", 64)
    monkeypatch.setattr(S, "DIRECT_ROWS", 16)
    points = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long").repartition(5)
    links = S.near_links(points, 3).collect()
    assert len(links) <= 6 * len(prints)
    got = labels_of([(r.a % 2**64, r.b % 2**64) for r in links], prints)
    index = {int(p): i for i, p in enumerate(prints)}
    assert [index[g] for g in got] == plain_components(prints, 3)


def test_one_half_equal_for_all(spark, monkeypatch):
    """The low halves cannot be told apart; the search then goes by all 64 bits."""
    rng = np.random.default_rng(9)
    prints = np.unique(rng.integers(0, 2**32, 1500, dtype=np.uint64) << np.uint64(32))
    parent = S.link_shard(prints, np.ones(len(prints), bool), S.halves(prints)[0], 3)
    index = plain_components(prints, 3)
    assert parent.tolist() == index


def test_empty(no_docs):
    assert S.simhash_dedup(no_docs).count() == 0
    assert S.keep_one(no_docs).count() == 0


def test_keep_one(awkward):
    kept = S.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 2 not in ids and 1 in ids and 6 not in ids and ids.count(None) == 2


def test_keep_one_goes_by_row(spark):
    """One row of each component, also where ids are null or repeated."""
    words = [f"word{i}" for i in range(400)]
    near = [" ".join(words), " ".join([*words[:-1], "other"])]
    assert bin(plain_fingerprint(near[0]) ^ plain_fingerprint(near[1])).count("1") <= 3
    far = [" ".join(f"{w}{i}" for i in range(50)) for w in ("far", "off", "out")]
    rows = [(1, near[0]), (2, near[1]), (2, far[0]), (3, far[1]), (3, far[1]), (3, far[1] + " "), (3, far[2]), (4, far[2]), (None, near[1]), (None, far[2])]
    rows += [(None, "alone here with no id at all"), (None, "alone here with no id at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def brute(rows):
        comp, kept = plain_components([plain_fingerprint(t) for _, t in rows], 3), {}
        for (doc_id, _), c in zip(rows, comp, strict=True):
            at = (doc_id is None, doc_id or 0)
            kept[c] = min(at, kept.get(c, at))
        return sorted((c, *at) for c, at in kept.items())

    def found(kept):
        where = dict(zip([t for _, t in rows], plain_components([plain_fingerprint(t) for _, t in rows], 3), strict=True))
        return sorted((where[r.text], r.doc_id is None, r.doc_id or 0) for r in kept)

    assert found(S.keep_one(docs, keep_null_ids=False).collect()) == brute(rows)
    named = [r for r in rows if r[0] is not None]
    kept = S.keep_one(docs).collect()
    assert found(r for r in kept if r.doc_id is not None) == [r for r in brute(rows) if not r[1]] == brute(named)
    assert sum(r.doc_id is None for r in kept) == 4
