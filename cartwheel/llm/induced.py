"""Suffix sorting with common prefixes by external induced sorting.

The suffixes of a text of integers are sorted by induction from its S*
suffixes (those that start where the text turns from falling to rising):

1. the substrings between S* positions are sorted and named; if names
   repeat, the string of names is sorted by recursion, which also gives the
   common prefixes of the S* suffixes, in names;
2. a priority queue, fed with the sorted S* suffixes, yields the L suffixes
   in order: each suffix taken from the queue puts the suffix before it
   back in, if that is an L suffix;
3. the same queue run on the mirrored alphabet, fed with the L suffixes in
   descending order, yields all suffixes in descending order.

Queue entries are tuples (position, common prefix with the entry before it
in its bucket), so the common prefixes come out with the order: between
two suffixes put into one bucket from one bucket it is one more than the
least on the way from the one to the other.

The queue is a list of symbol ranges, each with a buffer in the order of
arrival; buffers beyond ``memory`` bytes go to one file per range and are
read back when their range comes. Entries are taken in batches: all whose
order no entry of the batch can change any more. Arrays longer than
``memory`` bytes (the text, positions, names) are memory-mapped files. So
memory is bounded by ``memory`` and one range, whatever the text's length.

Common prefixes are only counted up to ``cap``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

#: entries taken from the queue at once, at most.
BATCH = 1 << 17
#: ranges of the queue at most, and suffixes in a range at least.
RANGES, RANGE_SIZE = 256, 4096
#: elements of an array handled at once, at least.
PART = 1024


class Scratch:
    """Arrays in memory, or in files of ``folder`` where they are longer than ``memory`` bytes."""

    def __init__(self, folder: str, memory: int = 1 << 26):
        self.folder, self.memory, self.files = folder, memory, 0

    def path(self) -> str:
        self.files += 1
        return os.path.join(self.folder, f"{self.files}.bin")

    def empty(self, n: int, dtype) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.memory:
            return np.empty(n, dtype)
        return np.memmap(self.path(), dtype, "w+", shape=(n,))

    def drop(self, *arrays: np.ndarray) -> None:
        for a in arrays:
            if isinstance(a, np.memmap):
                os.remove(a.filename)

    def parts(self, n: int) -> Iterator[slice]:
        step = max(PART, self.memory // 64)
        for at in range(0, n, step):
            yield slice(at, min(n, at + step))


def range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low .. high]) per query, both ends included."""
    out = np.empty(len(low), values.dtype)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
        if len(table) > (1 << k):
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def starts_of(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it; the first does."""
    out = np.empty(len(values), bool)
    out[:1] = True
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


class Text:
    """A text whose last symbol is 0 and occurs nowhere else, with the types and runs of its positions."""

    def __init__(self, symbols: np.ndarray, scratch: Scratch, cap: int):
        self.symbols, self.scratch, self.cap, self.n = symbols, scratch, cap, len(symbols)
        self.sigma = 1 + max((int(symbols[p].max()) for p in scratch.parts(self.n)), default=0)
        self.rising = scratch.empty(self.n, bool)  # S type
        self.run = scratch.empty(self.n, np.uint16)  # length of the run of one symbol from here on, up to cap
        self.counts = np.zeros(self.sigma, np.int64)
        after, rising, ahead = -1, True, 0  # of the position behind the part
        for part in reversed(list(scratch.parts(self.n))):
            s = np.asarray(symbols[part], np.int64)
            self.counts += np.bincount(s, minlength=self.sigma)
            following = np.append(s[1:], after)
            # the end of each position's run inside the part
            ends = np.where(s != following, np.arange(len(s)), len(s))
            ends = np.minimum.accumulate(ends[::-1])[::-1]
            open_ = ends == len(s)  # runs on into the part behind
            at = np.minimum(ends, len(s) - 1)
            up = np.where(open_, rising, s[at] < following[at])
            length = np.where(open_, len(s) - np.arange(len(s)) + ahead, ends - np.arange(len(s)) + 1)
            if part.stop == self.n:
                up[-1] = True
            self.rising[part], self.run[part] = up, np.minimum(length, cap)
            after, rising, ahead = int(s[0]), bool(up[0]), int(length[0])

    def stars(self) -> np.ndarray:
        """Ascending positions of the S* suffixes; the last is the end of the text."""
        found, before = [], True
        for part in self.scratch.parts(self.n):
            up = self.rising[part]
            found.append(np.flatnonzero(up & ~np.append(before, up[:-1])) + part.start)
            before = bool(up[-1])
        total = sum(map(len, found))
        out, at = self.scratch.empty(total, np.int64), 0
        for f in found:
            out[at : at + len(f)] = f
            at += len(f)
        return out

    def close(self) -> None:
        self.scratch.drop(self.rising, self.run)


class Queue:
    """Entries ``position << 16 | common prefix`` per range of symbols, first in, first out."""

    def __init__(self, edges: np.ndarray, scratch: Scratch):
        self.edges, self.scratch = edges, scratch
        self.buffers: list[list[np.ndarray]] = [[] for _ in edges[:-1]]
        self.files: dict[int, str] = {}
        self.held = 0

    def put(self, symbols: np.ndarray, entries: np.ndarray) -> None:
        if not len(entries):
            return
        where = (np.searchsorted(self.edges, symbols, side="right") - 1).astype(np.uint16)
        order = np.argsort(where, kind="stable")
        where, entries = where[order], entries[order]
        cuts = np.flatnonzero(starts_of(where)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(where)], strict=True):
            buffer = self.buffers[where[a]]
            buffer.append(entries[a:b])
            if len(buffer) >= 64:
                buffer[:] = [np.concatenate(buffer)]
        self.held += entries.nbytes
        if self.held > self.scratch.memory:
            self.spill()

    def spill(self) -> None:
        for k, buffer in enumerate(self.buffers):
            if buffer:
                with open(self.files.setdefault(k, self.scratch.path()), "ab") as out:
                    out.write(np.concatenate(buffer).tobytes())
                buffer.clear()
        self.held = 0

    def take(self, k: int) -> Iterator[np.ndarray]:
        """The entries of range ``k`` in order of arrival, those put in meanwhile included."""
        while k in self.files or self.buffers[k]:
            path = self.files.pop(k, None)
            if path is not None:
                with open(path, "rb") as data:
                    while part := data.read(8 * BATCH):
                        yield np.frombuffer(part, np.int64)
                os.remove(path)
                continue  # what was spilled meanwhile is older than what is buffered now
            parts, self.buffers[k] = self.buffers[k], []
            if parts:
                joined = np.concatenate(parts)
                self.held -= joined.nbytes
                for at in range(0, len(joined), BATCH):
                    yield joined[at : at + BATCH]


class Induction:
    """One pass of the queue over a text, upwards or on the mirrored alphabet.

    ``seeds`` are sorted suffixes with their common prefixes; in a bucket
    they come after the suffixes put in. ``run()`` yields (positions,
    common prefixes, seeds?) in the order of the pass.
    """

    def __init__(self, text: Text, seeds: np.ndarray, seed_prefix: np.ndarray, mirrored: bool):
        self.text, self.seeds, self.seed_prefix = text, seeds, seed_prefix
        counts, self.values = text.counts, text.symbols
        if mirrored:
            counts, self.values = counts[::-1], text.scratch.empty(text.n, text.symbols.dtype)
            for part in text.scratch.parts(text.n):
                self.values[part] = text.sigma - 1 - text.symbols[part]
        # stands for no symbol: the text's end is 0, and the greatest value is not used
        self.none = np.iinfo(self.values.dtype).max
        # ranges of about equal counts; a frequent symbol is a range of its own
        size = max(RANGE_SIZE, int(RANGE_SIZE / 1024 * text.n**0.5), text.n // RANGES)
        before = np.cumsum(counts) - counts
        firsts = np.flatnonzero(np.append(True, before[1:] // size != before[:-1] // size))
        often = np.flatnonzero(counts > size)
        edges = np.unique(np.concatenate([firsts, often, often + 1, [0, len(counts)]]))
        self.queue = Queue(edges[edges <= len(counts)].astype(self.values.dtype), text.scratch)
        # per symbol: the symbol from which it was last put in, and the least common prefix since then
        self.origin = np.full(text.sigma, -1, np.int64)
        self.least = np.zeros(text.sigma, np.uint16)
        self.active, self.active_symbol = np.zeros(0, np.int64), -1
        self.last = (0, -1, True)  # position, symbol, seed? of the entry taken last

    def before(self, positions: np.ndarray, symbols: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """Symbol before each position, ``none`` where the suffix there is not put in."""
        s = self.values[np.maximum(positions - 1, 0)]
        wanted = s > symbols
        wanted |= (s == symbols) & ~seed
        wanted &= positions > 0
        s[~wanted] = self.none
        return s

    def close(self) -> None:
        if self.values is not self.text.symbols:
            self.text.scratch.drop(self.values)

    def run(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        at = 0
        for k, (low, high) in enumerate(zip(self.queue.edges[:-1], self.queue.edges[1:], strict=True)):
            if high - low == 1:
                for entries in self.queue.take(k):
                    yield self.step(entries >> 16, np.full(len(entries), low), entries & 0xFFFF, np.zeros(len(entries), bool))
                while at < len(self.seeds):
                    mine = np.asarray(self.seeds[at : at + BATCH])
                    n = int(np.count_nonzero(self.values[mine] < high))
                    if n:
                        yield self.step(mine[:n], np.full(n, low), np.asarray(self.seed_prefix[at : at + n]), np.ones(n, bool))
                        at += n
                    if n < len(mine):
                        break
                continue
            held = np.concatenate([np.zeros(0, np.int64), *self.queue.take(k)])
            end = at
            while end < len(self.seeds):
                mine = self.values[np.asarray(self.seeds[end : end + BATCH])]
                n = int(np.count_nonzero(mine < high))
                end += n
                if n < len(mine):
                    break
            positions = np.concatenate([held >> 16, self.seeds[at:end]])
            prefix = np.concatenate([held & 0xFFFF, self.seed_prefix[at:end]])
            seed = np.arange(len(positions)) >= len(held)
            symbols, at = self.values[positions], end
            while len(positions):
                order = np.argsort((symbols - low).astype(np.int64) * 2 + seed, kind="stable")
                positions, prefix, seed, symbols = positions[order], prefix[order], seed[order], symbols[order]
                # what an earlier entry of the batch puts in must not come before a later one
                put = self.before(positions, symbols, seed)
                ahead = np.empty_like(put)
                ahead[0] = self.none
                np.minimum.accumulate(put[:-1], out=ahead[1:])
                late = ahead < symbols
                late |= (ahead == symbols) & seed
                n = int(np.argmax(late)) or len(late)  # the first is never late
                yield self.step(positions[:n], symbols[:n], prefix[:n], seed[:n], put[:n])
                new = np.concatenate([np.zeros(0, np.int64), *self.queue.take(k)])
                positions = np.concatenate([positions[n:], new >> 16])
                prefix = np.concatenate([prefix[n:], new & 0xFFFF])
                seed = np.concatenate([seed[n:], np.zeros(len(new), bool)])
                symbols = np.concatenate([symbols[n:], self.values[new >> 16]])

    def step(self, positions, symbols, prefix, seed, put=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes a batch: mends the common prefixes of first seeds, puts in the suffixes before."""
        run, prefix = self.text.run, prefix.astype(np.uint16)
        # the first seed of a bucket, behind a suffix put in
        turn = seed.copy()
        turn[1:] &= (symbols[1:] == symbols[:-1]) & ~seed[:-1]
        turn[0] &= self.last[1] == symbols[0] and not self.last[2]
        if turn.any():
            at = np.flatnonzero(turn)
            p = np.where(at > 0, positions[at - 1], self.last[0])
            prefix[at] = np.minimum(run[p], run[positions[at]])
        self.last = (int(positions[-1]), symbols[-1], bool(seed[-1]))
        current = symbols[-1]
        same_symbol = symbols[0] == current

        if put is None:
            put = self.before(positions, symbols, seed)
        from_ = np.flatnonzero(put != self.none)
        if len(from_) == 0:
            if self.active_symbol == current and same_symbol:
                self.least[self.active] = np.minimum(self.least[self.active], prefix.min())
            else:
                self.active, self.active_symbol = np.zeros(0, np.int64), current
            return positions, prefix, seed
        target = put[from_]
        order = np.argsort(target, kind="stable")
        at, d = from_[order], target[order]
        c = symbols[at]
        first = starts_of(d)
        new = np.ones(len(at), np.int64)
        pair = ~first
        pair[1:] &= c[1:] == c[:-1]
        pair = np.flatnonzero(pair)
        new[pair] += range_min(prefix, at[pair - 1] + 1, at[pair])
        head = np.flatnonzero(first)
        origin = self.origin[d[head]]
        new[head[origin < 0]] = 0
        so_far = np.minimum.accumulate(prefix)
        same = head[origin == c[head]]
        new[same] += np.minimum(self.least[d[same]], so_far[at[same]])
        np.minimum(new, self.text.cap, out=new)

        if self.active_symbol == current and same_symbol:
            self.least[self.active] = np.minimum(self.least[self.active], so_far[-1])
        else:
            self.active = np.zeros(0, np.int64)
        final = np.append(head[1:] - 1, len(d) - 1)
        self.origin[d[final]] = c[final]
        mine = final[c[final] == current]
        to_come = np.full(len(prefix) + 1, 0xFFFF, np.uint16)
        to_come[:-1] = np.minimum.accumulate(prefix[::-1])[::-1]
        self.least[d[mine]] = to_come[at[mine] + 1]
        self.active = np.union1d(self.active, d[mine]) if len(self.active) else d[mine].astype(np.int64)
        self.active_symbol = current

        entries = np.empty(len(at), np.int64)
        entries[order] = (positions[at] - 1) << 16 | new
        self.queue.put(target, entries)
        return positions, prefix, seed


# -- sorting and naming the substrings between S* positions ------------------


def _keys(text: Text, starts: np.ndarray, ends: np.ndarray, offset: int, bits: int, per: int) -> np.ndarray:
    """``per`` symbols with their types from ``offset`` on, packed; 0 behind a substring's end."""
    out = np.zeros(len(starts), np.uint64)
    for j in range(offset, offset + per):
        at = starts + j
        inside = at <= ends
        at = np.minimum(at, text.n - 1)
        value = text.symbols[at].astype(np.uint64) * np.uint64(2) + text.rising[at] + np.uint64(1)
        out = out << np.uint64(bits) | np.where(inside, value, np.uint64(0))
    return out


def _equal_prefix(text: Text, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal (symbol, type) pairs of the text from ``a`` and ``b`` on; they differ somewhere before its end."""
    out, alive = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(alive):
        x, y = np.minimum(a[alive] + out[alive], text.n - 1), np.minimum(b[alive] + out[alive], text.n - 1)
        same = (text.symbols[x] == text.symbols[y]) & (text.rising[x] == text.rising[y]) & (out[alive] < text.cap)
        alive = alive[same]
        out[alive] += 1
    return out


def name_substrings(text: Text, stars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name of each S* substring, their sorted order, equal pairs of each name with the one before)."""
    scratch, m = text.scratch, len(stars)
    names, order_out, shared = scratch.empty(m, np.uint32), scratch.empty(m, np.int64), []
    bits = int(2 * text.sigma + 1).bit_length()
    per = max(1, 64 // bits)

    def limits(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return stars[k], stars[np.minimum(k + 1, m - 1)]

    # substrings are dealt to pieces by their first key, so that a piece fits in memory
    wanted = max(1, -(-m * 64 // scratch.memory))
    pieces: list[np.ndarray | str] = [np.arange(m)]
    if wanted > 1:
        sample = np.arange(0, m, max(1, m // (64 * wanted)))
        cuts = np.unique(np.sort(_keys(text, *limits(sample), 0, bits, per))[:: max(1, len(sample) // wanted)][1:])
        files = [scratch.path() for _ in range(len(cuts) + 1)]
        for part in scratch.parts(m):
            k = np.arange(part.start, part.stop)
            where = np.searchsorted(cuts, _keys(text, *limits(k), 0, bits, per), side="right")
            for piece in np.unique(where):
                with open(files[piece], "ab") as out:
                    out.write(k[where == piece].tobytes())
        pieces = [f for f in files if os.path.exists(f)]

    named, written, last = 0, 0, -1
    for piece in pieces:
        k = piece if isinstance(piece, np.ndarray) else np.fromfile(piece, np.int64)
        if isinstance(piece, str):
            os.remove(piece)
        order, head = np.arange(len(k)), np.zeros(len(k), bool)
        head[:1] = True
        todo, offset = np.arange(len(k)), 0
        while len(todo):
            start, end = limits(k[order[todo]])
            key, group = _keys(text, start, end, offset, bits, per), np.cumsum(head[todo])
            by = np.lexsort((key, group))
            order[todo], key, group = order[todo][by], key[by], group[by]
            head[todo] |= np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
            offset += per
            start, end = limits(k[order[todo]])
            sizes = np.diff(np.append(np.flatnonzero(head), len(k)))
            todo = todo[(start + offset <= end) & (np.repeat(sizes, sizes)[todo] > 1)]
        k = k[order]
        numbers = named + np.cumsum(head) - 1
        names[k], order_out[written : written + len(k)] = numbers, k
        heads = stars[k[head]]
        before = np.append(last, heads[:-1]) if last >= 0 else np.append(heads[:1], heads[:-1])
        equal = np.zeros(len(heads), np.int64)
        differ = np.flatnonzero(before != heads)
        equal[differ] = _equal_prefix(text, before[differ], heads[differ])
        shared.append(equal.astype(np.uint16))
        named, written, last = int(numbers[-1]) + 1, written + len(k), int(heads[-1])
    return names, order_out, np.concatenate(shared)


def _sorted_stars(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """The S* suffixes in order, each with its common prefix with the one before."""
    scratch = text.scratch
    stars = text.stars()
    m = len(stars)
    names, order, shared = name_substrings(text, stars)
    if len(shared) == m:
        ranks, equal = order, None
    else:
        ranks, equal = suffix_array(names, scratch, text.cap)
    sorted_, prefix = scratch.empty(m, np.int64), scratch.empty(m, np.uint16)
    for part in scratch.parts(m):
        low = max(0, part.start - 1)
        k = np.asarray(ranks[low : part.stop])
        sorted_[part] = stars[k[part.start - low :]]
        a, b = k[:-1], k[1:]  # neighbours; the first suffix has none
        same = np.zeros(len(a), np.int64) if equal is None else equal[low + 1 : part.stop].astype(np.int64)
        x, y = np.minimum(a + same, m - 1), np.minimum(b + same, m - 1)
        length = stars[x] - stars[a]
        differ = np.flatnonzero((length < text.cap) & (names[x] != names[y]))
        more = range_min(shared, names[x[differ]].astype(np.int64) + 1, names[y[differ]].astype(np.int64)).astype(np.int64)
        p, q = np.minimum(stars[x[differ]] + more, text.n - 1), np.minimum(stars[y[differ]] + more, text.n - 1)
        # equal symbols of different type: the shorter run of the symbol ends the common prefix
        more += np.where(text.symbols[p] == text.symbols[q], np.minimum(text.run[p], text.run[q]), 0)
        length[differ] += more
        prefix[low + 1 : part.stop] = np.minimum(length, text.cap)
    prefix[0] = 0
    scratch.drop(stars, names, order, *([ranks, equal] if equal is not None else []))
    return sorted_, prefix


def descending(symbols: np.ndarray, scratch: Scratch, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, common prefix with the suffix before it here) of all suffixes but the last symbol's, greatest first."""
    if len(symbols) < 2:
        return
    text = Text(symbols, scratch, cap)
    seeds, prefix = _sorted_stars(text)
    falling = text.n - sum(int(np.count_nonzero(text.rising[p])) for p in scratch.parts(text.n))
    positions, common, at = scratch.empty(falling, np.int64), scratch.empty(falling, np.uint16), 0
    up = Induction(text, seeds, prefix, mirrored=False)
    for p, c, seed in up.run():
        mine = ~seed
        n = int(np.count_nonzero(mine))
        positions[at : at + n], common[at : at + n] = p[mine], c[mine]
        at += n
    scratch.drop(seeds, prefix)
    # downwards: each entry's common prefix is now with the one that stood after it
    back = scratch.empty(falling, np.uint16)
    back[:1] = 0
    back[1:] = common[:0:-1]
    down = Induction(text, positions[::-1], back, mirrored=True)
    for p, c, _ in down.run():
        yield p, c
    down.close()
    scratch.drop(positions, common, back)
    text.close()


def suffix_array(symbols: np.ndarray, scratch: Scratch, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and common prefix of each suffix with the one before it, up to ``cap``."""
    n = len(symbols)
    order, prefix, at = scratch.empty(n, np.int64), scratch.empty(n, np.uint16), n
    order[0], prefix[0] = n - 1, 0
    if n > 1:
        prefix[1] = 0
    for p, c in descending(symbols, scratch, cap):
        order[at - len(p) : at] = p[::-1]
        # c is the common prefix with the greater neighbour, which stands one place further
        places = np.arange(at, at - len(p), -1)
        inside = places < n
        prefix[places[inside]] = c[inside]
        at -= len(p)
    return order, prefix
