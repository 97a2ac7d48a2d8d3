"""Suffix arrays with common-prefix values by induced sorting, in bulk and with queues that go to disk.

The suffixes at the left ends of falling-to-rising turns (*turns* below) are sorted first, by recursion on the
names of the stretches between them. One pass then induces the falling suffixes from the turns, in ascending
order of characters, and a second one induces the rising suffixes from the falling ones, descending. A pass
takes suffixes off a priority queue in order (first character, time of entry), and each enters its predecessor,
if that is of the kind sought. All suffixes that no one in between can precede are taken at once, so a step
is a handful of numpy calls; the queue holds its entries in ranges of characters, in memory or in a file.

The value common with the suffix before travels with each suffix: two suffixes induced by a and b have one more
character in common than the least value met between a and b.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Ranges of characters that the queue keeps apart.
RANGES = 512


class Queue:
    """First-in-first-out ranges of entries, position * 256 + common; beyond ``memory`` bytes they go to files."""

    def __init__(self, ranges: int, memory: int):
        self.held: list[list[np.ndarray]] = [[] for _ in range(ranges)]
        self.files: dict[int, object] = {}
        self.memory, self.size = memory, 0

    def push(self, k: int, rows: np.ndarray) -> None:
        self.held[k].append(rows)
        self.size += rows.nbytes
        if self.size > self.memory:
            for j, rows_of in enumerate(self.held):
                if rows_of:
                    if j not in self.files:
                        self.files[j] = tempfile.TemporaryFile(prefix="tidemark-queue-")
                    for r in rows_of:
                        self.files[j].write(r.tobytes())
                    self.held[j] = []
            self.size = 0

    def pop(self, k: int) -> np.ndarray | None:
        got = self.held[k]
        if not got and k not in self.files:
            return None
        self.held[k] = []
        self.size -= sum(r.nbytes for r in got)
        if k in self.files:
            with self.files.pop(k) as f:
                f.seek(0)
                got.insert(0, np.frombuffer(f.read(), np.int64))
        return got[0] if len(got) == 1 else np.concatenate(got)


def kinds(text: np.ndarray) -> np.ndarray:
    """True where a suffix rises: it is smaller than the next one. The last (the end mark) counts as rising."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int64)))
    moves = np.append(np.where(step != 0, np.arange(n - 1), n - 1), n - 1)
    after = np.minimum.accumulate(moves[::-1])[::-1]  # the next place where the character changes
    up = np.append(step > 0, True)
    return up[after]


def turns(rising: np.ndarray) -> np.ndarray:
    return np.flatnonzero(rising[1:] & ~rising[:-1]) + 1


def runs(text: np.ndarray) -> np.ndarray:
    """How often a position's character repeats from there on."""
    n = len(text)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    return ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo..hi] (both within), by doubling."""
    span = hi - lo + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    table, width = values, 1
    for k in range(int(level.max(initial=0)) + 1):
        some = level == k
        if some.any():
            out[some] = np.minimum(table[lo[some]], table[hi[some] - width + 1])
        if 2 * width <= len(values):
            table = np.minimum(table[: len(table) - width], table[width:])
        width *= 2
    return out


def induce(text: np.ndarray, seeds: np.ndarray, wanted: np.ndarray, common: np.ndarray | None, cap: int, memory: int) -> tuple[np.ndarray, np.ndarray | None]:
    """All seeds and wanted suffixes in order, the wanted before the seeds of a character; and their values.

    seeds: sorted suffixes. wanted: marks the suffixes to induce. common: of each seed with the one before.
    """
    sigma = int(text.max()) + 1
    ranges = min(sigma, RANGES)
    range_of = np.append((np.arange(sigma, dtype=np.int64) * ranges) // sigma, -1)  # the last for none
    queue = Queue(ranges, memory)
    seed_bounds = np.searchsorted(range_of[text[seeds]], np.arange(ranges + 1))
    out, out_common = [], []
    since = np.full(sigma, cap, np.int16) if common is not None else None
    lengths = runs(text) if common is not None else None
    zero = np.zeros(0, np.int16)

    for k in range(ranges):
        low, high = seed_bounds[k], seed_bounds[k + 1]
        if low == high and not queue.held[k] and k not in queue.files:
            continue
        pool = seeds[low:high] << 8
        if common is not None:
            pool |= common[low:high]
        key = text[seeds[low:high]] * 2 + 1
        last_key, last_at = -1, -1
        while True:
            new = queue.pop(k)
            if new is not None:
                new_key = text[new >> 8] * 2
                if len(pool) and (len(new_key) == 0 or new_key[-1] >= key[0] or (new_key > key[0]).any()) or (new_key[1:] < new_key[:-1]).any():
                    key = np.concatenate([key, new_key])
                    order = np.argsort(key, kind="stable")
                    pool, key = np.concatenate([pool, new])[order], key[order]
                else:
                    pool, key = np.concatenate([new, pool]), np.concatenate([new_key, key])
            if not len(pool):
                break
            before = (pool >> 8) - 1
            ok = wanted[before] & (before >= 0)  # -1 reads the last
            target = np.where(ok, text[before], sigma)
            least = np.minimum.accumulate(np.where(range_of[target] == k, target, sigma))
            n = len(pool)
            stop = key[1:] > 2 * least[:-1]
            if n > 1:
                first = int(stop.argmax())
                if stop[first]:
                    n = first + 1
            place, ok = pool[:n] >> 8, ok[:n]
            out.append(place)
            if common is not None:
                c = (pool[:n] & 255).astype(np.int16)
                keys = key[:n]
                prev = np.concatenate([[last_key], keys[:-1]])
                c[prev >> 1 != keys >> 1] = 0
                meet = np.flatnonzero((prev >> 1 == keys >> 1) & (prev != keys))  # wanted, then a seed: runs of one character
                if len(meet):
                    prev_at = np.where(meet > 0, place[meet - 1], last_at)
                    c[meet] = np.minimum(cap, np.minimum(lengths[prev_at], lengths[place[meet]]))
                out_common.append(c)
                last_key, last_at = int(keys[-1]), int(place[-1])
            at = np.flatnonzero(ok)
            if len(at):
                t = target[at]
                o = np.argsort(t.astype(np.uint16) if sigma < 65536 else t, kind="stable")
                at, t = at[o], t[o]
                rows = (place[at] - 1) << 8
                if common is not None:
                    first = np.concatenate([[True], t[1:] != t[:-1]])
                    lo = np.where(first, 0, np.concatenate([[0], at[:-1]]) + 1)
                    least = _range_min(c, lo, at)
                    least[first] = np.minimum(least[first], since[t[first]])
                    rows |= np.minimum(cap, least + 1)
                    final = np.append(np.flatnonzero(first)[1:], len(at)) - 1
                    since = np.minimum(since, c.min())
                    tail = np.full(len(final), cap, np.int16)
                    some = at[final] + 1 < n
                    if some.any():
                        tail[some] = _range_min(c, at[final][some] + 1, np.full(some.sum(), n - 1))
                    since[t[final]] = tail
                where = range_of[t]
                cuts = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(where)]
                for a, b, r in zip(cuts[:-1], cuts[1:], where[cuts[:-1]].tolist(), strict=True):
                    queue.push(r, rows[a:b])
            elif common is not None:
                since = np.minimum(since, c.min())
            pool, key = pool[n:], key[n:]
    got = np.concatenate(out) if out else np.zeros(0, np.int64)
    return got, (np.concatenate(out_common) if out_common else zero) if common is not None else None


def names(text: np.ndarray, rising: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks of the stretches from each turn to the next, the next turn's character included; equal ones tie."""
    n = len(text)
    lengths = np.diff(np.append(at, n - 1)) + 1
    symbols = text.astype(np.uint64) * np.uint64(2) + rising + np.uint64(1)
    bits = int(symbols.max()).bit_length()
    each = max(1, 63 // bits)
    rank, active, done = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while len(active):
        word = np.zeros(len(active), np.uint64)
        for k in range(done, done + each):
            inside = k < lengths[active]
            word = (word << np.uint64(bits)) | np.where(inside, symbols[np.minimum(at[active] + k, n - 1)], np.uint64(0))
        # the rank so far, refined by this word: a rank is the number of smaller stretches
        order = np.lexsort((word, rank[active]))
        r, w = rank[active][order], word[order]
        new = np.concatenate([[False], (r[1:] != r[:-1]) | (w[1:] != w[:-1])])
        head = np.concatenate([[True], r[1:] != r[:-1]])
        base = np.maximum.accumulate(np.where(head, np.arange(len(r)), 0))
        start = np.maximum.accumulate(np.where(new | head, np.arange(len(r)), 0))
        rank[active[order]] = r + (start - base)
        done += each
        tied = np.zeros(len(active), bool)
        same = np.concatenate([(start[1:] == start[:-1]), [False]]) if len(r) else np.zeros(0, bool)
        same = same | np.concatenate([[False], same[:-1]])
        tied[order] = same
        active = active[tied & (done < lengths[active])]
    return rank


def suffix_order(text: np.ndarray, memory: int) -> np.ndarray:
    """Sorted suffixes of a text that ends with its one smallest character."""
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1].copy()
    rising = kinds(text)
    at = turns(rising)
    seeds = sorted_turns(text, rising, at, memory)
    falling, _ = induce(text, seeds, ~rising, None, 0, memory)
    falling = falling[~rising[falling]]
    sigma = int(text.max())
    back, _ = induce(sigma - text, falling[::-1], rising, None, 0, memory)
    return np.concatenate([[n - 1], back[::-1]])


def sorted_turns(text: np.ndarray, rising: np.ndarray, at: np.ndarray, memory: int) -> np.ndarray:
    rank = names(text, rising, at)
    distinct, inverse = np.unique(rank, return_inverse=True)
    if len(distinct) == len(at):
        return at[np.argsort(rank)]
    return at[suffix_order(inverse.astype(np.int64), memory)]


def _direct(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Characters that suffixes a and b have in common, up to cap; eight at a time. text: below 512."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(8, np.uint64)])
    word = np.zeros(n, np.uint64)
    for k in range(7):
        word = (word << np.uint64(9)) | padded[k : k + n]
    out, active, k = np.full(len(a), cap, np.int64), np.arange(len(a)), 0
    while len(active) and k < cap:
        x, y = a[active] + k, b[active] + k
        end = (x >= n) | (y >= n)
        d = word[np.minimum(x, n - 1)] ^ word[np.minimum(y, n - 1)]
        stop = (d != 0) | end
        got = np.zeros(len(active), np.int64)
        for j in range(6, 0, -1):
            got += d < np.uint64(1) << np.uint64(9 * j)
        out[active[stop]] = np.minimum(cap, k + np.where(end[stop], 0, got[stop]))
        active = active[~stop]
        k += 7
    return out


def suffix_array(text: np.ndarray, cap: int, memory: int = 256 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of text (characters below 510) in order, and what each has in common with the one before.

    Values are exact up to cap (255 at most) and cap beyond it. A shorter suffix comes before those that it begins.
    """
    n = len(text) + 1
    text = np.append(text.astype(np.int64) + 1, 0)
    if n < 3:
        return np.arange(n - 1), np.zeros(n - 1, np.int16)
    rising = kinds(text)
    seeds = sorted_turns(text, rising, turns(rising), memory)
    common = np.zeros(len(seeds), np.int16)
    common[1:] = _direct(text, seeds[:-1], seeds[1:], cap)
    order, common = induce(text, seeds, ~rising, common, cap, memory)
    fall = ~rising[order]
    falling, common = order[fall], common[fall]
    flipped = np.zeros(len(common), np.int16)
    flipped[1:] = common[1:][::-1]
    order, common = induce(int(text.max()) - text, falling[::-1], rising, flipped, cap, memory)
    values = np.zeros(len(order), np.int16)
    values[1:] = common[1:][::-1]
    return order[::-1], values
