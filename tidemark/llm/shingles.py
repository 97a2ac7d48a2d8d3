"""Word-shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

_rng = np.random.default_rng(20250101)
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_ODD = _rng.integers(0, 2**64, 24, np.uint64) | np.uint64(1)
#: Longer words are hashed by a cryptographic digest, each on its own.
LONG = 64
#: A shingle's hash: 128 bits. h alone orders sets and names shingles in candidates.
SHINGLE = np.dtype([("h", "<u8"), ("g", "<u8")])
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of 64 bits of all words, and the number of words of each text.

    A word's bytes are mixed in eight at a time, which leaves no structure that unlike words could share.
    """
    raw = np.frombuffer(b" ".join(texts) + b" " * 9, np.uint8)
    if lower:
        raw = _LOWER[raw]
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), counts
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    lengths = ends - starts
    eight = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (len(raw) - 7,), (1,))
    with np.errstate(over="ignore"):
        h, g = lengths.astype(np.uint64) * _ODD[3], lengths.astype(np.uint64) * _ODD[4]
        some, k = np.arange(len(starts)), 0
        while len(some):
            x = eight[starts[some] + k] & _MASK[np.minimum(lengths[some] - k, 8)]
            h[some] = mixed(h[some] ^ x)
            g[some] = mixed((g[some] + x) * _ODD[5])
            k += 8
            some = some[lengths[some] > k] if k < LONG else some[:0]
    for w in np.flatnonzero(lengths > LONG).tolist():
        digest = hashlib.blake2b(raw[starts[w] : ends[w]].tobytes(), digest_size=16).digest()
        h[w], g[w] = np.frombuffer(digest, "<u8")
    return h, g, counts


def _distinct(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    order = np.argsort(h)
    out = np.empty(len(h), SHINGLE)
    out["h"], out["g"] = h[order], g[order]
    same = out["h"][1:] == out["h"][:-1]
    if not same.any():
        return out
    if (same & (out["g"][1:] != out["g"][:-1])).any():  # unlike shingles with one first half
        out = out[np.lexsort((out["g"], out["h"]))]
    return out[np.concatenate([[True], (out["h"][1:] != out["h"][:-1]) | (out["g"][1:] != out["g"][:-1])])]


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Shingles that two sets share."""
    if (x["h"][1:] == x["h"][:-1]).any() or (y["h"][1:] == y["h"][:-1]).any():
        return len(set(x.tolist()) & set(y.tolist()))
    _, i, j = np.intersect1d(x["h"], y["h"], assume_unique=True, return_indices=True)
    return int((x["g"][i] == y["g"][j]).sum())


def shingle_sets(texts: list[bytes], n: int = 3, lower: bool = True) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of n words; of fewer words, the whole sequence's."""
    out: list[np.ndarray] = []
    h, g, counts = word_hashes(texts, lower)
    with np.errstate(over="ignore"):
        rolled, other = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
        for k in range(n):
            part, more = h[k:], g[k:]
            rolled[: len(part)] = mixed(rolled[: len(part)] + part) * _ODD[0]
            other[: len(more)] = other[: len(more)] * _ODD[6] + more
        rolled = mixed(rolled)
        end = np.cumsum(counts)
        for e, c in zip(end.tolist(), counts.tolist(), strict=True):
            if c >= n:
                out.append(_distinct(rolled[e - c : e - n + 1], other[e - c : e - n + 1]))
            elif c:
                x, y = (np.array([c], np.uint64) * _ODD[k] for k in (1, 7))
                for w, v in zip(h[e - c : e], g[e - c : e], strict=True):
                    x, y = mixed(x + w) * _ODD[2], mixed(y + v) * _ODD[8]
                out.append(_distinct(mixed(x), y))
            else:
                out.append(np.zeros(0, SHINGLE))
    return out
