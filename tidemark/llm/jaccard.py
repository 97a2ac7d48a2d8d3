"""Exact Jaccard join of documents' word-shingle sets, by adaptive multi-match prefixes.

All shingles are set in one global order, rare ones first. A set of n shingles whose partners share at least
o = ceil(percent * n / 100) of them has, for any l, the l-prefix of its first n - o + l shingles, and two linked
sets share at least l shingles of their l-prefixes. l = 1 is the usual prefix filter. Each set picks its own l: a
third of n - o, or more where a longer prefix costs less, since fewer candidates come through it; two sets with
different l are held to the smaller. Only pairs that share so many prefix shingles are verified. Sets equal as
a whole are one class from the start.

Links are found in three rounds. The first pairs each class of a shingle's group with the group's first class
only, so a group of m alike classes costs m pairs; the second keeps a few partners of each class; the third
takes all pairs. After each round the verified links give components, and the next one pairs no classes within a
component: what the last round adds is all that could still change them. Pairs are counted shingle by shingle,
while a shingle's group is small. A class in larger groups takes along the list of its shingles of this kind, and
such a group counts them all at once, at a pair's first common one, and hands on what may pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, joined, release, table
from tidemark.llm.shingles import common, mixed, shingle_sets

#: The frequency sketch has 2**SKETCH_BITS counters, at any size of input; it decides costs, never results.
SKETCH_BITS = 21
#: Multiples of the least number of shared prefix shingles that a set tries, and the cost of one more candidate
#: against one more posting.
MULTIPLES, VERIFY = (1, 2, 4, 8, 16), 60.0
#: A shingle's group is large beyond so many classes; still larger ones are dealt in blocks of so many classes, a
#: task for each pair of blocks.
LARGE, BLOCK = 128, 2048
#: Bytes are dealt to a part for each 2,000,000 distinct shingles of documents, and to so many parts at least; the
#: number follows the data, not the session's partitions, since parts send rows to parts.
LEAST_PARTS = 24
#: Partners that the second round keeps for each class.
FEW = 8
#: Bits of the Bloom filter that spares the shuffle sets which no candidate pair needs.
BLOOM_BITS = 26
#: A shingle of a set that is sent to be verified: 96 bits of its hash.
SENT = np.dtype([("h", "<u8"), ("g", "<u4")])
#: A task of the components takes so many links at least.
LINKS = 1 << 18
_ROWS = "part int, kind int, data binary"
_POSTING = np.dtype([("t", "<u8"), ("c", "<u8")])
_CLASS = np.dtype([("c", "<u8"), ("n", "<i8"), ("l", "<i8")])
_LIVE = np.dtype([("c", "<u8"), ("t", "<u8"), ("m", "<i8")])
_LABEL = np.dtype([("c", "<u8"), ("label", "<u8")])
_MEMBER = np.dtype([("t", "<u8"), ("pair", "<i8"), ("own", "<i8"), ("c", "<u8"), ("label", "<u8"), ("n", "<i8"), ("l", "<i8"), ("cold", "<i8"), ("m", "<i8"), ("size", "<i8")])
_PAIR = np.dtype([("a", "<u8"), ("b", "<u8"), ("count", "<i4"), ("need", "<i4")])


#: Classes that share the first half of their digests; these go by the second half.
Taken = frozenset[int]


def halves(s: np.ndarray) -> tuple[int, int]:
    """A set's digest of 128 bits in two halves; zeros for the empty set."""
    if not len(s):
        return 0, 0
    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little") or 1, int.from_bytes(digest[8:], "little") or 1


def class_of(s: np.ndarray, taken: Taken) -> int:
    """The name of a set's class."""
    first, second = halves(s)
    return second if first in taken else first


def _key(doc_id: F.Column) -> F.Column:
    return F.coalesce(doc_id, F.lit(-(2**63)))  # a null id


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    """The set of each text, about 256 kB of text at a time."""
    block, size = [], 0
    for t in batch.column(1):
        block.append((t.as_py() or "").encode())
        size += len(block[-1])
        if size >= 1 << 18:
            yield from shingle_sets(block, words)
            block, size = [], 0
    yield from shingle_sets(block, words)


def _rows(parts: list[int], kinds: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], ["part", "kind", "data"])


def _dealt(kind: int, part: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
    """One row of bytes for each part."""
    if not len(part):
        return [], [], []
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    ends = np.append(at[1:], len(part))
    return part[at].tolist(), [kind] * len(at), [rows[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)]


def _joined(table: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    got = [d for k, d in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True) if k == kind]
    return np.frombuffer(b"".join(got), dtype)


def document_classes(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame, Taken, bytes, int]:
    """(doc_id, hash, n, class) of each document; (class, doc, least, docs) of each class; classes that go by the second
    half of their digests; the sketch, a byte for each counter; all distinct shingles' number.

    Each task counts in an array of bounded size; the arrays are summed in slices, and what comes to the driver
    is the logarithms, one byte for each counter whatever the size of the input.
    """
    slices = 32
    width = (1 << SKETCH_BITS) // slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << SKETCH_BITS, np.uint32), set()
        schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            ids, n, own = batch.column(0), [], []
            for s in _sets(batch, words):
                c = halves(s)
                n.append(len(s))
                own.append(c)
                if c not in seen and len(s):
                    if len(seen) < 50_000:
                        seen.add(c)
                    np.add.at(counts, (s["h"] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            none, digests = pa.nulls(len(n), pa.int32()), np.array(own, np.uint64).reshape(-1, 2).T.copy().view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(n, pa.int64()), pa.array(digests[0]), pa.array(digests[1]), none, pa.nulls(len(n), pa.binary())], schema=schema)
        if counts.any():
            data = [pa.compress(counts[k * width : (k + 1) * width].tobytes(), "zstd", asbytes=True) for k in range(slices)]
            empty = pa.nulls(slices, pa.int64())
            yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, empty, pa.array(range(slices), pa.int32()), pa.array(data, pa.binary())], schema=schema)

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for d in t.column("counts").to_pylist():
            total += np.frombuffer(pa.decompress(d, width * 4, "zstd", asbytes=True), np.uint32)
        logs = np.minimum(255, np.floor(8 * np.log2(1 + total))).astype(np.uint8)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "logs": pa.array([logs.tobytes()], pa.binary()), "total": pa.array([int(total.sum())], pa.int64())})

    all_rows = cut(docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, hash long, n long, first long, second long, slice int, counts binary"))
    got = all_rows.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(add, "slice int, logs binary, total long").collect()  # 32 rows of 64 kB
    sketch = b"".join(bytes(r["logs"]) for r in sorted(got, key=lambda r: r["slice"]))
    taken: set[int] = set()
    while True:
        name = F.when(F.col("first").isin(list(taken)), F.col("second")).otherwise(F.col("first")) if taken else F.col("first")
        own = all_rows.where("slice is null").select("doc_id", "hash", "n", "second", name.alias("class"))
        classes = cut(own.groupBy("class").agg(F.min(_key(F.col("doc_id"))).alias("doc"), F.min("doc_id").alias("least"), F.count("*").alias("docs"), F.max("n").alias("n"), F.min("second").alias("low"), F.max("second").alias("high")))
        double = classes.where("low <> high").select("class").collect()  # by chance: rows^2 / 2^65 of them
        if not double:
            return own.drop("second"), classes, frozenset(c & (1 << 64) - 1 for c in taken), sketch, sum(r["total"] for r in got)
        taken |= {r["class"] for r in double}


def prefix(s: np.ndarray, logs: np.ndarray, mean: float, percent: int) -> tuple[np.ndarray, int]:
    """A set's prefix in the global order, and the number of shared shingles that it asks for."""
    n, s = len(s), s["h"]
    freq = logs[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((s, freq))
    free = n - -(-percent * n // 100)
    base = max(1, free // 3)
    cost = np.cumsum(np.maximum(0.0, np.exp2(freq[order[: free + MULTIPLES[-1] * base]].astype(np.float64) / 8) - 1 - 1.5 * mean - 8))
    best, l = None, min(base, n - free)
    for k in (base * x for x in MULTIPLES):
        if free + k > n:
            break
        c = cost[free + k - 1] * (1 + VERIFY / k)
        if best is None or c < 0.8 * best:
            best, l = c, k
    return s[order[: free + l]], l


def live_postings(docs: DataFrame, words: int, percent: int, taken: Taken, sketch: bytes, total: int, parts: int) -> DataFrame:
    """Rows of bytes by class: its numbers (kind 1), and its prefix shingles that another class has too (kind 0)."""
    mean = total / (1 << SKETCH_BITS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, seen = np.frombuffer(sketch, np.uint8), set()
        for batch in batches:
            tokens, owners, numbers = [], [], []
            for s in _sets(batch, words):
                c = class_of(s, taken)
                if not c or c in seen:
                    continue
                if len(seen) < 50_000:
                    seen.add(c)
                p, l = prefix(s, logs, mean, percent)
                tokens.append(p)
                owners.append(np.full(len(p), c, np.uint64))
                numbers.append((c, len(s), l))
            if tokens:
                rows = np.empty(sum(map(len, tokens)), _POSTING)
                rows["t"], rows["c"] = np.concatenate(tokens), np.concatenate(owners)
                yield _rows(*_dealt(0, (mixed(rows["t"]) % np.uint64(parts)).astype(np.int64), rows))
                own = np.array(numbers, _CLASS)
                yield _rows(*_dealt(1, (own["c"] % np.uint64(parts)).astype(np.int64), own))

    def keep(t: pa.Table) -> pa.Table:
        rows = _joined(t, 0, _POSTING)
        rows = rows[np.lexsort((rows["c"], rows["t"]))]
        if len(rows):
            rows = rows[np.concatenate([[True], (rows["t"][1:] != rows["t"][:-1]) | (rows["c"][1:] != rows["c"][:-1])])]
            at = np.flatnonzero(np.concatenate([[True], rows["t"][1:] != rows["t"][:-1]]))
            m = np.repeat(np.diff(np.append(at, len(rows))), np.diff(np.append(at, len(rows))))
            live = np.empty(int((m > 1).sum()), _LIVE)
            live["c"], live["t"], live["m"] = rows["c"][m > 1], rows["t"][m > 1], m[m > 1]
        else:
            live = np.zeros(0, _LIVE)
        own = _joined(t, 1, _CLASS)
        a, b = (_dealt(k, (x["c"] % np.uint64(parts)).astype(np.int64), x) for k, x in ((0, live), (1, own)))
        return pa.Table.from_batches([_rows(*(x + y for x, y in zip(a, b, strict=True)))])

    return docs.mapInArrow(send, _ROWS).groupBy("part").applyInArrow(keep, _ROWS)


def _pack(members: np.ndarray, lists: list[np.ndarray], part: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    order = np.argsort(part, kind="stable")
    parts, data, k = [], [], 0
    while k < len(order):
        e = k
        while e < len(order) and part[order[e]] == part[order[k]]:
            e += 1
        own = order[k:e]
        body = b"".join(lists[i].tobytes() for i in own)
        parts.append(int(part[order[k]]))
        data.append(len(own).to_bytes(8, "little") + members[own].tobytes() + body)
        k = e
    return _rows(parts, [kind] * len(parts), data)


_NONE = np.zeros(0, np.uint64)


def needed(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Shared prefix shingles that linked sets with these numbers have at least."""
    overlap = -(-percent * (x["n"] + y["n"]) // (100 + percent))
    return overlap + np.minimum(x["l"] + (-percent * x["n"] // 100), y["l"] + (-percent * y["n"] // 100))


def _large(members: np.ndarray, lists: list[np.ndarray], percent: int, few: bool) -> np.ndarray:
    """Pairs of one large group that may pass, with the number of shingles of large groups that they share.

    Only pairs that share no earlier such shingle.
    """
    m, t, n, label, own = len(members), members["t"][0], members["n"], members["label"], members["own"]
    two = members["pair"][0] >> 32 != members["pair"][0] & 0xFFFFFFFF
    flat, who = np.concatenate(lists), np.repeat(np.arange(m), [len(x) for x in lists])
    u, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    used = count > 1
    u, column, ok = u[used], np.cumsum(used) - 1, used[inverse]
    who, column = who[ok], column[inverse[ok]]
    shared, before = np.zeros((m, m), np.float32), np.zeros((m, m), np.float32)
    split = int(np.searchsorted(u, t))
    for lo, hi, early in ((0, split, True), (split, len(u), False)):
        for k in range(lo, hi, 4096):
            e = min(hi, k + 4096)
            x = np.zeros((m, e - k), np.float32)
            some = (column >= k) & (column < e)
            x[who[some], column[some] - k] = 1
            got = x @ x.T
            shared += got
            if early:
                before += got
    left, right = [], []
    for i in range(m - 1):
        j = np.arange(i + 1, m)
        ok = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (label[i] != label[j]) & (before[i, j] == 0)
        ok &= shared[i, j] + np.minimum(members["cold"][i], members["cold"][j]) >= needed(members[i], members[j], percent)
        if two:
            ok &= own[i] != own[j]
        j = j[ok][:FEW] if few else j[ok]
        left.append(np.full(len(j), i, np.int32))
        right.append(j.astype(np.int32))
    i, j = np.concatenate(left), np.concatenate(right)
    c = members["c"]
    got = np.empty(len(i), _PAIR)
    got["a"], got["b"] = np.minimum(c[i], c[j]), np.maximum(c[i], c[j])
    got["count"], got["need"] = shared[i, j], needed(members[i], members[j], percent)
    return got


def _pairs(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    ok = (100 * np.minimum(x["n"], y["n"]) >= percent * np.maximum(x["n"], y["n"])) & (x["label"] != y["label"])
    x, y = x[ok], y[ok]
    got = np.empty(len(x), _PAIR)
    got["a"], got["b"] = np.minimum(x["c"], y["c"]), np.maximum(x["c"], y["c"])
    got["count"], got["need"] = 1, needed(x, y, percent)
    return got


def _small(members: np.ndarray, starts: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """All pairs of small groups, each counted once for the group's shingle; groups of one size at a time."""
    out = [np.zeros(0, _PAIR)]
    for size in np.unique(sizes).tolist():
        if size < 2:
            continue
        at = starts[sizes == size][:, None] + np.arange(size)[None]
        i, j = np.triu_indices(size, 1)
        for block in np.array_split(at, max(1, at.shape[0] * len(i) // 150_000)):
            out.append(_pairs(members[block[:, i].ravel()], members[block[:, j].ravel()], percent))
    return np.concatenate(out)


def _summed(pairs: np.ndarray) -> np.ndarray:
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    at = np.flatnonzero(np.concatenate([[True], (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])]))
    out = pairs[at].copy()
    out["count"] = np.add.reduceat(pairs["count"], at)
    return out


def candidates(live: DataFrame, labels: DataFrame | None, percent: int, parts: int, way: str) -> DataFrame:
    """Pairs (a, b) of classes that pass the filters, none within a label: by way of "stars" those with the first
    class of a shingle's group, of "few" a few for each class, of "all" all."""
    stars, few = way == "stars", way == "few"

    def deal(t: pa.Table) -> pa.Table:
        own, rows, said = _joined(t, 1, _CLASS), _joined(t, 0, _LIVE), _joined(t, 2, _LABEL)
        if not len(rows):
            return pa.Table.from_batches([_rows([], [], [])])
        own = own[np.unique(own["c"], return_index=True)[1]]
        at = np.searchsorted(own["c"], rows["c"])
        label = rows["c"].copy()
        if len(said):
            said = said[np.argsort(said["c"])]
            k = np.minimum(np.searchsorted(said["c"], rows["c"]), len(said) - 1)
            label = np.where(said["c"][k] == rows["c"], said["label"][k], label)
        order = np.lexsort((rows["t"], rows["c"]))
        rows, at, label = rows[order], at[order], label[order]
        starts = np.flatnonzero(np.concatenate([[True], rows["c"][1:] != rows["c"][:-1]]))
        ends, large = np.append(starts[1:], len(rows)), rows["m"] > LARGE
        cold = np.repeat(np.add.reduceat(~large, starts, dtype=np.int64), ends - starts)
        whole = {int(rows["c"][a]): rows["t"][a:b][large[a:b]] for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if large[a:b].any()}
        members = np.empty(len(rows), _MEMBER)
        for f in ("t", "c"):
            members[f] = rows[f]
        members["label"], members["n"], members["l"], members["pair"] = label, own["n"][at], own["l"][at], 0
        members["cold"], members["m"] = cold, rows["m"]
        blocks = -(-rows["m"] // BLOCK)
        members["own"] = (mixed(rows["c"] ^ rows["t"]) % blocks.astype(np.uint64)).astype(np.int64)
        hot = (blocks > 1) & (not stars)
        if hot.any():  # a copy for each pair of blocks that has the member's own
            some, b = members[hot], blocks[hot]
            copies, other = np.repeat(some, b), np.concatenate([np.arange(x) for x in b])
            copies["pair"] = np.minimum(copies["own"], other) << 32 | np.maximum(copies["own"], other)
            members = np.concatenate([members[~hot], copies])
        lists = [whole[c] if m > LARGE and not stars else _NONE for c, m in zip(members["c"].tolist(), members["m"].tolist(), strict=True)]
        members["size"] = [len(x) for x in lists]
        part = (mixed(members["t"] + members["pair"].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        return pa.Table.from_batches([_pack(members, lists, part)])

    def pair(t: pa.Table) -> pa.Table:
        heads, lists = [], []
        for d in t.column("data").to_pylist():
            k = int.from_bytes(d[:8], "little")
            h = np.frombuffer(d, _MEMBER, k, 8)
            tokens = np.frombuffer(d, np.uint64, -1, 8 + h.nbytes)
            heads.append(h)
            lists += np.split(tokens, np.cumsum(h["size"])[:-1])
        pairs = [np.zeros(0, _PAIR)]
        if heads:
            members = np.concatenate(heads)
            order = np.lexsort((members["c"], members["n"], members["pair"], members["t"]))
            members = members[order]
            at = np.flatnonzero(np.concatenate([[True], (members["t"][1:] != members["t"][:-1]) | (members["pair"][1:] != members["pair"][:-1])]))
            sizes = np.diff(np.append(at, len(members)))
            if stars:
                first = np.repeat(at, sizes)
                rest = np.flatnonzero(first != np.arange(len(members)))
                pairs.append(_pairs(members[first[rest]], members[rest], percent))
                at = at[:0]
            large, sizes = members["m"][at] > LARGE, sizes[: len(at)]
            pairs.append(_small(members, at[~large], sizes[~large], percent))
            for s, size in zip(at[large].tolist(), sizes[large].tolist(), strict=True):
                own = members[s : s + size]
                if size > 1 and (own["label"] != own["label"][0]).any():
                    pairs.append(_large(own, [lists[k] for k in order[s : s + size]], percent, few))
        got = _summed(np.concatenate(pairs))
        return pa.Table.from_batches([_rows(*_dealt(0, (mixed(got["b"]) % np.uint64(parts)).astype(np.int64), got))])

    def count(t: pa.Table) -> pa.Table:
        got = _summed(_joined(t, 0, _PAIR))
        got = got[got["count"] >= got["need"]]
        if few:
            got = got[np.lexsort((mixed(got["a"] + mixed(got["b"])), got["b"]))]
            first = np.concatenate([[True], got["b"][1:] != got["b"][:-1]]) if len(got) else np.zeros(0, bool)
            place = np.arange(len(got)) - np.maximum.accumulate(np.where(first, np.arange(len(got)), 0)) if len(got) else np.zeros(0, int)
            got = got[place < FEW]
        return pa.table({"a": got["a"].copy().view(np.int64), "b": got["b"].copy().view(np.int64)})

    rows = live
    if labels is not None:

        def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.empty(batch.num_rows, _LABEL)
                for f, k in (("c", 0), ("label", 1)):
                    x[f] = batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64)
                yield _rows(*_dealt(2, (x["c"] % np.uint64(parts)).astype(np.int64), x))

        rows = live.unionByName(labels.select("node", "label").mapInArrow(say, _ROWS))
    return rows.groupBy("part").applyInArrow(deal, _ROWS).groupBy("part").applyInArrow(pair, _ROWS).groupBy("part").applyInArrow(count, "a long, b long")


def verified(docs: DataFrame, classes: DataFrame, taken: Taken, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose sets are linked indeed.

    Sets are made anew, for one document of each class in a pair; a Bloom filter of these documents' ids spares
    the others, and what it lets through wrongly finds no pair to join.
    """
    of_a, of_b = (classes.select(F.col("class").alias(k), F.col("doc").alias(f"{k}_doc")) for k in "ab")
    pairs = cut(pairs.join(of_a, "a").join(of_b, "b").select("a_doc", "b_doc", "a", "b"))
    size = 1 << BLOOM_BITS
    spread = lambda ids: mixed(ids.view(np.uint64)) >> np.uint64(64 - BLOOM_BITS)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices, seen = {}, np.zeros(0, np.uint64)
        for batch in batches:
            seen = np.union1d(seen, spread(np.concatenate([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])))
        for s in range(64):
            at = seen[(seen >= s * (size // 64)) & (seen < (s + 1) * (size // 64))] - np.uint64(s * (size // 64))
            if len(at):
                slices[s] = np.packbits(np.bincount(at.astype(np.int64), minlength=size // 64).astype(bool)).tobytes()
        yield _rows(list(slices), [0] * len(slices), [pa.compress(x, "zstd", asbytes=True) for x in slices.values()])

    def either(key: tuple, t: pa.Table) -> pa.Table:
        out = np.zeros(size // 512, np.uint8)
        for d in t.column("data").to_pylist():
            out |= np.frombuffer(pa.decompress(d, len(out), "zstd", asbytes=True), np.uint8)
        return pa.Table.from_batches([_rows([key[0].as_py()], [0], [pa.compress(out.tobytes(), "zstd", asbytes=True)])])

    filled = pairs.mapInArrow(bits, _ROWS).groupBy("part").applyInArrow(either, _ROWS).collect()  # 8 MB at most
    bloom = {r["part"]: bytes(r["data"]) for r in filled}

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = np.zeros(size // 8, np.uint8)
        for s, d in bloom.items():
            has[s * (size // 512) : (s + 1) * (size // 512)] = np.frombuffer(pa.decompress(d, size // 512, "zstd", asbytes=True), np.uint8)
        for batch in batches:
            bit = spread(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            batch = batch.filter(pa.array((has[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)))
            made = list(_sets(batch, words))
            c = np.array([class_of(s, taken) for s in made], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c, pa.int64()), pa.array([s.astype(SENT).tobytes() for s in made], pa.binary())], ["doc", "c", "s"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, SENT), np.frombuffer(y, SENT)
                both = common(x, y)
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    got = docs.select(_key(F.col("doc_id")).alias("doc"), "text").mapInArrow(sets, "doc long, c long, s binary")
    x, y = got.alias("x"), got.alias("y")
    left = pairs.join(x, (F.col("a") == F.col("x.c")) & (F.col("a_doc") == F.col("x.doc"))).select("a", "b", "b_doc", F.col("x.s").alias("s1"))
    both = left.join(y, (F.col("b") == F.col("y.c")) & (F.col("b_doc") == F.col("y.doc"))).select("a", "b", "s1", F.col("y.s").alias("s2"))
    return cut(both.mapInArrow(linked, "a long, b long").distinct())


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (u, v) of a task as stars, about LINKS of them at a time: a node and the smallest that they reach."""

    def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        u, v, top = at[: len(u)], at[len(u) :], np.arange(len(nodes))
        while True:
            low = top.copy()
            np.minimum.at(low, u, top[v])
            np.minimum.at(low, v, top[u])
            np.minimum.at(low, top, low[np.arange(len(top))])
            low = low[low]
            if (low == top).all():
                break
            top = low
        some = top != np.arange(len(top))
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[top[some]])], ["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        if sum(len(u) for u, _ in held) >= LINKS:
            yield stars(*map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        yield stars(*map(np.concatenate, zip(*held, strict=True)))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b); label is the component's smallest node.

    Each task first reduces its links to stars, so that few are left. Then large stars and small stars in turn until
    nothing changes; each round is cut off by a checkpoint. No component is gathered in one place: a round takes
    minima by node and joins them back.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks = max(4, links.count() // LINKS)
    now, before = cut(links.coalesce(tasks).mapInArrow(contracted, "u long, v long").distinct()), None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(least, F.col("u") == F.col("k"))
        now = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.union(stars.select(F.col("label").alias("node"), "label").distinct())


def relabelled(near: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) after more links."""
    if near is None:
        return cut(components(links))
    at = lambda side: near.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    over = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    more = cut(components(over))
    moved = near.join(more.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return cut(moved.unionByName(more.join(near, "node", "left_anti").select("node", "label")))


def similar_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, hash (of the text), n_shingles, component_id, component for each row of docs.

    Words are runs of other than space and \\t to \\r, lower-cased from A to Z; a document's set has the hashes
    of its runs of ``words`` words, or of its whole sequence if that is shorter. Documents are linked when
    100 * intersection >= percent * union; component_id is the smallest doc_id that links reach, component a number
    that tells components apart whatever their ids. Empty and null
    texts have no shingles and are linked with nothing. Repeated rows are documents of one class. A null doc_id
    stays null, and its component_id is the smallest other one, if any. An empty table gives an empty result.
    Every document, shingle and linked pair counts; neither groups nor partners are capped. Words and sets are
    compared by hashes of 128 bits, shingles by 96; candidates are sought by the first half of shingles' (two shingles of one
    set that share a half would count as one there: a chance of 10^-11 for a set of 10,000).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own, classes, taken, sketch, total = document_classes(docs, words)
    parts = max(LEAST_PARTS, total // 2_000_000)
    live = cut(live_postings(docs, words, percent, taken, sketch, total, parts))
    near = None
    for way in ("stars", "few", "all"):
        near = relabelled(near, verified(docs, classes, taken, candidates(live, near, percent, parts, way), words, percent))
        release(docs.sparkSession)
    labelled = cut(classes.where("n > 0").join(near.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("label", F.coalesce("label", "class")))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("of"))
    n_classes, n_docs = labelled.agg(F.count("*"), F.coalesce(F.sum("docs"), F.lit(0))).first()
    found = joined(labelled.select("class", "docs", "label"), least, ["label"], n_classes).select("class", "component_id", F.col("label").alias("component"), F.col("docs").alias("of"))
    linked = joined(own.where("n > 0"), cut(found), ["class"], n_docs).select("doc_id", "hash", F.col("n").alias("n_shingles"), "component_id", "component")
    return linked.unionByName(own.where("n = 0").select("doc_id", "hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of all documents: shingles of three words, links of 0.9 or more."""
    return similar_components(table(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op2_jaccard_join": op2_jaccard_join}
ORACLES: dict[str, str] = {}
