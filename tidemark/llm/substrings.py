"""Exact removal of repeated byte strings by suffix arrays, dealt out by anchors.

A string of ``length`` bytes has an *anchor*: the smallest of the hashed ANCHOR-grams in it. Equal strings have
it at equal places, so places need to be compared within an anchor's hash alone. The strings in a row with the
same anchor form a *context*, a short stretch of text. Of equal contexts the first stands for all, and the
others are repeats as a whole. First contexts whose anchor has other contexts too go to a shard by the anchor's
hash; the shard's suffix array (``induced``) has equal strings side by side, and all but the earliest go.

A shard is sorted in runs of a few MB, in memory. Contexts of an anchor that don't fit a run are split by the bytes
around it (``split_hot``), so that equal strings stay together, until each part fits. Text is shuffled twice, to cut
the contexts out of it and to join documents to shards' results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, partitions, table
from tidemark.llm.induced import suffix_array
from tidemark.llm.shingles import _BYTE, mixed

ANCHOR = 32
#: Bytes of text that are hashed at once, contexts that a task holds, and bytes of a shard sorted at once at most.
CHUNK, HELD, SORTED = 1 << 19, 1_000_000, 4 << 20
_CONTEXT = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("size", "<u2"), ("anchor", "<u2")])
_SPAN = np.dtype([("doc", "<i8"), ("at", "<i4"), ("end", "<i4")])
_WANT = np.dtype([("doc", "<i8"), ("at", "<i4"), ("size", "<u2"), ("anchor", "<u2"), ("h", "<u8")])
_ROWS = "part int, kind int, data binary"
_U = np.uint64


def contexts(raw: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the anchor, hash of the context, start, end and place of the anchor, of each context in raw.

    valid[s] tells whether the string at s counts; raw has 64 bytes more than the last counting string.
    """
    grams = {1: _BYTE[raw]}
    k = 1
    while k < 64:
        g = grams[k]
        n = len(g) - k
        h = g[:n] * _U(0x9E3779B97F4A7C15)
        h += g[k:]
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(32)
        k *= 2
        grams[k] = h
    own, whole = grams[ANCHOR], grams[64]
    w, n = length - ANCHOR + 1, len(raw) - length + 1
    low = (own[: n + w - 1] & _U(0xFFFFFFFF00000000)) | np.arange(n + w - 1, dtype=np.uint64)
    k = 1
    while 2 * k <= w:
        low = np.minimum(low[: len(low) - k], low[k:])
        k *= 2
    if k < w:
        low = np.minimum(low[: len(low) - (w - k)], low[w - k :])
    valid = valid[:n]
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new & valid)
    stops = np.append(np.flatnonzero(new | ~valid), n)
    end = stops[np.searchsorted(stops, start, side="right")] + length - 1
    at = (low[start] & _U(0xFFFFFFFF)).astype(np.int64)
    size = end - start
    c = (size * 256 + (at - start)).astype(np.uint64)
    for k in range(0, 2 * length - ANCHOR, 64):  # stretches of 64 that cover the context
        c = mixed(c * _U(0x9E3779B97F4A7C15) + whole[np.minimum(start + k, end - 64)])
    return own[at], c, start, end, at


def _rows(parts: list[int], kind: int, data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([kind] * len(parts), pa.int32()), pa.array(data, pa.binary())], ["part", "kind", "data"])


def _deal(rows: np.ndarray, part: np.ndarray, kind: int) -> pa.RecordBatch:
    if not len(part):
        return _rows([], kind, [])
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    ends = np.append(at[1:], len(part)).tolist()
    return _rows(part[at].tolist(), kind, [rows[a:b].tobytes() for a, b in zip(at.tolist(), ends, strict=True)])


def _of(t: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(d for k, d in zip(t.column("kind").to_pylist(), t.column("data").to_pylist(), strict=True) if k == kind), dtype)


def _doc_part(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(doc.view(np.uint64)) % _U(parts)).astype(np.int64)


def _grouped(h: np.ndarray) -> np.ndarray:
    """Number of the run of equal values that each value is in."""
    return np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1 if len(h) else np.zeros(0, np.int64)


def _merged(spans: np.ndarray) -> np.ndarray:
    """Spans in order, those that touch or overlap joined."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["at"], spans["doc"]))]
    first = np.concatenate([[True], spans["doc"][1:] != spans["doc"][:-1]])
    group = np.cumsum(first) - 1
    reach = np.maximum.accumulate(spans["end"].astype(np.int64) + (group << 32)) - (group << 32)
    new = first.copy()
    new[1:] |= spans["at"][1:] > reach[:-1]
    at = np.flatnonzero(new)
    out = spans[at].copy()
    out["end"] = reach[np.append(at[1:], len(spans)) - 1]
    return out


def _first_contexts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of equal contexts, and the spans of the others. Rows that are the same place count once."""
    rows = rows[np.lexsort((rows["at"], rows["doc"], rows["c"], rows["h"]))]
    if not len(rows):
        return rows, np.zeros(0, _SPAN)
    new = np.ones(len(rows), bool)
    new[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["c"][1:] != rows["c"][:-1])
    rest = rows[~new]
    spans = np.empty(len(rest), _SPAN)
    spans["doc"], spans["at"], spans["end"] = rest["doc"], rest["at"], rest["at"] + rest["size"]
    return rows[new], spans


def find_contexts(docs: DataFrame, length: int, parts: int, crowd: int = HELD >> 10, hot: np.ndarray | None = None) -> DataFrame:
    """Rows of bytes: first contexts of each task by anchor (kind 0), repeats within the task by document (1).

    An anchor with more than ``crowd`` first contexts at once would fill its part, so these are dealt by the whole
    context (3), and the anchor's own part is told of it (4).

    With ``hot``, sorted hashes of anchors: only their first contexts, packed with text (3), and the repeats (1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        pieces: dict[tuple[int, int], bytes] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                rows, spans = _first_contexts(np.concatenate(held))
                held.clear()
                if hot is not None:
                    want = _wanted(rows)
                    yield _pack(want, [pieces[k] for k in zip(want["doc"].tolist(), want["at"].tolist(), strict=True)], (mixed(want["h"]) % _U(parts)).astype(np.int64), 3)
                    yield _deal(spans := _merged(spans), _doc_part(spans["doc"], parts), 1)
                    pieces.clear()
                    return
                group = _grouped(rows["h"])
                many = np.bincount(group)[group] > crowd
                rows, far = rows[~many], rows[many]
                yield _deal(rows, (mixed(rows["h"]) % _U(parts)).astype(np.int64), 0)
                yield _deal(far, (mixed(far["h"] ^ far["c"]) % _U(parts)).astype(np.int64), 3)
                marks = np.unique(far["h"])
                yield _deal(marks, (mixed(marks) % _U(parts)).astype(np.int64), 4)
                yield _deal(spans := _merged(spans), _doc_part(spans["doc"], parts), 1)

        for batch in batches:
            keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, np.int64)
            block, total = [], 0
            for k, size in enumerate(sizes.tolist()):
                if size >= length:
                    block.append(k)
                    total += size
                if block and (total >= CHUNK or k + 1 == len(sizes)):
                    data = [texts[j].as_py().encode() for j in block]
                    raw = np.frombuffer(b"".join(data) + bytes(length + 64), np.uint8)
                    ends = np.cumsum([len(d) for d in data])
                    starts = ends - [len(d) for d in data]
                    valid = np.zeros(len(raw), bool)
                    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                        valid[a : b - length + 1] = True
                    h, c, start, end, anchor = contexts(raw, valid, length)
                    at = np.searchsorted(ends, start, side="right")
                    rows = np.empty(len(h), _CONTEXT)
                    rows["h"], rows["c"], rows["doc"], rows["at"], rows["size"] = h, c, keys[np.array(block)][at], start - starts[at], end - start
                    rows["anchor"] = anchor - start
                    if hot is not None:
                        some = np.isin(rows["h"], hot)
                        rows = rows[some]
                        for doc, place, a, b in zip(rows["doc"].tolist(), rows["at"].tolist(), start[some].tolist(), end[some].tolist(), strict=True):
                            pieces[doc, place] = raw[a:b].tobytes()
                    held.append(rows)
                    block, total = [], 0
                    if sum(map(len, held)) >= (HELD if hot is None else HELD // 8):
                        yield from flush()
        yield from flush()

    return docs.mapInArrow(run, _ROWS)


def compare_contexts(found: DataFrame, parts: int, most: int) -> DataFrame:
    """Rows of bytes by document: repeats (kind 1), and contexts that a shard must look at (kind 2).

    Of anchors with more than ``most`` bytes of contexts, or dealt by context, there is just the hash (3).
    """

    def run(t: pa.Table) -> pa.Table:
        rows, spans = _first_contexts(_of(t, 0, _CONTEXT))
        far, more = _first_contexts(_of(t, 3, _CONTEXT))
        spans = _merged(np.concatenate([spans, more, _of(t, 1, _SPAN)]))
        group = _grouped(rows["h"])
        hot = (np.bincount(group, rows["size"])[group] > most) | np.isin(rows["h"], _of(t, 4, np.dtype("<u8")))
        out = [_deal(spans, _doc_part(spans["doc"], parts), 1)]
        want = _wanted(rows[~hot & (np.bincount(group)[group] > 1)])
        out.append(_deal(want, _doc_part(want["doc"], parts), 2))
        out.append(_rows([0], 3, [np.unique(np.concatenate([rows["h"][hot], far["h"]])).tobytes()]) if hot.any() or len(far) else _rows([], 3, []))
        return pa.Table.from_batches(out)

    return found.groupBy("part").applyInArrow(run, _ROWS)


def _wanted(rows: np.ndarray) -> np.ndarray:
    want = np.empty(len(rows), _WANT)
    for name in _WANT.names:
        want[name] = rows[name]
    return want


def _pack(want: np.ndarray, pieces: list[bytes], part: np.ndarray, kind: int) -> pa.RecordBatch:
    order = np.argsort(part, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]])) if len(order) else order
    out, data = [], []
    for a, b in zip(at.tolist(), np.append(at[1:], len(order)).tolist(), strict=True) if len(at) else ():
        own = order[a:b]
        out.append(int(part[own[0]]))
        data.append(len(own).to_bytes(8, "little") + want[own].tobytes() + b"".join(pieces[i] for i in own))
    return _rows(out, kind, data)


def _unpack(data: bytes) -> tuple[np.ndarray, bytes]:
    want = np.frombuffer(data, _WANT, int.from_bytes(data[:8], "little"), 8)
    return want, data[8 + want.nbytes :]


def cut_pieces(texts: DataFrame, wanted: DataFrame, parts: int) -> DataFrame:
    """Rows of bytes by anchor: the contexts that shards look at, with their text."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        want = _of(right, 2, _WANT)
        if not len(want) or not left.num_rows:
            return pa.Table.from_batches([_rows([], 0, [])])
        want = want[np.argsort(want["doc"], kind="stable")]
        row_of = {k: i for i, k in enumerate(left.column("key").to_pylist())}
        column, pieces = left.column("text").combine_chunks(), [b""] * len(want)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
        last, text = None, b""
        for i, (doc, at, size) in enumerate(zip(want["doc"].tolist(), want["at"].tolist(), want["size"].tolist(), strict=True)):
            if doc != last:
                text, last = column[row_of[doc]].as_py().encode(), doc
            pieces[i] = text[at : at + size]
        part = (mixed(want["h"]) % _U(parts)).astype(np.int64)
        return pa.Table.from_batches([_pack(want, pieces, part, 0)])

    return texts.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(run, _ROWS)


def _splits(data: bytes, length: int, full: dict[bytes, tuple[int, int]]) -> Iterator[tuple[bytes, int, int, int, int, int, int, bytes]]:
    """Stretches of packed contexts: key, first and last place of the anchor in a string, depth, document, place, anchor, text.

    A stretch holds a context's strings whose anchor is at one of these places. All of them cover the bytes that
    make the key, so equal strings have equal keys. A key in ``full`` is split in halves of the places; one of a
    single place covers the whole string and is not split.
    """
    want, raw = _unpack(data)
    begin = 0
    for doc, at, size, anchor, _ in want.tolist():
        text = raw[begin : begin + size]
        begin += size
        todo = [(0, length - ANCHOR, 0)]
        while todo:
            low, high, depth = todo.pop()
            a, b = anchor - min(high, anchor), anchor - max(low, anchor - size + length) + length
            if b - a < length:
                continue
            key = hashlib.blake2b(bytes([low, high]) + text[anchor - low : anchor - high + length], digest_size=16).digest()
            if key in full and low < high:
                middle = (low + high) // 2
                todo += [(low, middle, depth + 1), (middle + 1, high, depth + 1)]
            else:
                yield key, low, high, depth, doc, at + a, anchor - a, text[a:b]


def split_hot(packed: DataFrame, length: int, parts: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of bytes: contexts of crowded anchors in pieces for shards (kind 0), and repeats by document (1).

    Places are halved, and keys cover more bytes, where a key has more than ``most`` bytes of pieces. Keys are
    counted by partial aggregates, and only the full ones, less than one in ``most`` bytes, come to the driver. A
    key of a single place that is still full is one string (by a hash of 128 bits): all but its first go.
    """
    full: dict[bytes, tuple[int, int]] = {}
    depth, total, strings = 0, 0, False

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = [(key, len(text), doc, at, low == high) for key, low, high, deep, doc, at, _, text in _splits(data.as_py(), length, full) if deep == depth]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["key", "size", "doc", "at", "last"])

    data = packed.select("data")
    while True:
        seen = Observation()
        keys = data.mapInArrow(count, "key binary, size long, doc long, at long, last boolean").observe(seen, F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
        found = keys.groupBy("key").agg(F.sum("size").alias("size"), F.min(F.struct("doc", "at")).alias("first"), F.max("last").alias("last")).where(F.col("size") > most).collect()
        total += seen.get["size"] - sum(r["size"] for r in found)
        full.update((bytes(r["key"]), tuple(r["first"])) for r in found)
        strings |= any(r["last"] for r in found)
        if all(r["last"] for r in found):
            break
        depth += 1
    shards = max(parts, total // (32 << 20))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = [(doc, at, len(text), anchor, int.from_bytes(key[:8], "little"), text) for key, _, _, _, doc, at, anchor, text in _splits(data.as_py(), length, full) if key not in full]
                want = np.array([r[:5] for r in rows], _WANT)
                yield _pack(want, [r[5] for r in rows], (mixed(want["h"]) % _U(shards)).astype(np.int64), 0)

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                spans = _merged(np.array([(doc, at, at + length) for key, _, _, _, doc, at, _, _ in _splits(data.as_py(), length, full) if full.get(key, (doc, at)) != (doc, at)], _SPAN))
                yield _deal(spans, _doc_part(spans["doc"], parts), 1)

    spans = data.mapInArrow(repeats, _ROWS)
    return data.mapInArrow(pieces, _ROWS), spans if strings else spans.limit(0)


def _repeats(want: np.ndarray, raw: np.ndarray, length: int, memory: int) -> np.ndarray:
    """Spans of the strings in the pieces that occur earlier in another piece."""
    ends = np.cumsum(want["size"].astype(np.int64))
    starts = ends - want["size"]
    text = np.zeros(len(raw) + len(want), np.int64)  # 0 ends a piece
    places = np.arange(len(raw)) + np.repeat(np.arange(len(want)), want["size"])
    text[places] = raw.astype(np.int64) + 1
    order, common = suffix_array(text, length, memory)
    equal = common >= length
    group = np.cumsum(~equal)
    many = np.flatnonzero(equal)
    if not len(many):
        return np.zeros(0, _SPAN)
    inside = np.zeros(len(order), bool)
    inside[many] = inside[many - 1] = True
    at, group = order[inside], group[inside]
    begins = starts + np.arange(len(want))  # in text
    piece = np.searchsorted(begins, at, side="right") - 1
    whole = at - begins[piece] + length <= want["size"][piece]  # else it goes on into the next piece
    at, group, piece = at[whole], group[whole], piece[whole]
    if not len(at):
        return np.zeros(0, _SPAN)
    doc, place = want["doc"][piece], want["at"][piece] + (at - begins[piece])
    o = np.lexsort((place, doc, group))
    group, doc, place = group[o], doc[o], place[o]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    head = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
    later = (doc != doc[head]) | (place != place[head])
    spans = np.empty(int(later.sum()), _SPAN)
    spans["doc"], spans["at"], spans["end"] = doc[later], place[later], place[later] + length
    return _merged(spans)


def sort_shards(pieces: DataFrame, length: int, parts: int, memory: int, most: int) -> DataFrame:
    """Rows of bytes by document: the repeats that the shards' suffix arrays show (kind 1).

    A shard is sorted in runs of whole anchors of ``most`` bytes at most; no anchor has more.
    """

    def run(t: pa.Table) -> pa.Table:
        heads, bodies = zip(*map(_unpack, t.column("data").to_pylist()), strict=True)
        want, raw = np.concatenate(heads), np.frombuffer(b"".join(bodies), np.uint8)
        begins = np.cumsum(want["size"].astype(np.int64)) - want["size"]
        order = np.argsort(want["h"], kind="stable")
        group = _grouped(want["h"][order])
        order = order[np.bincount(group)[group] > 1]
        want, begins = want[order], begins[order]
        filled = np.concatenate([[0], np.cumsum(want["size"].astype(np.int64))])
        new = np.flatnonzero(want["h"][1:] != want["h"][:-1]) + 1
        spans, a = [np.zeros(0, _SPAN)], 0
        for b, after in zip([*new.tolist(), len(want)], [*new[1:].tolist(), len(want), len(want)], strict=False):
            if b > a and (b == len(want) or filled[after] - filled[a] > most):
                sizes = want["size"][a:b].astype(np.int64)
                ahead = np.cumsum(sizes) - sizes
                own = raw[np.repeat(begins[a:b] - ahead, sizes) + np.arange(int(sizes.sum()))]
                spans.append(_repeats(want[a:b], own, length, memory))
                a = b
        out = _merged(np.concatenate(spans))
        return pa.Table.from_batches([_deal(out, _doc_part(out["doc"], parts), 1)])

    return pieces.groupBy("part").applyInArrow(run, _ROWS)


def remove_repeats(docs: DataFrame, length: int = 100, memory: int = 128 << 20, with_text: bool = False, most: int = SORTED, crowd: int = HELD >> 10) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs; with_text adds kept (binary).

    A byte goes if a string of ``length`` bytes (64 to 191) that covers it starts earlier too: in a document
    with a smaller doc_id, or earlier in the same one. Overlaps count, strings don't cross documents, and they
    are judged on the input. Null texts are empty. Rows with equal or null ids are documents of their own,
    null ids last and equal ones by text, so of two equal rows the second goes. Shorter texts stay whole. An
    empty table gives an empty result. ``most`` is the bytes of a shard that are sorted at once, ``crowd`` the
    contexts of an anchor that a task sends to one place at once.
    """
    if not 64 <= length <= 191:
        raise ValueError("length must be from 64 to 191")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, distinct, size = docs.agg(F.count("*"), F.countDistinct("doc_id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n != distinct:
        docs = cut(docs.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn("key", F.monotonically_increasing_id()))
    else:
        docs = docs.withColumn("key", F.col("doc_id"))
    parts = max(2 * partitions(docs), size // (32 << 20))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _doc_part(batch.column(1).to_numpy(zero_copy_only=False), parts)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], ["part", "doc_id", "key", "text"])

    compared = cut(compare_contexts(find_contexts(docs.select("key", "text"), length, parts, crowd), parts, most))
    texts = docs.select("doc_id", "key", "text").mapInArrow(placed, "part int, doc_id long, key long, text string")
    pieces = cut_pieces(texts, compared.where("kind = 2"), parts)
    spans = compared.where("kind = 1")
    if crowded := compared.where("kind = 3").select("data").collect():
        hot = np.unique(np.concatenate([np.frombuffer(r["data"], "<u8") for r in crowded]))
        packed = cut(find_contexts(docs.select("key", "text"), length, parts, crowd, hot))
        split, known = split_hot(packed.where("kind = 3"), length, parts, most)
        pieces, spans = pieces.unionByName(split), spans.unionByName(packed.where("kind = 1")).unionByName(known)
    spans = spans.unionByName(sort_shards(pieces, length, parts, memory, most))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        gone = _merged(_of(right, 1, _SPAN))
        keys, ids, column = left.column("key").to_numpy(), left.column("doc_id"), left.column("text")
        lo, hi = np.searchsorted(gone["doc"], keys, "left").tolist(), np.searchsorted(gone["doc"], keys, "right").tolist()
        at, end = gone["at"].tolist(), gone["end"].tolist()
        sizes, removed, spans, digests, kept = [], [], [], [], []
        for k, text in enumerate(column):
            raw = text.as_py().encode()
            a, b = lo[k], hi[k]
            rest = raw
            if b > a:
                rest = b"".join([raw[: at[a]], *(raw[end[i] : at[i + 1]] for i in range(a, b - 1)), raw[end[b - 1] :]])
            sizes.append(len(raw))
            removed.append(len(raw) - len(rest))
            spans.append(b - a)
            digests.append(hashlib.sha256(rest).hexdigest())
            if with_text:
                kept.append(rest)
        out = {"doc_id": ids, "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return texts.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(finish, schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without bytes covered by a 100-byte string that starts earlier; odd rows as in ``remove_repeats``."""
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES: dict[str, str] = {}
