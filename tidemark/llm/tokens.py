"""Sub-word tokens of a SentencePiece merge model: encoding, decoding and counting.

The models served here have an identity normaliser with a dummy prefix, byte fallback, and no piece that goes
on after a word (a space mark follows another mark only). Two characters between which no piece can reach
therefore part a text into *pre-tokens* that are encoded each on its own: a run of spaces with the word after
it, a newline, or a word after a newline. ``MergeModel`` checks these properties and refuses other models.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table

MARK = "▁"
PRE_TOKEN = re.compile(r" +[^ \n]*|\n|[^ \n]+")
#: Distinct pre-tokens that a Python worker remembers, and slots for pairs of tokens. Results don't depend on them.
REMEMBERED, PAIR_BITS = 300_000, 20
#: Longer pre-tokens are encoded one at a time, and not remembered; texts are taken in blocks of so many characters.
LONG, BLOCK = 64, 1 << 20


class MergeModel:
    """Prefix-table encoder of a merge-type SentencePiece model.

    The encoding of a string's prefix is the encoding of a shorter prefix plus one last token, and the last
    token is unique: it is the one match ending there that is compatible with the last token of the prefix
    before it. Compatible are two tokens whose concatenation the merge procedure splits into just those two.
    An automaton finds the matches of two characters or more; where none is compatible, the last token is the
    character itself. Ids are recovered from the end of the table backwards.
    """

    def __init__(self, proto: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(proto)
        norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not model.trainer_spec.byte_fallback or not kinds <= {1, 2, 3, 6}:
            raise ValueError("a merge model with identity normaliser, dummy prefix and byte fallback is needed")
        self.pieces = [p.piece for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece goes on after a word")
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        if len(self.byte_ids) != 256:
            raise ValueError("byte pieces are missing")
        self._splits()
        self.meets = {p.replace(MARK, " ")[k : k + 2] for p in self.ids for k in range(len(p) - 1)}  # characters that a piece has side by side
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if i in self.tokens and len(piece) > 1:
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.length = np.array([len(p) for p in self.pieces], np.int64)
        self.lengths, self.names = self.length.tolist(), [str(i) for i in range(len(self.pieces))]
        self.known = np.full(1 << PAIR_BITS, -2, np.int64)  # pairs of tokens by hash, twice the pair plus whether they fit

    def merges(self, text: str) -> tuple[list[str], int]:
        """The merge procedure itself, best score first, then leftmost; and the length of the left part in the last merge."""
        symbols, n, cut = list(text), len(text), 0
        left, right, heap, score = list(range(-1, n - 1)), list(range(1, n + 1)), [], self.score

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (s := score.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (-s, i, j, len(symbols[i]) + len(symbols[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size:
                continue
            cut = len(symbols[i])
            symbols[i], symbols[j] = symbols[i] + symbols[j], ""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
            offer(left[i], i)
            offer(i, k)
        return [s for s in symbols if s], cut

    def _splits(self) -> None:
        """Of each token its rank (-1 for a character), and the two tokens that its last merge joins; joins of all pairs."""
        n, scores = len(self.pieces), sorted((s for p, s in self.score.items() if len(p) > 1), reverse=True)
        best = {s: k for k, s in enumerate(scores)}
        self.rank, self.left, self.right, self.tied = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
        pairs = []
        for piece, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(piece) > 1:
                rank = best[self.score[piece]]
                pairs += [(a << 20 | b, rank) for k in range(1, len(piece)) if (a := self.ids.get(piece[:k])) is not None and (b := self.ids.get(piece[k:])) is not None]
                done, cut = self.merges(piece)
                if len(done) == 1:
                    a, b = self.ids[piece[:cut]], self.ids[piece[cut:]]
                    self.rank[i], self.left[i], self.right[i] = rank, a, b
                    self.tied[i] = self.tied[a] or self.tied[b] or rank and scores[rank - 1] == scores[rank]
        self.tokens = {i for p, i in self.ids.items() if len(p) == 1 or self.left[i] >= 0}
        self.pair, self.pair_rank = np.array(sorted(pairs), np.int64).reshape(-1, 2).T.copy()

    def compatible(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the merge procedure splits the two tokens' concatenation into just them.

        The merges that made the two are undone, the later first; it does not if the tokens that meet at the
        seam at some time would have joined before the merge undone last. Of equal merges the left is first. Pairs
        with a token of a score that several pieces have go through the procedure itself.
        """
        ok, own = np.ones(len(token), bool), before >= 0
        tied = own & (self.tied[token] | self.tied[np.maximum(before, 0)])
        for k in np.flatnonzero(tied).tolist():
            pieces = [self.pieces[before[k]], self.pieces[token[k]]]
            ok[k] = self.merges("".join(pieces))[0] == pieces
        rows = np.flatnonzero(own & ~tied)
        a, b, limit = before[rows], token[rows], np.full(len(rows), 1 << 40)
        while len(rows):
            at = np.minimum(np.searchsorted(self.pair, a << 20 | b), len(self.pair) - 1)
            joins = (self.pair[at] == (a << 20 | b)) & (self.pair_rank[at] < limit)
            ok[rows[joins]] = False
            first, second = self.rank[a], self.rank[b]
            on = ~joins & (np.maximum(first, second) >= 0)
            rows, a, b, first, second = rows[on], a[on], b[on], first[on], second[on]
            undo = first > second
            a, b, limit = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b]), np.where(undo, first, second + 1)
        return ok

    def fitting(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs; pairs lately asked for are known."""
        pair = (before + 2) << 20 | token
        slot = (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        got = self.known[slot]
        missed = np.flatnonzero(got >> 1 != pair)
        if len(missed):
            new, at = np.unique(pair[missed], return_inverse=True)
            got[missed] = (new << 1 | self.compatible((new >> 20) - 2, new & 0xFFFFF))[at]
            self.known[slot[missed]] = got[missed]
        return (got & 1).astype(bool)

    def encode_piece(self, text: str) -> list[int]:
        """Ids of a pre-token whose spaces are marks already."""
        single = [self.ids.get(c, -2) for c in text]  # -2: a character outside the vocabulary
        last = list(single)  # last token of the prefix that ends here; a character where no longer token fits
        for end, token in self.automaton.iter(text):
            start = end - self.lengths[token]
            if last[end] == single[end] and self.fitting(np.array([last[start] if start >= 0 else -1]), np.array([token]))[0]:
                last[end] = token
        out, i = [], len(text) - 1
        while i >= 0:
            if last[i] < 0:
                out += [self.byte_ids[b] for b in reversed(text[i].encode())]
                i -= 1
            else:
                out.append(last[i])
                i -= self.lengths[last[i]]
        out.reverse()
        return out

    def encode_pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many pre-tokens one after the other, where each begins, and which are whole; no word holds a newline.

        The tables are filled by place: all matches that end at the same place of their words at once. A word with
        a character outside the vocabulary isn't whole; encode_piece has its ids.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = "\n" + "\n".join(words)
        starts = np.cumsum(size + 1) - size
        codes, at = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)
        last = np.array([self.ids.get(chr(c), -2) for c in codes.tolist()], np.int64)[at]
        last[starts - 1] = -1
        flat = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64)
        end, token = flat[::2], flat[1::2]
        first = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else end
        turn = np.arange(len(end)) - np.repeat(first, np.diff(np.append(first, len(end))))  # among matches with one end, longest first
        place = ((end - np.repeat(starts, size + 1)[end]) << 6 | turn).astype(np.uint16)
        order = np.argsort(place, kind="stable")
        end, token = end[order], token[order]
        bounds, free = np.cumsum(np.bincount(place, minlength=1)), np.ones(len(text), bool)
        for a, b in zip([0, *bounds[:-1].tolist()], bounds.tolist(), strict=True):
            if a < b:
                e, t = end[a:b], token[a:b]
                some = free[e]
                e, t = e[some], t[some]
                ok = self.fitting(last[e - self.length[t]], t)
                last[e[ok]], free[e[ok]] = t[ok], False
        word, at = np.arange(len(words)), starts + size - 1
        owners, ids = [word[:0]], [word[:0]]
        while len(word):
            t = last[at]
            owners.append(word)
            ids.append(t)
            at = at - np.where(t < 0, 1, self.length[t])
            on = at >= starts[word]
            word, at = word[on], at[on]
        owner, token = np.concatenate(owners[::-1]), np.concatenate(ids[::-1])  # last tokens were found first
        order = np.argsort(owner, kind="stable")
        whole = np.ones(len(words), bool)
        whole[owner[token < 0]] = False
        return token[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))]), whole

    def decode_piece(self, ids: list[int]) -> str:
        """Text of ids; the bytes of fallback pieces join to characters."""
        out, run = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run = bytearray()
            out.append(self.pieces[i])
        if run:
            out.append(run.decode(errors="replace"))
        return "".join(out).replace(MARK, " ")

    def known_by(self, word: str) -> tuple[str, str]:
        """Ids of a pre-token, joined by commas, and their text."""
        ids = self.encode_piece(word.replace(" ", MARK))
        return ",".join(map(str, ids)), self.decode_piece(ids)

    def encode(self, text: str) -> list[int]:
        return [i for w in pre_tokens(text) for i in self.encode_piece(w.replace(" ", MARK))]

    def decode(self, ids: list[int]) -> str:
        text = self.decode_piece(ids)
        return text[1:] if text[:1] == " " else text  # the dummy prefix


def pre_tokens(text: str) -> list[str]:
    """What PRE_TOKEN finds in the text after a first space, marks taken for spaces."""
    out: list[str] = []
    for k, line in enumerate(f" {text}".replace(MARK, " ").split("\n") if text else ()):
        if k:
            out.append("\n")
        if "  " in line or line[-1:] == " ":
            out += PRE_TOKEN.findall(line)
        else:
            first, *rest = line.split(" ")
            if first:
                out.append(first)
            out += [" " + w for w in rest]
    return out


def blocks(texts: list[str]) -> Iterator[list[str]]:
    """Texts in turn, about BLOCK characters at a time."""
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


class Memory:
    """What is known of distinct pre-tokens, in two generations: when the younger is full, the older is forgotten."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, words: set[str]) -> list[str]:
        """Words that aren't known; those that are come into the younger generation."""
        new = words.difference(self.young)
        again = new.intersection(self.old)
        self.young.update((w, self.old[w]) for w in again)
        return list(new - again)

    def settle(self, words: set[str], odd: Iterable[str], most: int) -> None:
        """Forget long and odd words, and the older generation where there are more than ``most`` words in all."""
        for w in [*odd, *(w for w in words if len(w) > LONG)]:
            self.young.pop(w, None)
        if 2 * len(self.young) > most:
            self.old, self.young = self.young, {}


_models: dict[tuple, tuple] = {}


def _worker(proto: bytes, kind: str, make):
    """The model and the memory of this Python worker, kept over its tasks."""
    key = (hash(proto), kind)
    if key not in _models:
        _models[key] = (make(proto), Memory())
    return _models[key]


def encode_documents(docs: DataFrame, model_file: str, with_ids: bool = False, remembered: int = REMEMBERED, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's whole text; with_ids adds ids and decoded.

    One output row for each input row, in one pass without a shuffle; a null text is an empty one (no ids), and an
    empty table gives an empty one. Repeated rows give repeated results; other columns are ignored. A long text is
    taken as a whole, at a cost in proportion to it. A worker remembers ``remembered`` pre-tokens at most, and with
    ``keep`` over its tasks. The model file is read once, on the driver, and travels with the tasks.
    """
    with open(model_file, "rb") as f:
        proto = f.read()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def learn(model: MergeModel, memory: Memory, odd: dict[str, str], words: set[str]) -> None:
        """Ids of new pre-tokens, joined by commas, into memory; odd: their decoded texts, where these are others.

        A last character that no piece joins to the one before is a token of its own: what is before it is learnt.
        """
        new, young = memory.missing(words), memory.young
        tails = [w for w in new if 2 < len(w) <= LONG and w[-2:] not in model.meets]
        some = set(new).difference(tails).union(w[:-1] for w in tails)
        some = [w for w in memory.missing(some) if len(w) <= LONG and w != "\n"]
        ids, bounds, whole = model.encode_pieces([w.replace(" ", MARK) for w in some])
        ids, bounds = ids.tolist(), bounds.tolist()
        names, pieces = [model.names[i] for i in ids], [model.pieces[i] for i in ids]
        rest = [w for w in new if len(w) > LONG or w == "\n"] + [w for w, ok in zip(some, whole.tolist(), strict=True) if not ok]
        for w, a, b in zip(some, bounds, bounds[1:], strict=False):
            young[w] = ",".join(names[a:b])
            if (decoded := "".join(pieces[a:b]).replace(MARK, " ")) != w:
                odd[w] = decoded
        single: dict[str, tuple[str, str]] = {}
        for w in rest:
            young[w], decoded = model.known_by(w)
            odd.pop(w, None)
            if decoded != w:
                odd[w] = decoded
        for w in tails:
            if w[-1] not in single:
                single[w[-1]] = model.known_by(w[-1])
            ids_of, decoded = single[w[-1]]
            young[w] = f"{young[w[:-1]]},{ids_of}"
            if w[:-1] in odd or decoded != w[-1]:
                odd[w] = odd.get(w[:-1], w[:-1]) + decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = _worker(proto, "encode", MergeModel)
        for batch in batches:
            n, h, d, all_ids, all_text = [], [], [], [], []
            for block in blocks([t or "" for t in batch.column(1).to_pylist()]):
                words = [pre_tokens(t) for t in block]
                distinct, odd = set().union(*words), {}
                learn(model, memory, odd, distinct)
                for own in words:
                    joined = ",".join(map(memory.young.__getitem__, own))
                    plain = "".join(map(odd.get, own, own))[1:]
                    n.append(joined.count(",") + 1 if joined else 0)
                    h.append(hashlib.sha256(joined.encode()).hexdigest())
                    d.append(hashlib.sha256(plain.encode()).hexdigest())
                    if with_ids:
                        all_ids.append([int(x) for x in joined.split(",")] if joined else [])
                        all_text.append(plain)
                memory.settle(distinct, odd, remembered)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(d, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)
        if not keep:
            memory.__init__()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of each row's whole text.

    Each pre-token that a block of rows holds is counted once, by the library, and the counts are joined to
    the frequencies of the block's documents; no document's ids are made. A null text is empty: no bytes, no
    tokens. One output row for each input row, no shuffle; an empty table gives an empty one, repeated rows repeated
    results, and other columns are ignored. A worker remembers at most ``REMEMBERED`` counts.
    """
    with open(model_file, "rb") as f:
        proto = f.read()

    def make(data: bytes):
        import sentencepiece

        MergeModel(data)  # refuses models for which pre-tokens don't part the text
        return sentencepiece.SentencePieceProcessor(model_proto=data)

    def learn(model, young: dict[str, int], words: list[str]) -> None:
        spaced = [w for w in words if w[0] == " "]  # the library adds this first space itself
        bare = [w for w in words if w[0] != " "]  # after a newline: two pieces less, the added space and the newline
        young.update(zip(spaced, (len(x) for x in model.encode([w[1:] for w in spaced], num_threads=1)), strict=True))
        young.update(zip(bare, (len(x) - 2 for x in model.encode([f"\n{w}" for w in bare], num_threads=1)), strict=True))
        if " " in young:
            young[" "] = 1  # alone the library drops it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = _worker(proto, "count", make)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = []
            for block in blocks(texts):
                counts = [Counter(pre_tokens(t)) for t in block]
                distinct = set().union(*counts)
                learn(model, memory.young, memory.missing(distinct))
                n += [sum(f * memory.young[w] for w, f in c.items()) for c in counts]
                memory.settle(distinct, (), REMEMBERED)
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )
        memory.__init__()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of all documents: encoded as the library does, then decoded."""
    return encode_documents(table(spark, sf_dir, "documents"), default_model(), remembered=2 * REMEMBERED, keep=True)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than 4,096 tokens) of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"), default_model(), limit=4096)


QUERIES = {"op6_sentencepiece": op6_sentencepiece, "op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
