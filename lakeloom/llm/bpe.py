"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are cut into pre-tokens by the tokenizer's pattern. The distinct pre-tokens that a task has not
met before are laid out in one symbol array, and an inverted index maps each mergeable pair (through
its rank) to the positions where it stands. Ranks are then replayed in order from a heap: one step
merges every position of the lowest rank, and only the pairs on both sides of a merged position are
looked up and indexed anew. This equals merging each pre-token alone, lowest rank first and leftmost
among equals: pre-tokens do not interact, and a pre-token in which a merge would bring up a *lower*
rank than the one being replayed is finished alone, pair by pair.

Defined results: a null text is an empty text (no ids); there are no special tokens, their strings are
ordinary text; ids decode to exactly the encoded bytes. Ids without an entry in the vocabulary raise KeyError.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lakeloom.llm._text import give_back, slices

NONE = np.int32((1 << 31) - 1)
#: Pre-tokens of one generation in a worker's memory; beyond it a new one begins, which takes over what it meets again
#: from the last one (speed only, results are the same).
MEMO_WORDS = 180_000
#: And characters of them, on average a word: long pre-tokens (texts without spaces) fill the memory sooner.
MEMO_CHARS = 16


class ByteBpe:
    """A vocabulary of ranks: the rank of a byte string is its id and its merge order."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.width = max(ranks.values(), default=0) + 1
        self.byte_id = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = {}
        for word, rank in ranks.items():
            for k in range(1, len(word)):
                a, b = ranks.get(word[:k]), ranks.get(word[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = rank
        self.pair_key = np.array(sorted(pairs), dtype=np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_key.tolist()], dtype=np.int32)
        self.byte_pair_rank = self._rank(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)).reshape(256, 256)
        self.memo: dict[str, tuple[str, int, bytes]] = {}
        self.last: dict[str, tuple[str, int, bytes]] = {}
        self.limit = MEMO_WORDS
        self.chars = 0

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return cls(ranks, pattern)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = np.asarray(left, dtype=np.int64) * self.width + right
        if not len(self.pair_key):
            return np.full(len(keys), NONE)
        at = np.minimum(np.searchsorted(self.pair_key, keys), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == keys, self.pair_rank[at], NONE)

    def merge_alone(self, ids: list[int]) -> list[int]:
        """Lowest rank first, leftmost among equals, one merge at a time."""
        sym = np.array(ids, dtype=np.int64)
        rank = self._rank(sym[:-1], sym[1:])
        while len(rank) and rank.min() < NONE:
            i = int(rank.argmin())
            sym = np.concatenate([sym[:i], rank[i : i + 1], sym[i + 2 :]])
            rank = np.delete(rank, i)
            for j in (i - 1, i):
                if 0 <= j < len(rank):
                    rank[j] = self._rank(sym[j : j + 1], sym[j + 1 : j + 2])[0]
        return sym.tolist()

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; every merge of the vocabulary is applied to all words at once, in rank order.

        A word that is itself in the vocabulary is that id, even if no merges lead there.
        """
        whole = [self.ranks.get(w) for w in words]
        if any(i is not None for i in whole):
            rest = iter(self.replay([w for w, i in zip(words, whole) if i is None]))
            return [next(rest) if i is None else [i] for i in whole]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        if n == 0:
            return [[] for _ in words]
        # a few numbers for each byte of the words: 32 bits hold them, which bounds what a batch takes
        first = np.concatenate([[0], np.cumsum(sizes)])
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        sym = self.byte_id[data].astype(np.int32)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        prv = np.arange(-1, n - 1, dtype=np.int32)
        filled = sizes > 0
        nxt[first[1:][filled] - 1] = -1
        prv[first[:-1][filled]] = -1
        alive = np.ones(n, dtype=bool)
        rank = np.full(n, NONE)
        left = np.flatnonzero(nxt >= 0).astype(np.int32)
        rank[left] = self.byte_pair_rank[data[left], data[left + 1]]
        alone: set[int] = set()
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(at: np.ndarray) -> None:
            at = at[rank[at] < NONE]
            if not len(at):
                return
            order = at[np.argsort(rank[at], kind="stable")]
            r = rank[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            cuts = [0, *cut.tolist(), len(order)]
            for key, a, b in zip(r[cuts[:-1]].tolist(), cuts, cuts[1:]):
                part = order[a:b]
                if key in index:
                    index[key].append(part)
                else:
                    index[key] = [part]
                    heapq.heappush(heap, key)

        post(left)
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            if len(at) > 1:  # overlapping pairs of one run of equal symbols: every second one, from the left
                near = np.zeros(len(at), dtype=bool)
                near[1:] = nxt[at[:-1]] == at[1:]
                if near.any():
                    begin = np.maximum.accumulate(np.where(near, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - begin) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            right = sym[after]
            sym[at] = r
            alive[gone] = False
            rank[gone] = NONE
            nxt[at] = after
            tail = after >= 0
            prv[after[tail]] = at[tail]
            rank[at] = NONE
            # pairs as they are when only the merges to the left are done: a lower rank here would come first
            amid = at[tail][self._rank(np.full(int(tail.sum()), r), right[tail]) < r]
            before = prv[at]
            touched = np.unique(np.concatenate([at[tail], before[before >= 0]]))
            if len(touched):
                rank[touched] = self._rank(sym[touched], sym[nxt[touched]])
                lower = np.concatenate([touched[rank[touched] < r], amid])
                if len(lower):
                    for w in np.unique(word_of[lower]).tolist():
                        alone.add(w)
                        alive[first[w] : first[w + 1]] = False
                        rank[first[w] : first[w + 1]] = NONE
                    touched = touched[alive[touched]]
                post(touched)
        kept = np.flatnonzero(alive)
        counts = np.bincount(word_of[kept], minlength=len(words))
        flat, ends = sym[kept].tolist(), np.cumsum(counts).tolist()
        result = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for w in alone:
            result[w] = self.merge_alone(self.byte_id[data[first[w] : first[w + 1]]].tolist())
        return result

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def learn(self, words: Iterable[str]) -> None:
        if len(self.memo) > self.limit or self.chars > self.limit * MEMO_CHARS:
            self.memo, self.last, self.chars = {}, self.memo, 0
        memo, last, new, text = self.memo, self.last, [], self.text_of.__getitem__
        for w in words:
            if w not in memo:
                known = last.get(w)
                if known is None:
                    new.append(w)
                else:
                    memo[w] = known
        for k in range(0, len(new), 200_000):
            part = new[k : k + 200_000]
            self.chars += sum(map(len, part))
            for w, ids in zip(part, self.replay([w.encode() for w in part])):
                self.memo[w] = (" ".join(map(text, ids)), len(ids), self.decode(ids))

    def encode(self, text: str) -> list[int]:
        words = self.pattern.findall(text)
        self.learn(set(words))
        return [int(i) for w in words for i in self.memo[w][0].split()]


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def loaded(path: str, pattern: str) -> ByteBpe:
    """One tokenizer for each worker process and vocabulary."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe.load(path, pattern)
    return _LOADED[path, pattern]


def _batches(batches: Iterable[pa.RecordBatch], path: str, pattern: str, with_ids: bool, limit: int = MEMO_WORDS, forget: bool = False) -> Iterator[pa.RecordBatch]:
    bpe = loaded(path, pattern)
    bpe.limit = limit
    for batch in batches:
        for i, j, _, _ in slices(batch.column(1), 2 << 20):
            words = [bpe.pattern.findall(t or "") for t in batch.column(1).slice(i, j - i).to_pylist()]
            bpe.learn(set().union(*words))
            n, ids_hash, text_hash, ids = [], [], [], []
            for found in words:
                texts, sizes, data = zip(*map(bpe.memo.__getitem__, found)) if found else ((), (), ())
                n.append(sum(sizes))
                joined = " ".join(texts)
                ids_hash.append(hashlib.sha256(joined.encode()).hexdigest())
                text_hash.append(hashlib.sha256(b"".join(data)).hexdigest())
                if with_ids:
                    ids.append(np.array(joined.split(), dtype=np.int32))
            columns = [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
    if forget:
        bpe.memo, bpe.last = {}, {}
        give_back()


def encode(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text", with_ids: bool = True, memo_words: int = MEMO_WORDS, forget: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids]) of each row; the decoded digest comes from decoding the ids.

    memo_words and forget trade a worker's memory (pre-tokens kept, and whether past the end of a task) for time.
    Rows are independent: there is no shuffle, and a lost task is simply run again.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    out = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(lambda it: _batches(it, path, pattern, with_ids, memo_words, forget), schema)
    return out.withColumnRenamed("key", key)


def decode(tokens: DataFrame, path: str, pattern: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, data binary) of each row of ids; null ids give empty bytes."""
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for b in batches:
            data = [bpe.decode(x or ()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["key", "data"])

    return tokens.select(tokens[key].alias("key"), tokens[ids].alias("ids")).mapInArrow(run, f"key {kind}, data binary").withColumnRenamed("key", key)


__all__ = ["ByteBpe", "decode", "encode", "loaded"]
