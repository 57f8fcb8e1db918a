"""Benchmark decontamination: passages of benchmark items inside documents, at a similarity of 0.8 or more.

Words are compared without case (A-Z) and punctuation, in shingles of five words (an item of fewer words is one
shingle). For an item of n words every n-word window of a document that shares a shingle with it is a candidate -
a window without one has similarity 0. A document of fewer words than the item is one window as a whole. Candidates get a SimHash of their weighted shingles; fingerprints are cut
into RADIUS + 1 blocks, and a look-up by each block's value finds all items within RADIUS differing bits, since
at least one block must agree. Their whole distance is verified, then the exact weighted-shingle similarity
(sum of minima over sum of maxima of shingle counts). At similarity 0.8 the fingerprints differ by some ten bits
of 64; RADIUS is four standard deviations above.

Items are a query set held in memory in blocks of bounded size, one after the other, against all documents; with more than one
block each block's results are written before the next one is made. Documents are never shuffled.

A radius of a third of the bits leaves blocks of two or three bits, by which nearly all items of a size are looked up; blocks long
enough to select would need a radius that loses items. The whole distance is what selects (one unrelated item in 119 lies
within RADIUS), and the shared shingle decides for which windows it is taken.

Defined results: null texts are empty; an item without words, or without id, matches nothing; rows of one id, repeated ones and all
that have no id, give one row for each item, that of the best window among them.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm._durable import written
from lakeloom.llm._text import NOT_ALNUM, U64, shingle_hashes, slices, span_hashes, word_spans

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 22
#: Bytes of item texts that are broadcast at once; more items are taken in several such blocks.
BLOCK_BYTES = 8 << 20
_EDGES = np.linspace(0, 64, RADIUS + 2).round().astype(int)
_BLOCKS = [(U64(a), U64((1 << (b - a)) - 1)) for a, b in zip(_EDGES[:-1].tolist(), _EDGES[1:].tolist())]
_FILTER_BITS = 22


def _word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, starts, ends, first = word_spans(data, offs, NOT_ALNUM)
    return span_hashes(low, starts, ends), first


def _signs(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def _pack(positive: np.ndarray) -> np.ndarray:
    return np.packbits(positive, axis=1, bitorder="little").view("<u8").ravel()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


class ItemIndex:
    """Items by shingle, by size, and by the blocks of their fingerprints."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids = [i for i, _ in items]
        self.sizes, self.counts, self.of_size = [], [], defaultdict(list)
        by_shingle: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        prints = np.zeros(len(items), dtype=U64)
        for j, (_, text) in enumerate(items):
            data = np.frombuffer((text or "").encode(), np.uint8)
            words, _ = _word_hashes(data, np.array([0, len(data)]))
            n = len(words)
            k = min(SHINGLE, n)
            shingles = shingle_hashes(words, k) if n else np.zeros(0, U64)
            self.sizes.append(n)
            self.counts.append(Counter(shingles.tolist()))
            if n:
                prints[j] = _pack((_signs(shingles).sum(0) > 0)[None, :])[0]
                self.of_size[n].append(j)
                for s in set(shingles.tolist()):
                    by_shingle[k][s].add(n)
        self.prints = prints
        self.shingles = {}
        for k, sizes in by_shingle.items():
            keys = np.array(sorted(sizes), dtype=U64)
            bloom = np.zeros(1 << _FILTER_BITS, dtype=bool)
            bloom[(keys >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.shingles[k] = (keys, bloom, [sorted(sizes[s]) for s in keys.tolist()])
        self.blocks = {}
        for n, members in self.of_size.items():
            m = np.array(members)
            tables = []
            for shift, mask in _BLOCKS:
                value = (prints[m] >> shift) & mask
                order = np.argsort(value, kind="stable")
                tables.append((value[order], m[order]))
            self.blocks[n] = tables

    def within(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in prints, item) of all pairs within RADIUS bits among the items of n words."""
        found = []
        for (shift, mask), (values, members) in zip(_BLOCKS, self.blocks[n]):
            mine = (prints >> shift) & mask
            a, b = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
            at = np.repeat(np.arange(len(prints)), b - a)
            item = members[np.arange(len(at)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
            near = np.bitwise_count(prints[at] ^ self.prints[item]) <= RADIUS
            found.append(np.stack([at[near], item[near]]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pairs[0], pairs[1]

    def search(self, data: np.ndarray, offs: np.ndarray) -> dict[tuple[int, int], tuple[float, int, int]]:
        """(text, item) -> (best similarity, first word of the best window, the earliest among equals, and its words)."""
        words, first = _word_hashes(data, offs)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for k, (keys, bloom, sizes) in self.shingles.items():
            shingles = shingle_hashes(words, k)
            hit = np.flatnonzero(bloom[(shingles >> U64(64 - _FILTER_BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(keys, shingles[hit]), len(keys) - 1)
            same = keys[at] == shingles[hit]
            hit, at = hit[same], at[same]
            doc = np.searchsorted(first, hit, side="right") - 1
            inside = hit + k <= first[doc + 1]
            ranges: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
            for p, s, d in zip(hit[inside].tolist(), at[inside].tolist(), doc[inside].tolist()):
                for n in sizes[s]:
                    size = min(n, int(first[d + 1] - first[d]))
                    a, b = max(p + k - size, int(first[d])), min(p, int(first[d + 1]) - size)
                    if a <= b:
                        row = ranges[n, size]
                        if row and row[-1][2] == d and a <= row[-1][1] + 1:
                            row[-1] = (row[-1][0], max(b, row[-1][1]), d)
                        else:
                            row.append((a, b, d))
            for (n, size), spans in ranges.items():
                for a, b, d in spans:
                    self._windows(shingles, n, size, k, a, b, d, int(first[d]), best)
        return best

    def _windows(self, shingles: np.ndarray, n: int, size: int, k: int, a: int, b: int, doc: int, base: int, best: dict) -> None:
        span = size - k + 1
        for lo in range(a, b + 1, 4096):
            hi = min(lo + 4095, b)
            part = shingles[lo : hi + span]
            total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_signs(part), axis=0, dtype=np.int32)])
            prints = _pack(total[span:] - total[:-span] > 0)
            for at, item in zip(*(x.tolist() for x in self.within(n, prints))):
                s = similarity(Counter(part[at : at + span].tolist()), self.counts[item])
                key = (doc, item)
                if s >= SIMILARITY and (key not in best or (s, -(lo + at - base)) > (best[key][0], -best[key][1])):
                    best[key] = (s, lo + at - base, size)


def _search_batches(batches: Iterable[pa.RecordBatch], index: ItemIndex) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found = [], []
        for i, _, data, offs in slices(batch.column(1)):
            for (d, item), (s, at, size) in sorted(index.search(data, offs).items()):
                rows.append(i + d)
                found.append((index.ids[item], s, at, size))
        if rows:
            cols = list(zip(*found))
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["key", "item_id", "similarity", "start_word", "n_words"])


def _indexes(items: DataFrame, block_bytes: int) -> Iterator[tuple[Broadcast, bool]]:
    """The items in blocks of bounded size, each broadcast as an index, and whether there are others."""
    items = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        block = [tuple(r) for r in items.where(F.expr(f"pmod(xxhash64(item_id), {blocks}) = {k}")).toLocalIterator()]
        yield items.sparkSession.sparkContext.broadcast(ItemIndex(block)), blocks > 1


def find(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, item_id, similarity, start_word, n_words): every document and item of 0.8 or more, with the best window."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    out = None
    for held, more in _indexes(items, block_bytes):
        part = rows.mapInArrow(lambda it, held=held: _search_batches(it, held.value), f"key {kind}, item_id bigint, similarity double, start_word bigint, n_words bigint")
        if more:  # only one block is held at a time
            part = written(part)
            held.unpersist()
        out = part if out is None else out.union(part)
    best = F.max_by(F.struct("start_word", "n_words"), F.struct("similarity", -F.col("start_word"))).alias("b")
    out = out.groupBy("key", "item_id").agg(F.max("similarity").alias("similarity"), best)
    return out.select(F.col("key").alias(key), "item_id", "similarity", "b.start_word", "b.n_words")


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any passage of an item, all columns as they were. Rows are judged where they lie: no shuffle."""

    def keep(batches: Iterable[pa.RecordBatch], index: ItemIndex, at: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = np.ones(batch.num_rows, dtype=bool)
            for i, _, data, offs in slices(batch.column(at)):
                for d, _item in index.search(data, offs):
                    stay[i + d] = False
            yield batch.filter(pa.array(stay))

    for held, more in _indexes(items, block_bytes):
        docs = docs.mapInArrow(lambda it, held=held, at=docs.columns.index(text): keep(it, held.value, at), docs.schema)
        if more:
            docs = written(docs)
            held.unpersist()
    return docs
