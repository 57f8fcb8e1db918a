"""Removal of repeated passages: longest-previous-factor arrays over the suffixes that can have an earlier match.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document of a smaller id, or earlier in
the same one. In terms of a suffix array: the factor that starts at p is repeated if one of the two suffixes nearest to p in
suffix order that start earlier (previous and next smaller position) shares LENGTH bytes with it.

Suffixes are brought together without shuffling the text:

1. Each LENGTH-byte window has an anchor, the GRAM-byte substring of least hash in it (the leftmost among equals), which
   depends on its content alone: equal windows have equal anchors at equal offsets. Successive windows with one anchor form a
   stretch of up to 2 * LENGTH bytes, described by two hashes: its anchor's and its content's. Descriptions are grouped
   by anchor. A stretch that equals an earlier one is repeated as a whole; a stretch alone with its anchor has no match.
   Within a batch of documents only the first of equal stretches goes to its anchor's group, the others are known to be repeats.
2. Left are the distinct stretches whose anchor has several contents: edges of edits and chance repeats. Their bytes
   are fetched, and in buckets of whole anchors their windows are put in suffix order; the previous and the next smaller position
   of each decide whether its longest previous factor has LENGTH bytes. Anchors with more than HOT contents (a common line
   before ever different text) go to no bucket: the first place of each of their windows is found by
   digests of windows, in two steps so that no task gets all copies of one window, and all other places are repeats.
3. Each document gets its repeated stretches, and the rest of its bytes is kept.

Nothing is sampled, and no bucket grows with the commonest text: copies of stretches meet in step 1 as descriptions of fixed size
that are streamed in sorted order, those of windows in step 2 in parts. Suffix order is kept to step 2 because it needs
the text itself: step 1 hands on one stretch of each content, whose copies have the same factors. Hashes of step 1 and
digests of windows have 128 bits; the buckets of step 2 compare bytes.

Defined results: a null text is empty; a text of under LENGTH bytes is kept whole; rows that repeat both id and text are
one document, and each gets its result; texts of one id that differ, and rows with null ids (after all others), are told apart by their texts' hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm._durable import written
from lakeloom.llm._text import U64, buffers, give_back, mix64, slices

LENGTH = 100
GRAM = 32
HOT = 20_000
BUCKET_BYTES = 2 << 20
#: Parts of the copies of one window of a crowded anchor, and rows up to which a list of anchors or ids is broadcast.
SALTS, BROADCAST_ROWS = 64, 200_000
_LAST = (1 << 63) - 1
_CODES = [U64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_POSITION = U64((1 << 20) - 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on (positions near the end are padded)."""
    n = len(data)
    raw = np.concatenate([data, np.zeros(GRAM + 8, np.uint8)])
    words = np.ndarray((n + GRAM,), "<u8", raw, strides=(1,))
    mixed = mix64(words)
    h = mixed[:n] * _CODES[0]
    for j in range(1, GRAM // 8):
        h += mixed[8 * j : 8 * j + n] * _CODES[j]
    return mix64(h)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` successive values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def stretches(data: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, text, start in the text, bytes) of every stretch of the texts between offsets."""
    size = np.diff(offs)
    count = np.maximum(size - length + 1, 0)
    if not count.sum():
        z = np.zeros(0, np.int64)
        return z.astype(U64), z.astype(U64), z, z, z
    h = _gram_hashes(data)
    least = _least((h & ~_POSITION) | np.arange(len(data), dtype=U64), length - GRAM + 1)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offs[:-1], count)
    text = np.repeat(np.arange(len(count)), count)
    mine = least[at]
    new = np.ones(len(mine), dtype=bool)
    new[1:] = (mine[1:] != mine[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(mine)]]) - 1
    start, stop = at[first], at[last] + length
    anchor = h[(mine[first] & _POSITION).astype(np.int64)]
    content = (stop - start).astype(U64)
    for where in (start, start + GRAM, start + 2 * GRAM, stop - 3 * GRAM, stop - 2 * GRAM, stop - GRAM):  # they cover up to 6 * GRAM bytes
        content = mix64(content * U64(0x9DDFEA08EB382D69) + h[where])
    return anchor, content, text[first], start - offs[text[first]], stop - start


#: Bytes of text whose stretches are described at once; of longer texts, the parts.
PIECE, RUN = 1 << 19, 4 << 20


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row of each text, its place in the row): runs of whole texts, longer ones in overlapping parts."""
    for i, j, data, offs in slices(column, PIECE):
        if len(data) <= PIECE + length:
            yield data, offs, np.arange(i, j), np.zeros(j - i, np.int64)
        else:
            for begin in range(0, len(data), PIECE):
                part = data[begin : begin + PIECE + length - 1]
                yield part, np.array([0, len(part)]), np.array([i]), np.array([begin])


def _describe(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (m, s, doc, sub, pos, again): pos is start * 256 + bytes beyond LENGTH; again: known here to be repeated."""
    for batch in batches:
        docs, subs = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False), dtype=np.int64) for k in (0, 1))
        found, held = [], 0
        for data, offs, row, begin in _pieces(batch.column(2), length):
            m, s, text, start, size = stretches(data, offs, length)
            found.append((m, s, row[text], (start + begin[text]) * 256 + (size - length)))
            held += len(data)
            if held >= RUN:
                yield from _described(found, docs, subs)
                found, held = [], 0
        if found:
            yield from _described(found, docs, subs)


def _described(found: list[tuple[np.ndarray, ...]], docs: np.ndarray, subs: np.ndarray) -> Iterator[pa.RecordBatch]:
    m, s, row, pos = (np.concatenate(x) for x in zip(*found))
    doc, sub = docs[row], subs[row]
    order = np.lexsort((pos, sub, doc, s, m))
    m, s, doc, sub, pos = m[order], s[order], doc[order], sub[order], pos[order]
    again = np.zeros(len(m), dtype=bool)
    again[1:] = (m[1:] == m[:-1]) & (s[1:] == s[:-1])
    if again.any():
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(m))))
        again &= (doc != doc[head]) | (sub != sub[head]) | (pos != pos[head])
        m, s = np.where(again, U64(0), m), np.where(again, U64(0), s)
    for k in range(0, len(m), 100_000):
        cut = slice(k, k + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(m[cut].view(np.int64)), pa.array(s[cut].view(np.int64)), pa.array(doc[cut]), pa.array(sub[cut]), pa.array(pos[cut]), pa.array(again[cut])], ["m", "s", "doc", "sub", "pos", "again"])


def _resolve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (again, m, s, doc, sub, pos): (doc, sub, pos, m) of repeated stretches (m null) and of those to fetch.

    Streams: what is carried from batch to batch is one row, whatever the size of a group.
    """
    last: tuple | None = None  # m, s and identity of the first stretch of the last content
    waiting: tuple | None = None  # the only content of the last anchor so far, as long as it is the only one
    for batch in batches:
        known = batch.filter(batch.column(5))
        if known.num_rows:
            yield pa.RecordBatch.from_arrays([known.column(2), known.column(3), known.column(4), pa.nulls(known.num_rows, pa.int64())], ["doc", "sub", "pos", "m"])
        batch = batch.filter(pc.invert(batch.column(5)))
        m, s, doc, sub, pos = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        n = len(m)
        if not n:
            continue
        new_m, new_s = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        new_m[1:] = m[1:] != m[:-1]
        new_s[1:] = new_m[1:] | (s[1:] != s[:-1])
        if last is not None:
            new_m[0] = m[0] != last[0]
            new_s[0] = new_m[0] or s[0] != last[1]
        head = np.maximum.accumulate(np.where(new_s, np.arange(n), -1))
        old = head < 0
        first = [np.where(old, last[k], x[head]) if old.any() else x[head] for k, x in ((2, doc), (3, sub), (4, pos))]
        again = ~new_s & ((doc != first[0]) | (sub != first[1]) | (pos != first[2]))
        # contents of each anchor in this batch; run 0 is the anchor carried over, if it goes on
        run = np.cumsum(new_m)
        contents = np.bincount(run[new_s], minlength=run[-1] + 1)
        several = contents > 1
        if not new_m[0]:
            several[0] = several[0] or waiting is None or contents[0] > 0
        fetch = new_s & several[run]
        parts = [(doc[again], sub[again], pos[again], np.zeros(int(again.sum()), np.int64), np.ones(int(again.sum()), bool)), (doc[fetch], sub[fetch], pos[fetch], m[fetch], np.zeros(int(fetch.sum()), bool))]
        if waiting is not None and not new_m[0] and contents[0] > 0:
            parts.append(tuple(np.array([x]) for x in (*waiting[1:], waiting[0], False)))
        end = run[-1]
        if several[end]:
            waiting = None
        elif contents[end]:
            k = int(np.flatnonzero(new_s)[-1])
            waiting = (int(m[k]), int(doc[k]), int(sub[k]), int(pos[k]))
        last = (m[-1], s[-1], first[0][-1], first[1][-1], first[2][-1])
        d, b, p, a, whole = (np.concatenate(x) for x in zip(*parts))
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(b, pa.int64()), pa.array(p, pa.int64()), pa.array(a, pa.int64(), mask=whole.astype(bool))], ["doc", "sub", "pos", "m"])


def _fetch(batches: Iterable[pa.RecordBatch], buckets: int, length: int, hot: bool) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, doc, sub, start, data) from (doc, sub, text, asked: list of pos, anchor, whether it is crowded): bytes of
    stretches, or of those of crowded anchors the digests of all their windows."""
    for batch in batches:
        data, offs = buffers(batch.column(2))
        out: list[tuple] = []
        docs, subs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, asked in enumerate(batch.column(3).to_pylist()):
            text = data[offs[i] : offs[i + 1]]
            for one in asked or ():
                if one["hot"] != hot:
                    continue
                start, extra = divmod(one["pos"], 256)
                piece = text[start : start + length + extra].tobytes()
                if hot:
                    out += [(0, docs[i], subs[i], start + k, hashlib.blake2b(piece[k : k + length], digest_size=16).digest()) for k in range(extra + 1)]
                else:
                    out.append(((one["m"] & _LAST) % buckets, docs[i], subs[i], start, piece))
            if len(out) > 20_000 or i == len(docs) - 1:
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["bucket", "doc", "sub", "start", "data"])
                    out = []


def prefix_ranks(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the `length`-byte strings that start at `at`, in suffix order; equal strings have equal ranks.

    Prefix doubling: ranks of 8 bytes give those of 16, 32, ... and at last two overlapping ones those of `length`.
    """
    n = len(data)
    words = np.ndarray((n,), ">u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,)).astype(U64)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    span = 8
    while span * 2 <= length:
        more = np.concatenate([rank[span:], np.zeros(min(span, n), np.int64)])
        rank = np.unique(rank * n + more, return_inverse=True)[1].astype(np.int64)
        span *= 2
    if span < length:
        return np.unique(rank[at] * n + rank[at + (length - span)], return_inverse=True)[1].astype(np.int64)
    return rank[at]


def _nearest_smaller(order: np.ndarray) -> np.ndarray:
    """For each entry the nearest place before it with a smaller value, or -1.

    Each place points to one before which it has only greater ones in between; while that one is greater too, its own
    pointer is followed. All places move at once, those that have arrived drop out.
    """
    near = np.arange(len(order)) - 1
    open_ = np.arange(1, len(order))
    while len(open_):
        at = near[open_]
        open_ = open_[(at >= 0) & (order[at] > order[open_])]
        near[open_] = near[near[open_]]
    return near


def nearest_earlier(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a suffix array (positions in suffix order): of each entry, the place in it of the previous and of the next
    smaller position, or -1."""
    back = _nearest_smaller(order[::-1])[::-1]
    return _nearest_smaller(order), np.where(back >= 0, len(order) - 1 - back, -1)


def longest_previous_factors(data: bytes) -> np.ndarray:
    """LPF of a text: for each position, the most bytes from it on that also start earlier (overlaps count)."""
    n = len(data)
    order = np.array(sorted(range(n), key=lambda i: data[i:]), dtype=np.int64)
    before, after = nearest_earlier(order)
    out = np.zeros(n, dtype=np.int64)
    for i, p in enumerate(order.tolist()):
        for j in (before[i], after[i]):
            if j >= 0:
                q, k = int(order[j]), 0
                while p + k < n and data[p + k] == data[q + k]:
                    k += 1
                out[p] = max(out[p], k)
    return out


def repeated_windows(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the windows that start at `at` (ascending, in order of precedence) have LPF >= length among them.

    The windows in suffix order, equal ones by position, are the suffix array cut at `length`. A window's longest previous factor
    is the longer of what it has in common with the previous and with the next smaller position; both are
    compared by the ranks of their `length` bytes, which are equal where the bytes are.
    """
    rank = prefix_ranks(data, at, length)
    order = np.argsort(rank, kind="stable")
    out = np.zeros(len(at), dtype=bool)
    for near in nearest_earlier(order):
        out[order] |= (near >= 0) & (rank[order[near]] == rank[order])
    return out


def _factors(group: pa.Table, length: int) -> pa.Table:
    """Repeated stretches (doc, sub, pos) among the pieces of one bucket."""
    group = group.sort_by([("doc", "ascending"), ("sub", "ascending"), ("start", "ascending")])
    doc, sub, start = (group[c].to_numpy() for c in ("doc", "sub", "start"))
    other = np.ones(len(doc), dtype=bool)  # rows that repeat id and text have sent the same piece
    other[1:] = (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (start[1:] != start[:-1])
    group = group.filter(pa.array(other))
    data, offs = buffers(group["data"].combine_chunks())
    doc, sub, start = (group[c].to_numpy() for c in ("doc", "sub", "start"))
    count = np.diff(offs) - length + 1
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offs[:-1], count)
    hit = np.flatnonzero(repeated_windows(data, at, length))
    row, at = row[hit], at[hit]
    begin = np.ones(len(hit), dtype=bool)
    begin[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    a = np.flatnonzero(begin)
    b = np.concatenate([a[1:], [len(hit)]]) - 1 if len(a) else a
    pos = (start[row[a]] + at[a] - offs[row[a]]) * 256 + (at[b] - at[a])
    give_back()
    return pa.table({"doc": pa.array(doc[row[a]], pa.int64()), "sub": pa.array(sub[row[a]], pa.int64()), "pos": pa.array(pos, pa.int64())})


def removed_runs(pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs covered by stretches."""
    if not len(pos):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pos = np.sort(pos)
    start, stop = pos >> 8, (pos >> 8) + (pos & 255) + length
    reach = np.maximum.accumulate(stop)
    new = np.ones(len(pos), dtype=bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return start[first], reach[np.concatenate([first[1:], [len(pos)]]) - 1]


def _cut(batches: Iterable[pa.RecordBatch], length: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = buffers(batch.column(2))
        lists = batch.column(3)
        n_bytes, n_removed, n_spans, digest, texts, starts, stops = [], [], [], [], [], [], []
        for i in range(batch.num_rows):
            text = data[offs[i] : offs[i + 1]]
            pos = lists[i].values
            a, b = removed_runs(np.asarray(pos.to_numpy(zero_copy_only=False), np.int64) if pos is not None else np.zeros(0, np.int64), length)
            edges = np.concatenate([[0], np.stack([a, b], axis=1).ravel(), [len(text)]])
            kept = b"".join(text[x:y].tobytes() for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()))
            n_bytes.append(len(text))
            n_removed.append(len(text) - len(kept))
            n_spans.append(len(a))
            digest.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append(kept)
                starts.append(a)
                stops.append(b)
        columns = [batch.column(0), batch.column(1), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())]
        names = ["doc", "sub", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            columns += [pa.array(texts, pa.binary()), pa.array(starts, pa.list_(pa.int64())), pa.array(stops, pa.list_(pa.int64()))]
            names += ["kept", "starts", "stops"]
        yield pa.RecordBatch.from_arrays(columns, names)


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, sub, text): doc orders documents; sub tells apart texts of one id (0 where ids are unique, below 0: null ids)."""
    rows = docs.select(docs[key].cast("bigint").alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    plain = rows.select(F.coalesce("id", F.lit(_LAST)).alias("doc"), F.lit(0).cast("bigint").alias("sub"), "text")
    twice = rows.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    n, nulls = twice.count(), not rows.where("id is null").isEmpty()
    if not n and not nulls:
        return plain
    twice = written(twice.withColumn("twice", F.lit(True)))
    told = rows.where("id is not null").join(F.broadcast(twice) if n <= BROADCAST_ROWS else twice, "id", "left").withColumn("twice", F.coalesce("twice", F.lit(False)))
    told = told.select("id", "text", "twice").union(rows.where("id is null").select("id", "text", F.lit(False)))
    mark = F.pmod(F.xxhash64("text"), F.lit(1 << 62)) + 1
    return told.select(F.coalesce("id", F.lit(_LAST)).alias("doc"), F.when(F.col("id").isNull(), mark - (1 << 62) - 1).when(F.col("twice"), mark).otherwise(F.lit(0)).cast("bigint").alias("sub"), "text")


def later_places(windows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(doc, sub, start) of all but the first of equal windows (data: their digest).

    Copies are dealt out in `salts` parts; the first of each part, at most so many, then meet.
    """
    place = F.struct("doc", "sub", "start")
    salt = F.pmod(F.xxhash64("doc"), F.lit(salts))
    placed = windows.withColumn("salt", salt).withColumn("first", F.min(place).over(Window.partitionBy("data", "salt")))
    later = placed.where(place != F.col("first")).select("doc", "sub", "start")
    leads = placed.where(place == F.col("first")).groupBy("data").agg(F.collect_set("first").alias("all"))
    return later.union(leads.select(F.explode(F.filter("all", lambda x: x != F.array_min("all"))).alias("x")).select("x.*"))


def remove(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES, with_text: bool = True) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept, starts, stops]) of every row of docs."""
    if not 3 * GRAM <= length <= 7 * GRAM // 2:  # stretches of up to 2 * length - GRAM bytes must be covered by their content hash
        raise ValueError(f"length must lie in [{3 * GRAM}, {7 * GRAM // 2}]")
    rows = _identified(docs, key, text)
    told = rows.mapInArrow(lambda it: _describe(it, length), "m bigint, s bigint, doc bigint, sub bigint, pos bigint, again boolean")
    # those known to be repeated need no group: they are spread evenly, whatever text they repeat
    dealt = told.repartition(F.when(F.col("again"), F.xxhash64("doc", "sub", "pos")).otherwise(F.col("m")))
    found = written(dealt.sortWithinPartitions("again", "m", "s", "doc", "sub", "pos").mapInArrow(_resolve, "doc bigint, sub bigint, pos bigint, m bigint"))
    ask = found.where("m is not null")
    crowded = written(ask.groupBy("m").count().where(F.col("count") > hot).select("m"))
    n, n_crowded = ask.count(), crowded.count()
    buckets = max(1, n * (length + 30) // bucket_bytes)

    if n_crowded:
        ask = ask.join((F.broadcast(crowded) if n_crowded <= BROADCAST_ROWS else crowded).withColumn("hot", F.lit(True)), "m", "left")
        ask = ask.withColumn("hot", F.coalesce("hot", F.lit(False)))
    else:
        ask = ask.withColumn("hot", F.lit(False))
    asked = ask.groupBy("doc", "sub").agg(F.collect_set(F.struct("pos", "m", "hot")).alias("asked"))
    met = rows.join(asked, ["doc", "sub"]).select("doc", "sub", "text", "asked")

    def fetched(of: DataFrame, hot: bool) -> DataFrame:
        return of.mapInArrow(lambda it: _fetch(it, buckets, length, hot), "bucket bigint, doc bigint, sub bigint, start bigint, data binary")

    spans = found.where("m is null").select("doc", "sub", "pos")
    if n_crowded:
        windows = fetched(met.where(F.exists("asked", lambda x: x["hot"])), True).select("doc", "sub", "start", "data")
        spans = spans.union(later_places(windows).select("doc", "sub", F.expr("start * 256")))
    spans = spans.union(fetched(met, False).groupBy("bucket").applyInArrow(lambda t: _factors(t, length), "doc bigint, sub bigint, pos bigint"))
    spans = spans.groupBy("doc", "sub").agg(F.collect_set("pos").alias("spans"))
    schema = "doc bigint, sub bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary, starts array<bigint>, stops array<bigint>" if with_text else "")
    cut = rows.join(spans, ["doc", "sub"], "left").select("doc", "sub", "text", F.coalesce("spans", F.expr("cast(array() as array<bigint>)")).alias("spans")).mapInArrow(lambda it: _cut(it, length, with_text), schema)
    return cut.select(F.when(F.col("sub") >= 0, F.col("doc")).alias(key), *[c for c in cut.columns if c not in ("doc", "sub")])
