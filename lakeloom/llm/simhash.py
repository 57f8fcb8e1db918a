"""SimHash fingerprints of whole texts, and groups of fingerprints that lie within a few bits.

Fingerprint: the text with A-Z lowered is cut into words, the words into overlapping 3-word shingles
(repeats included; a shorter text is one shingle of all its words), each shingle is hashed with XXH64
(seed 42), and a bit is 1 if it is 1 in over half of the hashes. A text without words has fingerprint
zero and is linked like any other; a null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm._components import components
from lakeloom.llm._durable import cut
from lakeloom.llm._text import U64, buffers, give_back, mix64, slices, word_spans

SHINGLE = 3
SEED = 42
# The five primes of XXH64.
P1, P2, P3, P4, P5 = map(U64, (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.float64)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _xxh64_of_length(words8: np.ndarray, words4: np.ndarray, data: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """XXH64 of the spans of one length that start at `at`."""
    with np.errstate(over="ignore"):
        seed_, pos = U64(seed), 0
        if length >= 32:
            v = [np.full(len(at), x, dtype=U64) for x in (seed_ + P1 + P2, seed_ + P2, seed_, seed_ - P1)]
            while pos + 32 <= length:
                for lane in range(4):
                    v[lane] = _rotl(v[lane] + words8[at + (pos + 8 * lane)] * P2, 31) * P1
                pos += 32
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                h = (h ^ (_rotl(x * P2, 31) * P1)) * P1 + P4
        else:
            h = np.full(len(at), seed_ + P5, dtype=U64)
        h = h + U64(length)
        while pos + 8 <= length:
            h = _rotl(h ^ (_rotl(words8[at + pos] * P2, 31) * P1), 27) * P1 + P4
            pos += 8
        if pos + 4 <= length:
            h = _rotl(h ^ (words4[at + pos].astype(U64) * P1), 23) * P2 + P3
            pos += 4
        while pos < length:
            h = _rotl(h ^ (data[at + pos].astype(U64) * P5), 11) * P1
            pos += 1
        h = (h ^ (h >> U64(33))) * P2
        h = (h ^ (h >> U64(29))) * P3
        return h ^ (h >> U64(32))


def xxh64_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many spans of one buffer: spans of equal length are hashed together."""
    out = np.empty(len(starts), dtype=U64)
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    words8 = np.ndarray((len(data) + 1,), "<u8", raw, strides=(1,))
    words4 = np.ndarray((len(data) + 1,), "<u4", raw, strides=(1,))
    order = np.argsort(lengths.astype(np.uint16) if len(lengths) and lengths.max() < 65536 else lengths, kind="stable")
    at = starts[order]
    size = lengths[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(size)) + 1, [len(size)]]) if len(size) else np.zeros(1, int)
    view = memoryview(raw)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        n = int(size[a])
        if b - a < 4 or n > 4096:
            got = np.array([xxhash.xxh64_intdigest(view[s : s + n], seed) for s in at[a:b].tolist()], dtype=U64)
        else:
            got = _xxh64_of_length(words8, words4, raw, at[a:b], n, seed)
        out[order[a:b]] = got
    return out


def fingerprints_of(data: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of the texts that lie in `data` between successive offsets."""
    low, starts, ends, first = word_spans(data, offs)
    lengths = ends - starts
    joined = np.full(int(lengths.sum()) + len(starts), 0x20, dtype=np.uint8)
    word = np.repeat(np.arange(len(starts)), lengths)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined[np.arange(len(word)) + word] = low[np.repeat(starts - begin[:-1], lengths) + np.arange(len(word)) + word]
    counts = np.diff(first)
    n = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    doc = np.repeat(np.arange(len(counts)), n)
    head = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[:-1][doc]
    last = np.minimum(head + shingle, first[1:][doc]) - 1
    at = begin[head]
    h = xxh64_spans(joined, at, begin[last] + lengths[last] - at)
    return majority(h, doc, n)


def majority(h: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64 bits of each text: 1 if set in over half of its n hashes; doc: the text of each hash."""
    ones = np.empty((len(n), 64))
    lanes = h.view(np.uint8).reshape(-1, 8) if len(h) else np.zeros((0, 8), np.uint8)
    for k in range(8):
        seen = np.bincount(doc * 256 + lanes[:, k], minlength=256 * len(n)).reshape(len(n), 256)
        ones[:, 8 * k : 8 * k + 8] = seen @ BITS
    bits = 2 * ones > n[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def _fingerprint_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [fingerprints_of(data, offs) for _, _, data, offs in slices(batch.column(1))]
        found = np.concatenate(parts) if parts else np.zeros(0, U64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64), pa.int64())], ["key", "fp"])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp bigint: the 64 bits, signed) of each row; rows are independent and nothing is shuffled."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(_fingerprint_batches, f"key {kind}, fp bigint").withColumnRenamed("key", key)


HALF = 32
#: Members of one segment value beyond which its links are found by masks and not by pairs. Both ways are exact.
HOT_SEGMENT = 1000


def _segments(fps: DataFrame, at: str) -> DataFrame:
    """fps with each of its two 32-bit segments: segment, key (its value), other (the value of the other one)."""
    low, high = "fp & 4294967295L", "shiftrightunsigned(fp, 32)"
    return fps.selectExpr(at, "fp", f"explode(array(named_struct('segment', 0, 'key', {low}, 'other', {high}), named_struct('segment', 1, 'key', {high}, 'other', {low}))) s").select(at, "fp", "s.*")


def close_pairs(fps: DataFrame, *, node: str = "node", hot: int = HOT_SEGMENT) -> DataFrame:
    """Links (a, b) between distinct fingerprints at 2 or fewer differing bits, complete up to reachability.

    fps: (node, fp), one row for each distinct fp. Two such fingerprints differ by at most one bit in one of their
    two 32-bit segments. So each fingerprint looks up, in either segment's table, its own segment value and those at
    one bit (only with the bit set that it lacks: the partner looks up the other direction), and the matches'
    whole distance is verified. The work is 2 * 17 look-ups a fingerprint, whatever their number.

    A segment value with more than `hot` members is not paired but split by masks: its members with the same
    rest but for two masked bits (at most 4) or, with look-ups at one bit, one masked bit (at most 66) are linked
    in a star. No pair is lost to this: members within reach share a masked rest.
    """
    table = _segments(fps, node)
    probe = table.selectExpr(
        node, "fp", "segment", "other",
        "explode(concat(array(key), filter(transform(sequence(0, 31), i -> key | shiftleft(1L, i)), k -> k <> key))) key",
    )
    crowded = table.groupBy("segment", "key").count().where(F.col("count") > hot).select("segment", "key", F.lit(True).alias("crowded"))
    keys = ["segment", "key"]
    few = table.join(crowded, keys, "left_anti").select(*keys, F.col(node).alias("b"), F.col("fp").alias("fp_b"))
    pairs = probe.join(few, keys).where("fp <> fp_b and bit_count(fp ^ fp_b) <= 2").select(F.col(node).alias("a"), "b")
    many = probe.withColumn("member", F.expr("key = if(segment = 0, fp & 4294967295L, shiftrightunsigned(fp, 32))")).join(crowded, keys)
    one = many.selectExpr(node, "member", *keys, "explode(sequence(0, 31)) i", "other").selectExpr(node, "member", *keys, "i", "-1 j", "other & ~shiftleft(1L, i) rest")
    two = many.where("member").selectExpr(node, "member", *keys, "other", "explode(sequence(0, 30)) i").selectExpr(node, "member", *keys, "other", "i", "explode(sequence(i + 1, 31)) j")
    two = two.selectExpr(node, "member", *keys, "i", "j", "other & ~shiftleft(1L, i) & ~shiftleft(1L, j) rest")
    groups = one.union(two).groupBy(*keys, "i", "j", "rest").agg(F.collect_set(node).alias("all"), F.min(F.when(F.col("member"), F.col(node))).alias("b"))
    stars = groups.where("b is not null and size(all) > 1").select(F.explode("all").alias("a"), "b").where("a <> b")
    return pairs.union(stars)


#: Words of 64 bits and segments of 16 bits of a wide fingerprint; differing bits up to which two are close: at a similarity of 0.8 of
#: the sets 39 of 256 are expected, with a deviation of 6.
WIDE, SEGMENTS, RADIUS = 4, 16, 64
_LANES = mix64(np.arange(2001, 2001 + WIDE, dtype=U64))
#: Fingerprints that one group of the search holds, about; candidate pairs compared at a time; close pairs kept before they are reduced.
GROUP, AT_ONCE, KEPT = 65_536, 200_000, 300_000


def wide_prints(h: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints of 64 * WIDE bits (rows of words) of sets of shingle hashes."""
    return np.stack([majority(mix64(h ^ lane), doc, n) for lane in _LANES], axis=1)


def _dealt(batches: Iterable[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """(g, prints): fingerprints dealt out by segment and its `top` highest bits, and to the groups at one of these bits that
    they lack; packed as nodes, fingerprints, and whether the group is their own."""
    for batch in batches:
        node, words = batch.column(0).to_numpy(), buffers(batch.column(1))[0].view(U64).reshape(-1, WIDE)
        every, parts = np.arange(len(node)), []
        for k in range(SEGMENTS):
            high = words.view("<u2").reshape(-1, SEGMENTS)[:, k].astype(np.int64) >> (16 - top)
            parts.append((every, high + (k << top), np.ones(len(node), np.uint8)))
            for bit in range(top):
                lack = np.flatnonzero((high >> bit) & 1 == 0)
                parts.append((lack, (high[lack] | 1 << bit) + (k << top), np.zeros(len(lack), np.uint8)))
        at, g, own = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(g, kind="stable")
        at, g, own = at[order], g[order], own[order]
        some, begin = np.unique(g, return_index=True)
        cuts = [*begin.tolist(), len(g)]
        packed = [node[at[i:j]].tobytes() + words[at[i:j]].tobytes() + own[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], ["g", "prints"])


def _forest(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of links (distance, a, b) those that reach all, the closest first."""
    of: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := of.setdefault(x, x)) != x:
            of[x] = x = of[up]
        return x

    keep = []
    for k in np.lexsort((b, a, d)).tolist():
        x, y = root(int(a[k])), root(int(b[k]))
        if x != y:
            of[y] = x
            keep.append(k)
    return d[keep], a[keep], b[keep]


def _close_in_group(rows: pa.Table, top: int, radius: int) -> pa.Table:
    """(a, b): links of the close fingerprints of one group; those of its own segment values meet the same value and those at one bit
    that they lack, the others the same value (of the bits below the top, they differ in one of the top)."""
    node, words, own = [], [], []
    for blob in rows["prints"].to_pylist():
        n = len(blob) // (8 * WIDE + 9)
        node.append(np.frombuffer(blob, np.int64, n))
        words.append(np.frombuffer(blob, U64, n * WIDE, 8 * n).reshape(n, WIDE))
        own.append(np.frombuffer(blob, np.uint8, n, 8 * n * (WIDE + 1)))
    node, words, own = np.concatenate(node), np.concatenate(words), np.concatenate(own).astype(bool)
    low = 16 - top
    value = words.view("<u2").reshape(-1, SEGMENTS)[:, rows["g"][0].as_py() >> top].astype(np.int64) & ((1 << low) - 1)
    mine = np.flatnonzero(own)
    mine = mine[np.argsort(value[mine], kind="stable")]
    v = value[mine]
    starts = np.searchsorted(v, np.arange((1 << low) + 1))
    asks = [(mine, np.arange(1, len(v) + 1), starts[v + 1]), (other := np.flatnonzero(~own), starts[value[other]], starts[value[other] + 1])]
    for bit in range(low):
        lack = np.flatnonzero((v >> bit) & 1 == 0)
        to = v[lack] | 1 << bit
        asks.append((mine[lack], starts[to], starts[to + 1]))
    found = [(np.zeros(0, np.int64),) * 3]
    for who, since, until in asks:
        total = np.concatenate([[0], np.cumsum(until - since)])
        i = 0
        while i < len(who):
            j = max(int(np.searchsorted(total, total[i] + AT_ONCE, side="right")) - 1, i + 1)
            many = (until - since)[i:j]
            x = np.repeat(who[i:j], many)
            y = mine[np.arange(total[j] - total[i]) + np.repeat(since[i:j] - (total[i:j] - total[i]), many)]
            d = np.bitwise_count(words[x] ^ words[y]).sum(1, dtype=np.int64)
            near = np.flatnonzero(d <= radius)
            x, y = node[x[near]], node[y[near]]
            found.append((d[near], np.minimum(x, y), np.maximum(x, y)))
            if sum(len(f[0]) for f in found) > KEPT:
                found = [_forest(*(np.concatenate(f) for f in zip(*found)))]
            i = j
    _, a, b = _forest(*(np.concatenate(f) for f in zip(*found)))
    give_back()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def wide_links(prints: DataFrame, *, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """Links (a, b), a below b, between wide fingerprints (node bigint, fp binary) that lie within `radius` bits and differ by at most one bit in
    one of their segments: each group's links reach all that its close pairs reach, the closest first.

    Multi-index search as in close_pairs, with 16 tables: segment values and balls of one bit, distances verified. Groups are the
    highest bits of a segment, so many that one has about `group` fingerprints; the other bits' balls are looked up within
    the group, so a fingerprint travels 16 * (1 + half of these bits) times and not 16 * 17 / 2. The comparisons, of some tens of nanoseconds
    each, are a fixed share (0.4 %) of all pairs.
    """
    n, top = prints.count(), 0
    while top < 16 and n >> top > group:
        top += 1
    dealt = prints.mapInArrow(lambda it: _dealt(it, top), "g int, prints binary")
    return dealt.groupBy("g").applyInArrow(lambda rows: _close_in_group(rows, top, radius), "a bigint, b bigint").distinct()


#: A fingerprint with more than one row in so many is joined to its rows by a broadcast; there are fewer than this.
CROWDED = 10_000


def groups(prints: DataFrame, *, key: str = "doc_id", hot: int = HOT_SEGMENT) -> DataFrame:
    """(key, fp, component) of each (key, fp): component is the smallest key reachable over links, itself included.

    Equal fingerprints meet in one row first (a partial aggregation, so that thousands of copies cost no more than
    one), links and components are those of distinct fingerprints. Rows that share a key but not their fingerprint are told apart:
    each has the component of its own fingerprint. Null keys stay rows of their own group null.
    """
    prints = cut(prints.select(key, "fp"))
    nodes = cut(prints.where(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("copies")).withColumn("node", F.col("fp")))
    found = cut(components(close_pairs(nodes.select("node", "fp"), hot=hot)))
    smallest = found.join(nodes, "node").groupBy("component").agg(F.min("least").alias("smallest"))
    linked = found.join(smallest, "component").select("node", "smallest")
    labels = cut(nodes.join(linked, "node", "left").select("fp", "copies", F.coalesce("smallest", "least").alias("component")))
    total = labels.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    crowded = F.col("copies") * CROWDED > total
    few = F.broadcast(labels.where(crowded).select("fp", F.col("component").alias("known"), F.lit(True).alias("crowded")))
    told = prints.join(few, "fp", "left")
    done = told.where("crowded").select(key, "fp", F.col("known").alias("component"))
    rest = told.where("crowded is null").select(key, "fp").join(labels.where(~crowded).select("fp", "component"), "fp", "left")
    return done.union(rest.select(key, "fp", "component")).select(key, "fp", F.when(F.col(key).isNotNull(), F.col("component")).alias("component"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint: 16 hex digits, component_id) of every row of docs."""
    out = groups(fingerprints(docs, key=key, text=text), key=key)
    return out.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
