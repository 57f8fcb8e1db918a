"""Class-based bigram language model: exchange clustering of the vocabulary, and log probabilities of whole texts.

Words are runs other than ASCII white space with A-Z lowered; each text is followed by an end token. All counts are
taken over all training texts. Every word has a class: words of at least MIN_COUNT tokens get one of CLASSES by exchange
clustering; every other word, seen or not, has the class of its shape (length and kind of its last character); the end
token is a class of its own (whose only word it is, so that its emission is 1), and the first word of a text follows it.

    log10 P(text) = sum over tokens of log10 P(class | last class) + log10 P(word | class)
    P(word | class) = (c + 0.5) / (N_class + 0.5 * (V_class + 1))
    P(class | last) = (n(last, class) + SMOOTH * (N_class + 0.5) / (N + 0.5 * classes)) / (n(last) + SMOOTH)

Exchange: the SEEDS most frequent words are moved one by one, each to the class with the greatest likelihood, on their table
of pairs, which is of fixed size. Then all others are moved, in rounds: their links (word, neighbour) stay in Spark, dealt out
in buckets of words; a round turns a word's links into counts by the neighbours' classes and moves it to the class that makes the
words before and after it likeliest, given the class pairs so far (such a word is at most 1 / SEEDS of all tokens). From the second round on,
words move in turns of one half, and a round counts only if the likelihood, taken anew from all pairs, has risen. Texts are turned into sequences of symbols once; class pairs are counted on these.
Training asks for nothing but neighbours, so a sequence may have breaks.

The hashes, counts and symbols of the HELD most frequent clustered words are held in memory, in the driver and in the workers
(20 bytes each; held=None holds all). All others are ranked in Spark. They are breaks of the texts' sequences, which stay where they are;
such a word and its two neighbours make a short sequence of their own, shuffled by the word's hash to its symbol (a neighbour that isn't
held either goes first, to its own symbol). So they are clustered like any: the result doesn't depend on `held`. What grows with the vocabulary is the class
of each clustered word while training (two bytes a word; the driver takes 20 more for a moment, for shapes and moves). Scoring joins
the words of a text that aren't held to their counts and classes, once for each text and word, and takes the steps
between classes when they are known. Words are identified by a 64-bit hash.

Defined results: a null text is an empty text, whose only token is the end. Without a training text (no rows, or all held out)
nothing is known: every class is equally likely, and so is every word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm._durable import written
from lakeloom.llm._text import U64, buffers, slices, span_hashes, word_spans

MIN_COUNT, HELD = 2, 1_000_000
SEEDS, CLASSES, PASSES, ROUNDS, SMOOTH = 1_000, 128, 4, 3, 5.0
#: Words are dealt out in buckets of about so many words, or tokens if that makes more buckets, up to so many.
BUCKET_WORDS, BUCKET_TOKENS, MOST_BUCKETS = 2_000, 4_000_000, 1 << 14
_LAST = np.full(256, 3, dtype=np.int64)  # punctuation and symbols
_LAST[list(b"aeiou")] = 0
_LAST[list(b"bcdfghjklmnpqrstvwxyz")] = 1
_LAST[list(b"0123456789")] = 2
_LAST[128:] = 4
_LENGTHS = np.array([3, 7, 12])
SHAPES = 20
END = SHAPES  # symbols: shapes, the end, then clustered words, the most frequent first
FIXED = SHAPES + 1
BREAK = -1  # in a sequence: what is before it isn't next to what is after it


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape, first word of each text) of all words."""
    low, starts, ends, first = word_spans(data, offs)
    shape = np.searchsorted(_LENGTHS, ends - starts, side="right") * 5 + _LAST[low[ends - 1]] if len(starts) else np.zeros(0, np.int64)
    return span_hashes(low, starts, ends), shape, first


def _with_ends(values: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """Values of words with the end's value after each text."""
    return np.insert(values, first[1:], end)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Position of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class _Tally:
    """Counts by 64-bit key (and a label that the key implies), compacted as they grow."""

    def __init__(self, limit: int = 1_000_000):
        self.limit, self.size, self.parts = limit, 0, []

    def add(self, keys: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> None:
        u, at, back = np.unique(keys, return_index=True, return_inverse=True)
        self.parts.append((u, labels[at], np.bincount(back, weights=counts, minlength=len(u)).astype(np.int64)))
        self.size += len(u)

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts, self.parts, self.size = self.parts, [], 0
        if not parts:
            return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.add(*(np.concatenate(x) for x in zip(*parts)))
        (out,) = self.parts
        self.parts, self.size = [], 0
        return out

    def full(self) -> bool:
        return self.size > self.limit

    def compact(self) -> None:
        out = self.merged()
        self.parts, self.size = [out], len(out[0])


def _emit(tally: _Tally, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    keys, labels, counts = tally.merged()
    for i in range(0, len(keys), 200_000):
        part = slice(i, i + 200_000)
        yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(labels[part]), pa.array(counts[part])], list(names))


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = _Tally()
    for batch in batches:
        for _, _, data, offs in slices(batch.column(0)):
            h, shape, _ = _tokens(data, offs)
            tally.add(h, shape)
            if tally.full():
                tally.compact()
                if tally.full():
                    yield from _emit(tally, ("h", "shape", "n"))
    yield from _emit(tally, ("h", "shape", "n"))


@dataclass
class Vocabulary:
    """Hashes of the clustered words, sorted, with the symbol and the count of each."""

    hashes: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray

    def symbols_of(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        at = _find(self.hashes, h)
        return np.where(at >= 0, self.symbols[at], shape) if len(self.hashes) else shape


def _others(owner: np.ndarray, h: np.ndarray, place: np.ndarray, owners: int) -> list[pa.Array]:
    """The distinct words of each owner, as hashes, and the places of each."""
    order = np.lexsort((h, owner))
    owner, h, place = owner[order], h[order], place[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    cuts = pa.array(np.searchsorted(owner[begin], np.arange(owners + 1)).astype(np.int32))
    places = pa.ListArray.from_arrays(pa.array(np.append(begin, len(h)).astype(np.int32)), pa.array(place.astype(np.int32)))
    return [pa.ListArray.from_arrays(cuts, pa.array(h[begin].view(np.int64))), pa.ListArray.from_arrays(cuts, places)]


def _fill(flat: np.ndarray, starts: np.ndarray, values: pa.Array, places: pa.Array) -> None:
    """Writes each owner's values (a list) to their places (a list of lists), counted from the owner's start."""
    owner = np.repeat(np.arange(len(values)), values.value_lengths().to_numpy(zero_copy_only=False))
    inner = places.flatten()
    times = inner.value_lengths().to_numpy(zero_copy_only=False)
    flat[starts[np.repeat(owner, times)] + inner.flatten().to_numpy()] = np.repeat(values.flatten().to_numpy(), times)


def _list(names: list[str], columns: list[pa.Array]) -> pa.Array:
    """One list of structs."""
    return pa.ListArray.from_arrays(pa.array([0, len(columns[0])], pa.int32()), pa.StructArray.from_arrays(columns, names))


def _sequences(batches: Iterable[pa.RecordBatch], words: Vocabulary, more: bool) -> Iterator[pa.RecordBatch]:
    """Symbols of runs of whole texts, each text with its end, as packed 32-bit numbers.

    If there are more words than these, the run's words that aren't among them are breaks, and listed: each with the symbols before
    and after its places (32 bits each, big-endian, a break for another such word), and pairs of two such words.
    """
    for batch in batches:
        for _, _, data, offs in slices(batch.column(0)):
            h, shape, first = _tokens(data, offs)
            s = _with_ends(words.symbols_of(h, shape), first, END).astype(np.int32)
            open_ = np.flatnonzero(_find(words.hashes, h) < 0) if more else np.zeros(0, np.int64)
            place = open_ + np.searchsorted(first[1:], open_, side="right")
            s[place] = BREAK
            h, shape = h[open_], shape[open_].astype(np.int8)
            sides = np.stack([np.where(place > 0, s[place - 1], END), s[place + 1]], axis=1).astype(">i4")
            one = np.flatnonzero(sides[:, 1] == BREAK)  # the next such word is next to it
            pairs = [pa.array(x) for x in (h[one].view(np.int64), shape[one], h[one + 1].view(np.int64), shape[one + 1])]
            some = np.flatnonzero((sides != BREAK).any(axis=1))
            some = some[np.argsort(h[some], kind="stable")]
            begin = np.flatnonzero(np.append(True, h[some[1:]] != h[some[:-1]])) if len(some) else some
            cuts, kind = pa.py_buffer((np.append(begin, len(some)) * 8).astype(np.int32)), some[begin]
            around = pa.Array.from_buffers(pa.binary(), len(begin), [None, cuts, pa.py_buffer(sides[some].tobytes())])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s.tobytes()], pa.binary()),
                    _list(["h", "shape", "around"], [pa.array(h[kind].view(np.int64)), pa.array(shape[kind]), around]),
                    _list(["h", "shape", "next", "next_shape"], pairs),
                ],
                ["s", "words", "pairs"],
            )


def _filled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences of the words that weren't held, each between its neighbours, from (symbol, around)."""
    for batch in batches:
        data, cuts = buffers(batch.column(1))
        s = np.full((len(data) // 8, 4), BREAK, np.int32)
        s[:, [0, 2]] = data.view(">i4").reshape(-1, 2)
        s[:, 1] = np.repeat(batch.column(0).to_numpy(), np.diff(cuts) // 8)
        yield pa.RecordBatch.from_arrays([pa.array([np.append(np.int32(BREAK), s).tobytes()], pa.binary())], ["s"])


def _met(owners: DataFrame, by: str, words: DataFrame, value: str, *sums: Column) -> DataFrame:
    """For each owner (by, h, places: lists), its words' values and their places, and sums over its words; a left join."""
    asked = owners.selectExpr(by, "explode(arrays_zip(h, places)) x").selectExpr(by, "x.h h", "x.places places")
    known = F.collect_list(F.when(F.col(value).isNotNull(), F.struct(value, "places"))).alias("known words")
    return asked.join(words, "h", "left").groupBy(by).agg(known, *sums).selectExpr("*", f"`known words`.{value} {value}", "`known words`.places places").drop("known words")


def _class_pairs(batches: Iterable[pa.RecordBatch], of: np.ndarray, total: int) -> Iterator[pa.RecordBatch]:
    """(pair: class * total + next class, n) over all sequences."""
    cells = None
    for batch in batches:
        for blob in batch.column(0):
            s = np.frombuffer(blob.as_buffer(), np.int32)
            c = of[s].astype(np.int64)
            pair, broken = np.concatenate([[END], c[:-1]]) * total + c, s == BREAK
            if broken.any():
                broken[1:] |= s[:-1] == BREAK
                pair = pair[~broken]
            part = np.bincount(pair, minlength=total * total)
            cells = part if cells is None else cells + part
    if cells is not None:
        pair = np.flatnonzero(cells)
        for i in range(0, len(pair), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pair[i : i + 100_000]), pa.array(cells[pair[i : i + 100_000]])], ["pair", "n"])


def _links(batches: Iterable[pa.RecordBatch], first: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, links) of the words from symbol `first` on: their places in the bucket (16 bits) and then their neighbours
    (32 bits: twice the symbol after the word, or twice the one before it plus one), packed."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def rows() -> pa.RecordBatch:
        word, other = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(word % buckets, kind="stable")
        word, other = word[order], other[order]
        cuts = np.searchsorted(word % buckets, np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cuts))
        place = (word // buckets).astype(np.uint16)
        packed = [place[cuts[k] : cuts[k + 1]].tobytes() + other[cuts[k] : cuts[k + 1]].tobytes() for k in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], ["bucket", "links"])

    for batch in batches:
        for blob in batch.column(0):
            s = np.frombuffer(blob.as_buffer(), np.int32)
            at = np.flatnonzero(s >= first)
            word = s[at] - first
            for other, side in ((s[at + 1], 0), (np.where(at > 0, s[at - 1], END), 1)):
                met = other != BREAK
                held.append((word[met], other[met] * 2 + side))
            if sum(len(w) for w, _ in held) > 1_000_000:
                yield rows()
    if held:
        yield rows()


def _moved(batches: Iterable[pa.RecordBatch], first: int, buckets: int, words: int, of: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray], turn: int | None) -> Iterator[pa.RecordBatch]:
    """(word, class) of the words that another class suits better, from links that come bucket by bucket; turn: 0 or 1, or all.

    Held are one bucket's counts by class and some links, whatever their number.
    """
    after, before, log_size = tables
    total = len(log_size)
    now, counts, parts = -1, np.zeros(0), []

    def add() -> None:
        nonlocal counts
        if parts:
            cell = np.concatenate(parts)
            parts.clear()
            more = np.bincount(cell, minlength=len(counts))
            counts += more

    def judged() -> pa.RecordBatch:
        add()
        both = counts.reshape(-1, 2 * total)
        symbols = first + now + buckets * np.arange(len(both))
        o, i = both[:, :total], both[:, total:]
        gain = o @ after.T + i @ before.T - o.sum(1)[:, None] * log_size[None, :]
        gain[:, :FIXED] = -np.inf
        to = gain.argmax(1)
        pick = to != of[symbols]
        if turn is not None:
            pick &= np.arange(len(both)) % 2 == turn
        return pa.RecordBatch.from_arrays([pa.array(symbols[pick], pa.int32()), pa.array(to[pick], pa.int32())], ["word", "class"])

    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if bucket != now:
                if now >= 0:
                    yield judged()
                now, counts = bucket, np.zeros(-(-(words - bucket) // buckets) * 2 * total)
            raw = blob.as_buffer()
            n = len(raw) // 6
            place, other = np.frombuffer(raw, np.uint16, n).astype(np.int64), np.frombuffer(raw, np.int32, n, 2 * n)
            parts.append(place * (2 * total) + (other & 1) * total + of[other >> 1])
            if sum(map(len, parts)) > 500_000:
                add()
    if now >= 0:
        yield judged()


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def likelihood(m: np.ndarray) -> float:
    """The part of a class bigram model's log likelihood that depends on the classes."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(0)).sum() - _xlogx(m.sum(1)).sum())


def exchange_pass(m: np.ndarray, out: np.ndarray, into: np.ndarray, own: np.ndarray, of: np.ndarray, fixed: int) -> np.ndarray:
    """New classes of words after one pass; m: class pairs, out/into: a word's counts by the class after/before it,
    own: of a word after itself, of: classes so far; the first `fixed` classes take and lose no words."""
    m, of = m.astype(np.float64).copy(), of.copy()
    members = np.bincount(of, minlength=len(m))
    for w in np.argsort(-out.sum(1), kind="stable"):
        a, o, i, s = of[w], out[w].astype(np.float64), into[w].astype(np.float64), float(own[w])
        if members[a] <= 1:
            continue
        m[a] -= o
        m[:, a] -= i
        m[a, a] += s
        o[a] -= s  # pairs of the word with itself go where it goes
        i[a] -= s
        rows, cols = m.sum(1), m.sum(0)
        d = np.arange(len(m))
        gain = (_xlogx(m + o) - _xlogx(m)).sum(1) + (_xlogx(m + i[:, None]) - _xlogx(m)).sum(0)
        diag = m[d, d]
        gain += _xlogx(diag + o + i + s) + _xlogx(diag) - _xlogx(diag + o) - _xlogx(diag + i)
        gain -= _xlogx(rows + o.sum() + s) - _xlogx(rows) + _xlogx(cols + i.sum() + s) - _xlogx(cols)
        # the other classes' sums gain the word's pairs wherever it goes
        gain[:fixed] = -np.inf
        b = int(np.argmax(gain))
        m[b] += o
        m[:, b] += i
        m[b, b] += s
        members[a] -= 1
        members[b] += 1
        of[w] = b
    return of


@dataclass
class Model:
    """All that scoring holds in memory: bounded by the words held and the number of classes squared."""

    words: Vocabulary
    symbol_class: np.ndarray  # class of each symbol, those of the words held
    transition: np.ndarray  # log10 P(class | last class)
    spread: np.ndarray  # log10 of each class's emission denominator
    tokens: int
    types: int
    ends: int


def _ranked(counts: DataFrame, min_count: int) -> DataFrame:
    """(rank, h, shape, n) of the words of min_count or more tokens: from 0, the most frequent first, ties by hash. Nothing is
    gathered: ranks are places in the partitions of a sorted table."""
    order = (F.desc("n"), F.col("h").bitwiseXOR(F.lit(-(1 << 63))))
    rows = written(counts.where(F.col("n") >= min_count).orderBy(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before, starts = 0, {}
    for p, n in sorted(rows.groupBy(part).count().collect()):
        starts[p], before = before, before + n
    start = F.create_map(*[F.lit(x).cast("bigint") for p in starts.items() for x in p])[part] if starts else F.lit(0)
    return rows.select((F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + start).alias("rank"), "h", F.col("shape").cast("byte").alias("shape"), "n")


def _classed(batches: Iterable[pa.RecordBatch], of: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(h, shape, n, class) of words (rank, h, shape, n)."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(of[FIXED + batch.column(0).to_numpy()].astype(np.int32))], ["h", "shape", "n", "class"])


def seed_classes(pairs: np.ndarray, classes: int, passes: int) -> np.ndarray:
    """Classes of the seeds (symbols from FIXED on, the most frequent first) by exchange on the table of symbol pairs."""
    seeds = len(pairs) - FIXED
    total = FIXED + classes
    of = np.concatenate([np.arange(FIXED), FIXED + np.arange(seeds) % classes])
    one = np.eye(total)
    last, best = -np.inf, of
    for _ in range(passes + 1):
        hot = one[of]
        out, into = pairs @ hot, pairs.T @ hot
        m = hot.T @ out
        if (now := likelihood(m)) <= last:
            break
        last, best = now, of
        of = np.concatenate([of[:FIXED], exchange_pass(m, out[FIXED:], into[FIXED:], np.diag(pairs)[FIXED:], of[FIXED:], FIXED)])
    return best


def _train(texts: DataFrame, *, min_count: int = MIN_COUNT, held: int | None = HELD, seeds: int = SEEDS, classes: int = CLASSES, passes: int = PASSES, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model, and (h, n, class) of the training words that it doesn't hold; those of less than min_count have no class."""
    sc = texts.sparkSession.sparkContext
    counts = written(texts.mapInArrow(_count_words, "h bigint, shape bigint, n bigint").groupBy("h").agg(F.first("shape").alias("shape"), F.sum("n").alias("n")))
    ends = texts.count()
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n = tokens + ends
    clustered = counts.where(F.col("n") >= min_count)
    all_words = clustered.count()
    held = all_words if held is None else min(max(held, seeds), all_words)
    ranked = _ranked(counts, min_count) if held < all_words else None
    got = (clustered if ranked is None else ranked.where(F.col("rank") < held)).select("h", F.col("shape").cast("byte").alias("shape"), "n").toArrow().combine_chunks()
    h, shape, many = got["h"].to_numpy().view(U64), got["shape"].to_numpy().astype(np.int64), got["n"].to_numpy()
    rank = np.lexsort((h, -many))
    h, shape, many = h[rank], shape[rank], many[rank]
    order = np.argsort(h)
    words = Vocabulary(h[order], (FIXED + order).astype(np.int32), many[order])
    seeds = min(seeds, all_words)
    total = FIXED + (classes if all_words else 0)
    of = np.empty(FIXED + all_words, np.int16)
    of[:FIXED], of[FIXED : FIXED + held] = np.arange(FIXED), shape

    share = sc.broadcast(words)
    more = ranked is not None
    lists = "words array<struct<h: bigint, shape: tinyint, around: binary>>, pairs array<struct<h: bigint, shape: tinyint, next: bigint, next_shape: tinyint>>"
    runs = written(texts.mapInArrow(lambda it: _sequences(it, share.value, more), f"s binary, {lists}"))
    sequences = runs.select("s")
    if more:
        tail = ranked.where(F.col("rank") >= held)
        for r in tail.select(F.col("rank").cast("int").alias("rank"), "shape").toArrow().to_batches():
            of[FIXED + r.column(0).to_numpy()] = r.column(1).to_numpy()
        ranks, symbol = tail.select("h", "rank"), F.coalesce(F.col("rank") + FIXED, "shape").cast("int")
        # the first word of a pair, found, is what the second has before it
        before = F.concat(F.unhex(F.lpad(F.hex(symbol), 8, "0")), F.unhex(F.lit(f"{BREAK & 0xFFFFFFFF:X}")))
        second = runs.selectExpr("inline(pairs)").join(ranks, "h", "left").select(F.col("next").alias("h"), F.col("next_shape").alias("shape"), before.alias("around"))
        found = runs.selectExpr("inline(words)").unionByName(second).join(ranks, "h", "left").select(symbol.alias("symbol"), "around")
        sequences = sequences.union(written(found.mapInArrow(_filled, "s binary")))

    def class_pairs(of: np.ndarray, total: int) -> np.ndarray:
        given = sc.broadcast(of)
        m = np.zeros(total * total)
        for r in sequences.mapInArrow(lambda it: _class_pairs(it, given.value, total), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow().to_batches():
            m[r.column(0).to_numpy()] = r.column(1).to_numpy()
        given.unpersist()
        return m.reshape(total, total)

    if seeds:
        apart = of.astype(np.int32)
        apart[FIXED : FIXED + seeds] = FIXED + np.arange(seeds)
        of[: FIXED + seeds] = seed_classes(class_pairs(apart, FIXED + seeds), classes, passes)
    m = class_pairs(of, total)
    first, rest = FIXED + seeds, all_words - seeds
    if rest and rounds:
        buckets = int(min(max(1, rest // BUCKET_WORDS, n // BUCKET_TOKENS), MOST_BUCKETS, rest))
        links = sequences.mapInArrow(lambda it: _links(it, first, buckets), "bucket int, links binary")
        links = written(links.repartition("bucket").sortWithinPartitions("bucket"))
    for step in range(rounds if rest else 0):
        size = m.sum(1)
        prior = (size + 0.5) / (m.sum() + 0.5 * total)
        after = np.log((m + SMOOTH * prior[None, :]) / (size[:, None] + SMOOTH))
        before = np.log(m.T + SMOOTH * prior[:, None])
        given = sc.broadcast((of, (after, before, np.log(size + 0.5)), None if step == 0 else step % 2))
        moves = links.mapInArrow(lambda it: _moved(it, first, buckets, rest, *given.value), "word int, class int").toArrow().combine_chunks()
        if not moves.num_rows:
            break
        new = of.copy()
        new[moves["word"].to_numpy()] = moves["class"].to_numpy()
        new_m = class_pairs(new, total)
        if step and likelihood(new_m) <= likelihood(m):
            break
        of, m = new, new_m
    size, kinds = np.zeros(total), np.zeros(total)
    for s, c, v in counts.groupBy("shape").agg(F.sum("n"), F.count("*")).collect():
        size[s], kinds[s] = c, v
    for sign, where in ((-1, shape), (1, of[FIXED : FIXED + held])):
        np.add.at(size, where, sign * many)
        np.add.at(kinds, where, sign)
    others = counts.where(F.col("n") < min_count).selectExpr("h", "n", "cast(null as int) class")
    if more:
        given = sc.broadcast(of)
        tail = written(tail.mapInArrow(lambda it: _classed(it, given.value), "h bigint, shape byte, n bigint, class int"))
        for s, k, c, v in tail.groupBy("shape", "class").agg(F.sum("n"), F.count("*")).collect():
            size[[s, k]] += [-c, c] if s != k else [0, 0]
            kinds[[s, k]] += [-v, v] if s != k else [0, 0]
        others = others.union(tail.select("h", "n", "class"))
    size[END], kinds[END] = ends, 1
    prior = (size + 0.5) / (n + 0.5 * total)
    transition = np.log10((m + SMOOTH * prior[None, :]) / (m.sum(1)[:, None] + SMOOTH))
    return Model(words, of[: FIXED + held], transition, np.log10(size + 0.5 * (kinds + 1)), n, types + 1 if n else 0, ends), others


def _score_batches(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(key, n_tokens, known, logs, seq, h, places): held words' sums, the classes so far, and the other words and their places."""
    log_count = np.log10(model.words.counts + 0.5)
    kind = np.min_scalar_type(len(model.transition) - 1)
    for batch in batches:
        for i, j, data, offs in slices(batch.column(1)):
            h, shape, first = _tokens(data, offs)
            docs = j - i
            doc = np.repeat(np.arange(docs), np.diff(first))
            at = _find(model.words.hashes, h)
            known = at >= 0
            n_known = np.bincount(doc[known], minlength=docs)
            logs = np.bincount(doc[known], weights=log_count[at[known]], minlength=docs).astype(np.float64)
            k = shape.copy()
            k[known] = model.symbol_class[model.words.symbols[at[known]]]
            seq = _with_ends(k, first, END).astype(kind)
            cuts = pa.py_buffer(((first + np.arange(docs + 1)) * kind.itemsize).astype(np.int32))
            place = np.arange(len(h)) - first[:-1][doc]
            columns = [
                batch.column(0).slice(i, docs), pa.array(np.diff(first) + 1), pa.array(n_known), pa.array(logs),
                pa.Array.from_buffers(pa.binary(), docs, [None, cuts, pa.py_buffer(seq)]), *_others(doc[~known], h[~known], place[~known], docs),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "known", "logs", "seq", "h", "places"])


def _steps(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(key, n_tokens, known, logs, rest) of (key, n_tokens, known, logs, seq, class, places), when all classes are known."""
    kind = np.min_scalar_type(len(model.transition) - 1)
    spread = model.spread.copy()
    spread[END] = 0.0  # the end is its class's only word
    for batch in batches:
        for i, j, data, offs in slices(batch.column(4)):
            seq, starts = data.view(kind).copy(), offs // kind.itemsize
            _fill(seq, starts[:-1], batch.column(5).slice(i, j - i), batch.column(6).slice(i, j - i))
            step = model.transition[np.concatenate([[END], seq[:-1]]), seq] - spread[seq]
            rest = np.add.reduceat(step, starts[:-1])
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in range(4)], pa.array(rest)], ["key", "n_tokens", "known", "logs", "rest"])


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **training: int | None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row.

    Rows whose crc32 of the key as text is 1 modulo 5 are held out; rows with a null key train. training: min_count, held,
    seeds, classes, passes and rounds, see above.
    """
    spark = docs.sparkSession
    out = F.coalesce(F.crc32(docs[key].cast("string")) % 5 == 1, F.lit(False))
    model, others = _train(docs.where(~out).select(F.coalesce(docs[text], F.lit("")).alias("text")), **training)
    share = spark.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    fields = f"key {kind}, n_tokens bigint, known bigint, logs double"
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    schema = f"{fields}, seq binary, h array<bigint>, places array<array<int>>"
    found = written(rows.mapInArrow(lambda it: _score_batches(it, share.value), schema).withColumn("row", F.monotonically_increasing_id()))
    # words that training lacks add log10(0.5) each
    more, seen = F.sum(F.expr("size(places) * log10(coalesce(n, 0) + 0.5D)")).alias("more"), F.sum(F.expr("if(n is null, 0, size(places))")).alias("seen")
    sums = _met(found, "row", others, "class", more, seen)
    added = (F.col("known") + F.coalesce("seen", F.lit(0))).alias("known"), (F.col("logs") + F.coalesce("more", F.lit(0.0))).alias("logs")
    classes = [F.coalesce(c, F.expr("array()")).alias(c) for c in ("class", "places")]
    all_ = found.drop("h", "places").join(sums, "row", "left").select("key", "n_tokens", *added, "seq", *classes).mapInArrow(lambda it: _steps(it, share.value), f"{fields}, rest double")
    whole = float(np.log10(model.tokens + 0.5 * (model.types + 1)))
    end = float(np.log10(model.ends + 0.5))
    result = all_.select(
        F.col("key").alias(key), F.coalesce(F.crc32(F.col("key").cast("string")) % 5 == 1, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("known") + F.lit(int(model.ends > 0))).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.lit(end) - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("logs") + F.col("rest")).alias("score"),
    )
    return result.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
