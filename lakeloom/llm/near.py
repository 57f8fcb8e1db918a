"""Groups of near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, and what they reach.

Words are those of the fingerprints (A-Z lowered, cut at ASCII white space); a text of fewer words is one shingle of all
its words, and texts without words have the empty set, equal to itself. Texts of equal sets are one node.

Nodes are linked by SimHash: fingerprints of 256 bits of their shingles, multi-index search in 16 segments with balls of one bit,
verified distances (simhash.wide_links), and then the exact similarity of the sets. A pair at 0.8 lies outside all balls with a probability
of 0.5 %, and of a crowd only the closest links are checked. So that no link is lost, what that leaves is completed by MinHash: BANDS keys of
ROWS minima each. A pair of similarity s shares none with a probability of (1 - s**ROWS)**BANDS: 5e-8 at 0.8, less above.

Nodes that share a key form a bucket, which is never gathered. Its nodes, wherever they lie, are compared by the exact similarity of
their sets with the bucket's pivots (the same few serve all buckets of a group of copies), and groups are made of all
links. Pairs within a bucket's largest group need no further look; every node outside it is compared with all nodes
of the bucket, in blocks of bounded size. So no link between groups is lost, no task holds a bucket, and a group of copies
costs about one comparison a node; what is paid in full is a large bucket of texts that are not similar.

Sets are named by a 64-bit hash, texts travel and sets are made anew where they are compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import simhash
from lakeloom.llm._components import components
from lakeloom.llm._durable import written
from lakeloom.llm._text import U64, buffers, give_back, mix64, shingle_hashes, slices, span_hashes, word_spans
from lakeloom.llm.simhash import wide_prints

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
#: Nodes in a block of those outside a bucket's largest group, and of all; rows and bytes up to which a table is broadcast.
OUT_BLOCK, BLOCK, BROADCAST_ROWS, BROADCAST_BYTES = 256, 1024, 200_000, 16 << 20
#: Pivots of a bucket, each the least by a hash of its own.
PIVOTS = 2
_FACTORS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=U64)) | U64(1)
_MASKS = mix64(np.arange(1001, BANDS * ROWS + 1001, dtype=U64))


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, offsets of the texts in them)."""
    low, starts, ends, first = word_spans(data, offs)
    words, counts = span_hashes(low, starts, ends), np.diff(first)
    whole = shingle_hashes(words, SHINGLE)
    n = np.where(counts == 0, 0, np.maximum(counts - SHINGLE + 1, 1))
    doc = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][doc]
    h = np.zeros(len(doc), U64)
    long = counts[doc] >= SHINGLE
    h[long] = whole[at[long]]
    for k in range(1, SHINGLE):
        short = counts[doc] == k
        if short.any():
            h[short] = shingle_hashes(words, k)[at[short]]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(counts) + 1))


def band_keys(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """BANDS keys of each set; sets must not be empty."""
    keys = np.zeros((len(offs) - 1, BANDS), U64)
    if len(offs) < 2:
        return keys
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat((h ^ _MASKS[k]) * _FACTORS[k], offs[:-1])
        keys[:, k // ROWS] = mix64(keys[:, k // ROWS] * U64(0x9DDFEA08EB382D69) + least + U64(k // ROWS + 1))
    return keys


def _band_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, mark, sid, size, fp, bands) of (key, mark, text): sid is a hash of the set; the empty set has no bands."""
    for batch in batches:
        for i, j, data, offs in slices(batch.column(2)):
            h, at = shingle_sets(data, offs)
            total = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(h + U64(1)), dtype=U64)])
            sid = mix64(total[at[1:]] - total[at[:-1]])
            some = np.flatnonzero(np.diff(at))
            keys = band_keys(h, np.append(at[some], len(h)))
            cuts = np.concatenate([[0], np.cumsum((np.diff(at) > 0) * BANDS)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys.ravel().view(np.int64)))
            prints = wide_prints(h, np.repeat(np.arange(j - i), np.diff(at)), np.diff(at))
            fp = pa.array([row.tobytes() for row in prints], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(sid.view(np.int64)), pa.array(np.diff(at)), fp, bands], ["key", "mark", "sid", "size", "fp", "bands"])


def _near(x: np.ndarray, flat: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of several sets, concatenated in flat, are similar to the sorted set x."""
    if not len(x):
        return sizes == 0
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    both = np.bincount(owner[x[at] == flat], minlength=len(sizes))
    return both >= SIMILARITY * (sizes + len(x) - both) - 1e-9


def _pair_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the similar pairs among rows (a, b, text of a, text of b)."""
    for batch in batches:
        keep = []
        for k in range(0, batch.num_rows, 256):
            sides = []
            for c in (2, 3):
                data, offs = buffers(batch.column(c).slice(k, 256))
                sides.append(shingle_sets(data, offs))
            (h, at), (g, to) = sides
            for r in range(len(at) - 1):
                one, two = h[at[r] : at[r + 1]], g[to[r] : to[r + 1]]
                keep.append(bool(_near(one, two, np.zeros(len(two), np.int64), np.array([len(two)]))[0]))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        give_back()


def _block_links(outside: pa.Table, members: pa.Table) -> pa.Table:
    """(a, b): links that join up a block of nodes outside a bucket's largest group and a block of all its nodes.

    Columns sid, top (whether in the largest group), text. One link to the largest group is enough for each node outside.
    """
    out: list[tuple[int, int]] = []
    if outside.num_rows and members.num_rows:
        sides = []
        for t in (outside, members):
            h, at = shingle_sets(*buffers(t["text"].combine_chunks()))
            sides.append((t["sid"].to_numpy(), h, at))
        (a, h, at), (b, flat, to) = sides
        top = members["top"].to_numpy()
        sizes = np.diff(to)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        of = {int(x): int(x) for x in (*a, *b)}

        def root(x: int) -> int:
            while of[x] != x:
                of[x] = x = of[of[x]]
            return x

        one = int(b[np.argmax(top)]) if top.any() else None
        for m in b[top].tolist():
            of[m] = one
        for k, x in enumerate(a.tolist()):
            for y in b[_near(h[at[k] : at[k + 1]], flat, owner, sizes)].tolist():
                if root(x) != root(y):
                    of[root(x)] = root(y)
                    out.append((x, y))
    give_back()
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _links(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) between nodes (sid, first, size, fp, bands), complete up to reachability; rows (key, mark, text)."""
    close = written(simhash.wide_links(nodes.where("size > 0").select("sid", "fp")))
    in_bands = nodes.select("sid", "size", F.explode("bands").alias("band"))
    least = [F.min(F.struct(F.xxhash64("sid", F.lit(k)), "sid", "size")).alias(f"p{k}") for k in range(PIVOTS)]
    shared = in_bands.groupBy("band").agg(F.count("*").alias("n"), *least).where("n > 1")
    pivots = F.array(*[F.struct(F.col(f"p{k}.sid").alias("sid"), F.col(f"p{k}.size").alias("size")) for k in range(PIVOTS)])
    member = written(in_bands.join(shared.select("band", "n", F.array_distinct(pivots).alias("pivots")), "band"))
    alike = F.filter("pivots", lambda p: (p["sid"] != F.col("sid")) & (F.least("size", p["size"]) >= SIMILARITY * F.greatest("size", p["size"]) - 1e-9))
    asked = member.select("sid", alike["sid"].alias("pivots"), F.exists("pivots", lambda p: p["sid"] == F.col("sid")).alias("is_pivot"))
    asked = asked.union(close.selectExpr("a", "array(b)", "false")).union(close.selectExpr("b", "array()", "true"))
    asked = asked.groupBy("sid").agg(F.array_distinct(F.flatten(F.collect_set("pivots"))).alias("pivots"), F.bool_or("is_pivot").alias("is_pivot"))
    asked = asked.join(nodes.selectExpr("sid", "first.key", "first.mark"), "sid")
    # rows that are equal in all columns meet where the join has dealt them out
    met = rows.join(asked, ["key", "mark"]).groupBy("key", "mark").agg(F.first(F.struct("sid", "text", "pivots", "is_pivot")).alias("x")).select("x.*")
    texts = written(met)
    pivots = texts.where("is_pivot").select(F.col("sid").alias("b"), F.col("text").alias("other"))
    size = pivots.agg(F.sum(F.octet_length("other"))).first()[0] or 0
    pairs = texts.select(F.col("sid").alias("a"), "text", F.explode("pivots").alias("b"))
    pairs = pairs.join(F.broadcast(pivots) if size <= BROADCAST_BYTES else pivots, "b").select("a", "b", "text", "other")
    links = written(pairs.mapInArrow(_pair_batches, "a bigint, b bigint"))
    labels = components(links).withColumnRenamed("node", "sid")
    placed = written(member.where("n > 2").join(labels, "sid", "left").select("sid", "band", F.coalesce("component", "sid").alias("c")))
    sides = placed.groupBy("band", "c").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("sid")).alias("mark"))
    groups = sides.groupBy("band").agg(F.max_by("c", F.struct("k", "c")).alias("largest"), F.sum("k").alias("n"), F.max("k").alias("most"), F.bit_xor("mark").alias("mark"))
    # buckets of the same nodes are one
    plan = groups.where("n > most").groupBy("mark", "n").agg(F.min_by(F.struct("band", "largest", "most"), "band").alias("g"))
    plan = written(plan.selectExpr("g.band", "g.largest", f"int(ceil((n - g.most) / {OUT_BLOCK})) outs", f"int(ceil(n / {BLOCK})) blocks"))
    n_plan = plan.count()
    if not n_plan:
        return links
    todo = placed.join(_small(plan, n_plan), "band").withColumn("top", F.expr("c = largest"))
    one = todo.where("not top").selectExpr("band", "int(pmod(xxhash64(sid, 1), outs)) i", "explode(sequence(0, blocks - 1)) j", "sid", "top")
    all_ = todo.selectExpr("band", "explode(sequence(0, outs - 1)) i", "int(pmod(xxhash64(sid, 2), blocks)) j", "sid", "top")
    cells = ["band", "i", "j"]
    both = [x.join(texts.select("sid", "text"), "sid").select(*[F.col(c).alias(c) for c in (*cells, "sid", "top", "text")]).groupBy(*cells) for x in (one, all_)]
    return links.union(both[0].cogroup(both[1]).applyInArrow(_block_links, "a bigint, b bigint"))


def firsts(docs: DataFrame, *, key: str, mark: str, text: str) -> DataFrame:
    """(key, mark) of the first row of each group of near copies, by key and then mark. Rows with a null key are left out."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(mark).alias("mark"), F.col(text).alias("text"))
    all_ = rows.mapInArrow(_band_batches, f"key {kind}, mark bigint, sid bigint, size bigint, fp binary, bands array<bigint>")
    nodes = written(all_.groupBy("sid").agg(F.min(F.struct("key", "mark")).alias("first"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    labels = components(_links(nodes, rows))
    return nodes.select("sid", "first").join(labels.withColumnRenamed("node", "sid"), "sid", "left").groupBy(F.coalesce("component", "sid").alias("c")).agg(F.min("first").alias("f")).selectExpr("f.key", "f.mark")
