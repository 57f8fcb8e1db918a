"""Approximate nearest neighbours by inner product: balanced posting lists behind a graph of centroids.

Inner product becomes Euclidean distance by one more coordinate, sqrt(M^2 - |x|^2) with M the greatest norm (a query
gets 0 and is scaled to norm M, which keeps its order). Centroids are fitted on a bounded sample, taken by hash, by recursive
halving and a few assignments that penalise full clusters. A nearest-centroid graph in memory answers which lists are near a
vector (best-first search), for indexing and querying alike. Every row is indexed: it goes to its nearest list and, if
it lies near a boundary (distance within the replica ratio, and no list already taken lies between), to further ones.
A query reads the lists whose distance is within the probe ratio of the nearest one, however many these are. Lists are cut
into blocks of bounded size on both sides, so that no list, however crowded with copies, lies in one task.

The probe ratio is measured, not fixed: a bounded sample of the queries is compared with all rows, and the ratio is the least
with which their lists hold the share `recall` of their true neighbours. Where vectors form clusters this is close to 1 and few
lists are read; where they don't, it says so by reading much. ratio=float("inf") reads all lists and is exact.

Scores are inner products of the original vectors in double precision, added up in coordinate order (one that isn't a
number, by overflow, comes last). Vectors that are null, zero, or hold null or non-finite components take no part; nor do rows
without id. A vector shorter than the longest has zeros for what it lacks. Rows that repeat an id count once, at their best score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm._durable import written

SAMPLE_ROWS = 40_000
LIST_ROWS = 250
#: The centroids' graph is broadcast: at most this many, whatever the table's size, no more than half of the sample, and
#: no more than so many bytes of centroids hold.
MAX_LISTS, CENTROID_BYTES = 16_384, 64 << 20
#: Lists a row may lie in, and how much further than its nearest list; a list is skipped if one already taken is nearer
#: to it than NEAR_LIST times the row's own distance.
REPLICAS, REPLICA_RATIO, NEAR_LIST = 4, 1.2, 0.35
#: Share of the true neighbours that the lists read must hold, on average over the queries measured, and how many these are.
RECALL, MEASURED = 0.98, 256
#: A query goes on to the next lists, whatever their distance, until the lists it reads hold so many vectors.
LEAST_READ = 400
DEGREE, BEAM, EXPAND = 24, 96, 8
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 5, weight: float = 0.3, seed: int = 0) -> np.ndarray:
    """At most `lists` centroids of clusters of about equal size."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while len(parts) < lists:
        parts.sort(key=len)
        rows = parts.pop()
        if len(rows) < 2:
            parts.append(rows)
            break
        two = x[rng.choice(rows, 2, replace=False)]
        for _ in range(4):
            side = ((x[rows] - two.mean(0)) @ (two[1] - two[0])) > 0
            if side.all() or not side.any():
                break
            two = np.stack([x[rows[~side]].mean(0), x[rows[side]].mean(0)])
        order = np.argsort(x[rows] @ (two[1] - two[0]), kind="stable")
        parts += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    c = np.stack([x[p].mean(0) for p in parts])
    share, load = len(x) / len(c), np.array([len(p) for p in parts], dtype=np.float64)
    for _ in range(rounds):
        near = np.empty(len(x), dtype=np.int64)
        for i in range(0, len(x), 2048):
            d = _distances(x[i : i + 2048], c)
            near[i : i + 2048] = (d * d + weight * d.min(1)[:, None] ** 2 * (load / share - 1).clip(0)[None, :]).argmin(1)
        load = np.bincount(near, minlength=len(c)).astype(np.float64)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(load[:, None] > 0, total / np.maximum(load, 1)[:, None], c)
    return np.unique(c, axis=0)


@dataclass
class CentroidGraph:
    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, c: np.ndarray, degree: int = DEGREE, seed: int = 0) -> CentroidGraph:
        """Nearest neighbours by half, random long links by the other; spread entries."""
        n, rng = len(c), np.random.default_rng(seed)
        degree = min(degree, max(n - 1, 1))
        near = np.empty((n, degree), dtype=np.int64)
        for i in range(0, n, 1024):
            near[i : i + 1024] = np.argpartition(_distances(c[i : i + 1024], c), min(degree, n - 1), axis=1)[:, :degree]
        far = rng.integers(0, n, (n, max(2, degree // 4)))
        return cls(c, np.hstack([near, far]), rng.choice(n, min(n, 32), replace=False))

    def search(self, x: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances), nearest first, of the k lists found nearest to each row of x."""
        n, c = len(self.centroids), self.centroids
        beam = min(max(beam, k), n)
        rows = np.arange(len(x))[:, None]
        seen = np.zeros((len(x), n), dtype=bool)
        seen[:, self.entries] = True
        ids = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        dist = _distances(x, c[self.entries])
        done = np.zeros(ids.shape, dtype=bool)
        norm = (c * c).sum(1)
        mine = (x * x).sum(1)[:, None]
        while True:
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, done = ids[rows, order], dist[rows, order], done[rows, order]
            open_ = np.where(done | np.isinf(dist), np.inf, dist)
            if np.isinf(open_).all():
                break
            pick = np.argsort(open_, axis=1, kind="stable")[:, : min(max(EXPAND, beam // 8), open_.shape[1])]
            usable = np.isfinite(open_[rows, pick])
            done[rows, pick] = True
            new = np.where(usable[:, :, None], self.neighbours[ids[rows, pick]], -1).reshape(len(x), -1)
            new = np.sort(new, axis=1)
            fresh = (new >= 0) & ~seen[rows, new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            r, at = np.nonzero(fresh)
            to = new[r, at]
            seen[r, to] = True
            d = np.full(new.shape, np.inf)
            d[r, at] = np.sqrt(np.maximum(norm[to] + mine[r, 0] - 2 * np.einsum("ij,ij->i", x[r], c[to]), 0))
            width = max(1, int(fresh.sum(1).max()))
            keep = np.argsort(d, axis=1, kind="stable")[:, :width]
            ids = np.hstack([ids, new[rows, keep]])
            dist = np.hstack([dist, d[rows, keep]])
            done = np.hstack([done, np.zeros((len(x), width), dtype=bool)])
        return ids[:, :k], dist[:, :k]


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))[:, None]])


def _home_lists(graph: CentroidGraph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of each row's nearest list and its replicas."""
    ids, dist = graph.search(x, REPLICAS)
    c, taken = graph.centroids, np.isfinite(dist)
    taken &= dist <= REPLICA_RATIO * dist[:, :1]
    taken[:, 0] = True
    for j in range(1, ids.shape[1]):
        for i in range(j):
            between = np.sqrt(((c[ids[:, i]] - c[ids[:, j]]) ** 2).sum(1))
            taken[:, j] &= ~(taken[:, i] & (between < NEAR_LIST * dist[:, j]))
    row, at = np.nonzero(taken)
    return row, ids[row, at]


@dataclass
class Probing:
    """Which lists a query reads: those within `ratio` of its nearest one (taken as `least` at least), and those that
    come before it has read `rows` vectors. `hint`: how many lists to ask the graph for at first."""

    ratio: float
    least: float
    rows: int
    hint: int

    def lists(self, graph: CentroidGraph, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): all of them; rows whose last list found would still be read ask for twice as many."""
        out, todo, k, n = [], np.arange(len(x)), max(1, self.hint), len(graph.centroids)
        while len(todo):
            if k * 2 >= n:
                dist = _distances(x[todo], graph.centroids)
                ids = np.argsort(dist, axis=1, kind="stable")
                dist = np.take_along_axis(dist, ids, axis=1)
            else:
                ids, dist = graph.search(x[todo], k)
            before = np.cumsum(sizes[ids], axis=1) - sizes[ids]
            reach = self.ratio * np.maximum(dist[:, :1], self.least)
            read = np.isfinite(dist) & ((dist <= reach) | (before < self.rows))
            enough = ~read[:, -1] if k * 2 < n else np.ones(len(todo), dtype=bool)
            row, at = np.nonzero(read & enough[:, None])
            out.append((todo[row], ids[row, at]))
            todo, k = todo[~enough], k * 2
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _nearest(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k nearest ids in one block, ties to the smaller id; never the query's own row."""
    own, peak = np.abs(q).max(1, keepdims=True), np.abs(v).max(initial=0) or 1.0  # against overflow
    order = np.argsort(v_ids, kind="stable")
    v_ids, v = v_ids[order], v[order]
    begin = np.flatnonzero(np.concatenate([[True], v_ids[1:] != v_ids[:-1]]))
    rough = (q / own) @ (v / peak).T
    slack = 1e-9 * (1 + np.abs(rough).max())
    rough[q_ids[:, None] == v_ids[None, :]] = -np.inf
    floor = np.full(len(q_ids), -np.inf)
    if len(begin) > k:  # the k-th best id, not row
        best = rough if len(begin) == len(v_ids) else np.maximum.reduceat(rough, begin, axis=1)
        floor = -np.partition(-best, k - 1, axis=1)[:, k - 1]
    row, col = np.nonzero((rough >= floor[:, None] - slack) & np.isfinite(rough))
    score = np.zeros(len(row))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(q.shape[1]):
            score += q[row, d] * v[col, d]
    score[np.isnan(score)] = -np.inf
    order = np.lexsort((-score, v_ids[col], row))
    row, col, score = row[order], col[order], score[order]
    once = np.ones(len(row), dtype=bool)
    once[1:] = (row[1:] != row[:-1]) | (v_ids[col[1:]] != v_ids[col[:-1]])
    row, col, score = row[once], col[once], score[once]
    order = np.lexsort((v_ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    first = np.searchsorted(row, np.arange(len(q_ids)))
    keep = np.arange(len(row)) - first[row] < k
    return q_ids[row[keep]], v_ids[col[keep]], score[keep]


def _best_of(best: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best ids of each query; an id counts once."""
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.selectExpr("*", "int(row_number() over (partition by query_id order by score desc, vec_id)) rank")
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def compared(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """The exact k nearest of the given queries among all rows (id, e): each task sends at most k rows for a query."""
    held = rows.sparkSession.sparkContext.broadcast((ids, q))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_ = held.value
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def cut(parts):
            a, b, s = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((b, -s, a))
            a, b, s = a[order], b[order], s[order]
            seen: dict[tuple[int, int], None] = {}
            count: dict[int, int] = {}
            for at, pair in enumerate(zip(a.tolist(), b.tolist())):
                if pair not in seen and count.get(pair[0], 0) < k:
                    seen[pair] = at
                    count[pair[0]] = count.get(pair[0], 0) + 1
            at = np.array(list(seen.values()), dtype=np.int64)
            return [(a[at], b[at], s[at])]

        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                kept.append(_nearest(q_ids, q_, part.column(0).to_numpy(), _vectors(part.column(1)), k))
                kept = cut(kept) if len(kept) > 4 else kept
        for a, b, s in cut(kept) if kept else ():
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], ["query_id", "vec_id", "score"])

    return _best_of(rows.select("id", "e").mapInArrow(scan, "query_id bigint, vec_id bigint, score double"), k)


def measured_probing(truth: list[tuple[int, int]], homes: dict[int, list[int]], graph: CentroidGraph, ids: np.ndarray, x: np.ndarray, recall: float, least_read: int) -> Probing:
    """The least ratio with which lists of the queries x hold the share `recall` of the true pairs (query, vector)."""
    dist = _distances(x, graph.centroids)
    least = float(np.median(dist.min(1))) if len(x) else 0.0
    reach = np.maximum(dist.min(1), least)
    at = {int(i): n for n, i in enumerate(ids)}
    need = np.array([min(dist[at[q], c] for c in homes[v]) / max(reach[at[q]], 1e-300) for q, v in truth if v in homes])
    ratio = max(1.0, float(np.quantile(need, recall, method="higher"))) if len(need) else 1.0
    within = (dist <= ratio * reach[:, None] * (1 + 1e-9)).sum(1)
    return Probing(ratio * (1 + 1e-9), least, least_read, int(within.max(initial=1)) + 8)


def neighbours(
    table: DataFrame, *, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", sample_rows: int = SAMPLE_ROWS, max_lists: int = MAX_LISTS,
    recall: float = RECALL, measured: int = MEASURED, ratio: float | None = None, least_read: int = LEAST_READ,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, the rows whose id is divisible by `every`.

    ratio: the probe ratio if it is to be given and not measured on `measured` queries; infinite: all lists, exact.
    """
    spark = table.sparkSession
    usable = "e is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x <> 0)"
    rows = table.select(table[key].cast("bigint").alias("id"), table[vector].alias("e")).where("id is not null").where(usable)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    n, length, peak = rows.agg(F.count("*"), F.max(F.size("e")), F.max(F.expr("array_max(transform(e, x -> abs(double(x))))"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    kind = rows.schema["e"].dataType.simpleString()
    rows = rows.select("id", F.expr(f"if(size(e) = {length}, e, concat(e, cast(array_repeat(0, {length} - size(e)) as {kind})))").alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + (x.cast("double") / F.lit(peak)) * (x.cast("double") / F.lit(peak))))
    top = rows.agg(F.max(norm)).first()[0]
    whole = 1 << 30

    def some(of: DataFrame, out_of: int, want: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, vectors) of `want` rows, those of the least hash of the id."""
        mark = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(whole))
        got = of.withColumn("mark", mark).where(F.col("mark") <= int(min(1.0, 1.5 * want / out_of + 1e-3) * whole)).orderBy("mark", "id").limit(want).select("id", "e").toArrow().combine_chunks()
        return got["id"].to_numpy(), _vectors(got["e"].combine_chunks()) if got.num_rows else np.zeros((0, length))

    _, x = some(rows, n, sample_rows, 1)
    lists = int(max(1, min(max_lists, n // LIST_ROWS, len(x) // 2, CENTROID_BYTES // (8 * (length + 1)))))
    graph = CentroidGraph.build(balanced_centroids(_lift(x / peak, top), lists)) if len(x) else CentroidGraph.build(np.zeros((1, length + 1)))
    held = spark.sparkContext.broadcast(graph)

    def place(batches: Iterable[pa.RecordBatch], pick) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                row, to = pick(_vectors(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], ["list", "id", "e"])

    def as_query(v: np.ndarray) -> np.ndarray:
        v = v / np.abs(v).max(1, keepdims=True)
        return np.hstack([v * (top / np.sqrt((v * v).sum(1)))[:, None], np.zeros((len(v), 1))])

    posted = written(rows.mapInArrow(lambda it: place(it, lambda v: _home_lists(held.value, _lift(v / peak, top))), f"list int, id bigint, e {kind}"))
    sizes = np.zeros(len(graph.centroids), dtype=np.int64)
    for r in posted.groupBy("list").count().collect():
        sizes[r[0]] = r[1]
    queries = rows.where(F.col("id") % every == 0)
    if ratio is None:
        q_ids, q = some(queries, max(1, n // every), measured, 2)
        q_ids, at = np.unique(q_ids, return_index=True)
        q = q[at]
        truth = [(r.query_id, r.vec_id) for r in compared(rows, q_ids, q, k).collect()] if len(q) else []
        true_ids = spark.createDataFrame([(v,) for v in sorted({v for _, v in truth})], "id bigint")
        homes: dict[int, list[int]] = {}
        for r in posted.join(F.broadcast(true_ids), "id", "left_semi").select("id", "list").distinct().collect():
            homes.setdefault(r.id, []).append(r.list)
        probing = measured_probing(truth, homes, graph, q_ids, as_query(q) if len(q) else np.zeros((0, length + 1)), recall, least_read)
    else:
        probing = Probing(ratio, 0.0, least_read, len(sizes) if np.isinf(ratio) else 64)
    probes = written(queries.mapInArrow(lambda it: place(it, lambda v: probing.lists(held.value, as_query(v), sizes)), f"list int, id bigint, e {kind}"))
    asks = np.zeros(len(sizes), dtype=np.int64)
    for r in probes.groupBy("list").count().collect():
        asks[r[0]] = r[1]
    grid = spark.createDataFrame([(i, int(max(1, -(-s // BLOCK_ROWS))), int(max(1, -(-a // BLOCK_QUERIES)))) for i, (s, a) in enumerate(zip(sizes, asks))], "list int, vb int, qb int")
    grid = F.broadcast(grid)
    v_side = posted.join(grid, "list").selectExpr("list", "int(pmod(xxhash64(id), vb)) v", "explode(sequence(0, qb - 1)) q", "id", "e")
    q_side = probes.join(grid, "list").selectExpr("list", "explode(sequence(0, vb - 1)) v", "int(pmod(xxhash64(id), qb)) q", "id", "e")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if left.num_rows and right.num_rows:
            one, two = left.combine_chunks(), right.combine_chunks()
            sides = [(t["id"].to_numpy(), _vectors(t["e"].combine_chunks())) for t in (two, one)]
            out = _nearest(*sides[0], *sides[1], k)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    cells = ("list", "v", "q")
    met = v_side.groupBy(*cells).cogroup(q_side.groupBy(*cells)).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    return _best_of(met, k)
