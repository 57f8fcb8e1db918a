import math
import random

import numpy as np

from lakeloom.llm import ann


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def brute(rows, k=20, every=20):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(v)
    out = {}
    for q in good:
        if q % every == 0:
            out[q] = sorted((-max(dot(a, v) for a in good[q] for v in vs), i) for i, vs in good.items() if i != q)[:k]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 list", "'x' id", "2 score")


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    return out


def test_small_tables_with_odd_vectors_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [round(rng.gauss(0, 1), 2) for _ in range(8)]) for i in range(120)]
    rows += [(200 + i, [0.5] * 8) for i in range(60)]  # ties
    rows += [(300, None), (320, [0.0] * 8), (340, [1.0, None] * 4), (360, [float("nan")] * 8), (380, [float("inf")] * 8), (400, []), (420, [1.0]), (None, [1.0] * 8)]
    assert found(ann.neighbours(table(spark, rows))) == brute(rows)
    assert ann.neighbours(table(spark, rows[-8:-3])).count() == 0
    assert brute(rows)[420]  # a shorter vector has zeros for what it lacks
    few = rows[:5]
    assert found(ann.neighbours(table(spark, few))) == brute(few)


def test_recall_against_brute_force(spark):
    rng = random.Random(4)
    mid = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(40)]
    rows = [(i, [m + rng.gauss(0, 0.6) for m in rng.choice(mid)]) for i in range(6000)]
    rows += [(i, mid[0]) for i in range(6000, 8000)]  # a crowded list
    got, want = found(ann.neighbours(table(spark, rows))), brute(rows)
    assert got.keys() == want.keys()
    hits = sum(len({x[0] for x in want[q]} & {x[0] for x in got[q]}) / len({x[0] for x in want[q]}) for q in want) / len(want)
    assert hits >= 0.9
    assert [i for _, i in got[0]] == [i for _, i in sorted(got[0])] and len(got[0]) == 20


def test_repeated_rows_count_once_before_the_cut(spark):
    rng = random.Random(5)
    v = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(0, v), (20, [-x for x in v]), (20, v)] + [(7, v)] * 30 + [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(100, 160)]
    got = found(ann.neighbours(table(spark, rows)))
    assert got == brute(rows) and len(got[0]) == 20


def test_huge_components_keep_their_order(spark):
    rows = [(i, [1e200 * (i + 1), 1e200]) for i in range(0, 40)] + [(100, [1e-200, 0.0])]
    got = found(ann.neighbours(table(spark, rows)))
    assert [i for _, i in got[100]] == list(range(39, 19, -1)) and len(got[0]) == 20


def test_an_infinite_ratio_is_exact_and_clusters_are_read_in_part(spark):
    rng = random.Random(6)
    flat = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(3000)]
    assert found(ann.neighbours(table(spark, flat), ratio=float("inf"))) == brute(flat)
    x = np.concatenate([np.random.default_rng(1).normal(c, 0.05, (250, 8)) for c in np.random.default_rng(2).normal(0, 1, (40, 8))])
    graph = ann.CentroidGraph.build(ann.balanced_centroids(ann._lift(x, np.sqrt((x * x).sum(1)).max()), 40))
    lifted = ann._lift(x, np.sqrt((x * x).sum(1)).max())
    row, home = ann._home_lists(graph, lifted)
    homes = {}
    for r, h in zip(row.tolist(), home.tolist()):
        homes.setdefault(r, []).append(h)
    ids = np.arange(0, len(x), 50)
    near = np.argsort(((lifted[ids, None] - lifted[None]) ** 2).sum(2), axis=1)[:, :20]
    probing = ann.measured_probing([(int(q), int(v)) for q, vs in zip(ids, near) for v in vs], homes, graph, ids, lifted[ids], 0.98, 0)
    at, _ = probing.lists(graph, lifted[ids], np.full(len(graph.centroids), 250))
    assert len(at) / len(ids) < 0.25 * len(graph.centroids)
